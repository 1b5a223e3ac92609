"""SQL (DuckDB) of the registered queries whose rows it can give: by plain definitions, not by the operators' methods."""

from __future__ import annotations

from . import decontaminate, lang_id, secret_scan, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

#: Every pair of places with equal tokens, by diagonal; a stretch from one to a later one, most equal tokens first.
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT item_id, regexp_extract_all({FOLDED}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
tw AS (SELECT item_id, len(w) AS m, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS j FROM t),
on_diagonal AS (SELECT doc_id, item_id, i - j AS g, any_value(m) AS m, list(j ORDER BY j) AS js FROM dw JOIN tw USING (w) GROUP BY doc_id, item_id, i - j HAVING count(*) >= least({decontaminate.LEAST_TOKENS}, any_value(m))),
ends AS (SELECT doc_id, item_id, g, m, unnest(js) AS j, generate_subscripts(js, 1) AS k FROM on_diagonal),
stretches AS (SELECT a.doc_id, a.item_id, a.g, b.k - a.k + 1 AS n_equal, b.j - a.j + 1 AS n_tokens, a.g + a.j AS first_token, b.j AS z
  FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.g = b.g AND b.k >= a.k AND b.k - a.k + 1 >= {decontaminate.LEAST_SHARE} * (b.j - a.j + 1) AND b.k - a.k + 1 >= least({decontaminate.LEAST_TOKENS}, a.m)),
of_diagonal AS (SELECT * FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY n_equal DESC, z) = 1)
SELECT doc_id, item_id, n_equal, n_tokens, first_token, CAST(n_equal AS DOUBLE) / n_tokens AS share FROM of_diagonal
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, first_token, g) = 1"""

#: All pairs that share a shingle, and reachability.
NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
runs AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, s FROM runs WHERE s IS NOT NULL UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM w GROUP BY doc_id HAVING count(*) < 3),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN links ON a = y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)"""

#: Every window of 50 bytes as 100 hexadecimal digits; texts in stretches of 1000 bytes, since cutting takes longer far inside a text.
SUFFIX_DEDUP = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, 1000 * k AS pos, strlen(x) // 2 - 1000 * k AS n, substr(x, 2000 * k + 1, 2098) AS x FROM (SELECT doc_id, x, unnest(range(0, strlen(x) // 2000 + 1)) AS k FROM h) z),
w AS (SELECT doc_id, pos + i AS pos, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, pos, x, unnest(range(0, greatest(0, least(1000, n - 49)))) AS i FROM p) z),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
late AS (SELECT doc_id, pos FROM w JOIN first USING (s) WHERE doc_id > least),
gaps AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS opens FROM late),
runs AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM gaps),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS z FROM runs GROUP BY doc_id, r),
before AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM before JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)"""

CHAT_FORMAT = r"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', t FROM said UNION ALL SELECT -1, 1, 'assistant', t FROM said),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + len(regexp_extract_all(role, '<\\*\|')) + 5 * len(regexp_extract_all(role, '\n')) + 1
    + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11) AS BIGINT) AS formatted_chars,
  list(role ORDER BY turn, role, text) AS r, list(text ORDER BY turn, role, text) AS x
FROM c GROUP BY conv_id),
s AS (SELECT *, r[1] = 'system' AS sys, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS talk FROM g)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  CASE WHEN talk = ['user', 'assistant'] AND NOT sys AND x[1] LIKE '%?' THEN 'question_answer'
    WHEN talk = ['user', 'assistant'] AND NOT sys THEN 'prompt_response'
    WHEN talk = ['user', 'assistant'] AND contains(x[3], chr(10)) THEN 'prompt_completion'
    WHEN talk = ['user', 'assistant'] THEN 'instruction'
    WHEN len(talk) > 0 AND len(list_filter(talk, lambda y: y NOT IN ('user', 'assistant'))) = 0 THEN 'from_value'
    ELSE 'messages' END AS layout
FROM s"""


def _either_case(words: str) -> str:
    """Letters of a pattern in either case, of ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _secret_kind(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    if name == "assign":
        pattern = pattern.removeprefix("(?i)")
        head, rest = pattern.split(")", 1)
        pattern = _either_case(head) + ")" + rest
    p = pattern.replace("'", "''")
    ok = f"length(v) >= {least}" + (" AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if name == "mixed" else "")
    return f"""SELECT doc_id, owner, {kind} AS kind, '{name}' AS name, v, fin - length(whole) AS start, fin FROM (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS fin FROM (
    SELECT doc_id, owner, unnest(whole) AS whole, unnest(v) AS v, unnest(gaps[:len(whole)]) AS gap, generate_subscripts(whole, 1) AS i FROM (
      SELECT doc_id, owner, regexp_extract_all(t, '{p}') AS whole, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS gaps FROM d) x) y) z WHERE {ok}"""


SECRET_SCAN = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_secret_kind(k, *p) for k, p in enumerate(secret_scan.PATTERNS))}),
o AS (SELECT v, CASE WHEN count(DISTINCT owner) > {secret_scan.MAX_OWNERS} OR count(DISTINCT (owner, doc_id)) > {secret_scan.MAX_REPOSITORIES} * count(DISTINCT owner) THEN 'example'
  WHEN len(list_distinct(string_split(v, ''))) >= {secret_scan.LEAST_CHARACTERS} AND NOT regexp_matches(v, '{secret_scan.PLACEHOLDER}') THEN 'live' ELSE 'weak' END AS verdict FROM f GROUP BY v),
s AS (SELECT doc_id, kind, name, start, fin, verdict, name || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT) AS span FROM f JOIN o USING (v) WHERE name <> 'mixed' OR verdict = 'live'),
g AS (SELECT doc_id, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access, count(*) FILTER (WHERE name = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, kind, fin) FILTER (WHERE name <> 'mixed') AS base, string_agg(span, ',' ORDER BY start, kind, fin) AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)"""


def _crc_table() -> list[int]:
    """The CRC-32 of each byte, by its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


TAB = f"t AS (SELECT {_crc_table()}::BIGINT[] AS tab)"


def _crc32(text: str) -> str:
    digits = f"regexp_extract_all(hex(encode({text})), '..')"
    return f"xor(list_reduce(list_transform({digits}, lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: xor(tab[1 + (xor(a, x) & 255)], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def token_counts(first: set[str], rest: set[str]) -> str:
    """SQL of op2 for a vocabulary: the longest piece at each place of each distinct word, and the walk along them."""

    def listed(pieces: set[str]) -> str:
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(pieces)) + "]"

    longest = max(map(len, first | rest))
    return rf"""
WITH RECURSIVE p AS (SELECT unnest({listed(first)}) AS s, TRUE AS opens UNION ALL SELECT unnest({listed(rest)}), FALSE),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS w FROM d),
dw AS (SELECT w, length(w) AS n FROM w GROUP BY w),
i AS (SELECT w, n, unnest(range(1, n + 1)) AS i FROM dw),
c AS (SELECT w, i, substr(w, i, CAST(l AS BIGINT)) AS s, i = 1 AS opens FROM (SELECT w, i, unnest(range(1, least({longest}, n - i + 1) + 1)) AS l FROM i) z),
best AS (SELECT w, i, max(length(s)) AS l FROM c JOIN p USING (s, opens) GROUP BY w, i),
walk(w, i, k) AS (SELECT w, 1::BIGINT, 0::BIGINT FROM dw UNION ALL SELECT w, walk.i + l, k + 1 FROM walk JOIN best USING (w, i)),
ends AS (SELECT w, max(k) FILTER (WHERE i = n + 1) AS k FROM walk JOIN dw USING (w) GROUP BY w),
g AS (SELECT doc_id, count(*) AS n_words, sum(coalesce(k, 1)) AS n_tokens, count(*) FILTER (WHERE k IS NULL) AS n_unknown FROM w JOIN ends USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, coalesce(n_unknown, 0) AS n_unknown FROM documents LEFT JOIN g USING (doc_id)"""


#: The jump hash as a recursion. The order of slots is that of a single range: up to that many rows for each shard.
SHARDING = f"""
WITH RECURSIVE {TAB},
k AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS crc, substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS hex FROM documents, t),
j(doc_id, state, b, ahead) AS (SELECT doc_id, CAST('0x' || hex AS UBIGINT)::HUGEINT, -1::BIGINT, 0::BIGINT FROM k
  UNION ALL SELECT doc_id, s, ahead, CAST(floor((ahead + 1) * (2147483648::DOUBLE / CAST((s // 8589934592) + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM j WHERE ahead < 9) z),
s AS (SELECT doc_id, max(b) FILTER (WHERE b < 8) AS shard, max(b) AS grown FROM j GROUP BY doc_id)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY hex, doc_id, crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM k JOIN s USING (doc_id) WHERE (SELECT count(*) FROM documents) <= {8 * sharding.ROWS_PER_RANGE}"""

#: Words and n-grams as strings; all labelled rows, so for tables that have no more than the sample.
LANG_ID = rf"""
WITH {TAB},
d AS (SELECT doc_id, lang, text, {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS held_out FROM documents, t),
w AS (SELECT doc_id, lang, held_out, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+'), lambda x: regexp_matches(x, '\p{{L}}'))) AS w FROM d),
dw AS (SELECT DISTINCT w FROM w),
g AS (SELECT w, 0 AS n, w AS g FROM dw UNION ALL SELECT w, n, substr(chr(10) || w || chr(10), CAST(i AS BIGINT), n) FROM (SELECT w, n, unnest(range(1, length(w) + 4 - n)) AS i FROM dw, (SELECT unnest(range(1, {lang_id.LONGEST + 1})) AS n) y) z),
learned AS (SELECT w, lang, count(*) AS c FROM w WHERE NOT held_out AND lang IS NOT NULL GROUP BY w, lang),
langs AS (SELECT DISTINCT lang FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT n, g, lang, sum(c) AS c FROM learned JOIN g USING (w) GROUP BY n, g, lang),
kept AS (SELECT n, g FROM counts GROUP BY n, g HAVING sum(c) >= {lang_id.LEAST_COUNT}),
smooth AS (SELECT n, g, lang, coalesce(c, 0) + {lang_id.SMOOTH}::DOUBLE AS c FROM kept CROSS JOIN langs LEFT JOIN counts USING (n, g, lang)),
logs AS (SELECT n, g, lang, ln(c / sum(c) OVER (PARTITION BY n, lang)) AS p FROM smooth),
level AS (SELECT w, arg_min(n, CASE WHEN n = 0 THEN 0 ELSE 10 - n END) AS n FROM g JOIN kept USING (n, g) GROUP BY w),
scores AS (SELECT w, lang, avg(p) AS p FROM level JOIN g USING (w, n) JOIN logs USING (n, g) GROUP BY w, lang),
sums AS (SELECT doc_id, scores.lang AS lang, sum(p) AS s FROM w JOIN scores USING (w) GROUP BY doc_id, scores.lang),
best AS (SELECT doc_id, lang, 1 / sum(exp(s - m)) OVER (PARTITION BY doc_id) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM (SELECT doc_id, lang, s, max(s) OVER (PARTITION BY doc_id) AS m FROM sums) z)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN best b USING (doc_id) WHERE r IS NULL OR r = 1"""

ORACLE_SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op3_near_dup": NEAR_DUP,
    "op6_sharding": SHARDING,
    "op7_suffix_dedup": SUFFIX_DEDUP,
    "op8_chat_format": CHAT_FORMAT,
    "op9_secret_scan": SECRET_SCAN,
    "op10_lang_id": LANG_ID,
}
