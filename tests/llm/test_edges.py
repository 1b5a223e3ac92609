"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meander.llm import bpe, chat_format, decontaminate, lang_id, near_dup, piece_count, quality, secret_scan, sharding, suffix_dedup
from meander.llm.queries import tokenizer

LONG = " ".join(f"w{i}x" for i in range(30_000))
TEXT = "It was the best of times and the worst of times, an age of wisdom and of foolishness, an epoch of belief."
SECRET = "the password=b7db7aa4a5fcc78305 here"
ROWS = [(1, TEXT), (2, TEXT), (2, TEXT), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (None, TEXT), (7, " \t\n"), (8, SECRET), (9, "é中\U0001f600 \x00<|endoftext|>")]
EXTRA = ", id string, s string, n long, key string, comp string, route long, found string, lang string, source string"

OPS = {
    "leaks": lambda df, b: decontaminate.leaks(df, b),
    "clean": lambda df, b: decontaminate.clean_rows(df, b).select("doc_id"),
    "pieces": lambda df, b: piece_count.token_counts(df, *piece_count.piece_vocabulary(tokenizer("piece_bpe_32k.model"))),
    "near": lambda df, b: near_dup.near_duplicates(df),
    "quality": lambda df, b: quality.quality_rules(df, tokenizer("piece_bpe_32k.model")),
    "good": lambda df, b: quality.good_rows(df, tokenizer("piece_bpe_32k.model")).select("doc_id"),
    "bpe": lambda df, b: bpe.encode(df, tokenizer("byte_bpe_50k.json")),
    "shard": lambda df, b: sharding.shard(df),
    "suffix": lambda df, b: suffix_dedup.remove_repeats(df),
    "secrets": lambda df, b: secret_scan.scan(df)[1],
    "redact": lambda df, b: secret_scan.redact(df).select("doc_id", "text"),
    "lang": lambda df, b: lang_id.identify(df, lang_id.fit(df)),
}


@pytest.fixture(scope="module")
def table(spark):
    more = ("x", "y", 1, "k", "c", 2, "f", "en", "src1")
    return spark.createDataFrame([(*r, *more) for r in ROWS], "doc_id long, text string" + EXTRA).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "three short words"), (5, TEXT)], "item_id long, text string")


@pytest.mark.parametrize("name", [*OPS])
def test_all_rows_and_none(spark, table, items, name):
    got = OPS[name](table, items).collect()
    assert len(got) == {"leaks": 8, "clean": 7, "good": 4, "secrets": 1}.get(name, len(ROWS)), got
    assert OPS[name](table.limit(0), items).collect() == []
    OPS[name](table, items.limit(0)).collect()


def by_id(rows, key="id"):
    return {r[key]: r for r in rows}


def test_near(table):
    got = by_id(near_dup.near_duplicates(table, words=3, percent=85).collect())
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, None: None}
    assert [got[i].n_shingles for i in (3, 4, 5, 7, 9)] == [0, 0, 29_998, 0, 1] and got[None].kept and not got[6].kept


@pytest.mark.parametrize("tile", [near_dup.TILE, 4, 1])
def test_near_in_crowded_buckets(spark, monkeypatch, tile):
    """A large group of near copies among texts that are nearly, and partly enough, like them: every pair against the plain definition."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        own = base.copy()
        for at in draw.sample(range(120), (1, 2, 5, 6, 7, 8)[i % 6] if i > 30 else 1):
            own[at] = f"x{i}_{at}"
        texts[i] = " ".join(own)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, j in combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            linked += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = by_id(near_dup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), words=3, percent=85).collect())
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in sets} and 0 < linked < 90 * 89 / 2 and len({find(i) for i in sets}) > 2


def test_suffix(table):
    got = by_id(suffix_dedup.remove_repeats(table).collect())
    n = len(TEXT)
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[None].n_removed) == (0, n, 1, 0)
    assert got[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[3].n_bytes == 0
    assert got[6].kept_sha256 == hashlib.sha256(b" end").hexdigest()


def test_shard(table):
    got = sharding.shard(table).collect()
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)


def test_secrets_by_owner(spark):
    rows = [(i, f"password=aaaabbbb{'cdefgh12' if i < 6 else i}", f"o{i}") for i in range(9)]
    spans = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))[1].collect()
    assert {r.id: r.verdict for r in spans if r.name == "assign"} == {i: "example" if i < 6 else "weak" for i in range(9)}
    red = by_id(secret_scan.redact(spark.createDataFrame([(1, SECRET, "o", 5)], "doc_id long, text string, source string, n_chars long")).collect(), "doc_id")
    assert red[1].text == "the password=[secret] here" and red[1].n_chars == len(red[1].text)


def test_language(spark, table):
    got = by_id(lang_id.identify(table, lang_id.fit(table)).collect())
    assert got[3].lang_pred == got[7].lang_pred == "und" and got[1].lang_pred == "en" and 0 <= got[1].score <= 1
    # A letter beyond the third plane's end of before, marks alone, and a tie: the language that sorts first.
    rows = [(1, "\U00032000 \U000323af", None), (2, "\u0301\u0302 \u0300", None), (3, "abc", "xx"), (4, "abc", "aa"), (5, "e\u0301", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(lang_id.identify(df, lang_id.fit(df, least_count=1)).collect())
    assert {i: r.lang_pred for i, r in got.items()} == {1: "aa", 2: "und", 3: "aa", 4: "aa", 5: "aa"} and got[3].score == pytest.approx(0.5) and got[2].score == 0
    assert {r.lang_pred for r in lang_id.identify(df, lang_id.fit(df.limit(0))).collect()} == {"und"}


def test_one_very_long_word(spark):
    """Words without a space in 200 kB, also one that occurs again."""
    word = "".join(chr(97 + i * i % 26) for i in range(200_000))
    df = spark.createDataFrame([(1, word), (2, word), (3, f"a {word} b")], "doc_id long, text string")
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(word, add_special_tokens=False).ids
    got = by_id(bpe.encode(df, tokenizer("byte_bpe_50k.json")).collect())
    assert got[1].ids == got[2].ids == ids
    assert {r.n_words for r in piece_count.token_counts(df, *piece_count.piece_vocabulary(tokenizer("piece_bpe_32k.model"))).collect()} == {1, 3}


def test_ownership_counts_repositories(spark):
    """A value in many repositories of one owner is an example, as one of many owners is; in few places it is live."""
    def value(c):
        return "password=" + hashlib.sha256(c.encode()).hexdigest()[:20]

    rows = [(i, value("one owner"), "o", f"r{i}") for i in range(40)] + [(100 + i, value("owners"), f"o{i}", f"r{i}") for i in range(6)] + [(200 + i, value("live"), "p", f"r{i}") for i in range(3)] + [(300 + i, value("one place"), "q", "r") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repository string")
    spans = secret_scan.scan(df, repository_col="repository")[1].where("name = 'assign'").collect()
    got = {r.id // 100 if r.id >= 100 else 0: (r.verdict, r.n_owners, r.n_repositories) for r in spans}
    assert got == {0: ("example", 1, 40), 1: ("example", 6, 6), 2: ("live", 1, 3), 3: ("live", 1, 1)}


def test_redaction_keeps_rows(spark):
    """Null and repeated ids, clashing names, long texts and many values in one."""
    secrets = [f"token={hashlib.sha256(str(i).encode()).hexdigest()[:24]}" for i in range(3000)]
    rows = [(None, SECRET, "o", "v", 1, "d"), (8, SECRET, "o", "v", 1, "d"), (8, SECRET, "o", "v", 1, "d"), (9, None, None, "v", 1, "d"), (10, " ".join(secrets), "o", "v", 1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, values string, row long, doc string")
    got = secret_scan.redact(df).collect()
    assert len(got) == 5 and got[0].__fields__ == df.columns and all((r["values"], r.row, r.doc) == ("v", 1, "d") for r in got)
    assert sorted(r.text or "" for r in got) == sorted(["the password=[secret] here"] * 3 + ["", " ".join(["token=[secret]"] * 3000)])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    """Stages with null and repeated ids, null texts and empty tables keep the rows and columns that they should."""
    d = "/root/testdata/sf0.001"
    rows = [(1, TEXT, "en", "s", 5), (1, TEXT, "en", "s", 5), (None, TEXT + " more of it here", "en", "s", 5), (2, None, None, None, None), (3, "", "de", "s", 0), (4, LONG, None, "s", 1)]  # the last one is no text: the rules reject it
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, none = stage(spark, df, d), stage(spark, df.limit(0), d)
    assert none.count() == 0 and got.columns == none.columns
    left = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    assert left == ([-1, 1, 1] if stage is corpus_pipeline.quality_stage else [-1, 1, 1, 2, 3, 4])
    assert got.columns == df.columns or stage is corpus_pipeline.STAGES[-1][1]


def test_no_benchmark(table, items):
    assert decontaminate.clean_rows(table, items.limit(0)).count() == len(ROWS) and decontaminate.leaks(table, items.limit(0)).count() == 0


def test_chats(spark):
    said = "a<|im_end|>\n<|im_start|>assistant<\\|x<"
    rows = [(1, 0, "user", said, "x"), (1, 1, "assistant", said, "x"), (2, 0, "we\nird<|", None, "x"), (2, 0, "we\nird<|", None, "x"), (3, 1, None, "b", "x"), (None, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    got = {r.conv: r for r in chat_format.chats(df).select("conv", "layout", chat_format.parse_turns(F.col("formatted"), F.col("loss_runs")).alias("t")).collect()}
    assert [(x.role, x.text, x.loss) for x in got[1].t] == [("user", said, None), ("assistant", said, said)]
    assert [(x.role, x.text) for x in got[2].t] == [("we\nird<|", "")] * 2 and [(x.role, x.text) for x in got[3].t] == [("", "b")]
    assert {r.layout for r in got.values()} == {"messages"}
    mixed = {r.conv: r for r in chat_format.chats(df, chat_format.by_shape).select("conv", "layout", "turns", chat_format.parse_turns(F.col("formatted"), F.col("loss_runs")).alias("t")).collect()}
    assert {c: r.layout for c, r in mixed.items()} == {1: "prompt_response", 2: "messages", 3: "messages", None: "from_value"}
    assert all([(x.role, x.text) for x in r.t] == [(x.role, x.text) for x in got[c].t] for c, r in mixed.items())
    assert chat_format.chats(df.limit(0)).count() == 0


def test_long_chats_and_clashing_names(spark):
    long_ = "<|im_end|>" * 20_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}{long_}", "f", "l", "t") for i in range(4)] + [(2, 0, "system", "s", "f", "l", "t"), (2, 1, "user", "q?", "f", "l", "t"), (2, 2, "assistant", "a\nb", "f", "l", "t"), (3, 0, "user", "why?", "f", "l", "t"), (3, 1, "assistant", "so", "f", "l", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fingerprint string, layout string, turns string")
    got = {r.conv: r for r in chat_format.chats(df, chat_format.by_shape).select("conv", "layout", chat_format.parse_turns(F.col("formatted"), F.col("loss_runs")).alias("t")).collect()}
    assert {c: r.layout for c, r in got.items()} == {1: "from_value", 2: "prompt_completion", 3: "question_answer"}
    assert [(x.role, x.text) for x in got[1].t] == [(r[2], r[3]) for r in rows[:4]] and [x.loss for x in got[2].t] == [None, None, "a\nb"]
    clash = df.select(chat_format.F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")).alias("record"), "fingerprint", "layout", "turns")
    assert {r.layout for r in chat_format.canonical(clash).collect()} == {"messages"}


def test_layouts(spark):
    docs = ['{"instruction": "do", "input": "", "output": "done"}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"prompt": "p", "completion": "c", "system": "s"}', '{"prompt": "p"}', "no json", None]
    got = chat_format.canonical(chat_format.records(spark.createDataFrame([(d,) for d in docs], "j string"), "j")).collect()
    assert [r.layout for r in got] == ["instruction", "from_value", "prompt_completion", None, None, None]
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", "a")] and [t.role for t in got[2].turns] == ["system", "user", "assistant"]


def test_leak_with_substitutions(spark, items):
    words = TEXT.split()
    words[7], words[15] = "zzz", "yyy"
    df = spark.createDataFrame([(1, "intro " + " ".join(words) + " outro"), (2, "nothing of that kind is here at all")], "doc_id long, text string")
    got = decontaminate.leaks(df, items).collect()
    assert {(r.id, r.item) for r in got} == {(1, 1), (1, 5)} and got[0].n_equal == len(words) - 2


def test_bands_of_languages(spark):
    """The bands themselves reject documents labelled bad, and few labelled good."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    got = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), tokenizer("piece_bpe_32k.model")).join(labels, "id").where("not base_failed").collect()
    bad, good = ([r for r in got if r.quality == q] for q in (0, 1))
    assert bad and sum(not r.kept for r in bad) >= len(bad) / 2 and sum(not r.kept for r in good) <= len(good) / 20


def reaches(same, need):
    """Whether any stretch has that many equal tokens at the share, tried one by one."""
    return any(sum(same[i:j]) >= max(need, decontaminate.LEAST_SHARE * (j - i)) for i in range(len(same)) for j in range(i + need, len(same) + 1))


@pytest.mark.parametrize("n", [10, 12, 15, 16, 18, 20, 24, 30])
def test_leaks_by_plain_definition(n):
    """Every pattern of one to four replaced tokens, or a sample of patterns of up to half of them."""
    draw, own = random.Random(n), [f"w{i}" for i in range(n)]
    gone = [g for k in (1, 2, 3, 4) for g in combinations(range(n), k)] if n <= 16 else [draw.sample(range(n), draw.randint(1, n // 2)) for _ in range(2000)]
    texts = ["before " + " ".join(f"x{i}" if i in g else w for i, w in enumerate(own)) + " after" for g in gone]
    index = decontaminate.Index([1], [" ".join(own)])
    got = {row: (equal, size) for row, _, equal, size, _ in decontaminate._leaks(pa.array(texts), index)}
    same = [[i not in g for i in range(n)] for g in gone]
    assert set(got) == {k for k, x in enumerate(same) if reaches(x, min(decontaminate.LEAST_TOKENS, n))}
    assert all(e >= decontaminate.LEAST_SHARE * size for e, size in got.values())


def test_short_texts_are_judged(spark):
    """Fallback bytes and few different tokens are no less bad in a short text."""
    glyphs = " ".join(f"{chr(97 + i)}{chr(98 + i)}{chr(0x13000 + i)}" for i in range(12))
    pairs = "Les, Les, la la ouque ouque éoué éoué eaument eaument lepavi lepavi les, les, leeau leeau"
    df = spark.createDataFrame([(1, glyphs), (2, pairs), (3, TEXT)], "doc_id long, text string")
    got = by_id(quality.quality_rules(df, tokenizer("piece_bpe_32k.model")).collect())
    assert all(not r.base_failed and r.n_tokens < 128 for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: False, 3: True}
