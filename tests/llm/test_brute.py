"""The registered queries over whole small tables against plain versions; those that SQL can express are in test_sql.py too."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from meander.llm import bpe, decontaminate, lang_id, quality, queries, suffix_dedup

D = "/root/testdata/sf0.01"


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{D}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))


@pytest.fixture(scope="module")
def items():
    t = pq.read_table(f"{D}/benchmark.parquet").to_pydict()
    return dict(zip(t["item_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def run(spark):
    made = {}

    def rows(name):
        if name not in made:
            made[name] = {r["doc_id"]: r for r in queries.QUERIES[name](spark, D).collect()}
        return made[name]

    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_leaks(docs, items):
    """(doc, item) whose best diagonal stretch of tokens is long enough, every diagonal tried."""
    tokens = lambda t: [fold(w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)]
    out = set()
    for d, text in docs.items():
        doc, places = tokens(text), defaultdict(list)
        for i, w in enumerate(doc):
            places[w].append(i)
        for item, passage in items.items():
            own = tokens(passage)
            need = min(decontaminate.LEAST_TOKENS, len(own))
            on = Counter(i - j for j, w in enumerate(own) for i in places.get(w, ()))
            for diagonal, n in on.items():
                if n < need or not own:
                    continue
                best = run = equal = length = 0
                top = (0, 0)
                for j, w in enumerate(own):
                    if 0 <= j + diagonal < len(doc):
                        same = doc[j + diagonal] == w
                        run, equal, length = run + (1 if same else -decontaminate.SUBSTITUTION), equal + same, length + 1
                        if run <= 0:
                            run = equal = length = 0
                        if run > best:
                            best, top = run, (equal, length)
                if top[0] >= need and top[0] >= decontaminate.LEAST_SHARE * top[1]:
                    out.add((d, item))
    return out


def plain_components(docs, words, percent):
    sets = {}
    for d, t in docs.items():
        w = words_of(fold(t))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a_, b_ = find(a), find(b)
                    root[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_op4(run, docs):
    got = run("op4_quality_rules")
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        w, seen, again = words_of(t), set(), 0
        for line in t.split("\n"):
            if words_of(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = Counter(windows)
        inside = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside), failed)
        assert not (r.kept and failed)


def plain_script(text):
    """The class by script: most letters of a listed one; none if letters and marks are few."""
    words = [c for w in words_of(text) for c in w]
    kinds = [unicodedata.category(c)[0] for c in words]
    if 3 * sum(k in "LM" for k in kinds) < max(len(words), 3):
        return "none"
    count = Counter()
    for c, k in zip(words, kinds, strict=True):
        if k in "LM" or c.isascii() and c.isalpha():
            count.update(s for s, ranges in quality.SCRIPTS.items() if any(a <= ord(c) <= z for a, z in ranges))
    return max(quality.SCRIPTS, key=lambda s: count[s]) if count else "other"


def plain_fertility(text, model):
    words = words_of(text)
    ids = [i for w in words for i in model.encode(w)]
    n, count = len(ids), Counter(ids)
    return n, sum(map(len, words)) / max(n, 1), sum(model.is_byte(i) for i in ids) / max(n, 1), -sum(c / n * math.log2(c / n) for c in count.values())


ODD = {
    "symbols": " ".join("#$%&"[i % 4] * 2 + "*@!~"[i // 3 % 4] + "^+=-"[i // 5 % 4] for i in range(60)),
    "glyphs": " ".join(chr(0x2500 + i * 7 % 128) + chr(0x2600 + i * 11 % 112) + chr(0x1F300 + i) for i in range(60)),
    "hieroglyphs": " ".join(chr(0x13000 + i) + chr(0x13100 + i) for i in range(60)),
    "numbers": " ".join(str(i * 7919 % 10007) for i in range(60)),
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα, είναι προικισμένοι με λογική και συνείδηση",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם",
    "marks": "\u0301 \u0302 " * 20 + " ".join("\u0300\u0301\u0302"[: 1 + i % 3] for i in range(12)),
}


def test_op4_figures(spark, run, docs):
    """The fertility figures, the class and the verdict by plain definitions, also of odd texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    langs = dict(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect())
    odd = {r.id: r for r in quality.quality_rules(spark.createDataFrame([*ODD.items()], "doc_id string, text string"), queries.tokenizer("piece_bpe_32k.model")).collect()}
    rows = [(docs[d], langs[d], r) for d, r in run("op4_quality_rules").items()] + [(ODD[d], None, r) for d, r in odd.items()]
    for text, lang, r in rows:
        n, per_token, share, entropy = plain_fertility(text, model)
        assert (r.n_tokens, r.chars_per_token, r.byte_share) == (n, pytest.approx(per_token), pytest.approx(share)) and r.token_entropy == pytest.approx(entropy, abs=1e-9)
        script = plain_script(text)
        assert r.script == (f"{script}_{lang}" if n >= quality.SHORT_TOKENS and f"{script}_{lang}" in quality.BANDS else script)
        b = quality.BANDS[r.script]
        floor = max([f for least, f in b.min_entropy if least <= n], default=0)
        inside = b.min_chars_per_token <= r.chars_per_token <= b.max_chars_per_token and r.byte_share <= b.max_byte_share and r.token_entropy >= floor
        assert r.kept == (not r.base_failed and inside)
    assert [odd[k].script for k in ODD] == ["none", "none", "other", "none", "greek", "hebrew", "other"]
    assert [odd[k].kept for k in ODD] == [False, False, False, False, True, True, False]


def test_op5(run, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got = run("op5_bpe")
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def plain_jump(key, shards):
    """The published loop, in whole numbers of 64 bits."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_op6(run, docs):
    got = run("op6_sharding")
    assert got.keys() == docs.keys()
    slots = defaultdict(list)
    for d, r in got.items():
        raw = docs[d].encode()
        key = int(hashlib.md5(str(d).encode()).hexdigest()[:16], 16)
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(key, 8), plain_jump(key, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_repeats(docs, width=suffix_dedup.WIDTH):
    least = {}
    for d in sorted(docs):
        raw = docs[d].encode()
        for i in range(len(raw) - width + 1):
            least.setdefault(raw[i : i + width], d)
    out = {}
    for d, t in docs.items():
        raw = t.encode()
        mark = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < d:
                mark[i] += 1
                mark[i + width] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = len(raw), int(gone.sum()), runs, sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 8, 0])
def test_op7(spark, crowd):
    passage = "a passage that all of these share, long enough for many windows and for more than one anchor of them"
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    more = dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True)) | {10**6 + i: f"{i * 7919} before {passage[i % 9 :]}{'' if i % 3 else ' and'} {i % 5} after {i}" for i in range(200)}
    df = spark.createDataFrame([*more.items()], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, crowd=crowd).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_repeats(more)


def test_op10(run, docs):
    got = run("op10_lang_id")
    assert got.keys() == docs.keys()
    t = pq.read_table(f"{D}/documents.parquet").to_pydict()
    right = []
    for d, lang, text in zip(t["doc_id"], t["lang"], t["text"], strict=True):
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang:
            right.append(r.lang_pred == lang)
    assert len(right) > 20 and np.mean(right) >= 0.95


def plain_words(text):
    """Runs of letters and marks that have a letter, in lower case where that is one code point."""
    kind = lambda c: unicodedata.category(c)[0]
    runs = [w for w in "".join(c if kind(c) in "LM" else "\n" for c in text).split("\n") if any(kind(c) == "L" for c in w)]
    return ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in runs]


def plain_grams(word, n):
    w = f"\n{word}\n"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n else [word]


def test_op10_by_plain_model(run):
    """Tables, backing off and scores by dictionaries of strings."""
    t = pq.read_table(f"{D}/documents.parquet").to_pydict()
    count = [defaultdict(Counter) for _ in range(lang_id.LONGEST + 1)]
    for d, lang, text in zip(t["doc_id"], t["lang"], t["text"], strict=True):
        if zlib.crc32(str(d).encode()) % 5 and lang is not None and text is not None:
            for w in plain_words(text):
                for n in range(lang_id.LONGEST + 1):
                    for g in plain_grams(w, n):
                        count[n][g][lang] += 1
    langs = sorted({x for c in count[0].values() for x in c})
    tables = []
    for c in count:
        kept = {g: x for g, x in c.items() if sum(x.values()) >= lang_id.LEAST_COUNT}
        total = {k: sum(x[k] + lang_id.SMOOTH for x in kept.values()) for k in langs}
        tables.append({g: [math.log((x[k] + lang_id.SMOOTH) / total[k]) for k in langs] for g, x in kept.items()})
    got = run("op10_lang_id")
    for d, text in zip(t["doc_id"], t["text"], strict=True):
        sums = np.zeros(len(langs))
        words = plain_words(text or "")
        for w in words:
            for n in (0, *range(lang_id.LONGEST, 0, -1)):
                known = [tables[n][g] for g in plain_grams(w, n) if g in tables[n]]
                if known:
                    sums += np.mean(known, axis=0)
                    break
        if not words:
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
        else:
            assert got[d].lang_pred == langs[int(sums.argmax())] and got[d].score == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=2e-6)


def test_pipeline(spark, run, docs, items):
    """Each stage on what the plain version of the stages before it keeps."""
    from tokenizers import Tokenizer

    rows = queries.table(spark, D, "documents")
    kept = {d: t for d, t in docs.items() if run("op4_quality_rules")[d].kept}
    near = plain_components(kept, 5, 80)
    kept = {d: t for d, t in kept.items() if near[d][1] == d}
    leaked = {d for d, _ in plain_leaks(kept, items)}
    kept = {d: t for d, t in kept.items() if d not in leaked}
    left = rows.where(rows.doc_id.isin([*kept]))
    redacted = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, left, D).collect()}
    assert redacted.keys() == kept.keys() and redacted[min(kept)].__fields__ == rows.columns
    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert got.keys() == kept.keys()
    for d, r in got.items():
        ids = t.encode(redacted[d].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_decode(spark):
    """Ids back to texts as the library does, also ids that end inside a character."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = ["plain words", "", "é中\U0001f600 <|endoftext|> x", "a" * 1000, " \n\t "]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts] + [t.encode("中\U0001f600").ids[:-1]]
    df = spark.createDataFrame([*enumerate(ids), (None, None), (0, ids[0])], "id long, ids array<int>")
    got = sorted(((r.id if r.id is not None else -1, r.text) for r in bpe.decode(df, queries.tokenizer("byte_bpe_50k.json")).collect()))
    assert got == sorted([*((i, t.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids)), (-1, ""), (0, texts[0])])


def test_other_files_are_refused(tmp_path):
    with open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        (tmp_path / "t.json").write_text(f.read(), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        bpe.Vocabulary(str(tmp_path / "t.json"))
