"""Language identification: words first, then character n-grams.

A model holds log frequencies by language of the words and of the character n-grams from 5 down to 1 that its labelled rows have twice or
more. A word that it knows scores by the word's frequency in each language; a word that it does not know scores by the longest n-grams of
which it knows any, the mean of those. A text's language has the largest sum over its words; the score is its posterior
probability under equal priors.

Words are runs of letters and marks with a letter, lower case, with their boundaries taken into the n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, _high_powers, _ipow_low, _pow_low, in_arrow, letters, mix, text_blocks

#: Labelled rows from which a model is fitted, in expectation; with fewer, all of them. This bounds the model's tables.
SAMPLE_ROWS = 40_000
#: Words and n-grams that the labelled rows have less often stay out of the tables; 1 keeps all.
LEAST_COUNT = 2
LONGEST = 5
SMOOTH = 0.5


class Words:
    """The words of some texts as code points; every text stands between two boundaries."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        kind, lower = letters()
        raw, cut = data.tobytes(), off.tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cps = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        of = kind[cps]
        inside = of > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        if (of == 1).any():  # a run of marks alone is no word
            full = np.concatenate([[0], np.cumsum(of == 2)])
            some = full[self.end] > full[self.start]
            self.start, self.end = self.start[some], self.end[some]
        self.first = np.searchsorted(self.start, np.concatenate([[1], 1 + np.cumsum(size + 1)]))
        codes = mix(np.where(inside, lower[cps], 0).astype(np.uint64) + np.uint64(1))
        n, high = len(codes), _high_powers(len(codes))[0]
        codes *= np.multiply.outer(high[: (n >> 12) + 1], _pow_low).ravel()[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= _high_powers(len(self.sums))[1][start >> 12] * _ipow_low[start & 4095]
        return mix(h + (end - start).astype(np.uint64) * PLACE[0])

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place in words) of all n-grams of some words, boundaries included."""
        begin, size = self.start[words] - 1, self.end[words] - self.start[words] + 2 - (n - 1)
        size = np.maximum(size, 0)
        own = np.repeat(np.arange(len(words)), size)
        at = np.repeat(begin, size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        return self.hash(at, at + n), own


class Model:
    """tables[0]: words, tables[n]: n-grams; each (sorted hashes, log frequencies by language)."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def lookup(self, n: int, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        keys = self.tables[n][0]
        if not len(keys):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[i] == h, i, -1)

    def word_scores(self, w: Words, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        row = self.lookup(0, h)
        out[row >= 0] = self.tables[0][1][row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            g, own = w.grams(words[left], n)
            row = self.lookup(n, g)
            g, own = row[row >= 0], own[row >= 0]
            count = np.bincount(own, minlength=len(left))
            table = self.tables[n][1]
            for k in range(len(self.langs)):
                out[left, k] = np.bincount(own, table[g, k], minlength=len(left)) / np.maximum(count, 1)
            left = left[count == 0]
        return out

    def predict(self, column) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, _, data, off in text_blocks(column):
            w = Words(data, off)
            h = w.hash(w.start, w.end)
            _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
            each = self.word_scores(w, pick, h[pick])
            total = np.zeros((len(off) - 1, len(self.langs)))
            for k in range(len(self.langs)):
                sums = np.concatenate([[0], np.cumsum(each[inverse, k])])
                total[:, k] = sums[w.first[1:]] - sums[w.first[:-1]]
            some = np.diff(w.first) > 0
            if self.langs:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, share, some = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some), bool)
            names += [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores += np.where(some, share, 0.0).tolist()
        return names, scores


def _counts(rows: DataFrame) -> DataFrame:
    """(n, hash, lang, count) over rows (text, lang); counted in each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                found: list[list] = [[] for _ in range(LONGEST + 1)]
                for _, _, data, off in text_blocks(batch.column(0).filter(pa.array(langs == lang))):
                    w = Words(data, off)
                    for n in range(LONGEST + 1):
                        found[n].append(np.unique(w.grams(np.arange(len(w.start)), n)[0] if n else w.hash(w.start, w.end), return_counts=True))
                for n, parts in enumerate(found):
                    h, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([y for _, y in parts]), minlength=len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array([lang] * len(h), pa.string()), pa.array(c.astype(np.int64))], ["n", "hash", "lang", "count"])

    return in_arrow(rows.select("text", "lang"), run, "n int, hash long, lang string, count long")


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, least_count: int = LEAST_COUNT) -> Model:
    """A model from labelled rows: about sample_rows of them, chosen by a hash of their key. Rows without text or label do not count.

    The driver gets one table: a row of counts by language for each word and n-gram that occurs least_count times; the
    sample bounds it. No labelled row gives a model without languages.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample_rows / total)))
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    if not langs:
        return Model([], {n: (np.zeros(0, np.uint64), np.zeros((0, 0))) for n in range(LONGEST + 1)})
    found = _counts(rows).groupBy("n", "hash").agg(F.sum("count").alias("total"), *by_lang).where(F.col("total") >= least_count).drop("total").toArrow()
    kind, tables = found.column("n").to_numpy(), {}
    keys, count = found.column("hash").to_numpy().view(np.uint64), np.stack([found.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1)
    for n in range(LONGEST + 1):
        own = np.flatnonzero(kind == n)
        own = own[np.argsort(keys[own])]
        c = count[own] + SMOOTH
        tables[n] = keys[own], np.log(c / np.maximum(c.sum(axis=0, keepdims=True), 1e-9))
    return Model(langs, tables)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of df: ``und`` and 0 for a text that is null or has no letter, or without a model.

    Equal sums go to the language that sorts first. Rows with null or repeated ids are judged each; only id and text are
    read; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = sent.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double")
