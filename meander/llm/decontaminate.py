"""Benchmark decontamination by spaced seeds.

A mask says which of some successive tokens are hashed and which are ignored, so a passage with a few words replaced still
shares seeds with its source where plain n-grams break. All masks of all benchmark items make an index; each document's
seeds are looked up in it, and around every hit document and item are compared token by token along the hit's diagonal:
it is a leak if any stretch has LEAST_TOKENS equal tokens at a share of LEAST_SHARE, and the one with most equal tokens is reported.

The masks miss some of those stretches, so two hits of PAIR on one diagonal count as a hit too. Every leak has them: e equal tokens
between m others make at most m + 1 runs, thus at least e - 2 (m + 1) runs of three; with e >= 12 and e >= 3 m that is two or more.

The index is sent to the executors in blocks of a bounded number of items' bytes; a larger benchmark means more blocks,
each held against all documents, one after the other: its result is written and its index given up before the next is sent.
Documents are read once a block and never shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, PLACE, Prefix, in_arrow, mix, ragged, text_blocks, word_spans, written

#: 1: the token counts, 0: it is ignored.
MASKS = ("1101101011", "1011100101101", "111010011011")
#: A stretch is a leak from that many equal tokens on (or all tokens of a shorter item), at that share of equal tokens at least.
LEAST_TOKENS = 12
LEAST_SHARE = 0.75
#: What a substitution takes from a stretch's score if a match gives 1: no score is negative where the share is reached.
SUBSTITUTION = LEAST_SHARE / (1 - LEAST_SHARE)
#: Two hits on a diagonal are needed.
PAIR = "111"
INDEX_BYTES = 32 << 20
#: Tokens of diagonals that are compared together.
AT_ONCE = 1 << 20
#: Rows of a batch that are filtered together.
ROWS = 1000

#: Tokens are runs of ASCII letters and digits and of bytes beyond ASCII; everything else separates.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def _tokens(data, off):
    start, end, first = word_spans(data, off, _GAP)
    return Prefix(data, FOLD).of(start, end), first


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            t += h[i : i + n] * PLACE[i]
    return mix(t)


class Index:
    """Seeds of benchmark items. Items with fewer tokens than a mask are found by a seed of all their tokens."""

    def __init__(self, ids: list, texts: list[str], number: int = 0):
        self.ids, self.number, tokens = ids, number, []
        for _, _, data, off in text_blocks(pa.array(texts, pa.string())):
            h, first = _tokens(data, off)
            tokens += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat, self.begin = np.concatenate([*tokens, np.zeros(0, np.uint64)]), np.cumsum(self.size) - self.size
        shortest = min(map(len, MASKS))
        spans = sorted({len(t) for t in tokens if 0 < len(t) < shortest})
        #: (mask, hits needed on a diagonal)
        self.masks = [*((m, 1) for m in MASKS), (PAIR, 2), *(("1" * n, 1) for n in spans)]
        self.tables = []
        for k, (mask, _) in enumerate(self.masks):
            own = [(i, _seeds(t, mask)) for i, t in enumerate(tokens) if (len(t) >= shortest if k <= len(MASKS) else len(t) == len(mask))]
            seeds = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.uint64)
            item = np.repeat([i for i, _ in own], [len(s) for _, s in own]).astype(np.int64)
            place = np.concatenate([np.arange(len(s)) for _, s in own]) if own else np.zeros(0, np.int64)
            order = np.argsort(seeds, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[(seeds & np.uint64(0x3FFFFF)).astype(np.int64)] = True
            self.tables.append((seeds[order], item[order], place[order], seen))

    def hits(self, h: np.ndarray, first: np.ndarray):
        """Distinct (document, item, diagonal) of the block's seed hits; diagonal: place in the document less that in the item."""
        found = []
        for (mask, needed), (seeds, item, place, seen) in zip(self.masks, self.tables, strict=True):
            s = _seeds(h, mask)
            if not len(s) or not len(seeds):
                continue
            at = np.flatnonzero(seen[(s & np.uint64(0x3FFFFF)).astype(np.int64)])
            low, high = np.searchsorted(seeds, s[at], "left"), np.searchsorted(seeds, s[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            pick = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            at = np.repeat(at, n)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + len(mask) <= first[doc + 1]
            hit, n = self._distinct(np.stack([doc, item[pick], at - first[doc] - place[pick]], axis=1)[inside], len(h))
            found.append(hit[n >= needed])
        found = self._distinct(np.concatenate(found), len(h))[0] if found else np.zeros((0, 3), np.int64)
        return found[self.many_equal(h, first, found)]

    def _distinct(self, hits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows (document, item, diagonal) of a block of n tokens in order, and how often each is there; by one number a row if it fits."""
        items, span = len(self.size), n + int(self.size.max(initial=0)) + 1
        if not len(hits) or (int(hits[:, 0].max()) + 1) * items * 2 * span >= 1 << 63:
            return np.unique(hits, axis=0, return_counts=True)
        code, count = np.unique((hits[:, 0] * items + hits[:, 1]) * (2 * span) + hits[:, 2] + span, return_counts=True)
        pair, diagonal = np.divmod(code, 2 * span)
        return np.stack([pair // items, pair % items, diagonal - span], axis=1), count

    def many_equal(self, h: np.ndarray, first: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether a diagonal has enough equal tokens at all: a seed that many items share mostly gives others that have not."""
        doc, item, diagonal = found.T
        a = np.maximum(diagonal, 0)
        n = np.minimum(first[doc + 1] - first[doc], diagonal + self.size[item]) - a
        ok, cuts = np.zeros(len(found), bool), np.searchsorted(np.cumsum(n) // AT_ONCE, np.arange((n.sum() // AT_ONCE if len(n) else -1) + 2))
        for x, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > x:
                own = slice(x, z)
                same = h[ragged(first[doc[own]] + a[own], n[own])] == self.flat[ragged(self.begin[item[own]] + a[own] - diagonal[own], n[own])]
                equal = np.add.reduceat(same, np.cumsum(n[own]) - n[own], dtype=np.int64)
                ok[own] = equal >= np.minimum(LEAST_TOKENS, self.size[item[own]])
        return ok

    def leak(self, doc: np.ndarray, item: int, diagonal: int):
        """(equal tokens, tokens, first place in the document) of a diagonal's stretch with most equal tokens, or None."""
        own = self.tokens[item]
        a, z = max(0, diagonal), min(len(doc), diagonal + len(own))
        same = doc[a:z] == own[a - diagonal : z - diagonal]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
        # For each end the earliest begin whose stretch reaches the share; the longer one has no fewer equal tokens.
        begins = np.searchsorted(-np.minimum.accumulate(total), -total)
        count = np.concatenate([[0], np.cumsum(same)])
        end = int(np.argmax(count - count[begins]))
        equal = int(count[end] - count[begins[end]])
        if equal and equal >= min(LEAST_TOKENS, len(own)):
            begin = int(begins[end]) + int(np.argmax(same[begins[end] : end]))
            return equal, end - begin, a + begin
        return None


def _leaks(column, index: Index):
    """(row, item, equal tokens, tokens, first place) of an Arrow column; the stretch with most equal tokens for each row and item."""
    for at, _, data, off in text_blocks(column, 1 << 18):
        h, first = _tokens(data, off)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, diagonal in index.hits(h, first).tolist():
            if (x := index.leak(h[first[doc] : first[doc + 1]], item, diagonal)) and (x[0], -x[2]) > (lambda y: (y[0], -y[2]))(best.get((doc, item), (0, 0, 0))):
                best[doc, item] = x
        for (doc, item), x in sorted(best.items()):
            yield at + doc, item, *x


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark's items in blocks of at most INDEX_BYTES of text (one item at least), read one partition at a time."""
    ids, texts, size, number = [], [], 0, 0
    for i, text in benchmark.select(item_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy(item_col, "t").toLocalIterator():
        if ids and size + len(text) > INDEX_BYTES // 4:
            yield Index(ids, texts, number)
            ids, texts, size, number = [], [], 0, number + 1
        ids.append(i)
        texts.append(text)
        size += len(text)
    if ids:
        yield Index(ids, texts, number)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_equal, n_tokens, first_token, share): one row for each row of df and item that it leaks.

    Null and empty texts leak nothing, nor do items without tokens. Rows with a null or repeated id are each held
    against the benchmark; an item that occurs twice under two ids gives two rows. Other columns are not read; empty
    tables give an empty result.
    """
    id_type, item_type = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, n_equal long, n_tokens long, first_token long, share double"
    def rows(index: Index):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            index = sent.value
            for batch in batches:
                rows = list(_leaks(batch.column(1), index))
                if rows:
                    row, item, equal, tokens, first = (list(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item]), pa.array(equal, pa.int64()), pa.array(tokens, pa.int64()), pa.array(first, pa.int64()), pa.array([e / t for e, t in zip(equal, tokens, strict=True)], pa.float64())], ["id", "item", "n_equal", "n_tokens", "first_token", "share"])

        return in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema), sent

    parts = list(_in_turn(_blocks(benchmark, item_col, item_text_col), rows))
    return reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], schema)


def _in_turn(blocks, rows):
    """rows(index) for each block of the benchmark; with several, each is written before the next one's index is sent."""
    index = next(blocks, None)
    while index is not None:
        after = next(blocks, None)
        found, sent = rows(index)
        if after is not None or index.number:
            found = written(found)
            sent.unpersist()
        yield found
        index = after


def clean_rows(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of df that leak no item, with all their columns, without a shuffle.

    Rows with a null or empty text stay; rows with null or repeated ids and repeated rows are judged each. Columns of any name pass
    through; an empty benchmark keeps every row, an empty table gives an empty result.
    """
    place = df.columns.index(text_col)
    left = [df]

    def rows(index: Index):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):  # copies of a few rows at a time
                    part = batch.slice(at, ROWS)
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, *_ in _leaks(part.column(place), sent.value)]] = False
                    yield part.filter(pa.array(keep))

        return in_arrow(left[-1], run, df.schema), sent

    for found in _in_turn(_blocks(benchmark, item_col, item_text_col), rows):
        left.append(found)
    return left[-1]
