"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry at each place of a word; done plainly it reads characters
again and again. Here the vocabulary's trie gets failure links, as in string search: where no edge fits, the link leads to the
node for what is left after the pieces that are already certain, and the number of these pieces is stored with the link. Each
character is read once, no piece is built, and the sum of the popped numbers is the length. A word that has no tokenisation is one
unknown token.

Distinct words of a block go through the automaton in step, one character at a time; when few are left, the long ones, each by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, in_arrow, text_blocks, word_spans

_SHIFT = 21  # a code point has 21 bits
#: With fewer words a step of all costs more than steps of each.
FEW = 16


class Automaton:
    """first: pieces that begin a word; rest: pieces that continue one."""

    def __init__(self, first: set[str], rest: set[str]):
        # Node 0 is the start of a word, node 1 the start of a continuation.
        edges: dict[tuple[int, int], int] = {}
        parent, letter, depth, entry = [-1, -1], [-1, -1], [0, 0], [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted(pieces):
                at = root
                for c in map(ord, piece):
                    to = edges.get((at, c))
                    if to is None:
                        to = edges[at, c] = len(parent)
                        parent.append(at)
                        letter.append(c)
                        depth.append(depth[at] + 1)
                        entry.append(False)
                    at = to
                entry[at] = at > 1
        link, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(2, len(parent)), key=depth.__getitem__):
            if entry[v]:
                link[v], popped[v] = 1, 1
                continue
            z, n = link[parent[v]], 0
            while z >= 0 and (z, letter[v]) not in edges:
                n += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z, letter[v]], popped[parent[v]] + n
        key = np.array([a << _SHIFT | c for a, c in edges], np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.array(list(edges.values()), np.int64)[order]
        self.link, self.popped = np.array(link), np.array(popped)
        self._plain = None

    def _one(self, letters: list[int], node: int, total: int) -> tuple[int, int, bool]:
        """(node, total, unknown) after the letters of one word."""
        if self._plain is None:
            self._plain = dict(zip(self.key.tolist(), self.to.tolist(), strict=True)), self.link.tolist(), self.popped.tolist()
        edges, link, popped = self._plain
        for c in letters:
            while (to := edges.get(node << _SHIFT | c)) is None:
                if link[node] < 0:
                    return node, total, True
                total += popped[node]
                node = link[node]
            node = to
        return node, total, False

    def counts(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, unknown) of each word letters[start:end]; an unknown word counts 1."""
        n = len(start)
        node, total, unknown = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        live, at = np.flatnonzero(end > start), start.copy()
        while len(live) > FEW:
            asking = live  # those that have not found an edge for their letter yet
            c = letters[at[asking]].astype(np.int64)
            while len(asking):
                key = node[asking] << _SHIFT | c
                i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1) if len(self.key) else np.zeros(len(key), np.int64)
                found = self.key[i] == key if len(self.key) else np.zeros(len(key), bool)
                node[asking[found]] = self.to[i[found]]
                asking, c = asking[~found], c[~found]
                to = self.link[node[asking]]
                lost = to < 0
                unknown[asking[lost]] = True
                total[asking] += self.popped[node[asking]]
                node[asking] = to
                asking, c = asking[~lost], c[~lost]
            at[live] += 1
            live = live[~unknown[live] & (at[live] < end[live])]
        for w in live.tolist():
            node[w], total[w], unknown[w] = self._one(letters[at[w] : end[w]].tolist(), int(node[w]), int(total[w]))
        live = np.flatnonzero(~unknown & (node != 1) & (end > start))
        while len(live):
            to = self.link[node[live]]
            unknown[live[to < 0]] = True
            total[live] += self.popped[node[live]]
            node[live] = to
            live = live[to > 1]
        return np.where(unknown, 1, total), unknown


def piece_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """(pieces that begin a word, pieces that continue one) of a sentencepiece model: its word mark tells them apart."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {p[1:] for p in plain if p[0] == "▁" and len(p) > 1}, {p for p in plain if "▁" not in p}


def token_counts(df: DataFrame, first: set[str], rest: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for each row of df; words are runs of anything but ASCII white space.

    A null or empty text has no words and no tokens. Rows with null or repeated ids are counted each; other columns are not
    read; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(Automaton(first, rest))

    def run(batches):
        automaton = sent.value
        for batch in batches:
            words, tokens, unknown = [], [], []
            for _, _, data, off in text_blocks(batch.column(1)):
                start, end, at = word_spans(data, off)
                _, pick, inverse = np.unique(Prefix(data).of(start, end), return_index=True, return_inverse=True)
                raw = data.tobytes()
                text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
                size = np.array([len(t) for t in text], np.int64)
                stop = np.cumsum(size)
                count, odd = automaton.counts(np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32), stop - size, stop)
                for out, x in ((tokens, count), (unknown, odd)):
                    sums = np.concatenate([[0], np.cumsum(x[inverse], dtype=np.int64)])
                    out.append(sums[at[1:]] - sums[at[:-1]])
                words.append(np.diff(at))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (words, tokens, unknown))], ["id", "n_words", "n_tokens", "n_unknown"])

    return in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_words long, n_tokens long, n_unknown long")
