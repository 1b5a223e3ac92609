"""Byte-level BPE by speculate and verify, and decoding.

A word's merges are a chain of dependent steps, but its result can be checked locally: a sequence of tokens is the BPE
encoding of its bytes exactly if every token encodes to itself and every adjacent pair is compatible, that is, encodes to
itself too. So greedy longest match proposes tokens for all new words at once, walking a trie in step (the last few, long ones, each by itself); the distinct adjacent
pairs are tested at once by taking both tokens apart along their merges and asking whether an earlier merge would have
crossed the boundary; only words with an incompatible pair are merged step by step.

The pattern that cuts a text into words is that of the tokeniser's file (byte-level pre-tokeniser); special tokens of the
file are cut out first, as its library does. Each worker keeps the words it has seen, up to a bound in bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_blocks

#: Memory of the words that a worker keeps. A word takes its own strings and about that much for the objects that hold them.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 320
#: With fewer words a step of all costs more than steps of each.
FEW = 16
#: Texts whose words are looked up, and whose ids are held, together.
BLOCK_BYTES = 1 << 20
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def _checked(file: dict) -> dict:
    """The file, if it asks for nothing that is not done here: else its library would give other tokens."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = {"normalizer": file.get("normalizer"), "dropout": model.get("dropout"), "continuing_subword_prefix": model.get("continuing_subword_prefix"), "end_of_word_suffix": model.get("end_of_word_suffix"), "ignore_merges": model.get("ignore_merges"), "add_prefix_space": before.get("add_prefix_space")}
    odd = [k for k, v in plain.items() if v]
    odd += [f"added token {t['content']!r}: {k}" for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        odd.append("model or pre-tokeniser")
    if odd:
        raise ValueError(f"not supported: {', '.join(odd)}")
    return file


class Vocabulary:
    """Tables of a byte-level BPE file. Ids are renamed to ranks: bytes 0 to 255, then merges in order."""

    encoder = plain = None

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = _checked(json.load(f))
        model, letters = file["model"], byte_letters()
        vocab = model["vocab"]
        unwrap = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = {bytes([b]): b for b in range(256)}
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        names = {b: c for c, b in letters.items()}
        ids = [vocab.get(names[b], -1) for b in range(256)]
        left, right = [-1] * 256, [-1] * 256
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = rank[unwrap(a)], rank[unwrap(b)]
            joint = self.bytes[x] + self.bytes[y]
            if joint in rank:  # the same bytes by another merge: the pair still merges, into the token that is there
                raise ValueError("two merges make the same token")
            rank[joint] = len(self.bytes)
            self.pairs[x, y] = len(self.bytes)
            self.bytes.append(joint)
            ids.append(vocab[a + b])
            left.append(x)
            right.append(y)
        self.left, self.right, self.ids = np.array(left), np.array(right), np.array(ids)
        n = len(self.bytes)
        key = np.array([a * n + b for a, b in self.pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], np.array(list(self.pairs.values()))[order]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.id_bytes = {int(i): b for i, b in zip(self.ids, self.bytes, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        own = np.array([self.merge(b) == [i] for i, b in enumerate(self.bytes)])
        self._trie(own)

    def _trie(self, usable: np.ndarray) -> None:
        """Sorted edges (node, byte) -> node; accept: the rank of the token that ends at a node, if it encodes to itself."""
        nodes: dict[tuple[int, int], int] = {}
        accept = [-1]
        for r, b in enumerate(self.bytes):
            if usable[r]:
                at = 0
                for c in b:
                    to = nodes.get((at, c))
                    if to is None:
                        to = nodes[at, c] = len(accept)
                        accept.append(-1)
                    at = to
                accept[at] = r
        key = np.array([a * 256 + c for a, c in nodes], np.int64)
        order = np.argsort(key)
        self.edge_key, self.edge_to, self.accept = key[order], np.array(list(nodes.values()))[order], np.array(accept)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: merges the pair of lowest rank, leftmost first, until none is left."""
        parts = list(word)
        if len(parts) < 2:
            return parts
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.pairs.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j] = r, True
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := self.pairs.get((r, parts[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, parts[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get((parts[h], r))) is not None:
                heapq.heappush(heap, (x, h, parts[h], r))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def speculate(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, rank) of the greedy longest matches, in order of words and places. All words walk the trie in step."""
        n = len(start)
        word, at, stop = np.arange(n), start.copy(), end
        node, place = np.zeros(n, np.int64), start.copy()
        best, best_end = np.full(n, -1), start.copy()
        out_word, out_at, out_rank = [], [], []
        live = np.flatnonzero(at < stop)
        while len(live) > FEW:
            p = place[live]
            inside = p < stop[live]
            key = node[live] * 256 + np.where(inside, data[np.minimum(p, len(data) - 1)], 0)
            i = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            found = inside & (self.edge_key[i] == key)
            go, end_of = live[found], live[~found]
            node[go] = self.edge_to[i[found]]
            place[go] += 1
            taken = self.accept[node[go]]
            hit = go[taken >= 0]
            best[hit], best_end[hit] = taken[taken >= 0], place[hit]
            if len(end_of):
                out_word.append(word[end_of])
                out_at.append(at[end_of])
                out_rank.append(best[end_of])
                at[end_of] = place[end_of] = best_end[end_of]
                node[end_of], best[end_of] = 0, -1
            live = np.concatenate([go, end_of[at[end_of] < stop[end_of]]])
        for w in live.tolist():
            found = list(self._longest(data[at[w] : stop[w]].tobytes()))
            out_word.append(np.full(len(found), word[w]))
            out_at.append(at[w] + np.array([a for a, _ in found], np.int64))
            out_rank.append(np.array([r for _, r in found], np.int64))
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, a, r = (np.concatenate(x) for x in (out_word, out_at, out_rank))
        order = np.argsort(a, kind="stable")
        return w[order], r[order]

    def _longest(self, raw: bytes):
        """(place, rank) of the greedy longest matches of one word."""
        if self.plain is None:
            self.plain = dict(zip(self.edge_key.tolist(), self.edge_to.tolist(), strict=True)), self.accept.tolist()
        (edges, accept), at = self.plain, 0
        while at < len(raw):
            node, best, best_end, place = 0, -1, at, at
            while place < len(raw) and (node := edges.get(node * 256 + raw[place], -1)) >= 0:
                place += 1
                if accept[node] >= 0:
                    best, best_end = accept[node], place
            yield at, best
            at = best_end

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of a and b before both are complete, for each pair of tokens.

        Goes back through the merges of both sides from the last one. limit: the rank of the merge undone last; a merge of
        the two pieces at the boundary that ranks before it would have come first. Of equal ranks the left one comes first.
        """
        n = len(self.bytes)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40)
        while len(live):
            key = x * n + y
            i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossing = (self.pair_key[i] == key) & (self.pair_rank[i] < limit)
            ok[live[crossing]] = False
            later_left = x > y  # the merge to undo; equal ones are undone on the right first, as the left came first
            whole = np.where(later_left, x, y) < 256
            go = ~crossing & ~whole
            live, x, y, later_left = live[go], x[go], y[go], later_left[go]
            limit = np.where(later_left, x, y + 1)
            x, y = np.where(later_left, self.right[x], x), np.where(later_left, y, self.left[y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens (ids of the file) of each word."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        word, rank = self.speculate(np.frombuffer(b"".join(words), np.uint8), end - size, end)
        pair = np.flatnonzero(word[1:] == word[:-1])
        n = len(self.bytes)
        key, inverse = np.unique(rank[pair] * n + rank[pair + 1], return_inverse=True)
        fits = self.compatible(key // n, key % n)[inverse]
        wrong = np.unique(np.concatenate([word[pair[~fits]], word[rank < 0]]))
        count = np.bincount(word, minlength=len(words))
        ids = self.ids[rank].tolist()
        out, at = [], 0
        for c in count.tolist():
            out.append(ids[at : at + c])
            at += c
        for w in wrong.tolist():
            out[w] = self.ids[self.merge(words[w])].tolist()
        self.merged = len(wrong)
        return out


class Encoder:
    """Encodes texts with a bounded memory of words: (ids joined by commas, number of ids, ids as int32 if packed).

    The tokens of each word that goes into the memory are decoded and have to give the word's bytes, so a text's ids decode to the text.
    """

    def __init__(self, vocabulary: Vocabulary, cache_bytes: int = CACHE_BYTES, packed: bool = True):
        self.v, self.seen, self.held, self.cache_bytes, self.packed = vocabulary, {}, 0, cache_bytes, packed
        self.words = regex.compile(WORD_PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.fixed = {s: self.entry(s.encode(), [i]) for s, i in vocabulary.special.items()}

    def entry(self, raw: bytes, ids: list[int]) -> tuple:
        if b"".join(map(self.v.id_bytes.__getitem__, ids)) != raw:
            raise ValueError(f"the vocabulary has no tokens for {raw!r}")
        return (",".join(map(str, ids)), len(ids), pack(f"<{len(ids)}i", *ids) if self.packed else b"")

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.fixed):
            return self.words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append("\0special" + part)
            else:
                out += self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.seen)
        if self.held > self.cache_bytes:
            self.seen.clear()
            self.held, new = 0, set().union(*split)
        special = {w for w in new if w.startswith("\0special") and w[8:] in self.fixed}
        plain = list(new - special)
        raw = [w.encode() for w in plain]
        for w, r, ids in zip(plain, raw, self.v.encode_words(raw), strict=True):
            self.seen[w] = entry = self.entry(r, ids)
            self.held += ENTRY_BYTES + len(r) + len(entry[0]) + len(entry[2])
        for w in special:
            self.seen[w] = self.fixed[w[8:]]
        get = self.seen.__getitem__
        return [[get(w) for w in ws] for ws in split]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of df.

    A worker keeps words in cache_bytes, besides those of one block: more take less time. ids is null unless keep_ids; decoded_sha256
    is the digest of the text that decoding the ids gives: the text itself, since the tokens of every word are decoded and compared. A null or empty text has no tokens. Rows with null or repeated ids are encoded
    each; other columns are not read; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        v = sent.value
        encoder = v.encoder = v.encoder or Encoder(v, cache_bytes, keep_ids)  # stays with the worker's copy of the vocabulary from task to task
        for batch in batches:
            for at, to, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                raw, cut = data.tobytes(), off.tolist()
                n, packed, digest, text = [], [], [], []
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                for whole, parts in zip(texts, encoder.encode(texts), strict=True):
                    n.append(sum([p[1] for p in parts]))
                    digest.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                    text.append(hashlib.sha256(whole.encode()).hexdigest())
                    if keep_ids:
                        packed.append(b"".join([p[2] for p in parts]))
                if keep_ids:
                    values = np.frombuffer(b"".join(packed), np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))
                else:
                    ids = pa.nulls(len(n), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), ids, pa.array(digest, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's token ids; bytes that are no UTF-8 become U+FFFD.

    Null or empty ids, however many rows have them, give the empty text; an id that the file does not have ends the job. Rows with null
    or repeated id columns are decoded each; other columns are not read; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        token = sent.value.id_bytes
        for batch in batches:
            texts = [b"".join([token[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return in_arrow(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string")
