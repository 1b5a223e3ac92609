"""Removal of repeated 50-byte strings by suffix arrays.

A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller id. Equal strings have to meet
without sending every suffix around:

1. anchors    Of each window of WIDTH bytes the smallest hash of its GRAM-byte pieces is the window's anchor. Equal windows have
              equal anchors at equal places, and successive windows mostly share one. An anchor's context is all that its
              windows can cover.
2. groups     Anchors meet by hash, as packed arrays. A context that an earlier document has too is removed as a whole. Contexts
              that share an anchor with another one, but are not equal, are left to 3; all others are unique.
              Within a task's batch only the smallest document of each context goes to the group, the others are settled.
3. suffixes   The undecided contexts of an anchor meet. Their suffixes are sorted in two stages: those smaller than their successors directly, the rest induced from these by a scan
              over the buckets of first bytes. Adjacent common prefixes of WIDTH bytes or more join suffixes into runs; a suffix
              goes if its run has a smaller document.

4. the rest     An anchor with more than CROWD undecided contexts (say, the border of a passage that very many documents share) is
              not given to one task: each window of its contexts is a key of its own that meets its equals by aggregation.

Texts travel twice, compressed in blocks: for the contexts and for the result. Contexts of an anchor are equal if 64 bits of their
hashes are, besides the anchor's own 32 bits and its part: among 10 million contexts of one anchor a wrong equality has a chance of
3 in a million. Parts are dealt by bits of the anchor's hash mixed anew, since an anchor, the smallest hash of its window, has small
high bits. Step 2 holds the hashes (not the bytes) of one anchor's different contexts in one task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, give_back, in_arrow, mix, ragged, text_blocks, written

WIDTH = 50
GRAM = 24
SPAN = WIDTH - GRAM + 1
PART_BYTES = 6 << 20
CHUNK_BYTES = 1 << 19
#: Small blocks keep the arrays of a block in a processor's cache.
BLOCK = 1 << 18
#: Texts whose occurrences are brought together before they are sent.
GATHER_BYTES = 8 << 20
#: Undecided contexts of one anchor that one task sorts; beyond that number their windows are spread.
CROWD = 8192
_PLACE = np.uint64((1 << 28) - 1)
END = 0xFF  # no byte of UTF-8


def anchors(data: np.ndarray, off: np.ndarray):
    """(place, document, context start, context end, key, context hash, prefix hashes) of a block's anchors, in order."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    prefix = Prefix(data)
    at = np.arange(n - GRAM + 1)
    h = prefix.of(at, at + GRAM)
    low = (h & ~_PLACE) | at.astype(np.uint64)
    size = 1
    while size * 2 <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    size = np.diff(off)
    starts = ragged(off[:-1], np.maximum(size - WIDTH + 1, 0))
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), None
    place = (low[starts] & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    doc = np.searchsorted(off, place, "right") - 1
    begin, end = np.maximum(off[doc], place - SPAN + 1), np.minimum(off[doc + 1], place + WIDTH)
    context = mix(prefix.of(begin, end) + (place - begin).astype(np.uint64))
    return place, doc, begin, end, h[place], context, prefix


_KEY = np.uint64(0xFFFFFFFF)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lower bytes of unsigned numbers, first all lowest, and so on: high bytes of small numbers compress away."""
    return pa.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), "zstd", asbytes=True)


def _from_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _packed(doc, key, context, flag) -> tuple:
    """Numbers and planes of rows: documents by place in a list of their own, keys (in order, 32 bits) by difference."""
    key = key & _KEY
    order = np.argsort(key, kind="stable")
    doc, key, context, flag = doc[order], key[order], context[order], flag[order]
    names, index = np.unique(doc, return_inverse=True)
    names = names.view(np.uint64)
    return len(doc), len(names), _planes(np.diff(names, prepend=np.uint64(0)), 8), _planes(index, 4), _planes(np.diff(key, prepend=np.uint64(0)), 4), context.astype("<u8").tobytes(), flag.tobytes()


def _unpacked(n, k, names, index, key, context, flag):
    names = np.cumsum(_from_planes(names, k, 8)).view(np.int64)
    return names[_from_planes(index, n, 4).astype(np.int64)], np.cumsum(_from_planes(key, n, 4)), np.frombuffer(context, "<u8"), np.frombuffer(flag, np.uint8)


_FIELDS = ("n", "k", "names", "idx", "key", "context", "flag")
_PACKED = "dest int, settled boolean, n int, k int, " + ", ".join(f"{f} binary" for f in _FIELDS[2:])
_COLUMNS = ["dest", "settled", *_FIELDS]


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32()] + [pa.binary()] * (len(_FIELDS) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _COLUMNS)


def _sent(dest: np.ndarray, settled: bool, doc, key, context, flag):
    """One packed row for each destination."""
    if not len(dest):
        return
    order = np.argsort(dest, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], dest[order][1:] != dest[order][:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        i = order[a:b]
        yield (int(dest[i[0]]), settled, *_packed(doc[i], key[i], context[i], flag[i]))


def part_of_key(key: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(parts)).astype(np.int64)


def _occurrences(docs: DataFrame, parts: int) -> DataFrame:
    """Packed distinct (document, key, context): to the part of the key, or settled to the part of the document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found, size = [], 0
            for at, to, data, off in text_blocks(batch.column(1), BLOCK):
                _, doc, _, _, key, context, _ = anchors(data, off)
                found.append((ids[at + doc], key, context))
                size += len(data)
                if size >= GATHER_BYTES or to == len(ids):
                    if rows := list(settled(*(np.concatenate(x) for x in zip(*found, strict=True)))):
                        yield _batch(rows)
                    found, size = [], 0

    def settled(doc, key, context):
        if len(doc):
            order = np.lexsort((doc, context, key))
            doc, key, context = doc[order], key[order], context[order]
            same = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
            first = np.concatenate([[True], ~same])
            fresh = np.concatenate([[True], ~(same & (doc[1:] == doc[:-1]))])
            late = fresh & (doc > doc[first][np.cumsum(first) - 1])
            yield from _sent(part_of_key(key[first], parts), False, doc[first], key[first], context[first], np.zeros(first.sum(), np.uint8))
            yield from _sent(part_of(doc[late], parts), True, doc[late], key[late], context[late], np.ones(late.sum(), np.uint8))

    return in_arrow(docs.select("id", "text"), run, _PACKED)


def _verdicts(sent: DataFrame, parts: int) -> DataFrame:
    """Packed (document, key, context, flag) by the document's part; flag 1: an earlier document has the context, 2: undecided."""

    def judge(rows: list):
        doc, key, context = (np.concatenate(x) for x in zip(*[_unpacked(*r)[:3] for r in rows], strict=True))
        order = np.lexsort((doc, context, key))
        doc, key, context = doc[order], key[order], context[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        group, of_key = np.cumsum(first) - 1, np.cumsum(new_key) - 1
        contexts = np.bincount(of_key[first], minlength=of_key[-1] + 1)
        edges = np.flatnonzero(new_key)
        mixed = (contexts > 1) & (np.minimum.reduceat(doc, edges) < np.maximum.reduceat(doc, edges))
        flag = np.where(doc > doc[first][group], 1, np.where(first & mixed[of_key], 2, 0)).astype(np.uint8)
        keep = flag > 0
        return _sent(part_of(doc[keep], parts), True, doc[keep], key[keep], context[keep], flag[keep]) if keep.any() else ()

    def run(batches):
        open_, at = [], None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1]:
                    out.append(row)
                    continue
                if open_ and row[0] != at:
                    out += judge(open_)
                    open_ = []
                at = row[0]
                open_.append(row[2:])
            if out:
                yield _batch(out)
        if open_ and (out := list(judge(open_))):
            yield _batch(out)

    return in_arrow(sent.repartition(parts, "dest").sortWithinPartitions("dest"), run, _PACKED)


_APPLIED = "kind int, dest int, uid long, id long, route long, place long, body binary"
_APPLIED_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_APPLIED_NAMES = [f.split()[0] for f in _APPLIED.split(", ")]


def _in_parts(docs: DataFrame, parts: int) -> DataFrame:
    """Compressed texts by the part of their documents; a row holds those of one part and batch."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=4)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            dest = part_of(ids, parts)
            raw, rows = batch.column(1).cast(pa.binary()), []
            for p in np.unique(dest).tolist():
                own = np.flatnonzero(dest == p)
                texts = raw.take(pa.array(own)).to_pylist()
                whole = b"".join(texts)
                rows.append((p, ids[own].tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), codec.compress(whole, asbytes=True) if whole else b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["dest", "ids", "sizes", "texts"])

    return in_arrow(docs.select("id", "text"), run, "dest int, ids binary, sizes binary, texts binary")


def _opened(table: pa.Table):
    """(ids, bytes, offsets, uids) of the rows of _in_parts, one after the other. uid: hash of the id and the text."""
    for ids, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        raw = pa.decompress(texts, int(off[-1]), "zstd", asbytes=True) if texts else b""
        ids = np.frombuffer(ids, np.int64)
        data = np.frombuffer(raw, np.uint8)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
            part, cut = data[off[at] : off[to]], off[at : to + 1] - off[at]
            uid = (Prefix(part).of(cut[:-1], cut[1:]) ^ mix(ids[at:to].view(np.uint64))).view(np.int64)
            yield ids[at:to], part, cut, uid
            at = to


def _applied(docs: DataFrame, verdicts: DataFrame, parts: int) -> DataFrame:
    """Rows of two kinds. 0: spans (body) of a document that an earlier one has; 1: an undecided context and its place."""

    def run(key, left, right):
        give_back()
        part = key[0].as_py()
        rows: list[tuple] = []
        packed = list(zip(*(right.column(f).to_pylist() for f in _FIELDS), strict=True))
        doc_v, key_v, context_v, flag_v = (np.concatenate(x) for x in zip(*[_unpacked(*r) for r in packed], strict=True)) if packed else [np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.uint8)]
        known = mix(mix(doc_v.view(np.uint64) ^ key_v << np.uint64(20)) + context_v)
        order = np.argsort(known)
        known, flag_v = known[order], flag_v[order]
        for ids, data, off, uid in _opened(left):
            place, doc, begin, end, key_a, context, _ = anchors(data, off)
            if not len(known) or not len(place):
                continue
            own = mix(mix(ids[doc].view(np.uint64) ^ (key_a & _KEY) << np.uint64(20)) + context)
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            flag = np.where(known[i] == own, flag_v[i], 0)
            spans = np.stack([begin - off[doc], end - off[doc]], axis=1)
            raw = data.tobytes()
            whole = np.flatnonzero(flag == 1)
            edges = np.flatnonzero(np.concatenate([[True], doc[whole][1:] != doc[whole][:-1], [True]])) if len(whole) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = doc[whole[a]]
                rows.append((0, part, int(uid[d]), int(ids[d]), None, None, spans[whole[a:b]].tobytes()))
            left_over = np.flatnonzero(flag == 2)
            d = doc[left_over]
            for u, own_id, r, p, s, e in zip(uid[d].tolist(), ids[d].tolist(), key_a[left_over].view(np.int64).tolist(), spans[left_over, 0].tolist(), begin[left_over].tolist(), end[left_over].tolist(), strict=True):
                rows.append((1, part, u, own_id, r, p, raw[s:e]))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, _APPLIED_KINDS, strict=True)], names=_APPLIED_NAMES)

    return _in_parts(docs, parts).groupBy("dest").cogroup(verdicts.select("dest", *_FIELDS).groupBy("dest")).applyInArrow(run, _APPLIED)


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finished(docs: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """The result of each document from its spans (dest, uid, body)."""

    def run(key, left, right):
        give_back()
        uids, bodies = right.column("uid").to_numpy(), right.column("body").to_pylist()
        gone: dict[int, list[bytes]] = {}
        for u, b in zip(uids.tolist(), bodies, strict=True):
            gone.setdefault(u, []).append(b)
        rows = []
        for ids, data, off, uid in _opened(left):
            raw = data.tobytes()
            for i, u, a, b in zip(ids.tolist(), uid.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = raw[a:b]
                if u in gone:
                    rows.append((i, b - a, *_kept(text, np.frombuffer(b"".join(gone[u]), np.int64).reshape(-1, 2))))
                else:
                    rows.append((i, b - a, 0, 0, hashlib.sha256(text).hexdigest()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")])

    return _in_parts(docs, parts).groupBy("dest").cogroup(spans.groupBy("dest")).applyInArrow(run, _RESULT)


def _kept(text: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal runs removed, digest of the rest)."""
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, spans[:, 0], 1)
    np.add.at(mark, spans[:, 1], -1)
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def suffix_order(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Places of a byte array in the order of their suffixes' first depth bytes at least; text ends with END.

    A suffix is small if it is less than its successor. Small ones are sorted directly. Every other suffix begins with a byte
    no less than its successor's, so a scan in order over the buckets of first bytes meets its successor before itself.
    """
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    rise[-1] = -1
    stop = np.flatnonzero(rise)
    small = rise[stop[np.searchsorted(stop, np.arange(n))]] > 0
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    at = np.flatnonzero(small)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[at]).view(f"S{depth}").ravel()
    direct = at[np.argsort(keys, kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def repeated(bodies: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(body, place) of the windows of WIDTH bytes that a body of a smaller document holds too."""
    size = np.array([len(b) for b in bodies])
    text = np.frombuffer(bytes([END]).join(bodies) + bytes([END]), np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    order = suffix_order(text)
    body = np.repeat(np.arange(len(bodies)), size + 1)
    place = np.arange(len(text)) - start[body]
    order = order[place[order] + WIDTH <= size[body[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | text[k : len(text) - 7 + k]
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, WIDTH - 8, 8), WIDTH - 8]:  # adjacent prefixes agree in WIDTH bytes
        w = word[order + k]
        same &= w[1:] == w[:-1]
    edges = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(docs[body[order]], edges)
    run = np.cumsum(np.concatenate([[0], ~same]))
    gone = order[docs[body[order]] > least[run]]
    return body[gone], place[gone]


def _decided(contexts: DataFrame) -> DataFrame:
    """(dest, uid, body): spans that suffix arrays remove of the undecided contexts."""

    def settle(rows: list):
        docs = np.array([r[1] for r in rows], np.int64)
        body, place = repeated([r[4] for r in rows], docs)
        if not len(body):
            return
        order = np.lexsort((place, body))
        body, place = body[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (body[1:] != body[:-1]) | (place[1:] - place[:-1] > 1)]))
        last = np.append(first[1:] - 1, len(body) - 1)
        own, base = body[first], np.array([r[3] for r in rows], np.int64)
        spans = np.stack([place[first] + base[own], place[last] + base[own] + WIDTH], axis=1)
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = rows[own[a]]
            yield r[5], r[0], spans[a:z].tobytes()

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["dest", "uid", "body"])

    def run(batches):
        group, chunk, size, route = [], [], 0, None

        def closed():
            return group if len({r[1] for r in group}) > 1 else []

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] != route:
                    chunk += closed()
                    group, route = [], row[2]
                    if size > CHUNK_BYTES:
                        out += settle(chunk) if chunk else []
                        chunk, size = [], 0
                group.append(row)
                size += len(row[4])
            if out:
                yield sent(out)
        chunk += closed()
        if chunk and (out := list(settle(chunk))):
            yield sent(out)

    return in_arrow(contexts.select("uid", "id", "route", "place", "body", "dest").repartition("route").sortWithinPartitions("route"), run, "dest int, uid long, body binary")


def _of_crowds(contexts: DataFrame) -> DataFrame:
    """(dest, uid, body): the same spans by windows; for anchors that have too many contexts for one task."""

    def run(batches):
        for batch in batches:
            bodies = []
            for mask, base in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = base + np.flatnonzero(mask >> np.arange(SPAN) & 1)
                bodies.append(np.stack([at, at + WIDTH], axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["dest", "uid", "body"])

    windows = contexts.where(F.octet_length("body") >= WIDTH).withColumn("i", F.explode(F.sequence(F.lit(0), F.octet_length("body") - WIDTH)))
    windows = windows.select("dest", "uid", "id", "place", "i", F.expr(f"substring(body, i + 1, {WIDTH})").alias("window"))
    # Few windows of a border are shared: as a table of known size they can be sent to the others instead of a second shuffle.
    least = written(windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"))
    late = windows.join(least, "window").where("id > least").groupBy("dest", "uid", "place").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return in_arrow(late.select("dest", "uid", "mask", "place"), run, "dest int, uid long, body binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of df.

    A null text counts as empty; texts under WIDTH bytes lose nothing. Rows with equal ids take nothing from each other; a row without an id
    neither loses nor takes anything. Other columns are not read; an empty table gives an empty result.
    """
    named = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = named.where("id is not null")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / PART_BYTES))
    applied = written(_applied(docs, _verdicts(_occurrences(docs, parts), parts), parts), compression="zstd")
    undecided = applied.where("kind = 1")
    crowded = written(undecided.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("route"))
    spans = applied.where("kind = 0").select("dest", "uid", "body")
    if crowded.isEmpty():
        spans = spans.union(_decided(undecided))
    else:
        spans = spans.union(_decided(undecided.join(crowded, "route", "left_anti"))).union(_of_crowds(undecided.join(crowded, "route", "left_semi")))
    bare = named.where("id is null").select("id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256))
    return _finished(docs, spans, parts).union(bare)
