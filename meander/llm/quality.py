"""Quality rules: plain text counts and how a public tokeniser's vocabulary takes a text (its fertility).

A vocabulary trained on ordinary text spends few tokens on a word of its languages. Text of another kind (symbols, encoded
data, glyph noise) needs many tokens per character, falls back to single bytes or repeats few tokens. Measured per document:
code points per token, share of tokens that are fallback bytes, and entropy of the token distribution in bits. A document
is rejected outside the band of its class: its script and, where the table names a language that has a band and the text is not short,
its language. Entropy grows with length, so a band's floor is in steps of the number of tokens; every document is judged by all three
figures. Words are encoded one by one, so a distinct word of a block is encoded once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, in_arrow, letters, mix, ragged, text_blocks, tuples, word_spans

BAD_WORDS = 10
REPEAT_PERCENT = 20
#: Below that number of tokens the script's band holds, not the language's: a few words say little about a language.
SHORT_TOKENS = 128
#: A distinct word of a block is encoded once: larger blocks than elsewhere save time.
BLOCK = 1 << 19
#: Rows of a batch that are filtered together.
ROWS = 1000


@dataclass(frozen=True)
class Band:
    """Accepted ranges, ends included. min_entropy: (tokens, bits): from that many tokens on at least so many bits, in rising order."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: tuple[tuple[int, float], ...]


def short_floor(share: float, *longer: tuple[int, float]) -> tuple[tuple[int, float], ...]:
    """Entropy steps of a script: that share of the greatest possible, log2 of the least number of tokens of a step, then the given ones."""
    return tuple((n, round(share * log2(n), 2)) for n in (1, 16, 24, 32, 48, 64, 96)) + longer


def _steps(*floors: float) -> tuple[tuple[int, float], ...]:
    return tuple(zip((128, 192, 256, 384, 512, 768, 1024, 2048), floors, strict=True))


#: Scripts by first and last code point of their main blocks; the script of a text is the one of most of its letters listed here.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF),),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xEFF),),
    "georgian": ((0x10A0, 0x10FF),),
    "cjk": ((0x1100, 0x11FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
}
#: A text whose letters and marks, of any script, are less than that share of its words' code points has the class "none".
LEAST_LETTERS = 1 / 3
BANDS = {
    "latin": Band(1.25, 12.0, 0.10, short_floor(0.8, (128, 5.2), (256, 5.6), (512, 5.8), (1024, 6.0))),
    # Entropy: the 0.25 % of lowest figures among all documents labelled good of that language at sf0.1 (base rules passed, 128 tokens
    # or more), by steps of length, less a margin for what such a document just above a step has: 0.08, and 0.16 below 256 tokens.
    # Characters per token: the same less 0.1 to 0.2, as numbers and keys in a good text cost many tokens.
    "latin_en": Band(1.80, 12.0, 0.10, _steps(5.53, 5.77, 5.96, 6.13, 6.27, 6.46, 6.57, 6.73)),
    "latin_de": Band(1.90, 12.0, 0.10, _steps(5.60, 5.79, 5.90, 6.08, 6.19, 6.31, 6.37, 6.52)),
    "latin_fr": Band(1.60, 12.0, 0.10, _steps(5.39, 5.78, 5.90, 6.06, 6.08, 6.29, 6.34, 6.46)),
    "latin_es": Band(1.70, 12.0, 0.10, _steps(5.61, 5.61, 5.84, 6.11, 6.11, 6.33, 6.42, 6.57)),
    # Not fitted: there is no labelled text of these scripts. Ends well outside what plain sentences of them give with the 32k vocabulary.
    "greek": Band(0.7, 8.0, 0.30, short_floor(0.57)),
    "cyrillic": Band(1.0, 10.0, 0.20, short_floor(0.64)),
    "armenian": Band(0.5, 8.0, 0.40, short_floor(0.57)),
    "hebrew": Band(0.6, 8.0, 0.30, short_floor(0.5)),
    "arabic": Band(0.6, 8.0, 0.40, short_floor(0.57)),
    "indic": Band(0.4, 8.0, 0.70, short_floor(0.5)),
    "thai": Band(0.6, 8.0, 0.40, short_floor(0.57)),
    "georgian": Band(0.6, 8.0, 0.30, short_floor(0.5)),
    "cjk": Band(0.3, 4.0, 0.90, short_floor(0.64)),
    # Letters of scripts that the vocabulary hardly knows: it falls back to bytes and cannot tell such a text from noise.
    "other": Band(0.6, 8.0, 0.30, short_floor(0.5)),
    # Hardly any letters: symbols, glyphs, numbers.
    "none": Band(1.5, 12.0, 0.10, short_floor(0.8)),
}


def _class(script: str, lang: str | None, tokens: int, bands: dict[str, Band]) -> str:
    key = f"{script}_{lang}"
    return key if tokens >= SHORT_TOKENS and key in bands else script


def _fits(band: list[Band], tokens: np.ndarray, per_token: np.ndarray, share: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Whether each document's figures are inside its band."""
    low, high, most = (np.array([getattr(b, k) for b in band]) for k in ("min_chars_per_token", "max_chars_per_token", "max_byte_share"))
    floor = np.zeros(len(band))
    for b in set(band):
        own = np.flatnonzero([x is b for x in band])
        starts, floors = (np.array(x) for x in zip(*b.min_entropy, strict=True))
        step = np.searchsorted(starts, tokens[own], "right") - 1
        floor[own] = np.where(step >= 0, floors[np.maximum(step, 0)], 0.0)
    return (per_token >= low) & (per_token <= high) & (share <= most) & (entropy >= floor)


_models: dict = {}


def _model(spec):
    """spec: path of a sentencepiece model, or its bytes."""
    if spec not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(**({"model_proto": spec} if isinstance(spec, bytes) else {"model_file": spec}))
        _models[spec] = m, np.array([m.is_byte(i) for i in range(m.vocab_size())])
    return _models[spec]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def _lines(data: np.ndarray, off: np.ndarray, start: np.ndarray, prefix: Prefix) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, per document."""
    n = len(off) - 1
    doc_first = off[:-1]
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([doc_first, breaks + 1]), kind="stable")
    doc = np.searchsorted(off[1:], begin, "right")
    # A break at the end of a document opens a line at the next one's offset: it is empty, and its document does not matter.
    stop = np.append(begin[1:], off[-1])
    ends_at_break = np.zeros(len(data) + 1, bool)
    ends_at_break[breaks + 1] = True
    stop = np.where(ends_at_break[stop] & (stop > begin), stop - 1, stop)
    some = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, doc = begin[some], stop[some], doc[some]
    key = mix(prefix.of(begin, stop) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=n)


def _repeats(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words inside windows of width words that the document has twice or more, per document."""
    n, words = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n), words)
    runs = tuples(h, width)
    at = np.flatnonzero(doc[: len(runs)] == doc[width - 1 :]) if len(runs) else np.zeros(0, np.int64)
    key = mix(runs[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not len(key):
        return np.zeros(n, np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    twice = same | np.append(same[1:], False)
    mark = np.zeros(len(h) + 1, np.int32)
    hit = at[order[twice]]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + width, -1)
    return _per_doc(np.cumsum(mark[:-1]) > 0, first)


def _script(data: np.ndarray, off: np.ndarray, chars: np.ndarray) -> list[str]:
    """The script of each document, whose words have chars code points. Code points are decoded only where a lead byte asks for it."""
    n = len(off) - 1
    counts = np.zeros((n, len(SCRIPTS)), np.int64)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    counts[:, 0] = _per_doc(ascii_letter, off)
    known = counts[:, 0].copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        first, rest = b[lead], [b[lead + i] & 63 for i in (1, 2, 3)]
        cp = np.where(first < 0xE0, (first & 31) << 6 | rest[0], np.where(first < 0xF0, (first & 15) << 12 | rest[0] << 6 | rest[1], (first & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]))
        doc = np.searchsorted(off[1:], lead, "right")
        is_letter = letters()[0][cp] > 0
        known += np.bincount(doc[is_letter], minlength=n)
        for i, ranges in enumerate(SCRIPTS.values()):
            inside = np.zeros(len(cp), bool)
            for a, z in ranges:
                inside |= (cp >= a) & (cp <= z)
            counts[:, i] += np.bincount(doc[inside & is_letter], minlength=n)
    names = np.array([*SCRIPTS, "other", "none"])
    script = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(SCRIPTS))
    return names[np.where(known >= np.maximum(LEAST_LETTERS * chars, 1), script, len(SCRIPTS) + 1)].tolist()


def _fertility(data, start, end, h, first, spec):
    """Tokens, fallback bytes and token entropy of each document of a block."""
    model, is_byte = _model(spec)
    n = len(first) - 1
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    ids = model.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], num_threads=1)
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    tokens = _per_doc(sizes[inverse], first)
    fallback = _per_doc(np.add.reduceat(np.append(is_byte[flat], 0), begins)[inverse] * (sizes[inverse] > 0), first) if len(begins) else np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    key = np.repeat(doc, sizes[inverse]) * len(is_byte) + flat[ragged(begins[inverse], sizes[inverse])]
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(edge, len(key))).astype(float)
    owner = key[edge] // len(is_byte)
    t = np.maximum(tokens, 1).astype(float)
    entropy = np.bincount(owner, -(c / t[owner]) * np.log2(c / t[owner]), minlength=n) if len(edge) else np.zeros(n)
    return tokens, fallback, entropy


def _measure(column, langs: list | None, spec, bands: dict[str, Band]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in NAMES}
    for at, _, data, off in text_blocks(column, BLOCK):
        start, end, first = word_spans(data, off)
        prefix = Prefix(data)
        h = prefix.of(start, end)
        n_words = np.diff(first)
        # Whatever is neither ASCII white space nor a continuation byte is a code point of a word.
        in_word = np.zeros(len(data) + 1, np.int8)
        np.add.at(in_word, start, 1)
        np.add.at(in_word, end, -1)
        chars = _per_doc((np.cumsum(in_word[:-1]) > 0) & ((data & 0xC0) != 0x80), off)
        repeats = _repeats(h, first, 5)
        tokens, fallback, entropy = _fertility(data, start, end, h, first, spec)
        script = _script(data, off, chars)
        lang = langs[at : at + len(script)] if langs is not None else [None] * len(script)
        script = [_class(*x, bands) for x in zip(script, lang, tokens.tolist(), strict=True)]
        failed = (n_words < BAD_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
        per_token, share = chars / np.maximum(tokens, 1), fallback / np.maximum(tokens, 1)
        fits = _fits([bands.get(s) or bands["other"] for s in script], tokens, per_token, share, entropy)
        for k, v in zip(NAMES, (n_words, chars, _per_doc(_SYMBOL[data], off), _lines(data, off, start, prefix), repeats, failed, fits & ~failed, tokens, per_token, share, entropy, script), strict=True):
            out[k] += v.tolist() if isinstance(v, np.ndarray) else v
    return out


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script")
_TYPES = dict(zip(NAMES, ("long", "long", "long", "long", "long", "boolean", "boolean", "long", "double", "double", "double", "string"), strict=True))
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def quality_rules(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bands: dict[str, Band] | None = None, lang_col: str = "lang") -> DataFrame:
    """One row for each row of df: its id, the base counts, base_failed, the fertility figures, script (the key of the band held) and kept.

    A null or empty text has no words: all counts 0, base_failed, not kept. Ids may be null or repeat; every row is judged
    alone, so ties and repeated rows get equal verdicts. Of the other columns only lang_col is read, if there is one. An empty table gives an empty result.
    """
    bands = bands or BANDS
    spec = open(model, "rb").read()
    lang = [F.col(lang_col).alias("lang")] if lang_col in df.columns else []

    def run(batches):
        for batch in batches:
            got = _measure(batch.column(1), batch.column(2).to_pylist() if batch.num_columns > 2 else None, spec, bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k], _ARROW[_TYPES[k]]) for k in NAMES)], ["id", *NAMES])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *lang), run, f"id {kind}, " + ", ".join(f"{k} {t}" for k, t in _TYPES.items()))


def good_rows(df: DataFrame, model: str, text_col: str = "text", bands: dict[str, Band] | None = None, lang_col: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, with all their columns, without a shuffle.

    A row with a null or empty text goes; rows with a null or repeated id and repeated rows are judged each; an empty table gives an
    empty result. Other columns, whatever their names, pass through.
    """
    bands = bands or BANDS
    spec = open(model, "rb").read()
    place = df.columns.index(text_col)
    lang = df.columns.index(lang_col) if lang_col in df.columns else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # copies of a few rows at a time
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(_measure(part.column(place), None if lang is None else part.column(lang).to_pylist(), spec, bands)["kept"], pa.bool_()))

    return in_arrow(df, run, df.schema)
