"""Segments, tokens, lemmas, n-grams and hashes of texts.

Segments are found by one pattern whose alternatives stand in order of precedence; only their offsets, which count UTF-8
bytes, need more than the match itself.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import arrow, vector
from quillmesh.functions.normalize import fold_text
from quillmesh.runtime import map_batches

SEGMENT = "array<struct<text:string,start:int,end:int,segment_type:string>>"
# Endings cut from words without a known lemma, longest stem kept at least three letters.
ENDINGS = ("mente", "iendo", "ación", "ción", "cion", "ando", "ing", "ed", "es", "s")


@functools.cache
def _patterns():
    """The patterns for texts with and without signs of addresses and tags, and the one of user-seen characters.

    Classes come from the Unicode tables of the pattern module and are written out for the faster standard one.
    """
    import regex

    points = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)

    def ranges(body: str) -> str:
        out = []
        for run in regex.findall(f"{body}+", points):
            start = 0
            for i in range(1, len(run) + 1):
                if i == len(run) or ord(run[i]) != ord(run[i - 1]) + 1:
                    out.append(f"\\U{ord(run[start]):08x}-\\U{ord(run[i - 1]):08x}")
                    start = i
        return "".join(out)

    word, number, blank = ranges(r"[\p{Alphabetic}\p{Mn}\p{Mc}'’_‌‍]"), ranges(r"\p{N}"), ranges(r"\s")
    dark, light = f"[^{blank}]", f"(?<![^{blank}])"
    plain = rf"(?P<text>[{word}]+)|(?P<number>[{number}]+)|(?P<other>{dark})"
    marked = rf"(?P<url>(?i:https?://){dark}+)|(?P<email>{light}{dark}*@{dark}*\.{dark}*|{light}{dark}*\.{dark}*@{dark}*)|(?P<mention>{light}@{dark}+)|(?P<hashtag>{light}\#{dark}+)|"
    return re.compile(plain), re.compile(marked + plain), regex.compile(r"\X")


@functools.lru_cache(65536)
def _kind_of_sign(piece: str) -> str:
    import regex

    return "emoji" if regex.search(r"\p{Emoji}", piece) else "symbol" if regex.search(r"\p{S}", piece) else "unknown"


def _inside_sentence(text: str, start: int) -> bool:
    """Whether what stands before a word is neither the start of the text nor the end of a sentence."""
    at = start - 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return at >= 0 and text[at] not in ".!?"


def segment_text(text: str | None, most: int | None = T.SEGMENTS) -> list[tuple[str, int, int, str]]:
    """(text, start, end, type) of the segments, or of the first ``most``; offsets in UTF-8 bytes."""
    if not text:
        return []
    plain, marked, shown = _patterns()
    pattern = marked if "@" in text or "#" in text or "://" in text else plain
    ascii_, out, at, seen, place = text.isascii(), [], 0, 0, 0
    while m := pattern.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "other":
            if not ascii_ and not text[start : start + 2].isascii():
                end = shown.match(text, start).end()
            kind = _kind_of_sign(text[start:end])
        piece = text[start:end]
        if kind == "text" and len(piece) > 1 and piece[0].isupper() and piece[1:].islower() and start:
            kind = "named_entity" if _inside_sentence(text, start) else "text"
        if ascii_:
            a, b = start, end
        else:
            a = place + len(text[seen:start].encode("utf-8", "surrogatepass"))
            b = a + len(piece.encode("utf-8", "surrogatepass"))
            seen, place = end, b
        out.append((piece, a, b, kind))
        if most is not None and len(out) == most:
            break
        at = end
    return out


def _segment_columns(texts: list[str | None], most: int | None) -> tuple[np.ndarray, list[pa.Array]]:
    """How many segments each text has, and their columns one after another."""
    found = [segment_text(t, most) for t in texts]
    flat = [s for own in found for s in own]
    return np.fromiter(map(len, found), np.int64, len(found)), [pa.array([s[i] for s in flat], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]


@vector(SEGMENT)
def segments(column: pa.Array) -> pa.Array:
    """The first segments of each text, as many as an analysis takes; null texts have none."""
    size, columns = _segment_columns(column.to_pylist(), T.SEGMENTS)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.StructArray.from_arrays(columns, names=["text", "start", "end", "segment_type"]))


def segment_table(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """One row for each segment of each text: ``key``, pos, text, start, end, segment_type. Whole texts unless ``most`` is given."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, columns = _segment_columns(batch.column(1).to_pylist(), most)
        row = np.repeat(np.arange(len(size)), size)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), *columns], names=[key, "pos", "text", "start", "end", "segment_type"])

    kind = dict(df.dtypes)[key]
    return map_batches(df.select(key, text), run, f"`{key}` {kind}, pos int, text string, start int, end int, segment_type string")


def segment_counts(df: DataFrame, text: str) -> DataFrame:
    """(segment_type, n) over whole texts; each batch sends its counts alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(s[3] for t in batch.column(0).to_pylist() for s in segment_text(t, None))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["segment_type", "n"])

    return map_batches(df.select(text), run, "segment_type string, n bigint").groupBy("segment_type").agg(F.sum("n").alias("n"))


def tokens(segments: Column) -> Column:
    return F.transform(segments, lambda s: s["text"])


def words(c: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in the JVM."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def words_text(text: str) -> list[str]:
    """The same in Python."""
    return re.findall(r"[^\W_]+", text.lower())


def lemma_text(word: str) -> str:
    w = word.lower()
    if len(w) > 5:
        for end in ENDINGS:
            if w.endswith(end) and len(w) - len(end) >= 3:
                return w[: -len(end)]
    return w


def lemma(c: Column) -> Column:
    """The same by pattern, for words as a column."""
    w = F.lower(c)
    return F.when(F.length(w) > 5, F.regexp_replace(w, rf"(?<=^.{{3,200}})({'|'.join(ENDINGS)})$", "")).otherwise(w)


def word_ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


# ------------------------------------------------------------------------------------------------ hashes

_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(tokens: list[str], seed: int = 0) -> np.ndarray:
    """64-bit FNV-1a of each token, all tokens a byte at a time."""
    raw = [t.encode() for t in tokens]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.full(len(raw), _BASIS ^ np.uint64(seed))
    rows = np.zeros((len(raw), int(size.max(initial=0))), np.uint8)
    rows[np.arange(rows.shape[1])[None, :] < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    for i in range(rows.shape[1]):
        on = size > i
        out[on] = (out[on] ^ rows[on, i].astype(np.uint64)) * _PRIME
    return out


def simhash_tokens(tokens: list[str]) -> int:
    """Signed 64-bit pattern; a bit is set where more tokens set it than not."""
    if not tokens:
        return 0
    bits = fnv1a(tokens)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    votes = 2 * bits.astype(np.int64).sum(axis=0) - len(tokens)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[votes > 0].sum(dtype=np.uint64).view(np.int64))


def minhash_tokens(tokens: list[str], k: int = 32, saturating: bool = True) -> list[int]:
    """``k`` least hashes. The saturating kind clips each 64-bit hash to 32 bits, as its counterpart does; the other one
    keeps the upper half, which makes a usable signature."""
    top = 2**32 - 1
    if not tokens:
        return [top] * k
    out = []
    for salt in range(k):
        h = fnv1a(tokens, salt)
        out.append(int(min(top, h.min()) if saturating else (h >> np.uint64(32)).min()))
    return out


@arrow("long")
def simhash(s: pd.Series) -> pd.Series:
    return s.map(lambda t: simhash_tokens(list(t) if t is not None else []))


@arrow("array<long>")
def minhash_compat(s: pd.Series) -> pd.Series:
    return s.map(lambda t: minhash_tokens(list(t) if t is not None else []))


@arrow("array<long>")
def minhash(s: pd.Series) -> pd.Series:
    return s.map(lambda t: minhash_tokens(list(t) if t is not None else [], saturating=False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, 0.0).otherwise(equal / F.size(a))


# ------------------------------------------------------------------------------------------------ hashed vectors


def feature_hash_texts(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """Signed hashes of words (1.0) and character trigrams (0.25) of the folded text, at length one."""
    out = np.zeros((len(texts), dims))
    known: dict[str, int] = {}
    parts = []
    for row, text in enumerate(texts):
        if not text:
            continue
        folded = fold_text(text)
        found = folded.split()
        grams = list(map("".join, zip(folded, folded[1:], folded[2:], strict=False)))
        parts.append((row, len(found), np.array([known.setdefault(t, len(known)) for t in found + grams], np.int64)))
    h = np.zeros(len(known), np.uint64)
    of = list(known)
    short = np.fromiter((len(t) <= 3 for t in of), bool, len(of))  # long words alone take many steps
    for own in (short, ~short):
        at = np.flatnonzero(own)
        h[at] = fnv1a([of[i] for i in at.tolist()])
    place, sign = (h % np.uint64(dims)).astype(np.int64), np.where(h & np.uint64(1), -1.0, 1.0)
    for row, words, which in parts:
        weight = sign[which]
        weight[words:] *= 0.25
        out[row] = np.bincount(place[which], weight, dims)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def word_hash_texts(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """Words (1.0) and pairs of words (0.5), the sign from the top bit, at length one."""
    out = np.zeros((len(texts), dims))
    for row, text in enumerate(texts):
        if not text:
            continue
        found = re.findall(r"[^\W_]+", fold_text(text))
        pairs = [f"{a}\0{b}" for a, b in zip(found, found[1:], strict=False)]
        h = fnv1a(found + pairs)
        weight = np.concatenate([np.ones(len(found)), np.full(len(pairs), 0.5)])
        np.add.at(out[row], (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), -weight, weight))
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


@arrow("array<float>")
def feature_hash(s: pd.Series) -> pd.Series:
    return pd.Series(list(feature_hash_texts(s.tolist())))


@arrow("array<float>")
def word_hash(s: pd.Series) -> pd.Series:
    return pd.Series(list(word_hash_texts(s.tolist())))


def embedding_of(name: str):
    """The vector function of ``hash:N`` or ``wordhash:N``."""
    kind, _, dims = name.partition(":")
    made = {"hash": feature_hash_texts, "wordhash": word_hash_texts}.get(kind)
    if made is None or not dims.isdigit() or not 1 <= int(dims) <= 4096:
        raise ValueError(f"no such embedding: {name!r}")

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(made(s.tolist(), int(dims))))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return arrow("array<float>")(run)
