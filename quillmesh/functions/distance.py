"""Distances and similarities of strings. Levenshtein is Spark's own; the others run as Arrow functions over pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import arrow
from quillmesh.functions.normalize import fold_text, strip_marks_text


def _edits(a: str, b: str, swaps: bool) -> int:
    """Edit distance by bit vectors: one step of a few long additions for each character of ``b``."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a  # the distance is the same either way, and a step is cheap however long the bit vectors are
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, before, edits = full, 0, 0, 0, len(a)
    for ch in b:
        hit = where.get(ch, 0)
        turned = (~diagonal & hit) << 1 & before if swaps else 0
        diagonal = ((hit & up) + up ^ up) | hit | down | turned
        right, left = down | ~(diagonal | up) & full, diagonal & up
        edits += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & full
        up, down = (left << 1 | ~(diagonal | right)) & full, right & diagonal & full
        before = hit
    return edits


def osa_text(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no place edited twice (optimal string alignment)."""
    return _edits(a, b, True)


def levenshtein_text(a: str, b: str) -> int:
    return _edits(a, b, False)


def jaro_text(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    # a character takes the leftmost free equal one in reach; as the reach moves right, each kind of character needs one pointer
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    at = dict.fromkeys(places, 0)
    met_a, at_b = [], []
    for i, x in enumerate(a):
        own = places.get(x)
        if own is None:
            continue
        k = at[x]
        while k < len(own) and own[k] < i - reach:
            k += 1
        if k < len(own) and own[k] <= i + reach:
            met_a.append(x)
            at_b.append(own[k])
            k += 1
        at[x] = k
    m = len(met_a)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(met_a, sorted(at_b), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal first letters, whatever the Jaro."""
    return _winkler(a, b, jaro_text(a, b))


def _winkler(a: str, b: str, j: float) -> float:
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + 0.1 * same * (1 - j)


def ngram_text(a: str, b: str, n: int) -> float:
    """Jaccard of the multisets of character n-grams."""
    if a == b:
        return 1.0
    if n <= 3 and len(a) + len(b) > 200:
        return ngrams_of_codes(*(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for x in (a, b)), n)
    x, y = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def ngrams_of_codes(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """The same for sequences of numbers of at most 21 bits, n-grams of at most three: counted by sorting."""
    grams = []
    for x in (a, b):
        size = max(0, len(x) - n + 1)
        key = np.zeros(size, np.uint64)
        for i in range(n):
            key = key << np.uint64(21) | x[i : i + size]
        grams.append(np.unique(key, return_counts=True))
    (p, m), (q, k) = grams
    _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], k[j]).sum())
    union = int(m.sum() + k.sum()) - shared
    return shared / union if union else 0.0


def lcs_text(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def character_text(a: str, b: str) -> dict[str, float]:
    """The parts of character similarity and their blend, over folded texts without marks."""
    return character_folded(*(strip_marks_text(fold_text(x)) for x in (a, b)))


def character_bound(a: Counter, b: Counter) -> float:
    """What the blend of two folded texts with these characters can't exceed, from what they have in common."""
    n, m = a.total(), b.total()
    shared = (a & b).total()
    if not n or not m:
        return 1.0 if n == m else 0.0
    most, jaro = shared / max(n, m), (shared / n + shared / m + 1) / 3 if shared else 0.0
    return sum(T.CHARACTER[k] * v for k, v in {"levenshtein": most, "damerau": most, "jaro": jaro, "jaro_winkler": jaro + 0.4 * (1 - jaro), "ngram": 1.0, "lcs": most}.items())


def character_folded(a: str, b: str) -> dict[str, float]:
    """The same for texts that are folded already."""
    if a == b:
        return dict.fromkeys([*T.CHARACTER, "combined"], 1.0)
    longest, j = max(len(a), len(b), 1), jaro_text(a, b)
    parts = {
        "levenshtein": 1 - levenshtein_text(a, b) / longest,
        "damerau": 1 - osa_text(a, b) / longest,
        "jaro": j,
        "jaro_winkler": _winkler(a, b, j),
        "ngram": (ngram_text(a, b, 2) + ngram_text(a, b, 3)) / 2,
        "lcs": lcs_text(a, b) / longest,
    }
    return parts | {"combined": sum(T.CHARACTER[k] * v for k, v in parts.items())}


def _pairs(fn, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return arrow(kind)(run)


osa = _pairs(osa_text, "int")
jaro = _pairs(jaro_text, "double")
jaro_winkler = _pairs(jaro_winkler_text, "double")
bigrams = _pairs(lambda a, b: ngram_text(a, b, 2), "double")
trigrams = _pairs(lambda a, b: ngram_text(a, b, 3), "double")
lcs = _pairs(lcs_text, "int")
character = _pairs(lambda a, b: character_text(a, b)["combined"], "double")


@arrow("levenshtein double, damerau double, jaro double, jaro_winkler double, ngram double, lcs double, combined double")
def character_parts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    names = [*T.CHARACTER, "combined"]
    rows = [dict.fromkeys(names, np.nan) if x is None or y is None else character_text(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=names)


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the share of edits, code point by code point."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
