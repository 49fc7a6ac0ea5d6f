"""Features of whole batches of texts, worked out over their code points at once.

All texts of an Arrow batch are one array of code points; a table tells the classes of each point as bits, so a count of any
class in every text is one sum over runs. What needs neighbours (runs, digits beside letters) compares the array with itself
shifted by one. Only user-seen characters, which few texts need, go through a pattern text by text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import vector

#: Classes of code points, and how the pattern module writes them.
CLASSES = {
    "alphabetic": r"\p{Alphabetic}",
    "number": r"\p{N}",
    "upper": r"\p{Lu}",
    "invisible": f"[{T.INVISIBLE}]",
    "bidi": f"[{T.BIDI}]",
    "combining": f"[{T.COMBINING}]",
    "selector": f"[{T.SELECTORS}]",
    "joiner": f"[{T.JOINERS}]",
    "full_width": f"[{T.FULL_WIDTH}]",
    "blank": f"[{T.EXTRA_BLANKS}]",
    "emoji": "[\U0001f000-\U0001faff☀-➿]",
    "confusable": "[" + "".join(ch for ch in T.CONFUSABLE_FROM if not ("０" <= ch <= "ｚ") and ch != "Ⅰ") + "]",
    "punctuation": r"[!-/:-@\[-`{-~]",
    **{f"script {s}": rf"\p{{{s}}}" for s in T.SCRIPTS},
}
BIT = {name: np.uint32(1 << i) for i, name in enumerate(CLASSES)}


@functools.cache
def class_table() -> np.ndarray:
    """For every code point the bits of its classes; made once in each worker."""
    import regex

    points = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)
    table = np.zeros(0x110000, np.uint32)
    for name, pattern in CLASSES.items():
        found = "".join(regex.findall(f"{pattern}+", points))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] |= BIT[name]
    return table


@functools.cache
def _graphemes():
    import regex

    return regex.compile(r"\X"), regex.compile(f"^[{T.COMBINING}]|‍$|[{T.SELECTORS}].*[{T.SELECTORS}]", regex.DOTALL)


def malformed_text(text: str) -> int:
    """User-seen characters that begin with a combining mark, end in a joiner, or hold two selectors."""
    shown, bad = _graphemes()
    return sum(bool(bad.search(g)) for g in shown.findall(text))


class Points:
    """A batch of texts as one array; null and empty texts have no points."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        self.sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.codes = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.joined = np.zeros(len(self.codes), bool)  # whether a point and the one before stand in one text
        self.joined[1:] = self.row[1:] == self.row[:-1]

    @functools.cached_property
    def flags(self) -> np.ndarray:
        return class_table()[self.codes]

    def sums(self, of: np.ndarray) -> np.ndarray:
        """How often a flag over the points is set in each text."""
        whole = np.concatenate([[0], np.cumsum(of)])
        ends = np.cumsum(self.sizes)
        return whole[ends] - whole[ends - self.sizes]

    def has(self, name: str) -> np.ndarray:
        return self.flags & BIT[name] != 0

    def count(self, name: str) -> np.ndarray:
        return self.sums(self.has(name))

    def scripts(self) -> np.ndarray:
        """How many scripts each text has letters of."""
        return sum((self.count(f"script {s}") > 0).astype(np.int64) for s in T.SCRIPTS)

    def _runs(self, same: np.ndarray) -> np.ndarray:
        """The length of the run that ends at each point, where ``same`` joins a point to the one before."""
        at = np.arange(len(same))
        return at - np.maximum.accumulate(np.where(same, 0, at)) + 1 if len(same) else at

    def repetition(self) -> np.ndarray:
        """The share of characters that cutting runs of three or more would take away."""
        marks = np.isin(self.codes, [ord("!"), ord("?"), ord(".")])
        able = self.has("alphabetic") | self.has("number") | marks
        same = self.joined.copy()
        same[1:] &= (self.codes[1:] == self.codes[:-1]) & able[1:]
        run = self._runs(same)
        last = np.ones(len(run), bool)
        last[:-1] = ~same[1:]
        lost = self.sums(np.where(last & (run >= 3) & able, run - 1, 0))
        return np.minimum(1.0, lost / np.maximum(1, self.sizes))

    def flooded(self) -> np.ndarray:
        marks = np.isin(self.codes, [ord("!"), ord("?"), ord(".")])
        same = self.joined.copy()
        same[1:] &= marks[1:] & marks[:-1]
        return self.sums(marks & (self._runs(same) >= 3)) > 0

    def leet(self) -> np.ndarray:
        """Whether a digit stands beside a letter."""
        digit, letter = (self.codes >= 48) & (self.codes <= 57), self.has("alphabetic")
        beside = self.joined.copy()
        beside[1:] &= digit[1:] & letter[:-1] | letter[1:] & digit[:-1]
        return self.sums(beside) > 0

    def entropy(self) -> np.ndarray:
        """Shannon entropy of the characters of each text in bits."""
        key, n = np.unique(self.row.astype(np.uint64) << np.uint64(21) | self.codes, return_counts=True)
        total = np.bincount((key >> np.uint64(21)).astype(np.int64), n * np.log2(n), minlength=len(self.texts))
        return np.where(self.sizes > 0, np.log2(np.maximum(1, self.sizes)) - total / np.maximum(1, self.sizes), 0.0)

    def malformed(self) -> np.ndarray:
        """Only texts with marks, joiners or selectors can hold any."""
        out = np.zeros(len(self.texts), np.int64)
        for i in np.flatnonzero(self.sums(self.flags & (BIT["combining"] | BIT["joiner"] | BIT["selector"]) != 0)).tolist():
            out[i] = malformed_text(self.texts[i])
        return out

    def suspicion(self) -> np.ndarray:
        """How much a text's characters look like a disguise, from 0 to about 2."""
        capped = lambda n, each, most: np.minimum(n * each, most)
        return (
            np.where(self.scripts() > 1, 0.4, 0.0) + capped(self.count("confusable"), 0.15, 0.5) + capped(self.count("invisible"), 0.1, 0.3) + capped(self.count("blank"), 0.05, 0.2)
            + capped(self.count("bidi"), 0.25, 0.5) + np.where(self.count("combining") > 0, 0.05, 0.0) + capped(self.count("selector"), 0.02, 0.1) + capped(self.count("joiner"), 0.02, 0.1)
            + capped(self.count("full_width"), 0.10, 0.3) + capped(self.malformed(), 0.20, 0.5)
        )

    def disguise(self) -> dict[str, np.ndarray]:
        """The scores of disguise, and the flags in their order."""
        n, d, e, odd = self.count("alphabetic"), self.count("number"), self.count("emoji"), self.count("confusable")
        repeated, leet, flooded, mixed = self.repetition(), self.leet(), self.flooded(), self.scripts() > 1
        fragments = np.where((n > 0) & ((d > 0) | (e > 0)), np.minimum(1.0, (d + e) / np.maximum(1, n)), 0.0)
        replaced = np.where((e > 0) & (n > 0), 0.35, 0.0)
        leet_score = np.where(leet, np.maximum(0.35, np.minimum(1.0, d / np.maximum(1, n))), 0.0)
        twins, unicode_score = np.minimum(1.0, odd * 0.35), self.suspicion()
        flags = {
            "leetspeak": leet, "repetition": repeated >= 0.08, "punctuation_flood": flooded, "mixed_scripts": mixed, "confusables": odd > 0, "invisible_characters": self.count("invisible") > 0,
            "bidirectional_controls": self.count("bidi") > 0, "fragmentation": fragments >= 0.2, "uppercase_flood": (n >= 4) & (self.count("upper") > 0.9 * n),
        }
        score = np.minimum(1.0, leet_score * 0.35 + repeated * 0.25 + flooded * 0.15 + mixed * 0.2 + twins * 0.25 + unicode_score * 0.25 + fragments * 0.15 + replaced * 0.15)
        any_flag = np.logical_or.reduce(list(flags.values())) if len(n) else np.zeros(0, bool)
        return {
            "detected": (score >= 0.25) | any_flag, "score": score, "leet_score": leet_score, "homoglyph_score": twins, "unicode_score": unicode_score, "fragmentation_score": fragments,
            "symbol_substitution_score": replaced, "repetition_score": repeated, "flags": flags,
        }


def _nulls(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_null())


@vector("double")
def entropy(column: pa.Array) -> pa.Array:
    return pa.array(Points(column.to_pylist()).entropy(), mask=_nulls(column))


@vector("double")
def suspicion(column: pa.Array) -> pa.Array:
    return pa.array(Points(column.to_pylist()).suspicion(), mask=_nulls(column))


@vector("int")
def malformed(column: pa.Array) -> pa.Array:
    return pa.array(Points(column.to_pylist()).malformed().astype(np.int32), mask=_nulls(column))


@vector("detected boolean, score double, leet_score double, homoglyph_score double, unicode_score double, fragmentation_score double, symbol_substitution_score double, repetition_score double, flags array<string>")
def obfuscation(column: pa.Array) -> pa.Array:
    """The scores and flags of disguise as one struct; null for a null text."""
    found = Points(column.to_pylist()).disguise()
    flags = found.pop("flags")
    names = np.array(list(flags), dtype=object)
    raised = np.stack(list(flags.values()), axis=1) if len(column) else np.zeros((0, len(names)), bool)
    row, which = np.nonzero(raised)
    offsets = np.concatenate([[0], np.cumsum(raised.sum(axis=1))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[which], pa.string()))
    return pa.StructArray.from_arrays([*(pa.array(v) for v in found.values()), lists], names=[*found, "flags"], mask=pa.array(_nulls(column)))


def spam_columns(texts: list[str | None]) -> dict[str, np.ndarray]:
    """What the spam scorers count in each text."""
    from quillmesh.functions.tokens import segment_text

    p = Points(texts)
    kinds = {"url": np.zeros(len(texts), np.int32), "email": np.zeros(len(texts), np.int32), "emoji": np.zeros(len(texts), np.int32)}
    for i, t in enumerate(texts):
        for _, _, _, kind in segment_text(t, None):
            if kind in kinds:
                kinds[kind][i] += 1
    n, a, d = np.maximum(1, p.sizes), np.maximum(1, p.count("alphabetic")), p.disguise()
    return {
        "url_count": kinds["url"], "email_count": kinds["email"], "emoji_count": kinds["emoji"], "number_ratio": p.count("number") / n, "emoji_ratio": kinds["emoji"] / n, "uppercase_ratio": p.count("upper") / a,
        "punctuation_ratio": p.count("punctuation") / n, "entropy": p.entropy(), "repetition_score": d["repetition_score"], "obfuscation_score": d["score"], "mixed_scripts": (p.scripts() > 1).astype(float),
        "confusable_count": p.count("confusable").astype(np.int32), "leet_or_twins": d["flags"]["leetspeak"] | d["flags"]["confusables"], "length": p.sizes.astype(np.int32),
    }
