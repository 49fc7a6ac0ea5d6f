"""Resource packs (languages, symbols, abbreviations): reading, checking, merging, and their tables.

Packs are small files of the package or of a folder of the user. They are read on the driver under limits and become
tables, or a :class:`Lexicon` that travels with a closure.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
EMBEDDED = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources")


@dataclass(frozen=True)
class Limits:
    """Bounds that a pack must keep; file sizes are looked at before parsing."""

    bytes: int = 64 << 20
    entries: int = 1_000_000
    symbols: int = 100_000
    readings: int = 256


class PackError(ValueError):
    """A pack that breaks a rule; the message says which."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise PackError(what)


def declared_digest(pack: dict) -> str:
    """The digest of a pack without its own ``sha256`` field, in canonical JSON."""
    return hashlib.sha256(json.dumps({k: v for k, v in pack.items() if k != "sha256"}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def check(pack: dict, kind: str, limits: Limits = Limits()) -> dict:
    """The pack itself, if it keeps the rules of its kind."""
    _need(pack.get("schema_version") == SCHEMA_VERSION, f"schema_version must be {SCHEMA_VERSION}")
    if pack.get("sha256"):
        _need(pack["sha256"] == declared_digest(pack), "sha256 does not match the content")
    if kind in ("languages", "abbreviations"):
        _need(bool((pack.get("language") or "").strip()), "language must not be blank")
    rows = pack.get("symbols" if kind == "symbols" else "entries") or []
    _need(len(rows) <= (limits.symbols if kind == "symbols" else limits.entries), "too many entries")
    for row in rows:
        name = row.get("word" if kind == "languages" else "token")
        _need(bool((name or "").strip()), "an entry has a blank name")
        if kind == "languages":
            weight = row.get("weight", 1.0)
            _need(isinstance(weight, (int, float)) and math.isfinite(weight) and weight >= 0, f"weight of {name!r} must be finite")
        else:
            readings = row.get("readings") or []
            _need(len(readings) <= limits.readings, f"too many readings of {name!r}")
            for r in readings:
                _need(bool((r.get("text") or "").strip()), f"a reading of {name!r} is blank")
                _need(0 < r.get("probability", 0) <= 1, f"a probability of {name!r} is out of range")
    return pack


def read_packs(root: str, kind: str, limits: Limits = Limits()) -> Iterator[tuple[str, dict]]:
    """(path, pack) of all packs of a kind below ``root/kind``, in order of path; none where the folder is missing."""
    for at, folders, files in os.walk(os.path.join(root, kind)):
        folders.sort()
        for name in sorted(files):
            if name.endswith(".json"):
                path = os.path.join(at, name)
                _need(os.path.getsize(path) <= limits.bytes, f"{path} is too large")
                with open(path, encoding="utf-8") as f:
                    yield path, check(json.load(f), kind, limits)


@dataclass
class Lexicon:
    """Words, symbols and abbreviations of all packs, merged by language and token."""

    words: dict[str, dict[str, tuple[float, bool, str | None]]] = field(default_factory=dict)
    symbols: dict[str, list[tuple[str, str, float]]] = field(default_factory=dict)
    concepts: dict[str, list[str]] = field(default_factory=dict)
    abbreviations: dict[str, list[tuple[str, str, float]]] = field(default_factory=dict)

    def add_language(self, pack: dict) -> None:
        own = self.words.setdefault(pack["language"], {})
        rows = [(e["word"], 1.0 if e.get("weight") is None else e["weight"], bool(e.get("stop_word")), e.get("lemma")) for e in pack.get("entries") or []]
        rows += [(w, 1.0, False, None) for w in pack.get("words") or []] + [(w, 1.0, True, None) for w in pack.get("stop_words") or []]
        for word, weight, stop, lemma in rows:
            key = word.strip().lower()
            w, s, le = own.get(key, (0.0, False, None))
            own[key] = (max(w, weight), s or stop, le or lemma)

    def add_symbols(self, pack: dict) -> None:
        for row in pack.get("symbols") or []:
            own = self.symbols.setdefault(row["token"], [])
            for r in row.get("readings") or []:
                item = (r["text"], r.get("language") or pack.get("language") or "und", r["probability"])
                if all(x[:2] != item[:2] for x in own):
                    own.append(item)
            own.sort(key=lambda x: (-x[2], x[0], x[1]))
            self.concepts.setdefault(row["token"], []).extend(c["id"] for c in row.get("concepts") or [])

    def add_abbreviations(self, pack: dict) -> None:
        for row in pack.get("entries") or []:
            own = self.abbreviations.setdefault(row["token"].lower(), [])
            own.extend((r["text"], pack["language"], r["probability"]) for r in row["readings"])
            own.sort(key=lambda x: (-x[2], x[0], x[1]))

    def languages_of(self, word: str) -> list[str]:
        key = word.strip().lower()
        return [lang for lang in sorted(self.words) if key in self.words[lang]]

    def contains(self, word: str, languages: list[str] | None = None) -> bool:
        key = word.strip().lower()
        wild = not languages or any(x in ("und", "unknown") for x in languages)
        if wild:
            return key in self.all_words
        return any(key in own for lang, own in self.words.items() if wild or lang in languages)

    @functools.cached_property
    def all_words(self) -> frozenset[str]:
        return frozenset(w for own in self.words.values() for w in own)

    @functools.cached_property
    def _in_order(self) -> list[str]:
        return sorted(self.all_words)

    def starts(self, prefix: str) -> bool:
        """Whether any word begins like this."""
        at = bisect.bisect_left(self._in_order, prefix.lower())
        return at < len(self._in_order) and self._in_order[at].startswith(prefix.lower())

    def frequency(self, word: str) -> float:
        return self._most.get(word.lower(), 0.0)

    @functools.cached_property
    def _most(self) -> dict[str, float]:
        """The largest weight of each word in any language."""
        out: dict[str, float] = {}
        for own in self.words.values():
            for word, (weight, _, _) in own.items():
                out[word] = max(out.get(word, weight), weight)
        return out

    def lookup(self, word: str) -> str:
        """NotFound, Unique or Ambiguous by the number of languages that have the word."""
        return ("NotFound", "Unique")[len(self.languages_of(word))] if len(self.languages_of(word)) < 2 else "Ambiguous"


def load(root: str = EMBEDDED, limits: Limits = Limits()) -> Lexicon:
    """All packs below a root."""
    lexicon = Lexicon()
    for kind, add in (("languages", lexicon.add_language), ("symbols", lexicon.add_symbols), ("abbreviations", lexicon.add_abbreviations)):
        for _, pack in read_packs(root, kind, limits):
            add(pack)
    return lexicon


#: Rows of a table of language packs that may be read into a lexicon, and entries of all of them.
TABLE_ROWS, TABLE_ENTRIES = 1_000, 5_000_000


def from_table(packs: DataFrame, root: str = EMBEDDED) -> Lexicon:
    """The packs below a root with those of a table of language packs added; the size of the table is checked."""
    from pyspark.sql import functions as F

    rows, entries = packs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()
    if rows > TABLE_ROWS or entries > TABLE_ENTRIES:
        raise ValueError(f"{rows:,} packs with {entries:,} entries are too many for one lexicon")
    lexicon = load(root)
    for r in packs.collect():
        lexicon.add_language({"language": r.language, "entries": [e.asDict() for e in r.entries or [] if e.word], "stop_words": [w for w in r.stop_words or [] if w]})
    return lexicon


def manifest(spark: SparkSession, root: str = EMBEDDED) -> DataFrame:
    """One row for each pack: kind, path, language, name, entries, digest."""
    rows = [
        (kind, os.path.relpath(path, root), pack.get("language"), pack.get("name"), len(pack.get("symbols" if kind == "symbols" else "entries") or []), declared_digest(pack))
        for kind in ("languages", "symbols", "abbreviations")
        for path, pack in read_packs(root, kind)
    ]
    return spark.createDataFrame(rows, "kind string, path string, language string, name string, entries int, sha256 string")


def symbol_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    rows = [(t, text, lang, p) for t, rs in sorted(lexicon.symbols.items()) for text, lang, p in rs]
    return spark.createDataFrame(rows, "token string, reading string, language string, probability double")


def abbreviation_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    rows = [(t, text, lang, p) for t, rs in sorted(lexicon.abbreviations.items()) for text, lang, p in rs]
    return spark.createDataFrame(rows, "token string, reading string, language string, probability double")


def word_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    rows = [(lang, w, weight, stop, lemma) for lang, own in sorted(lexicon.words.items()) for w, (weight, stop, lemma) in sorted(own.items())]
    return spark.createDataFrame(rows, "language string, word string, weight double, stop_word boolean, lemma string")
