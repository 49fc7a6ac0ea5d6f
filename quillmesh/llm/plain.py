"""One plain form for texts that look alike (problem 1), and the words every other operator here counts.

The plain form of a text is found segment by segment. A precompiled class holds every code point that fails a
normalization quick check (NFKC "no", or "maybe" because it can join what stands before it), is invisible, or is a blank
of another kind. Only the runs of such characters, each with the one stable character before it as context, are
normalized; everything between is copied. A second pass looks at words that mix Latin, Greek and Cyrillic letters.

Defined results: a null text stays null; an empty or blank text stays as it is apart from its blanks; texts are never cut.
Joiners and selectors inside emoji stay. Applying :func:`plain` twice changes nothing more.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd

_LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
_JOINERS = "‍︎️"

# Letters of one script that look like a letter of another (Unicode confusables, Latin first).
_LOOK_LATIN = "aceopxyijskhABEKMHOPCTXYISJZvnuwtdgqrmNVWDLFGQRU"
_GREEK_TO_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειικνορτυχγωϲϳ", "ABEZHIKMNOPTYXaeiiKvoptuxywcj", strict=True)) | {"κ": "k", "η": "n", "μ": "u", "σ": "o", "β": "b"}
_CYRILLIC_TO_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝӏѵгпикмнтЗб", "ABESIJKMHOPCTYXaesijopcyxdhqwlvrnukmht36", strict=True))


def _as_ranges(points: list[int]) -> str:
    out, start, last = [], None, None
    for p in [*points, None]:
        if last is not None and p == last + 1:
            last = p
            continue
        if start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}" if last > start else f"\\U{start:08x}")
        start = last = p
    return "".join(out)


def _invisible(ch: str) -> bool:
    """Default ignorable and format characters, except the tags and selectors that only emoji use when they stand in one."""
    p = ord(ch)
    return unicodedata.category(ch) == "Cf" and not 0x600 <= p <= 0x605 and p not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD) or p in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= p <= 0xFE0F or 0x180B <= p <= 0x180F or 0xE0100 <= p <= 0xE01EF


def _odd_blank(ch: str) -> bool:
    return unicodedata.category(ch) == "Zs" and ch != " "


@functools.cache
def unstable_points() -> frozenset[str]:
    """Every character that may change."""
    seconds, found = set(), []
    # ideographs, syllables, surrogates and private or empty planes have no other form
    points = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x17000), *range(0x1AFF0, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]
    for p in points:
        d = unicodedata.decomposition(chr(p))
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2:
                seconds.add(int(parts[1], 16))
    seconds |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for p in points:
        ch = chr(p)
        if ch in _LINE_BREAKS:
            continue
        folded = unicodedata.normalize("NFKC", ch)
        if folded.startswith(" ") and not _odd_blank(ch):
            continue  # spacing accents: taking them apart would part words
        if folded != ch or p in seconds or unicodedata.combining(ch) or _invisible(ch) or _odd_blank(ch):
            found.append(ch)
    return frozenset(found)


@functools.cache
def _segments() -> re.Pattern[str]:
    c = _as_ranges(sorted(map(ord, unstable_points())))
    return re.compile(f"([^{c}]?)([{c}]+)(?=(.?))", re.DOTALL)


@functools.cache
def _letters_elsewhere() -> frozenset[str]:
    """Greek and Cyrillic letters, the only ones that take part in mixed words beside Latin ones."""
    return frozenset(c for c in map(chr, range(0x370, 0xA6A0)) if _has_other.match(c))


_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
_OTHER = "Ͱ-ͳͶͷͻ-ͽͿΆΈ-ϡϰ-Ͽἀ-῿Ѐ-ԯᲀ-ᲈꙀ-ꚟ"
_GREEK = "Ͱ-ϡϰ-Ͽἀ-῿"
_CYRILLIC = "Ѐ-ԯᲀ-ᲈꙀ-ꚟ"
_has_other = re.compile(f"[{_OTHER}]")
_mixed = re.compile(f"[{_LATIN}][^\\W_]*?[{_OTHER}]|[{_OTHER}][^\\W_]*?[{_LATIN}]|[{_GREEK}][^\\W_]*?[{_CYRILLIC}]|[{_CYRILLIC}][^\\W_]*?[{_GREEK}]")
_word = re.compile(r"[^\W_]+")


def _is_picture(ch: str) -> bool:
    if not ch:
        return False
    p = ord(ch)
    return unicodedata.category(ch) in ("So", "Sk") or p in (0x203C, 0x2049, 0x3030, 0x303D, 0x20E3) or 0x2190 <= p <= 0x21FF or 0x1F1E6 <= p <= 0x1FAFF or ch in "0123456789#*"


def kept_of(m: re.Match[str]) -> list[tuple[int, str]]:
    """What of an unstable run stays, blanks replaced, each with its place in the run."""
    base, run, after = m.group(1), m.group(2), m.group(3)
    kept, before = [], base
    for i, ch in enumerate(run):
        if _odd_blank(ch):
            kept.append((i, " "))
        elif ch in _JOINERS:
            follows = run[i + 1] if i + 1 < len(run) else after
            picture = _is_picture(before) and not (ch == "‍" and before in "0123456789#*")
            if picture and (ch != "‍" or _is_picture(follows)) and (before not in "0123456789#*" or follows == "⃣"):
                kept.append((i, ch))
                if ch != "‍":
                    continue  # a selector leaves the picture before it in place
        elif 0x1F3FB <= ord(ch) <= 0x1F3FF or not _invisible(ch):
            kept.append((i, ch))
        elif 0xE0020 <= ord(ch) <= 0xE007F and _is_picture(base):
            kept.append((i, ch))
        else:
            continue
        before = ch
    return kept


def _segment(m: re.Match[str]) -> str:
    """One stable character and the unstable run after it, in plain form."""
    base, rest = m.group(1), "".join(ch for _, ch in kept_of(m))
    if rest and not rest.isspace():
        return unicodedata.normalize("NFKC", base + rest)
    return base + rest


def _script(ch: str) -> str:
    p = ord(ch)
    if p < 0x250 or 0x1E00 <= p <= 0x1EFF:
        return "L" if ch.isalpha() else ""
    if 0x370 <= p <= 0x3FF or 0x1F00 <= p <= 0x1FFF:
        return "G" if ch.isalpha() else ""
    if 0x400 <= p <= 0x52F or 0x1C80 <= p <= 0x1C88 or 0xA640 <= p <= 0xA69F:
        return "C" if ch.isalpha() else ""
    return "X" if ch.isalpha() else ""


@functools.cache
def _twins() -> dict[str, dict[str, str]]:
    """For each target script, letters of the others and the twin they stand for."""
    to_latin = _GREEK_TO_LATIN | _CYRILLIC_TO_LATIN
    to_latin = {k: v for k, v in to_latin.items() if v.isalpha()}
    to_cyrillic = {v: k for k, v in zip("АВЕЅІЈКМНОРСТУХаеѕіјорсух", "ABESIJKMHOPCTYXaesijopcyx", strict=True)}
    to_greek = {v: k for k, v in zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορι", "ABEZHIKMNOPTYXavopi", strict=True)}
    return {
        "L": to_latin,
        "C": to_cyrillic | {g: to_cyrillic[x] for g, x in _GREEK_TO_LATIN.items() if x in to_cyrillic},
        "G": to_greek | {c: to_greek[x] for c, x in _CYRILLIC_TO_LATIN.items() if x in to_greek},
    }


#: Twins that hold only for upright shapes; used where a word can't be brought to one script by the sure ones.
_SURE = set("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιаеѕіјорсухАВЕЅІЈКМНОРСТУХԁһԛԝӏѵ") | set("ABESIJKMHOPCTYXaesijopcyxvZN")


def _mixes(word: str) -> bool:
    scripts = {s for s in map(_script, word) if s}
    return len(scripts & {"L", "G", "C"}) > 1


def _one_script(word: str, near: str) -> str:
    """A mixed word in the one script that can hold all of its letters; ``near`` is the script of the words around it."""
    scripts = [_script(ch) for ch in word]
    counts = {s: scripts.count(s) for s in "LCG"}
    best: tuple[tuple, str] | None = None
    for target in "LCG":
        twin = _twins()[target]
        foreign = [ch for ch, s in zip(word, scripts, strict=True) if s and s != target]
        if counts[target] and all(ch in twin for ch in foreign):
            own = any(s == target and ch not in _SURE for ch, s in zip(word, scripts, strict=True))
            sure = all(ch in _SURE for ch in foreign)
            rank = (sure, own, target == near, counts[target])
            if best is None or rank > best[0]:
                best = (rank, target)
    target = best[1] if best else max("LCG", key=lambda s: counts[s])
    twin = _twins()[target]
    return "".join(ch if not s or s == target else twin.get(ch, ch) for ch, s in zip(word, scripts, strict=True))


def _unmix(text: str) -> str:
    """Brings every mixed word to one script; where both would do, the nearest word of one script decides."""
    found = list(_word.finditer(text))
    mixed = [i for i, m in enumerate(found) if not m.group().isascii() and _mixes(m.group())]

    def pure(i: int) -> str:
        kinds = {_script(ch) for ch in found[i].group()} & set("LCG")
        return kinds.pop() if len(kinds) == 1 and len(found[i].group()) > 1 else ""

    out, at = [], 0
    for i in mixed:
        near = next((k for j in (*range(i - 1, max(-1, i - 6), -1), *range(i + 1, min(len(found), i + 6))) if (k := pure(j))), "")
        m = found[i]
        out += [text[at : m.start()], _one_script(m.group(), near)]
        at = m.end()
    return "".join([*out, text[at:]])


def plain(text: str | None) -> str | None:
    """The plain form of one text."""
    if text is None or text.isascii():
        return text
    while True:
        chars = set(text)  # the quick check: most texts end here
        if not chars.isdisjoint(unstable_points()):
            text = _segments().sub(_segment, text)
            chars = set(text)
        if chars.isdisjoint(_letters_elsewhere()) or not _mixed.search(text):
            return text
        before, text = text, _unmix(text)
        if text == before or set(text).isdisjoint(unstable_points()):
            return text  # else a letter that was replaced may join the mark after it


def is_plain(text: str | None) -> bool:
    """Whether a text holds none of the characters that problem 1 asks for."""
    if text is None or text.isascii():
        return True
    chars = set(text)
    if not chars.isdisjoint(unstable_points()) and _segments().sub(_segment, text) != text:
        return False
    return chars.isdisjoint(_letters_elsewhere()) or not _mixed.search(text)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the plain form, lower-cased; none for null."""
    if not text:
        return []
    return _word.findall(plain(text).lower())


def hash_words(flat: list[str]):
    """64-bit hashes of words, the same in every process."""
    import numpy as np

    if not flat:
        return np.empty(0, np.uint64)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(unique, categorize=False)[codes]
