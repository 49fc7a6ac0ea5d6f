"""Sounds of words by rule, their distances, and transcription between scripts."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import tables as T
from quillmesh.functions import transcribe
from quillmesh.functions.distance import levenshtein_text, ngrams_of_codes
from quillmesh.functions.lazy import arrow
from quillmesh.functions.normalize import fold_text

_SOUND = {ch: sound for sound, chs in T.VOWEL_SOUNDS.items() for ch in chs} | T.LETTER_SOUNDS
_VOWELS = "aeiouəɛɪɔʊ"


@lru_cache(16)
def _rules(language: str) -> tuple[re.Pattern, dict[str, str], frozenset[str]]:
    """Pairs, letters before e or i, then letters, as one pattern in order of precedence; the letters before e or i."""
    sounds, before = dict(_SOUND), {}
    if language == "es":
        sounds |= dict.fromkeys(T.VOWEL_SOUNDS["ɪ"], "i") | {"h": "", "j": "x"}
        before = {"c": "s", "g": "x"}
    if language == "tr":
        sounds["ç"] = "tʃ"
    pairs = dict(T.PAIR_SOUNDS) | ({"ll": "ʝ"} if language == "es" else {})
    table = {**pairs, **{f"{k}\0": v for k, v in before.items()}, **sounds}
    order = [*pairs, "gu(?=[ei])", *(f"{k}(?=[ei])" for k in before), "."]
    return re.compile("|".join(order), re.DOTALL), table, frozenset(before)


def sounds_of(text: str | None, language: str = "und") -> list[str]:
    """The sounds of a text's words."""
    if not text:
        return []
    return [x for word in re.findall(r"[^\W\d_]+", fold_text(text)) for x in _word_sounds(word, language)]


_LETTER: dict[str, str] = {}


def as_letters(found: tuple[str, ...] | list[str]) -> str:
    """Sounds as one character each, the same ones as long as the process lives."""
    for s in found:
        if s not in _LETTER:
            _LETTER[s] = chr(33 + len(_LETTER))
    return "".join(map(_LETTER.__getitem__, found))


def from_letters(letters: str) -> list[str]:
    names = list(_LETTER)
    return [names[ord(c) - 33] for c in letters]


@lru_cache(200_000)
def _token_letters(token: str) -> str:
    return as_letters(sounds_of(token))


def letters_of(text: str | None) -> str:
    """:func:`sounds_of` as in :func:`as_letters`. No word goes over a space, so what stands between two is looked up."""
    return "".join([_token_letters(t) if len(t) <= 64 else as_letters(sounds_of(t)) for t in text.split(" ")]) if text else ""


@lru_cache(200_000)
def _word_sounds(word: str, language: str) -> tuple[str, ...]:
    """The sounds of one folded word; words come again and again."""
    pattern, table, before = _rules(language)
    out = []
    for m in pattern.finditer(word):
        piece = m.group()
        if piece == "gu":
            sound = "g"
        elif piece in before and word[m.end() : m.end() + 1] in ("e", "i"):
            sound = table[piece + "\0"]
        else:
            sound = table.get(piece, "")
        if sound:
            out.append(sound)
    return tuple(out)


@lru_cache(1)
def _letter_kinds() -> tuple:
    """Patterns of Latin letters and of all others."""
    import regex

    return regex.compile(r"\p{Latin}"), regex.compile(r"[\p{Alphabetic}--\p{Latin}]", regex.V1)


def sound_confidence(text: str, sounds: list[str]) -> float:
    if not sounds:
        return 0.0
    latin, other = _letter_kinds()
    latin, other = bool(latin.search(text)), not text.isascii() and bool(other.search(text))
    return 0.65 if latin and not other else 0.35 if latin else 0.15


def parse_ipa(ipa: str) -> list[str]:
    """IPA as single sounds, the long ones first; marks of stress and length are left out."""
    return re.findall("|".join([*T.IPA_LONG, f"[^{re.escape(T.IPA_SKIPPED)}̀-ͯ˞-˿᪰-᫿]"]), ipa)


def _class(sound: str) -> tuple:
    """Vowel: height, backness, rounding. Consonant: place, manner, voice."""
    first = sound[:1]
    if any(ch in "aeiouəɛɪɔʊɑɒɨʉɯyøœ" for ch in sound):
        vowel = {"i": (3, 0, False), "ɪ": (2, 0, False), "e": (2, 0, False), "ɛ": (1, 0, False), "æ": (1, 0, False), "a": (0, 1, False), "ɑ": (0, 2, False), "o": (2, 2, True), "ɔ": (2, 2, True), "u": (3, 2, True), "ʊ": (3, 2, True), "y": (2, 1, True), "ø": (2, 1, True), "œ": (2, 1, True)}
        return ("vowel", *vowel.get(first, (1, 1, False)))
    places = {"bilabial": "pbm", "labiodental": "fv", "dental": "θð", "postalveolar": "ʃʒ", "alveolar": "tdsznlɾr", "palatal": "jʝɲ", "velar": "kgx", "glottal": "h"}
    manners = {"stop": "pbtdkg", "fricative": "fvszʃʒxh", "nasal": "mnɲ", "liquid": "lrɾ", "glide": "jw"}
    place = next((p for p, chs in places.items() if first and first in chs), "other")
    manner = next((m for m, chs in manners.items() if first and first in chs), "other")
    if first in ("t", "d") and ("ʃ" in sound or "ʒ" in sound):
        manner = "affricate"
        place = "postalveolar" if sound[1:2] in ("ʃ", "ʒ") else place
    return ("consonant", place, manner, any(ch in "bdgvzʒɡmnrlɲʝj" for ch in sound))


def sound_label(sound: str) -> str:
    c = _class(sound)
    if c[0] == "vowel":
        return "vowel:rounded" if c[3] else "vowel:unrounded"
    if (c[2], c[1]) in (("stop", "bilabial"), ("stop", "alveolar"), ("fricative", "alveolar")):
        return f"consonant:{c[2]}:{c[1]}"
    return f"consonant:{c[2]}" if c[2] in ("nasal", "liquid", "glide") else "consonant:other"


@lru_cache(65536)
def sound_distance(a: str, b: str) -> float:
    """0 for the same sound, 1 for a vowel and a consonant, else by their features."""
    if a == b:
        return 0.0
    x, y = _class(a), _class(b)
    if x[0] != y[0]:
        return 1.0
    if x[0] == "vowel":
        return 0.45 * abs(x[1] - y[1]) / 3 + 0.40 * abs(x[2] - y[2]) / 2 + 0.15 * (x[3] != y[3])
    return 0.35 * (x[1] != y[1]) + 0.35 * (x[2] != y[2]) + 0.30 * (x[3] != y[3])


def _distances(a: list[str], b: list[str]) -> tuple[float, int]:
    """Edit distance by features and by equality. A row is worked out at once: insertions are a running minimum.

    What both begin or end with costs nothing in some best alignment, so only what lies between is worked out.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return float(len(a) + len(b)), len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a  # both distances are the same either way, and the shorter side gives the rows
    kinds = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    names = list(kinds)
    cost = np.array([[sound_distance(x, y) for y in names] for x in names])
    x, y = [kinds[s] for s in a], np.array([kinds[s] for s in b])
    table, step = cost[:, y], np.arange(len(b) + 1, dtype=float)
    row, new = step.copy(), np.empty(len(b) + 1)
    for i, k in enumerate(x, 1):
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + table[k], out=new[1:])
        np.subtract(new, step, out=new)
        np.minimum.accumulate(new, out=row)
        row += step
    plain = levenshtein_text("".join(chr(33 + kinds[s]) for s in a), "".join(chr(33 + kinds[s]) for s in b))
    return float(row[-1]), plain


def sound_ngrams(a: list[str], b: list[str], n: int) -> float:
    if a == b:
        return 1.0
    if len(a) + len(b) > 200:
        kinds = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
        return ngrams_of_codes(*(np.fromiter((kinds[s] for s in x), np.uint64, len(x)) for x in (a, b)), n)
    x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def sound_similarity(a: list[str], ca: float, b: list[str], cb: float) -> float:
    if not a or not b:
        return 0.0
    longest = max(len(a), len(b))
    weighted, plain = (0.0, 0) if a == b else _distances(a, b)
    by_feature, exact = 1 - weighted / longest, 1 - plain / longest
    grams = (sound_ngrams(a, b, 2) + sound_ngrams(a, b, 3)) / 2
    return max(0.0, min(1.0, 0.45 * by_feature + 0.25 * exact + 0.20 * grams + 0.10 * min(ca, cb)))


def syllables(sounds: list[str]) -> int:
    return sum(any(ch in _VOWELS for ch in s) for s in sounds)


@arrow("ipa string, phonemes array<string>, syllables int, articulatory_features array<string>, confidence double")
def phonemize(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = []
    for t, lang in zip(text, language, strict=True):
        found = sounds_of(t, lang or "und")
        rows.append(("".join(found) or None, found, syllables(found), [sound_label(s) for s in found], sound_confidence(t or "", found)))
    return pd.DataFrame(rows, columns=["ipa", "phonemes", "syllables", "articulatory_features", "confidence"])


@arrow("double")
def phonetic_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = sounds_of(x), sounds_of(y)
        out.append(sound_similarity(p, sound_confidence(x or "", p), q, sound_confidence(y or "", q)))
    return pd.Series(out)


# ------------------------------------------------------------------------------------------------ transcription

_CYRILLIC = str.maketrans({**dict(zip(T.CYRILLIC_FROM + T.CYRILLIC_FROM.upper(), T.CYRILLIC_TO + T.CYRILLIC_TO.upper(), strict=True)), **T.CYRILLIC_LONG, **{k.upper(): v.capitalize() for k, v in T.CYRILLIC_LONG.items()}})
_ARABIC = str.maketrans({**T.ARABIC, **{chr(p): "" for p in range(0x64B, 0x653)}})


def latin_view(text: str) -> str | None:
    """A Cyrillic or Arabic text in Latin letters; None for others."""
    if re.search("[\u0400-\u052f]", text):
        return text.translate(_CYRILLIC)
    if re.search("[\u0600-\u06ff]", text):
        return text.translate(_ARABIC)
    return transcribe.other_views(text).get("Latn")


def cyrillic_to_latin(c: Column) -> Column:
    """Letter by letter, with letters that give several replaced first; case is kept by letter."""
    for ch, out in T.CYRILLIC_LONG.items():
        c = F.replace(F.replace(c, F.lit(ch), F.lit(out)), F.lit(ch.upper()), F.lit(out.capitalize()))
    return F.translate(c, T.CYRILLIC_FROM + T.CYRILLIC_FROM.upper(), T.CYRILLIC_TO + T.CYRILLIC_TO.upper())


def latin_to_cyrillic(c: Column) -> Column:
    """Groups of letters first, the longest before the others."""
    for group, out in {**T.LATIN_DIGRAPHS, "x": "кс"}.items():
        c = F.replace(F.replace(F.replace(c, F.lit(group), F.lit(out)), F.lit(group.capitalize()), F.lit(out.capitalize())), F.lit(group.upper()), F.lit(out.upper()))
    return F.translate(c, T.LATIN_SINGLE_FROM + T.LATIN_SINGLE_FROM.upper(), T.LATIN_SINGLE_TO + T.LATIN_SINGLE_TO.upper())


def arabic_to_latin(c: Column) -> Column:
    c = F.regexp_replace(c, "[ً-ْ]", "")
    for ch, out in T.ARABIC.items():
        if len(out) > 1:
            c = F.replace(c, F.lit(ch), F.lit(out))
    single = {k: v for k, v in T.ARABIC.items() if len(v) == 1}
    return F.translate(c, "".join(single), "".join(single.values()))


def latin_heavy(c: Column) -> Column:
    latin, all_ = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit(r"\p{IsAlphabetic}"))
    return (latin >= 2) & (latin * 2 >= all_)


def drop_vowels(c: Column) -> Column:
    return F.translate(c, "aeiouy", "")


def consonantal(c: Column) -> Column:
    return ~c.rlike("[aeiou]")


def views(c: Column) -> Column:
    """One transcription for each script that a text can be written in besides its own. Scripts of syllables take precedence."""
    own = F.when(transcribe.needed(c), transcribe.syllabic_views(c)).otherwise(F.create_map().cast("map<string,string>"))
    letters = F.map_filter(
        F.create_map(
            F.lit("Latn"), F.when(c.rlike(transcribe.SYLLABIC), None).when(c.rlike(r"[\x{400}-\x{52f}]"), cyrillic_to_latin(c)).when(c.rlike(r"[\x{600}-\x{6ff}]"), arabic_to_latin(c)),
            F.lit("Cyrl"), F.when(latin_heavy(c), latin_to_cyrillic(c)),
        ),
        lambda k, v: v.isNotNull() & (v != c),
    )
    return F.map_concat(letters, own)
