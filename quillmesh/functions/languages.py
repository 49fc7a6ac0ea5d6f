"""The language of a text by its known words, by its scripts, and by how much of a script without blanks a lexicon covers."""

from __future__ import annotations

import math
import re

from quillmesh.sources.packs import Lexicon

# Languages that a script hints at, and how strongly; how much a hint counts beside known words, and what unknown
# words and texts without words give to none.
SCRIPT_HINTS = {
    "Arabic": {"ar": 0.60, "fa": 0.25, "ur": 0.15},
    "Cyrillic": {"ru": 0.55, "uk": 0.20, "bg": 0.15, "sr": 0.10},
    "Devanagari": {"hi": 0.85, "mr": 0.15},
    "Han": {"zh": 0.60, "ja": 0.40},
    "Hiragana": {"ja": 1.0},
    "Katakana": {"ja": 1.0},
    "Hangul": {"ko": 1.0},
    "Hebrew": {"he": 1.0},
    "Thai": {"th": 1.0},
}
HINT_BESIDE_WORDS, UNKNOWN, WORDLESS, LEAST_WEIGHT = 0.15, 0.35, 0.15, 0.01
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[㐀-䶿一-鿿぀-ヿ가-힯]")


def script_hints(scripts: frozenset[str] | list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for script in sorted(scripts):
        for lang, p in SCRIPT_HINTS.get(script, {}).items():
            out[lang] = out.get(lang, 0.0) + p
    return out


def detect_text(text: str, scripts: frozenset[str], lexicon: Lexicon, most: int = 8) -> list[tuple[str, float]]:
    """Languages with their shares, best first; ``unknown`` is one of them."""
    words, hints = _WORD.findall(text.lower()), script_hints(scripts)
    if not words:
        scores = {**hints, "unknown": WORDLESS} if hints else {"unknown": 1.0}
    else:
        scores, matched = {}, 0
        for w in words:
            own = lexicon.languages_of(w)
            matched += bool(own)
            for lang in own:
                scores[lang] = scores.get(lang, 0.0) + 1 + math.log1p(max(LEAST_WEIGHT, lexicon.words[lang][w][0]))
        for lang, p in hints.items():
            scores[lang] = scores.get(lang, 0.0) + p * (HINT_BESIDE_WORDS if matched else 1.0)
        if not scores:
            scores = {"unknown": 1.0}
        elif matched < len(words):
            scores["unknown"] = UNKNOWN * (1 - matched / len(words))
    total = sum(scores.values())
    return sorted(((lang, s / total) for lang, s in scores.items()), key=lambda x: (-x[1], x[0]))[:most]


def cjk_coverage(text: str, words: set[str]) -> float:
    """The share of a text's Han, kana and Hangul characters that stand in a known word of such characters."""
    query = "".join(_CJK.findall(text))
    covered = [False] * len(query)
    for word in words:
        if word and len(_CJK.findall(word)) == len(word):
            at = query.find(word)
            while at >= 0:
                covered[at : at + len(word)] = [True] * len(word)
                at = query.find(word, at + 1)
    return sum(covered) / len(query) if query else 0.0
