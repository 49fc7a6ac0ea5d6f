"""Reading texts that write words with digits, signs and pictures.

A text is a lattice: each token has readings, each with a probability and a kind. The search keeps the ``BEAM`` best
partial readings after every token; what comes out is scored on words, sound, context, symbols and language.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import arrow
from quillmesh.functions.normalize import fold_text
from quillmesh.functions.many import sounds_many
from quillmesh.functions.sounds import letters_of, sound_confidence, sound_similarity, sounds_of
from quillmesh.functions.tokens import segment_text
from quillmesh.sources.packs import Lexicon

BEAM, KEPT, LONGEST_SPLIT = 20, 10, 4
# Weights of the parts of a reading's score, and what each kind of step costs.
WEIGHTS = {"lexical": 0.36, "phonetic": 0.22, "context": 0.12, "symbol": 0.18, "language": 0.12}
COSTS = {"identity": 0.0, "boundary": 0.03, "leet": 0.05, "symbol": 0.10, "abbreviation": 0.08}
COST_CAP, FREQUENCY_SCALE, FREQUENCY_CAP = 0.35, 5.0, 0.25
SWITCH, BOUNDARY, DIGIT_IN_WORD = 0.98, {"join": 0.97, "space": 0.97, "both": 0.94}, 0.5
FLOOR, ABSTAIN_SCORE, ABSTAIN_GAP, STRONG_GAP = 0.08, 0.4, 0.02, 0.15
_LEET, _LEET_SIGNS = str.maketrans(T.LEET_FROM, T.LEET_TO), frozenset(T.LEET_FROM)


def readings(piece: str, kind: str, lexicon: Lexicon, most: int = 8) -> list[tuple[str, float, str, str]]:
    """(text, probability, step, language) of one token, its plain self among them."""
    out = [(piece, 1.0, "identity", "und")]
    if kind in ("emoji", "symbol", "number", "unknown"):
        out += [(t, p, "symbol", lang) for t, lang, p in lexicon.symbols.get(piece.replace("️", ""), [])[:most]]
    if not _LEET_SIGNS.isdisjoint(piece) and any(map(str.isalpha, piece)):
        out.append((piece.lower().translate(_LEET), 0.85, "leet", "und"))
    out += [(t, p, "abbreviation", lang) for t, lang, p in lexicon.abbreviations.get(piece.lower(), [])[:most]]
    return out


def plausibility(text: str, lexicon: Lexicon) -> float:
    """How well a reading is made of known words."""
    folded = text.lower()
    tight = "".join(folded.split())
    if not tight:
        return 0.0

    def parts(s: str, depth: int) -> bool:
        return depth <= LONGEST_SPLIT and any(lexicon.contains(s[:i]) and (lexicon.contains(s[i:]) or parts(s[i:], depth + 1)) for i in range(2, len(s) - 1))

    if lexicon.contains(tight) or len(tight) <= 24 and parts(tight, 0):
        return 1.0
    found = folded.split()
    known = sum(map(lexicon.all_words.__contains__, found))
    if known:
        return 0.4 + 0.6 * known / len(found)
    return 0.55 if lexicon.starts(tight) else 0.15


def _without_sound(text: str, prior: float, steps: list[str], languages: list[str], lexicon: Lexicon) -> tuple[float, float]:
    """The weighted parts of a reading's score but the phonetic one, and what its steps leave of the whole."""
    lexical = min(1.0, plausibility(text, lexicon) + min(FREQUENCY_CAP, math.log1p(lexicon.frequency(text)) / FREQUENCY_SCALE))
    edge = 1.0 if lexicon.contains(text) else 0.65 if lexicon.starts(text) else 0.35
    known = [x for x in languages if x != "und"]
    parts = {"lexical": lexical, "context": 0.55 * lexical + 0.45 * edge, "symbol": min(1.0, prior), "language": 1.0 if len(set(known)) == 1 else 0.7}
    return sum(WEIGHTS[k] * v for k, v in parts.items()), 1 - min(COST_CAP, sum(COSTS[s] for s in steps))


def _whole(parts: tuple[float, float], phonetic: float) -> float:
    return max(0.0, min(1.0, (parts[0] + WEIGHTS["phonetic"] * phonetic) / sum(WEIGHTS.values()) * parts[1]))


def _phonetic(text: str, source: str, sounds: list[str]) -> float:
    own = sounds if text == source else sounds_of(text)
    return sound_similarity(own, sound_confidence(text, own), sounds, sound_confidence(source, sounds)) if own and sounds else 0.5


def score(text: str, source: str, prior: float, steps: list[str], languages: list[str], lexicon: Lexicon, sounds: list[str] | None = None) -> float:
    """``sounds`` are those of the source, where they are known."""
    return _whole(_without_sound(text, prior, steps, languages, lexicon), _phonetic(text, source, sounds_of(source) if sounds is None else sounds))


@dataclass(frozen=True)
class Search:
    """How far the search for readings goes."""

    beam: int = BEAM
    kept: int = KEPT
    segments: int = T.SEGMENTS
    readings: int = 8
    strong_gap: float = STRONG_GAP


def _beam(text: str, lexicon: Lexicon, search: Search, pieces: list[tuple[str, int, int, str]] | None = None) -> list[tuple[float, str, tuple[str, ...], tuple[str, ...]]]:
    """The readings that the search ends with: probability, text, steps but those that leave a token as it is, languages that
    are known. ``pieces`` are the text's segments, where they are known."""
    pieces = segment_text(text, search.segments) if pieces is None else pieces
    offsets = text.encode()
    beam: list[tuple[float, str, tuple[str, ...], tuple[str, ...]]] = [(1.0, "", (), ())]
    last, tail = 0, ""  # what all readings have behind them
    for n, (piece, start, end, kind) in enumerate(pieces):
        gap = offsets[last:start].decode(errors="ignore")
        apart = bool(gap)
        last = end
        own = readings(piece, kind, lexicon, search.readings)
        if len(own) == 1:  # it can only be read as it is: the order of the beam stays
            tail += gap + piece if n else piece
            continue
        grown: dict[str, tuple[float, str, tuple[str, ...], tuple[str, ...]]] = {}
        for p, done, steps, langs in beam:
            done += tail
            for t, q, step, lang in own:
                w = p * q
                if kind == "number" and step == "symbol" and not apart and done[-1:].isalpha():
                    w *= DIGIT_IN_WORD
                if lang != "und" and any(x != lang for x in langs):
                    w *= SWITCH
                forms = [(gap, w, ())] if done else [("", w, ())]
                if done and step != "identity":
                    forms.append(("", w * BOUNDARY["join"], ("boundary",)) if apart else (" ", w * BOUNDARY["space"], ("boundary",)))
                for between, v, extra in forms:
                    new = done + between + t
                    if new not in grown or grown[new][0] < v:
                        grown[new] = (v, new, steps if step == "identity" else (*steps, step, *extra), langs if lang == "und" else (*langs, lang))
        beam, tail = sorted(grown.values(), key=_falling)[: search.beam], ""
    return [(p, done + tail, steps, langs) for p, done, steps, langs in beam]


def _falling(reading: tuple) -> float:
    return -reading[0]


def _alone(text: str, value: float, search: Search) -> list[dict]:
    """The one reading of a text that can't be read in another way."""
    return [{"text": text, "score": value, "steps": [], "changed": False, "gap": value, "strong": value >= search.strong_gap, "confidence": value * (0.5 + 0.5 * value)}]


def _nodes(beam: list[tuple[float, str, tuple[str, ...], tuple[str, ...]]], lexicon: Lexicon) -> list[tuple[float, str, list[str], tuple[float, float]]]:
    """Readings with what they can score at most, best first; what their sounds add is still open."""
    nodes = []
    for p, done, steps, langs in beam:
        parts = _without_sound(done, p, list(steps), list(langs), lexicon)
        nodes.append((_whole(parts, 1.0), done, list(steps), parts))
    return sorted(nodes, key=lambda x: -x[0])


def _add(best: dict[str, dict], done: str, steps: list[str], value: float, whole_key: str) -> None:
    key = fold_text(done)
    if value >= FLOOR and (key not in best or best[key]["score"] < value):
        best[key] = {"text": done, "score": value, "steps": steps, "changed": key != whole_key}


def _out(most: float, best: dict[str, dict], search: Search) -> bool:
    """Whether a reading that can score ``most`` can't be among those that are kept."""
    return len(best) >= max(2, search.kept) and most < sorted((x["score"] for x in best.values()), reverse=True)[max(2, search.kept) - 1]


def decode_text(text: str | None, lexicon: Lexicon, search: Search = Search()) -> list[dict]:
    """The best readings with their scores, gaps to the next, and steps; none where nothing speaks for any."""
    if not text:
        return []
    beam, sounds = _beam(text, lexicon, search), sounds_of(text)
    if len(beam) == 1:
        return _alone(beam[0][1], score(beam[0][1], text, 1.0, [], [], lexicon, sounds), search)
    best: dict[str, dict] = {}
    whole_key = fold_text(text)
    # the sounds of a reading are only compared where it can still be among those that are kept
    for most, done, own_steps, parts in _nodes(beam, lexicon):
        if _out(most, best, search):
            break
        _add(best, done, own_steps, _whole(parts, _phonetic(done, text, sounds)), whole_key)
    return _kept(best, search)


def decode_texts(texts: list[str | None], lexicon: Lexicon, search: Search = Search(), pieces: list[list[tuple[str, int, int, str]]] | None = None) -> list[list[dict]]:
    """:func:`decode_text` of each text; the sounds of all their readings are compared at once. ``pieces`` are the segments of
    the texts, where they are known."""
    out: list[list[dict]] = [[] for _ in texts]
    alone, open_ = [], []
    for i, text in enumerate(texts):
        if text:
            beam = _beam(text, lexicon, search, pieces and pieces[i])
            if len(beam) == 1:
                alone.append((i, beam[0][1], _without_sound(beam[0][1], 1.0, [], [], lexicon)))
            else:
                open_.append((i, _nodes(beam, lexicon), {}, fold_text(text)))
    spoken: dict[str, tuple[str, float]] = {}

    def sound(text: str) -> tuple[str, float]:
        if text not in spoken:
            letters = letters_of(text)
            spoken[text] = letters, sound_confidence(text, letters)
        return spoken[text]

    def phonetic(asked: list[tuple[str, str]]) -> list[float]:
        both = [(*sound(done), *sound(text)) for done, text in asked]
        return [value if x[0] and x[2] else 0.5 for x, value in zip(both, sounds_many(both), strict=True)]

    for (i, done, parts), value in zip(alone, phonetic([(done, texts[i]) for i, done, _ in alone]), strict=True):
        out[i] = _alone(done, _whole(parts, value), search)
    # as many readings as are kept first, then those that can still be among them
    for first, last in ((0, max(2, search.kept)), (max(2, search.kept), None)):
        asked = [(i, best, key, node) for i, nodes, best, key in open_ for node in nodes[first:last] if not first or not _out(node[0], best, search)]
        for (_, best, key, (_, done, steps, parts)), value in zip(asked, phonetic([(node[1], texts[i]) for i, _, _, node in asked]), strict=True):
            _add(best, done, steps, _whole(parts, value), key)
    for i, _, best, _ in open_:
        out[i] = _kept(best, search)
    return out


def _kept(best: dict[str, dict], search: Search) -> list[dict]:
    """The best of the readings that were scored, with their gaps and confidences."""
    found = sorted(best.values(), key=lambda x: (-x["score"], x["text"]))[: search.kept]
    if len(found) > 1 and found[0]["score"] < ABSTAIN_SCORE and found[0]["score"] - found[1]["score"] < ABSTAIN_GAP:
        return []
    for i, f in enumerate(found):
        gap = f["score"] - found[i + 1]["score"] if i == 0 and len(found) > 1 else f["score"] if i == 0 else 0.0
        f["gap"], f["strong"] = gap, gap >= search.strong_gap
        f["confidence"] = f["score"] * (0.5 + 0.5 * gap)
    return found


def decode(c: Column, lexicon: Lexicon, search: Search = Search()) -> Column:
    """Readings of a text column; the lexicon travels with the function."""
    sent = pickle.dumps(lexicon)
    held: list[Lexicon] = []

    def run(s: pd.Series) -> pd.Series:
        if not held:
            held.append(pickle.loads(sent))
        return s.map(lambda t: decode_text(t, held[0], search))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return arrow("array<struct<text:string,score:double,steps:array<string>,changed:boolean,gap:double,strong:boolean,confidence:double>>")(run)(c)

