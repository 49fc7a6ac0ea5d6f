"""Evidence of pairs of messages: all channels, and the features between them that the trained scorer weighs.

Each text is read once (:class:`Side`), whatever number of pairs it stands in within a task; a feature that has no evidence is
0, a channel without evidence is missing.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmesh.functions import tables as T
from quillmesh.functions.distance import character_bound, character_folded, character_text
from quillmesh.functions.entities import entities_text
from quillmesh.functions.languages import detect_text
from quillmesh.functions.normalize import fold_text, strip_marks_text
from quillmesh.functions.points import BIT, class_table
from quillmesh.functions.many import character_bounds, character_counts, character_many, sounds_many
from quillmesh.functions.rebus import Search, decode_text, decode_texts
from quillmesh.functions.sounds import latin_view, letters_of, sound_confidence, sound_similarity, sounds_of
from quillmesh.functions.tokens import feature_hash_texts, lemma_text, segment_text
from quillmesh.runtime import map_batches
from quillmesh.sources.packs import Lexicon


def _tight(text: str) -> str:
    return "".join(fold_text(text).split())


def graded(text: str, lexicon: Lexicon, search: Search = Search()) -> dict[str, float]:
    """Folded forms of a text and of its readings, each with its confidence over its rank."""
    return _graded(text, decode_text(text, lexicon, search))


def _graded(text: str, found: list[dict]) -> dict[str, float]:
    out = {_tight(text): 1.0}
    for rank, r in enumerate(found):
        key = _tight(r["text"])
        out[key] = max(out.get(key, 0.0), r["confidence"] / (rank + 1))
    return out


def exact_decode(x: dict[str, float], y: dict[str, float]) -> float:
    """The best confidence of a form that two texts (as :func:`graded`) can both be read as."""
    return max((min(x[k], y[k]) for k in x.keys() & y.keys()), default=0.0)


def decoded_overlap(x: dict[str, float], y: dict[str, float]) -> float:
    """The closest pair of readings of two texts (as :func:`graded`), damped by rank. Pairs that can't come closer than the best
    so far, by their rank or by the characters they share, are not compared."""
    if x.keys() & y.keys() and next(iter(x)) == next(iter(y)):
        return 1.0
    best = 0.0
    sides = [[(strip_marks_text(k), Counter(strip_marks_text(k))) for k in side] for side in (x, y)]
    pairs = sorted((max(i, j), i, j) for i in range(len(x)) for j in range(len(y)))
    for rank, i, j in pairs:
        damp = 1 / (1 + 0.05 * rank)
        if damp <= best:
            break
        (p, cp), (q, cq) = sides[0][i], sides[1][j]
        if p == q:
            best = damp
        elif abs(len(p) - len(q)) <= max(len(p), len(q)) / 2 and damp * character_bound(cp, cq) > best:
            best = max(best, damp * character_folded(p, q)["combined"])
    return best


#: Readings of a pair that are compared in each round of :func:`decoded_overlaps`, but the last, which takes the rest; pairs whose
#: characters are counted at once, and rounding that a bound may be off by.
ROUNDS, COUNTED, OFF = (1,), 128, 1e-9


def decoded_overlaps(pairs: list[tuple[dict[str, float], dict[str, float]]]) -> list[float]:
    """:func:`decoded_overlap` of each pair, in rounds: the texts themselves, then those readings that can come closest."""
    best = np.array([1.0 if next(iter(x)) == next(iter(y)) else 0.0 for x, y in pairs])
    bare = {k: strip_marks_text(k) for pair in pairs for side in pair for k in side}
    at = np.flatnonzero(best < 1).tolist()
    known: dict[tuple[str, str], float] = {}
    open_: list[np.ndarray] = []
    for start in range(0, len(at), COUNTED):
        part = at[start : start + COUNTED]
        texts = list(dict.fromkeys(bare[k] for n in part for side in pairs[n] for k in side))
        number = {t: i for i, t in enumerate(texts)}
        single, two, three, lengths = character_counts(texts)
        rows = []
        for n in part:
            x, y = (np.array([number[bare[k]] for k in side]) for side in pairs[n])
            i, j = np.divmod(np.arange(len(x) * len(y)), len(y))
            rows.append((np.full(len(i), n), x[i], y[j], 1 / (1 + 0.05 * np.maximum(i, j))))
        n, x, y, damp = (np.concatenate(c) for c in zip(*rows, strict=True))
        np.maximum.at(best, n[x == y], damp[x == y])

        def left(n, x, y, damp, bound):
            on = damp * bound + OFF > best[n]
            return n[on], x[on], y[on], damp[on], bound[on]

        def shared(counts, x, y):
            return np.concatenate([np.zeros(0, np.int64), *(np.minimum(counts[x[k : k + 2_048]], counts[y[k : k + 2_048]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 2_048))])

        on = (x != y) & (np.abs(lengths[x] - lengths[y]) <= np.maximum(lengths[x], lengths[y]) / 2) & (damp > best[n])
        n, x, y, damp = n[on], x[on], y[on], damp[on]
        one = shared(single, x, y)
        n, x, y, damp, bound = left(n, x, y, damp, character_bounds(one, lengths[x], lengths[y]))
        open_.append((texts, n, x, y, damp, bound, single, two, three, lengths, left, shared))
    for turn, size in enumerate((*ROUNDS, None)):
        asked, new = [], {}
        for k, (texts, n, x, y, damp, bound, single, two, three, lengths, left, shared) in enumerate(open_):
            n, x, y, damp, bound = left(n, x, y, damp, bound)
            if turn == 1:  # the closest of the texts themselves is known, most else falls by their pairs of neighbours
                bound = character_bounds(shared(single, x, y), lengths[x], lengths[y], shared(two, x, y), shared(three, x, y))
                n, x, y, damp, bound = left(n, x, y, damp, bound)
            order = np.lexsort((-(damp if turn == 0 else damp * bound), n))
            n, x, y, damp, bound = n[order], x[order], y[order], damp[order], bound[order]
            first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, np.int64)
            nth = np.arange(len(n)) - np.repeat(first, np.diff([*first, len(n)]))
            now = nth < (len(n) if size is None else size)
            asked += [(i, (texts[p], texts[q]), d) for i, p, q, d in zip(n[now].tolist(), x[now].tolist(), y[now].tolist(), damp[now].tolist(), strict=True)]
            open_[k] = (texts, n[~now], x[~now], y[~now], damp[~now], bound[~now], single, two, three, lengths, left, shared)
        new = list(dict.fromkeys(pair for _, pair, _ in asked if pair not in known))
        known.update(zip(new, character_many(new), strict=True))
        for i, pair, d in asked:
            best[i] = max(best[i], d * known[pair])
    return best.tolist()


def swapped(a: list[str], b: list[str]) -> tuple[int, str, str] | None:
    """The one place at which two word lists differ, where they differ at just one; one list may have a word more."""
    a, b = [fold_text(w) for w in a], [fold_text(w) for w in b]
    if min(len(a), len(b)) < 2 or abs(len(a) - len(b)) > 1:
        return None

    def only(x: list[str], y: list[str]) -> int | None:
        at = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q]
        return at[0] if len(at) == 1 else None

    if len(a) == len(b):
        at = only(a, b)
        return None if at is None else (at, a[at], b[at])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    for skip in range(len(long)):
        rest = long[:skip] + long[skip + 1 :]
        at = only(rest, short)
        if at is not None:
            pair = (rest[at], short[at]) if long is a else (short[at], rest[at])
            return (at + (at >= skip), *pair)
        if rest == short:
            return None
    return None


class Compared:
    """Similarities of folded texts and of sounds that were worked out at once; any other is worked out when it is asked for."""

    def __init__(self, pairs: list[tuple[Side, Side]] = ()):
        asked = {}
        for a, b in pairs:
            asked[a.bare, b.bare] = None
            if a.looks != a.bare or b.looks != b.bare:
                asked[a.looks, b.looks] = None
            if a.even != a.bare or b.even != b.bare:
                asked[a.even, b.even] = None
            if a.signs or b.signs:
                asked[a.tight_bare, b.tight_bare] = None
        self.characters = dict(zip(asked, character_many(list(asked)), strict=True))
        found = sounds_many([(*a.sounds, *b.sounds) for a, b in pairs])
        self.sounds = {(a.text, b.text): value for (a, b), value in zip(pairs, found, strict=True)}
        overlaps = decoded_overlaps([(a.graded, b.graded) for a, b in pairs])
        self.decoded = {(a.text, b.text): value for (a, b), value in zip(pairs, overlaps, strict=True)}

    def character(self, p: str, q: str) -> float:
        return self.characters[p, q] if (p, q) in self.characters else character_folded(p, q)["combined"]

    def sound(self, a: Side, b: Side) -> float:
        return self.sounds[a.text, b.text] if (a.text, b.text) in self.sounds else sounds_many([(*a.sounds, *b.sounds)])[0]

    def overlap(self, a: Side, b: Side) -> float:
        return self.decoded[a.text, b.text] if (a.text, b.text) in self.decoded else decoded_overlap(a.graded, b.graded)


def symbolic(a: Side, b: Side, compared: Compared) -> float | None:
    """How well the readings of one text's symbols fit the other text; None where neither has symbols."""
    if not a.signs and not b.signs:
        return None
    ra, rb = a.signs, b.signs
    best = 0.55 * compared.character(a.tight_bare, b.tight_bare)
    for own, other in ((ra, b), (rb, a)):
        best = max([best, *(p for t, p in own.items() if t in other.folded_words)])
    for x in ra:
        for y in rb:
            best = max(best, character_text(x, y)["combined"]) if best < 1 else best
    for own, other in ((ra, b), (rb, a)):
        for t in own:
            bare = strip_marks_text(fold_text(t))
            if character_bound(Counter(bare), other.tight_counts) > best:
                best = max(best, character_folded(bare, other.tight_bare)["combined"])
    return min(1.0, best)


_COLLAPSE = re.compile(r"([^\W_]|[!?.])\1{2,}")
_BLANKS = re.compile(f"[\\s{T.EXTRA_BLANKS}]+")
_LEET, _LOOKS = str.maketrans(T.LEET_FROM, T.LEET_TO), str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)
_WORDS = re.compile(r"[^\W_]+")
_LONG_SCRIPTS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


class Side:
    """One text of a pair and what has been read from it, each part worked out once."""

    def __init__(self, text: str, lexicon: Lexicon, settings: Settings):
        self.text, self.lexicon, self.settings = text, lexicon, settings

    @cached_property
    def folded(self) -> str:
        return fold_text(self.text)

    @cached_property
    def bare(self) -> str:
        return strip_marks_text(self.folded)

    @cached_property
    def tight(self) -> str:
        return "".join(self.folded.split())

    @cached_property
    def tight_bare(self) -> str:
        return strip_marks_text(self.tight)

    @cached_property
    def tight_counts(self) -> Counter:
        return Counter(self.tight_bare)

    @cached_property
    def lemmas(self) -> frozenset[str]:
        return frozenset(lemma_text(w) for w in _WORDS.findall(self.bare.lower()))

    @cached_property
    def looks(self) -> str:
        return strip_marks_text(fold_text(self.folded.translate(_LOOKS)))

    @cached_property
    def even(self) -> str:
        """Leet read as letters, repetition cut, blanks evened."""
        return strip_marks_text(fold_text(_BLANKS.sub(" ", _COLLAPSE.sub(r"\1", self.text.translate(_LEET))).strip(" ")))

    @cached_property
    def segments(self) -> list[tuple[str, int, int, str]]:
        return segment_text(self.text, self.settings.search.segments)

    @cached_property
    def words(self) -> list[str]:
        return [p for p, _, _, kind in self.segments if kind in ("text", "named_entity")]

    @cached_property
    def folded_words(self) -> frozenset[str]:
        return frozenset(map(fold_text, self.words))

    @cached_property
    def signs(self) -> dict[str, float]:
        """Readings of emoji, symbols and numbers with their probabilities."""
        return {t.lower(): p for piece, _, _, kind in self.segments if kind in ("emoji", "symbol", "number") for t, _, p in self.lexicon.symbols.get(piece.replace("️", ""), [])}

    @cached_property
    def graded(self) -> dict[str, float]:
        return graded(self.text, self.lexicon, self.settings.search) if self.settings.rebus else {self.tight: 1.0}

    @cached_property
    def sounds(self) -> tuple[str, float]:
        """As in :func:`quillmesh.functions.sounds.as_letters`, with their sureness."""
        found = letters_of(self.text)
        return found, sound_confidence(self.text, found)

    @cached_property
    def vector(self) -> np.ndarray:
        return feature_hash_texts([self.text])[0].astype(np.float64)

    @cached_property
    def entities(self) -> list[dict]:
        return entities_text(self.text, self.settings.entities, self.settings.entity_chars)

    @cached_property
    def coverage(self) -> float:
        return sum(self.lexicon.contains(w) for w in self.words) / len(self.words) if self.words else 0.0

    @cached_property
    def languages(self) -> list[tuple[str, float]]:
        return detect_text(self.text, self.scripts, self.lexicon)

    @property
    def language(self) -> str:
        return self.languages[0][0]

    @cached_property
    def fold_key(self) -> str:
        return "".join(c for c in self.bare if c.isalnum())

    @cached_property
    def scripts(self) -> frozenset[str]:
        flags = int(np.bitwise_or.reduce(class_table()[np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)])) if self.text else 0
        return frozenset(s for s in T.SCRIPTS if flags & int(BIT[f"script {s}"]))

    @cached_property
    def latin(self) -> str | None:
        return latin_view(self.text)


def prepare(sides: list[Side]) -> None:
    """The readings and vectors of texts, worked out at once."""
    own = list({s.text: s for s in sides if "graded" not in s.__dict__}.values())
    decoded = [s for s in own if s.settings.rebus]
    if decoded:
        for s, found in zip(decoded, decode_texts([s.text for s in decoded], decoded[0].lexicon, decoded[0].settings.search, [s.segments for s in decoded]), strict=True):
            s.graded = _graded(s.text, found)
    for s, vector in zip(own, feature_hash_texts([s.text for s in own]).astype(np.float64), strict=True):
        s.vector = vector


@dataclass(frozen=True)
class Settings:
    """What an engine's configuration says about pairs."""

    search: Search = Search()
    entities: int = T.ENTITIES
    entity_chars: int = T.ENTITY_CHARS
    rebus: bool = True


def entity_evidence(a: list[dict], b: list[dict]) -> tuple[float, float]:
    """Agreement (the share of values that both hold, of the longer list) and conflict (of the kinds that both hold, the share
    without a common value); 0 where there is nothing to go by."""
    x, y = ({(e["entity_type"], e["value"]) for e in side} for side in (a, b))
    most = max(len(x), len(y))
    kinds = {k for k, _ in x} & {k for k, _ in y}
    apart = sum(not {v for k, v in x if k == kind} & {v for k, v in y if k == kind} for kind in kinds)
    return (len(x & y) / most if most else 0.0), (apart / len(kinds) if kinds else 0.0)


#: Sureness of a transcription letter by letter.
TRANSCRIBED = 0.6


def channels(a: Side, b: Side, compared: Compared) -> dict[str, float | None]:
    """The channels of two texts, None where one is missing."""
    character = compared.character(a.bare, b.bare)
    lexical = len(a.lemmas & b.lemmas) / len(a.lemmas | b.lemmas) if a.lemmas | b.lemmas else 1.0
    return {
        "semantic": float(a.vector @ b.vector), "lexical": lexical, "character": character, "visual": character if a.looks == a.bare and b.looks == b.bare else compared.character(a.looks, b.looks),
        "phonetic": compared.sound(a, b), "symbolic": symbolic(a, b, compared), "decoded": compared.overlap(a, b),
        "obfuscation": character if a.even == a.bare and b.even == b.bare else compared.character(a.even, b.even),
    }


def features(a: Side, b: Side, compared: Compared | None = None) -> dict[str, float | None]:
    """The channels (None where one is missing) and the features between them, of two texts."""
    found = channels(a, b, compared or Compared())
    semantic, lexical, symbolic_ = (found[k] for k in ("semantic", "lexical", "symbolic"))
    ca, cb = a.sounds[1], b.sounds[1]
    sure = {"semantic": 1.0, "lexical": 1.0, "character": 1.0, "visual": 1.0, "phonetic": min(ca, cb), "symbolic": 0.0 if symbolic_ is None else 1.0, "decoded": 1.0, "obfuscation": 1.0}
    same = 1.0 if a.language == b.language else 0.0
    validity, single = min(a.coverage, b.coverage), float(all(len(s.words) == 1 and len(_LONG_SCRIPTS.findall(s.words[0])) < 3 for s in (a, b)))
    likeness = sound = swap_valid = 0.0
    one_language = 1.0
    if swap := swapped(a.words, b.words):
        _, p, q = swap
        likeness = character_text(p, q)["combined"]
        swap_valid = float(a.lexicon.contains(p) and a.lexicon.contains(q))
        u, v = sounds_of(p), sounds_of(q)
        sound = sound_similarity(u, sound_confidence(p, u), v, sound_confidence(q, v))
        own, other = set(a.lexicon.languages_of(p)), set(a.lexicon.languages_of(q))
        one_language = 0.0 if own and other and not own & other else 1.0
    exact = exact_decode(a.graded, b.graded)
    identical = float(bool(a.fold_key) and a.fold_key == b.fold_key)
    short, long = sorted((a.fold_key, b.fold_key), key=len)
    contained = float(bool(short) and short != long and short in long and (len(short) >= 3 or not short.isascii()))
    cross = float(bool(a.scripts) and bool(b.scripts) and not a.scripts & b.scripts)
    transcribed = 0.0
    if cross and (a.latin or b.latin):
        transcribed = max(character_text(x, y)["combined"] for x, y in ((a.latin or a.text, b.text), (a.text, b.latin or b.text), (a.latin or a.text, b.latin or b.text))) * TRANSCRIBED
    agreement, conflict = entity_evidence(a.entities, b.entities)
    floor = max(0.0, semantic)
    return found | {
        "channel_confidence": sum(sure.values()) / len(sure), "language_agreement": same, "lexicon_validity": validity, "single_word_pair": single, "swapped_word_similarity": likeness,
        "swapped_phonetic": sound * validity * one_language, "confusable_swap": likeness * sound * (validity > 0.999) * swap_valid * one_language, "valid_swap_similarity": swap_valid * likeness**3 * one_language,
        "normalized_identity": identical, "substring_containment": contained, "cross_script_pair": cross, "cross_script_agreement": cross * same, "exact_decode": exact, "single_word_exact": single * exact,
        "fuzzy_decode_mismatch": min(1.0, max(0.0, (symbolic_ or 0.0) * found["decoded"] * (1 - min(1.0, exact)))), "contextual_semantic": 0.0, "cross_language_semantic": 0.0 if same else semantic,
        "entity_agreement": agreement, "entity_conflict": conflict, "semantic_without_lexical_overlap": semantic if lexical < 0.3 else 0.0,
        "transliteration_semantic_agreement": transcribed * floor * cross, "transliteration_semantic_conflict": transcribed * (1 - floor) * validity * (1 - same) * cross, "swap_validity": swap_valid,
    }


_KIND = ", ".join(f"{k} double" for k in [*T.CHANNELS, "channel_confidence", "language_agreement", *T.PAIR_FEATURES, "swap_validity"])
#: Texts whose readings a worker keeps, and pairs that it compares at once.
KEPT_SIDES, ABREAST = 4_000, 2_000


def with_evidence(pairs: DataFrame, a: str, b: str, lexicon: Lexicon, settings: Settings = Settings(), longest: int | None = None, between: bool = True) -> DataFrame:
    """``pairs`` with all features of two of its text columns as new columns, null where a text is null or over ``longest``;
    without ``between`` with the channels alone.

    One pass over Arrow batches, so whatever is done with the columns later reads no text again; a text that comes again in
    a task is not read again either.
    """
    names = [c.split(" ")[0] for c in _KIND.split(", ")] if between else list(T.CHANNELS)
    if clash := set(names) & set(pairs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    sent = pickle.dumps(lexicon)
    held: list[Lexicon] = []
    sides: dict[str, Side] = {}

    def side(text: str) -> Side:
        if text not in sides:
            sides[text] = Side(text, held[0], settings)
        return sides[text]

    def read(rows: list[tuple[str | None, str | None]]) -> list[dict[str, float | None]]:
        if len(sides) + 2 * len(rows) > KEPT_SIDES:
            sides.clear()
        there = [None if x is None or y is None or longest is not None and max(len(x), len(y)) > longest else (side(x), side(y)) for x, y in rows]
        pairs = [pair for pair in there if pair]
        prepare([s for pair in pairs for s in pair])
        compared = Compared(pairs)
        return [dict.fromkeys(names) if pair is None else (features if between else channels)(*pair, compared) for pair in there]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(pickle.loads(sent))
        at = batch.schema.get_field_index
        texts = list(zip(batch.column(at(a)).to_pylist(), batch.column(at(b)).to_pylist(), strict=True))
        rows = [r for i in range(0, len(texts), ABREAST) for r in read(texts[i : i + ABREAST])]
        new = [pa.array([r[k] if r[k] is None else float(r[k]) for r in rows], pa.float64()) for k in names]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = [*pairs.schema.fields, *(StructField(k, DoubleType()) for k in names)]
    return map_batches(pairs, run, StructType(fields))


#: What a message alone tells to a decision.
MESSAGE = ["language_top_probability", "language_candidate_count", "lexicon_coverage", "rebus_top_score", "rebus_candidate_count", "entity_count"]


def with_message_features(df: DataFrame, text: str, lexicon: Lexicon, settings: Settings = Settings()) -> DataFrame:
    """``df`` with :data:`MESSAGE` as new columns, null for a null text; one pass over Arrow batches."""
    sent = pickle.dumps(lexicon)
    held: list[Lexicon] = []

    def read(text: str) -> list[float]:
        side = Side(text, held[0], settings)
        found = decode_text(text, held[0], settings.search)
        return [side.languages[0][1], len(side.languages), side.coverage, max((r["score"] for r in found), default=0.0), len(found), len(side.entities)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(pickle.loads(sent))
        rows = [[None] * len(MESSAGE) if t is None else read(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.float64()) for i in range(len(MESSAGE)))], names=[*batch.schema.names, *MESSAGE])

    return map_batches(df, run, StructType([*df.schema.fields, *(StructField(k, DoubleType()) for k in MESSAGE)]))


def transcription_agreement(views_a: Column, views_b: Column, a: Column, b: Column) -> Column:
    """1 where a view of one text equals the other text or a view of it, without case and blanks."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    left = F.transform(F.concat(F.map_values(views_a), F.array(a)), norm)
    right = F.transform(F.concat(F.map_values(views_b), F.array(b)), norm)
    return F.arrays_overlap(left, right).cast("double")
