"""Similarities of many pairs of texts at once: what :mod:`distance` and :mod:`sounds` work out pair by pair, with the pairs
side by side in the words of NumPy arrays. Results are the same; long texts go pair by pair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quillmesh.functions import distance, sounds
from quillmesh.functions import tables as T

#: Longer texts are compared one by one, where the additions are long enough. Pairs side by side, and words of their bit vectors.
LONGEST, ABREAST, ROOM = 1_000, 2_048, 4_000_000
_ONE, _TOP, _ALL, _BEYOND = np.uint64(1), np.uint64(63), np.uint64(2**64 - 1), np.iinfo(np.int64).max


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts as rows of numbers from 1, with 0 beyond their ends; their lengths; how many numbers there are."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    rows = np.zeros((len(texts), int(lengths.max(initial=0))), np.int64)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat + 1
    return rows, lengths, len(kinds) + 1


def _grams(codes: np.ndarray, lengths: np.ndarray, kinds: int, left: np.ndarray, right: np.ndarray, n: int, besides: np.ndarray | int = 0) -> np.ndarray:
    """Jaccard of the multisets of n-grams, for rows ``left`` and ``right`` of :func:`_codes` that share so many ``besides``. Equal n-grams of a row are numbered
    through, which makes multisets sets; two sorted together, what both hold stands twice."""
    size = max(0, codes.shape[1] - n + 1)
    key = np.zeros((len(codes), size), np.int64)
    for i in range(n):
        key = key * kinds + codes[:, i : i + size]
    there, place = np.maximum(0, lengths - n + 1), np.arange(size)
    key[place >= there[:, None]] = _BEYOND
    key.sort(axis=1)
    first = np.ones(key.shape, bool)
    first[:, 1:] = key[:, 1:] != key[:, :-1]
    nth = place - np.maximum.accumulate(np.where(first, place, 0), axis=1)
    key = np.where(place < there[:, None], key * 1024 + nth, _BEYOND)
    shared = np.zeros(len(left), np.int64)
    for at in range(0, len(left), 256):
        both = np.concatenate([key[left[at : at + 256]], key[right[at : at + 256]]], axis=1)
        both.sort(axis=1)
        shared[at : at + 256] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _BEYOND)).sum(axis=1)
    union = there[left] + there[right] - shared + besides
    return np.where(union > 0, (shared + besides) / np.maximum(union, 1), 0.0)


def _numbered(texts: Sequence[str]) -> tuple[list[str], dict[str, int]]:
    own = list(dict.fromkeys(texts))
    return own, {t: i for i, t in enumerate(own)}


def _slices(pairs: Sequence[tuple[str, str]]) -> list[list[int]]:
    """Places of pairs whose second texts fill as many words, the longest first texts first, as many as go abreast."""
    words = [-(-len(b) // 64) for _, b in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (words[i], -len(pairs[i][0])))
    out: list[list[int]] = []
    for i in order:
        if not out or len(out[-1]) >= ABREAST or words[out[-1][0]] != words[i]:
            out.append([])
        out[-1].append(i)
    return out


def _abreast(pairs: list[tuple[str, str]], whole: bool) -> dict[str, np.ndarray]:
    """Edit distances, with ``whole`` also those with swaps, common subsequences, Jaro and n-grams, of pairs as in :func:`_slices`."""
    own, number = _numbered([t for pair in pairs for t in pair])
    codes, lengths, kinds = _codes(own)
    left, right = (np.fromiter((number[p[k]] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
    n, m = lengths[left], lengths[right]
    words = -(-int(m.max()) // 64)
    masks_of, pattern = np.unique(right, return_inverse=True)
    if len(pairs) > 1 and len(masks_of) * kinds > ROOM:
        half = len(pairs) // 2
        parts = [_abreast(pairs[:half], whole), _abreast(pairs[half:], whole)]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    # a second text's characters by numbers of its own, 0 for those that it has not, so that what a step looks up lies close
    rows = codes[masks_of]
    held = np.zeros((len(rows), kinds), bool)
    held[np.arange(len(rows))[:, None], rows] = True
    held[:, 0] = False
    own_number = (np.cumsum(held, axis=1) * held).astype(np.int32)
    width = int(own_number.max()) + 1
    own_number += (np.arange(len(rows)) * width)[:, None].astype(np.int32)
    # bit i of a text's mask of a character: it stands at i
    masks = np.zeros((words, len(rows) * width), np.uint64)
    places = np.take_along_axis(own_number, rows, axis=1)
    for i in range(int(m.max())):
        there = rows[:, i] > 0
        masks[i // 64][places[there, i]] |= _ONE << np.uint64(i % 64)
    steps = own_number.ravel().take(codes[left].T + pattern * kinds)
    size = len(pairs)
    active = np.searchsorted(-n, -np.arange(int(n.max())), "left")  # first texts stand by falling length
    full = lambda: np.full((words, size), _ALL)
    zero = lambda: np.zeros((words, size), np.uint64)
    up, down = full(), zero()
    if whole:
        up2, down2, diagonal2, before, rest, free, window = full(), zero(), zero(), zero(), full(), full(), zero()
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        for w in range(words):
            filled = np.clip(reach - 64 * w, 0, 64).astype(np.uint64)  # the bits below the reach; its own comes with the first step
            window[w] = np.where(filled == 64, _ALL, (_ONE << np.minimum(filled, _TOP)) - _ONE)
        met = np.zeros((len(active), size), bool)

    def column(hit, up, down, carried_up, carried_down, turned=None):
        """One step of one word, in place; what is carried into the next word, and the diagonal."""
        x = hit | carried_down
        diagonal = ((x & up) + up ^ up) | x | down
        if turned is not None:
            diagonal |= turned
        right, left = down | ~(diagonal | up), diagonal & up
        over = right >> _TOP, left >> _TOP
        right = right << _ONE | carried_up
        left = left << _ONE | carried_down
        up[:] = left | ~(diagonal | right)
        down[:] = right & diagonal
        return *over, diagonal

    for i, k in enumerate(active.tolist()):
        place = steps[i, :k]
        c_up = c_up2 = _ONE
        c_down = c_down2 = np.uint64(0)
        if whole:
            turn = c_rest = np.uint64(0)
            slid = (reach[:k] >= i).astype(np.uint64)
            none = np.full(k, _ALL)
        for w in range(words):
            hit = masks[w].take(place)
            c_up, c_down, _ = column(hit, up[w, :k], down[w, :k], c_up, c_down)
            if not whole:
                continue
            open_ = ~diagonal2[w, :k] & hit
            turned = (open_ << _ONE | turn) & before[w, :k]
            turn = open_ >> _TOP
            c_up2, c_down2, diagonal2[w, :k] = column(hit, up2[w, :k], down2[w, :k], c_up2, c_down2, turned)
            before[w, :k] = hit
            row = rest[w, :k]
            met_here = row & hit
            total = row + met_here
            over = total < row
            total += c_rest
            c_rest = (over | (total < c_rest)).astype(np.uint64)
            row[:] = total | row - met_here
            view = window[w, :k]
            next_ = view >> _TOP
            view[:] = view << _ONE | slid
            slid = next_
            taken = hit & view & free[w, :k] & none
            none[taken != 0] = 0
            free[w, :k] ^= taken & -taken
        if whole:
            met[i, :k] = none == 0
    held = np.stack([np.where(m - 64 * w >= 64, _ALL, (_ONE << np.clip(m - 64 * w, 0, 63).astype(np.uint64)) - _ONE) for w in range(words)])
    bits = lambda x: np.bitwise_count(x & held).sum(axis=0, dtype=np.int64)
    out = {"edits": n + bits(up) - bits(down)}
    if whole:
        out |= {"swaps": n + bits(up2) - bits(down2), "lcs": bits(~rest)}
        out["ngram"] = (_grams(codes, lengths, kinds, left, right, 2) + _grams(codes, lengths, kinds, left, right, 3)) / 2
        taken = np.unpackbits(np.ascontiguousarray(~free.T).view(np.uint8), axis=1, bitorder="little").view(bool)
        at_b = np.pad(codes, ((0, 0), (0, max(0, 64 * words - codes.shape[1]))))[right, : 64 * words][taken]
        met = met.T
        found = met.sum(axis=1)
        apart = np.bincount(np.repeat(np.arange(size), found)[codes[left, : met.shape[1]][met] != at_b], minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["jaro"] = np.where(found > 0, (found / n + found / m + (found - apart / 2) / found) / 3, 0.0)
    return out


def edits_many(pairs: Sequence[tuple[str, str]]) -> list[int]:
    """:func:`distance.levenshtein_text` of each pair."""
    out = [0] * len(pairs)
    near = [i for i, (a, b) in enumerate(pairs) if a and b and max(len(a), len(b)) <= LONGEST]
    for i in set(range(len(pairs))).difference(near):
        out[i] = distance.levenshtein_text(*pairs[i])
    own = [pairs[i] for i in near]
    for part in _slices(own):
        for i, value in zip(part, _abreast([own[j] for j in part], False)["edits"].tolist(), strict=True):
            out[near[i]] = value
    return out


#: Lots into which n-grams are counted.
LOTS = 256


def character_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How often each text holds each character of all of them; its pairs and triples of characters, counted in lots; its length."""
    codes, lengths, kinds = _codes(texts)
    row = np.arange(len(texts))[:, None]
    single = np.bincount((codes + row * kinds).ravel(), minlength=len(texts) * kinds).reshape(len(texts), kinds)[:, 1:].astype(np.int16)
    lots, key = [], codes
    for n in (2, 3):
        key = key[:, : max(0, codes.shape[1] - n + 1)] * 1_000_003 + codes[:, n - 1 :]
        there = np.arange(key.shape[1]) < (lengths - n + 1)[:, None]
        lot = (key * 0x9E3779B1 >> 20) % LOTS + 1
        lots.append(np.bincount((np.where(there, lot, 0) + row * (LOTS + 1)).ravel(), minlength=len(texts) * (LOTS + 1)).reshape(len(texts), LOTS + 1)[:, 1:].astype(np.int16))
    return single, *lots, lengths


def character_bounds(shared: np.ndarray, n: np.ndarray, m: np.ndarray, two: np.ndarray | None = None, three: np.ndarray | None = None) -> np.ndarray:
    """What the blend of texts of ``n`` and ``m`` characters can't exceed that share so many, and no more than so many pairs and
    triples of neighbours.

    An edit does away with at most two pairs of neighbours, a swap with three; of the pairs in a common subsequence only those
    are not in both texts between which one of them has something.
    """
    longest = np.maximum(1, np.maximum(n, m))
    most = edits = swaps = lcs = shared / longest
    jaro = np.where(shared > 0, (shared / np.maximum(1, n) + shared / np.maximum(1, m) + 1) / 3, 0.0)
    ngram = np.ones(len(shared))
    if two is not None and three is not None:
        lost = np.maximum(0, longest - 1 - two)
        edits, swaps, lcs = np.minimum(most, 1 - lost / 2 / longest), np.minimum(most, 1 - lost / 3 / longest), np.minimum(most, (two + 1 + n + m) / 3 / longest)
        of = [np.maximum(0, n - k) + np.maximum(0, m - k) - x for k, x in ((1, two), (2, three))]
        ngram = sum(np.where(all_ > 0, x / np.maximum(1, all_), 0.0) for all_, x in zip(of, (two, three), strict=True)) / 2
    bound = sum(T.CHARACTER[k] * v for k, v in {"levenshtein": edits, "damerau": swaps, "jaro": jaro, "jaro_winkler": jaro + 0.4 * (1 - jaro), "ngram": ngram, "lcs": lcs}.items())
    return np.where((n > 0) & (m > 0), bound, np.where(n == m, 1.0, 0.0))


def character_many(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """The blend of :func:`distance.character_folded` of each pair."""
    out = [0.0] * len(pairs)
    near = [i for i, (a, b) in enumerate(pairs) if a and b and a != b and max(len(a), len(b)) <= LONGEST]
    for i in set(range(len(pairs))).difference(near):
        out[i] = distance.character_folded(*pairs[i])["combined"]
    if not near:
        return out
    own = [pairs[i] for i in near]
    for part in _slices(own):
        here = [own[j] for j in part]
        got = _abreast(here, True)
        for i, (a, b), edits, swaps, lcs, jaro, ngram in zip(part, here, *(got[k].tolist() for k in ("edits", "swaps", "lcs", "jaro", "ngram")), strict=True):
            longest = max(len(a), len(b))
            parts = {"levenshtein": 1 - edits / longest, "damerau": 1 - swaps / longest, "jaro": jaro, "jaro_winkler": distance._winkler(a, b, jaro), "ngram": ngram, "lcs": lcs / longest}
            out[near[i]] = sum(T.CHARACTER[k] * v for k, v in parts.items())
    return out


# ------------------------------------------------------------------------------------------------ sounds

def _ends(a: str, b: str) -> tuple[int, int]:
    """How much two texts both begin with, and of the rest both end with. It costs nothing in some best alignment."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    head = low
    low, high = 0, min(len(a), len(b)) - head
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    return head, low


def _weighted(pairs: list[tuple[str, str]]) -> list[float]:
    """Edit distances by features of sounds, in twentieths: all their differences are whole numbers of those."""
    names = list(sounds._LETTER)
    cost = np.array([[round(20 * sounds.sound_distance(x, y)) - 20 for y in names] for x in names], np.int16).ravel()
    out = np.zeros(len(pairs))
    turned = [(b, a) if len(a) > len(b) else (a, b) for a, b in pairs]
    order = sorted(range(len(pairs)), key=lambda i: -len(turned[i][1]))
    for at in range(0, len(order), ABREAST // 4):
        part = sorted(order[at : at + ABREAST // 4], key=lambda i: -len(turned[i][0]))
        short, long = ([turned[i][k] for i in part] for k in (0, 1))
        n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (short, long))
        rows = []
        for texts, lengths in ((short, n), (long, m)):
            row = np.full((len(texts), int(lengths.max())), 33, np.int32)
            row[np.arange(row.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            rows.append(row - 33)
        x, y = rows[0] * len(names), rows[1]
        # the distance less 20 for each sound of the longer side so far, so that insertions are a running minimum
        row = np.zeros((len(part), y.shape[1] + 1), np.int16)
        active = np.searchsorted(-n, -np.arange(int(n.max())), "left")
        for i, k in enumerate(active.tolist()):
            now = row[:k]
            new = now[:, :-1] + cost.take(x[:k, i, None] + y[:k])
            now += 20
            np.minimum(now[:, 1:], new, out=now[:, 1:])
            np.minimum.accumulate(now, axis=1, out=now)
        out[part] = (row[np.arange(len(part)), m] + 20 * m) / 20
    return out.tolist()


def sounds_many(pairs: Sequence[tuple[str, float, str, float]]) -> list[float]:
    """:func:`sounds.sound_similarity` of each (a, confidence, b, confidence), sounds as in :func:`sounds.as_letters`."""
    out = [0.0] * len(pairs)
    near = [i for i, (a, _, b, _) in enumerate(pairs) if a and b and max(len(a), len(b)) <= LONGEST]
    for i in set(range(len(pairs))).difference(near):
        a, ca, b, cb = pairs[i]
        out[i] = sounds.sound_similarity(sounds.from_letters(a), ca, sounds.from_letters(b), cb)
    own = [(pairs[i][0], pairs[i][2]) for i in near]
    ends = [_ends(a, b) for a, b in own]
    apart = [(a[h : len(a) - t], b[h : len(b) - t]) for (a, b), (h, t) in zip(own, ends, strict=True)]
    weighted = [float(len(a) + len(b)) for a, b in apart]
    plain, grams = list(map(int, weighted)), [1.0] * len(own)
    both = [k for k, (a, b) in enumerate(apart) if a and b]
    middle = [apart[k] for k in both]
    for k, by_feature, edits in zip(both, _weighted(middle), edits_many(middle), strict=True):
        weighted[k], plain[k] = by_feature, edits
    unlike = [k for k, (a, b) in enumerate(own) if a != b]
    # n-grams within what both begin or end with are in both, so those at the other places are counted
    cut = [(max(0, ends[k][0] - 2), max(0, ends[k][1] - 2)) for k in unlike]
    kept = [tuple(x[h : len(x) - t] for x in own[k]) for k, (h, t) in zip(unlike, cut, strict=True)]
    for part in _slices(kept):
        texts, number = _numbered([t for k in part for t in kept[k]])
        left, right = (np.fromiter((number[kept[k][side]] for k in part), np.int64, len(part)) for side in (0, 1))
        codes, lengths, kinds = _codes(texts)
        besides = np.array([sum(cut[k]) for k in part])
        for k, share in zip(part, (sum(_grams(codes, lengths, kinds, left, right, n, besides) for n in (2, 3)) / 2).tolist(), strict=True):
            grams[unlike[k]] = share
    for i, (a, b), by_feature, edits, share in zip(near, own, weighted, plain, grams, strict=True):
        longest = max(len(a), len(b))
        out[i] = max(0.0, min(1.0, 0.45 * (1 - by_feature / longest) + 0.25 * (1 - edits / longest) + 0.20 * share + 0.10 * min(pairs[i][1], pairs[i][3])))
    return out
