"""Problem 7: the languages of texts and of the stretches inside them, by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, counted once and then frozen. The code length of a
byte is that of its longest known context; where a context has not seen the byte, its escape is paid and the next shorter
one is asked, down to a uniform byte (method C escapes). Words are coded one by one between word bounds, so a word met
before costs one look-up. For all languages at once the trees are flattened: one row for every (context, byte) that any
language has seen, holding the exact code length in each, and one for every context, holding each language's escape.

Names, tags and misspelled words belong to no language. A word is therefore coded by a mixture of the language's tree and
of one source for all languages that spends ``NOISE`` bits a byte: the code length stays exact, and what is strange to
every language says next to nothing.

A text is put in plain form, cleared of what has no language (addresses, accounts, tags, numbers), and parted into
sentences; digits inside words are read as the letters they stand for. A sentence has the language of least code length,
unless two languages, one after the other, need so much less that they pay for the change (``SWITCH`` bits), in which case
it is divided there, and so on. A stretch counts when its language beats the second by ``SURE`` bits over at least two
words. Weak stretches only count where a text has no sure one. Confidence is the share of the language when the code
lengths of all its stretches in the record together are read as probabilities.

The trees are fitted on the pack of examples and on a sample of at most ``SAMPLE`` labelled texts, twice over: texts of
which the model so far is sure, in one language alone and the one of their label, are counted for it whole, up to
``PER_LANGUAGE`` words for each language.

Defined results: null, empty and wordless texts have no language; ties go to the first language in order; without any
pack or text all languages cost the same, so none is ever sure; words are coded whole, however long.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.plain import plain, words
from quillmesh.runtime import map_batches, sampled, table

ORDER = 5
SURE = 9.0
SAMPLE = 12_000
PER_LANGUAGE = 25_000
#: Bits a byte of the source that all languages share, and what it takes to turn to it.
NOISE, TURN = 2.0, 2.0
#: Bits that a change of language inside a sentence costs.
SWITCH = 20.0
#: Bytes of a word that are coded at once; longer ones in pieces with the bytes before them as context.
PIECE = 64
#: Words whose code lengths a worker keeps.
KNOWN_WORDS = 400_000

# Other spellings of language codes.
CODES = {"eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "rus": "ru"}
# Digits that stand for letters inside words, and the common Latin transcription of Russian.
LEET = str.maketrans("0123456789@$", "oizeasgtbgas")
CYRILLIC = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "),
        strict=True,
    )
)

_EMAIL = re.compile(r"[\w.+-]+\s*(?:@|[(\[{<]\s*(?:at|@|arroba|chiocciola|собака)\s*[)\]}>]|\bat\b|\barroba\b)\s*[\w-]+(?:\s*(?:\.|[(\[{<]\s*(?:dot|\.|punto|punkt|point|ponto|точка)\s*[)\]}>]|\bdot\b)\s*[\w-]+)+", re.IGNORECASE)
_AT_WORD = re.compile(r"[(\[{<]\s?(?:at|arroba|chiocciola|собака)\b|\sat\s\S+\sdot\s|\sarroba\s", re.IGNORECASE)
_NOISE = re.compile(r"https?://\S+|www\.\S+|[@#]\w+|\b[^\W\d_]{2,}_?\d+\b(?=[\s,;)\]>+/.]|$)(?<=[^\W\d_]\d\d)|\b\w+_\w+\b")
_BREAKS = re.compile(r"(?<=[.!?…:])\s+|[\n\r]+|\s+[/|;>]+\s+|(?<=[)\]>])\s+|\s+(?=[(\[<])|\s--?\s")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"^[a-z]{3,}\d\d$")
_LETTER = re.compile(r"[^\W\d_]")


def code_of(label: str | None) -> str:
    """The two-letter code of a label in any spelling; empty for none and ``und``."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    return "" if code == "und" else CODES.get(code, code)


def latin(word: str) -> str:
    return "".join(CYRILLIC.get(ch, ch) for ch in word)


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start and end in the plain form and the words that have a language, of each sentence with any."""
    if not text:
        return []
    shown = plain(text)
    blank = lambda m: " " * len(m.group())
    if "@" in shown or _AT_WORD.search(shown):
        shown = _EMAIL.sub(blank, shown)
    clear = _NOISE.sub(blank, shown)
    out, at = [], 0
    for m in [*_BREAKS.finditer(clear), None]:
        end = m.start() if m else len(clear)
        found = []
        for w in _WORD.findall(clear[at:end].lower()):
            if w.isalpha():
                found.append(w)
            elif _LETTER.search(w) and not _TAG.match(w):
                w = w.translate(LEET) if any(c.isdigit() for c in w) and sum(map(str.isalpha, w)) * 3 >= len(w) else w
                if not any(c.isdigit() for c in w):
                    found.append(w)
        if found:
            out.append((at, end, found))
        at = m.end() if m else end
    return out


def _keys(rows: np.ndarray, at: np.ndarray, place: int, order: int, symbol: bool) -> np.ndarray:
    """Hashes of the context of ``order`` bytes before ``place``, with the byte at ``place`` or without."""
    out = np.full(len(at), np.uint64(order * 2 + symbol + 1))
    for i in range(place - order, place + symbol):
        out = (out ^ rows[at, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _matrix(vocabulary: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as rows of bytes between word bounds: the rows, their lengths, the first place of each that is coded, and whose
    word it is. Longer words than ``PIECE`` bytes have several rows, which begin with ``order`` bytes that are only context."""
    raw, start, who = [], [], []
    for i, w in enumerate(vocabulary):
        whole = b" " + w.encode() + b" "
        for at in range(1, len(whole), PIECE):
            first = max(0, at - order) if at > 1 else 0
            raw.append(whole[first : at + PIECE])
            start.append(at - first)
            who.append(i)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    rows = np.zeros((len(raw), int(size.max(initial=1))), np.uint8)
    rows[np.arange(rows.shape[1])[None, :] < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return rows, size, np.array(start, np.int64), np.array(who, np.int64)


class Trees:
    """The frozen trees of all languages, flattened."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        vocabulary = sorted(set().union(*counts.values()) if counts else set())
        k = len(self.languages)
        weight = np.array([[counts[lang][w] for lang in self.languages] for w in vocabulary], np.float64).reshape(len(vocabulary), k)
        rows, size, start, owner = _matrix(vocabulary, order)
        none = np.empty(0, np.uint64)
        below_keys, below_cost = none, np.empty((0, k))
        self.tables = []
        for o in range(order + 1):
            # every place with at least o bytes before it (the word bound is one of them, and is no symbol at the start)
            sym, ctx, who = [none], [none], [np.empty((2, 0), np.int64)]
            for place in range(max(1, o), rows.shape[1]):
                at = np.flatnonzero((size > place) & (start <= place))
                sym.append(_keys(rows, at, place, o, True))
                ctx.append(_keys(rows, at, place, o, False))
                who.append(np.stack([at, np.full(len(at), place)]))
            sym, ctx, who = np.concatenate(sym), np.concatenate(ctx), np.concatenate(who, axis=1)
            keys, first, inverse = np.unique(sym, return_index=True, return_inverse=True)
            c = np.zeros((len(keys), k))
            np.add.at(c, inverse, weight[owner[who[0]]])
            ctx_keys, ctx_of = np.unique(ctx[first], return_inverse=True)
            n, d = np.zeros((len(ctx_keys), k)), np.zeros((len(ctx_keys), k))
            np.add.at(n, ctx_of, c)
            np.add.at(d, ctx_of, c > 0)
            total = np.maximum(n + d, 1)
            escape = np.where(n > 0, -np.log2(np.maximum(d, 1e-9) / total), 0.0)
            if o:
                under = np.empty(len(keys), np.uint64)
                for place in range(o, rows.shape[1]):
                    sel = np.flatnonzero(who[1][first] == place)
                    under[sel] = _keys(rows, who[0][first][sel], place, o - 1, True)
                lower = below_cost[np.searchsorted(below_keys, under)]
            else:
                lower = np.full((len(keys), k), 8.0)
            cost = np.where(c > 0, -np.log2(np.maximum(c, 1e-9) / total[ctx_of]), escape[ctx_of] + lower)
            below_keys, below_cost = keys, cost
            self.tables.append((keys, cost.astype(np.float32), ctx_keys, escape.astype(np.float32)))

    def cost(self, vocabulary: list[str]) -> np.ndarray:
        """Code length in bits of each word in each language."""
        out = np.zeros((len(vocabulary), len(self.languages)), np.float64)
        if not vocabulary:
            return out
        rows, size, start, owner = _matrix(vocabulary, self.order)
        for place in range(1, rows.shape[1]):
            at = np.flatnonzero((size > place) & (start <= place))
            for o in range(min(self.order, place), -1, -1):
                if not len(at):
                    break
                keys, cost, ctx_keys, escape = self.tables[o]
                own = _keys(rows, at, place, o, True)
                k = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                hit = keys[k] == own if len(keys) else np.zeros(len(at), bool)
                np.add.at(out, owner[at[hit]], cost[k[hit]])
                at = at[~hit]
                ctx = _keys(rows, at, place, o, False)
                k = np.minimum(np.searchsorted(ctx_keys, ctx), max(0, len(ctx_keys) - 1))
                seen = ctx_keys[k] == ctx if len(ctx_keys) else np.zeros(len(at), bool)
                np.add.at(out, owner[at[seen]], escape[k[seen]])
            np.add.at(out, owner[at], 8.0)
        return out


class Model:
    """Trees with the words met so far."""

    def __init__(self, trees: Trees):
        self.trees, self.languages = trees, trees.languages
        self.known: dict[str, int] = {}
        self.costs = np.empty((0, len(self.languages)))

    def learn(self, vocabulary: set[str]) -> None:
        new = [w for w in vocabulary if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, self.costs, new = {}, self.costs[:0], list(vocabulary)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        cost = self.trees.cost(new)
        noise = np.fromiter((len(w.encode()) + 1 for w in new), np.float64, len(new))[:, None] * NOISE + TURN
        least = np.minimum(cost, noise)
        self.costs = np.concatenate([self.costs, least - np.log2(2.0 ** (least - cost) + 2.0 ** (least - noise))])

    def lengths(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of all words of all sentences, one after another, and how many each has; call :meth:`learn` first."""
        flat = np.fromiter((self.known[w] for p in parts for w in p), np.int64, sum(map(len, parts)))
        return self.costs[flat], np.fromiter(map(len, parts), np.int64, len(parts))


#: A stretch in one language: start and end in the plain form, language number, code lengths in all languages, lead over the
#: second in bits, words.
Stretch = tuple[int, int, int, np.ndarray, float, int]


def judged(model: Model, texts: list[str | None]) -> list[list[Stretch]]:
    """For each text its stretches: its sentences, or parts of them."""
    return judged_sentences(model, [sentences(t) for t in texts])


def _leads(score: np.ndarray) -> np.ndarray:
    """By how many bits the first language of each row beats the second."""
    if score.shape[1] < 2:
        return np.full(len(score), 60.0 if score.shape[1] else 0.0)
    two = np.partition(score, 1, axis=1)
    return two[:, 1] - two[:, 0]


def divided(costs: np.ndarray) -> list[tuple[int, int]]:
    """The words of a sentence (a row of code lengths each) in runs of one language; a change must save ``SWITCH`` bits and leave
    two words at least, of which the language is sure, on either side."""
    out, left = [], [(0, len(costs))]
    while left:
        a, b = left.pop()
        best = None
        if b - a >= 4:
            whole = np.cumsum(costs[a:b], axis=0)
            rest = whole[-1] - whole
            gain = whole[-1].min() - whole[:-1].min(axis=1) - rest[:-1].min(axis=1)
            gain[0] = gain[-1] = -1
            at = int(gain.argmax())
            if gain[at] >= SWITCH and min(_leads(whole[at : at + 1])[0], _leads(rest[at : at + 1])[0]) >= SURE:
                best = a + at + 1
        if best is None:
            out.append((a, b))
        else:
            left += [(best, b), (a, best)]
    return out


def judged_sentences(model: Model, parts: list[list[tuple[int, int, list[str]]]]) -> list[list[Stretch]]:
    """The same for texts that are parted already."""
    flat = [s for p in parts for s in p]
    model.learn({w for s in flat for w in s[2]})
    costs, sizes = model.lengths([s[2] for s in flat])
    begin = np.cumsum(sizes) - sizes
    score = np.add.reduceat(costs, begin, axis=0) if len(flat) else np.empty((0, len(model.languages)))
    lead = _leads(score)
    best = score.argmin(axis=1) if score.shape[1] else np.zeros(len(score), np.int64)
    # words that the sentence's language codes much worse than another does: without them no change can pay
    extra = costs - costs.min(axis=1, keepdims=True) if score.shape[1] else costs
    open_ = np.zeros(len(flat), bool)
    if len(flat) and score.shape[1] > 1:
        open_ = np.add.reduceat(extra[np.arange(len(extra)), np.repeat(best, sizes)], begin) >= SWITCH
    out, at = [], 0
    for p in parts:
        own: list[Stretch] = []
        for start, end, found in p:
            runs = divided(costs[begin[at] : begin[at] + sizes[at]]) if open_[at] and len(found) >= 4 else [(0, len(found))]
            if len(runs) == 1:
                own.append((start, end, int(best[at]), score[at], float(lead[at]), len(found)))
            else:
                for i, (a, b) in enumerate(runs):
                    total = costs[begin[at] + a : begin[at] + b].sum(axis=0)
                    # places inside a sentence go by the share of its letters before them
                    share = [sum(map(len, found[:x])) / max(1, sum(map(len, found))) for x in (a, b)]
                    own.append((start + round(share[0] * (end - start)), start + round(share[1] * (end - start)), int(total.argmin()), total, float(_leads(total[None])[0]), b - a))
            at += 1
        out.append(own)
    return out


def _confidence(total: np.ndarray, lang: int) -> float:
    """The share of a language when code lengths are read as probabilities."""
    return float(1 / (2.0 ** np.maximum(-60, np.minimum(60, total[lang] - total))).sum())


def languages_of(found: list[Stretch]) -> dict[int, float]:
    """The languages of a record from its stretches, with the confidence that all stretches of each together give."""
    totals: dict[int, np.ndarray] = {}
    for _, _, lang, total, lead, n in found:
        if lead >= SURE and n >= 2:
            totals[lang] = totals[lang] + total if lang in totals else total
    if not totals and found:
        _, _, lang, total, lead, _ = max(found, key=lambda s: s[4])
        if lead > 1.0:
            totals[lang] = total
    return {lang: _confidence(total, lang) for lang, total in totals.items()}


def fit(pack: list[tuple[str, list[str], list[str]]], sample: list[tuple[str, str]]) -> Trees:
    """Trees from (language, words, examples) and labelled sample texts (text, code); labels may be wrong."""
    seed: dict[str, Counter] = {}
    for lang, entries, examples in pack:
        c = seed.setdefault(lang, Counter())
        for text in examples:
            for _, _, found in sentences(text):
                c.update(found)
        c.update({w.lower(): 1 for w in entries})
    trees = _with_transcription(seed)
    split = [(own, code) for t, code in sample if (own := sentences(t))]
    for _ in range(2):
        model, kept, sizes = Model(trees), {lang: Counter(c) for lang, c in seed.items()}, dict.fromkeys(seed, 0)
        for start in range(0, len(split), 2000):
            part = split[start : start + 2000]
            for text, (own, code) in zip(judged_sentences(model, [p[0] for p in part]), part, strict=True):
                sure = languages_of(text)
                leads = [s[4] for s in text if s[2] in sure]
                if len(sure) == 1 and max(leads) >= 2 * SURE and model.languages[next(iter(sure))] == code:  # its weak sentences are in the same language
                    name = code
                    found = [w for s in own for w in s[2]]
                    if sizes[name] < PER_LANGUAGE:
                        kept[name].update(found)
                        sizes[name] += len(found)
        trees = _with_transcription(kept)
    return trees


def _with_transcription(counts: dict[str, Counter]) -> Trees:
    """Trees in which words of another alphabet also count in Latin transcription."""
    whole = {}
    for lang, c in counts.items():
        own = Counter(c)
        for w, n in c.items():
            t = latin(w)
            if t != w:
                own[t] += n
        whole[lang] = own
    return Trees(whole)


def fitted(spark: SparkSession, sf_dir: str) -> Trees:
    """The trees for a data folder: its language pack, and a bounded sample of its messages."""
    pack = [(r.language, [e.word for e in r.entries or [] if e.word], list(r.examples or [])) for r in table(spark, sf_dir, "language_pack").select("language", "entries", "examples").collect()]
    messages = table(spark, sf_dir, "spam_item").where("text IS NOT NULL").select("id", "text", _codes(F.col("lang")).alias("code")).where("code <> ''")
    sample = [(r.text, r.code) for r in sampled(messages, "id", SAMPLE, 3).collect()]
    return fit(pack, sample)


def detect(df: DataFrame, keep: list[str], fields: list[str], trees: Trees, stretches: bool = False) -> DataFrame:
    """Columns ``keep`` with the languages of the texts in ``fields`` taken together: langs, confidences and n_words (of a single field, else 0).

    With ``stretches`` instead one row for each run of sentences in one language: field, start_pos and end_pos in the plain
    form, lang and confidence.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(trees))  # its size follows from the bounded sample
    holder: list[Model] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Model(pickle.loads(sent.value)))
        model = holder[0]
        at = batch.schema.get_field_index
        columns = [batch.column(at(f)).to_pylist() for f in fields]
        found = [judged(model, c) for c in columns]
        if stretches:
            take, rows = [], []
            for r in range(batch.num_rows):
                for f, own in zip(fields, found, strict=True):
                    for start, end, lang, total in _stretches(own[r]):
                        take.append(r)
                        rows.append((f, start, end, model.languages[lang], _confidence(total, lang)))
            kept = batch.select(keep).take(pa.array(take, pa.int64()))
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*keep, "field", "start_pos", "end_pos", "lang", "confidence"])
        langs = []
        for r in range(batch.num_rows):
            langs.append(languages_of([s for own in found for s in own[r]]))
        n = [len(words(t)) for t in columns[0]] if len(columns) == 1 else [0] * batch.num_rows
        new = [pa.array([[model.languages[k] for k in sorted(x)] for x in langs], pa.list_(pa.string())), pa.array([[x[k] for k in sorted(x)] for x in langs], pa.list_(pa.float64())), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.select(keep).columns, *new], names=[*keep, "langs", "confidences", "n_words"])

    kinds = dict(df.dtypes)
    extra = "field string, start_pos bigint, end_pos bigint, lang string, confidence double" if stretches else "langs array<string>, confidences array<double>, n_words int"
    return map_batches(df.select(*dict.fromkeys([*keep, *fields])), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), extra]))


def _stretches(found: list[Stretch]) -> list[tuple[int, int, int, np.ndarray]]:
    """Stretches in one language after one another as one, with their code lengths together; weak ones follow the sure one
    before, else after, them. None where nothing tells the languages apart."""
    sure = [s[4] >= SURE and s[5] >= 2 for s in found]
    lang: list[int] = []
    for i, s in enumerate(found):
        near = next((found[j][2] for j in (*range(i - 1, -1, -1), *range(i + 1, len(found))) if sure[j]), s[2]) if any(sure) and not sure[i] else s[2]
        lang.append(near)
    out: list[tuple[int, int, int, np.ndarray]] = []
    for s, k in zip(found, lang, strict=True):
        if not len(s[3]):
            continue
        if out and out[-1][2] == k:
            out[-1] = (out[-1][0], s[1], k, out[-1][3] + s[3])
        else:
            out.append((s[0], s[1], k, s[3]))
    return out


def _codes(column: F.Column) -> F.Column:
    """The two-letter code of a label column; empty for none and ``und``."""
    code = F.element_at(F.split(F.lower(F.trim(F.coalesce(column, F.lit("")))), "[-_]"), 1)
    mapped = F.element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), code)
    return F.when(code == "und", "").otherwise(F.coalesce(mapped, code))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = table(spark, sf_dir, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select(F.lit("evaluation_case").alias("src"), "id", "a", "b", F.array_sort(F.array_distinct(F.transform(F.coalesce("languages", F.array().cast("array<string>")), _codes))).alias("declared"))
    spam = table(spark, sf_dir, "spam_item").where("text IS NOT NULL").select(F.lit("spam_item").alias("src"), "id", "text", F.array(_codes(F.col("lang"))).alias("declared"))
    return cases, spam


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose declared languages are not those of their sentences, with the true ones."""
    trees = fitted(spark, sf_dir)
    cases, spam = _inputs(spark, sf_dir)
    keep = ["src", "id", "declared"]
    found = detect(cases, keep, ["a", "b"], trees).unionByName(detect(spam, keep, ["text"], trees).where("n_words >= 4"))
    wrong = found.where(F.size("langs") > 0).where(F.array_sort("langs") != F.col("declared"))
    return wrong.select("src", "id", F.explode("langs").alias("lang")).distinct()


def p7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every record with their confidence."""
    trees = fitted(spark, sf_dir)
    cases, spam = _inputs(spark, sf_dir)
    found = detect(cases, ["src", "id"], ["a", "b"], trees).unionByName(detect(spam, ["src", "id"], ["text"], trees))
    return found.select("src", "id", F.explode(F.arrays_zip("langs", "confidences")).alias("x")).select("src", "id", F.col("x.langs").alias("lang"), F.round("x.confidences", 6).alias("confidence")).distinct()


def p7_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of every text."""
    trees = fitted(spark, sf_dir)
    cases, spam = _inputs(spark, sf_dir)
    return detect(cases, ["src", "id"], ["a", "b"], trees, True).unionByName(detect(spam, ["src", "id"], ["text"], trees, True)).distinct()
