"""Problem 10: the share of each document's words that repeats what the document said before.

A word is repeated when it lies in a run of ``run`` words that also begins at an earlier place in its document. Whether a
document reaches a share is decided by a cascade of rules. Each rule but the last can only clear a document, and never
one that reaches the share, so their order changes the time and not the result. What each rule costs and clears is measured
once, on a sample of ``SAMPLE`` documents: the rule that clears most for a second of cost comes first, then, among what it
leaves and with what it has worked out at hand, the next, and so on. All tasks follow this order.

Defined results: null, empty and blank texts have no words and a share of 0; documents of fewer than ``least_words``
words are no cases; texts are read whole. Repeated rows give repeated rows in :func:`repetition` and one row in
:func:`repetitive`. Of other columns only those named in ``keep`` are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.plain import words
from quillmesh.runtime import map_batches, sampled, table

#: Documents that the order of the rules is measured on; the sample never decides a result.
SAMPLE = 200


def repeated_words(tokens: list[str], run: int = 8) -> int:
    """How many words lie in a run that also begins earlier."""
    n = len(tokens)
    if n <= run:
        return 0
    codes = pd.factorize(np.array(tokens, dtype=object))[0].astype(np.int64)
    return repeated_of_codes(codes, run)


def repeated_of_codes(codes: np.ndarray, run: int) -> int:
    n = len(codes)
    if n <= run:
        return 0
    # windows of 1, 2, 4, ... codes are numbered exactly: equal number, equal window
    number, width = codes, 1
    while width < run:
        step = min(width, run - width)
        pair = number[: n - width - step + 1] * np.int64(n + 1) + number[step : step + n - width - step + 1]
        number, width = pd.factorize(pair)[0].astype(np.int64), width + step
    again = np.flatnonzero(pd.Series(number).duplicated(keep="first").to_numpy())
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


class Document:
    """One text and what the rules have worked out about it so far."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._words: list[str] | None = None

    def as_it_is(self) -> Document:
        """The same document with what is worked out so far."""
        new = Document(self.text)
        new._words = self._words
        return new

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = words(self.text)
        return self._words


def clearing_rules(share: float, run: int, least_words: int) -> dict[str, Callable[[Document], bool]]:
    """Rules that are true only of documents that can't be cases.

    A repeated word equals a word of the earlier run, so it is no first occurrence: distinct words make up at most
    ``1 - share`` of a case. The same holds for pairs of neighbours within repeated runs: ``r`` repeated words hold at
    least ``r * (run - 1) / run`` pairs that are no first occurrences.
    """

    def few_characters(d: Document) -> bool:
        return len(d.text) < 2 * least_words - 1 and d.text.isascii()

    def few_words(d: Document) -> bool:
        return len(d.words) < least_words

    def many_distinct_words(d: Document) -> bool:
        n = len(d.words)
        return n > 0 and n - len(set(d.words)) < share * n

    def many_distinct_pairs(d: Document) -> bool:
        n = len(d.words)
        if n < 2:
            return True
        pairs = len(set(zip(d.words, d.words[1:], strict=False)))
        return n - 1 - pairs < share * n * (run - 1) / run

    return {"few_characters": few_characters, "few_words": few_words, "many_distinct_words": many_distinct_words, "many_distinct_pairs": many_distinct_pairs}


def order_of(texts: list[str | None], share: float, run: int, least_words: int) -> list[str]:
    """The clearing rules by rejections for a second of cost among the texts that the rules before leave."""
    rules, left, order = clearing_rules(share, run, least_words), [Document(t) for t in texts], []
    while rules:
        tried = []
        for name, rule in rules.items():
            asked = [d.as_it_is() for d in left]
            began = time.perf_counter()
            cleared = [rule(d) for d in asked]
            tried.append((-sum(cleared) / (time.perf_counter() - began + 1e-9), name, [d for d, c in zip(asked, cleared, strict=True) if not c]))
        _, name, left = min(tried, key=lambda x: x[:2])
        order.append(name)
        del rules[name]
    return order


class Cascade:
    """The clearing rules in a given order, and the exact count after them."""

    def __init__(self, share: float, run: int, least_words: int, order: list[str] | None = None):
        self.share, self.run, self.least_words = share, run, least_words
        rules = clearing_rules(share, run, least_words)
        self.rules = [rules[name] for name in order or rules]

    def is_case(self, text: str | None) -> bool:
        d = Document(text)
        return not any(rule(d) for rule in self.rules) and self._exact(d)

    def _exact(self, d: Document) -> bool:
        n = len(d.words)
        return n >= self.least_words and repeated_words(d.words, self.run) >= self.share * n - 1e-9


def repetitive(df: DataFrame, text: str, keep: list[str], share: float = 0.3, run: int = 8, least_words: int = 16) -> DataFrame:
    """Columns ``keep`` of the rows whose text repeats itself to at least ``share``."""
    drawn = sampled(df.select(text).where(F.length(text) > 0), text, SAMPLE).collect()
    order = order_of([r[0] for r in drawn], share, run, least_words)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        is_case = Cascade(share, run, least_words, order).is_case
        kept = batch.filter(pa.array([is_case(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.bool_()))
        return kept.select(keep)

    kinds = dict(df.dtypes)
    wanted = df.select(*dict.fromkeys([*keep, text])).filter(F.length(text) > 0)
    return map_batches(wanted, pick, ", ".join(f"`{k}` {kinds[k]}" for k in keep))


def repetition(df: DataFrame, text: str, keep: list[str], run: int = 8) -> DataFrame:
    """Columns ``keep``, and for every row its words, its repeated words and their share, and the shares of its words in repeated lines and sentences."""
    import re

    sentence = re.compile(r"(?<=[.!?…。])\s+|\n+")

    def again(parts: list[str]) -> float:
        seen, total, repeated = set(), 0, 0
        for part in parts:
            w = tuple(words(part))
            total += len(w)
            if w and w in seen:
                repeated += len(w)
            seen.add(w)
        return repeated / total if total else 0.0

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        found = [words(t) for t in texts]
        counts = [repeated_words(w, run) for w in found]
        lines = [again(t.splitlines()) if t else 0.0 for t in texts]
        sentences = [again(sentence.split(t)) if t else 0.0 for t in texts]
        new = [pa.array([len(w) for w in found], pa.int64()), pa.array(counts, pa.int64()), pa.array([c / len(w) if w else 0.0 for c, w in zip(counts, found, strict=True)], pa.float64()), pa.array(lines, pa.float64()), pa.array(sentences, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.select(keep).columns, *new], names=[*keep, "n_words", "repeated", "share", "line_share", "sentence_share"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_words bigint, repeated bigint, share double, line_share double, sentence_share double"])
    return map_batches(df.select(*dict.fromkeys([*keep, text])), measure, schema)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of at least 16 words of which at least 30 in 100 are repeated."""
    return repetitive(table(spark, sf_dir, "documents"), "text", ["doc_id"]).distinct()


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition(table(spark, sf_dir, "documents"), "text", ["doc_id"])
