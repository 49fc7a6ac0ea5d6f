"""Typed decisions: adapters over scores, an interaction head over vectors, class prototypes, and their fitting."""

from __future__ import annotations

import json
import pickle
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import entities, normalize, tokens
from quillmesh.functions import unicode as uni
from quillmesh.functions.lazy import arrow
from quillmesh.operators.measures import softmax

# Names of the message features of a decision, in order.
FUSION = [
    "language_top_probability", "language_candidate_count", "lexicon_coverage", "token_count", "char_length", "digit_ratio", "punctuation_ratio", "uppercase_ratio", "script_count", "mixed_scripts", "confusable_count", "suspicious_unicode_score",
    "invisible_character_count", "bidirectional_control_count", "obfuscation_score", "leet_score", "homoglyph_score", "repetition_score", "fragmentation_score", "rebus_top_score", "rebus_candidate_count", "entity_count", "url_email_count", "emoji_count", "symbol_count",
]
MOST_CANDIDATES, STATE_CHARS, ACCEPT = 64, 8192, 0.5


def fusion(c: Column, given: dict[str, Column] | None = None) -> Column:
    """The message features as a map; those that need a language, a lexicon or readings come from ``given``, else are 0."""
    from quillmesh.functions import tables as T

    n, a, o = F.greatest(F.length(c), F.lit(1)), F.greatest(uni.letters(c), F.lit(1)), uni.obfuscation(c)
    urls = F.size(entities.found(c, entities.URL)) + F.size(entities.found(c, entities.EMAIL))
    own = {
        "token_count": F.size(tokens.words(c)), "char_length": F.length(c), "digit_ratio": uni.digits(c) / n, "punctuation_ratio": F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]")) / n, "uppercase_ratio": uni.uppercase(c) / a,
        "script_count": F.size(uni.scripts(c)), "mixed_scripts": uni.mixed_scripts(c).cast("double"), "confusable_count": uni.confusables(c), "suspicious_unicode_score": F.least(F.lit(1.0), uni.suspicious_score(c)),
        "invisible_character_count": uni.count_of(c, T.INVISIBLE), "bidirectional_control_count": uni.count_of(c, T.BIDI), "obfuscation_score": o["score"], "leet_score": o["leet_score"], "homoglyph_score": o["homoglyph_score"],
        "repetition_score": o["repetition_score"], "fragmentation_score": o["fragmentation_score"], "url_email_count": urls, "emoji_count": uni.emoji(c), "symbol_count": F.regexp_count(c, F.lit(r"\p{S}")),
    } | (given or {})
    return F.create_map(*(x for k in FUSION for x in (F.lit(k), F.coalesce(F.nanvl(own.get(k, F.lit(0.0)).cast("double"), F.lit(0.0)), F.lit(0.0)))))


def explode_choices(requests: DataFrame) -> DataFrame:
    """(id, state, label, description) of choice questions; criteria of more than the limit are refused."""
    many = requests.where(F.size("criteria") > MOST_CANDIDATES).limit(1).count()
    if many:
        raise ValueError(f"a question has at most {MOST_CANDIDATES} candidates")
    return requests.select("id", "state", F.explode("criteria").alias("label", "description"))


def decided(scored: DataFrame, accept: float = ACCEPT, temperature: float = 1.0) -> DataFrame:
    """(id, label, confidence, probabilities, decision) from scores (id, label, score); ties go to the first label."""
    rows = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("s"))  # at most MOST_CANDIDATES each
    p = softmax(F.transform("s", lambda e: e["score"].cast("double")), temperature)
    rows = rows.select("id", F.transform("s", lambda e: e["label"]).alias("labels"), p.alias("p"))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return rows.select("id", F.element_at("labels", best).alias("label"), F.array_max("p").alias("confidence"), F.map_from_arrays("labels", "p").alias("probabilities"), F.when(F.array_max("p") >= accept, "accept").otherwise("escalate").alias("decision"))


def similarity_decisions(requests: DataFrame, dims: int = 256, temperature: float = 0.1) -> DataFrame:
    """Choice questions by the cosine of hashed vectors of state and description."""
    from quillmesh.operators.retrieval import cosine

    rows = explode_choices(requests)
    v = rows.select("id", "label", tokens.embedding_of(f"wordhash:{dims}")(F.col("state")).alias("x"), tokens.embedding_of(f"wordhash:{dims}")(F.concat_ws(" ", "label", "description")).alias("y"))
    return decided(v.select("id", "label", cosine(F.col("x"), F.col("y")).alias("score")), temperature=temperature)


# ------------------------------------------------------------------------------------------------ interaction head


def interaction(state: np.ndarray, candidate: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """Features of pairs of vectors: both, their product, their difference, and the message's own."""
    if state.shape != candidate.shape or not np.isfinite(state).all() or not np.isfinite(candidate).all():
        raise ValueError("vectors must be finite and of one length")
    parts = [state, candidate, state * candidate, np.abs(state - candidate)]
    return np.concatenate(parts + ([extra] if extra is not None else []), axis=-1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))


@dataclass
class Head:
    """Two layers that score a candidate from its interaction features."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @classmethod
    def fresh(cls, inputs: int, hidden: int = 32, seed: int = 1) -> Head:
        rng = np.random.default_rng(seed)
        edge1, edge2 = np.sqrt(6 / (inputs + hidden)), np.sqrt(6 / (hidden + 1))
        return cls(rng.uniform(-edge1, edge1, (hidden, inputs)), np.zeros(hidden), rng.uniform(-edge2, edge2, hidden), 0.0)

    def score(self, features: np.ndarray) -> np.ndarray:
        return gelu(features @ self.w1.T + self.b1) @ self.w2 + self.b2

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()} | {"artifact_version": 1})

    @classmethod
    def from_json(cls, text: str) -> Head:
        raw = json.loads(text)
        if raw.pop("artifact_version", None) != 1:
            raise ValueError("unknown version of an interaction head")
        head = cls(*(np.array(raw[k], float) for k in ("w1", "b1", "w2")), float(raw["b2"]), float(raw["temperature"]))
        if head.w1.shape != (len(head.b1), head.w1.shape[1]) or head.w2.shape != head.b1.shape or not all(np.isfinite(x).all() for x in (head.w1, head.b1, head.w2)):
            raise ValueError("an interaction head must be finite and of matching sizes")
        return head


def fit_head(examples: list[tuple[np.ndarray, int]], hidden: int = 32, epochs: int = 30, rate: float = 5e-3, l2: float = 1e-4, seed: int = 1) -> Head:
    """A head by Adam on (features of all candidates, gold place); the examples are a bounded labelled sample."""
    head = Head.fresh(examples[0][0].shape[1], hidden, seed)
    names = ("w1", "b1", "w2")
    m, v = ({k: np.zeros_like(getattr(head, k)) for k in names} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            x, gold = examples[i]
            z = x @ head.w1.T + head.b1
            h = gelu(z)
            s = h @ head.w2 + head.b2
            p = np.exp(s - s.max())
            p /= p.sum()
            p[gold] -= 1
            slope = (gelu(z + 1e-4) - gelu(z - 1e-4)) / 2e-4
            back = p[:, None] * head.w2[None, :] * slope
            grads = {"w1": back.T @ x + l2 * head.w1, "b1": back.sum(axis=0), "w2": p @ h + l2 * head.w2}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(head, k, getattr(head, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return head


def head_decisions(requests: DataFrame, head: Head, dims: int) -> DataFrame:
    """Choice questions by an interaction head over hashed vectors."""
    sent, held = pickle.dumps(head), []

    def run(state: pd.Series, candidate: pd.Series) -> pd.Series:
        if not held:
            held.append(pickle.loads(sent))
        x, y = tokens.word_hash_texts(state.tolist(), dims), tokens.word_hash_texts(candidate.tolist(), dims)
        return pd.Series(held[0].score(interaction(x, y)))

    run.__annotations__ = {"state": pd.Series, "candidate": pd.Series, "return": pd.Series}
    rows = explode_choices(requests)
    return decided(rows.select("id", "label", arrow("double")(run)(F.col("state"), F.concat_ws(" ", "label", "description")).alias("score")), temperature=head.temperature)


def prototypes(vectors: DataFrame, descriptions: DataFrame | None = None, blend: float = 0.5) -> DataFrame:
    """(label, prototype): mean direction of labelled vectors (label, vector), blended with those of descriptions."""
    if not 0 <= blend <= 1:
        raise ValueError("blend must lie within 0 and 1")
    e = vectors.select("label", F.posexplode("vector").alias("i", "v"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    unit = lambda c: F.transform(c, lambda v: v / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12)))
    rows = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p")).select("label", unit(F.col("p")).alias("prototype"))
    if descriptions is None:
        return rows
    both = rows.join(descriptions.select("label", F.col("vector").alias("d")), "label", "left")
    mixed = F.when(F.col("d").isNull(), F.col("prototype")).otherwise(F.zip_with("prototype", "d", lambda a, b: (1 - blend) * a + blend * b.cast("double")))
    return both.select("label", mixed.alias("p")).select("label", unit(F.col("p")).alias("prototype"))


def view_for(c: Column) -> Column:
    """The text that a decision looks at: normalized, up to the limit."""
    return F.left(normalize.normalized(c), F.lit(STATE_CHARS))
