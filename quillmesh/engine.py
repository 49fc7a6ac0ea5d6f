"""The engine: one object whose methods take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh import __version__
from quillmesh.config import EngineConfig
from quillmesh.functions import entities, normalize, points, rebus, sounds, tokens
from quillmesh.functions import tables as T
from quillmesh.functions import unicode as uni
from quillmesh.operators import decide, evidence, retrieval, scoring
from quillmesh.runtime import cut, spread
from quillmesh.sources import packs

SCHEMA_VERSION = 2
CHANNELS = ("unicode", "lexical", "symbolic", "rebus", "phonetic", "semantic", "transliteration", "entities", "obfuscation")


class TextEngine:
    """Analysis, comparison, detection, retrieval and decisions under one configuration.

    Heavy channels are columns of their own, so a query that selects few of them computes few. ``packs_table`` may add a
    table of language packs to the packs of the folder.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, resources: str = packs.EMBEDDED, packs_table: DataFrame | None = None):
        self.spark, self.config, self.resources = spark, config or EngineConfig(), resources
        self.lexicon = packs.load(resources) if packs_table is None else packs.from_table(packs_table, resources)
        c = self.config
        self.search = rebus.Search(c.beam, c.candidates, c.segments, c.symbol_readings, c.strong_gap)
        self.settings = evidence.Settings(self.search, c.entities, c.entity_chars, c.rebus)

    # analysis

    def channels(self) -> tuple[str, ...]:
        """The channels that the configuration switches on."""
        off = {name for name, on in (("semantic", self.config.semantic), ("phonetic", self.config.phonetic), ("rebus", self.config.rebus)) if not on}
        return tuple(c for c in CHANNELS if c not in off)

    def analyze(self, messages: DataFrame, text: str = "text", channels: tuple[str, ...] | None = None) -> DataFrame:
        """Messages with their evidence columns, of ``channels`` or those that are switched on. Texts over the limit get
        ``too_long`` and null evidence."""
        channels = self.channels() if channels is None else channels
        unknown = set(channels) - set(CHANNELS)
        if unknown:
            raise ValueError(f"no such channels: {sorted(unknown)}")
        c = F.when(F.length(text) <= self.config.input_chars, F.col(text))
        # the ones that need Python read one column that stands before them
        out = messages.withColumn("too_long", F.coalesce(F.length(text) > self.config.input_chars, F.lit(False))).withColumn("_t", c)
        t = F.col("_t")
        out = out.withColumn("normalized", normalize.normalized(t)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
        add = {
            "unicode": lambda: {"scripts": uni.scripts(t), "suspicious_unicode_score": points.suspicion(t), "skeleton": normalize.skeleton(t)},
            "lexical": lambda: {"segments": F.slice(tokens.segments(t), 1, self.config.segments), "char_features": uni.char_features(t), "simhash": tokens.simhash(tokens.words(t))},
            "symbolic": lambda: {"symbols": F.regexp_extract_all(t, F.lit(r"([\p{S}\p{N}])"), 1)},
            "rebus": lambda: {"rebus_candidates": rebus.decode(t, self.lexicon, self.search)},
            "phonetic": lambda: {"phonetic": sounds.phonemize(t, F.lit("und"))},
            "semantic": lambda: {"embedding": tokens.feature_hash(t)},
            "transliteration": lambda: {"transliterations": sounds.views(t)},
            "entities": lambda: {"entities": entities.entities_within(t, self.config.entities, self.config.entity_chars)},
            "obfuscation": lambda: {"obfuscation": uni.obfuscation(t)},
        }
        for channel in channels:
            for name, column in add[channel]().items():
                out = out.withColumn(name, column)
        return out.drop("_t")

    def without_entities(self, messages: DataFrame, text: str = "text") -> DataFrame:
        return self.analyze(messages, text, tuple(c for c in self.channels() if c != "entities"))

    def without_transliteration(self, messages: DataFrame, text: str = "text") -> DataFrame:
        return self.analyze(messages, text, tuple(c for c in self.channels() if c != "transliteration"))

    def decode(self, messages: DataFrame, text: str = "text") -> DataFrame:
        """One row for each reading of each message."""
        rows = messages.select("id", F.posexplode(rebus.decode(F.col(text), self.lexicon, self.search)).alias("rank", "r"))
        return rows.select("id", "rank", "r.*")

    # pairs

    def compare(self, pairs: DataFrame, profile: str | None = None, between: bool = True) -> DataFrame:
        """Pairs (id, a, b) with channels, the features between them, the blended score and the trained one; without ``between``
        with the channels and the blended score alone.

        Weights are those of ``profile``, else of the configuration; a channel that is missing, or that is switched off,
        takes its weight along. Pairs with a null text, or one over the limit, get nulls.
        """
        both = evidence.with_evidence(pairs, "a", "b", self.lexicon, self.settings, self.config.input_chars, between)
        weights = dict(self.config.weights if profile is None else T.PROFILES[profile])
        scored = both.withColumn("score", F.when(F.col("lexical").isNotNull(), scoring.combine({k: F.col(k) for k in T.CHANNELS}, weights)))
        return scored if not between else scored.withColumn("trained", F.when(F.col("lexical").isNotNull(), scoring.pair_score()))

    def duplicates(self, pairs: DataFrame, mode: str = "combined", threshold: float | None = None, between: bool = True) -> DataFrame:
        """:meth:`compare` with whether each pair is a duplicate, and why. No verdict looks at the features between the channels,
        which ``between`` leaves out."""
        return scoring.judged(self.compare(pairs, "duplicate", between), self.config.duplicate_threshold if threshold is None else min(1.0, max(0.0, threshold)), mode)

    # detection

    def detect_spam(self, messages: DataFrame, text: str = "text", registry: DataFrame | None = None) -> DataFrame:
        """Messages with the spam features, the trained and the untrained probability, labels and reasons."""
        f = scoring.spam_features(messages, text, self.lexicon, self.search, registry)
        return f.withColumn("probability", scoring.spam_trained()).withColumn("heuristic", scoring.spam_heuristic()).withColumn("spam", F.col("probability") >= T.SPAM_THRESHOLD).withColumn("labels", scoring.spam_labels()).withColumn("reasons", scoring.spam_reasons())

    def match_patterns(self, messages: DataFrame, registry: DataFrame) -> DataFrame:
        """Messages against a registry; a pattern without a threshold of its own has that of the configuration."""
        return scoring.match_patterns(messages, registry.withColumn("threshold", F.coalesce("threshold", F.lit(self.config.pattern_threshold))))

    # retrieval

    def _candidates(self, store: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        """(query, id, a, b) of the documents that retrieval brings for each query. Texts over the limit take no part."""
        store, queries = (df.where(F.length("text").between(1, self.config.input_chars)).select("id", "text") for df in (store, queries))
        found = retrieval.candidates(retrieval.postings(store), queries, self.config.per_channel)
        ranked = cut(retrieval.preranked(found, queries, store, max(most, self.config.search_candidates)).select("query", "id"))
        return ranked.join(queries.select(F.col("id").alias("query"), F.col("text").alias("a")), "query").join(store.select("id", F.col("text").alias("b")), "id")

    def find_similar(self, store: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
        """(query, id, score, rank): the ``most`` best documents (id, text) of a store for each query (id, text)."""
        if most < 1:
            return self.spark.createDataFrame([], "query string, id string, score double, rank int")
        # pairs of one query go to one task as far as they fit, so its text is read once
        pairs = spread(self._candidates(store, queries, most), "query", "id").sortWithinPartitions("query")
        scored = self.compare(pairs).select("query", "id", "score")
        return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)

    def find_duplicates(self, store: DataFrame, queries: DataFrame, threshold: float | None = None, mode: str = "combined") -> DataFrame:
        """(query, id, duplicate_score, reason): the documents of a store that are duplicates of a query."""
        pairs = spread(self._candidates(store, queries, 1), "query", "id").sortWithinPartitions("query")
        return self.duplicates(pairs, mode, threshold, between=False).where("duplicate").select("query", "id", "duplicate_score", "reason")

    # decisions

    def decide(self, requests: DataFrame, head: decide.Head | None = None, dims: int = 256) -> DataFrame:
        """Choice questions (id, state, criteria) decided by a fitted head, else by similarity."""
        return decide.head_decisions(requests, head, dims) if head else decide.similarity_decisions(requests, dims)

    # what there is

    def diagnostics(self) -> DataFrame:
        """One row for each provider: its quality and what it falls back to."""
        state = lambda on: "Basic" if on else "Off"
        rows = [
            ("rebus", state(self.config.rebus), f"beam of {self.config.beam}"), ("phonetic", state(self.config.phonetic), "rules for Latin script"), ("semantic", state(self.config.semantic), "feature hashes"),
            ("lexicon", "Basic", f"{sum(map(len, self.lexicon.words.values()))} words"), ("symbols", "Basic", f"{len(self.lexicon.symbols)} tokens"), ("g2p", "Basic", "rules for Latin script"), ("transliteration", "Basic", "letter tables"),
            ("embedding", "Basic", "feature hashes"), ("spam", "Production", "trained weights"), ("generative", "Unavailable", "no network"), ("version", "Production", __version__),
        ]
        return self.spark.createDataFrame(rows, "provider string, quality string, note string")

    def resource_manifest(self) -> DataFrame:
        return packs.manifest(self.spark, self.resources)
