"""Queries over texts: normalization, characters, tokens, distances, entities, sounds, lexicon and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import distance, entities, languages, normalize, points, rebus, sounds, tokens
from quillmesh.functions import tables as T
from quillmesh.functions import unicode as uni
from quillmesh.plans.registry import Registry
from quillmesh.runtime import even, table
from quillmesh.sources import packs

query = Registry()
_BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{2028}\x{2029}\x0B]"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query(r"""SELECT coalesce(lang, '?') AS lang, count(*) AS docs, sum(length(coalesce(text, ''))) AS chars,
    sum(len(regexp_extract_all(coalesce(text, ''), '\p{L}'))) AS letters, sum(len(regexp_extract_all(coalesce(text, ''), '\p{N}'))) AS digits
    FROM documents GROUP BY 1""")
def norm_profile_by_lang(spark, sf):
    """Length, letters and digits of the documents by language label."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        table(spark, sf, "documents")
        .select(F.coalesce("lang", F.lit("?")).alias("lang"), F.length(text).alias("n"), F.regexp_count(text, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(text, F.lit(r"\p{N}")).alias("digits"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chars"), F.sum("letters").alias("letters"), F.sum("digits").alias("digits"))
    )


@query("SELECT doc_id, translate(text, '0123456789@$!', 'oizeasgtbgasi') AS leet FROM documents")
def norm_leet(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.leet(F.col("text")).alias("leet"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{L}[0-9]|[0-9]\p{L}') AS leet FROM documents")
def norm_detect_leet(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.has_leet(F.col("text")).alias("leet"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_BLANKS}+', ' ', 'g'), '^ | $', '', 'g') AS even FROM documents")
def norm_whitespace(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.blanks(F.col("text")).alias("even"))


@query(f"SELECT doc_id, regexp_replace(text, '{_BLANKS}+', '', 'g') AS tight FROM documents")
def norm_compact(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.compact(F.col("text")).alias("tight"))


_COLLAPSE = r"""
    WITH c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
    r AS (SELECT doc_id, ch, min(i) AS i, count(*) AS n FROM g GROUP BY doc_id, ch, run),
    k AS (SELECT doc_id, i, CASE WHEN n >= 3 AND regexp_matches(ch, '[\p{L}\p{N}!?.]') THEN ch ELSE repeat(ch, n) END AS part FROM r)"""


@query(_COLLAPSE + " SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN s.collapsed ELSE d.text END AS collapsed FROM documents d LEFT JOIN (SELECT doc_id, string_agg(part, '' ORDER BY i) AS collapsed FROM k GROUP BY doc_id) s USING (doc_id)")
def norm_collapse_repetition(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.collapse(F.col("text")).alias("collapsed"))


@query(_COLLAPSE + " SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN length(d.text) = 0 THEN 0.0 ELSE round((length(d.text) - s.n)::DOUBLE / length(d.text), 6) END AS ratio FROM documents d LEFT JOIN (SELECT doc_id, sum(length(part)) AS n FROM k GROUP BY doc_id) s USING (doc_id)")
def norm_repetition_ratio(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(normalize.repetition_ratio(F.col("text")), 6).alias("ratio"))


@query(f"SELECT doc_id, translate(text, '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}') AS mapped FROM documents")
def norm_confusable_map(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.confusable(F.col("text")).alias("mapped"))


@query(r"SELECT doc_id, lower(text) AS folded FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')")
def norm_casefold_ascii(spark, sf):
    return _docs(spark, sf).where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", normalize.fold(F.col("text")).alias("folded"))


@query()
def norm_casefold_all(spark, sf):
    """The folding of all documents; :func:`norm_casefold_ascii` has those on which DuckDB's ``lower`` agrees."""
    return _docs(spark, sf).select("doc_id", normalize.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, nfc_normalize(text) AS nfc FROM documents")
def norm_nfc(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.nfc(F.col("text")).alias("nfc"))


@query()
def norm_nfkc(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.nfkc(F.col("text")).alias("nfkc"))


@query(r"SELECT doc_id, strip_accents(lower(text)) AS bare FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7Fàâäáãåçèéêëìíîïñòóôõöùúûü¿]')")
def norm_strip_diacritics(spark, sf):
    return _docs(spark, sf).where(~F.col("text").rlike("[^\\x00-\\x7Fàâäáãåçèéêëìíîïñòóôõöùúûü¿]")).select("doc_id", normalize.strip_marks(normalize.fold(F.col("text"))).alias("bare"))


@query()
def norm_strip_diacritics_all(spark, sf):
    """All documents; :func:`norm_strip_diacritics` has those on which DuckDB's ``strip_accents`` agrees."""
    return _docs(spark, sf).select("doc_id", normalize.strip_marks(normalize.fold(F.col("text"))).alias("bare"))


@query()
def norm_skeleton(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.skeleton(F.col("text")).alias("skeleton"))


@query()
def norm_pipeline(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.normalized(F.col("text")).alias("normalized"))


@query()
def norm_views(spark, sf):
    return _docs(spark, sf).select("doc_id", F.to_json(normalize.views(F.col("text"))).alias("views"))


@query()
def norm_transformations(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(normalize.transformations(F.col("text"))).alias("t")).select("doc_id", "t.transformation_type", F.length("t.replacement").alias("n"))


@query(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS folded FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')")
def norm_alnum_fold(spark, sf):
    return _docs(spark, sf).where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", normalize.letters_only(normalize.fold(F.col("text"))).alias("folded"))


@query()
def norm_alnum_fold_all(spark, sf):
    """All documents; :func:`norm_alnum_fold` has those in ASCII, on which the SQL agrees."""
    return _docs(spark, sf).select("doc_id", normalize.letters_only(normalize.fold(F.col("text"))).alias("folded"))


@query("SELECT doc_id, left(text, 8192) AS head, length(text) > 8192 AS too_long FROM documents")
def norm_truncate(spark, sf):
    """The head that an analysis may take, and whether a text is over the limit."""
    return _docs(spark, sf).select("doc_id", normalize.truncate(F.col("text"), T.INPUT_CHARS).alias("head"), (F.length("text") > T.INPUT_CHARS).alias("too_long"))


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def norm_natural_order(spark, sf):
    """Names in natural order: numbers inside them by value. The place is a global rank over a range-sorted table."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name", normalize.natural(F.col("c_name")).alias("k"))
    parts = df.repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    parts = parts.withColumn("i", F.col("i") - F.shiftleft(F.col("p").cast("long"), 33))
    from pyspark.sql import Window as W

    counts = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("p", "before")), "p").select("c_custkey", "c_name", (F.col("before") + F.col("i") + 1).alias("place"))


# ------------------------------------------------------------------------------------------------ characters


@query(r"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'Cyrillic' END, CASE WHEN regexp_matches(text, '\p{Greek}') THEN 'Greek' END,
    CASE WHEN regexp_matches(text, '\p{Han}') THEN 'Han' END, CASE WHEN regexp_matches(text, '\p{Hangul}') THEN 'Hangul' END, CASE WHEN regexp_matches(text, '\p{Hiragana}') THEN 'Hiragana' END,
    CASE WHEN regexp_matches(text, '\p{Katakana}') THEN 'Katakana' END, CASE WHEN regexp_matches(text, '\p{Latin}') THEN 'Latin' END], lambda x: x IS NOT NULL) AS scripts FROM documents""")
def uni_scripts(spark, sf):
    return _docs(spark, sf).select("doc_id", uni.scripts(F.col("text")).alias("scripts"))


@query(r"""SELECT doc_id, length(text) AS length, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{N}')) AS digits,
    len(regexp_extract_all(text, '[ \t\n\r\f\x0B]')) AS whitespace, len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS punctuation FROM documents""")
def char_features(spark, sf):
    return _docs(spark, sf).select("doc_id", uni.char_features(F.col("text")).alias("f")).select("doc_id", "f.length", "f.letters", "f.digits", "f.whitespace", "f.punctuation")


@query(r"""SELECT doc_id, regexp_matches(text, '[!?.]{3,}') AS flooded,
    CASE WHEN text IS NULL THEN 0.0 WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')), 6) END AS upper_ratio FROM documents WHERE text IS NOT NULL""")
def obf_flood_and_upper(spark, sf):
    c = F.col("text")
    return _docs(spark, sf).where("text IS NOT NULL").select("doc_id", uni.flooded(c).alias("flooded"), F.round(uni.uppercase_ratio(c), 6).alias("upper_ratio"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
    n AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM n GROUP BY 1)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id""")
def feat_entropy(spark, sf):
    return even(_docs(spark, sf).where(F.length("text") > 0)).select("doc_id", F.round(uni.entropy(F.col("text")), 6).alias("entropy"))


_INVISIBLE_SQL = r"[\x{00AD}\x{061C}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{_INVISIBLE_SQL}')) AS invisible, len(regexp_extract_all(text, '[\x{{200C}}\x{{200D}}]')) AS joiners,
    len(regexp_extract_all(text, '[\x{{FE00}}-\x{{FE0F}}]')) AS selectors, len(regexp_extract_all(text, '[\x{{FF01}}-\x{{FF60}}\x{{FFE0}}-\x{{FFEE}}]')) AS full_width,
    len(regexp_extract_all(text, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]')) AS emoji FROM documents""")
def uni_classes(spark, sf):
    c = F.col("text")
    return _docs(spark, sf).select("doc_id", uni.count_of(c, T.INVISIBLE).alias("invisible"), uni.count_of(c, T.JOINERS).alias("joiners"), uni.count_of(c, T.SELECTORS).alias("selectors"), uni.count_of(c, T.FULL_WIDTH).alias("full_width"), uni.emoji(c).alias("emoji"))


@query()
def uni_suspicious_score(spark, sf):
    c = F.col("text")
    return even(_docs(spark, sf).where("text IS NOT NULL")).select("doc_id", F.round(points.suspicion(c), 6).alias("score"), points.malformed(c).alias("malformed"))


@query()
def obf_features(spark, sf):
    return even(_docs(spark, sf).where("text IS NOT NULL")).select("doc_id", uni.obfuscation(F.col("text")).alias("o")).select("doc_id", "o.detected", F.round("o.score", 6).alias("score"), F.array_join("o.flags", ",").alias("flags"))


_HITS = "".join(ch for ch in T.CONFUSABLE_FROM if not ("０" <= ch <= "ｚ") and ch != "Ⅰ")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[{_HITS}]')) AS hits FROM documents")
def vis_confusable_hits(spark, sf):
    return _docs(spark, sf).select("doc_id", uni.confusables(F.col("text")).alias("hits"))


@query()
def vis_similarity(spark, sf):
    pairs = table(spark, sf, "evaluation_case").select("id", "a", "b").dropDuplicates(["id"])
    return pairs.select("id", F.round(distance.character(normalize.skeleton(F.col("a")), normalize.skeleton(F.col("b"))), 6).alias("visual"))


# ------------------------------------------------------------------------------------------------ tokens


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w GROUP BY 1""")
def tok_word_counts(spark, sf):
    return _docs(spark, sf).select(F.explode(tokens.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query()
def tok_segment_types(spark, sf):
    """Segments of whole documents by type."""
    return tokens.segment_counts(even(_docs(spark, sf)), "text")


@query()
def tok_token_table(spark, sf):
    """One row for each segment, offsets in bytes."""
    return tokens.segment_table(even(_docs(spark, sf)), "doc_id", "text")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents)
    SELECT word, CASE WHEN length(word) > 5 THEN regexp_replace(word, '^(.{3,}?)(mente|iendo|ación|ción|cion|ando|ing|ed|es|s)$', '\1') ELSE word END AS lemma FROM w""")
def tok_lemmas(spark, sf):
    words = _docs(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("word")).distinct()
    w = F.col("word")
    return words.select("word", F.when(F.length(w) > 5, F.regexp_replace(w, "^(.{3,}?)(mente|iendo|ación|ción|cion|ando|ing|ed|es|s)$", "$1")).otherwise(w).alias("lemma"))


@query(r"""WITH s AS (SELECT DISTINCT language, unnest(stop_words) AS word FROM language_pack),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents)
    SELECT doc_id, language, count(*) AS n FROM w JOIN s USING (word) GROUP BY ALL""")
def tok_stop_words(spark, sf):
    stop = table(spark, sf, "language_pack").select("language", F.explode("stop_words").alias("word")).distinct()
    words = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("word"))
    return words.join(stop, "word").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
    g AS (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w WHERE len(ws) >= 2)
    SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ng_word_bigrams(spark, sf):
    grams = tokens.word_ngrams(F.col("ws"), 2)
    return _docs(spark, sf).select(tokens.words(F.col("text")).alias("ws")).where("ws IS NOT NULL").select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM documents WHERE length(text) >= 3)
    SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ng_char_trigrams(spark, sf):
    return _docs(spark, sf).where(F.length("text") >= 3).select(F.explode(tokens.char_ngrams(F.col("text"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents),
    tf AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), df AS (SELECT word, count(*) AS d FROM tf GROUP BY 1), total AS (SELECT count(DISTINCT doc_id) AS t FROM w),
    s AS (SELECT doc_id, word, round(n * ln(1 + t / d), 6) AS score FROM tf JOIN df USING (word), total)
    SELECT doc_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS k FROM s) WHERE k <= 5""")
def sim_tfidf_terms(spark, sf):
    """The five words of each document with the highest weight."""
    from pyspark.sql import Window as W

    words = _docs(spark, sf).select("doc_id", F.explode(tokens.words(F.col("text"))).alias("word"))
    tf = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("d"))
    total = words.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("t"))
    scored = tf.join(df, "word").crossJoin(F.broadcast(total)).select("doc_id", "word", F.round(F.col("n") * F.ln(1 + F.col("t") / F.col("d")), 6).alias("score"))
    return scored.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "word"))).where("k <= 5").drop("k")


_SETS = r"""WITH p AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}]+'))) AS x, list_sort(list_distinct(regexp_extract_all(lower(b), '[\p{L}\p{N}]+'))) AS y FROM evaluation_case WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(_SETS + " SELECT id, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM p")
def sim_jaccard_pairs(spark, sf):
    pairs = table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b").distinct()
    return pairs.select("id", F.round(distance.jaccard(F.array_distinct(tokens.words(F.col("a"))), F.array_distinct(tokens.words(F.col("b")))), 6).alias("jaccard")).distinct()


_FNV = """list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(0, octet_length(encode(word))), lambda i: (16 * (strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 2, 1)) - 1)::UBIGINT)),
    lambda a, b: ((xor(a, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"""


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents), h AS (SELECT word, {_FNV} AS h FROM (SELECT DISTINCT word FROM w)),
    v AS (SELECT doc_id, bit, sum(2 * ((h // (2::UHUGEINT ** bit)::UHUGEINT) % 2)::INT - 1) AS votes FROM w JOIN h USING (word), (SELECT unnest(range(64)) AS bit) GROUP BY ALL),
    s AS (SELECT doc_id, sum(CASE WHEN votes > 0 THEN (2::HUGEINT ** bit)::HUGEINT ELSE 0 END) AS u FROM v GROUP BY 1)
    SELECT doc_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END)::BIGINT AS simhash FROM documents LEFT JOIN s USING (doc_id)""")
def hash_simhash(spark, sf):
    return _docs(spark, sf).select("doc_id", tokens.simhash(tokens.words(F.col("text"))).alias("simhash"))


@query("SELECT doc_id, list_transform(range(32), lambda i: 4294967295) AS signature FROM documents")
def hash_minhash_compat(spark, sf):
    """The saturating signature, which is the same for practically every text."""
    return _docs(spark, sf).select("doc_id", tokens.minhash_compat(F.coalesce(tokens.words(F.col("text")), F.array().cast("array<string>"))).alias("signature"))


@query()
def hash_minhash_similarity(spark, sf):
    pairs = table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b").dropDuplicates(["id"])
    return pairs.select("id", F.round(tokens.signature_similarity(tokens.minhash(tokens.words(F.col("a"))), tokens.minhash(tokens.words(F.col("b")))), 6).alias("similarity"))


@query()
def emb_feature_hash(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokens.feature_hash(F.col("text")).alias("vector"))


@query()
def emb_word_hash(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tokens.embedding_of("wordhash:128")(F.col("text")).alias("vector"))


# ------------------------------------------------------------------------------------------------ distances

_NAMES = "FROM (SELECT a.p_partkey AS x, b.p_partkey AS y, a.p_name AS s, b.p_name AS t FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names of parts alike in brand, type and size."""
    part = table(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("x"), F.col("p_name").alias("s"), "p_brand", "p_type", "p_size")
    b = part.select(F.col("p_partkey").alias("y"), F.col("p_name").alias("t"), "p_brand", "p_type", "p_size")
    return a.join(b, ["p_brand", "p_type", "p_size"]).where("x < y").select("x", "y", "s", "t")


@query(f"SELECT x, y, levenshtein(s, t) AS edits, round(1 - levenshtein(s, t) / greatest(length(s), length(t), 1), 6) AS similarity {_NAMES}")
def dist_levenshtein(spark, sf):
    return _names(spark, sf).select("x", "y", F.levenshtein("s", "t").alias("edits"), F.round(distance.edit_similarity(F.col("s"), F.col("t")), 6).alias("similarity"))


@query()
def dist_osa(spark, sf):
    return _names(spark, sf).select("x", "y", distance.osa(F.col("s"), F.col("t")).alias("edits"))


@query()
def sim_jaro(spark, sf):
    return _names(spark, sf).select("x", "y", F.round(distance.jaro(F.col("s"), F.col("t")), 6).alias("jaro"))


@query()
def sim_jaro_winkler(spark, sf):
    return _names(spark, sf).select("x", "y", F.round(distance.jaro_winkler(F.col("s"), F.col("t")), 6).alias("jaro_winkler"))


@query(f"""WITH n AS (SELECT * {_NAMES}), a AS (SELECT x, y, g, count(*) AS n FROM (SELECT x, y, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM n) GROUP BY ALL),
    b AS (SELECT x, y, g, count(*) AS n FROM (SELECT x, y, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM n) GROUP BY ALL),
    m AS (SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS lo, sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))) AS hi FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y AND a.g = b.g GROUP BY ALL)
    SELECT x, y, round(lo / hi, 6) AS bigrams FROM m""")
def sim_ngram(spark, sf):
    return _names(spark, sf).select("x", "y", F.round(distance.bigrams(F.col("s"), F.col("t")), 6).alias("bigrams"))


@query()
def sim_lcs(spark, sf):
    return _names(spark, sf).select("x", "y", distance.lcs(F.col("s"), F.col("t")).alias("lcs"))


@query()
def sim_character(spark, sf):
    return _names(spark, sf).select("x", "y", distance.character_parts(F.col("s"), F.col("t")).alias("c")).select("x", "y", *(F.round(f"c.{k}", 6).alias(k) for k in ("levenshtein", "damerau", "jaro", "jaro_winkler", "ngram", "lcs", "combined")))


# ------------------------------------------------------------------------------------------------ entities

for _kind, _pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9._%+-]*[A-Za-z0-9]\.[A-Za-z]{2,}"), ("date", entities.DATE_ISO), ("time", entities.TIME)):

    def _make(pattern: str):
        def run(spark, sf):
            return table(spark, sf, "spam_item").select("text").where("text IS NOT NULL").select(F.explode(entities.found(F.col("text"), pattern)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))

        return run

    query(f"WITH f AS (SELECT unnest(regexp_extract_all(text, '{_pattern}')) AS value FROM spam_item) SELECT value, count(*) AS n FROM f GROUP BY 1", f"ent_{_kind}")(_make(_pattern))


_PAID = "concat('paid ', CASE o_orderkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '€ ' ELSE '£' END, CAST(o_orderkey % 1000 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN concat('.', CAST(10 + o_custkey % 90 AS VARCHAR)) ELSE '' END, ' for ', CAST(o_custkey % 7 AS VARCHAR))"


@query(f"WITH f AS (SELECT unnest(regexp_extract_all({_PAID}, '{entities.AMOUNT}')) AS value FROM orders) SELECT value, count(*) AS n FROM f GROUP BY 1")
def ent_amount(spark, sf):
    """Amounts with a currency sign in a line for each order."""
    lines = table(spark, sf, "orders").select(F.expr(_PAID.replace("VARCHAR", "STRING")).alias("text"))
    return lines.select(F.explode(entities.found(F.col("text"), entities.AMOUNT)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query()
def ent_extract(spark, sf):
    found = table(spark, sf, "spam_item").select("id", "text").dropDuplicates(["id"]).select("id", F.explode(entities.entities(F.col("text"))).alias("e"))
    return found.select("id", "e.entity_type", "e.value", "e.start", "e.end", "e.confidence")


@query()
def ent_agreement_conflict(spark, sf):
    pairs = table(spark, sf, "evaluation_case").where("a IS NOT NULL AND b IS NOT NULL").select("id", "a", "b").dropDuplicates(["id"])
    e = pairs.select("id", entities.entities(F.col("a")).alias("x"), entities.entities(F.col("b")).alias("y"))
    return e.select("id", F.round(entities.agreement(F.col("x"), F.col("y")), 6).alias("agreement"), F.round(entities.conflict(F.col("x"), F.col("y")), 6).alias("conflict"))


# ------------------------------------------------------------------------------------------------ sounds


def _long_replace(sql: str) -> str:
    for ch, out in T.CYRILLIC_LONG.items():
        o = out.replace("'", "''")
        sql = f"replace(replace({sql}, '{ch}', '{o}'), '{ch.upper()}', '{o.capitalize()}')"
    return f"translate({sql}, '{T.CYRILLIC_FROM}{T.CYRILLIC_FROM.upper()}', '{T.CYRILLIC_TO}{T.CYRILLIC_TO.upper()}')"


@query(f"SELECT DISTINCT id, {_long_replace('text')} AS latin FROM spam_item WHERE regexp_matches(text, '[\\x{{0400}}-\\x{{052F}}]')")
def tr_cyrillic_to_latin(spark, sf):
    return table(spark, sf, "spam_item").where(F.col("text").rlike(r"[\x{400}-\x{52f}]")).select("id", sounds.cyrillic_to_latin(F.col("text")).alias("latin")).distinct()


@query()
def tr_views(spark, sf):
    return table(spark, sf, "spam_item").where("text IS NOT NULL").select("id", "text").dropDuplicates(["id"]).select("id", F.explode(sounds.views(F.col("text"))).alias("script", "view"))


@query("SELECT word, translate(word, 'aeiouy', '') AS bare FROM (SELECT DISTINCT unnest(entries).word AS word FROM language_pack)")
def tr_vowel_fold(spark, sf):
    return table(spark, sf, "language_pack").select(F.explode("entries").alias("e")).select(F.col("e.word").alias("word")).distinct().select("word", sounds.drop_vowels(F.col("word")).alias("bare"))


@query()
def pho_g2p(spark, sf):
    words = table(spark, sf, "language_pack").select("language", F.explode("entries").alias("e")).select("language", F.col("e.word").alias("word")).distinct()
    return words.select("language", "word", sounds.phonemize(F.col("word"), F.col("language")).alias("p")).select("language", "word", "p.ipa", "p.syllables", "p.confidence")


@query()
def pho_similarity(spark, sf):
    words = table(spark, sf, "language_pack").select("language", F.explode("entries").alias("e")).select("language", F.col("e.word").alias("word")).distinct()
    a, b = words.withColumnRenamed("word", "a"), words.withColumnRenamed("word", "b")
    pairs = a.join(b, ["language", *[]]).where("a < b AND left(a, 2) = left(b, 2)")
    return pairs.select("language", "a", "b", F.round(sounds.phonetic_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# ------------------------------------------------------------------------------------------------ lexicon and readings

_LEX = "WITH e AS (SELECT language, unnest(entries) AS e FROM language_pack), r AS (SELECT language, lower(e.word) AS word, e.weight AS weight, e.stop_word AS stop FROM e UNION ALL SELECT language, lower(unnest(stop_words)), 1.0, true FROM language_pack), l AS (SELECT language, word, max(weight) AS weight, bool_or(stop) AS stop_word FROM r GROUP BY ALL)"


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words by language from entries and stop words, merged."""
    pack = table(spark, sf, "language_pack")
    entries = pack.select("language", F.explode("entries").alias("e")).select("language", F.lower("e.word").alias("word"), F.col("e.weight").alias("weight"), F.col("e.stop_word").alias("stop"))
    stops = pack.select("language", F.explode("stop_words").alias("word")).select("language", F.lower("word").alias("word"), F.lit(1.0).alias("weight"), F.lit(True).alias("stop"))
    return entries.unionByName(stops).groupBy("language", "word").agg(F.max("weight").alias("weight"), F.bool_or("stop").alias("stop_word"))


@query(_LEX + " SELECT language, word, weight, stop_word FROM l")
def lex_rebuild(spark, sf):
    return _lexicon(spark, sf)


@query(_LEX + " SELECT word, count(DISTINCT language) AS languages, CASE WHEN count(DISTINCT language) = 1 THEN 'Unique' ELSE 'Ambiguous' END AS status FROM l GROUP BY word")
def lex_lookup(spark, sf):
    return _lexicon(spark, sf).groupBy("word").agg(F.countDistinct("language").alias("languages")).withColumn("status", F.when(F.col("languages") == 1, "Unique").otherwise("Ambiguous"))


@query(_LEX + r", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents) SELECT doc_id, round(avg(CASE WHEN k.word IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM w LEFT JOIN (SELECT DISTINCT word FROM l) k USING (word) GROUP BY doc_id")
def lex_coverage(spark, sf):
    known = _lexicon(spark, sf).select("word").distinct().withColumn("known", F.lit(1.0))
    words = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("word"))
    return words.join(known, "word", "left").groupBy("doc_id").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 6).alias("coverage"))


@query(_LEX + r""", w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents),
    v AS (SELECT doc_id, language, sum(1 + ln(1 + weight)) AS votes FROM w JOIN l USING (word) GROUP BY ALL)
    SELECT doc_id, language, round(votes / sum(votes) OVER (PARTITION BY doc_id), 6) AS probability FROM v""")
def lang_profile_detect(spark, sf):
    """Languages by the votes of known words, as shares."""
    from pyspark.sql import Window as W

    words = _docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("word"))
    votes = words.join(_lexicon(spark, sf), "word").groupBy("doc_id", "language").agg(F.sum(1 + F.log1p("weight")).alias("votes"))
    return votes.select("doc_id", "language", F.round(F.col("votes") / F.sum("votes").over(W.partitionBy("doc_id")), 6).alias("probability"))


_HINTS = ", ".join(f"('{script}', '{lang}', {p})" for script, own in languages.SCRIPT_HINTS.items() for lang, p in own.items())


@query(_LEX + rf""", d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS word FROM d),
    n AS (SELECT d.doc_id, count(w.word) AS words, count(k.word) AS matched FROM d LEFT JOIN w USING (doc_id) LEFT JOIN (SELECT DISTINCT word FROM l) k ON w.word = k.word GROUP BY 1),
    h AS (SELECT doc_id, language, sum(p) AS s FROM d, (VALUES {_HINTS}) AS t(script, language, p) WHERE regexp_matches(text, '\p{{' || script || '}}') GROUP BY ALL),
    v AS (SELECT doc_id, language, sum(1 + ln(1 + greatest(weight, {languages.LEAST_WEIGHT}))) AS s FROM w JOIN l USING (word) GROUP BY ALL UNION ALL SELECT doc_id, language, s * CASE WHEN matched = 0 THEN 1.0 ELSE {languages.HINT_BESIDE_WORDS} END FROM h JOIN n USING (doc_id)),
    a AS (SELECT doc_id, language, sum(s) AS s FROM v GROUP BY ALL UNION ALL SELECT doc_id, 'unknown', CASE WHEN doc_id NOT IN (SELECT doc_id FROM v) THEN 1.0 WHEN words = 0 THEN {languages.WORDLESS} ELSE {languages.UNKNOWN} * (1 - matched / words) END FROM n WHERE matched < words OR words = 0 OR doc_id NOT IN (SELECT doc_id FROM v))
    SELECT doc_id, language, round(s / sum(s) OVER (PARTITION BY doc_id), 6) AS probability FROM a""")
def lang_detect(spark, sf):
    """Languages of every document by known words, script hints, and a share for what is unknown."""
    from functools import reduce

    from pyspark.sql import Window as W

    docs, c = _docs(spark, sf).where("text IS NOT NULL"), F.col("text")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), 1)).alias("word"))
    lexicon = _lexicon(spark, sf)
    # matches are counted by document before anything is joined with the documents
    votes = words.join(lexicon, "word").groupBy("doc_id", "language").agg(F.sum(1 + F.log1p(F.greatest("weight", F.lit(languages.LEAST_WEIGHT)))).alias("s"))
    matched = words.join(lexicon.select("word").distinct(), "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"))
    base = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), 1)).alias("words"), uni.scripts(c).alias("scripts")).join(matched, "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    given = reduce(lambda m, x: m.when(F.col("script") == x[0], F.array(*(F.struct(F.lit(k).alias("language"), F.lit(p).alias("p")) for k, p in x[1].items()))), list(languages.SCRIPT_HINTS.items()), F)
    hints = base.select("doc_id", "matched", F.explode("scripts").alias("script")).select("doc_id", "matched", F.explode(given).alias("h"))
    hints = hints.select("doc_id", F.col("h.language").alias("language"), (F.col("h.p") * F.when(F.col("matched") == 0, 1.0).otherwise(languages.HINT_BESIDE_WORDS)).alias("s"))
    known = votes.unionByName(hints).groupBy("doc_id", "language").agg(F.sum("s").alias("s"))
    none = base.join(known.select("doc_id").distinct().withColumn("any", F.lit(True)), "doc_id", "left").where("any IS NULL OR words = 0 OR matched < words")
    share = F.when(F.col("any").isNull(), 1.0).when(F.col("words") == 0, languages.WORDLESS).otherwise(languages.UNKNOWN * (1 - F.col("matched") / F.col("words")))
    scores = known.unionByName(none.select("doc_id", F.lit("unknown").alias("language"), share.alias("s")))
    return scores.select("doc_id", "language", F.round(F.col("s") / F.sum("s").over(W.partitionBy("doc_id")), 6).alias("probability"))


@query()
def src_manifest(spark, sf):
    return packs.manifest(spark)


@query()
def sym_readings(spark, sf):
    return packs.symbol_table(spark, packs.load())


@query()
def abbr_readings(spark, sf):
    return packs.abbreviation_table(spark, packs.load())


@query()
def reb_decode(spark, sf):
    """The best reading of every pair's second text that has one beside itself."""
    lexicon = packs.load()
    texts = table(spark, sf, "evaluation_case").where("b IS NOT NULL").select("id", "b").dropDuplicates(["id"])
    return texts.select("id", F.explode(rebus.decode(F.col("b"), lexicon)).alias("r")).where("r.changed").select("id", "r.text", F.round("r.score", 6).alias("score"), "r.strong")
