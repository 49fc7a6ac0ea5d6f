"""The engine, its sources and sinks, decisions, streams and the command line."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh import cli
from quillmesh.config import ConfigurationError, EngineConfig
from quillmesh.engine import CHANNELS, TextEngine
from quillmesh.functions import tables as T
from quillmesh.operators import decide, evidence, measures, retrieval, scoring
from quillmesh.sources import datasets, packs
from quillmesh.streaming import jobs


def test_config():
    assert EngineConfig().input_chars == 8192
    for bad in ({"beam": 0}, {"strong_gap": 2.0}, {"weights": {"lexical": float("nan")}}, {"weights": {"nothing": 1.0}}, {"weights": {"lexical": 0.0}}):
        with pytest.raises(ConfigurationError):
            EngineConfig(**bad)


def test_analyze(spark):
    df = spark.createDataFrame([("1", "C0mpr4 ah0r4!!! https://x.io 😀"), ("2", None), ("3", ""), ("4", "x" * 9000)], "id string, text string")
    rows = {r.id: r for r in TextEngine(spark).analyze(df).collect()}
    assert rows["1"].normalized.startswith("compra ahora") and "leetspeak" in rows["1"].obfuscation.flags
    assert any(s.segment_type == "url" for s in rows["1"].segments)
    assert rows["4"].too_long and rows["4"].normalized is None and not rows["2"].too_long and rows["3"].normalized == ""
    few = TextEngine(spark).analyze(df, channels=("obfuscation",))
    assert "segments" not in few.columns and set(CHANNELS) >= {"unicode"}
    with pytest.raises(ValueError):
        TextEngine(spark).analyze(df, channels=("nothing",))


def test_compare_is_symmetric_and_knows_itself(spark):
    e = TextEngine(spark)
    pairs = spark.createDataFrame([("1", "buy the house now", "buy the mouse now"), ("2", "buy the mouse now", "buy the house now"), ("3", "hello", "hello"), ("4", "I ❤ u", "I love you")], "id string, a string, b string")
    got = {r.id: r for r in e.compare(pairs).collect()}
    assert got["1"].score == pytest.approx(got["2"].score) and got["3"].score > 0.95
    assert got["1"].swapped_word_similarity > 0.5 and got["4"].exact_decode > 0.05 and got["3"].trained > got["1"].trained
    dup = {r.id: r for r in e.duplicates(pairs).collect()}
    assert dup["3"].duplicate and dup["3"].reason == "exact raw match"


def test_compare_agrees_with_the_expressions(spark):
    """The one-pass channels are those of the expressions, on texts of several scripts and disguises."""
    texts = ["Buy the h0use now!!!", "buy the mouse now", "Ｃlick  hеre", "отправитель переслал", "gr8 w0rk 😀", "", "Ångström ﬁle", "aaa bbb"]
    pairs = spark.createDataFrame([(f"{i}-{j}", x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "id string, a string, b string")
    want = {r.id: r for r in scoring.scored(pairs).collect()}
    for r in TextEngine(spark).compare(pairs).collect():
        for channel in ("lexical", "character", "visual", "phonetic", "obfuscation", "normalized_identity", "cross_script_pair"):
            assert r[channel] == pytest.approx(want[r.id][channel], abs=1e-6), (r.id, channel, r.a, r.b)


def test_compare_nulls_long_texts_and_settings(spark):
    pairs = spark.createDataFrame([("1", None, "x"), ("2", "word", "word"), ("3", "w" * 9000, "w")], "id string, a string, b string")
    got = {r.id: r for r in TextEngine(spark).compare(pairs).collect()}
    assert got["1"].score is None and got["3"].trained is None and got["2"].score > 0.9 and got["2"].trained > 0.5
    one = {r.id: r for r in TextEngine(spark, EngineConfig(weights={"lexical": 1.0})).compare(pairs).collect()}
    assert one["2"].score == one["2"].lexical
    assert TextEngine(spark).compare(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        TextEngine(spark).compare(pairs.withColumn("lexical", F.lit(1)))


def test_settings_act(spark):
    text = "I ❤ u " + "word " * 400 + "Anna Miller met Bert Jones and Carl Smith"
    df = spark.createDataFrame([("1", text)], "id string, text string")
    small = TextEngine(spark, EngineConfig(segments=5, entities=2, candidates=1, phonetic=True))
    row = small.analyze(df).first()
    assert len(row.segments) == 5 and len(row.entities) == 2 and len(row.rebus_candidates) <= 1 and "phonetic" in row.asDict() and "embedding" not in row.asDict()
    assert "rebus_candidates" not in TextEngine(spark, EngineConfig(rebus=False)).analyze(df).columns
    assert "entities" not in small.without_entities(df).columns and "transliterations" not in small.without_transliteration(df).columns
    registry = spark.createDataFrame([("p", ["you were chosen"], [], None)], "pattern_id string, examples array<string>, negatives array<string>, threshold double")
    asked = spark.createDataFrame([("1", "you were chosen today")], "id string, text string")
    assert TextEngine(spark, EngineConfig(pattern_threshold=0.2)).match_patterns(asked, registry).count() == 1
    assert TextEngine(spark, EngineConfig(pattern_threshold=0.99)).match_patterns(asked, registry).count() == 0


def test_readings_follow_the_segment_limit():
    from quillmesh.functions.rebus import Search, decode_text

    text = "word " * 60 + "I ❤ u"
    lexicon = packs.load()
    assert any("love" in r["text"] for r in decode_text(text, lexicon)) and not any("love" in r["text"] for r in decode_text(text, lexicon, Search(segments=48)))


def test_find_duplicates(spark):
    docs = spark.createDataFrame([("a", "the price list for the desk"), ("b", "The  price list for the desk"), ("c", "something else")], "id string, text string")
    queries = spark.createDataFrame([("q", "the price list for the desk"), ("n", None), ("e", "")], "id string, text string")
    got = {r.id: r for r in TextEngine(spark).find_duplicates(docs, queries).collect()}
    assert set(got) == {"a", "b"} and got["a"].reason == "exact raw match" and got["b"].reason == "normalized match" and got["b"].duplicate_score == 1.0
    assert TextEngine(spark).find_duplicates(docs, queries, 0.3, "lexical").count() >= 2
    assert TextEngine(spark).find_similar(docs, queries, 0).count() == 0


def test_spam_features_and_score(spark):
    """All features by hand on one text; and that the trained scorer weighs the readings."""
    df = spark.createDataFrame([("1", "WIN now!!! http://x.io 😀 100 €"), ("2", None), ("3", ""), ("4", "The meeting moved to Monday.")], "id string, text string")
    got = {r.id: r for r in scoring.spam_features(df).collect()}
    r = got["1"]
    assert (r.url_count, r.email_count, r.emoji_count) == (1, 0, 1) and r.number_ratio == pytest.approx(3 / 30) and r.punctuation_ratio == pytest.approx(7 / 30) and r.uppercase_ratio == pytest.approx(3 / 13)
    assert r.repetition_score == pytest.approx(2 / 30) and 0 < r.decoded_similarity <= 1 and got["2"].entropy is None and got["3"].entropy == 0.0
    out = {r.id: r for r in TextEngine(spark).detect_spam(df).collect()}
    weights = scoring.T.SPAM_WEIGHTS
    for row in (out["1"], out["4"]):
        z = scoring.T.SPAM_BIAS + sum(weights[k] * float(row[k]) for k in weights)
        assert row.probability == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    assert "promotion" in out["1"].labels
    registry = spark.createDataFrame([("p", ["the meeting moved to monday"], [], 0.3)], "pattern_id string, examples array<string>, negatives array<string>, threshold double")
    met = {r.id: r for r in TextEngine(spark).detect_spam(df, registry=registry).collect()}
    assert met["4"].pattern_score > 0.8 and met["1"].pattern_score == 0 and "known_pattern" in met["4"].labels


def test_postings_of_all_channels(spark):
    docs = spark.createDataFrame([("a", "I ❤ the h0use 4u"), ("b", "привет друзья"), ("n", None), ("e", "")], "id string, text string")
    p = retrieval.postings(docs, (*retrieval.CHANNELS, *retrieval.READ_CHANNELS))
    found = {(r.channel, r.id) for r in p.select("channel", "id").distinct().collect()}
    assert {("lexical", "a"), ("normalized", "b"), ("character", "a"), ("symbol", "a"), ("minhash", "a"), ("semantic", "b"), ("phonetic", "a"), ("transliteration", "b"), ("decoded", "a"), ("concept", "a")} <= found
    assert not {i for _, i in found} - {"a", "b"}
    with pytest.raises(ValueError):
        retrieval.postings(docs, ("nothing",))


def test_exact_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[10] = v[20]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "id bigint, vector array<double>")
    queries = df.where("id % 20 = 0 OR id >= 900")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -3)
    for block in (50_000, 4):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = {}
        for r in retrieval.exact_search(df, queries, 5).collect():
            got.setdefault(r.query, []).append((r.rank, r.id))
        for q in range(0, 300, 20):
            assert [i for _, i in sorted(got[q])] == sorted(range(300), key=lambda i: (-s[q, i], i))[:5]
    assert retrieval.exact_search(df, queries.limit(0), 5).count() == 0


def test_features_of_characters_by_hand(spark):
    """The batch form against plain definitions, and against the expressions."""
    import math
    from collections import Counter

    from quillmesh.functions import points
    from quillmesh.functions import unicode as uni

    texts = ["h3llo woooorld!!!", "Сегодня и today", "a\u0301\u0301b", "x\u200by\u202ez", "👩\u200d💻 ok", "\u0301start", "ＦＵＬＬ", "A" * 50, "", None, "ends\u200d", "☎\ufe0f\ufe0f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    c = F.col("text")
    got = {r.id: r for r in df.select("id", uni.entropy(c).alias("e"), points.suspicion(c).alias("s"), uni.suspicious_score(c).alias("s_"), points.malformed(c).alias("m"), uni.malformed(c).alias("m_"), uni.obfuscation(c).alias("o")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert r.e is None and r.s is None and r.m is None and r.o is None
            continue
        assert r.e == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), abs=1e-9) and r.s == pytest.approx(r.s_) and r.m == r.m_
    assert got[0].o.flags == ["leetspeak", "repetition", "punctuation_flood"] and got[0].o.repetition_score == pytest.approx(5 / 17)
    assert got[1].o.flags == ["mixed_scripts", "confusables"] and "uppercase_flood" in got[7].o.flags


def test_swapped_words():
    assert evidence.swapped("a b c".split(), "a x c".split()) == (1, "b", "x")
    assert evidence.swapped("a b".split(), "x y".split()) is None
    assert evidence.swapped("win a free prize now".split(), "win free praise now".split()) == (3, "prize", "praise")
    assert evidence.swapped("quick brown fox".split(), "the quick brown fox".split()) is None


def test_search_and_store(spark, tmp_path):
    docs = spark.createDataFrame([("a", "the price list for the desk"), ("b", "a lost parcel near the desk"), ("c", "сообщение отправителя")], "id string, text string")
    queries = spark.createDataFrame([("q", "lost parcel at the desk")], "id string, text string")
    best = TextEngine(spark).find_similar(docs, queries, 2).orderBy("rank").collect()
    assert best[0].id == "b"
    path = str(tmp_path / "store")
    datasets.write_store(docs, path)
    datasets.write_store(retrieval.upsert(docs, spark.createDataFrame([("a", "new")], "id string, text string")), path)
    assert {r.id: r.text for r in datasets.read_store(spark, path).collect()}["a"] == "new"
    assert retrieval.remove(docs, docs.where("id = 'a'")).count() == 2
    newer = str(tmp_path / "newer")
    docs.withColumn("store_version", F.lit(9)).write.parquet(newer)
    with pytest.raises(ValueError):
        datasets.read_store(spark, newer)


def test_datasets(spark, tmp_path):
    one = {"id": "1", "a": "x", "b": "y", "split": "dev", "labels": {"similar": True}}
    (tmp_path / "cases.json").write_text(json.dumps({"version": "1", "cases": [one, {**one, "id": "2", "split": None}]}))
    got = {r.id: r for r in datasets.cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got["1"].split == "validation" and got["2"].split == "test" and got["2"].difficulty == "medium"
    (tmp_path / "spam.json").write_text(json.dumps({"version": "1", "source": "s", "items": [{"id": "1", "text": "t", "label": "SPAM"}]}))
    assert datasets.spam_corpus(spark, str(tmp_path / "spam.json")).first().label == "spam"
    good = {"id": "1", "state": "s", "question": {"type": "choice", "criteria": {"x": "1", "y": "2"}}, "gold": "x"}
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps({**good, "question": {"type": "binary"}})]))
    fine, bad = datasets.decisions(spark, str(tmp_path / "d.jsonl"))
    assert fine.count() == 1 and bad.count() == 2
    (tmp_path / "lines.txt").write_text("one\n\n  \ntwo\n")
    assert datasets.lines(spark, str(tmp_path / "lines.txt")).count() == 2


def test_patterns_and_artifacts(spark, tmp_path):
    registry = spark.createDataFrame([("p", ["you were chosen"], ["were you there"], 0.5)], "pattern_id string, examples array<string>, negatives array<string>, threshold double")
    path = str(tmp_path / "patterns.json")
    datasets.save_patterns(registry, path)
    assert datasets.patterns(spark, path).first().pattern_id == "p"
    found = scoring.match_patterns(spark.createDataFrame([("1", "you were chosen"), ("2", "nothing at all")], "id string, text string"), registry).collect()
    assert [r.id for r in found] == ["1"]
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": 1, "patterns": [{"id": " ", "examples": ["x"]}]}))
    with pytest.raises(ValueError):
        datasets.patterns(spark, str(tmp_path / "bad.json"))
    datasets.save_artifact(str(tmp_path / "a.json"), "logistic_spam", {"x": 1.0}, 0.5)
    assert datasets.artifact(str(tmp_path / "a.json"), "logistic_spam", ["x"]) == ({"x": 1.0}, 0.5)
    for kind, names in (("other", ["x"]), ("logistic_spam", ["y"])):
        with pytest.raises(ValueError):
            datasets.artifact(str(tmp_path / "a.json"), kind, names)


def test_decisions(spark):
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(60):
        x = rng.normal(size=(3, 8))
        examples.append((x, int(x[:, 0].argmax())))
    head = decide.fit_head(examples, hidden=8, epochs=40)
    assert np.mean([head.score(x).argmax() == g for x, g in examples]) > 0.9
    again = decide.Head.from_json(head.to_json())
    assert np.allclose(again.score(examples[0][0]), head.score(examples[0][0]))
    with pytest.raises(ValueError):
        decide.interaction(np.ones((1, 3)), np.ones((1, 4)))
    rows = spark.createDataFrame([("1", "refund of my invoice", {"billing": "invoice and refund", "sales": "plans and offers"})], "id string, state string, criteria map<string,string>")
    got = decide.similarity_decisions(rows).first()
    assert got.label == "billing" and sum(got.probabilities.values()) == pytest.approx(1.0)


def test_rerank_keeps_the_tail(spark):
    rows = spark.createDataFrame([("q", f"d{i}", 1.0 - i / 10, i / 10) for i in range(6)], "query string, id string, score double, lexical double")
    got = scoring.rerank(rows, "query", "score", {"lexical": F.col("lexical") * 10}, 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["d2", "d1", "d0", "d3", "d4", "d5"]


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.random(300).round(2)
    m = measures.binary_metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s, strict=True)], "label double, score double")).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert m.roc_auc == pytest.approx(auc, abs=1e-5) and m.accuracy == pytest.approx(np.mean((s >= 0.5) == y), abs=1e-6)
    weights, bias = measures.fit_logistic(spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(70)], "x double, y double"), ["x"], "y", steps=40)
    assert weights[0] > 0 and bias < weights[0]


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(i, f"2024-01-01 {i // 6:02d}:{i % 6 * 10:02d}:00", i % 3, "click" if i % 2 else "view", 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "'{}' props")
    df.write.parquet(folder)
    q = jobs.tumbling(jobs.event_stream(spark, folder)).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start, r.event_type): r.n for r in spark.table("tumbled").collect()}
    assert got == {(r.start, r.event_type): r.n for r in jobs.tumbling(df).collect()}
    s = jobs.event_stream(spark, folder).withColumn("text", F.lit("the same message"))
    q = jobs.first_seen(jobs.analysed(s), "ts", late="3 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 1


def test_command_line(spark, capsys):
    assert cli.main(["schema-version"]) == 0
    assert cli.main(["compare", "hello there", "hello there"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["score"] > 0.9
    assert cli.main(["spam", "WIN NOW!!! https://x.io 12345"]) == 0 and cli.main(["resources"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["compare", "one"])


def test_manifest(spark):
    rows = packs.manifest(spark).collect()
    assert {r.kind for r in rows} == {"languages", "symbols", "abbreviations"} and all(len(r.sha256) == 64 for r in rows)


def test_cell_search_finds_what_exact_search_finds(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test data here")
    v = spark.read.parquet(path).selectExpr("vec_id AS id", "embedding AS vector")
    rng = np.random.default_rng(4)
    spread = (np.repeat(rng.normal(size=(60, 8)), 20, axis=0) + 0.05 * rng.normal(size=(1_200, 8))).tolist()
    families = spark.createDataFrame([*enumerate(spread), (5_000, [0.0] * 8)], "id bigint, vector array<double>")
    for vectors, cell in ((v, 200), (families, 20)):
        queries = vectors.where("id % 20 = 0")
        exact, got = ({(r["query"], r["rank"]): (r["id"], r["similarity"]) for r in f.collect()} for f in (retrieval.exact_search(vectors, queries, 10), retrieval.cell_search(vectors, queries, 10, cell=cell)))
        assert got == exact and len(got) == 10 * queries.count()
    few = families.where("id < 4")
    assert retrieval.cell_search(few, few, 10, cell=1).count() == 12


def test_pattern_query_reads_whole_texts(spark, tmp_path):
    from quillmesh.plans import catalogue

    path = str(tmp_path)
    spark.createDataFrame([("a", " " * 9_000 + "last chance to claim your prize now"), ("b", "hello"), ("c", None)], "id string, text string").write.parquet(f"{path}/spam_item.parquet")
    assert [(r.id, r.pattern_id) for r in catalogue.queries()["pat_match"](spark, path).collect()] == [("a", "claim")]


def test_prerank_query_draws_from_all_channels(spark, tmp_path):
    from quillmesh.plans import catalogue

    path = str(tmp_path)
    spark.createDataFrame([(1, "unbelievable"), (2, "zzz qqq"), (3, "believably done"), (4, None)], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "believable")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    assert sorted((r["query"], r["id"]) for r in catalogue.queries()["idx_prerank"](spark, path).collect()) == [(7, 1), (7, 3)]


def _some_pairs():
    import random

    rng = random.Random(5)
    alphabets = ["ab", "abcdefgh ", "abcdéжю日本語😀 ", "abcdefghijklmnopqrstuvwxyz 0123"]
    make = lambda: "".join(rng.choices(rng.choice(alphabets), k=rng.choice([0, 1, 2, 3, 20, 63, 64, 65, 127, 128, 129, 200])))

    def changed(text):
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "é" + text[at:], text[:at] + text[at : at + 2][::-1] + text[at + 2 :]])
        return text

    firsts = [make() for _ in range(400)]
    return [(a, changed(a) if i % 2 else make()) for i, a in enumerate(firsts)] + [("a" * 2_000, "b" + "a" * 1_990)]


def test_many_pairs_at_once_as_one_by_one():
    from quillmesh.functions import distance, many, sounds

    pairs = _some_pairs()
    single = [distance.character_folded(a, b)["combined"] for a, b in pairs]
    assert np.allclose(many.character_many(pairs), single, atol=1e-12)
    assert many.edits_many(pairs) == [distance.levenshtein_text(a, b) for a, b in pairs]
    own = list(dict.fromkeys(t for pair in pairs for t in pair))
    one, two, three, lengths = many.character_counts(own)
    x, y = (np.array([own.index(p[k]) for p in pairs]) for k in (0, 1))
    shared = lambda counts: np.minimum(counts[x], counts[y]).sum(axis=1, dtype=int)
    assert (many.character_bounds(shared(one), lengths[x], lengths[y], shared(two), shared(three)) >= np.where(x == y, 0, single) - 1e-9).all()  # equal ones are not asked for
    spoken = [(sounds.sounds_of(a), 0.65, sounds.sounds_of(b), 0.35) for a, b in pairs]
    assert np.allclose(many.sounds_many([(sounds.as_letters(a), ca, sounds.as_letters(b), cb) for a, ca, b, cb in spoken]), [sounds.sound_similarity(*p) for p in spoken], atol=1e-9)
    assert many.character_many([]) == many.sounds_many([]) == []


def test_readings_of_pairs_are_compared_at_once(monkeypatch):
    from quillmesh.functions import rebus

    lexicon, settings = packs.load(), evidence.Settings()
    pairs = [("gr8 2 c u 4 ever m8", "great to see you for ever mate"), ("I ❤ u", "i love you"), ("", "a b"), ("w1n 4 pr1z3 n0w", "win a prize now"), ("привет мир", "privet mir"), ("a b c", "a x c")]
    sides = [(evidence.Side(a, lexicon, settings), evidence.Side(b, lexicon, settings)) for a, b in pairs]
    single = [evidence.decoded_overlap(*(evidence.graded(s.text, lexicon) for s in pair)) for pair in sides]
    found = [rebus.decode_text(s.text, lexicon) for pair in sides for s in pair]
    one_by_one = []
    for module, name in ((evidence, "character_folded"), (evidence, "decode_text"), (rebus, "sound_similarity")):
        monkeypatch.setattr(module, name, lambda *x, name=name, f=getattr(module, name): one_by_one.append(name) or f(*x))
    evidence.prepare([s for pair in sides for s in pair])
    compared = evidence.Compared(sides)
    assert np.allclose([evidence.channels(*pair, compared)["decoded"] for pair in sides], single, atol=1e-9)
    assert one_by_one.count("decode_text") == 0 and one_by_one.count("sound_similarity") == 0 and len(one_by_one) <= 10
    again = rebus.decode_texts([s.text for pair in sides for s in pair], lexicon)
    assert [[(r["text"], round(r["score"], 9), r["steps"]) for r in rs] for rs in again] == [[(r["text"], round(r["score"], 9), r["steps"]) for r in rs] for rs in found]


def test_duplicates_need_the_channels_alone(spark):
    engine = TextEngine(spark)
    pairs = spark.createDataFrame([("1", "Win a prize now", "W1n a pr1ze n0w"), ("2", "a", None), ("3", "see you", "see  YOU"), ("4", "hello", "x" * 9_000), ("5", "quick brown fox", "lazy dog")], "id string, a string, b string")
    whole, alone = engine.duplicates(pairs), engine.duplicates(pairs, between=False)
    assert set(T.CHANNELS) <= set(alone.columns) and not {"trained", "language_agreement", *T.PAIR_FEATURES} & set(alone.columns)
    seen = lambda df: sorted(tuple(r) for r in df.select("id", "duplicate", F.round("duplicate_score", 9), "reason", *T.CHANNELS).collect())
    assert str(seen(whole)) == str(seen(alone))
