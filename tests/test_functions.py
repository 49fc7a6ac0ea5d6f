"""Functions against plain versions of themselves and known values."""

import os
import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.functions import distance, entities, normalize, rebus, sounds, tables, tokens
from quillmesh.sources import packs

short = st.text("abcé", max_size=8)


def plain_edits(a, b, swaps):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(short, short)
@settings(max_examples=300, deadline=None)
def test_edit_distances(a, b):
    assert distance.osa_text(a, b) == plain_edits(a, b, True)
    assert distance.levenshtein_text(a, b) == plain_edits(a, b, False)


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_lcs_and_symmetry(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    assert distance.lcs_text(a, b) == d[-1][-1]
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    if a != b:
        assert distance.ngram_text(a, b, 2) == pytest.approx(sum((x & y).values()) / max(1, sum((x | y).values())))
    assert 0 <= distance.character_text(a, b)["combined"] <= 1 + 1e-9


def test_known_values():
    assert distance.osa_text("ca", "abc") == 3
    assert distance.jaro_text("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert distance.jaro_winkler_text("abcd", "axyz") == pytest.approx(0.55)
    assert distance.jaro_text("", "") == 1.0 and distance.jaro_text("a", "") == 0.0
    assert normalize.fold_text("Straße İΣς") == "strasse i̇σσ"
    assert normalize.strip_marks_text("café") == "cafe"
    assert normalize.fold_text(None) is None


def test_hashes():
    def fnv(data):
        h = 0xCBF29CE484222325
        for byte in data:
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return h

    words = ["", "a", "straße", "日本"]
    assert [int(h) for h in tokens.fnv1a(words)] == [fnv(w.encode()) for w in words]
    assert tokens.simhash_tokens([]) == 0
    assert tokens.minhash_tokens([]) == [2**32 - 1] * 32
    same, other = tokens.minhash_tokens(list("abcdef"), saturating=False), tokens.minhash_tokens(list("uvwxyz"), saturating=False)
    assert same != other


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_segments_keep_their_places(text):
    raw = text.encode("utf-8", "surrogatepass")
    last = 0
    for piece, a, b, kind in tokens.segment_text(text):
        assert raw[a:b].decode("utf-8", "surrogatepass") == piece and a >= last and kind
        last = b


def test_segments_and_entities():
    kinds = {p: k for p, _, _, k in tokens.segment_text("Hi @bob see https://x.io/a #tag me@x.org 25 😀")}
    assert kinds["@bob"] == "mention" and kinds["https://x.io/a"] == "url" and kinds["#tag"] == "hashtag" and kinds["me@x.org"] == "email" and kinds["25"] == "number" and kinds["😀"] == "emoji"
    found = {(e["entity_type"], e["value"]) for e in entities.entities_text("Pay $25.50 or 100 USD on 2031-02-03 at 10:20 to me@x.org")}
    assert {("currency", "USD 25.50"), ("currency", "USD 100"), ("date", "2031-02-03"), ("time", "10:20"), ("email", "me@x.org")} <= found
    assert entities.entities_text("") == [] and entities.entities_text(None) == []


def test_sounds():
    assert sounds.sounds_of("queso", "es") == ["k", "e", "s", "o"]
    assert sounds.sounds_of("gente", "es")[0] == "x" and sounds.sounds_of("gente", "en")[0] == "g"
    assert sounds.parse_ipa("ˈtʃiːks") == ["tʃ", "i", "ks"]
    assert sounds.sound_distance("p", "p") == 0 and sounds.sound_distance("a", "p") == 1
    assert sounds.sound_similarity(["k", "a"], 0.65, ["k", "a"], 0.65) > sounds.sound_similarity(["k", "a"], 0.65, ["m", "u"], 0.65)


def test_maps_are_one_to_one():
    assert len(tables.CONFUSABLE_FROM) == len(tables.CONFUSABLE_TO)
    assert all(sum(p.values()) == pytest.approx(1.0) for p in tables.PROFILES.values())


def test_packs(tmp_path):
    lexicon = packs.load()
    assert lexicon.lookup("de") == "Ambiguous" and lexicon.lookup("zzz") == "NotFound"
    assert lexicon.contains("house", ["en"]) and not lexicon.contains("house", ["fr"]) and lexicon.contains("house", ["und"])
    good = {"schema_version": 1, "language": "xx", "entries": [{"word": "a"}]}
    packs.check(good, "languages")
    for bad in ({**good, "schema_version": 2}, {**good, "language": " "}, {**good, "entries": [{"word": ""}]}, {**good, "sha256": "0"}, {**good, "entries": [{"word": "a", "weight": float("nan")}]}):
        with pytest.raises(packs.PackError):
            packs.check(bad, "languages")
    packs.check({**good, "sha256": packs.declared_digest(good)}, "languages")
    assert list(packs.read_packs(str(tmp_path), "languages")) == []


def test_readings():
    lexicon = packs.load()
    found = [r["text"] for r in rebus.decode_text("I ❤ u", lexicon)]
    assert "I love you" in found or "I love u" in found
    assert rebus.decode_text("", lexicon) == []
    assert rebus.plausibility("for the house", lexicon) == 1.0


def plain_fold(text):
    """Character by character after the compatibility form."""
    special = {"ß": "ss", "ẞ": "ss", "ς": "σ", "ſ": "s", "İ": "i\u0307"}
    return "".join(special.get(c, c.lower()) for c in unicodedata.normalize("NFKC", text))


def test_folding_queries_cover_all_documents(spark, tmp_path):
    from quillmesh.plans import catalogue

    # text, folded, without marks, letters and digits
    fixture = [
        (None, None, None, None),
        ("", "", "", ""),
        ("Plain TEXT 1!", "plain text 1!", "plain text 1!", "plaintext1"),
        ("Straße, GROẞ ſo", "strasse, gross so", "strasse, gross so", "strassegrossso"),
        ("ΣΟΦΟΣ σοφός", "σοφοσ σοφόσ", "σοφοσ σοφοσ", "σοφοσσοφόσ"),
        ("İstanbul", "i\u0307stanbul", "istanbul", "istanbul"),
        ("Ёлка, Йод", "ёлка, йод", "елка, иод", "ёлкайод"),
        ("Łódź — ﬁn ①", "łódź — fin 1", "łodz — fin 1", "łódźfin1"),
        ("e\u0301 Ａ", "é a", "e a", "éa"),
        ("हिन्दी", "हिन्दी", "हिन्दी", "हिनदी"),
        ("👍🏽 漢字 𝐗", "👍🏽 漢字 x", "👍🏽 漢字 x", "漢字x"),
        ("مَدرسة", "مَدرسة", "مَدرسة", "مَدرسة"),
    ]
    path = str(tmp_path)
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(fixture)], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    queries = catalogue.queries()
    for k, name in enumerate(("norm_casefold_all", "norm_strip_diacritics_all", "norm_alnum_fold_all"), 1):
        got = {r[0]: r[1] for r in queries[name](spark, path).collect()}
        assert got == {i: r[k] for i, r in enumerate(fixture)}, name
    sf = "/root/testdata/sf0.01"
    if os.path.isdir(sf):  # whole tables against a plain version
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
        mark = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
        folded = {i: None if t is None else plain_fold(t) for i, t in texts.items()}
        assert sum(t is not None and not t.isascii() for t in texts.values()) > 100
        assert {r[0]: r[1] for r in queries["norm_casefold_all"](spark, sf).collect()} == folded
        assert {r[0]: r[1] for r in queries["norm_strip_diacritics_all"](spark, sf).collect()} == {i: None if t is None else mark.sub("", unicodedata.normalize("NFD", t)) for i, t in folded.items()}


def test_scripts_of_syllables():
    from quillmesh.functions import transcribe as t

    for text, latin in (("きって", "kitte"), ("コーヒー", "koohii"), ("しゃしん", "shashin"), ("さんぽ", "sampo"), ("ありがとう", "arigatou"), ("がっこう", "gakkou")):
        assert t.kana_to_latin(text) == latin
    for text, latin in (("धन्यवाद", "dhanyavad"), ("कमल", "kamal"), ("क", "ka"), ("नमस्ते", "namaste"), ("ज़रा", "zara")):
        assert t.devanagari_to_latin(text) == latin
    assert t.han_to_latin("你好") == "ni hao" and t.latin_to_han("ni hao") == "你好" and t.latin_to_han("nothing here") is None
    assert t.other_views(None) == t.other_views("") == t.other_views("plain words") == {} and t.other_views("ni hao") == {"Hans": "你好"}


def test_views_of_all_scripts(spark):
    from pyspark.sql import functions as F

    from quillmesh.functions import sounds

    df = spark.createDataFrame([("привет",), ("你好",), ("ありがとう",), ("नमस्ते",), ("ni hao",), ("",), (None,)], "text string")
    got = {r.text: r.v for r in df.select("text", sounds.views(F.col("text")).alias("v")).collect()}
    assert got["привет"]["Latn"] == "privet" and got["你好"] == {"Latn": "ni hao"} and got["ありがとう"]["Latn"] == "arigatou" and got["नमस्ते"]["Latn"] == "namaste" and got["ni hao"]["Hans"] == "你好" and not got[""]


def test_language_by_words_scripts_and_coverage():
    from quillmesh.functions import languages as lang
    from quillmesh.sources.packs import Lexicon

    lexicon = Lexicon()
    lexicon.add_language({"language": "en", "entries": [{"word": "house", "weight": 2.0}, {"word": "red", "weight": 1.0}]})
    lexicon.add_language({"language": "es", "entries": [{"word": "red", "weight": 3.0}]})
    got = dict(lang.detect_text("Red house qqq", frozenset({"Latin"}), lexicon))
    import math

    scores = {"en": 2 + math.log1p(2) + math.log1p(1), "es": 1 + math.log1p(3), "unknown": 0.35 / 3}
    assert got == pytest.approx({k: v / sum(scores.values()) for k, v in scores.items()})
    assert lang.detect_text("", frozenset(), lexicon) == [("unknown", 1.0)] and lang.detect_text("привет", frozenset({"Cyrillic"}), lexicon)[0][0] == "ru"
    assert lang.cjk_coverage("你好吗 abc", {"你好", "abc"}) == pytest.approx(2 / 3) and lang.cjk_coverage("abc", {"abc"}) == 0.0
