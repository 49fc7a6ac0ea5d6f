"""Operators for training data against brute force on small tables, and on nulls, empty, long, repeated and clashing input."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmesh.llm import components as C
from quillmesh.llm import p1_plain_form, p2_overlaps, p3_personal, p4_neighbours, p5_families, p6_splits, p7_languages, p8_encode, p9_leaks, p10_repetition
from quillmesh.llm.plain import is_plain, plain, words
from quillmesh.llm.wordsets import word_sets

TOKENIZER = f"{p8_encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
LONG = "lorem ipsum dolor " * 4000


def test_plain_form():
    for dirty, clean in (("Ｔｅｌ", "Tel"), ("𝗲x", "ex"), ("ﬁn", "fin"), ("éte", "éte"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("рrüftе", "prüfte"), ("вepнyл", "вернул"), ("жд­ёт", "ждёт")):
        assert plain(dirty) == clean and not is_plain(dirty) and is_plain(clean) and plain(clean) == clean
    for kept in ("👩‍💻", "☎️", "1️⃣", "h0us3", "дом", "漢字 かな", "a\tb\nc", "", None):
        assert plain(kept) == kept and is_plain(kept)
    assert plain("e" + "́" * 5000).startswith("é")


def test_plain_form_is_stable():
    rng = random.Random(1)
    pool = "ab яр éｅ́​‍️👩💻ﬁоa 　𝗲ѕ漢ｶﾞ가각"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        once = plain(text)
        assert plain(once) == once, ascii(text)


def test_lookalikes_in_tables(spark):
    df = spark.createDataFrame([(1, "Ｔel", "x"), (2, "tel", "y"), (3, None, None), (4, "", "z"), (4, "", "z"), (5, LONG, None)], "id int, text string, plain_ string")
    assert {r.id for r in p1_plain_form.with_lookalikes(df, "text").collect()} == {1}
    out = p1_plain_form.to_plain(df, "text").collect()
    assert len(out) == 6 and {r.id: r.plain for r in out}[1] == "Tel" and {r.id: r.plain for r in out}[3] is None
    assert p1_plain_form.to_plain(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        p1_plain_form.to_plain(df.withColumnRenamed("plain_", "plain"), "text")


# ---------------------------------------------------------------------------------------- sets of words


def make_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            own = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rng.shuffle(own)
        else:
            own = rng.choices(vocabulary, k=rng.randrange(8, 25))
        texts.append(" ".join(own))
    return texts


def similar(a, b, least=0.6):
    shared = len(a & b)
    return shared > 0 and shared >= least * (len(a) + len(b) - shared) - 1e-9


def test_families_match_brute_force(spark):
    texts = make_texts(250)
    rows = [("s", f"i{i:04d}", t) for i, t in enumerate(texts)] + [("t", f"i{i:04d}", t) for i, t in enumerate(texts[:40])]
    rows += [("s", "i0003", texts[3]), ("s", "n1", None), ("s", "n2", ""), ("s", "short", "a b c"), (None, "x", texts[0]), ("s", None, texts[0])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "src string, id string, text string, group_id string")
    got = {(r.src, r.id, r.group_id) for r in p5_families.families(df.select("src", "id", "text")).collect()}
    want = set()
    for src in ("s", "t"):
        own = sorted({(i, t) for s, i, t in rows if s == src and t and i and len(words(t)) >= 8})
        parent = list(range(len(own)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        sets = [set(words(t)) for _, t in own]
        for i, j in itertools.combinations(range(len(own)), 2):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        groups = defaultdict(set)
        for i, (k, _) in enumerate(own):
            groups[find(i)].add(k)
        want |= {(src, k, min(g)) for g in groups.values() if len(g) > 1 for k in g}
    assert {g for g in got if g[0]} == want
    assert p5_families.families(df.limit(0).select("src", "id", "text")).count() == 0


def test_a_long_record_widens_nothing():
    """Records of a few words beside one of 50,000, and two long ones that are alike."""
    rng = np.random.default_rng(4)
    long = np.unique(rng.integers(1, 2**24, 50_000, dtype=np.uint32))
    rows = [np.unique(rng.integers(1, 2**24, 12, dtype=np.uint32)) for _ in range(300)] + [long, long[: len(long) * 9 // 10], long[: len(long) // 2]]
    sizes = np.array([len(r) for r in rows])
    sets = p5_families.Sets(sizes, np.concatenate(rows), sizes, np.empty(0, np.uint8), np.zeros(len(rows), np.int64))
    assert sets.words.nbytes < 1_000_000
    i, j = np.array([300, 300, 301, 0, 0]), np.array([301, 302, 302, 300, 1])
    assert sets.similar(i, j, 0.6).tolist() == [True, False, False, False, False]


def test_false_links_are_found_and_made_again(spark, monkeypatch):
    """Links that whole words do not bear out are dropped, and what their components really link is linked again."""
    texts = make_texts(200, 5)
    df = spark.createDataFrame([("s", f"i{k:03d}", t) for k, t in enumerate(texts)], "src string, id string, text string")
    want = {(r.id, r.group_id) for r in p5_families.families(df).collect()}
    real, slices = p5_families.links, []

    def lying(records, common, levels, least, slice_=0):
        slices.append(slice_)
        found = real(records, common, levels, least, slice_)
        if slice_:
            return found
        hashes = sorted(r[0] for r in records.select("set_hash").distinct().collect())
        return found.limit(5).unionByName(spark.createDataFrame(list(zip(hashes, hashes[1:])), "u bigint, v bigint"))

    monkeypatch.setattr(p5_families, "links", lying)
    assert {(r.id, r.group_id) for r in p5_families.families(df).collect()} == want and slices == [0, 1]


def test_a_common_word_that_nobody_leads_by_makes_no_group(spark):
    """Records of one template meet by their rare words alone; those of few rare words still meet by the template's."""
    template = " ".join(f"common{i}" for i in range(13))
    rows = [("s", f"i{k:03d}", f"{template} {' '.join(f'own{k // 2}x{i}' for i in range(6))} single{k}") for k in range(600)]
    rows += [("s", f"j{k:02d}", f"{template} {' '.join(f'few{k}x{i}' for i in range(2 + k % 3))}") for k in range(20)]
    df = spark.createDataFrame(rows, "src string, id string, text string")
    want = {(f"i{k:03d}", f"i{k // 2 * 2:03d}") for k in range(600)} | {(f"j{k:02d}", "j00") for k in range(20)}
    assert {(r.id, r.group_id) for r in p5_families.families(df).collect()} == want
    common = p5_families.common_words(df, "text")
    sets = p5_families._records(df.where("id LIKE 'i%'"), common, 8).cache()
    levels = p5_families.rarity(sets, np.uint64, "rare", "common", common)
    groups = Counter()
    for r in p5_families._placed(sets, common, levels, 0.6, 1).select("keys").collect():
        groups.update((np.frombuffer(bytes(r.keys), np.uint32) >> 1).tolist())
    assert groups and max(groups.values()) == 2


def test_blocks_meet_where_one_side_leads():
    rng = np.random.default_rng(3)
    hashes, leads = rng.integers(0, 2**62, 60), rng.random(60) < 0.4
    for first, other in ((1, 1), (1, 4), (3, 1), (3, 5), (0, 2)):
        at, pair = p5_families._pairs_of_blocks(hashes, leads, np.full(60, first), np.full(60, other))
        groups = defaultdict(set)
        for i, g in zip(at.tolist(), pair.tolist(), strict=True):
            groups[g].add(i)
        met = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
        assert not (first == 0 and groups)
        assert first == 0 or all(p in met for p in itertools.combinations(range(60), 2) if leads[p[0]] or leads[p[1]])


def test_tree_links_leave_pairs_that_do_not_lead():
    rng = np.random.default_rng(6)
    rows = [np.unique(np.concatenate([np.arange(1, 25, dtype=np.uint32), rng.integers(100, 2**24, 4, dtype=np.uint32)])) for _ in range(300)]
    sizes = np.array([len(r) for r in rows])
    sets = p5_families.Sets(sizes, np.concatenate(rows), sizes, np.empty(0, np.uint8), np.zeros(len(rows), np.int64))
    for leading in (0, 1, 20):
        forest, leads = p5_families.Forest(300), np.zeros(300, bool)
        leads[rng.permutation(300)[:leading]] = True
        p5_families.tree_links(sets, np.arange(300), forest, 0.6, leads)
        assert len(np.unique(forest.roots())) == (1 if leading else 300)


def test_tree_links_join_all_that_is_linked():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**32, 30, dtype=np.uint32)
    rows = []
    for _ in range(400):
        own = base.copy() if rng.random() < 0.5 else rng.integers(1, 2**32, 30, dtype=np.uint32)
        own[rng.integers(0, 30, 5)] = rng.integers(1, 2**32, 5, dtype=np.uint32)
        rows.append(np.unique(own))
    none = np.zeros(len(rows), np.int64)
    sizes = np.array([len(r) for r in rows])
    sets = p5_families.Sets(sizes, np.concatenate(rows), sizes, np.empty(0, np.uint8), none)
    forest = p5_families.Forest(len(rows))
    p5_families.tree_links(sets, np.arange(len(rows)), forest, 0.6)
    got = forest.roots()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(set(rows[i]), set(rows[j])):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(rows))] == list(got)


def test_overlaps_match_brute_force(spark):
    texts = make_texts(120, 5)
    rows = [(f"i{i:03d}", i % 3 > 0, t, texts[(i * 7) % 120]) for i, t in enumerate(texts)]
    rows += [rows[4], ("e1", True, "", ""), ("e2", False, "", ""), ("c1", True, texts[0], texts[0]), ("c2", False, texts[0], texts[0]), ("long", True, LONG, LONG), ("long2", False, LONG, LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, train boolean, a string, b string, n string").drop("n")
    linked, members = p2_overlaps.overlapping(word_sets(df, ["id", "train"], "a", "b"))
    m = members.collect()
    ids = {True: defaultdict(set), False: defaultdict(set)}
    for r in m:
        ids[r.train][r.set_hash].add(r.id)
    got = {(x, y) for r in linked.collect() for x in ids[True][r.train_hash] for y in ids[False][r.other_hash]}
    sets = {i: (train, set(words(a)) | set(words(b))) for i, train, a, b in rows}
    want = {(x, y) for x, (tx, sx) in sets.items() for y, (ty, sy) in sets.items() if tx and not ty and similar(sx, sy)}
    assert got == want


# ---------------------------------------------------------------------------------------- components and splits


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3), (5, None), (1, 2), (2, 1)] + [(i, 0) for i in range(400, 460)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert C.components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_hubs_are_looked_up_alike(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_ROWS", 10)
    monkeypatch.setattr(C, "HUBS", 4)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(50)]
    got = C.components(spark.createDataFrame(edges, "u int, v int")).collect()
    assert {r.root for r in got} == {0, 1000} and len(got) == 251


def test_splits(spark):
    cases = [(f"i{i}", f"see @user{i % 40}x now" if i % 5 == 0 else None, f" Author{i % 60} " if i % 3 else None, None if i % 2 else f"SRC{i % 25}", "c" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(cases, "id string, a string, author string, source string, category string")
    groups = {r.id: r.group_id for r in p6_splits.groups(p6_splits.relations(df)).collect()}
    all_ = spark.createDataFrame([(i, groups.get(i, i), c) for i, _, _, _, c in cases] + [(f"solo{k}", f"solo{k}", "c") for k in range(600)], "id string, group_id string, category string")
    out = p6_splits.assign(all_).collect()
    assert len(out) == 1000
    splits = defaultdict(set)
    for r in out:
        splits[r.group_id].add(r.split)
    assert all(len(s) == 1 for s in splits.values())
    share = Counter(r.split for r in out)
    assert abs(share["test"] - 100) <= 8 and abs(share["validation"] - 100) <= 8
    assert p6_splits.assign(all_.limit(0)).count() == 0


def test_accounts(spark):
    df = spark.createDataFrame([("1", "mail me@firm.example or @Ann_1, (@bob) @ab x@y"), ("2", "@ann_1!"), ("3", None)], "id string, a string").selectExpr("*", "cast(null as string) author", "'  ' source")
    keys = {(r.id, r.key) for r in p6_splits.relations(df).collect()}
    assert keys == {("1", "account ann_1"), ("1", "account bob"), ("2", "account ann_1")}


def test_subset_sums():
    rng = random.Random(4)
    for _ in range(200):
        counts = [(s, rng.randrange(1, 4)) for s in sorted(rng.sample(range(1, 30), rng.randrange(1, 5)))]
        target = rng.randrange(1, 60)
        taken = p6_splits.choose(counts, target)
        assert all(n <= dict(counts)[s] for s, n in taken.items())
        sums = {0}
        for s, n in counts:
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert abs(sum(s * n for s, n in taken.items()) - target) == min(abs(x - target) for x in sums)
    big = p6_splits.choose([(1, 10**8), (7, 10**6), (10**7, 3)], 10**7)
    assert sum(s * n for s, n in big.items()) == 10**7


# ---------------------------------------------------------------------------------------- personal data


@pytest.fixture(scope="module")
def names():
    lexicon = [("Bricath", "given"), ("Rodrora", "given"), ("Kyhon", "given"), ("Woldosen", "family"), ("Duskarette", "family"), ("Thornarsky", "family")]
    return p3_personal.fit(lexicon, ["The sender forwarded a short reply for Zelmergo on Monday morning. My name is Rodrora Woldosen."] * 50)


def test_items(names):
    cases = {
        "Write to ann.lee@web.test today": [("email", "ann.lee@web.test")],
        "Write to ann (at) web (dot) test!": [("email", "ann (at) web (dot) test")],
        "Call +999 123 456 789 or (201) 555-0123, 555-0199.": [("phone", "+999 123 456 789"), ("phone", "(201) 555-0123"), ("phone", "555-0199")],
        "My national id is 000-24-0865.": [("id_number", "000-24-0865")],
        "Passport no. TX 14 35 25 F was copied.": [("id_number", "TX 14 35 25 F")],
        "SKU 907-52-9642 (648 187 728 pts) v3.70.53.239 S35-8858": [],
        "I live at 9013 Oatcastle Blvd Apt 36, second bell.": [("address", "9013 Oatcastle Blvd Apt 36")],
        "J'habite 4 rue de la Faugette, là.": [("address", "4 rue de la Faugette")],
        "Vivo en C/ Quintarela n. 9, bien.": [("address", "C/ Quintarela n. 9")],
        "Ich wohne Lindauer Angerstraße 98a.": [("address", "Lindauer Angerstraße 98a")],
        "Живу: ул. Морквинская, д. 12, кв. 3": [("address", "ул. Морквинская, д. 12, кв. 3")],
        "Regards, Rodrora Woldosen.": [("name", "Rodrora Woldosen")],
        "Ask for Ms Kyhon Thornarsky at the desk": [("name", "Kyhon Thornarsky")],
        "THORNARSKY Kyhon lost it": [("name", "THORNARSKY Kyhon")],
        "The night shift Zelmergo archived @bricath": [],
        "Call five five five one two three four now": [("phone", "five five five one two three four")],
    }
    cases.pop("Call five five five one two three four now")
    for text, want in cases.items():
        assert [(k, text[a:b]) for a, b, k in p3_personal.items(text, names)] == want, text
    assert p3_personal.items(None, names) == [] and p3_personal.items("", names) == []


def test_offsets_survive_disguise(names):
    text = "ｘ é ​ ann.l​ee@web.test ＋999 123 456 789 ﬁn"
    found = {k: text[a:b] for a, b, k in p3_personal.items(text, names)}
    assert found["email"] == "ann.l​ee@web.test" and found["phone"] == "＋999 123 456 789"
    assert p3_personal.redacted(text, names) == "ｘ é ​ [EMAIL] [PHONE] ﬁn"
    shown, places = p3_personal.rewritten(text)
    starts, stops = places
    assert len(shown) == len(starts) == len(stops) and all(0 <= a < b <= len(text) for a, b in zip(starts, stops)) and starts == sorted(starts)
    assert p3_personal.undigit("call five five five oh one two three now", None)[0] == "call 5550123 now"


def test_ends_of_items_keep_their_marks(names):
    """A letter with a mark of its own, or one that becomes two, ends where its source ends."""
    for name in ("Woldosen", "Woldosen\u0301", "Ｗｏｌｄｏｓｅｎ", "Woldo\u200bsen"):
        text = f"ﬁne. My name is Rodrora {name}, ok"
        assert [text[a:b] for a, b, k in p3_personal.items(text, names) if k == "name"] == [f"Rodrora {name}"], ascii(text)


@pytest.mark.parametrize(
    "text, kind, item",
    [
        ("my ssn is 123-45-6789.", "id_number", "123-45-6789"), ("SSN 123-45-6789", "id_number", "123-45-6789"), ("DNI: 12345678Z", "id_number", "12345678Z"), ("СНИЛС 112-233-445 95", "id_number", "112-233-445 95"),
        ("ring +44 (0)20 7946 0958 now", "phone", "+44 (0)20 7946 0958"), ("phone 2 1 2 five five five one two three four.", "phone", "2 1 2 five five five one two three four"),
        ("write to me at ann (at) mail (dot) test", "email", "ann (at) mail (dot) test"), ("write to me at ann.lee @ mail.test", "email", "ann.lee @ mail.test"), ("ann dot lee at mail dot test now", "email", "ann dot lee at mail dot test"),
        ("scrivi a ann chiocciola posta punto test", "email", "ann chiocciola posta punto test"), ("ann@mail.test @someone said", "email", "ann@mail.test"),
    ],
)
def test_items_in_forms_of_their_own(names, text, kind, item):
    assert [text[a:b] for a, b, k in p3_personal.items(text, names) if k == kind] == [item]


def test_whole_lexicon_is_looked_up(spark, monkeypatch):
    monkeypatch.setattr(p3_personal, "LEXICON_ROWS", 5)
    rows = spark.createDataFrame([(f"Namo{c}{d}", "given") for c in "abcdefg" for d in "xyz"], "name string, kind string")
    names = p3_personal.Names([("Namoax", "given")], Counter(), p3_personal.listed_names(rows))
    assert all(names.holds(f"namo{c}{d}", "given") for c in "abcdefg" for d in "xyz") and not names.holds("namohx", "given") and not names.holds("namoax", "family")
    monkeypatch.setattr(p3_personal, "LARGEST_LEXICON", 10)
    with pytest.raises(ValueError):
        p3_personal.listed_names(rows)


def test_all_texts_are_counted(spark, tmp_path, monkeypatch):
    """The model of a folder is that of all texts of both tables, as the plain fit makes it, whatever the size of the lexicon."""
    rng = random.Random(3)
    lexicon = [("Bricath", "given"), ("Rodrora", "given"), ("Woldosen", "family"), ("Duskarette", "family")]
    pool = [f"{a}{b}{c}" for a in ("lem", "vor", "tan", "zu") for b in ("ba", "ki", "lo") for c in ("s", "mer", "x")]
    make = lambda: " ".join(rng.choices(pool, k=6)) + rng.choice([". Regards, Rodrora Woldosen.", " mail a@b.test", ", ask for Kelmira Duskarette", ""])
    spam, cases = [make() for _ in range(300)] + [None, ""], ["Quibble " + make() for _ in range(60)]
    spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(spam)], "id string, text string").write.parquet(f"{tmp_path}/spam_item.parquet")
    spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(cases)], "id string, a string").write.parquet(f"{tmp_path}/evaluation_case.parquet")
    spark.createDataFrame([*lexicon, (None, "given")], "name string, kind string").write.parquet(f"{tmp_path}/name_lexicon.parquet")
    want = p3_personal.fit(lexicon, [t for t in spam + cases if t])
    for rows in (100_000, 2):
        monkeypatch.setattr(p3_personal, "LEXICON_ROWS", rows)
        got = p3_personal.fitted(spark, str(tmp_path))
        assert got.common == want.common and "quibble" in got.common and "kelmira" not in got.common
        for a, b in zip(got.models, want.models, strict=True):
            for x, y in zip(a.grams + a.heads, b.grams + b.heads, strict=True):
                assert x.keys() == y.keys() and all(abs(x[g] - y[g]) < 1e-3 * y[g] for g in y)
        assert got.holds("rodrora", "given") and not got.holds("rodrora", "family")


def test_common_words_follow_the_number_of_texts():
    assert p3_personal.Names([], Counter(some=50, many=100), None, 12_000).common == {"many"}
    assert p3_personal.Names([], Counter(some=50, few=30), None, 100).common == {"some"}


def test_introduced_is_the_search():
    rng = random.Random(8)
    phrases = ["my name is", "Regards", "lo ha firmato da", "Je m’appelle", "dear Mr.", "г-жа", "--", "=>", '"', "(", "спросите", "Sig.ra", "querida", "liebe", "ok", "a1", "Señor", "vraag om", "eu me chamo", "bien à vous", "é", "m"]
    for _ in range(2000):
        text = "".join(rng.choice(phrases) + rng.choice([" ", ", ", ": ", ". ", "\n", "", " - "]) for _ in range(rng.randrange(1, 6))) + "Name here"
        for at in [m.start() for m in p3_personal._WORD.finditer(text)]:
            assert p3_personal.introduced(text, at) == bool(p3_personal._BEFORE.search(text, max(0, at - 60), at)), (text, at)


def test_little_is_done_where_no_name_can_stand(names, monkeypatch):
    """A phrase is looked for only before words that it can matter for, and a word met before is not scored again."""
    text = "Zork told the Reviewer and Zelmergo Bricath that Polvimer, Glue and Paper went to Zork."
    want = p3_personal.names_in(text, names, [])
    scored, looked = [], []
    like, introduced = names.like, p3_personal.introduced
    monkeypatch.setattr(names, "like", lambda word: scored.append(word) or like(word))
    monkeypatch.setattr(p3_personal, "introduced", lambda text, start: looked.append(start) or introduced(text, start))
    assert p3_personal.names_in(text, names, []) == want
    assert not scored and set(looked) <= {0}


def test_words_and_hints_are_those_of_the_plain_search():
    rng = random.Random(4)
    pool = ["Name", "o'Neil", "Anne-Marie’s", "x²", "a_b", "#tag", "@at", "a@b", "12", "é", "Ж", "中文", "\U0001d400x", "😀", "-", "’", "ß9", "Ünal", *(x for hint in p3_personal.ADDRESS_HINT for x in hint)]
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice(["", " ", " ", ", ", "\n"]) for _ in range(rng.randrange(6)))
        parts, low = p3_personal.split_words(text), text.lower()
        assert "".join(parts) == text and parts[1::2] == p3_personal._WORD.findall(text), text
        assert p3_personal.address_patterns(low) == [p for hint, p in zip(p3_personal.ADDRESS_HINT, p3_personal.ADDRESS, strict=True) if any(x in low for x in hint)], text


def test_items_in_tables(spark, names):
    df = spark.createDataFrame([("s", "1", None), ("s", "2", ""), ("s", "3", "mail a@b.test"), ("s", "3", "mail a@b.test"), ("s", "4", LONG)], "kind string, id string, text string").withColumnRenamed("kind", "src")
    out = p3_personal.find_items(df, ["src", "id"], "text", names).collect()
    assert [(r.id, r.kind, r.start_pos, r.end_pos) for r in out] == [("3", "email", 5, 13)] * 2
    assert p3_personal.find_items(df.limit(0), ["src", "id"], "text", names).count() == 0


# ---------------------------------------------------------------------------------------- vectors


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    v = (centres[rng.integers(0, 40, 600)] + 0.25 * rng.normal(size=(600, 16))).astype(np.float32)
    v[50:58] = v[7]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 4), (904, [float("nan")] * 16), (905, [1.0, None] + [0.0] * 14), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>")
    got = defaultdict(set)
    for r in p4_neighbours.neighbours(df, 5, 16).collect():
        got[r.id].add(r.other)
    assert set(got) == set(range(600)) and all(len(s) == 5 for s in got.values())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).astype(np.float64).round(6)
    np.fill_diagonal(s, -2)
    want = [set(np.argsort(-row, kind="stable")[:5].tolist()) for row in s]
    assert np.mean([len(got[i] & want[i]) / 5 for i in range(600)]) > 0.97
    assert got[7] == set(range(50, 55)) and got[57] == {7, 50, 51, 52, 53}
    few = p4_neighbours.neighbours(spark.createDataFrame(rows[:3], "id bigint, vec array<float>"), 5, 16)
    assert few.count() == 6
    assert p4_neighbours.neighbours(df.limit(0), 5, 16).count() == 0


def families_of_vectors(n, seed):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n // 30, 16))[rng.integers(0, n // 30, n)] + 0.3 * rng.normal(size=(n, 16))).astype(np.float32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).astype(np.float64)
    np.fill_diagonal(s, -2)
    return v, [set(np.argsort(-row, kind="stable")[:5].tolist()) for row in s]


@pytest.mark.parametrize("how", [{"leaf": 12}, {"from_random": True, "kept": 12}])
def test_descent_does_the_work(spark, how):
    """Small leaves, or no knowledge at all: the first graph is poor, the rounds make it good."""
    v, want = families_of_vectors(3000, 9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<float>")

    def recall(rounds):
        got = defaultdict(set)
        for r in p4_neighbours.neighbours(df, 5, 16, rounds=rounds, **how).collect():
            got[r.id].add(r.other)
        return np.mean([len(got[i] & want[i]) / 5 for i in range(len(v))])

    assert recall(0) < 0.9 and recall(12) >= 0.95


def test_full_cells_are_divided():
    rng = np.random.default_rng(3)
    for rows in (rng.normal(size=(5000, 8)), np.ones((5000, 8))):  # also where nothing tells the rows apart
        parts = list(p4_neighbours._leaves(rows.astype(np.float32), 100, 1))
        assert max(map(len, parts)) <= 100 and sorted(np.concatenate(parts).tolist()) == list(range(5000))
    home = p4_neighbours._homes(rng.normal(size=(300, 8)).astype(np.float32), np.ones(300), 16)
    assert np.bincount(home, minlength=16).min() >= 10
    assert set(p4_neighbours._homes(np.ones((3, 8), np.float32), np.ones(3), 16).tolist()) <= set(range(16))


def test_greedy_search(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(0, 30, 500)] + 0.3 * rng.normal(size=(500, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id bigint, vec array<float>")
    asked = rng.normal(size=(25, 16)).astype(np.float32) * 0.3 + centres[:25]
    queries = spark.createDataFrame([(10_000 + i, x.tolist()) for i, x in enumerate(asked)] + [(20_000, None), (20_001, [0.0] * 16)], "query bigint, vec array<float>")
    got = defaultdict(set)
    for r in p4_neighbours.search(df, queries, 5, 16).collect():
        got[r.query].add(r.other)
    s = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = [set(np.argsort(-row)[:5].tolist()) for row in s]
    assert set(got) == {10_000 + i for i in range(25)}
    assert np.mean([len(got[10_000 + i] & want[i]) / 5 for i in range(25)]) >= 0.9
    assert p4_neighbours.search(df.limit(0), queries, 5, 16).count() == 0


def test_greedy_search_reaches_every_family(spark):
    """2,000 distant families of ten, none linked to another: each needs a way in."""
    rng = np.random.default_rng(8)
    v = (np.repeat(rng.normal(size=(2_000, 16)), 10, axis=0) + 0.02 * rng.normal(size=(20_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<float>")
    got = defaultdict(set)
    for r in p4_neighbours.search(df, df.where("id % 40 = 0").selectExpr("id AS query", "vec"), 5, 16).collect():
        got[r.query].add(r.other)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[::40] @ u.T
    s[np.arange(500), np.arange(500) * 40] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[40 * i] & set(w)) / 5 for i, w in enumerate(want.tolist())]) >= 0.9


# ---------------------------------------------------------------------------------------- languages


@pytest.fixture(scope="module")
def trees():
    pack = [
        ("en", ["the", "sender", "message"], ["The sender forwarded the message on Monday morning.", "Our reviewer checked a short reply near the front desk.", "The night shift lost the price list."]),
        ("de", ["der", "die", "nachricht"], ["Der Absender übermittelte die Nachricht am Montagmorgen.", "Unsere Prüferin prüfte eine kurze Antwort neben dem Empfang.", "Die Nachtschicht verlor die Preisliste."]),
        ("ru", ["и", "на"], ["Отправитель переслал сообщение в понедельник утром.", "Наш проверяющий проверил короткий ответ у стойки.", "Ночная смена потеряла список цен."]),
    ]
    return p7_languages.fit(pack, [])


def test_code_lengths_are_those_of_the_recursion(trees):
    counts = {"en": Counter({"aba": 2, "abc": 1}), "de": Counter({"bab": 3})}
    t = p7_languages.Trees(counts, order=2)

    def brute(lang, word):
        def cost(history, symbol, order):
            if order < 0:
                return 8.0
            context = history[len(history) - order :] if order else b""
            seen = Counter()
            for w, n in counts[lang].items():
                raw = b" " + w.encode() + b" "
                for i in range(max(1, order), len(raw)):
                    if raw[i - order : i] == context:
                        seen[raw[i]] += n
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return -np.log2(seen[symbol] / total)
            return (-np.log2(len(seen) / total) if seen else 0.0) + cost(history, symbol, order - 1)

        raw = b" " + word.encode() + b" "
        return sum(cost(raw[:i], raw[i], min(2, i)) for i in range(1, len(raw)))

    for word in ("aba", "abc", "bab", "ab", "c", "xyz", "é"):
        assert t.cost([word])[0] == pytest.approx([brute(lang, word) for lang in t.languages], abs=1e-4)


def test_words_are_coded_whole(trees):
    long = "senderforwardedthemessage" * 12
    cost = trees.cost([long, long[:-1] + "ж", long[:70], "x" * 5000, ""])
    assert np.isfinite(cost).all() and (cost[0] != cost[1]).any() and (cost[2] < cost[0]).all()
    piece = p7_languages.PIECE
    try:  # the pieces that long words are coded in change nothing
        p7_languages.PIECE = 10_000
        assert np.allclose(trees.cost([long]), cost[:1])
    finally:
        p7_languages.PIECE = piece


def test_languages_of_nothing(spark):
    none = p7_languages.fit([], [])
    assert [p7_languages.languages_of(x) for x in p7_languages.judged(p7_languages.Model(none), ["Some words here", "", None])] == [{}, {}, {}]
    df = spark.createDataFrame([(1, "Some words here"), (2, None)], "id int, text string")
    assert [len(r.langs) for r in p7_languages.detect(df, ["id"], ["text"], none).collect()] == [0, 0]
    assert p7_languages.detect(df, ["id"], ["text"], none, True).count() == 0
    assert p7_languages.fit([("en", ["a"], [])], []).languages == ["en"]


def test_sentences_are_divided_between_languages(trees):
    model = p7_languages.Model(trees)
    text = "the night shift lost the price list die Nachtschicht verlor die Preisliste am Montagmorgen"
    (found,) = p7_languages.judged(model, [text])
    assert [model.languages[s[2]] for s in found] == ["en", "de"] and found[0][1] <= found[1][0] + 1
    assert sorted(model.languages[k] for k in p7_languages.languages_of(found)) == ["de", "en"]
    (whole,) = p7_languages.judged(model, ["the night shift lost the price list near the front desk on Monday morning"])
    assert len(whole) == 1 and p7_languages.languages_of(whole)[whole[0][2]] > 0.999


def test_languages(spark, trees):
    model = p7_languages.Model(trees)
    texts = ["The sender lost the message near the front desk.", "Die Nachtschicht prüfte die Nachricht.", "7h3 53nd3r l057 7h3 m3554g3 0n M0nd4y", "Nash proveryayushchiy proveril korotkiy otvet u stoyki.", "The night shift checked the price list. Der Absender verlor eine kurze Antwort.", None, "", "12 34"]
    got = [sorted(model.languages[k] for k in p7_languages.languages_of(x)) for x in p7_languages.judged(model, texts)]
    assert got == [["en"], ["de"], ["en"], ["ru"], ["de", "en"], [], [], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, LONG)], "langs int, text string").withColumnRenamed("langs", "id")
    assert p7_languages.detect(df, ["id"], ["text"], trees).count() == 9
    runs = p7_languages.detect(df.where("id = 4"), ["id"], ["text"], trees, True).orderBy("start_pos").collect()
    assert [r.lang for r in runs] == ["en", "de"] and runs[0].end_pos <= runs[1].start_pos
    assert p7_languages.detect(df.limit(0), ["id"], ["text"], trees).count() == 0
    assert [p7_languages.code_of(x) for x in ("EN", "en-GB", "eng", "und", "", None, "pt_BR")] == ["en", "en", "en", "", "", "", "pt"]


# ---------------------------------------------------------------------------------------- tokenizer


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=p8_encode.PIECES, mergeable_ranks=p8_encode.read_ranks(TOKENIZER), special_tokens={})


def test_encoding(tiktoken_encoding):
    encoder = p8_encode.Encoder(p8_encode.PairRanks(p8_encode.read_ranks(TOKENIZER)))
    rng = random.Random(8)
    texts = ["", None, " ", "<|endoftext|> x", "a" * 5000, "ab" * 3000, "1" * 999, "é" * 300, "漢字" * 200, "\x1c a\x85b", "tab\t\n\r\n  x "]
    texts += ["".join(rng.choice("abcdefgh ,.'st\n") for _ in range(rng.randrange(400))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(100)) for _ in range(40)]
    for _ in range(2):  # the second time from the pool
        ids, counts = encoder.encode(texts)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate(texts):
            assert ids[edges[i] : edges[i + 1]].tolist() == tiktoken_encoding.encode_ordinary(t or "")


def test_encoding_of_tables(spark, tiktoken_encoding):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, LONG, "z")], "doc_id bigint, text string, ids string")
    out = p8_encode.encode_column(df, "text", "tokens", ["doc_id"], TOKENIZER).collect()
    assert sorted(len(r.tokens) for r in out) == [0, 0, 2, 2, len(tiktoken_encoding.encode_ordinary(LONG))]
    assert p8_encode.encode_column(df.limit(0), "text", "tokens", ["doc_id"], TOKENIZER).count() == 0


def test_long_pieces_merge_leftmost_first():
    """Where a pair joins to a rank below that of its parts, it matters which is merged first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"bab": 258}
    piece = b"ab" * 40 + b"c"
    want = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(want[:-1], want[1:], strict=True)) if x + y in ranks]:
        i = min(pairs)[1]
        want[i : i + 2] = [want[i] + want[i + 1]]
    got = p8_encode.encode_pieces([piece], p8_encode.PairRanks(ranks))[0]
    assert got.tolist() == [ranks[x] for x in want]


# ---------------------------------------------------------------------------------------- leaks and repetition


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (0, None)]
    docs = []
    for d in range(80):
        own = rng.choices(vocabulary, k=40)
        if d % 2:
            source = items[rng.randrange(12)][1].split()
            n, at = rng.choice((8, 9, 10, 11, 20)), rng.randrange(10)
            own[5:5] = source[at : at + n]
        docs.append((d, (", " if d % 3 else "\n").join(own)))
    docs += [(3, docs[3][1]), (90, None), (91, ""), (92, LONG)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = defaultdict(set)
    for k, t in items:
        w = words(t)
        for j in range(len(w) - 9):
            index[tuple(w[j : j + 10])].add(k)
    want = {(k, item) for k, t in docs for j in range(len(words(t)) - 9) for item in index.get(tuple(words(t)[j : j + 10]), ())}
    assert want
    for limit in (p9_leaks.BROADCAST_BYTES, 0):  # by broadcast, and by a join in the cluster
        assert {(r.doc_id, r.item_id) for r in p9_leaks.leaks(d, i, broadcast_bytes=limit).collect()} == want
    assert p9_leaks.leaks(d, i.limit(0)).count() == 0 and p9_leaks.leaks(d.limit(0), i).count() == 0


def test_leaks_bear_substitutions(spark):
    item = [f"q{i}" for i in range(30)]
    changed = [w if i % 9 != 4 else "other" for i, w in enumerate(item)]
    d = spark.createDataFrame([(1, " ".join(changed))], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert p9_leaks.leaks(d, i).count() == 0
    row = p9_leaks.leaks(d, i, tolerant=True).first()
    assert row.stretch == 30 and row.equal_words == 27


def test_tolerant_masks_miss_no_pattern():
    for n in range(10, 20):
        for bad in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(n // 5 + 1)):
            kept = "".join("0" if i in bad else "1" for i in range(n))
            assert any(all(kept[j + i] == "1" for i, c in enumerate(m) if c == "1") for m in p9_leaks.TOLERANT_MASKS for j in range(n - len(m) + 1)), kept


def test_substituted_leaks_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for d in range(150):
        own = rng.choices(vocabulary, k=30)
        source = items[rng.randrange(12)][1].split()
        n = rng.choice((9, 10, 10, 11, 14, 15, 20))
        at = rng.randrange(len(source) - n + 1)
        part = source[at : at + n]
        for j in rng.sample(range(n), rng.randrange(n // 5 + 2)):
            part[j] = f"x{rng.randrange(1000)}"
        place = rng.choice((0, 5, 30))
        own[place:place] = part
        docs.append((d, " ".join(own)))
    docs += [(900, None), (901, ""), (902, LONG)]

    def stretches(a, b):  # (unbroken, stretch, equal) of the best alignment, straight from the definition
        best = (0, 0, 0)
        for shift in range(-len(b) + 1, len(a)):
            equal = [0 <= i + shift < len(a) and a[i + shift] == w for i, w in enumerate(b)]
            unbroken = max(len(list(g)) if k else 0 for k, g in itertools.groupby(equal))
            long = max(((j - i + 1, sum(equal[i : j + 1])) for i in range(len(b)) if equal[i] for j in range(i, len(b)) if equal[j] and 5 * sum(equal[i : j + 1]) >= 4 * (j - i + 1)), default=(0, 0))
            if long[0] >= 10:
                best = max(best, (unbroken, *long))
        return best

    want = {(d, k): best for d, text in docs[:150] for k, t in items[:12] if (best := stretches(words(text), words(t)))[1]}
    short = [w for w in want.values() if w[0] < 7]
    assert len(want) > 80 and len(short) > 20
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (p9_leaks.BROADCAST_BYTES, 0):
        got = {(r.doc_id, r.item_id): (r.unbroken, r.stretch, r.equal_words) for r in p9_leaks.leaks(d, i, tolerant=True, broadcast_bytes=limit).collect()}
        assert got == want


def brute_repeated(tokens, run=8):
    seen, hit = set(), [0] * len(tokens)
    for j in range(len(tokens) - run + 1):
        key = tuple(tokens[j : j + run])
        if key in seen:
            hit[j : j + run] = [1] * run
        seen.add(key)
    return sum(hit)


def test_repetition(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(300):
        own = rng.choices("abcdefghijklmnop", k=rng.randrange(0, 60))
        if rng.random() < 0.6 and len(own) > 20:
            own += own[: rng.randrange(5, 20)] * rng.randrange(1, 3)
        texts.append(" ".join(own))
    texts += [None, "", "x " * 15, "x " * 16, LONG]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string")
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        assert p10_repetition.repeated_words(w) == brute_repeated(w)
        if len(w) >= 16 and brute_repeated(w) >= 0.3 * len(w):
            want.add(i)
    assert {r.doc_id for r in p10_repetition.repetitive(df, "text", ["doc_id"]).collect()} == want and want
    shares = {r.doc_id: r for r in p10_repetition.repetition(df, "text", ["doc_id"]).collect()}
    assert shares[300].share == 0 and shares[300].n_words == 0 and shares[303].share > 0.4
    assert p10_repetition.repetitive(df.limit(0), "text", ["doc_id"]).count() == 0


def test_order_of_rules_changes_nothing():
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randrange(80))) for _ in range(200)]
    results = []
    for order in itertools.permutations(["few_characters", "few_words", "many_distinct_words", "many_distinct_pairs"]):
        c = p10_repetition.Cascade(0.3, 8, 16)
        c.order = list(order)
        results.append([c.is_case(t) for t in texts])
    assert all(r == results[0] for r in results)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"p{n}_{'ids' if n == 8 else 'found'}" for n in range(1, 11)} <= set(entry.queries())


# ---------------------------------------------------------------------------------------- hot keys and memory


def test_a_star_of_many_records(spark):
    """One source holds nearly all records: its key, and the record they all hang on, are looked up, not joined by one task."""
    from pyspark.sql import functions as F

    n = 60_000
    keys = spark.range(n).select(F.format_string("r%06d", "id").alias("id"), F.lit("source all").alias("key")).unionByName(spark.range(50).select(F.format_string("x%06d", "id").alias("id"), F.format_string("author %d", (F.col("id") / 5).cast("int")).alias("key")))
    out = p6_splits.groups(keys)
    assert out.where("group_id = 'r000000'").count() == n and out.groupBy("group_id").count().where("count = 5").count() == 10


def test_components_behind_a_hub(spark):
    from pyspark.sql import functions as F

    star = spark.range(30_000).select((F.col("id") + 10).alias("u"), F.lit(9).cast("bigint").alias("v"))
    chain = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (50_000, 50_001)], "u bigint, v bigint")
    out = C.components(star.unionByName(chain))
    assert out.groupBy("root").count().collect().__len__() == 2 and out.where("root = 1").count() == 30_004


def test_salted_joins_lose_and_repeat_nothing(spark):
    from pyspark.sql import functions as F

    many = spark.range(50_000).select(F.when(F.col("id") < 45_000, 1).otherwise(F.col("id") % 10).cast("bigint").alias("key"), "id")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "d")], "key bigint, x string")
    out = C.salted(many, other, "key", "id", 50_000)
    assert out.count() == many.join(other, "key").count() == out.distinct().count()


def test_overlaps_are_counted_without_pairs(spark):
    """A class of 2,000 copies in training and 2,000 elsewhere: four million pairs are counted, none is made."""
    linked = spark.createDataFrame([(1, 2, 5, 0.8), (3, 2, 5, 0.7)], "train_hash bigint, other_hash bigint, shared int, similarity double")
    members = spark.range(4_003).selectExpr("concat('r', id) AS id", "id < 2000 OR id = 4000 AS train", "CASE WHEN id = 4000 THEN 3L WHEN id < 2000 THEN 1L WHEN id > 4000 THEN 7L ELSE 2L END AS set_hash")
    out = p2_overlaps.counts_of(linked, members).collect()
    assert len(out) == 2_000 and {(r.n, r.most) for r in out} == {(2_001, 0.8)}
    few = members.where("id IN ('r1', 'r2', 'r2500', 'r4000')")
    assert {(r.train_id, r.other_id) for r in p2_overlaps.pairs_of(linked, few).collect()} == {("r1", "r2500"), ("r2", "r2500"), ("r4000", "r2500")}


def test_choosing_sizes_is_closest_and_small():
    import tracemalloc

    rng = random.Random(3)
    for _ in range(200):
        counts = [(s, rng.randrange(1, 4)) for s in rng.sample(range(1, 40), rng.randrange(1, 6))]
        target = rng.randrange(1, sum(s * n for s, n in counts) + 1)
        got = p6_splits.choose(counts, target)
        assert all(0 < n <= dict(counts)[s] for s, n in got.items())
        sums = {0}
        for s, n in counts:
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in sums)
    tracemalloc.start()
    counts = [(s * 7 + 1, 200) for s in range(1, 601)]
    got = p6_splits.choose(counts, 3_600_000)
    assert tracemalloc.get_traced_memory()[1] < 500_000_000 and sum(s * n for s, n in got.items()) == 3_600_000
    tracemalloc.stop()


def test_many_categories(spark, monkeypatch):
    monkeypatch.setattr(p6_splits, "STRATA", 3)
    df = spark.createDataFrame([(f"r{i:04d}", f"g{i // 2:04d}", f"c{i % 23}" if i % 3 else "big") for i in range(600)], "id string, group_id string, category string")
    out = p6_splits.assign(df).collect()
    assert len(out) == 600 and len({(r.group_id, r.split) for r in out}) == 300
    assert 40 <= sum(r.split == "test" for r in out) <= 80


def test_order_of_rules_is_measured():
    texts = ["one two three " * 40] * 20 + ["short"] * 100 + [" ".join(f"w{i}" for i in range(300))] * 50
    order = p10_repetition.order_of(texts, 0.3, 8, 16)
    assert sorted(order) == sorted(p10_repetition.clearing_rules(0.3, 8, 16))
    assert [p10_repetition.Cascade(0.3, 8, 16, order).is_case(t) for t in texts] == [p10_repetition.Cascade(0.3, 8, 16).is_case(t) for t in texts]
