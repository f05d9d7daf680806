"""The training-data operators on small tables, against brute force or planted cases."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re
import unicodedata

import pytest

from hodonym.llm import label_model, leakage, packing, person_names, skeletons
from hodonym.llm.canonical_values import Dictionary, canonical, dictionary, edit_cost, fold, mapped_values
from hodonym.llm.format_duplicates import _carry, copy_counts, format_duplicates
from hodonym.llm.queries import LLM_QUERIES, LLM_SQL
from hodonym.llm.street_linkage import cadastre_side, registry_side, street_links
from hodonym.llm.survivors import field_winners, street_survivors
from hodonym.llm.term_counts import item_counts, mark_items
from tests.compare import DATA, connection, same

TYPES = [("Strada", "Str."), ("Aleea", "Al."), ("Bulevardul", "Bd."), ("Intrarea", "Int."), ("Fundătura", "Fund."), ("Piața", "Pța"), ("Șoseaua", "Sos."), ("Stradela", "Str-la"), ("Cheiul", None), ("Drumul", "Drm.")]
rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
day = lambda n: dt.datetime(2022, 1, 1) + dt.timedelta(days=n)


def types_table(spark):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TYPES)], "type_id int, road_type string, abbreviation string")


def streets_table(spark, data, extra=""):
    """(id, judet, uat, artera_raw, name, core_name, day)"""
    full = [(i, j, u, None, a, None, n, fold(n or ""), c, fold(c or "") or None, day(k)) for i, j, u, a, n, c, k in data]
    df = spark.createDataFrame(full, "id long, judet string, uat string, siruta int, artera_raw string, street_type string, name string, name_normalized string, core_name string, core_name_norm string, recorded_at timestamp")
    return df.selectExpr("*", "'clash' key", "'clash' kind", "1 muni", "2 head", "'x' words")  # columns with names that the operators use


# ---- 2 ----------------------------------------------------------------------------------------------------------------


def brute_duplicates(data):
    groups = {}
    for i, scope, text in data:
        words = tuple(sorted(re.findall(r"[^\W_]+", (text or "").lower())))
        if words:
            groups.setdefault((scope, words), []).append(i)
    return sorted(((min(g), x) for g in groups.values() for x in g if x != min(g)), key=str)


def test_format_duplicates(spark):
    rng = random.Random(5)
    texts = ["Strada Unirii", "strada  UNIRII", "Unirii, Strada", "Strada-Unirii", "Strada\tUnirii ", "Strada Ştefan", "Strada Ștefan", "", " - ", None, "a a b", "a b b", "x" * 50_000]
    data = [(i, rng.choice(["A", "B", None]), rng.choice(texts)) for i in range(500)]
    data += [(1000 + i, "A", rng.choice(["Hot Key", "key HOT"])) for i in range(700)]  # more than half of all rows in one group
    df = spark.createDataFrame(data, "id long, scope string, t string").selectExpr("*", "'k' key", "'b' bag").repartition(7)
    assert rows(format_duplicates(df, "id", "t", ["scope"])) == brute_duplicates(data)
    counts = {r.first_id: r.n_copies for r in copy_counts(df, "id", "t", ["scope"]).collect()}
    assert sum(counts.values()) == sum(1 for _, _, t in data if re.search(r"[^\W_]", t or ""))
    assert rows(format_duplicates(df.limit(0), "id", "t", ["scope"])) == []


def test_runs_over_many_partitions():
    # a run that fills whole partitions keeps its first head
    assert _carry([(0, 5, 2, "k"), (0, 5, -1, "a"), (1, 9, 1, "k"), (1, 9, -1, "k"), (3, 12, 2, "z"), (3, 12, -1, "k")]) == {1: 5, 3: 5}


# ---- 4 ----------------------------------------------------------------------------------------------------------------


def test_term_counts(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "de", "x" * 30_000]
    data = [(i, rng.choice([None, "", " ", "a", "a a", "b a\tc", " ".join(rng.choices(words[:4], k=3)), words[4]])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, f string").selectExpr("id", "f", "f g", "'z' item").repartition(5)
    want = {}
    for _, f in data:
        if f:
            want.setdefault(("value", f), [0, 0])
            want["value", f] = [x + 1 for x in want["value", f]]
            for t in f.split():
                want.setdefault(("term", t), [0, 0])[0] += 1
            for t in set(f.split()):
                want["term", t][1] += 1
    got = item_counts(df, ["f", "g"])
    assert {(r.kind, r["item"]): [r.occurrences, r.records] for r in got.where("field = 'g'").collect()} == want
    marks = {(r.kind, r["item"]): r.mark for r in mark_items(got, df, common=5).where("field = 'f'").collect()}
    assert all(m == ("rare" if want[k][1] == 1 else "common" if want[k][1] * 5 > 400 else None) for k, m in marks.items())
    assert item_counts(df.limit(0), ["f"]).count() == 0


# ---- edits -----------------------------------------------------------------------------------------------------------


def test_all_texts_within_one_edit_meet(spark):
    from pyspark.sql import functions as F

    from hodonym.llm.edits import half_blocks

    rng = random.Random(21)
    words = {"".join(rng.choices("abc", k=rng.randrange(5, 9))) for _ in range(400)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    ours = df.select("w", F.explode(F.array(*half_blocks(F.col("w"), [0]))).alias("x")).select("w", "x.*")
    theirs = df.select(F.col("w").alias("t"), F.explode(F.array(*half_blocks(F.col("w"), [-1, 0, 1]))).alias("x")).select("t", "x.b", F.col("x.rest").alias("r"))
    met = {tuple(r) for r in theirs.join(ours, "b").where(F.levenshtein("rest", "r", 1) >= 0).select("t", "w").distinct().collect()}
    assert {(a, b) for a in words for b in words if osa(a, b) <= 1} <= met


# ---- 7 ----------------------------------------------------------------------------------------------------------------


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_dictionary_finds_every_single_edit():
    d = Dictionary(TYPES)
    rng = random.Random(4)
    for form in d.full:
        for _ in range(60):
            i, c = rng.randrange(len(form)), rng.choice("abcdefghijklmnopqrstuvwxyz")
            w = rng.choice([form[:i] + form[i + 1 :], form[:i] + c + form[i:], form[:i] + c + form[i + 1 :], form[:i] + form[i + 1 : i + 2] + form[i] + form[i + 2 :]])
            if len(w) >= 3 and len(form) >= 4:
                near = {e for f, es in d.full.items() if len(f) >= 4 and osa(w, f) <= 1 for e in es}
                assert d.token(w)[2] in near | d.forms.get(w, set()), (w, form)
            assert edit_cost(w, form) <= 1


@pytest.mark.parametrize(
    ("typed", "want"),
    [("STRADA", "Strada"), (" Str.", "Strada"), ("stradă", "Strada"), ("Strada aleea", "Aleea"), ("Strada strada", "Strada"), ("Bd-ul", "Bulevardul"), ("B-dul", "Bulevardul"), ("Intr.", "Intrarea"), ("Fdt.", "Fundătura"), ("P-ța", "Piața"), ("Şoseaua", "Șoseaua"),
     ("Şos", "Șoseaua"), ("STRDA", "Strada"), ("chei", "Cheiul"), ("De 95/6", None), ("DJ", None), ("lot 4", None), ("conform planului", None), ("?", None), ("", None), ("x" * 10_000, None), ("Scara B", None), ("canal", None)],
)
def test_meaning(typed, want):
    assert Dictionary(TYPES).meant(typed) == want


def test_canonical_column(spark):
    df = spark.createDataFrame([("str.",), (None,), ("zid",), ("",)], "v string")
    words = dictionary(types_table(spark), "road_type", "abbreviation", df, "v")
    assert [r[0] for r in df.select(canonical(words)(df.v)).collect()] == ["Strada", None, "unmatched", "unmatched"]
    assert dictionary(types_table(spark).limit(0), "road_type", "abbreviation", df, "v").meant("strada") is None


def test_entries_of_several_words():
    d = Dictionary([("Cluj Napoca", None), ("Cluj", "CJ"), ("Software Engineer", "SE"), ("Baia-Mare", None)])
    for typed, want in (("cluj napoca", "Cluj Napoca"), ("CLUJ-NAPOCA", None), ("Cluj, Napoca", "Cluj Napoca"), ("cluj napcoa", "Cluj Napoca"), ("software enginer", "Software Engineer"), ("Cluj", "Cluj"), ("baia mare", "Baia-Mare"), ("Cluj Baia Mare", "Baia-Mare"), ("napoca", None)):
        assert d.meant(typed) == want or want is None, typed


def test_long_lists_are_joined(spark, monkeypatch):
    """A list that is joined gives the same entries as one that is sent to the tasks."""
    entries = types_table(spark).unionByName(spark.createDataFrame([(90, "Calea Ferată", "C.F."), (91, None, "x")], "type_id int, road_type string, abbreviation string"))
    typed = ["STRADA", " Str.", "Strada aleea", "Bd-ul", "Intr.", "Fdt.", "P-ța", "Şos", "STRDA", "chei", "De 95/6", "DJ", "calea ferata", "cale ferata", "Strada calea ferata", "", None, "Aleea", "x" * 3000, "Strada", "Strada"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "id int, v string").selectExpr("*", "'z' entry", "'z' span", "'z' text")
    get = lambda: {r.id: r.to for r in mapped_values(df, "v", entries, "road_type", "abbreviation", "to").collect()}
    sent = get()
    monkeypatch.setattr("hodonym.llm.canonical_values.MOST_ENTRIES", 3)
    assert get() == sent and sent[12] == "Calea Ferată" and sent[14] == "Calea Ferată" and sent[16] is None and sent[10] == "unmatched"


# ---- 10 ---------------------------------------------------------------------------------------------------------------


def test_skeletons(spark):
    base = "Str. Ștefan cel Mare, nr. 10 – școala, știință"
    alike = [base, unicodedata.normalize("NFD", base), base.replace("ș", "ş").replace("ț", "ţ").replace("Ș", "Ş"), base.replace(" ", " "), base.replace("e", "е"), base.replace("a", "а​"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in base), base.replace("o", "ο")]
    other = [base.replace("ș", "s"), base.lower(), base.replace("10", "1O"), base.replace("10", "11"), base.replace(" ", "  "), base + "."]
    assert len({skeletons.skeleton(t) for t in alike}) == 1
    assert len({skeletons.skeleton(t) for t in [base, *other]}) == len(other) + 1
    assert skeletons.skeleton("ﬁﬂ") == "fifl" and skeletons.skeleton("​﻿­") == ""
    texts = [*alike, *alike[:3], *other, *other, None, "", "​", "­"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' skeleton", "7 id")
    want = sorted(((a, b) for (a, x), (b, y) in itertools.combinations(enumerate(texts), 2) if x and y and x != y and skeletons.skeleton(x).strip() and skeletons.skeleton(x) == skeletons.skeleton(y)), key=str)
    assert rows(skeletons.look_alike_pairs(df, "doc_id", "text")) == want and len(want) > 28
    assert rows(skeletons.look_alike_pairs(df.limit(0), "doc_id", "text")) == []
    heads = {i: min(j for j, y in enumerate(texts) if y and skeletons.skeleton(y) == skeletons.skeleton(texts[i])) for pair in want for i in pair}
    assert rows(skeletons.look_alike_groups(df, "doc_id", "text")) == sorted(heads.items(), key=str)


def test_more_scripts(tmp_path):
    for a, b in ("ⅼl", "ⅰi", "ⅠI", "ᎪA", "ᏟC", "ⲟo", "ᴄc", "ᴏo", "ꓐB", "ꓮA", "ԌG"):
        assert skeletons.skeleton(a) == b, (a, b)
    assert skeletons.skeleton("Ⅻ") == "XII" and skeletons.skeleton("ſ") == "ſ" and skeletons.skeleton("٠") == "٠"
    listed = tmp_path / "list.txt"
    listed.write_text("# comment\n\n10A0 ;\t0061 0301 ;\tMA\t# x\n0660 ; 002E ; MA\n0061 ; 0062 ; MA\n", encoding="utf-8-sig")
    more = skeletons.more_look_alikes(str(listed))
    assert more == {0x10A0: "a\u0301"} and skeletons.skeleton("Ⴀx", more) == "a\u0301x"


# ---- 9 ----------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    out = set()
    for i, d in docs:
        w = leakage.plain_words(d or "")
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for j, t in items:
            x = leakage.plain_words(t or "")
            if any(tuple(x[k : k + 12]) in grams for k in range(len(x) - 11)):
                out.add((i, j))
    return sorted(out, key=str)


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}ă" for i in range(40)] + ["de", "la", "și"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "scurt")]
    docs = []
    for i in range(150):
        d = text(rng.randrange(0, 300)).split()
        if rng.random() < 0.6:
            w = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(w))
            part = w[a : a + rng.choice([10, 11, 12, 13, 40])]
            d[len(d) // 2 : len(d) // 2] = [x.upper() if rng.random() < 0.5 else fold(x) + "," for x in part]
        docs.append((i, " ".join(d)))
    docs += [(900, None), (901, ""), (902, "z " * 60_000 + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 run", "2 score").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    got = leakage.leaked_passages(d, "doc_id", "text", t, "item_id", "text").collect()
    assert sorted(((r.doc_id, r.item_id) for r in got if r.run >= 12), key=str) == want and len(want) > 25
    assert all(r.score >= 24 and 0 < r.share <= 1 for r in got)
    assert leakage.leaked_passages(d, "doc_id", "text", t.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked_passages(d.limit(0), "doc_id", "text", t, "item_id", "text").count() == 0


def test_edited_copies(spark):
    """Copies with one word in 6 to 12 changed, left out or added are found, also where the corpus holds the item itself and other copies."""
    rng = random.Random(12)
    vocabulary = [f"cuv{i}" for i in range(800)] + ["de", "la", "și", "în"] * 40
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([40, 80, 160])))) for k in range(60)]
    docs, planted = [], set()
    for k, t in items:
        for every in (6, 8, 10, 12):
            w = t.split()
            for i in range(rng.randrange(every), len(w), every):
                w[i] = rng.choice(["altul", "", f"{w[i]} nou"])
            i = len(docs)
            planted.add((i, k))
            docs.append((i, " ".join(rng.choices(vocabulary, k=150)) + " " + " ".join(w) + " " + " ".join(rng.choices(vocabulary, k=80))))
        if k % 2:
            planted.add((len(docs), k))
            docs.append((len(docs), t))
    docs += [(len(docs) + i, " ".join(rng.choices(vocabulary, k=300))) for i in range(300)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(d, "doc_id", "text", t, "item_id", "text").collect()}
    assert len(got & planted) / len(planted) >= 0.99 and got <= planted


def test_seeds_occur_and_cover_every_window():
    import numpy as np

    f = np.array([5000, 900, 0, 7, 5000, 5000, 5000, 5000, 5000, 5000, 5000, 9000, 5000, 100_000, 0])
    chosen = leakage.choose_seeds(f)
    assert list(np.flatnonzero(chosen)) == list(range(3, 13))
    assert not leakage.choose_seeds(np.zeros(40, int)).any() and not leakage.choose_seeds(np.ones(8, int)).any()


def test_alignment():
    import numpy as np

    a, b = np.array([1, 2, 3, 4, 9, 5, 6, 7]), np.array([1, 2, 3, 4, 5, 6, 7])
    best = leakage.sweep(a, b)  # seven equal words, one left out
    assert best == (13, 7, 6, 4) and leakage.density(a, b, best) == 13 / 16
    none = np.array([8, 8])
    assert leakage.sweep(none, b) == (0, 0, 0, 0) and leakage.density(none, b, leakage.sweep(none, b)) == 0.0


# ---- 8 ----------------------------------------------------------------------------------------------------------------


def test_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 80)
        counts = {x: sizes.count(x) for x in sizes}
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        got = packing.fill(room, counts)
        assert sum(a * n for a, n in got) == best and all(n <= counts[a] for a, n in got)


def test_containers(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["strada", "unirii", "nr", "10", "ț"], k=rng.choice([0, 1, 5, 40, 200])))) for i in range(300)] + [(500, None), (501, "a" * 60_000), (502, "cuvânt " * 3000), (502, "cuvânt " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 shard", "2 n_tokens").repartition(3)
    kinds = spark.createDataFrame([("s", 64), ("m", 500), ("m", 400), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    out = packing.pack_containers(df, "doc_id", "text", kinds).toPandas()
    count = packing.token_counter()
    for kind, cap in (("s", 64), ("m", 500)):
        x = out[out.container_kind == kind]
        assert x.groupby("container_id").n_tokens.sum().max() <= cap
        for i in {d for d, t in docs if t is not None}:
            n, copies = count(next(t for d, t in docs if d == i)), sum(d == i for d, _ in docs)
            y = x[x.doc_id == i]
            assert y.n_tokens.sum() == n * copies
            assert n > cap or len(y) == copies  # whole unless longer than the container
        total = int(x.n_tokens.sum())
        assert x[x.n_tokens > 0].container_id.nunique() <= -(-total // cap) * 1.05 + 1
    assert set(out.container_kind) == {"s", "m"} and 500 not in set(out.doc_id)
    assert packing.pack_containers(df.limit(0), "doc_id", "text", kinds).count() == 0
    assert packing.pack_containers(df, "doc_id", "text", kinds.limit(0)).count() == 0


def test_long_runs_count_as_the_pattern_splits_them():
    count = packing.token_counter()
    for text in ("a  b" + " " * 3990 + "c ", "\n" * 50 + " x" + "\t" * 3000, " " * 3999):
        whole, packing._LONG_RUN = count(text), re.compile(r"\s{2}")
        assert count(text) == whole, text[:10]
        packing._LONG_RUN = re.compile(r"\s{4000}")
    assert count(" " * 300_000 + "x") > 0 and count("ab" * 100_000) > 0


def test_many_shards_fill_as_well_as_one(spark, monkeypatch):
    rng = random.Random(17)
    df = spark.createDataFrame([(i, "1 " * rng.randrange(1, 140)) for i in range(2000)], "doc_id long, text string").repartition(5)
    kinds = spark.createDataFrame([("m", 300)], "container_kind string, capacity_tokens int")
    one = packing.pack_containers(df, "doc_id", "text", kinds).toPandas()
    monkeypatch.setattr(packing, "SHARD", 100)
    many = packing.pack_containers(df, "doc_id", "text", kinds).toPandas()
    least = -(-int(one.n_tokens.sum()) // 300)
    assert sorted(zip(one.doc_id, one.n_tokens)) == sorted(zip(many.doc_id, many.n_tokens))
    assert one.container_id.nunique() <= least + 1
    assert many.container_id.nunique() <= least + 2
    assert many.groupby("container_id").n_tokens.sum().max() <= 300


# ---- 6 ----------------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    data = [
        (1, "J", "U", "strada ștefan popa", "ștefan popa", "ștefan popa", 1), (2, "J", "U", "Strada  Ștefan  Popa", "Ștefan Popa", "Ștefan Popa", 2), (3, "J", "U", "Str. Stefan Popa", "Str. Stefan Popa", "Str. Stefan Popa", 9), (4, "J", "U", "Popa, Ștefan - Strada", "Popa, Ștefan - Strada", "x", 9),
        (5, "J", "U", "Ștefan Popa", "Ștefan Popa", "Ștefan Popa", 1),
        (6, "J", "U", "Aleea Ștefan Popa", "Ștefan Popa", "Ștefan Popa", 1), (7, "J", "V", "Aleea Câmpului", "Câmpului", "Câmpului", 1), (8, "J", "V", "Aleea Cîmpului", "Cîmpului", "Cîmpului", 5), (9, "J", "V", "Aleea Campului", "Campului", "Campului", 8),
        (10, "J", "V", "Strada General Ion Popa", "General Ion Popa", "Ion Popa", 1), (11, "J", "V", "STRADA GENERAL ION POPA", "GENERAL ION POPA", "ION POPA", 3), (12, "J", "V", "Strada 12A", "12A", None, 1), (13, "J", "V", "Strada 12A", "12A", None, 1),
        (14, None, None, "Strada Nuci", "Nuci", "Nuci", 1), (15, None, None, "Strada Nuci", None, None, 1), (16, "J", "V", None, None, None, 1), (17, "J", "V", "", "", "", 1), (18, "J", "V", "x" * 40_000, "x", "x", 1),
    ]
    df = streets_table(spark, data)
    d = dictionary(types_table(spark), "road_type", "abbreviation", df, "street_type")
    # row 5 has no type and may be the Strada or the Aleea, so it is left out
    got = rows(street_survivors(df, d))
    assert got == sorted([(1, "Ștefan Popa", "Ștefan Popa", "Strada", 4), (7, "Cîmpului", "Cîmpului", "Aleea", 3), (10, "General Ion Popa", "Ion Popa", "Strada", 2), (14, "Nuci", "Nuci", "Strada", 2)], key=str)
    assert rows(street_survivors(df.where("id not in (6)"), d))[0][-1] in (5, 2, 3) and street_survivors(df.where("id != 6"), d).where("first_id = 1").first().n_rows == 5
    assert street_survivors(df.limit(0), d).count() == 0


def test_votes_decide_field_by_field(spark):
    """Three votes of weight 1 outweigh one of 2, not one of 4; null values and votes count for nothing."""
    votes = [("g", "x", 0.0, "x", 0.0)] * 3 + [("g", "y", 1.0, "y", 2.0), ("h", None, 9.0, "z", None), (None, "p", -9000.0, None, None), (None, "q", -9001.0, None, None), (None, "q", -9001.0, None, None), (None, "q", -9001.0, None, None)]
    df = spark.createDataFrame(votes, "g string, a string, a_vote double, b string, b_vote double").selectExpr("*", "1L n", "7L first_id", "'x' value", "'y' votes").drop("value")
    assert rows(field_winners(df, ["g"], ["a", "b"])) == sorted([("g", "x", "y", 4, 7), ("h", None, None, 1, 7), (None, "q", None, 4, 7)], key=str)


def test_votes_of_rows(spark):
    """The latest of the full spellings with the weights of the table; the most usual one with a decay over years."""
    data = [(i, "J", "U", "Aleea Câmpului", "Câmpului", "Câmpului", 1) for i in range(5)] + [(8, "J", "U", "Aleea Cîmpului", "Cîmpului", "Cîmpului", 30), (9, "J", "U", "Aleea Campului", "Campului", "Campului", 60)]
    df = streets_table(spark, data)
    d = Dictionary(TYPES)
    assert rows(street_survivors(df, d)) == [(0, "Cîmpului", "Cîmpului", "Aleea", 7)]
    assert rows(street_survivors(df, d, half_life=365 * 86400.0)) == [(0, "Câmpului", "Câmpului", "Aleea", 7)]
    assert rows(street_survivors(df, d, half_life=5 * 86400.0)) == [(0, "Cîmpului", "Cîmpului", "Aleea", 7)]


def test_survivors_do_not_depend_on_other_rows(spark):
    """A given name of three rows tells turned names apart, however many other rows there are."""
    data = [(1, "J", "U", "Strada Zamfira Popa", "Zamfira Popa", "Zamfira Popa", 1), (2, "J", "U", "Strada Popa Zamfira", "Popa Zamfira", "Popa Zamfira", 5), (3, "J", "V", "Strada Zamfira Rotaru", "Zamfira Rotaru", "Zamfira Rotaru", 5), (4, "J", "V", "Strada Ion Popa", "Ion Popa", "Ion Popa", 5)]
    many = [(100 + i, "J", "W", f"Strada Câmp{i} Nou", f"Câmp{i} Nou", f"Câmp{i} Nou", 1) for i in range(3000)]
    d = Dictionary(TYPES)
    for more in ([], many):
        assert [r for r in rows(street_survivors(streets_table(spark, data + more), d)) if r[0] == 1] == [(1, "Zamfira Popa", "Zamfira Popa", "Strada", 2)]


# ---- 1 ----------------------------------------------------------------------------------------------------------------


def test_label_model_learns_who_is_right():
    rng = random.Random(9)
    votes = []
    for _ in range(4000):
        y = rng.random() < 0.6
        say = lambda right, silent: 0 if rng.random() < silent else (1 if y == (rng.random() < right) else -1)  # noqa: E731, B023
        a = say(0.9, 0.1)
        votes.append(((a, a if rng.random() < 0.95 else -a, say(0.85, 0.3), say(0.75, 0.2), say(0.55, 0.0)), y))
    patterns = sorted({v for v, _ in votes})
    m = label_model.LabelModel(5).fit(patterns, [sum(v == p for v, _ in votes) for p in patterns])
    sure = dict(zip(patterns, m.confidence(patterns)))
    assert sum((sure[v] > 0.5) == y for v, y in votes) / len(votes) > 0.88
    assert {1 in (j, m.parent[j]) and 0 in (j, m.parent[j]) for j in (0, 1)} != {False}  # the copied voter is tied to its source


def test_links(spark):
    given = ["Ion", "Vasile", "Elena", "Maria", "Petre", "Radu", "Ana", "Mihail"]
    family = [a + b for a in ("Pop", "Mar", "Vlad", "Con", "Dum", "Stan", "Gav", "Rot") for b in ("escu", "eanu", "aru", "inte")]
    rng = random.Random(3)
    streets, renns, want, i = [], [], set(), 0
    for u in range(12):
        for k, f in enumerate(rng.sample(family, 24)):
            i += 1
            g, kind = rng.choice(given), rng.choice(["Strada", "Aleea", "Bulevardul"])
            streets.append((i, "J", f"COMUNA LOC{u}", f"{kind} {g} {f}", f"{g} {f}", f"{g} {f}", 1))
            if k % 2:
                form = rng.choice(["same", "same", "turned", "typo", "initial", "no type"])
                name = {"turned": f"{f} {g}", "typo": f"{g} {f[:-1]}{'x' if f[-1] != 'x' else 'y'}", "initial": f"{g[0]}. {f}"}.get(form, f"{g} {f}")
                renns.append((i, "[]", 100 + u if k % 3 else None, "J", f"Loc{u}", None if form == "no type" else kind.upper(), None, name))
                want.add((i, i))
            elif k % 4 == 0:
                renns.append((10_000 + i, "[]", 100 + u, "J", f"Loc{u}", {"Strada": "Aleea"}.get(kind, "Strada"), None, f"{g} {f}"))  # another type: another street
    renns += [(20_000, None, None, None, None, None, None, None), (20_001, "[]", 100, "J", None, "Strada", None, "")]
    s = streets_table(spark, [*streets, (30_000, None, None, None, None, None, 1), (30_001, "J", "COMUNA LOC1", "", "", "", 1)])
    r = spark.createDataFrame(renns, "id long, source_road_ids string, uat_siruta int, judet string, locality_raw string, road_type_raw string, street_type string, name string").selectExpr("*", "'c' key", "1 muni")
    u = spark.createDataFrame([(100 + k, "J", f"LOC{k}") for k in range(12)], "siruta int, judet string, uat string")
    d = Dictionary(TYPES)
    got = {(x.street_id, x.renns_id): x.confidence for x in street_links(registry_side(s, d), cadastre_side(r, u, d)).collect()}
    assert all(a == b for a, b in got), [x for x in got if x[0] != x[1]]
    assert len(set(got) & want) / len(want) > 0.9 and all(0.5 <= c <= 1 for c in got.values())
    assert street_links(registry_side(s.limit(0), d), cadastre_side(r, u, d)).count() == 0
    assert street_links(registry_side(s, d), cadastre_side(r.limit(0), u.limit(0), d)).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------------


def test_person_groups(spark):
    people = [(f"{g} {f}", f"{g.title()} {f.title()}", 1800 + k, 1850 + k) for k, (g, f) in enumerate(itertools.product(["ion", "vasile", "elena", "stefan", "maria"], ["popescu", "marinescu", "vladeanu", "rotaru", "gavrilescu"]))]
    more = [("popescu i.", "Popescu I.", 1800, None), ("mos craciun", "Popescu Vasile", None, None), ("vasile poppescu", "Vasile Poppescu", None, None), ("ion popescu fiul", "Ion Popescu fiul", 1840, None), ("ing. elena rotaru", "Ing. Elena Rotaru", None, None), ("x y", None, None, None), ("", "Nimeni", None, None)]
    p = spark.createDataFrame([(*x[:2], "M", x[2], x[3], None, None) for x in people + more], "core_name_norm string, full_name string, gender string, birth_year int, death_year int, profession string, wikidata_qid string").selectExpr("*", "'c' key", "1 s", "2 form")
    q = spark.createDataFrame([("popescu vasile",), ("marinescu fane",), ("vladaenu stefan",), ("izvorul mare",), ("izvorul marre",), (None,), ("",), ("1 mai",), ("popescu vasile",)], "core_name_norm string")
    got = {}
    for r in person_names.person_groups(p, q).collect():
        got.setdefault(r.person, set()).add(r.name)
    groups = {frozenset(g) for g in got.values()}
    for want in ({"ion popescu", "popescu i."}, {"vasile popescu", "popescu vasile", "mos craciun", "vasile poppescu"}, {"stefan marinescu", "marinescu fane"}, {"stefan vladeanu", "vladaenu stefan"}, {"elena rotaru", "ing. elena rotaru"}, {"ion popescu fiul"}):
        assert frozenset(want) in groups, want
    assert not any("izvorul mare" in g for g in groups)
    pairs = rows(person_names.same_person_pairs(p, q))
    assert ("ion popescu", "popescu i.") in pairs and all(a < b for a, b in pairs) and len(pairs) == len(set(pairs)) == sum(len(g) * (len(g) - 1) // 2 for g in groups)
    assert person_names.same_person_pairs(p.limit(0), q).count() == 0
    assert person_names.same_person_pairs(p, q.limit(0)).count() > 0


PERSON = "core_name_norm string, full_name string, gender string, birth_year int, death_year int, profession string, wikidata_qid string"


def people(spark, *rows_):
    return spark.createDataFrame([(n, f, "M", b, d, p, q) for n, f, b, d, p, q in rows_], PERSON)


def crowd(given="ion vasile elena stefan maria luca".split(), family="popescu marinescu vladeanu rotaru gavrilescu caragiale".split()):
    """People enough to tell given names from surnames."""
    return [(f"{g} {f}", f"{g.title()} {f.title()}", 1700 + 2 * k, 1760 + 2 * k, None, None) for k, (g, f) in enumerate(itertools.product(given, family)) if (g, f) not in {("ion", "popescu"), ("luca", "caragiale"), ("ion", "caragiale")}]


def test_namesakes_with_other_years_stay_apart(spark):
    two = [("ion popescu", "Ion Popescu", 1850, 1910, "poet", "Q1"), ("popescu ion", "Popescu Ion", 1950, 2010, "painter", "Q2")]
    p = people(spark, *crowd(), *two, ("i. popescu", "I. Popescu", 1950, None, "painter", None), ("ion poppescu", "Ion Poppescu", 1850, None, None, "Q1"))
    q = spark.createDataFrame([("ion popescu",), ("popescu ion",)], "core_name_norm string")
    pairs = set(rows(person_names.same_person_pairs(p, q)))
    assert ("ion popescu", "popescu ion") not in pairs
    assert ("i. popescu", "popescu ion") in pairs and ("ion popescu", "ion poppescu") in pairs and ("i. popescu", "ion popescu") not in pairs
    # without years that contradict each other the turned name is the same person
    p = people(spark, *crowd(), ("ion popescu", "Ion Popescu", 1850, 1910, "poet", "Q1"), ("popescu ion", "Popescu Ion", None, 1910, None, None))
    assert ("ion popescu", "popescu ion") in rows(person_names.same_person_pairs(p, q))


def test_initials_and_parts_left_out(spark):
    p = people(spark, *crowd(), ("ion luca caragiale", "Ion Luca Caragiale", 1852, 1912, "dramaturg", "Q9"), ("i l caragiale", "I. L. Caragiale", 1852, None, None, None), ("caragiale ion", "Caragiale Ion", 1852, 1912, None, "Q9"), ("x" * 3000, "Y " * 4000, 1900, None, None, None))
    pairs = set(rows(person_names.same_person_pairs(p, spark.createDataFrame([("i. l. caragiale",), ("w " * 5000,)], "core_name_norm string"))))
    for a, b in (("i l caragiale", "ion luca caragiale"), ("caragiale ion", "ion luca caragiale"), ("caragiale ion", "i l caragiale"), ("i. l. caragiale", "ion luca caragiale")):
        assert (a, b) in pairs, (a, b)
    assert person_names.channel("ion luca", "caragiale ion luca", {"ion", "luca"}) is None and person_names.channel("caragiale", "caragiale ion luca", {"ion", "luca"}) is None


def test_unrelated_rows_change_no_link(spark):
    group = [("zamfira popescu", "Zamfira Popescu", 1850, None, None, None), ("zamfira rotaru", "Zamfira Rotaru", 1870, None, None, None), ("zamfira vladeanu", "Zamfira Vladeanu", 1890, None, None, None)]
    q = spark.createDataFrame([("zamfira gavrilescu",), ("gavrilescu zamfira",), ("z. popescu",)], "core_name_norm string")
    noise = [(f"gigel neam{i:04d}", f"Gigel Neam{i:04d}", 1000, None, None, None) for i in range(3600)]
    few, many = (set(rows(person_names.same_person_pairs(people(spark, *crowd(), *group, *more), q))) for more in ([], noise))
    assert ("gavrilescu zamfira", "zamfira gavrilescu") in few and few <= many and not {x for x in many - few if "zamfira" in x[0]}


def test_pet_forms_are_learned(spark):
    """Two people known by identifier under a pet form that no list has make it known for others."""
    known = [(f"{g} {f}", f"{g.title()} {f.title()}", None, None, None, q) for f, q in (("popescu", "Q1"), ("rotaru", "Q2")) for g in ("vasile", "zizu")]
    p = people(spark, *[x for x in crowd() if x[0] not in ("vasile popescu", "vasile rotaru")], *known, ("vasile vladeanu", "Vasile Vlădeanu", 1800, None, None, None))
    pairs = rows(person_names.same_person_pairs(p, spark.createDataFrame([("zizu vladeanu",), ("vladeanu zizu",)], "core_name_norm string")))
    for a, b in (("vasile vladeanu", "zizu vladeanu"), ("vasile vladeanu", "vladeanu zizu"), ("vasile popescu", "zizu popescu")):
        assert (a, b) in pairs, (a, b)


def test_long_chains_of_links(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [("x", "y"), ("y", "x")], "a string, b string")
    label = {r.node: r.label for r in person_names._components(links).collect()}
    assert {label[f"n{i:03d}"] for i in range(201)} == {"n000"} and label["x"] == label["y"] == "x"


# ---- all --------------------------------------------------------------------------------------------------------------

FORMS = {"p1_found": "street_id renns_id", "p2_found": "first_id copy_id", "p3_found": "name_a name_b", "p4_found": "field kind item mark", "p6_found": "first_id name core_name street_type", "p7_found": "table_name row_id road_type", "p9_found": "doc_id item_id", "p10_found": "doc_a doc_b"}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", LLM_QUERIES)
def test_queries(spark, name):
    df = LLM_QUERIES[name](spark, str(DATA))
    if name in FORMS:
        assert df.columns == FORMS[name].split()
        assert df.count() == df.distinct().count()
    if name in LLM_SQL:
        same(df, connection(), LLM_SQL[name])
    else:
        assert df.count() > 0


# ---- what must hold of every result ---------------------------------------------------------------------------------------


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_links_and_groups_are_consistent(spark):
    """A cadastre row is of one street and its links share one municipality; pairs of spellings are the pairs of their groups; survivors are streets' smallest rows."""
    from hodonym.session import table

    d = str(DATA)
    read = lambda name: table(spark, d, name)
    links = LLM_QUERIES["p1_links"](spark, d).join(read("streets").selectExpr("id street_id", "concat(judet, '|', uat) place"), "street_id")
    assert links.groupBy("renns_id").agg({"place": "approx_count_distinct"}).where("`approx_count_distinct(place)` > 1").count() == 0
    assert links.where("confidence < 0.5 or confidence > 1").count() == 0
    groups = {}
    for r in LLM_QUERIES["p3_groups"](spark, d).collect():
        groups.setdefault(r.person, set()).add(r.name)
    pairs = {tuple(r) for r in LLM_QUERIES["p3_found"](spark, d).collect()}
    assert pairs == {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    best = LLM_QUERIES["p6_survivors"](spark, d)
    assert best.where("n_rows < 2 or name is null or street_type = ''").count() == 0 and best.count() == best.select("first_id").distinct().count()
    use = {r.container_kind: r for r in LLM_QUERIES["p8_use"](spark, d).collect()}
    assert len({r.n_tokens for r in use.values()}) == 1 and all(r.n_containers <= -(-r.n_tokens // r.capacity) * 1.05 + 1 for r in use.values())  # as for any few texts
