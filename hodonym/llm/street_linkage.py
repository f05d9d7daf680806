"""The same streets in two sources without a common key (problem 1).

Streets rows come together as streets (municipality, type, words of the name). Candidates share a block of their municipality:
the same words, the words after a pet name is written out, surname and initials, the surname alone, or half of a name that is
within one edit. Heuristics vote on every candidate, for it or against it; a label model learns from all vote patterns how far each
is right and which go together, and gives the confidence. Last comes an exact check of what the problem defines: streets of different types
are different streets, and a cadastre row is of one street.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hodonym.llm.canonical_values import EDITED, Dictionary, edit_cost, fold
from hodonym.llm.edits import half_blocks
from hodonym.llm.label_model import LabelModel
from hodonym.llm.nicknames import givens
from hodonym.llm.street_names import SAINT, TITLES, Parser, core_words, is_number
from hodonym.session import materialize, parallelism, ship_code

# Words for the kind of a municipality before its name.
_UNIT = re.compile(r"^(?:municipiul|mun\.?|orasul|oras|or\.|comuna|com\.|satul|sat|judetul)\s+")
VOTERS = ("type", "words", "spelling", "given name", "title", "unseen spelling", "only candidate", "single partner")
_SIDE = "id long, muni string, kind string, key string, words string, title string"


def unit_name(text: str | None) -> str:
    return _UNIT.sub("", re.sub(r"[\s\-]+", " ", fold(text or "")).strip())


def _side(rows: Iterator[pa.RecordBatch], types: Dictionary, second: bool) -> Iterator[pa.RecordBatch]:
    """Columns in: id, judet, place, text, and for the second source its unit's judet and name and the typed kinds. Out: ``_SIDE``."""
    p, places = Parser(types), {}
    for b in rows:
        cols = [c.to_pylist() for c in b.columns]
        out: list[list] = [[] for _ in range(6)]
        for i in range(b.num_rows):
            at = (cols[4][i], cols[5][i]) if second and cols[4][i] else (cols[1][i], cols[2][i])
            if at not in places:
                if len(places) > 200_000:
                    places.clear()
                places[at] = f"{at[0]}|{name}" if at[0] and (name := unit_name(at[1])) else None
            kind, words = p.split(cols[3][i] or "")
            if second:
                kind = types.meant(cols[6][i]) or types.meant(cols[7][i]) or kind
            body = core_words(words)
            for o, x in zip(out, (cols[0][i], places[at], kind, " ".join(sorted(body)), " ".join(body), " ".join(w for w in words if w in TITLES and len(body) < len(words)) or None)):
                o.append(x)
        yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), *[pa.string()] * 5))], names=["id", "muni", "kind", "key", "words", "title"])


def registry_side(streets: DataFrame, types: Dictionary) -> DataFrame:
    """Each registry row as ``_SIDE``; rows without a name or a municipality are left out."""
    ship_code(streets.sparkSession)
    cols = [F.col("id").cast("long"), "judet", "uat", "artera_raw"]
    return streets.where("id is not null").select(*cols).mapInArrow(lambda it: _side(it, types, False), _SIDE).where("key != '' and muni is not null")


def cadastre_side(renns: DataFrame, units: DataFrame, types: Dictionary) -> DataFrame:
    """Each cadastre row as ``_SIDE``, its municipality by code or, where the list has no such code, by name. Of a repeated code the first name counts."""
    ship_code(renns.sparkSession)
    known = units.where("siruta is not null").groupBy(F.col("siruta").cast("int").alias("_code")).agg(F.min(F.struct("judet", "uat")).alias("_unit"))
    rows = renns.where("id is not null").join(known, F.col("uat_siruta").cast("int") == F.col("_code"), "left")
    cols = [F.col("id").cast("long"), "judet", "locality_raw", "name", F.col("_unit.judet").alias("u_judet"), F.col("_unit.uat").alias("u_uat"), "road_type_raw", "street_type"]
    return rows.select(*cols).mapInArrow(lambda it: _side(it, types, True), _SIDE).where("key != '' and muni is not null")


#: Names with fewer letters are not sought with an edit.
LEAST_LETTERS = 5


def _registry_blocks() -> Column:
    """Blocks of a street; the surname may stand at either end, whatever the number of words."""
    w = F.split("words", " ")
    n = F.size(w)
    none = F.array().cast("array<string>")
    first, last = w[0], F.element_at(w, -1)
    initials = lambda given, y: F.transform(given, lambda x: F.concat(F.lit("i"), y, F.lit(" "), x.substr(1, 1)))
    every = F.array_distinct(F.concat(initials(F.slice(w, 1, n - 1), last), initials(F.slice(w, 2, n - 1), first)))
    return F.when(n > 1, F.concat(every, F.array(F.concat(F.lit("s"), first), F.concat(F.lit("s"), last), F.concat(F.lit("k"), F.col("key"))))).otherwise(none)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _cadastre_blocks(words: str) -> list[str]:
    w = words.split()
    out: set[str] = set()
    if len(w) == 1 and len(w[0]) > 2:
        out.add("s" + w[0])
    if len(w) > 1:
        letters, full = [x for x in w if len(x) == 1], [x for x in w if len(x) > 1]
        if letters and full:
            out |= {f"i{y} {letters[0]}" for y in (full[0], full[-1])}
        for i, x in enumerate(w):
            out |= {"k" + " ".join(sorted((*w[:i], g, *w[i + 1 :]))) for g in givens(x)}
    return sorted(out)


def _initials_fit(a: list[str], b: list[str]) -> bool:
    """Whether ``a`` is ``b`` with its given names, or the first of them, as initials."""
    letters, full = [x for x in a if len(x) == 1 and x.isalpha()], [x for x in a if len(x) > 1]
    if not letters or len(letters) + len(full) < len(a) or b[-1] not in full and b[0] not in full:
        return False
    given = list(b)
    for x in full:
        if x not in given:
            return False
        given.remove(x)
    return len(letters) in (1, len(given)) and all(y.startswith(x) for x, y in zip(letters, given))


def spelling_votes(theirs: str, ours: str, surname: bool = False) -> tuple[int, int, int]:
    """Votes on (same words, spelling within one edit or a known short form, given names agree) of two names' words.

    ``surname``: the single word of ``theirs`` closes more names than it opens, so it is a surname wherever it stands.
    """
    a, b = theirs.split(), ours.split()
    if sorted(a) == sorted(b):
        return 1, 1, 1 if len(a) > 1 else 0
    if 1 < len(a) <= len(b) and _initials_fit(a, b):
        return 0, 1, 1
    if len(a) == len(b):
        # pair the words that agree, then look at the ones left over
        left, right = list(a), list(b)
        for x in a:
            if x in right:
                left.remove(x)
                right.remove(x)
        if len(left) == 1:
            x, y = left[0], right[0]
            if len(a) > 1 and y in givens(x):
                return 0, 1, 1
            if edit_cost(x, y) <= EDITED and min(len(x), len(y)) >= 4 and (x + y).isalpha():
                return 0, 1, 0
        return -1, -1, -1
    if len(a) == 1 and (a[0] == b[-1] or surname and a[0] == b[0]) and SAINT not in b:
        return 0, 0, 0
    if abs(len("".join(a)) - len("".join(b))) <= 1 and edit_cost("".join(sorted(a)), "".join(sorted(b))) <= EDITED:
        return 0, 1, 0
    return -1, -1, -1


def _vote(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        kind, r_kind, words, r_words, title, r_title, seen, surname = (b.column(i).to_pylist() for i in range(4, 12))
        out = []
        for i in range(b.num_rows):
            same, spelt, given = spelling_votes(r_words[i], words[i], surname[i])
            typed = 0 if kind[i] is None or r_kind[i] is None else 1 if kind[i] == r_kind[i] else -1
            titled = 0 if not title[i] or not r_title[i] else 1 if set(title[i].split()) & set(r_title[i].split()) else -1
            out.append((typed, same, spelt, given, titled, 0 if same == 1 else -1 if seen[i] else 1))
        yield pa.record_batch([*(b.column(k) for k in range(5)), *(pa.array([o[k] for o in out], pa.int8()) for k in range(6))], names=["rid", "eid", "alone", "named", "kind", *(f"v{k}" for k in range(6))])


def candidates(registry: DataFrame, cadastre: DataFrame) -> DataFrame:
    """Every candidate (rid, eid, kind) with its votes v0..v7; ``alone``: the street has one type only.

    ``rid`` is a cadastre row, ``eid`` the hash of a street's municipality and key, ``kind`` a type under which the registry has it.
    """
    spark = registry.sparkSession
    number = r"^[0-9]+[a-z]?$"
    streets = registry.groupBy("muni", "key").agg(F.collect_set("kind").alias("kinds"), F.mode("words", True).alias("words"), F.max("title").alias("title"))
    streets = materialize(streets.withColumn("eid", F.xxhash64("muni", "key")), "streets")
    r = cadastre.select(F.col("id").alias("rid"), "muni", F.col("kind").alias("r_kind"), "key", F.col("words").alias("r_words"), F.col("title").alias("r_title"))
    carried = ["rid", "eid", "kinds", "r_kind", "words", "r_words", "title", "r_title", "seen", "surname"]
    same = r.join(streets, ["muni", "key"]).withColumn("seen", F.lit(True)).withColumn("surname", F.lit(False)).select(*carried)
    rest = r.join(streets.select("muni", "key"), ["muni", "key"], "left_anti").where(~F.col("r_words").rlike(number))
    # a single word is its own key: how many names it closes less how many it opens comes with the keys seen
    ends = streets.where("words like '% %'").select(F.explode(F.array(*(F.struct(F.substring_index("words", " ", i).alias("key"), F.lit(False).alias("seen"), F.lit(-i).alias("closes")) for i in (1, -1)))).alias("x")).select("x.*")
    known = streets.select("key", F.lit(True).alias("seen"), F.lit(0).alias("closes")).unionByName(ends).groupBy("key").agg(F.max("seen").alias("seen"), (F.sum("closes") > 0).alias("surname"))
    rest = materialize(rest.join(known, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("seen", "surname")}), "rest")

    block = lambda c: F.xxhash64("muni", c)
    named = streets.where(~F.col("key").rlike(number)).select("muni", "eid", "key", "words").repartition(parallelism(spark))
    sought = rest.select("rid", "muni", "key", "r_words").repartition(parallelism(spark))
    ours = named.select("muni", "eid", F.explode(_registry_blocks()).alias("b")).select("eid", block("b").alias("b"))
    theirs = sought.select("rid", "muni", F.explode(_cadastre_blocks("r_words")).alias("b")).select("rid", block("b").alias("b"))
    pairs = theirs.join(ours, "b").select("rid", "eid")
    halves = lambda c, lengths: F.explode(F.array(*half_blocks(F.col(c), lengths))).alias("x")
    ours = named.where(F.length("key") >= LEAST_LETTERS).select("muni", "eid", halves("key", [0])).select("eid", block("x.b").alias("b"), F.col("x.rest").alias("rest"))
    two = F.split("r_words", " ")
    orders = F.when(F.size(two) == 2, F.array_distinct(F.array(F.col("r_words"), F.concat_ws(" ", two[1], two[0])))).otherwise(F.array("key"))
    theirs = sought.where(F.length("key") >= LEAST_LETTERS).select("muni", "rid", F.explode(orders).alias("t")).select("muni", "rid", halves("t", [-1, 0, 1])).select("rid", block("x.b").alias("b"), F.col("x.rest").alias("r_rest"))
    near = theirs.join(ours, "b").where(F.levenshtein("rest", "r_rest", 1) >= 0).select("rid", "eid")
    pairs = pairs.unionByName(near).distinct()
    near = pairs.join(rest.withColumnRenamed("muni", "r_muni"), "rid").join(streets, "eid").where("muni = r_muni").select(*carried)

    wide = same.unionByName(near).withColumn("kind", F.explode(F.when(F.size("kinds") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("kinds"))))
    wide = wide.select("rid", "eid", (F.size("kinds") == 1).alias("alone"), F.lit(True).alias("named"), "kind", "r_kind", "words", "r_words", "title", "r_title", "seen", "surname")
    voted = materialize(wide.mapInArrow(_vote, "rid long, eid long, alone boolean, named boolean, kind string, " + ", ".join(f"v{k} byte" for k in range(6))).drop("named"), "voted")
    fits = "v0 >= 0 and v2 >= 0"
    taken = voted.where(fits).groupBy("eid", "kind").agg(F.count(F.lit(1)).alias("partners")).where("partners > 1").select(F.col("eid").alias("t_eid"), F.col("kind").alias("t_kind"), F.lit(0).alias("v7"))
    rivals = F.sum(F.when(F.expr(fits), 1).otherwise(0)).over(Window.partitionBy("rid"))
    both = voted.join(taken, (F.col("eid") == F.col("t_eid")) & F.col("kind").eqNullSafe(F.col("t_kind")), "left").drop("t_eid", "t_kind")
    return both.withColumn("v6", F.when(rivals <= 1, 1).otherwise(-1).cast("byte")).withColumn("v7", F.coalesce("v7", F.lit(1)).cast("byte"))


def _type_chance(ours: DataFrame, theirs: DataFrame) -> float:
    """How often two rows that have nothing to do with each other have the same type."""
    a, b = (dict(tuple(r) for r in x.where("kind is not null").groupBy("kind").count().collect()) for x in (ours, theirs))  # a row per type
    pairs = sum(a.values()) * sum(b.values())
    return min(max(sum(n * b.get(k, 0) for k, n in a.items()) / pairs, 0.01), 0.9) if pairs else 0.3


def street_links(registry: DataFrame, cadastre: DataFrame, least: float = 0.5) -> DataFrame:
    """(street_id, renns_id, confidence): the pairs with at least ``least`` confidence, from the sides of ``registry_side`` and ``cadastre_side``.

    Streets of different types are never the same. A cadastre row goes to its most confident street; if two are equally
    confident, it stays without one. Rows without a name or a municipality are linked with nothing; a repeated row repeats its pairs.
    """
    spark = registry.sparkSession
    registry, cadastre = materialize(registry, "registry"), materialize(cadastre, "cadastre")
    voted = materialize(candidates(registry, cadastre), "candidates")
    names = [f"v{k}" for k in range(len(VOTERS))]
    patterns = [tuple(r) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** 8 rows
    if not patterns:
        return spark.createDataFrame([], "street_id long, renns_id long, confidence double")
    votes = [p[:-1] for p in patterns]
    chance = _type_chance(registry, cadastre)
    # by definition streets of different types are no match: such candidates teach the model what no match looks like
    sure = LabelModel(len(VOTERS), chances={0: chance}).fit(votes, [p[-1] for p in patterns], [v[0] < 0 for v in votes]).confidence(votes)
    table = spark.createDataFrame([(*v, float(c)) for v, c in zip(votes, sure)], ", ".join(f"{n} byte" for n in names) + ", confidence double")
    # the exact check: no link between different types, and none where two streets are equally likely
    sure_ = voted.join(F.broadcast(table), names).where((F.col("confidence") >= least) & (F.col("v0") >= 0))
    best = sure_.groupBy("rid", "eid", "kind", "alone").agg(F.max("confidence").alias("confidence")).groupBy("rid").agg(F.max("confidence").alias("top"), F.max_by(F.struct("eid", "kind", "alone"), "confidence").alias("x"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("confidence"), asc=False).alias("all"))
    target = best.where("n = 1 or all[1] < top").select(F.col("rid").alias("renns_id"), F.col("x.eid").alias("eid"), F.col("x.kind").alias("t"), "x.alone", F.col("top").alias("confidence"))
    rows = registry.select(F.col("id").alias("street_id"), F.xxhash64("muni", "key").alias("eid"), "kind")
    fits = F.col("kind").eqNullSafe(F.col("t")) | F.col("kind").isNull() & F.col("alone")
    return rows.join(target, "eid").where(fits).select("street_id", "renns_id", "confidence")
