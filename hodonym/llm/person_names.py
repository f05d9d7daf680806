"""Spellings that name one person (problem 3).

Noisy-channel attribution. Full spellings are candidate canonical forms, ranked by how often they are written; people of one name whose
facts contradict each other are forms of their own. A spelling is attached to the form with the highest posterior: the form's frequency times
the likelihood that the channel (order, titles, one typing error, a pet form, initials, parts left out, a pen name given with the full name)
turns it into the spelling, times the agreement of what is known of both (years, gender, profession, identifier). Staying itself is one of
the hypotheses; it weighs little where no other name supports the spelling's words. Which words are given names is told by where they stand
in names, word by word, so unrelated rows change nothing.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hodonym.llm.canonical_values import edit_cost, fold
from hodonym.llm.edits import half_blocks
from hodonym.llm.nicknames import PET_FORMS, givens
from hodonym.llm.street_names import TITLES
from hodonym.session import materialize, parallelism, ship_code

# Folded words that tell generations of one name apart, each with its mark.
GENERATIONS = {
    "fiul": "2", "fiica": "2", "junior": "2", "jr": "2", "tanarul": "2", "tanara": "2", "nepotul": "3", "nepoata": "3", "tatal": "1", "senior": "1", "sr": "1",
    "batranul": "1", "batrana": "1", "varstnicul": "1",
}
#: Log-likelihoods of the channel.
SAME, TYPO, PET, INITIAL, FULL_NAME, OTHER_GIVEN, LEFT_OUT = 0.0, math.log(0.05), math.log(0.1), math.log(0.05), math.log(0.5), math.log(1e-4), math.log(0.02)
#: Log weight of a spelling that no other name supports as a name of its own.
UNSUPPORTED = math.log(0.01)
#: Names that must share a word for it to be an established surname.
SUPPORT = 3
#: (agree, disagree) for birth, death, identifier, profession, gender.
EVIDENCE = ((4.0, -6.0), (4.0, -6.0), (6.0, -6.0), (1.5, -3.0), (0.3, -4.0))
FACTS = ("birth_year", "death_year", "wikidata_qid", "profession", "gender")
#: Surnames that must show a pet form for it to be learned.
PET_SURNAMES = 2
#: The posterior that a spelling's best form must have; 0 attaches every spelling to its best form.
LEAST_POSTERIOR = 0.5
#: Shorter names are not sought with an edit.
LEAST_LETTERS = 6
#: Longer names are compared whole, not by parts.
MOST_LETTERS, MOST_WORDS = 120, 8
#: Opens the full names among the spellings.
MARK = "\x1f"
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def name_key(text: str | None) -> str:
    """Folded words without titles, sorted, then ``#`` and the generation if one is told; a key is its own key."""
    if text and "#" in text:
        return text
    words = [w for w in _WORD.findall(fold(text or "")) if w not in TITLES or len(w) == 1]
    told = next((g for w in words if (g := GENERATIONS.get(w))), "")
    return " ".join(sorted(w for w in words if w not in GENERATIONS)) + ("#" + told if told else "")


@F.udf(T.StringType(), useArrow=True)
def _key(text: str) -> str:
    return name_key(text)


def _parts(key: str) -> tuple[list[str], str]:
    """The words and the generation of a key or a form; what tells people of one name apart is not part of it."""
    words, _, told = key.partition("|")[0].partition("#")
    return words.split(), told


def _short(words: list[str]) -> bool:
    return len(words) <= MOST_WORDS and sum(map(len, words)) <= MOST_LETTERS


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _form_blocks(form: str) -> list[str]:
    """Blocks of a canonical form."""
    w, told = _parts(form)
    text = " ".join(w)
    out = {f"k{told} {text}"}
    if _short(w):
        out |= {f"i{told} {y} {x[0]}" for y, x in itertools.permutations(w, 2)}
        if len(w) > 2:
            out |= {f"p{told} {a} {b}" for a, b in itertools.combinations(w, 2)}
    return sorted(out)


def _forms_of_pets(pets: list[str] | None) -> dict[str, set[str]]:
    """Learned pet forms (``pet given`` each) by pet."""
    out: dict[str, set[str]] = {}
    for pet, given in (p.split() for p in pets or ()):
        out.setdefault(pet, set()).add(given)
    return out


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _spelling_blocks(key: str, pets: list[str] | None) -> list[str]:
    """Blocks of a spelling, with the pet forms learned for its words."""
    learned = _forms_of_pets(pets)
    w, told = _parts(key)
    out = {f"k{told} {' '.join(w)}"}
    if not _short(w):
        return sorted(out)
    letters, full = [x for x in w if len(x) == 1], [x for x in w if len(x) > 1]
    out |= {f"i{told} {y} {x}" for x in letters for y in full}
    out |= {f"p{told} {a} {b}" for a, b in itertools.combinations(full, 2)}
    for i, x in enumerate(w):
        out |= {f"k{told} {' '.join(sorted((*w[:i], g, *w[i + 1 :])))}" for g in (*givens(x), *learned.get(x, ())) if len(w) > 1}
    return sorted(out)


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _edited_orders(key: str) -> list[str]:
    """The orders of a spelling's words in which it is sought with an edit."""
    w, _ = _parts(key)
    if not _short(w) or len(" ".join(w)) < LEAST_LETTERS or any(len(x) == 1 for x in w):
        return []
    return sorted({" ".join(w), " ".join(reversed(w))})


def _word_channel(x: str, y: str, given: frozenset[str] | set[str], pets: dict[str, set[str]]) -> float | None:
    """Log-likelihood that the word ``y`` of a form is written as ``x``; ``pets`` are pet forms beside the fixed list."""
    if len(x) == 1:
        return INITIAL if y.startswith(x) else None
    if y in givens(x) or y in pets.get(x, ()):
        return PET
    if x in givens(y) or x in pets.get(y, ()):
        return None
    if edit_cost(x, y) <= 1 and min(len(x), len(y)) >= 3:
        return OTHER_GIVEN if x in given and y in given else TYPO
    return None


def channel(spelling: str, form: str, given: frozenset[str] | set[str], pets: dict[str, set[str]] | None = None) -> float | None:
    """Log-likelihood that ``form`` is written as ``spelling`` (keys), or None.

    One word may be misspelt or a pet form, any number may be initials, and given names may be left out as long as another whole
    word, not a given name, stays.
    """
    (a, told), (b, told_b) = _parts(spelling), _parts(form)
    if told != told_b or len(a) > len(b):
        return None
    if a == b:
        return SAME
    left, right, kept = list(a), list(b), []
    for x in a:
        if x in right:
            left.remove(x)
            right.remove(x)
            kept.append(x)
    if len(a) == len(b) and len(left) == 1:
        return _word_channel(left[0], right[0], given, pets or {})
    gone = len(b) - len(a)
    if len(a) < 2 or not any(len(x) > 1 and (not gone or x not in given) for x in kept) or not _short(b) or sum(len(x) > 1 for x in left) > 1:
        return None
    best = None
    for some in itertools.permutations(right, len(left)):
        likes = [_word_channel(x, y, given, pets or {}) for x, y in zip(left, some)]
        out = list(right)
        for y in some:
            out.remove(y)
        if None not in likes and all(y in given for y in out):
            total = sum(likes) + LEFT_OUT * gone
            best = total if best is None else max(best, total)
    return best


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: s, key, full, its given names and pet forms, own form with its frequency and support, then form, its frequency, support and given names, and the facts of both."""
    for b in batches:
        kept: list[tuple] = []
        for s, key, full, g, pets, own, n, sure, form, form_n, form_sure, form_g, *facts in zip(*(c.to_pylist() for c in b.columns)):
            if form == own:
                continue
            given, name, learned = {*(g or ()), *(form_g or ())}, form.partition("|")[0], _forms_of_pets(pets)
            likes = [channel(key, form, given, learned)]
            if full is not None and full != key and (y := channel(full, form, given, learned)) is not None:
                likes.append(y + FULL_NAME)
            likes = [x for x in likes if x is not None]
            if not likes or (form_sure, form_n, form) <= (sure, n, own or key) and max(likes) <= TYPO and full != name:
                continue
            total = math.log(form_n) + max(likes)
            for i, (yes, no) in enumerate(EVIDENCE):
                mine, theirs = facts[i], facts[len(EVIDENCE) + i]
                if mine is not None and theirs is not None:
                    total += yes if mine == theirs else no
            kept.append((s, form, total))
        if kept:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*kept), (pa.string(), pa.string(), pa.float64()))], names=["s", "form", "score"])


_PLAIN_NAME = re.compile(r"[^\W\d_][^\W\d_-]*(?:-[^\W\d_]+)* +[^\W\d_]+(?:-[^\W\d_]+)*")


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _ends(full_name: str) -> list[str] | None:
    """The folded first and last word of a name of two plain words."""
    text = re.sub(r"[^\w\- ,]|[\d_]", " ", full_name).strip()
    return fold(text).split() if _PLAIN_NAME.fullmatch(text) else None


def given_names(persons: DataFrame) -> DataFrame:
    """(w, first): the words that open at least two full names of two words and open names three times as often as they end them, with how many they open.

    Titles are no given names, nor are pet forms of another given name.
    """
    spark = persons.sparkSession
    words = persons.where("full_name is not null").select(_ends("full_name").alias("e")).where("e is not null").select(F.posexplode("e").alias("at", "w"))
    counts = words.groupBy("w").agg(F.sum(1 - F.col("at")).alias("first"), F.count(F.lit(1)).alias("n"))
    named = counts.where((F.col("first") >= 2) & (F.col("first") >= 3 * (F.col("n") - F.col("first"))) & ~F.col("w").isin(sorted(TITLES))).select("w", "first")
    named = materialize(named, "given")
    pets = spark.createDataFrame([(p, g) for p in PET_FORMS for g in givens(p)], "pet string, w string")  # a fixed list
    return named.join(pets.join(named, "w").select(F.col("pet").alias("w")), "w", "left_anti")


def learned_pet_forms(names: DataFrame, given: DataFrame) -> DataFrame:
    """(w, pet): a word and, as ``word given``, the given name for which it stands.

    Two words are forms of one name if at least ``PET_SURNAMES`` surnames have people of one identifier who bear now the one, now the other;
    they are no single edit apart, and the one that opens more full names is the given name.
    """
    two = names.where((F.col("known") == 1) & F.col("wikidata_qid").isNotNull() & (F.size(_words("key")) == 2)).select("wikidata_qid", _words("key").alias("k")).distinct()
    ends = two.select("wikidata_qid", F.explode(F.array(F.struct(F.col("k")[0].alias("y"), F.col("k")[1].alias("w")), F.struct(F.col("k")[1].alias("y"), F.col("k")[0].alias("w")))).alias("x")).select("wikidata_qid", "x.y", "x.w").where(F.length("w") > 2).distinct()
    other = ends.select("wikidata_qid", "y", F.col("w").alias("g"))
    both = ends.join(other, ["wikidata_qid", "y"]).where((F.col("w") != F.col("g")) & (F.levenshtein("w", "g", 1) < 0)).groupBy("w", "g").agg(F.count_distinct("y").alias("n")).where(F.col("n") >= PET_SURNAMES)
    often = lambda c, n: given.select(F.col("w").alias(c), F.col("first").alias(n))
    ranked = both.join(often("g", "g_first"), "g").join(often("w", "w_first"), "w", "left").where(F.col("g_first") > F.coalesce("w_first", F.lit(0)))
    return ranked.select("w", F.concat_ws(" ", "w", "g").alias("pet"))


def _sure(support: str) -> Column:
    """Whether other names support a form's surname."""
    return (F.coalesce(support, F.lit(0)) >= SUPPORT).alias(support)


def _words(key: str) -> Column:
    return F.split(F.split(key, "[#|]")[0], " ")


def person_groups(persons: DataFrame, streets: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """(name, person): every spelling of a person with its canonical form; spellings that no person's name explains are left out.

    Null and empty names are left out; titles do not count; the words for a generation keep namesakes apart, and so do years that
    contradict each other (without years, identifiers). A spelling whose best form has a posterior below ``least`` stays unattached.
    """
    spark = persons.sparkSession
    ship_code(spark)
    spread = parallelism(spark)
    given = materialize(given_names(persons), "given")
    facts = [F.col(f).cast("string").alias(f) for f in FACTS]
    p = persons.where("core_name_norm is not null and core_name_norm != ''").select(F.col("core_name_norm").alias("s"), _key("full_name").alias("full"), *facts)
    p = p.groupBy("s").agg(F.max("full").alias("full"), F.count(F.lit(1)).alias("n"), *(F.max(f).alias(f) for f in FACTS)).withColumn("known", F.lit(1))
    q = streets.where("core_name_norm is not null and core_name_norm != ''").groupBy(F.col("core_name_norm").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    q = q.select("s", F.lit(None).cast("string").alias("full"), "n", *(F.lit(None).cast("string").alias(f) for f in FACTS), F.lit(0).alias("known"))
    # the full names are spellings too, one for each person that the years tell apart, marked so that they are not returned
    person = F.concat_ws(MARK, F.lit(""), "full", F.coalesce("birth_year", F.lit("")), F.coalesce("death_year", F.lit("")))
    told = p.where("full is not null and full != '' and full not like '#%'").select(person.alias("s"), F.lit(None).cast("string").alias("full"), F.lit(0).cast("long").alias("n"), *FACTS, "known")
    names = p.unionByName(q).unionByName(told).groupBy("s").agg(F.max("full").alias("full"), F.sum("n").alias("n"), *(F.max(f).alias(f) for f in FACTS), F.max("known").alias("known"))
    names = names.withColumn("key", _key(F.when(F.startswith("s", F.lit(MARK)), F.split("s", MARK)[1]).otherwise(F.col("s")))).where("key != '' and key not like '#%'")
    names = materialize(names, "keys")

    learned = materialize(learned_pet_forms(names, given), "learned")
    given = given.join(learned.select("w").distinct(), "w", "left_anti")

    # people of one name: where years or identifiers contradict each other, the row's own value belongs to its form
    real = ~F.startswith("s", F.lit(MARK))
    many = [F.count_distinct(F.when(real, F.col(f))) > 1 for f in ("birth_year", "death_year")] + [(F.count_distinct(F.when(real, F.col("wikidata_qid"))) > 1) & (F.count("birth_year") + F.count("death_year") == 0)]
    several = names.where("known = 1").groupBy("key").agg(F.when(many[0], "birth_year").when(many[1], "death_year").when(many[2], "wikidata_qid").alias("told_by")).where("told_by is not null")
    value = F.coalesce(*(F.when(F.col("told_by") == f, F.col(f)) for f in ("birth_year", "death_year", "wikidata_qid")))
    own = F.when(F.col("told_by").isNull(), F.col("key")).when(value.isNotNull(), F.concat("key", F.lit("|"), value))
    words = names.select(F.explode(F.array_compact(F.array("key", "full"))).alias("k")).distinct().select("k", F.explode(_words("k")).alias("w"))
    kept = words.join(given, "w").groupBy("k").agg(F.sort_array(F.collect_set("w")).alias("g"))
    of = lambda k, g: kept.select(F.col("k").alias(k), F.col("g").alias(g))
    pets = materialize(words.join(learned, "w").groupBy("k").agg(F.sort_array(F.collect_set("pet")).alias("pets")), "pets")
    names = names.join(several, "key", "left").withColumn("own", own).drop("told_by").join(of("key", "key_g"), "key", "left").join(of("full", "full_g"), "full", "left")
    none = F.array().cast("array<string>")
    names = materialize(names.withColumn("g", F.array_union(F.coalesce("key_g", none), F.coalesce("full_g", none))), "names")

    # canonical forms: two or more whole words, a given name among them, or the name of a known person
    w = _words("key")
    whole = (F.size(w) >= 2) & F.forall(w, lambda x: F.length(x) >= 3)
    forms = names.where(whole & F.col("own").isNotNull()).groupBy(F.col("own").alias("form")).agg(F.sum("n").alias("form_n"), *(F.max(F.when(real, F.col(f))).alias(f"form_{f}") for f in FACTS), F.max("known").alias("known"), F.first("key_g").alias("form_g"))
    forms = forms.where(F.col("known").eqNullSafe(1) | (F.size(F.coalesce("form_g", none)) > 0)).withColumn("form_n", F.greatest(F.col("form_n"), F.lit(1)))
    surnames = forms.select("form", F.explode(F.array_except(_words("form"), F.coalesce("form_g", none))).alias("w"))
    support = surnames.groupBy("w").agg(F.count_distinct(F.split("form", "[|]")[0]).alias("forms"))
    supported = surnames.join(support, "w").groupBy("form").agg(F.min("forms").alias("support"))
    forms = materialize(forms.join(supported, "form", "left").withColumn("eid", F.xxhash64("form")), "forms")

    blocks = forms.select("eid", "form").repartition(spread).select("eid", F.explode(_form_blocks("form")).alias("b")).select("eid", F.xxhash64("b").alias("b"))
    keys = names.select("s", F.explode(F.array_distinct(F.array_compact(F.array("key", "full")))).alias("k")).join(pets, "k", "left").repartition(spread)
    sought = keys.select("s", F.explode(_spelling_blocks("k", "pets")).alias("b")).select("s", F.xxhash64("b").alias("b"))
    both = [pets.select(F.col("k").alias(k), F.col("pets").alias(f"{k}_pets")) for k in ("key", "full")]
    rows = names.select("s", "key", "full", "g", "own", *FACTS).join(both[0], "key", "left").join(both[1], "full", "left").withColumn("pets", F.array_union(F.coalesce("key_pets", none), F.coalesce("full_pets", none)))
    self_ = forms.select(F.col("form").alias("own"), F.col("form_n").alias("own_n"), "support")
    rows = rows.join(self_, "own", "left").select("s", "key", "full", "g", "pets", "own", F.coalesce("own_n", F.lit(0)).alias("own_n"), _sure("support"), *FACTS)
    target = forms.select("eid", "form", "form_n", _sure("support").alias("form_support"), "form_g", *(f"form_{f}" for f in FACTS))
    halves = lambda c, told, lengths: F.explode(F.transform(F.array(*half_blocks(F.col(c), lengths)), lambda x: F.struct(F.xxhash64(told, x["b"]).alias("b"), x["rest"].alias("rest")))).alias("x")
    generation = lambda c: F.coalesce(F.get(F.split(F.split(c, "[|]")[0], "#"), F.lit(1)), F.lit(""))
    ours = forms.select("eid", F.array_join(_words("form"), " ").alias("t"), generation("form").alias("told")).where(F.length("t") < MOST_LETTERS + MOST_WORDS).repartition(spread).select("eid", halves("t", F.col("told"), [0])).select("eid", "x.b", "x.rest")
    theirs = keys.select("s", F.explode(_edited_orders("k")).alias("t"), generation("k").alias("told")).select("s", halves("t", F.col("told"), [-1, 0, 1])).select("s", "x.b", F.col("x.rest").alias("s_rest"))
    edited = theirs.join(ours, "b").where(F.levenshtein("rest", "s_rest", 1) >= 0).select("s", "eid")
    pairs = sought.join(blocks, "b").select("s", "eid").unionByName(edited).distinct().join(target, "eid").join(rows, "s")
    scored = pairs.select("s", "key", "full", "g", "pets", "own", "own_n", "support", "form", "form_n", "form_support", "form_g", *FACTS, *(f"form_{f}" for f in FACTS)).mapInArrow(_score, "s string, form string, score double")
    best = scored.groupBy("s").agg(F.max_by("form", F.struct("score", "form")).alias("form"), F.max("score").alias("top"), F.sum(F.exp("score")).alias("sum"))
    stay = F.log("own_n") + F.when(F.coalesce("support", F.lit(99)) >= SUPPORT, 0.0).otherwise(UNSUPPORTED)
    chosen = names.select("s", "own").join(self_, "own", "left").join(best, "s", "left")
    moves = F.col("form").isNotNull() & (F.exp("top") >= least * F.col("sum")) & (F.col("own_n").isNull() | (F.col("top") > stay))
    chosen = materialize(chosen.select("s", "own", F.when(moves, F.col("form")).when(F.col("own_n").isNotNull(), F.col("own")).alias("person"), F.col("own_n").isNotNull().alias("is_form")).where("person is not null"), "chosen")

    # a form may itself be a spelling of another one; initials are no forms and join nothing
    links = chosen.where("is_form and own != person").select(F.col("own").alias("a"), F.col("person").alias("b")).distinct()
    label = _components(materialize(links, "links"))
    out = chosen.join(label, chosen.person == label.node, "left").select(F.col("s").alias("name"), F.coalesce("label", "person").alias("person"))
    return out.where(~F.startswith("name", F.lit(MARK)))


def _components(links: DataFrame) -> DataFrame:
    """(node, label) of the links' components, label being the smallest node.

    Every round a node takes the smallest label around it and then that label's own label, so the distance covered doubles.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        ahead = label.select(F.col("node").alias("new"), F.col("label").alias("ahead"))
        new = materialize(step.join(ahead, "new", "left").select("node", F.least("new", F.coalesce("ahead", "new")).alias("label"), (F.least("new", F.coalesce("ahead", "new")) < F.col("label")).alias("moved")), "label")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def same_person_pairs(persons: DataFrame, streets: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: every two spellings of one person."""
    g = materialize(person_groups(persons, streets), "groups")
    several = g.groupBy("person").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("person")
    g = g.join(several, "person", "left_semi")
    a, b = (g.select("person", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b")
