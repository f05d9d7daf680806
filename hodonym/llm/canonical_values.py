"""Free-entered values mapped to a canonical list (problem 7).

The list's entries, their forms without article and their abbreviations become a symmetric-delete dictionary: each key
is an entry's form or that form with one letter taken out. A typed token is looked up with its own deletions, so
that every form within one edit (insertion, deletion, substitution, swap of neighbours) is met without comparing it with
the list. Candidates are ranked by weighted Damerau-Levenshtein distance, then by how often the entry itself is typed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodonym.session import ship_code

UNMATCHED = "unmatched"
#: Most entries of a dictionary that is sent to every task; longer lists are joined.
MOST_ENTRIES = 5_000
#: Weights of the edits: a doubled letter or a swap is likelier than a foreign letter.
DOUBLED, SWAPPED, EDITED = 0.6, 0.7, 1.0
#: Penalty of an abbreviation that no list gives.
SHORTENED = 1.5


def fold(text: str) -> str:
    """Lower case without diacritics; î and â inside a word fall together, as do both ways to write ș and ț."""
    text = re.sub(r"(?<=\w)î(?=\w)", "â", unicodedata.normalize("NFC", text).lower())
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def bare_form(form: str) -> str:
    """A folded noun without its article: bulevardul, soseaua, aleea -> bulevard, sosea, alee."""
    for ending, rest in (("ul", ""), ("aua", "a"), ("eaua", "ea"), ("ea", "e"), ("ia", "ie")):
        if form.endswith(ending) and len(form) - len(ending) >= 3:
            return form[: -len(ending)] + rest
    return form


def edit_cost(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein (restricted) distance."""
    before, last = None, [i * EDITED for i in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * EDITED]
        for j, y in enumerate(b, 1):
            gone = DOUBLED if i > 1 and x == a[i - 2] else EDITED
            added = DOUBLED if j > 1 and y == b[j - 2] else EDITED
            cost = min(last[j] + gone, row[j - 1] + added, last[j - 1] + (0 if x == y else EDITED))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                cost = min(cost, before[j - 2] + SWAPPED)
            row.append(cost)
        before, last = last, row
    return last[-1]


def deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _within(word: str, form: str) -> bool:
    it = iter(form)
    return all(c in it for c in word)


def thirds(form: str) -> set[str]:
    """The first letter of a form with every two later ones, in order: what an abbreviation of three or more letters begins with."""
    return {form[0] + b + c for b, c in combinations(form[1:], 2)}


def words_of(typed: str) -> list[str]:
    """The folded words of a typed value, letters and digits only; none if it holds a digit."""
    if any(c.isdigit() for c in typed):
        return []
    return [w for w in (re.sub(r"[^a-z0-9]", "", x) for x in re.split(r"[\s.,;:/()\"'„”]+", fold(typed)) if x) if w]


def forms_of(entry: str) -> set[str]:
    """An entry's folded words, with and without article."""
    whole = " ".join(re.split(r"[\s-]+", fold(entry).strip()))
    return {whole, bare_form(whole)} if whole else set()


def short_form(short: str | None) -> str:
    return re.sub(r"[^a-z0-9]", "", fold(short)) if short else ""


@dataclass
class Dictionary:
    """Symmetric-delete dictionary over (entry, abbreviation) pairs; ``frequency`` ranks entries at equal distance."""

    entries: Iterable[tuple[str, str | None]]
    frequency: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forms: dict[str, set[str]] = {}
        self.near: dict[str, set[str]] = {}
        self.full: dict[str, set[str]] = {}
        self.begun: dict[str, set[str]] = {}
        self.most_words = 1
        for entry, short in self.entries:
            for form in forms_of(entry) if entry else ():
                self.full.setdefault(form, set()).add(entry)
                self.forms.setdefault(form, set()).add(entry)
                self.most_words = max(self.most_words, form.count(" ") + 1)
            if entry and (s := short_form(short)):
                self.forms.setdefault(s, set()).add(entry)
        for form in self.full:
            for d in deletions(form) | {form} if len(form) >= 4 else ():
                self.near.setdefault(d, set()).add(form)
            for t in thirds(form):
                self.begun.setdefault(t, set()).add(form)
        self.memo: dict[str, tuple[float, int, str] | None] = {}

    def token(self, word: str) -> tuple[float, int, str] | None:
        """(cost, -frequency, entry) of the entry that folded words, as a rule one, mean together, if any."""
        if word not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = self._token(word)
        return self.memo[word]

    def _token(self, word: str) -> tuple[float, int, str] | None:
        rank = lambda cost, entries: min((cost, -self.frequency.get(e, 0), e) for e in entries)
        if word in self.forms:
            return rank(0.0, self.forms[word])
        if len(word) < 3 or not word.replace(" ", "").isalpha():
            return None
        forms = {f for d in deletions(word) | {word} for f in self.near.get(d, ())}
        found = [rank(cost, self.full[f]) for f in forms if (cost := edit_cost(word, f)) <= EDITED]
        if not found:  # letters of one entry in order, from its first letter on
            begun = self.begun.get(word[:3], ())
            ends = {e for f in begun if f.startswith(word) or len(word) <= 5 and _within(word, f) and (word[-1] == f[-1] or len(word) == 3) for e in self.full[f]}
            starts = {e for f in begun if f.startswith(word) for e in self.full[f]}
            if len(ends) == 1 or len(word) >= 4 and ends and ends == starts:
                found = [rank(SHORTENED, ends)]
        return min(found) if found else None

    def meant(self, typed: str | None) -> str | None:
        """The entry that ``typed`` means; of two that it names, the second. Entries of several words are sought in as many words together."""
        return read_entries(words_of(typed), self.token, self.most_words) if typed else None


def read_entries(words: list[str], token: Callable[[str], tuple[float, int, str] | None], most_words: int) -> str | None:
    """The last of the entries into which ``words`` fall without rest, the longest first; None if they do not."""
    at, last = 0, None
    while at < len(words):
        for n in range(min(most_words, len(words) - at), 0, -1):
            if got := token(" ".join(words[at : at + n])):
                break
        else:
            return None
        at, last = at + n, got[2]
    return last


def dictionary(entries: DataFrame, entry: str, short: str, typed: DataFrame, value: str) -> Dictionary:
    """The dictionary of ``entries``, at most ``MOST_ENTRIES``, ranked by how often each entry is itself typed in ``typed[value]``.

    It is meant to be sent to every task; ``mapped_values`` also takes longer lists.
    """
    ship_code(entries.sparkSession)
    rows = [tuple(r) for r in entries.select(entry, short).where(F.col(entry).isNotNull()).orderBy(entry).limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries are not sent to every task: use mapped_values")
    names = {r[0] for r in rows}
    counts = typed.where(F.col(value).isin(sorted(names))).groupBy(value).count().collect() if names else []  # one row per entry
    return Dictionary(rows, {r[0]: r[1] for r in counts})


def canonical(words: Dictionary) -> "callable":
    """A column function: the entry meant, or 'unmatched'; null stays null. Each distinct text of a batch is looked up once."""

    @F.pandas_udf("string")
    def look_up(typed: pd.Series) -> pd.Series:
        known = {t: words.meant(t) or UNMATCHED for t in typed.dropna().unique()}
        return pd.Series([known.get(t) if isinstance(t, str) else None for t in typed], dtype=object)

    def of(c: Column) -> Column:
        return F.when(c.isNotNull(), look_up(c))

    return of


def mapped_values(typed: DataFrame, value: str, entries: DataFrame, entry: str, short: str, to: str, counted: DataFrame | None = None) -> DataFrame:
    """``typed`` with the column ``to``: the entry that ``value`` means, or 'unmatched'; null stays null.

    Entries at equal distance rank by how often they stand in ``counted[value]``, by default ``typed`` itself. The dictionary of a list of at most ``MOST_ENTRIES`` is sent to every task. That of a longer one stays a table: the distinct words typed are
    joined with it by their deletions, forms and first letters, which meets the same candidates and gives the same entries.
    """
    counted = typed if counted is None else counted
    listed = entries.where(F.col(entry).isNotNull())
    if listed.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES:
        return typed.withColumn(to, canonical(dictionary(entries, entry, short, counted, value))(F.col(value)))
    ship_code(entries.sparkSession)
    counts = counted.groupBy(F.col(value).alias("entry")).agg(F.count(F.lit(1)).alias("frequency"))
    ranked = listed.select(F.col(entry).alias("entry"), F.col(short).alias("short")).join(counts, "entry", "left").fillna(0, ["frequency"])
    most = int(listed.agg(F.max(F.size(F.split(F.trim(entry), r"[\s-]+")))).first()[0])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e, s, n in zip(*(c.to_pylist() for c in b.columns)):
                keys = {"=" + short_form(s)} if s else set()
                for f in forms_of(e):
                    keys |= {"=" + f} | {"-" + d for d in (deletions(f) | {f} if len(f) >= 4 else ())} | {"." + t for t in thirds(f)}
                out += [(k, e, s, n) for k in keys]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["k", "entry", "short", "frequency"])

    @F.pandas_udf("array<string>")
    def spans(text: pd.Series) -> pd.Series:
        each = (words_of(t) for t in text)
        return pd.Series([[" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)] for w in each])

    @F.pandas_udf("array<string>")
    def keys_of(span: pd.Series) -> pd.Series:
        return pd.Series([["=" + w, *(f"-{d}" for d in deletions(w) | {w}), *(["." + w[:3]] if len(w) >= 3 else [])] for w in span])

    @F.pandas_udf("string")
    def choose(span: pd.Series, found: pd.Series) -> pd.Series:
        got = (Dictionary([(x["entry"], x["short"]) for x in c], {x["entry"]: x["frequency"] for x in c}).token(w) for w, c in zip(span, found))
        return pd.Series([g[2] if g else None for g in got], dtype=object)

    @F.pandas_udf("string")
    def read(text: pd.Series, known: pd.Series) -> pd.Series:
        tables = ({x["span"]: (0.0, 0, x["entry"]) for x in (k if k is not None else ())} for k in known)
        return pd.Series([read_entries(words_of(t), k.get, most) or UNMATCHED for t, k in zip(text, tables)], dtype=object)

    texts = typed.select(F.col(value).alias("text")).where("text is not null").distinct()
    parts = texts.select("text", F.explode(spans("text")).alias("span"))
    sought = parts.select("span").distinct().select("span", F.explode(keys_of("span")).alias("k"))
    near = sought.join(ranked.mapInArrow(index, "k string, entry string, short string, frequency long"), "k").groupBy("span").agg(F.collect_set(F.struct("entry", "short", "frequency")).alias("found"))
    meant = near.select("span", choose("span", "found").alias("entry")).where("entry is not null")
    known = parts.join(meant, "span").groupBy("text").agg(F.collect_set(F.struct("span", "entry")).alias("known"))
    answers = texts.join(known, "text", "left").select(F.col("text").alias("_typed"), read("text", "known").alias(to))
    return typed.join(answers, typed[value] == answers["_typed"], "left").drop("_typed")
