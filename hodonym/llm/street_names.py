"""Street texts taken apart: type, words of the name, and how well a spelling is written."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.llm.canonical_values import SHORTENED, Dictionary, fold
from hodonym.session import ship_code

# Folded words that stand before a person's name and are no part of it.
TITLES = frozenset(
    "academician acad amiral arhitect arh aviator capitan cpt capt caporal colonel col comandor compozitor cronicar dl dna doamna doctor dr "
    "domnitor domnul domnitorul domnita episcop erou eroul general gen gral inginer ing invatator inv invatatorul jandarm locotenent lt "
    "maior mr maresal mitropolit parinte patriarh pictor plutonier poet preot prof profesor regele regina sculptor sergent serg slt soldat "
    "sublocotenent universitar univ vistier voda voievod".split()
)
# Folded words that mark a saint's name.
SAINTS = frozenset("sfantul sfanta sfintii sfintele sfintilor sf sfinti sft cuviosul cuvioasa".split())
#: The mark of a saint in a key.
SAINT = "sf"
#: Words that stay small within a name.
SMALL = frozenset("de din cel cea la lui si pe sub ale al a cu către spre dela".split())
_PAREN = re.compile(r"\([^)]*(?:\)|$)")
_WORD = re.compile(r"[^\W_]+(?:[-–'’][^\W_]+)*\.?")
_CLEAN = re.compile(r"[^\W_]+(?:-[^\W_]+)*\.?(?: [^\W_]+(?:-[^\W_]+)*\.?)*")
_NUMBER = re.compile(r"\d+[a-z]?")
_MARKED = re.compile("[ăâîșțĂÂÎȘȚáéíóöőúüűÁÉÍÓÖŐÚÜŰ]")
_CEDILLAS = re.compile("[şţŞŢ]")
_COMMAS = str.maketrans("şţŞŢ", "șțȘȚ")


class Parser:
    """Takes street texts apart with the types of a ``Dictionary``; remembers what it folded."""

    def __init__(self, types: Dictionary) -> None:
        self.types = types
        self.memo: dict[str, tuple] = {}
        self.texts: dict[str, tuple[str | None, tuple[str, ...]]] = {}

    def _word(self, raw: str) -> tuple[tuple[str, ...], str | None, bool]:
        """The folded parts of a written word; the type that it may be; whether only as a leading abbreviation."""
        if raw not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            folded = fold(raw.rstrip("."))
            parts = tuple(p for p in re.split(r"[-–'’]", folded) if p)
            whole = "".join(parts)
            entry, leading = None, False
            if whole.isalpha() and (got := self.types.token(whole)):
                if got[0] == 0:
                    entry, leading = got[2], whole not in self.types.full
                elif got[0] == SHORTENED and (raw.endswith(".") or "-" in raw):
                    entry, leading = got[2], True
            self.memo[raw] = parts, entry, leading
        return self.memo[raw]

    def split(self, text: str) -> tuple[str | None, list[str]]:
        """(type, folded words) of a street text; what is in brackets is left out."""
        if text not in self.texts:
            if len(self.texts) > 100_000:
                self.texts.clear()
            kind, words = self._split(text)
            self.texts[text] = kind, tuple(words)
        kind, words = self.texts[text]
        return kind, list(words)

    def _split(self, text: str) -> tuple[str | None, list[str]]:
        words = [self._word(w) for w in _WORD.findall(_PAREN.sub(" ", text) if "(" in text else text)]
        kind = None
        if len(words) > 1:
            if words[0][1]:
                kind, words = words[0][1], words[1:]
            elif words[-1][1] and not words[-1][2]:
                kind, words = words[-1][1], words[:-1]
        return kind, [p for w in words for p in w[0]]

    def name(self, text: str) -> list[str]:
        """The folded words of a name that has no type."""
        return [p for w in _WORD.findall(_PAREN.sub(" ", text)) for p in self._word(w)[0]]


def core_words(words: list[str]) -> list[str]:
    """The words that make the identity: without titles, saints marked alike; only titles stay as they are."""
    rest = [w for w in words if w not in TITLES and w not in SAINTS]
    if not rest:
        return words
    return [SAINT, *rest] if any(w in SAINTS for w in words) else rest


def is_number(words: list[str]) -> bool:
    return len(words) == 1 and _NUMBER.fullmatch(words[0]) is not None


def _usual_capitals(text: str) -> bool:
    for i, word in enumerate(text.split()):
        if word[0].isdigit():
            continue
        parts = word.split("-")
        if parts[0].islower():
            if i == 0 or fold(parts[0]) not in SMALL:
                return False
        elif not parts[0][0].isupper() or parts[0][1:] != parts[0][1:].lower():
            return False
        if any(p[1:] != p[1:].lower() for p in parts[1:]):
            return False
    return True


#: Points of a spelling: for clean writing of just the words wanted in usual capitals, against each abbreviation, hyphen and cedilla, for each diacritic.
CLEAN, SHORT, HYPHEN, CEDILLA, MARK = 1024, -128, -16, -4, 1


def tidy(text: str | None) -> str | None:
    """The text composed, with commas for cedillas and single blanks; None if nothing is left."""
    return " ".join(unicodedata.normalize("NFC", text).translate(_COMMAS).split()) or None if text else None


def writing(text: str) -> tuple[str | None, bool, int]:
    """(tidy text, whether it is in clean writing and usual capitals, the points of how fully it is written otherwise)."""
    short = sum(w[-1] == "." or len(w) == 1 and w.isalpha() for w in text.split())
    rest = SHORT * short + HYPHEN * text.count("-")
    if not text.isascii():
        rest += MARK * len(_MARKED.findall(text)) + CEDILLA * len(_CEDILLAS.findall(text))
    return tidy(text), _CLEAN.fullmatch(text) is not None and _usual_capitals(text), rest


_FORM = "judet string, uat string, kind string, key string, spelt string, name string, name_points long, name_clean boolean, core_name string, core_points long, core_clean boolean, n long, first_id long, newest double, votes double"
_NAMES = [c.split()[0] for c in _FORM.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in _FORM.split(", ")]
#: Spellings that a task holds before it hands them on.
HELD = 200_000


def parsed_spellings(streets: DataFrame, types: Dictionary, half_life: float) -> DataFrame:
    """The rows of streets without bare numbers, summed per task and spelling: street, points of name and core_name, and the votes.

    ``spelt`` is the order of the words without titles. ``votes`` sums 2 ** (age / half_life) of the rows, age being counted backwards
    from ``newest``, the spelling's latest date as log2 of its weight.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known, written, held = Parser(types), {}, {}, {}

        def look(raw: str | None, name: str | None, core: str | None) -> tuple | None:
            kind, words = p.split(raw or "")
            body = core_words(words)
            if not body or is_number(body):
                return None
            rest = [w for w in words if w not in TITLES and w not in SAINTS] or words
            fields = []
            for x, want in ((name, words), (core, rest)):
                if not x:
                    fields += [None, None, False]
                    continue
                if x not in written:
                    if len(written) > 100_000:
                        written.clear()
                    written[x] = *writing(x), p.name(x)
                value, clean, points, own = written[x]
                clean = clean and own == want
                fields += [value, points + CLEAN * clean, clean]
            return kind, " ".join(sorted(body)), " ".join(rest), *fields

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        for b in batches:
            for i, judet, uat, raw, name, core, at in zip(*(c.to_pylist() for c in b.columns)):
                text = (raw, name, core)
                if text not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[text] = look(*text)
                if (form := known[text]) is None:
                    continue
                weight = (at or 0.0) / half_life
                if (sums := held.get((judet, uat, *form))) is None:
                    held[judet, uat, *form] = [1, i, weight, 1.0]
                    continue
                sums[0] += 1
                if i is not None and (sums[1] is None or i < sums[1]):
                    sums[1] = i
                if weight > sums[2]:
                    sums[3] = sums[3] * _power(sums[2] - weight) + 1.0
                    sums[2] = weight
                else:
                    sums[3] += _power(weight - sums[2])
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    ship_code(streets.sparkSession)
    cols = [F.col("id").cast("long"), "judet", "uat", "artera_raw", "name", "core_name", (F.unix_micros(F.col("recorded_at").cast("timestamp")) / 1e6).alias("at")]
    return streets.select(*cols).mapInArrow(parse, _FORM)


def _power(x: float) -> float:
    return 2.0**x if x > -1000 else 0.0
