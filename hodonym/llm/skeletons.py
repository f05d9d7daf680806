"""Texts that look the same although their characters differ (problem 10).

The skeleton of a text: decompose it, drop what is invisible, replace every character by the prototype that looks like it,
decompose again. Texts with equal skeletons look the same. The texts are read once; all that follows works on digests.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.session import materialize, ship_code

# Letters of other scripts beside the Latin letters that look the same: Cyrillic, Greek, Armenian and phonetic, Cherokee, Coptic,
# Lisu, Canadian syllabics, small capitals.
LOOK_ALIKES = """
а a  с c  ԁ d  е e  ҽ e  һ h  і i  ј j  о o  р p  ԛ q  ѕ s  ѵ v  ԝ w  х x  у y  ү y  ӏ l  ӕ æ
А A  В B  С C  Е E  Ғ F  Ԍ G  Н H  І I  Ј J  К K  М M  О O  Р P  Ѕ S  Т T  Ѵ V  Ԝ W  Х X  Ү Y  У Y  Ӏ I  Ӕ Æ
α a  γ y  ι i  ν v  ο o  ρ p  υ u  ϲ c  ϳ j
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J
ո n  ս u  օ o  հ h  ց g  զ q  Ս U  Տ S  Օ O  ɑ a  ɡ g  ꞓ c
Ꭺ A  Ᏼ B  Ꮯ C  Ꭰ D  Ꭼ E  Ꮐ G  Ꮋ H  Ꭻ J  Ꮶ K  Ꮮ L  Ꮇ M  Ꮲ P  Ꮢ R  Ꮪ S  Ꭲ T  Ꮩ V  Ꮃ W  Ꮓ Z
ⲟ o  ⲥ c  ⲣ p  Ⲃ B  Ⲥ C  Ⲉ E  Ⲏ H  Ⲓ I  Ⲕ K  Ⲙ M  Ⲛ N  Ⲟ O  Ⲣ P  Ⲧ T  Ⲭ X  Ⲩ Y  Ⲍ Z
ꓮ A  ꓐ B  ꓚ C  ꓓ D  ꓰ E  ꓝ F  ꓖ G  ꓧ H  ꓲ I  ꓙ J  ꓗ K  ꓡ L  ꓟ M  ꓠ N  ꓳ O  ꓑ P  ꓣ R  ꓢ S  ꓔ T  ꓴ U  ꓦ V  ꓪ W  ꓫ X  ꓬ Y  ꓜ Z
ᗅ A  ᗷ B  ᗞ D  ᖴ F  ᕼ H  ᒍ J  ᒪ L  ᑭ P  ᖇ R  ᑌ U  ᐯ V  ᙭ X  ᑲ b  ᑯ d
ᴄ c  ᴏ o  ꜱ s  ᴜ u  ᴠ v  ᴡ w  ᴢ z
"""
#: Marks below a letter that look the same: the cedilla and the comma below.
MARKS = {0x0327: 0x0326, 0x0321: 0x0326}
# Hyphens and quotes of one look.
SAME_SIGNS = {0x2010: "-", 0x2011: "-", 0x2043: "-", 0xFE63: "-", 0x02BC: "’", 0x2024: ".", 0x037E: ";", 0x2236: ":", 0x2215: "/", 0x2044: "/"}
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Prototypes(dict):
    """Character -> its prototype, or None where it is invisible; what Unicode itself states is taken from its tables."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        category, form = unicodedata.category(c), unicodedata.decomposition(c)
        to: int | str | None = code
        if category == "Cf" or code in _INVISIBLE:
            to = None
        elif category == "Zs":
            to = " "
        elif form.startswith(("<wide>", "<narrow>", "<font>")):
            to = unicodedata.normalize("NFKD", c)
        elif form.startswith("<compat>") and category in ("Ll", "Lu", "Lt", "Nl") and len(x := unicodedata.normalize("NFKD", c)) > 1 and x.isalpha():
            to = x  # ligatures, digraphs, Roman numerals
        elif form.startswith("<compat>") and category == "Nl":
            to = unicodedata.normalize("NFKD", c)  # Roman numerals of one letter
        self[code] = to
        return to


@cache
def prototypes() -> dict[int, int | str | None]:
    words = LOOK_ALIKES.split()
    return _Prototypes({ord(a): b for a, b in zip(words[::2], words[1::2], strict=True)} | MARKS | SAME_SIGNS)


def more_look_alikes(path: str) -> dict[int, str]:
    """Single characters and their prototypes from a file in the format of Unicode's list of confusables (``code ; prototype ; type # ...``).

    Prototypes that are digits, or stand for a digit, are left out, as digits and letters are kept apart.
    """
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = [x.split() for x in line.split("#")[0].split(";")[:2]]
            if len(fields) == 2 and len(fields[0]) == 1:
                code, to = int(fields[0][0], 16), "".join(chr(int(x, 16)) for x in fields[1])
                if not chr(code).isascii() and not any(c.isdigit() for c in chr(code) + to):
                    out[code] = to
    return out


def skeleton(text: str, more: dict[int, str] | None = None) -> str:
    """The skeleton of a text; ``more`` look-alikes count before the table of this module."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", (text.translate(more) if more else text).translate(prototypes()))


def _digests(more: dict[int, str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            whole = [digest(t) for t in texts]
            bare = [d if t.isascii() else digest(skeleton(t, more)) for t, d in zip(texts, whole)]
            yield pa.record_batch([b.column(0), pa.array(bare, pa.binary()), pa.array(whole, pa.binary())], names=["id", "skeleton", "text"])

    return digests


def _marked(df: DataFrame, row_id: str, text: str, more: dict[int, str] | None) -> tuple[DataFrame, DataFrame]:
    """(id, skeleton, text) of all rows as 128-bit digests, written once; (skeleton, text, head) of the different texts of skeletons that several share."""
    ship_code(df.sparkSession)
    ids = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("text is not null and id is not null and trim(text) != ''")
    marked = materialize(rows.mapInArrow(_digests(more), f"id {ids}, skeleton binary, text binary"), "digests")
    empty = hashlib.blake2b(b"", digest_size=16).digest()
    forms = marked.where(F.col("skeleton") != F.lit(empty)).groupBy("skeleton", "text").agg(F.min("id").alias("head"))
    several = forms.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("skeleton")
    return marked, materialize(forms.join(several, "skeleton", "left_semi"), "forms")


def look_alike_groups(df: DataFrame, row_id: str, text: str, more: dict[int, str] | None = None) -> DataFrame:
    """(id, group_id): each row of a skeleton that at least two different texts share, with the smallest id of the skeleton's rows.

    Null texts and ids, and texts without any visible character, are left out. Rows are counted per text before anything is gathered by
    skeleton, and only then joined, by text, with the few texts that share a skeleton.
    """
    marked, forms = _marked(df, row_id, text, more)
    heads = forms.groupBy("skeleton").agg(F.min("head").alias("group_id"))
    return marked.join(forms.join(heads, "skeleton").select("text", "group_id"), "text").select("id", "group_id")


def look_alike_pairs(df: DataFrame, row_id: str, text: str, more: dict[int, str] | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every two rows whose different texts have one skeleton.

    The different texts of a skeleton are paired first; the pairs are then spread to the rows that hold the two texts, so copies of one text are
    never joined with each other.
    """
    marked, forms = _marked(df, row_id, text, more)
    a, b = (forms.select("skeleton", F.col("text").alias(f"text_{x}")) for x in "ab")
    texts = a.join(b, "skeleton").where("text_a < text_b").select("text_a", "text_b")
    left, right = (marked.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = texts.join(left, "text_a").join(right, "text_b").where("id_a != id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()
