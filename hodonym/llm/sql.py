"""SQL of the queries that SQL can express."""

from unicodedata import normalize

from hodonym.llm.skeletons import LOOK_ALIKES

_BAG = r"array_to_string(list_sort(regexp_extract_all(lower(artera_raw), '[\p{L}\p{N}]+')), ' ')"
_BAGS = f"select id, min(id) over (partition by judet, uat, {_BAG}) head from streets where {_BAG} <> ''"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _items(field: str) -> str:
    return f"""
    select '{field}' as field, 'value' as kind, {field} as item, count(*) as occurrences, count(*) as records from streets where {field} <> '' group by 3
    union all select '{field}', 'term', item, count(*), count(distinct id) from (
        select id, unnest(string_split_regex({field}, '{_SPACE}')) as item from streets) where item <> '' group by 3"""


_COUNTS = f"""
    select *, case when records <= 1 then 'rare' when records * 500 > (select count(*) from streets) then 'common' end as mark
    from ({_items('core_name_norm')} union all {_items('name_normalized')})"""

# what SQL can say of the skeleton: single characters, the usual ligatures and invisible characters, composed letters
_PAIRS = [*zip(LOOK_ALIKES.split()[::2], LOOK_ALIKES.split()[1::2]), *((chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)), *zip("şţŞŢ", "șțȘȚ"), *((c, " ") for c in map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))]
_PAIRS += [("\u2010", "-"), ("\u2011", "-"), ("\u2043", "-"), ("\ufe63", "-"), ("\u02bc", "’"), ("\u2024", "."), ("\u037e", ";"), ("\u2236", ":"), ("\u2215", "/"), ("\u2044", "/"), ("ⅰ", "i"), ("ⅼ", "l"), ("Ⅰ", "I"), ("ⅴ", "v"), ("ⅹ", "x"), ("ⅽ", "c"), ("ⅾ", "d"), ("ⅿ", "m")]
# letters with marks: the composed look-alike beside the composed Latin letter
_PAIRS += [(x, y) for a, b in zip(LOOK_ALIKES.split()[::2], LOOK_ALIKES.split()[1::2]) for m in "\u0300\u0301\u0302\u0303\u0306\u0308\u030b\u0326" if len(x := normalize("NFC", a + m)) == len(y := normalize("NFC", b + m)) == 1]
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
_SHOWN = "regexp_replace(nfc_normalize(text), '[\\p{Cf}\\x{34f}\\x{115f}\\x{1160}\\x{3164}\\x{ffa0}\\x{180b}-\\x{180f}\\x{fe00}-\\x{fe0f}]', '', 'g')"
for _a, _b in _LIGATURES.items():
    _SHOWN = f"replace({_SHOWN}, '{_a}', '{_b}')"
_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(*_PAIRS))
_LOOK = f"translate(nfc_normalize(translate({_SHOWN}, '{_FROM}', '{_TO}')), 'şţŞŢ', 'șțȘȚ')"
_LOOKS = f"looks as (select doc_id, text, {_LOOK} look from documents where trim(text) <> '')"
_SHARED = "shared as (select look from looks where look <> '' group by 1 having count(distinct text) > 1)"


def _grams(table: str, key: str) -> str:
    words = f"select {key}, regexp_extract_all(lower(strip_accents({_LOOK})), '[\\p{{L}}\\p{{N}}]+') w from {table}"
    return f"select distinct {key}, array_to_string(w[i:i + 11], ' ') gram from (select {key}, w, unnest(range(1, len(w) - 10)) i from ({words}) where len(w) >= 12)"


LLM_SQL = {
    "p9_found": f"select distinct doc_id, item_id from ({_grams('documents', 'doc_id')}) join ({_grams('eval_items', 'item_id')}) using (gram)",
    "p10_found": f"with {_LOOKS}, {_SHARED} select a.doc_id doc_a, b.doc_id doc_b from looks a join looks b using (look) where look in (from shared) and a.doc_id < b.doc_id and a.text <> b.text",
    "p10_groups": f"with {_LOOKS}, {_SHARED} select doc_id, min(doc_id) over (partition by look) group_id from looks where look in (from shared)",
    "p2_found": f"select head as first_id, id as copy_id from ({_BAGS}) where id <> head",
    "p2_counts": f"select head as first_id, count(*) as n_copies from ({_BAGS}) group by 1",
    "p4_counts": _COUNTS,
    "p4_found": f"select field, kind, item, mark from ({_COUNTS}) where mark is not null",
}
