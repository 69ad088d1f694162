"""Text column functions: trimming, ASCII folding, release characters, units."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderweave import fixed_values as fv

# Every character that str.isspace() accepts, as a Java class and as plain text.
_WHITE = (r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
_WHITE_CHARS = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_code(c: Column) -> Column:
    """Comparison key of a part code: stripped, upper case, blank as NULL."""
    return blank_to_null(F.upper(strip(c)))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the pattern does not occur."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def tokens(c: Column) -> Column:
    """Distinct whitespace-separated words."""
    return F.array_distinct(
        F.filter(F.split(c, f"[{_WHITE}]+"), lambda w: w != ""))


@lru_cache(maxsize=None)
def _compatibility_table() -> tuple[str, str, dict[str, str]]:
    """Non-ASCII characters whose NFKD form holds ASCII: one-to-one, one-to-many.

    NFKD works character by character and everything outside ASCII is dropped
    afterwards, so a per-character table gives the same text as normalising.
    """
    one_from, one_to, many = [], [], {}
    for point in range(128, 0x110000):
        char = chr(point)
        form = unicodedata.normalize("NFKD", char)
        ascii_part = "".join(p for p in form if ord(p) < 128)
        if len(ascii_part) == 1:
            one_from.append(char)
            one_to.append(ascii_part)
        elif ascii_part:
            many[char] = ascii_part
    return "".join(one_from), "".join(one_to), many


def _expand(c: Column, table: dict[str, str]) -> Column:
    """Replace single characters by longer strings, looping only over those present."""
    # Two literals instead of hundreds keep the plan small; Spark folds them to one map.
    keys, values = F.lit("\n".join(table)), F.lit("\n".join(table.values()))
    lookup = F.map_from_arrays(F.split(keys, "\n"), F.split(values, "\n"))
    special = F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7F]+", ""), ""))
    present = F.filter(special, lambda ch: (ch != "") & (F.instr(keys, ch) > 0))
    return F.aggregate(
        present, c, lambda text, ch: F.replace(text, ch, F.element_at(lookup, ch)))


def ascii_fold(c: Column, german: bool = True) -> Column:
    """ASCII text: German letters first (optional), then compatibility folding.

    Plain ASCII values, the common case, pass through untouched.
    """
    one_from, one_to, many = _compatibility_table()
    text = c
    if german:
        for letter, spelled in fv.GERMAN_LETTERS.items():
            text = F.replace(text, F.lit(letter), F.lit(spelled))
    # One by one first: after that hardly any text has a character left for the long table.
    text = F.translate(text, one_from, one_to)
    rest = let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(
        _expand(t, many), r"[^\x00-\x7F]", "")).otherwise(t))
    return F.when(c.rlike(r"[^\x00-\x7F]"), rest).otherwise(c)


def release_chars(c: Column) -> Column:
    """Mark the four service characters with the release character."""
    return F.regexp_replace(c, r"([?+:'])", r"?$1")


def message_text(c: Column) -> Column:
    return release_chars(ascii_fold(c))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL for unknown keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def table_unit(c: Column) -> Column:
    return lookup(F.lower(strip(c)), fv.TABLE_UNITS)


def payload_unit(c: Column) -> Column:
    """Unit of measure of any spelling, accents ignored; NULL when unknown."""
    def read(word: Column) -> Column:
        by_part = (F.when(word.rlike("stk|stuck|piece|pcs"), "PCE")
                   .when(word.rlike("^kg|kilogram"), "KGM")
                   .when(word.contains("ton"), "TNE")
                   .when(word.contains("met"), "MTR"))
        return F.when(word != "", F.coalesce(lookup(word, fv.PAYLOAD_UNITS), by_part))

    return let(F.lower(strip(ascii_fold(c, german=False))), read)
