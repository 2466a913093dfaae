"""Text expressions with Unicode white space and word rules, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the separators 1c to 1f; for Java, where it is one look at a character's type. As a list of
#: ranges, every letter was held against each of them.
WS = r"(?U)[\s\x1c-\x1f]"
NOT_WS = r"(?U)[^\s\x1c-\x1f]"
#: The same characters as text.
WS_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Everything that is neither a word character nor white space.
NOT_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words(text: Column) -> Column:
    """Runs of non-white-space, in order; null stays null."""
    return F.array_remove(F.split(text, WS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))  # by a pattern every run of white space is tried again from each of its characters


def normalize_ws(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(F.rlike(text, F.lit(NOT_WS)), F.lit(False))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words without punctuation, sorted."""
    return F.sort_array(F.array_distinct(words(F.regexp_replace(F.lower(text), NOT_WORD, ""))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def fmt3(x: Column) -> Column:
    """Three decimals, half to even on the decimal value (0.0625 prints 0.062): units of 1e-18, multiplied as doubles, so 0.5255 counts as 0.525499999999999936."""
    units = F.bround((x * F.lit(1e18)).cast("decimal(38,0)"), -15).cast("decimal(38,0)")
    return (units / F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,3)").cast("string")


def preview(text: Column, n: int = 200) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))
