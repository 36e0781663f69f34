"""Turkic case mapping, case predicates and composition, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose full upper case has several characters keep their simple one, which is themselves.
FULL_MAPPED = "ßŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ"
PARKED = "".join(chr(0xE000 + i) for i in range(len(FULL_MAPPED)))
#: Base letter and combining mark, and what they compose to.
COMPOSED = {
    "ö": "ö", "Ö": "Ö", "ü": "ü", "Ü": "Ü", "ç": "ç", "Ç": "Ç",
    "ş": "ş", "Ş": "Ş", "ğ": "ğ", "Ğ": "Ğ", "İ": "İ",
}
APOSTROPHES = "'’ʼ"


def az_lower(text: Column) -> Column:
    """Lower case with I -> ı and İ -> i, character by character."""
    return F.lower(F.translate(text, "IİΣ", "ıiσ"))


def az_upper(text: Column) -> Column:
    """Upper case with i -> İ and ı -> I, character by character."""
    parked = F.translate(F.translate(text, "iı", "İI"), FULL_MAPPED, PARKED)
    return F.translate(F.upper(parked), PARKED, FULL_MAPPED)


def upper_first(text: Column) -> Column:
    return F.concat(az_upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def is_title_case(text: Column) -> Column:
    """First letter upper, some later letter not."""
    return text.rlike(r"^\p{Lu}") & text.rlike(r"(?s)^.+?[\p{L}&&[^\p{Lu}]]")


def is_all_upper(text: Column) -> Column:
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def apply_case(original: Column, corrected: Column) -> Column:
    """The case pattern of one word on another."""
    return (
        F.when(is_all_upper(original), az_upper(corrected))
        .when(original.rlike(r"^\p{Lu}"), upper_first(corrected))
        .otherwise(corrected)
    )


def contains_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def is_apostrophe(char: Column) -> Column:
    return char.isin(*APOSTROPHES)


def compose_nfc(text: Column) -> Column:
    """Compose the Azerbaijani letters that may come as base and mark; nothing else changes."""
    composed = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), COMPOSED.items(), text)
    return F.when(text.rlike("[̧̆̇̈]"), composed).otherwise(text)
