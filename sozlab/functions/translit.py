"""Azerbaijani Latin and Cyrillic script, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for each other, in the order of the Latin alphabet.
LATIN = "AaBbCcÇçDdEeƏəFfGgĞğHhIıİiJjKkLlMmNnOoÖöPpQqRrSsŞşTtUuÜüVvXxYyZz"
CYRILLIC = "АаБбҸҹЧчДдЕеӘәФфҜҝҒғҺһЫыИиЖжКкЛлМмНнОоӨөПпГгРрСсШшТтУуҮүВвХхЈјЗз"
#: Letters that only the way to Latin knows, and signs that it drops.
ALSO_CYRILLIC, ALSO_LATIN, DROPPED = "Йй", "Yy", "ЬьЪъ"
FRONT_VOWELS = "ӘәЕеИиӨөҮү"


def latin_to_cyrillic(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


def cyrillic_to_latin(text: Column) -> Column:
    """Г is G where the next letter is a front vowel and the text writes no Ҝ, else Q; soft and hard signs go."""
    softened = F.regexp_replace(text, rf"Г(?=\P{{L}}*[{FRONT_VOWELS}])", "G")
    softened = F.regexp_replace(softened, rf"г(?=\P{{L}}*[{FRONT_VOWELS}])", "g")
    chosen = F.when(text.rlike("[Ҝҝ]"), text).otherwise(softened)
    return F.translate(chosen, CYRILLIC + ALSO_CYRILLIC + DROPPED, LATIN + ALSO_LATIN)


def arabic_to_latin(text: Column) -> Column:
    """Not defined for this script yet: the text itself."""
    return text


def latin_to_arabic(text: Column) -> Column:
    """Not defined for this script yet: the text itself."""
    return text
