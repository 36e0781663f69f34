"""What tokens, chunks, analyses, entities, moments, sentiments and names of kinds look like as text and in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of each kind of thing.
NAMES = {
    "token": ["Word", "Number", "Punctuation", "Space", "Symbol", "URL", "Email", "Sentence"],
    "entity": ["FIN", "VOEN", "Phone", "Email", "IBAN", "LicensePlate", "URL"],
    "moment": ["Date", "Time", "DateTime", "Duration"],
    "sentiment": ["Negative", "Neutral", "Positive"],
    "issue": ["spelling", "punctuation", "layout", "mixed_script"],
    "severity": ["info", "warning", "error"],
}
#: Numbers begin at 0 but for these.
FIRST = {"sentiment": -1}
#: Letters of the parts of a moment that a text names, from the lowest bit up.
PARTS = "YMDhms"
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")]


def quoted(text: Column) -> Column:
    """A text in double quotes, quotes, backslashes and line ends escaped."""
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _spanned(item: Column, more: Column | None = None) -> Column:
    """type("text")[start:end] of a struct with these fields."""
    return F.format_string("%s(%s)[%d:%d%s]", item["type"], quoted(item["text"]), item["start"], item["end"], F.lit("") if more is None else more)


def token(item: Column) -> Column:
    return _spanned(item)


def moment(item: Column) -> Column:
    return _spanned(item)


def entity(item: Column) -> Column:
    return _spanned(item, F.when(item["labeled"], ",labeled").otherwise(""))


def chunk(item: Column) -> Column:
    return F.format_string("Chunk(%d)[%d:%d](%d bytes)", item["index"], item["start"], item["end"], F.octet_length(item["text"]))


def suffixes(analysis: Column) -> Column:
    """The suffixes of an analysis as they stand in the word."""
    return F.array_join(F.transform(analysis["morphemes"], lambda m: m["surface"]), "")


def analysis(item: Column) -> Column:
    """stem[Tag:surface|...], or the stem alone."""
    shown = F.array_join(F.transform(item["morphemes"], lambda m: F.concat(m["tag"], F.lit(":"), m["surface"])), "|")
    return F.when(F.size(item["morphemes"]) > 0, F.concat(item["stem"], F.lit("["), shown, F.lit("]"))).otherwise(item["stem"])


def sentiment(label: Column, score: Column, positive: Column, negative: Column, total: Column) -> Column:
    return F.format_string("%s(score=%.2f, pos=%d, neg=%d, total=%d)", label, score.cast("double"), positive, negative, total)


def parts(mask: Column) -> Column:
    """The letters of the bits of a mask, or none."""
    letters = F.concat(*[F.when(mask.bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate(PARTS)])
    return F.when(letters == "", "none").otherwise(letters)


def named(kind: str, number: Column) -> Column:
    """The name with a number of a kind of NAMES; null if there is none."""
    return F.get(F.array(*map(F.lit, NAMES[kind])), number - FIRST.get(kind, 0))


def from_name(kind: str, name: Column) -> Column:
    """The number of a name of a kind; null for an unknown name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, NAMES[kind])), name), F.lit(0)) - 1 + FIRST.get(kind, 0)


def json(item: Column) -> Column:
    """A struct or an array of structs as JSON; fields that are null are left out."""
    return F.to_json(item)
