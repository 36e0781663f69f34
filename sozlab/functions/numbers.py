"""Numbers and Azerbaijani number words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casing import az_lower

#: Number words.
ONES = ["sıfır", "bir", "iki", "üç", "dörd", "beş", "altı", "yeddi", "səkkiz", "doqquz"]
TENS = ["", "on", "iyirmi", "otuz", "qırx", "əlli", "altmış", "yetmiş", "səksən", "doxsan"]
MAGNITUDES = ["", "min", "milyon", "milyard", "trilyon", "kvadrilyon", "kvintilyon"]
HUNDRED, NEGATIVE, WHOLE, COMMA = "yüz", "mənfi", "tam", "vergül"
DENOMINATORS = ["", "onda", "yüzdə", "mində"]
MOST = 10**18


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(_words(values), (index + 1).cast("int"))


def _group(g: Column) -> Column:
    """Words of 1 to 999; the hundred alone has no one before it."""
    hundreds, tens, ones = F.floor(g / 100), F.floor(g % 100 / 10), g % 10
    return F.concat_ws(
        " ",
        F.when(hundreds > 1, _at(ONES, hundreds)),
        F.when(hundreds > 0, F.lit(HUNDRED)),
        F.when(tens > 0, _at(TENS, tens)),
        F.when(ones > 0, _at(ONES, ones)),
    )


def to_words(n: Column) -> Column:
    """Cardinal words of a whole number (best of a plain column); beyond 10^18 an empty string."""
    n = n.cast("long")
    inside = (n <= MOST) & (n >= -MOST)
    parts = []
    for power in range(len(MAGNITUDES) - 1, -1, -1):
        g = F.abs(F.call_function("div", F.when(inside, n), F.lit(1000**power))) % 1000
        said, unit = _group(g), F.lit(MAGNITUDES[power])
        if power == 1:
            said = F.when(g == 1, unit).otherwise(F.concat_ws(" ", said, unit))
        elif power:
            said = F.concat_ws(" ", said, unit)
        parts.append(F.when(g > 0, said))
    words = F.when(n == 0, F.lit(ONES[0])).otherwise(F.concat_ws(" ", F.when(n < 0, F.lit(NEGATIVE)), *parts))
    return F.when(n.isNotNull(), F.when(inside, words).otherwise(F.lit("")))


def _last_vowel(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)^.*([aıoueəiöü])", 1)


def ordinal_of(cardinal: Column) -> Column:
    """The ordinal of cardinal words: the suffix that their last vowel asks for."""
    narrow = F.translate(_last_vowel(cardinal), "aıoueəiöü", "ııuuiiiüü")
    bare = F.concat(F.lit("nc"), narrow)
    suffix = F.when(cardinal.rlike("[aıoueəiöü]$"), bare).otherwise(F.concat(narrow, bare))
    return F.when(cardinal == "", F.lit("")).otherwise(F.concat(cardinal, suffix))


def _denominator(digits: Column) -> Column:
    """A power of ten as a denominator, with the locative ending that its last vowel asks for."""
    names = DENOMINATORS[1:] + ["on mində", "yüz mində"]
    names += [f"{n}{unit}" for unit in ("milyonda", "milyardda", "trilyonda", "kvadrilyonda") for n in ("bir ", "on ", "yüz ")]
    names.append("bir kvintilyonda")
    return F.get(_words(names), digits - 1)


def with_decimal_words(frame: DataFrame, column: str, name: str, mode: str = "math") -> DataFrame:
    """The table with the words of a decimal written as text, with ``.`` or ``,``; invalid text gives an empty string.

    ``math`` reads the digits after the separator as a fraction, ``digit`` one by one.
    """
    kept = [F.col(c) for c in frame.columns if c != name]
    text = F.regexp_replace(F.col(column), r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")
    body = F.regexp_replace(text, "^[+-]", "")
    parts = F.struct(
        text.startswith("-").alias("negative"),
        body.rlike("[.,]").alias("pointed"),
        F.regexp_extract(body, "(?s)^([^.,]*)", 1).alias("whole"),
        F.regexp_extract(body, "(?s)^[^.,]*[.,](.*)$", 1).alias("frac"),
    )
    cut = frame.select(*kept, parts.alias("_d"))
    whole, frac = F.col("_d.whole"), F.col("_d.frac")
    first = F.when(F.col("_d.pointed") & (whole == ""), F.lit(0).cast("long")).otherwise(
        F.when(whole.rlike("^[+-]?[0-9]+$"), whole.try_cast("long"))
    )
    valued = cut.select(
        *kept, "_d", first.alias("_w"), F.when(frac.rlike("^[0-9]+$"), frac.try_cast("long")).alias("_f")
    )
    said = valued.select(*kept, "_d", "_w", to_words(F.col("_w")).alias("_ws"), to_words(F.col("_f")).alias("_fs"))
    nought = (F.col("_w") == 0) & frac.rlike("^0*$")
    sign = F.when(F.col("_d.negative") & ~nought, F.lit(NEGATIVE))
    valid = whole.rlike("^[0-9]*$") & frac.rlike("^[0-9]+$") & (F.col("_ws") != "")
    if mode == "math":
        tail = F.concat_ws(" ", F.lit(WHOLE), _denominator(F.length(frac)), F.col("_fs"))
        valid = valid & (F.length(frac) <= 18) & (F.col("_fs") != "")
    else:
        digits = F.transform(F.split(frac, ""), lambda d: _at(ONES, F.coalesce(d.try_cast("int"), F.lit(0))))
        tail = F.concat_ws(" ", F.lit(COMMA), F.array_join(digits, " "))
    spoken = F.when(valid, F.concat_ws(" ", sign, F.col("_ws"), tail)).otherwise(F.lit(""))
    plain = F.when(F.col("_w") == 0, F.lit(ONES[0])).otherwise(F.concat_ws(" ", sign, F.col("_ws")))
    flipped = F.when(F.col("_d.negative") & F.col("_ws").startswith(NEGATIVE), F.expr(f"substring(_ws, {len(NEGATIVE) + 2})"))
    plain = F.when(F.coalesce(F.col("_ws"), F.lit("")) == "", F.lit("")).otherwise(F.coalesce(flipped, plain))
    words = F.when(F.col("_d.pointed"), F.coalesce(spoken, F.lit(""))).otherwise(plain)
    return said.select(*kept, F.when(F.col(column).isNotNull(), words).alias(name))


def _values() -> dict[str, int]:
    small = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS) if w}
    return small | {HUNDRED: 100} | {w: 1000**i for i, w in enumerate(MAGNITUDES) if w}


def parse_words(text: Column) -> Column:
    """The number that cardinal words name, null where they name none (or one beyond 10^18)."""
    values = _values()
    table = F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for kv in values.items() for x in kv])
    tokens = F.filter(F.split(az_lower(text), r"[\s\p{Z}\x{85}]+"), lambda t: t != "")
    negative = F.get(tokens, F.lit(0)) == NEGATIVE
    rest = F.when(negative, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("group"))

    def step(state: Column, token: Column) -> Column:
        value = F.try_element_at(table, token)
        group = F.greatest(state["group"], one)
        grown = F.when(value >= 1000, zero).when(value == 100, F.try_multiply(group, value)).when(value > 0, state["group"] + value)
        total = F.when(value < 1000, state["total"]).otherwise(F.try_add(state["total"], F.try_multiply(group, value)))
        return F.struct(F.when((total <= MOST) & grown.isNotNull(), total).alias("total"), grown.alias("group"))

    found = F.aggregate(rest, start, step, lambda s: F.when(s["total"].isNotNull(), F.try_add(s["total"], s["group"])))
    size = F.when((F.size(rest) == 1) & (F.get(rest, F.lit(0)) == ONES[0]), zero).when(F.size(rest) > 0, found)
    return F.when(size <= MOST, F.when(negative, -size).otherwise(size))
