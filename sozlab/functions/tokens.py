"""Typed tokens, sentences and size chunks with byte offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{85}\p{Z}]"
LOCAL = "[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*"
DOMAIN = r"(?:[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?![A-Za-z0-9-]|\.+[A-Za-z0-9-]))"
#: The alternatives in the order in which they are tried; together they tile any text.
URL = rf"(?i:https?://)(?:(?!{WS}).)+?(?=[.,!?]?(?:{WS}|$))"
EMAIL = f"{LOCAL}@{DOMAIN}"
SPACE = f"{WS}+"
NUMBER = r"[0-9]+(?:\.[0-9]{3}(?![0-9]))*(?:,[0-9]+)?"
WORD = r"\p{L}[\p{L}\p{Nd}]*(?:-[\p{L}\p{Nd}]+|(?<=\p{L})['’ʼ]\p{L}+)*"
TOKEN = rf"(?s){URL}|{EMAIL}|{SPACE}|{NUMBER}|{WORD}|-+|\p{{P}}|."
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ["prof", "dos", "ak", "dr", "az", "ar", "vb", "km", "kq", "sm", "min"]
SENTENCE_BREAK = (
    rf"(?<=[.?!…])(?<!(?<!\p{{L}})(?iu:{'|'.join(ABBREVIATIONS)})\.)(?<!(?<!\p{{L}})(?iu:və\s{{1,3}}s)\.)(?={WS}+\p{{Lu}})"
    r"|(?<=\n\n)(?!\n)"
)


#: Running sums are taken in blocks of so many numbers, as each step of a fold copies what it has gathered.
BLOCK = 256


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array as an array of arrays of BLOCK items each; an empty one as one empty array."""

    def cut(held: Column) -> Column:
        last = F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)))

    return let(items, cut)


def running_starts(sizes: Column) -> Column:
    """For each of an array of sizes the sum of those before it."""

    def folded(items: Column, size) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def joined(sums: Column) -> Column:
        return F.flatten(F.zip_with(sums, folded(sums, lambda b: b["at"])["out"], lambda b, base: F.transform(b["out"], lambda x: x + base)))

    return let(F.transform(blocks(sizes), lambda b: folded(b, lambda x: x)), joined)


def with_offsets(pieces: Column, fields=None) -> Column:
    """Pieces that tile a text as structs with half-open byte offsets; ``fields`` adds columns of a piece."""
    extra = fields or (lambda p: [])

    def piece(p: Column, at: Column) -> Column:
        return F.struct(p.alias("text"), at.alias("start"), (at + F.octet_length(p)).alias("end"), *extra(p))

    return F.when(pieces.isNotNull(), let(pieces, lambda held: F.zip_with(held, running_starts(F.transform(held, F.octet_length)), piece)))


def token_texts(text: Column) -> Column:
    """The tokens' texts, which tile the text; null for an empty one."""
    return F.when(text != "", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_type(piece: Column) -> Column:
    return (
        F.when(piece.rlike(r"(?s)^(?i:https?://)."), F.lit("URL"))
        .when(piece.rlike(f"^{LOCAL}@"), F.lit("Email"))
        .when(piece.rlike(f"^{WS}"), F.lit("Space"))
        .when(piece.rlike("^[0-9]"), F.lit("Number"))
        .when(piece.rlike(r"^\p{L}"), F.lit("Word"))
        .when(piece.rlike(r"^\p{P}"), F.lit("Punctuation"))
        .otherwise(F.lit("Symbol"))
    )


def word_tokens(text: Column) -> Column:
    """All tokens with byte offsets and types."""
    return with_offsets(token_texts(text), lambda p: [token_type(p).alias("type")])


def words(text: Column) -> Column:
    """Texts of the word tokens."""
    return F.filter(token_texts(text), lambda p: token_type(p) == "Word")


def sentences(text: Column) -> Column:
    """Sentences that tile the text; white space before a sentence belongs to it."""
    return F.when(text != "", F.split(text, SENTENCE_BREAK))


def sentence_tokens(text: Column) -> Column:
    return with_offsets(sentences(text))


def chunks_by_size(text: Column, size: int, overlap: int, short: int = 10) -> Column:
    """Windows of ``size`` characters, ``overlap`` shared; a short rest joins the window before it."""
    if size <= 0:
        return F.lit(None).cast("array<struct<text:string,start:int,end:int,index:int>>")
    step = size - max(0, min(overlap, size - 1))
    n = F.length(text)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    lengths = F.transform(starts, lambda s: F.least(F.lit(size), n - s))
    tail = F.get(F.filter(F.transform(lengths, lambda x, i: F.when((x < short) & (x < size) & (i > 0), i)), lambda i: i.isNotNull()), F.lit(0))
    kept = F.coalesce(tail, F.size(starts))
    cut = F.transform(
        F.slice(starts, F.lit(1), kept),
        lambda s, i: F.struct(
            s.alias("at"), F.when(tail.isNotNull() & (i == kept - 1), n - s).otherwise(F.least(F.lit(size), n - s)).alias("len"), i.alias("index")
        ),
    )
    made = F.transform(
        cut,
        lambda c: F.struct(
            text.substr(c["at"] + 1, c["len"]).alias("text"),
            F.octet_length(text.substr(F.lit(1), c["at"])).alias("start"),
            F.octet_length(text.substr(F.lit(1), c["at"] + c["len"])).alias("end"),
            c["index"].cast("int").alias("index"),
        ),
    )
    return F.when((text != "") & F.is_valid_utf8(text), F.slice(made, 1, 10000))
