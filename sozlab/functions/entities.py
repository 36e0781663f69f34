"""Rule-based entities with byte offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import blocks, let, running_starts

MOST_BYTES, MOST_ENTITIES, MOST_EMAIL = 1 << 20, 10_000, 254
B, A = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
S = "[\\t\\n\\f\\r ]"
#: What an entity of each type looks like.
PATTERNS = {
    "URL": r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+",
    "Email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "IBAN": rf"{B}AZ[0-9]{{2}}[A-Z]{{4}}[A-Z0-9]{{20}}{A}",
    "LicensePlate": rf"{B}[0-9]{{2}}-[A-Z]{{2}}-[0-9]{{3}}{A}",
    "Phone+": rf"\+994{S}?[0-9]{{2}}{S}?[0-9]{{3}}{S}?[0-9]{{2}}{S}?[0-9]{{2}}",
    "Phone0": rf"{B}0[0-9]{{2}}{S}?[0-9]{{3}}{S}?[0-9]{{2}}{S}?[0-9]{{2}}{A}",
    "FIN:": rf"{B}[Ff][Ii][Nn][:\t\n\f\r ]{S}?[A-HJ-NP-Za-hj-np-z0-9]{{7}}{A}",
    "FIN": rf"{B}[A-HJ-NP-Z0-9]{{7}}{A}",
    "VOEN:": rf"{B}[Vv][ÖöOo][Ee][Nn][:\t\n\f\r ]{S}?[0-9]{{10}}{A}",
}
ENTITY = "array<struct<text:string,start:int,end:int,type:string,labeled:boolean>>"


def _found(text: Column, name: str) -> Column:
    """Matches of a pattern as entities; offsets come from the pieces between matches."""
    kind, labelled = name.rstrip("+0:"), name.endswith(":")
    pattern = f"(?s){PATTERNS[name]}"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.octet_length(gap).alias("gap"), m.alias("match")))
    pairs = F.filter(gaps, lambda p: p["match"].isNotNull())

    def entity(pair: Column, start: Column) -> Column:
        match, begin = pair["match"], start + pair["gap"]
        value, skipped = match, F.lit(0)
        if labelled:
            value = match.substr(-F.lit(7 if kind == "FIN" else 10), F.lit(10))
            skipped = F.octet_length(match) - F.octet_length(value)
        elif kind == "URL":
            value = F.regexp_replace(match, r"[.,;:!?)\]}>]+$", "")
        return F.struct(
            value.alias("text"),
            (begin + skipped).alias("start"),
            (begin + skipped + F.octet_length(value)).alias("end"),
            F.lit(kind).alias("type"),
            F.lit(labelled).alias("labeled"),
        )

    whole = lambda p: p["gap"] + F.octet_length(p["match"])
    return let(pairs, lambda held: F.zip_with(held, running_starts(F.transform(held, whole)), entity))


def recognize(text: Column) -> Column:
    """All entities by start, overlaps resolved: the earliest stays, of equal starts the longest, then the labelled."""
    emails = F.filter(_found(text, "Email"), lambda e: F.octet_length(e["text"]) <= MOST_EMAIL)
    mixed = F.filter(_found(text, "FIN"), lambda e: e["text"].rlike("[A-Z]") & e["text"].rlike("[0-9]"))
    fins = let(_found(text, "FIN:"), lambda held: F.concat(held, let(F.transform(held, lambda f: f["start"]), lambda at: F.filter(mixed, lambda e: ~F.array_contains(at, e["start"])))))
    urls = F.filter(_found(text, "URL"), lambda e: e["text"] != "")
    everything = F.concat(
        urls, emails, _found(text, "IBAN"), _found(text, "LicensePlate"), _found(text, "Phone+"), _found(text, "Phone0"),
        fins, _found(text, "VOEN:"),
    )
    keyed = F.transform(
        everything,
        lambda e, i: F.struct(e["start"].alias("s"), (e["start"] - e["end"]).alias("l"), (~e["labeled"]).alias("u"), i.alias("i"), e.alias("e")),
    )
    begin = lambda fence, kind: F.struct(fence.alias("fence"), F.array().cast(kind).alias("out"))

    def step(state: Column, k: Column) -> Column:
        e = k["e"]
        return F.when(
            e["start"] >= state["fence"], F.struct(e["end"].alias("fence"), F.concat(state["out"], F.array(e)).alias("out"))
        ).otherwise(state)

    def block(state: Column, rows: Column) -> Column:
        done = F.aggregate(rows, begin(state["fence"], ENTITY), step)
        return let(done, lambda d: F.struct(d["fence"].alias("fence"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    kept = F.flatten(F.aggregate(blocks(F.array_sort(keyed)), begin(F.lit(0), f"array<{ENTITY}>"), block)["out"])
    likely = text.rlike(r"[0-9@]|https?://")
    empty = F.array().cast(ENTITY)
    return F.when((text != "") & (F.octet_length(text) <= MOST_BYTES), F.when(likely, F.slice(kept, 1, MOST_ENTITIES)).otherwise(empty))


def of_type(found: Column, kind: str) -> Column:
    """Texts of those of one type among recognised entities; recognise once where several types are asked for."""
    return F.transform(F.filter(found, lambda e: e["type"] == kind), lambda e: e["text"])


def texts_of(text: Column, kind: str) -> Column:
    """Texts of the entities of one type."""
    return of_type(recognize(text), kind)
