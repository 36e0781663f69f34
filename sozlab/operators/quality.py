"""Text quality: spacing, punctuation, layout and spelling issues, and a score."""

from __future__ import annotations

import itertools

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect, tokens
from ..functions.casing import is_title_case
from . import texts
from .rows import map_rows

MOST_BYTES, MOST_ISSUES, SURE = 1 << 20, 1000, 0.5
#: Letters of the two scripts that look alike.
LATIN_TWINS, CYRILLIC_TWINS = "aeopcxyAEOPCXYiIjJ", "аеорсхуАЕОРСХУіІјЈ"
ISSUES = "array<struct<text:string,start:int,end:int,type:string,severity:string,message:string,suggestion:string>>"
POINTS = {"error": 10, "warning": 3, "info": 1}
#: What the issues say.
UNKNOWN, SPACES, BEFORE, MISSING, REPEATED = (
    "unknown word", "multiple spaces", "space before punctuation", "missing space after punctuation", "repeated punctuation",
)
TWIN, FOREIGN = "contains characters from wrong script (possible keyboard layout error)", "text in different script"
TOUCHES, ENDS, ELLIPSIS = frozenset(",.;:!?"), frozenset(".!?"), "..."
SCRIPTS = {
    "Latn": (str.maketrans(CYRILLIC_TWINS, LATIN_TWINS), regex.compile(r"\p{Cyrillic}")),
    "Cyrl": (str.maketrans(LATIN_TWINS, CYRILLIC_TWINS), regex.compile(r"\p{Latin}")),
}
PUNCTUATION = regex.compile(r"\p{P}")


def _kind(token: str) -> str:
    """The class of a token by how it begins; addresses are neither words nor punctuation."""
    first = token[0]
    if first.isspace():
        return "space"
    if first.isalpha():
        return "other" if "@" in token or "://" in token else "word"
    if first in "0123456789":
        return "other" if "@" in token else "number"
    return "mark" if PUNCTUATION.match(first) and "@" not in token else "other"


def _spacing(tokens: list[str], kinds: list[str]):
    """(first, last, severity, message, suggestion) of spacing and repetition: at most one at a token."""
    run = 0
    for i, (token, kind) in enumerate(zip(tokens, kinds)):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        starts = i == 0 or tokens[i - 1] != token
        if kind == "space":
            if token.count(" ") > 1:
                yield i, i, "warning", SPACES, " "
            elif after in TOUCHES:
                yield i, i, "warning", BEFORE, ""
        elif kind == "mark":
            if token in ENDS and after and kinds[i + 1] in ("word", "number"):
                yield i, i, "warning", MISSING, token + " "
            elif starts and after == token:
                run = i + 1
                while run + 1 < len(tokens) and tokens[run + 1] == token:
                    run += 1
                if token * (run - i + 1) != ELLIPSIS:
                    yield i, run, "info", REPEATED, token


def _scripts(tokens: list[str], kinds: list[str], script: str):
    """(place, kind, severity, message, suggestion) of twins of the other script's letters, then of whole foreign words."""
    proper, foreign = SCRIPTS[script]
    words = [(i, t) for i, (t, k) in enumerate(zip(tokens, kinds)) if k == "word"]
    for i, token in words:
        if any(ord(c) in proper for c in token):
            yield i, "layout", "error", TWIN, token.translate(proper)
    for i, token in words:
        letters = [c for c in token if c.isalpha()]
        if all(map(foreign.match, letters)) and not all(ord(c) in proper for c in letters):
            yield i, "mixed_script", "info", FOREIGN, ""


def issues(tokens: list[str] | None, script: str | None, confidence: float | None, misspelt: list[dict] | None = None) -> tuple[int, list]:
    """(score, issues) of a text by its tokens, which tile it; an empty text has none.  ``misspelt``: word and suggestion."""
    if not tokens:
        return 100, []
    kinds = [_kind(t) for t in tokens]
    wrong = {m["word"]: m["suggestion"] or "" for m in misspelt or ()} if script != "Cyrl" else {}
    found = [
        (i, i, "spelling", "error", UNKNOWN, wrong[t])
        for i, t in enumerate(tokens) if t in wrong and kinds[i] == "word" and not any(map(str.isdigit, t))
    ]
    found += [(i, j, "punctuation", *rest) for i, j, *rest in _spacing(tokens, kinds)]
    if script in SCRIPTS and (confidence or 0) >= SURE:
        found += [(i, i, *rest) for i, *rest in _scripts(tokens, kinds, script)]
    kept = sorted(found[:MOST_ISSUES], key=lambda x: (x[0], -POINTS[x[3]]))
    edges = [0, *itertools.accumulate(len(t.encode("utf-8")) for t in tokens)]
    names = ("text", "start", "end", "type", "severity", "message", "suggestion")
    shown = [dict(zip(names, ("".join(tokens[i : j + 1]), edges[i], edges[j + 1], *rest))) for i, j, *rest in kept]
    return max(0, 100 - sum(POINTS[x[3]] for x in kept)), shown


def misspelt_words(frame: DataFrame, key: str, column: str, dictionary: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Unknown words of each text with their best correction: key, misspelt.  Words in title case may be names."""
    rows = frame.select(key, F.explode(F.array_distinct(tokens.words(F.col(column)))).alias("word")).where(~is_title_case(F.col("word")))
    wrong = texts.check_words(rows, dictionary, frequencies).where("not correct").select("word")
    best = texts.suggest_words(rows, dictionary, frequencies).where("rank = 1").select("word", F.col("term").alias("suggestion"))
    found = rows.join(wrong.join(best, "word", "left"), "word")
    return found.groupBy(key).agg(F.collect_list(F.struct("word", "suggestion")).alias("_misspelt"))


def validate(frame: DataFrame, column: str, key: str | None = None, dictionary: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """The table with the score (0 to 100) and the issues of a text.

    With a ``dictionary`` (lemma) and ``frequencies`` (word, freq) unknown words are issues too; ``key`` tells rows apart.
    """
    judged = detect.with_languages(frame, column, "_languages")
    best = detect.best(F.col("_languages"))
    text = F.col(column)
    ready = judged.withColumns({
        "_script": best["script"], "_sure": best["confidence"],
        "_tokens": F.when(F.octet_length(text) <= MOST_BYTES, tokens.token_texts(text)),
    })
    read = ["_tokens", "_script", "_sure"]
    if dictionary is not None and frequencies is not None and key:
        ready = ready.join(misspelt_words(frame, key, column, dictionary, frequencies), key, "left")
        read.append("_misspelt")
    return map_rows(ready, read, f"score int, issues {ISSUES}", issues).drop("_languages", *read)


def is_valid(issues_column):
    """No issue of the severity error."""
    return ~F.exists(issues_column, lambda i: i["severity"] == "error")
