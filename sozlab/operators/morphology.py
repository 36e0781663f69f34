"""Suffix analysis and stems of Azerbaijani words.

Words are analysed once each.  Which candidate stems are dictionary words is a semi join, so the dictionary may be of
any size; a second pass over the distinct words ranks and chooses.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import explode_rows, map_rows

#: The suffixes of each slot with their tags.  A is a or ə, I one of ı i u ü, D d or t, K q or k, each in
#: harmony with the vowel before; a sound in brackets stands after a vowel only.
NOUN_SUFFIXES = {
    "derived": [
        ("DerivAgent", ["çI"]),
        ("DerivAbstract", ["lIK"]),
        ("DerivPriv", ["sIz"]),
        ("DerivPoss", ["lI"]),
    ],
    "plural": [("Plural", ["lAr"])],
    "possessed": [
        ("Poss1Sg", ["Im", "m"]),
        ("Poss2Sg", ["In", "n"]),
        ("Poss3Sg", ["sI", "I"]),
        ("Poss1Pl", ["ImIz", "mIz"]),
        ("Poss2Pl", ["InIz", "nIz"]),
        ("Poss3Pl", ["lArI"]),
    ],
    "cased": [
        ("CaseGen", ["nIn", "In"]),
        ("CaseDat", ["yA", "nA", "A"]),
        ("CaseAcc", ["nI", "I"]),
        ("CaseLoc", ["ndA", "DA"]),
        ("CaseAbl", ["ndAn", "DAn"]),
        ("CaseIns", ["lA"]),
    ],
}
VERB_SUFFIXES = {
    "voiced": [
        ("VoicePass", ["Il"]),
        ("VoiceReflex", ["In"]),
        ("VoiceRecip", ["Iş"]),
        ("VoiceCaus", ["t"]),
        ("VoiceCaus", ["Ir"]),
    ],
    "negated": [("Negation", ["mA"])],
    "tensed": [
        ("TensePastDef", ["DI"]),
        ("TensePastIndef", ["mIş"]),
        ("TensePastEvi", ["Ib"]),
        ("TensePresent", ["Ir"]),
        ("TenseFuture", ["AcAK"]),
        ("TenseAorist", ["Ar"]),
        ("MoodOblig", ["mAlI"]),
        ("MoodCond", ["sA"]),
        ("Participle", ["An"]),
        ("Gerund", ["ArAK"]),
        ("Gerund", ["mAdAn"]),
        ("Gerund", ["IncA"]),
        ("Gerund", ["DIKcA"]),
    ],
    "personal": [
        ("Pers1Sg", ["Am", "m"]),
        ("Pers2Sg", ["sAn", "n"]),
        ("Pers1Pl", ["IK", "K"]),
        ("Pers2Pl", ["sInIz", "nIz"]),
        ("Pers3", ["lAr"]),
    ],
}
VERBALISER, COPULA, QUESTION = ("DerivVerb", ["lAş"]), ("Copula", ["DIr"]), ("Question", ["mI"])
#: Sounds.
VOWELS, BACK, VOICELESS = "aıoueəiöü", "aıou", "pçtkqfsşxh"
FOUR_WAY = str.maketrans(VOWELS, "ııuuiiiüü")
START = "start"
MOST_BYTES, MOST_DEPTH, MOST_ANALYSES = 256, 10, 128
#: Tags that reach far into verbs, and tags that make no new word.
DEEP = {"Negation", "MoodOblig", "MoodCond"}
UNPRODUCTIVE = {
    "CaseGen", "CaseDat", "CaseAcc", "CaseLoc", "CaseAbl", "CaseIns", "Poss1Sg", "Poss2Sg", "Poss3Sg", "Poss1Pl",
    "Poss2Pl", "Poss3Pl", "Negation", "VoicePass", "VoiceReflex", "VoiceRecip", "VoiceCaus", "MoodCond",
}
ANALYSES = "array<struct<stem:string,morphemes:array<struct<surface:string,tag:string>>>>"


def lower(text: str) -> str:
    return "".join({"I": "ı", "İ": "i"}.get(c) or (c.lower() if len(c.lower()) == 1 else c) for c in text)


def _vowel(text: str, last: bool) -> str:
    return next((c for c in (reversed(text) if last else text) if c in VOWELS), "")


def _harmony(pattern: str) -> int:
    return next(({"A": 2, "I": 4}[c] for c in pattern if c in "AI"), 0)


def _surfaces(pattern: str) -> list[str]:
    """The forms of a suffix in vowel harmony: its first vowel has two kinds (A) or four (I), the others follow it."""
    out = []
    for vowel in "ıiuü" if _harmony(pattern) == 4 else "aə":
        back = vowel in BACK
        sounds = {"A": "a" if back else "ə", "I": {"a": "ı", "ə": "i"}.get(vowel, vowel), "K": "q" if back else "k"}
        form = "".join(sounds.get(c, c) for c in pattern)
        out += [form.replace("D", d) for d in "dt"] if "D" in form else [form]
    return list(dict.fromkeys(out))


@lru_cache(maxsize=1)
def rules_by_state() -> dict[str, list[tuple]]:
    """For each state the suffixes that lead to it: (tag, surface, states before, harmony, needs a voiceless sound).

    Nouns and verbs each fill their slots in order, any of which may stay empty; derivation may repeat, persons follow a
    tense, the past also another tense, the copula any noun or a tense, and the question what ends a word.
    """
    table: dict[str, list[tuple]] = {}

    def add(state: str, suffix: tuple[str, list[str]], before: list[str]) -> None:
        tag, patterns = suffix
        harmony = max(map(_harmony, patterns))
        for pattern in patterns:
            for surface in _surfaces(pattern):
                hard = surface[0] == "t" and pattern[0] == "D" and tag != "Copula"
                table.setdefault(state, []).append((tag, surface, before, harmony, hard))

    nouns, verbs = [START, *NOUN_SUFFIXES], [START, *VERB_SUFFIXES]
    for slots, suffixes in ((nouns, NOUN_SUFFIXES), (verbs, VERB_SUFFIXES)):
        for state, listed in suffixes.items():
            before = ["tensed"] if state == "personal" else slots[: slots.index(state) + (state == "derived")]
            for suffix in listed:
                add(state, suffix, [*before, "tensed"] if suffix[0] == "TensePastDef" else before)
    add("voiced", VERBALISER, [START, "derived"])
    add("copular", COPULA, [*nouns, "tensed"])
    add("asked", QUESTION, [START, "personal", "copular", "tensed"])
    return table


def _fits(stem: str, surface: str, harmony: int) -> bool:
    a, b = _vowel(stem, last=True), _vowel(surface, last=False)
    if not a or not b or not harmony:
        return True
    return (a in BACK) == (b in BACK) if harmony == 2 else a.translate(FOUR_WAY) == b


def _valid(stem: str) -> bool:
    return len(stem) >= 2 and any(c in VOWELS for c in stem)


@lru_cache(maxsize=1 << 16)
def parses(word: str) -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """All ways to strip suffixes from a word, right to left, each as stem and (surface, tag) pairs.

    Works through a list of open states: what is left (lowered and as written), the state to reach, what was stripped.
    """
    table = rules_by_state()
    low = lower(word)
    found: dict[tuple, tuple] = {}
    open_states = [(low, word, state, (), 0) for state in sorted(table)]
    while open_states and len(found) < MOST_ANALYSES:
        rest, written, state, stripped, depth = open_states.pop()
        if state == START:
            if _valid(rest):
                found.setdefault((written, tuple(t for _, t in stripped)), (written, stripped))
            continue
        if depth >= MOST_DEPTH:
            continue
        for tag, surface, before, harmony, voiceless in table.get(state, ()):
            if not rest.endswith(surface):
                continue
            stem, shown = rest[: -len(surface)], written[: -len(surface)]
            if not stem or not _fits(stem, surface, harmony) or (voiceless and stem[-1] not in VOICELESS):
                continue
            taken = ((written[len(shown) :], tag), *stripped)
            restored = {"y": "k", "ğ": "q"}.get(stem[-1]) if surface[0] in VOWELS else None
            for earlier in before:
                open_states.append((stem, shown, earlier, taken, depth + 1))
                if restored:
                    open_states.append((stem[:-1] + restored, shown[:-1] + restored, earlier, taken, depth + 1))
    return tuple(found.values())


def ranked(word: str, known: frozenset[str]) -> list[tuple]:
    """Analyses, the likeliest first: known stems, of these the longest, of others the shortest, then the simplest."""

    def key(parse: tuple) -> tuple:
        stem, parts = parse
        is_known = lower(stem) in known
        return (not is_known, -len(stem) if is_known else len(stem), len(parts), "|".join(t for _, t in parts), stem, parts)

    return sorted(parses(word), key=key)


def vowel_restored(stem: str) -> list[str]:
    """What a stem was before it lost a vowel between its last two consonants: one candidate per vowel."""
    for i in range(len(stem) - 1, 0, -1):
        if stem[i] not in VOWELS and stem[i - 1] not in VOWELS:
            return [stem[:i] + v + stem[i:] for v in VOWELS] if len(stem) >= 3 and _vowel(stem[:i], last=True) else []
    return []


def _restored(stem: str, known: frozenset[str]) -> str | None:
    options = [c for c in vowel_restored(stem) if c in known]
    if len(options) < 2:
        return options[0] if options else None
    at = next(i for i, (a, b) in enumerate(zip(options[0], options[1])) if a != b)
    target = _vowel(stem[:at], last=True).translate(FOUR_WAY)
    return next((o for o in options if o[at] == target), None)


def candidates(word: str) -> set[str]:
    """Every string whose being a dictionary word bears on the analysis of a word."""
    out = set()
    for part in word.split("-") if "-" in word[1:-1] else [word]:
        stems = {lower(stem) for stem, _ in parses(part)} if part and len(part.encode()) <= MOST_BYTES else set()
        out |= stems | {lower(part)} | {c for s in stems for c in vowel_restored(s)}
    return out


def chosen_stem(word: str, known: frozenset[str]) -> str:
    """The stem of a word: hyphenated parts each, before an apostrophe as it stands, else by rank and dictionary."""
    if not word or len(word.encode()) > MOST_BYTES:
        return word
    if "-" in word[1:-1] and not word.startswith("-"):
        return "-".join(chosen_stem(p, known) for p in word.split("-"))
    for i, c in enumerate(word):
        if c in "'’ʼ":
            return word[:i] if i else word
    order = ranked(word, known)
    if lower(word) in known:
        for stem, parts in order:
            if parts and lower(stem) != lower(word) and lower(stem) in known and len(parts[0][0]) >= 2 and parts[0][1] not in UNPRODUCTIVE:
                return stem
        return word
    deep = [s for s, p in order if p and p[0][1] in DEEP and lower(s) in known]
    if deep:
        return min(deep, key=len)
    for stem, parts in order:
        if parts and lower(stem) in known:
            return stem
    for stem, parts in order:
        if parts and (back := _restored(lower(stem), known)):
            return back[0].upper().replace("I", "İ" if back[0] == "i" else "I") + back[1:] if stem[0] != lower(stem[0]) else back
    return next((stem for stem, parts in order if parts), word)


def _analysed(word: str, known: list[str] | None) -> tuple[str, list, bool]:
    held = frozenset(known or ())
    order = ranked(word, held) if len(word.encode()) <= MOST_BYTES else []
    shown = [{"stem": s, "morphemes": [{"surface": a, "tag": t} for a, t in p]} for s, p in order]
    shown.append({"stem": word, "morphemes": []})
    valid = any(p and lower(s) in held for s, p in order)
    return chosen_stem(word, held), shown, valid


def analyse_words(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words with stem, analyses and whether some analysis has suffixes on a known stem.

    Null words are left out; ``dictionary`` holds the column lemma.
    """
    distinct = words.select(F.col(column).alias("word")).where("word is not null and word != ''").distinct()
    asked = explode_rows(distinct, ["word"], "word string, lemma string", lambda w: [(w, c) for c in sorted(candidates(w))])
    known = asked.join(dictionary.select("lemma").distinct(), "lemma", "left_semi").groupBy("word").agg(F.collect_set("lemma").alias("known"))
    joined = distinct.join(known, "word", "left")
    return map_rows(joined, ["word", "known"], f"stem string, analyses {ANALYSES}, inflected boolean", _analysed).drop("known")


def stem_parts_of_speech(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """Distinct lowered words with the part-of-speech letter of the dictionary (pos, lemma): word, pos; null if unknown.

    Of several letters for one lemma the first counts, by ``ord`` where the dictionary has that column, else by letter.
    """
    order = F.col("ord") if "ord" in dictionary.columns else F.col("pos")
    letters = dictionary.groupBy(F.col("lemma").alias("word")).agg(F.min_by("pos", order).alias("pos"))
    distinct = words.select(F.col(column).alias("word")).where("word is not null and word != ''").distinct()
    return distinct.join(letters, "word", "left").select("word", "pos")
