"""Queries over worked examples: every order picks one by its key, and SQL holds what must come out.

They cover rules that texts of the standard tables never meet: typed tokens, sentence ends, suffixes, languages, moments
against each order's date, spelling and its issues, ranks of keywords, files written and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casing, detect, display, entities, tokens, translit
from ..operators import chunks, datetimes, lexical, morphology, quality, texts
from ..sources import vocabularies
from ..sources.shared import shared_folder
from . import jobs
from .registry import ORACLE_SQL, QUERIES, _document_words, _DOCUMENT_WORDS, _pick, _table, query

KEY = "o_orderkey"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _made(spark: SparkSession, sf_dir: str, inputs: list[str]) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(KEY, "o_orderdate", _pick(inputs, F.col(KEY)).alias("text"))


def examples(table: list[tuple[str, str]]) -> Callable:
    """Register a function from a table (o_orderkey, text) to (o_orderkey, got); ``table`` pairs inputs with results."""
    inputs, wanted = [a for a, _ in table], [b for _, b in table]

    def register(run: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[run.__name__] = lambda spark, sf_dir: run(_made(spark, sf_dir, inputs)).select(KEY, "got")
        ORACLE_SQL[run.__name__] = f"SELECT o_orderkey, {_sql_list(wanted)}[CAST(o_orderkey % {len(table)} AS INTEGER) + 1] AS got FROM orders"
        return run

    return register


def _shown(items: Column, show: Callable[[Column], Column], between: str = "|") -> Column:
    return F.coalesce(F.array_join(F.transform(items, show), between), F.lit(""))


def _tiled(parts: list[tuple[str, str]]) -> tuple[str, str]:
    """The text of (type, piece) pairs and its tokens, shown as type:piece@start."""
    starts = [0, *accumulate(len(piece.encode()) for _, piece in parts)]
    return "".join(p for _, p in parts), "|".join(f"{kind}:{piece}@{at}" for (kind, piece), at in zip(parts, starts))


_W, _N, _P, _S, _Y, _U, _E = "Word", "Number", "Punctuation", "Space", "Symbol", "URL", "Email"


@examples([
    _tiled([(_W, "Bakı'nın"), (_S, "  \t"), (_W, "sosial-iqtisadi"), (_P, "!")]),
    _tiled([(_N, "1.000.000"), (_S, " "), (_N, "3,14"), (_S, " "), (_N, "3"), (_P, "."), (_N, "14"), (_S, " "), (_N, "3"), (_P, ",")]),
    _tiled([(_N, "1"), (_P, "."), (_N, "00"), (_P, "."), (_N, "0"), (_S, " "), (_P, "-"), (_N, "5"), (_W, "km"), (_P, "%")]),
    _tiled([(_U, "https://gov.az/doc"), (_P, "."), (_S, " "), (_W, "http"), (_P, ":"), (_P, "/"), (_P, "/")]),
    _tiled([(_E, "test.user+tag@domain.co.az"), (_P, "."), (_S, " "), (_P, "."), (_E, "user@mail.az"), (_P, ".")]),
    _tiled([(_P, "'"), (_W, "söz"), (_P, "'"), (_S, " "), (_P, "-"), (_W, "söz"), (_P, "--"), (_W, "söz"), (_P, "–"), (_W, "F-16")]),
    _tiled([(_Y, "$"), (_Y, "±"), (_Y, "🏙"), (_S, "\n"), (_W, "中文"), (_P, "("), (_W, "ə"), (_P, ")")]),
    _tiled([(_W, "Prof"), (_P, "."), (_S, " "), (_W, "Əliyev"), (_S, " "), (_N, "1.000"), (_S, " "), (_W, "manat"), (_P, "…")]),
])
def typed_tokens(made: DataFrame) -> DataFrame:
    show = lambda t: F.concat(t["type"], F.lit(":"), t["text"], F.lit("@"), t["start"].cast("string"))
    return made.select(KEY, _shown(tokens.word_tokens(F.col("text")), show).alias("got"))


@examples([
    ("Bakı'nın 5 küçəsi, F-16; a@b.az https://c.az", "Bakı'nın|küçəsi|F-16"), ("1, 2 ...", ""), ("Az.R. qanunu – budur", "Az|R|qanunu|budur"),
])
def word_texts(made: DataFrame) -> DataFrame:
    return made.select(KEY, _shown(tokens.words(F.col("text")), lambda w: w).alias("got"))


def _sentences(*parts: str) -> tuple[str, str]:
    return _tiled([("Sentence", p) for p in parts])


@examples([
    _sentences("Birinci.", " İkinci."), _sentences("Prof. Əliyev gəldi."), _sentences("Az.R. qanunu."), _sentences("Kitablar və s. satıldı."),
    _sentences("Ola bilər...", " Bəlkə."), _sentences("Ola bilər…", " Bəlkə."), _sentences("Birinci\n\n", "İkinci"), _sentences("Birinci\nİkinci"),
    _sentences("Nə?!", " Doğru."), _sentences("O, prof."), _sentences("Yol 5 km. Bakıdan uzaqdır.", " Son."), _sentences("bir. iki. üç"),
])
def sentence_spans(made: DataFrame) -> DataFrame:
    show = lambda t: F.concat(F.lit("Sentence:"), t["text"], F.lit("@"), t["start"].cast("string"))
    return made.select(KEY, _shown(tokens.sentence_tokens(F.col("text")), show).alias("got"))


def _chunks(made: DataFrame, size: int, overlap: int, kind: str) -> DataFrame:
    show = lambda c: F.concat(c["text"], F.lit("@"), c["start"].cast("string"))
    return chunks.with_chunks(made, "text", size, overlap, kind).select(KEY, _shown(F.col("chunks"), show).alias("got"))


@examples([
    ("Bir. İki. Üç. Dörd.", "Bir. İki.@0| İki. Üç.@4| Üç. Dörd.@10"), ("Ab. Cd. Ef.", "Ab. Cd.@0| Cd. Ef.@3"), ("abcdefghijkl", "abcdefghijkl@0"),
    ("Birinci cümlə burada. İkinci cümlə orada.", "Birinci cümlə burada.@0| İkinci cümlə orada.@23"), ("A.\n\nB", "A.\n\nB@0"),
])
def sentence_chunk_spans(made: DataFrame) -> DataFrame:
    return _chunks(made, 10, 5, "sentence")


@examples([
    ("Birinci paraqraf.\n\nİkinci paraqraf.", "Birinci paraqraf.\n\n@0|İkinci paraqraf.@19"), ("Bir. İki.", "Bir. İki.@0"),
    ("Birinci cümlə burada. İkinci cümlə orada.", "Birinci cümlə burada.@0| İkinci cümlə orada.@23"), ("a" * 45, f"{'a' * 20}@0|{'a' * 25}@20"),
    ("https://example.az/sened söz", "https://example.az/sened söz@0"), ("söz " * 4 + "a@b.az, https://example.az/1", "söz söz söz söz a@b.az, @0|https://example.az/1@28"),
    ("a.\n\n\nb " + "c" * 20, f"a.\n\n\nb @0|{'c' * 20}@7"),
])
def structure_chunk_spans(made: DataFrame) -> DataFrame:
    return _chunks(made, 20, 0, "recursive")


@examples([
    ("Əlaqə: +994501234567", "Phone:+994501234567@9"), ("nömrə 0551234567, 055 123 45 67", "Phone:0551234567@8|Phone:055 123 45 67@20"),
    ("FIN: 5ARPXK2, sənəd 7HKPQR3 və ABCDEFG", "FIN:5ARPXK2@5!|FIN:7HKPQR3@22"), ("VÖEN: 9876543210; 1234567890", "VOEN:9876543210@7!"),
    ("AZ21NABZ00000000137010001944, 10-AA-123", "IBAN:AZ21NABZ00000000137010001944@0|LicensePlate:10-AA-123@30"),
    ("bax https://gov.az/a?b=1). a@b.az", "URL:https://gov.az/a?b=1@4|Email:a@b.az@27"), ("Bu sadə cümlədir.", ""), ("https://a.az/x@y.az", "URL:https://a.az/x@y.az@0"),
])
def entity_spans(made: DataFrame) -> DataFrame:
    show = lambda e: F.concat(e["type"], F.lit(":"), e["text"], F.lit("@"), e["start"].cast("string"), F.when(e["labeled"], "!").otherwise(""))
    return made.select(KEY, _shown(entities.recognize(F.col("text")), show).alias("got"))


@query("""
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS d FROM orders)
SELECT o_orderkey, '+99450' || d[4:10] AS "Phone", 'u' || d || '@mail.az' AS "Email", 'X' || d[5:10] AS "FIN", d AS "VOEN",
       'AZ21NABZ0000000000' || d AS "IBAN", d[9:10] || '-AB-' || d[8:10] AS "LicensePlate", 'http://a.az/' || d AS "URL" FROM d
""")
def entities_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the entities of each type, one type at a time."""
    d = F.lpad(F.col(KEY).cast("string"), 10, "0")
    part = lambda a, n: d.substr(a, n)
    text = F.concat(
        F.lit("a +99450"), part(4, 7), F.lit(" u"), d, F.lit("@mail.az fin: X"), part(5, 6), F.lit(" voen:"), d, F.lit(" AZ21NABZ0000000000"), d,
        F.lit(" "), part(9, 2), F.lit("-AB-"), part(8, 3), F.lit(" http://a.az/"), d,
    )
    made = _table(spark, sf_dir, "orders").select(KEY, text.alias("t")).select(KEY, entities.recognize(F.col("t")).alias("found"))
    return made.select(KEY, *[F.array_join(entities.of_type(F.col("found"), kind), ",").alias(kind) for kind in display.NAMES["entity"]])


#: Text, type, moment in SQL by the order's date d and its weekday w (Monday is 0), parts that it names (-1: none is named).
_MOMENTS = [
    ("sabah", "Date", "d + INTERVAL 1 DAY", 7), ("srağagün", "Date", "d - INTERVAL 2 DAY", 7), ("bu gün", "Date", "d", 7),
    ("gələn ay", "Date", "date_trunc('month', d) + INTERVAL 1 MONTH", 7), ("keçən il", "Date", "date_trunc('year', d) - INTERVAL 1 YEAR", 7),
    ("bu il", "Date", "date_trunc('year', d)", 7), ("keçən həftə", "Date", "d - to_days(w + 7)", 7), ("gələn həftə", "Date", "d + to_days(7 - w)", 7),
    ("çərşənbə", "Date", "d + to_days((9 - w) % 7)", 7), ("çərşənbə axşamı", "Date", "d + to_days((8 - w) % 7)", 7),
    ("keçən bazar ertəsi", "Date", "d - to_days((w + 6) % 7 + 1)", 7), ("gələn cümə", "Date", "d + to_days((10 - w) % 7 + 1)", 7),
    ("saat 3", "Time", "d + INTERVAL 3 HOUR", 8), ("axşam saat 7", "Time", "d + INTERVAL 19 HOUR", 8), ("14:30", "Time", "d + INTERVAL 870 MINUTE", 24),
    ("5 saat əvvəl", "DateTime", "d - INTERVAL 5 HOUR", 63), ("beş gün sonra", "Date", "d + INTERVAL 5 DAY", 7), ("2 həftə sonra", "Date", "d + INTERVAL 14 DAY", 7),
    ("martın 15-i", "Date", "make_timestamp(year(d), 3, 15, 0, 0, 0)", 6), ("may ayının 3-ü", "Date", "make_timestamp(year(d), 5, 3, 0, 0, 0)", 6),
    ("5-ci mart", "Date", "make_timestamp(year(d), 3, 5, 0, 0, 0)", 6), ("1-inci yanvar", "Date", "make_timestamp(year(d), 1, 1, 0, 0, 0)", 6),
    ("APRELDƏ", "Date", "make_timestamp(year(d), 4, 1, 0, 0, 0)", 2), ("32 mart 2026", "Date", "make_timestamp(2026, 3, 1, 0, 0, 0)", 3),
    ("05/03/2026 09:05:22", "DateTime", "make_timestamp(2026, 3, 5, 9, 5, 22)", 63), ("2 saat 30 dəqiqə", "Duration", "d", 0),
    ("25:99", None, None, None), ("5 heft", None, None, None),
]


def _sql_case(at: int, show: Callable) -> str:
    whens = " ".join(f"WHEN {i} THEN {show(m[at])}" for i, m in enumerate(_MOMENTS) if m[1])
    return f"CASE o_orderkey % {len(_MOMENTS)} {whens} END"


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d, CAST(isodow(o_orderdate) AS INTEGER) - 1 AS w FROM orders),
r AS (SELECT o_orderkey, {_sql_case(1, _text)} AS type, CAST({_sql_case(2, str)} AS TIMESTAMP) AS time, {_sql_case(3, str)} AS explicit FROM o)
SELECT * FROM r WHERE type IS NOT NULL
""")
def moments_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, periods, weekdays, clock times, ordinals and quantities against the date of each order."""
    found = datetimes.with_datetimes(_made(spark, sf_dir, [m[0] for m in _MOMENTS]), "text", "o_orderdate")
    return found.select(KEY, F.explode("datetimes").alias("r")).select(KEY, "r.type", "r.time", "r.explicit")


@examples([
    ("Salam, necəsən? Bu gün hava çox gözəldir.", "Azerbaijani Latn az"), ("Бу мәтн Азәрбајҹан дилиндәдир", "Azerbaijani Cyrl az"),
    ("Привет, как у тебя дела сегодня?", "Russian Cyrl ru"), ("Hello, how are you doing today?", "English Latn en"),
    ("Bugün hava çok güzel, parkta yürüyüş yapmaya karar verdik", "Turkish Latn tr"), ("Bu gün yaxşı hava olacaq deyirlər", "Azerbaijani Latn az"),
    ("1234567890", "Unknown  "), ("test", "Unknown  "), ("Привет мир молоко", "Russian Cyrl ru"),
])
def languages_of_texts(made: DataFrame) -> DataFrame:
    best = detect.best(F.col("languages"))
    said = F.concat_ws(" ", F.coalesce(best["lang"], F.lit("Unknown")), F.coalesce(best["script"], F.lit("")), detect.code(F.col("languages")))
    return detect.with_languages(made, "text").select(KEY, said.alias("got"))


def _sql_profile(name: str, profile: dict[str, float]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({_text(t)}, CAST({v!r} AS DOUBLE))' for t, v in profile.items())}) AS t(g, f))"


def _length(profile: dict[str, float]) -> str:
    return repr(sum(v * v for v in profile.values()) ** 0.5)


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS DOUBLE)"


ORACLE_SQL["detect_languages"] = f"""
WITH {_sql_profile('pa', detect.AZ_PROFILE)}, {_sql_profile('pt', detect.TR_PROFILE)},
n AS (SELECT doc_id, lang, text, {_n('\\p{L}')} AS l, {_n('[\\x{400}-\\x{4FF}]')} AS cyr, {_n('[əƏ]')} AS schwa, {_n(f'[{detect.TURKIC}]')} AS sh,
             {_n('[xXqQ]')} AS xq, {_n('[A-Za-z]')} AS asc_, {_n(f'[{detect.AZ_CYRILLIC}]')} AS ac, {_n(f'[{detect.RU_CYRILLIC}]')} AS rc FROM documents),
c AS (SELECT doc_id, lang, text, string_split(lower(translate(regexp_replace(text, '\\P{{L}}', '', 'g'), 'Iİ', 'ıi')), '') AS c FROM n WHERE schwa = 0 AND sh > 0 AND cyr <= l - cyr),
g AS (SELECT doc_id, lang, text, c[i] || c[i + 1] || c[i + 2] AS g, count(*) AS k FROM (SELECT doc_id, lang, text, c, unnest(range(1, len(c) - 1)) AS i FROM c) GROUP BY ALL),
s AS (SELECT doc_id, lang, text, sum(k * coalesce(pa.f, 0)) AS a, sum(k * coalesce(pt.f, 0)) AS t, sqrt(sum(k * k)) AS q FROM g LEFT JOIN pa USING (g) LEFT JOIN pt USING (g) GROUP BY ALL),
x AS (SELECT n.*, cyr > l - cyr AS ic, coalesce(a / q / {_length(detect.AZ_PROFILE)}, 0.0) AS ka, coalesce(t / q / {_length(detect.TR_PROFILE)}, 0.0) AS kt
      FROM n LEFT JOIN s ON n.doc_id IS NOT DISTINCT FROM s.doc_id AND n.lang IS NOT DISTINCT FROM s.lang AND n.text = s.text),
y AS (SELECT doc_id, lang,
        CASE WHEN ic THEN CASE WHEN ac = 0 AND rc = 0 THEN {detect.CYRILLIC_AZ} ELSE ac END WHEN schwa > 0 THEN schwa * {detect.SCHWA}
             WHEN sh > 0 THEN sh * {detect.SHARED} + ka + xq * {detect.XQ} ELSE 0 END AS az,
        CASE WHEN ic THEN CASE WHEN ac = 0 AND rc = 0 THEN {detect.CYRILLIC_RU} ELSE rc END ELSE 0 END AS ru,
        CASE WHEN ic THEN 0 WHEN sh > 0 OR schwa > 0 THEN asc_ / l * {detect.ENGLISH_IN_TURKIC} ELSE asc_ / l END AS en,
        CASE WHEN ic THEN 0 WHEN schwa > 0 THEN sh * {detect.SHARED} WHEN sh > 0 THEN sh * {detect.SHARED} + kt + CASE WHEN xq = 0 THEN {detect.NO_XQ} ELSE 0 END ELSE 0 END AS tr,
        l FROM x),
z AS (SELECT *, az + ru + en + tr AS total, greatest(az, ru, en, tr) AS top FROM y)
SELECT doc_id, lang, CASE WHEN l >= {detect.LEAST_LETTERS} AND total > 0 THEN CASE top WHEN az THEN 'Azerbaijani' WHEN ru THEN 'Russian' WHEN en THEN 'English' ELSE 'Turkish' END END AS found,
       CASE WHEN l >= {detect.LEAST_LETTERS} AND total > 0 THEN round(top / total, 9) END AS confidence FROM z
"""

_LEMMAS = (
    "kitab ev gəl su uşaq yaz müəllim göz gün iş yol ürək ağız beyin ömür şəhər danış ed bildir gözəl pis dəniz bu çox sinif ol paltar al oğlu"
).split()


def _lemmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _LEMMAS], "lemma string")


@examples([
    ("kitablarımızdan", "kitab"), ("Kitablar", "Kitab"), ("KITABLAR", "KITAB"), ("evlərdə", "ev"), ("gəlmişdir", "gəl"), ("yazdılar", "yaz"), ("müəllimdir", "müəllim"),
    ("gəlir", "gəl"), ("gözlük", "göz"), ("işsiz", "iş"), ("ürəyə", "ürək"), ("yola", "yol"), ("ağzım", "ağız"), ("beyni", "beyin"), ("ömrü", "ömür"), ("şəhri", "şəhər"),
    ("danışır", "danış"), ("edib", "ed"), ("bildirib", "bildir"), ("Bakı'nın", "Bakı"), ("a-b-c", "a-b-c"), ("paltar", "paltar"), ("alnı", "al"), ("kitabçılıqda", "kitab"),
    ("'test", "'test"), ("Oğlum", "Oğlu"), ("a" * 257, "a" * 257),
])
def stems_of_words(made: DataFrame) -> DataFrame:
    stems = morphology.analyse_words(made, _lemmas(made.sparkSession), "text").select(F.col("word").alias("text"), F.col("stem").alias("got"))
    return made.join(stems, "text")


_SUFFIXES = [
    ("kitablarımızdan", "kitab[Plural:lar|Poss1Pl:ımız|CaseAbl:dan]"), ("kitabım", "kitab[Poss1Sg:ım]"), ("kitabın", "kitab[Poss2Sg:ın]"), ("evdə", "ev[CaseLoc:də]"),
    ("evə", "ev[CaseDat:ə]"), ("kitabçılıq", "kitab[DerivAgent:çı|DerivAbstract:lıq]"), ("gəlmişdir", "gəl[TensePastIndef:miş|Copula:dir]"),
    ("yazdılar", "yaz[TensePastDef:dı|Pers3:lar]"), ("gəldim", "gəl[TensePastDef:di|Pers1Sg:m]"), ("evlərdə", "ev[Plural:lər|CaseLoc:də]"), ("kitab", "kitab"),
]


@examples(_SUFFIXES)
def suffixes_of_words(made: DataFrame) -> DataFrame:
    """The wanted analysis, if it is among those of the word."""
    rows = morphology.analyse_words(made, _lemmas(made.sparkSession), "text").select(F.col("word").alias("text"), "analyses")
    wanted = _pick([w for _, w in _SUFFIXES], F.col(KEY))
    return made.join(rows, "text").select(KEY, F.when(F.exists("analyses", lambda a: display.analysis(a) == wanted), wanted).alias("got"))


def _frequencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, 1000 - i) for i, w in enumerate(_LEMMAS)], "word string, freq long")


@query(f"""
WITH t AS (SELECT unnest({_sql_list(_LEMMAS)}) AS term, unnest(range(1000, {1000 - len(_LEMMAS)}, -1)) AS frequency),
w AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 2 THEN term ELSE substr(term, 1, 1 + CAST(o_orderkey % 3 AS INTEGER)) || substr(term, 3 + CAST(o_orderkey % 3 AS INTEGER)) END AS word
      FROM t, orders WHERE length(term) >= 4),
p AS (SELECT word, term, damerau_levenshtein(translate(word, 'əöüğçşı', '1234567'), translate(term, 'əöüğçşı', '1234567')) AS distance, frequency FROM w, t),
k AS (SELECT * FROM p WHERE distance <= 1 AND length(word) <= length(term) QUALIFY distance = 0 OR min(distance) OVER (PARTITION BY word) = 1)
SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, frequency DESC, term) AS INTEGER) AS rank, term, CAST(distance AS INTEGER) AS distance, frequency FROM k
""")
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms at distance 1 of terms that lost their second or third letter; a term itself has no other."""
    at = (F.col(KEY) % 3).cast("int")
    picked = _table(spark, sf_dir, "orders").select(at.alias("at")).distinct().crossJoin(F.broadcast(_lemmas(spark).where("length(lemma) >= 4")))
    made = picked.select(F.when(F.col("at") == 2, F.col("lemma")).otherwise(F.expr("left(lemma, 1 + at) || substring(lemma, 3 + at)")).alias("word"))
    return lexical.suggestions(made, _frequencies(spark), 1)


@examples([
    ("Bu kitab çox gözəldir.", "100"), ("Bu ketab gözəldir.", "90 spelling:ketab@3>kitab"), ("Bu  kitab gözəldir.", "97 punctuation:  @2> "),
    ("Bu kitab , gözəldir.", "97 punctuation: @8>"), ("Bu kitab...", "100"), ("Bu kitab..", "99 punctuation:..@8>."), ("Qərbi gözəldir.", "100"),
    ("x7xx F-16 sinif", "100"), ("Bu ketab ,gözəldir.", "87 spelling:ketab@3>kitab|punctuation: @8>"), ("kіtab gözəldir", "80 spelling:kіtab@0>kitab|layout:kіtab@0>kitab"), ("123 456 789", "100"),
])
def issues_of_texts(made: DataFrame) -> DataFrame:
    spark = made.sparkSession
    show = lambda i: F.concat(i["type"], F.lit(":"), i["text"], F.lit("@"), i["start"].cast("string"), F.lit(">"), i["suggestion"])
    judged = quality.validate(made.select(KEY, "text"), "text", KEY, _lemmas(spark), _frequencies(spark))
    found = F.when(F.size("issues") > 0, _shown(F.col("issues"), show))
    return judged.select(KEY, F.concat_ws(" ", F.col("score").cast("string"), found).alias("got"))


_STEMS = ["kitab", "dəniz", "ev", "yol", "gün"]
_RANKED = "[" + ", ".join(f"{_sql_list(_STEMS)}[CAST((o_orderkey // {d}) % 5 AS INTEGER) + 1]" for d in (1, 3, 7, 11, 2, 5)) + "]"


@query(f"""
WITH RECURSIVE t AS (SELECT o_orderkey AS doc_id, {_RANKED} AS s FROM orders),
d AS (SELECT doc_id, s, list_sort(list_distinct(s)) AS u FROM t),
m AS (SELECT doc_id, s, u, list_transform(u, lambda a: list_transform(u, lambda b: CASE WHEN a = b THEN 0.0::DOUBLE ELSE list_sum(list_transform(range(1, 6), lambda i:
        CAST((s[i] = a AND s[i + 1] = b) OR (s[i] = b AND s[i + 1] = a) AS DOUBLE)
        + CAST(coalesce((s[i] = a AND s[i + 2] = b) OR (s[i] = b AND s[i + 2] = a), FALSE) AS DOUBLE))) END)) AS w FROM d),
k AS (SELECT doc_id, s, u, w, list_transform(w, lambda r: list_sum(r)) AS sums FROM m),
r AS (
  SELECT doc_id, 0 AS i, 1.0::DOUBLE AS moved, list_transform(u, lambda a: 1.0::DOUBLE / len(u)) AS rank, w, sums, u, s FROM k
  UNION ALL
  SELECT doc_id, i + 1, list_max(list_transform(range(1, len(u) + 1), lambda j: abs(fresh[j] - rank[j]))), fresh, w, sums, u, s FROM (
    SELECT *, list_transform(range(1, len(u) + 1), lambda a: 0.15::DOUBLE / len(u) + 0.85::DOUBLE * list_sum(list_transform(range(1, len(u) + 1), lambda b:
      CASE WHEN w[a][b] = 0 THEN 0.0::DOUBLE ELSE rank[b] * w[a][b] / sums[b] END))) AS fresh
    FROM r WHERE i < 30 AND moved >= 1e-4)),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
e AS (SELECT doc_id, s, unnest(u) AS stem, round(unnest(rank), 9) AS score FROM f)
SELECT doc_id, stem, score, CAST(len(list_filter(s, lambda x: x = stem)) AS BIGINT) AS count FROM e
""")
def keyword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the stems of six-word texts among their neighbours."""
    words = F.array(*[_pick(_STEMS, F.floor(F.col(KEY) / d)) for d in (1, 3, 7, 11, 2, 5)])
    made = _table(spark, sf_dir, "orders").select(F.col(KEY).alias("doc_id"), words.alias("stems"))
    return lexical.textrank(made, 10).select("doc_id", "stem", "score", "count")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'İşıq' WHEN 1 THEN 'İŞIQ' ELSE 'işıq' END AS cased, c_custkey % 4 < 3 AS mark, c_name AS latin, c_name AS arabic FROM customer
""")
def case_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case of a word on another, apostrophes, and the script that has no table."""
    key = F.col("c_custkey")
    made = _table(spark, sf_dir, "customer").select(key, "c_name", _pick(["Ketab", "KETAB", "ketab"], key).alias("w"), _pick([*casing.APOSTROPHES, '"'], key).alias("a"))
    return made.select(
        "c_custkey", casing.apply_case(F.col("w"), F.lit("işıq")).alias("cased"), casing.is_apostrophe(F.col("a")).alias("mark"),
        translit.arabic_to_latin(F.col("c_name")).alias("latin"), translit.latin_to_arabic(F.col("c_name")).alias("arabic"),
    )


ORACLE_SQL["dictionary_build"] = f"""
WITH w AS (SELECT DISTINCT stem AS word FROM ({_DOCUMENT_WORDS})),
p AS (SELECT ['N', 'V', 'A', NULL][CAST(length(word) % 4 AS INTEGER) + 1] AS pos, word, regexp_replace(word, '(?:maq|mək)$', '') AS cut FROM w),
l AS (SELECT DISTINCT pos, CASE WHEN pos = 'V' AND length(cut) >= 2 AND regexp_matches(cut, '[aıoueəiöü]') THEN cut ELSE word END AS lemma
      FROM p WHERE pos IS NOT NULL AND regexp_full_match(word, '\\p{{L}}{{2,}}')),
b AS (SELECT lemma, regexp_replace(lemma, unnest(['(?:lar|lər)$', '(?:sı|si|su|sü)$', '(?:ı|i|u|ü)$']), '') AS base FROM l WHERE pos = 'N'),
i AS (SELECT DISTINCT lemma FROM b WHERE base <> lemma AND base IN (SELECT lemma FROM l))
SELECT pos, lemma FROM l WHERE pos <> 'N' OR lemma NOT IN (SELECT lemma FROM i)
"""


@query(f"""
WITH w AS (SELECT stem AS word, count(*) AS n FROM ({_DOCUMENT_WORDS}) WHERE regexp_full_match(stem, '[a-z]+') GROUP BY stem),
s AS (SELECT word, word[1 : len(word) - 1] AS stem FROM w WHERE len(word) > 3 AND word[len(word)] = 's' UNION ALL SELECT 'zzzz', 'zzz'),
e AS (SELECT word, n FROM w UNION ALL SELECT s.stem, n FROM w JOIN s USING (word)),
t AS (SELECT word, sum(n) AS n FROM e GROUP BY word)
SELECT word, CAST(greatest(coalesce(n, 0), 1) AS BIGINT) AS freq FROM t FULL JOIN (SELECT DISTINCT stem AS word, TRUE AS listed FROM s) USING (word) WHERE listed OR n >= 50
""")
def stem_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words and of the stems that a made table gives some of them; a stem without a word counts once."""
    words = _document_words(spark, sf_dir).where("stem rlike '^[a-z]+$'")
    ending = words.distinct().select(F.col("stem").alias("word")).distinct().where("length(word) > 3 and right(word, 1) = 's'")
    stems = ending.select("word", F.expr("left(word, length(word) - 1)").alias("stem")).union(spark.createDataFrame([("zzzz", "zzz")], "word string, stem string"))
    return jobs.word_frequencies(words.select(F.translate("stem", "I", "ı").alias("value")), stems)


_KNOWN = ["the", "de", "und", "la"]
_MINED = ORACLE_SQL["lexicon_candidates"].replace("WHERE a + b + neu >= 10", f"WHERE stem NOT IN ({', '.join(map(_text, _KNOWN))}) AND a + b + neu >= 10")


@query(_MINED)
def new_lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a lexicon does not hold yet."""
    key = F.col("doc_id") % 3
    classes = _table(spark, sf_dir, "documents").select("doc_id", F.when(key == 0, "positive").when(key == 1, "negative").otherwise("neutral").alias("class"))
    return jobs.mine_lexicon(_document_words(spark, sf_dir), classes, spark.createDataFrame([(w,) for w in _KNOWN], "stem string"))


@query("""
WITH r AS (SELECT CAST(o_orderkey % 50 AS BIGINT) AS file, CASE WHEN o_orderkey % 50 = 3 THEN 30 ELSE o_orderkey % 4 + 1 END AS n FROM orders),
t AS (SELECT file, CAST(sum(CASE WHEN file = 7 THEN 21 * n - 1 ELSE 11 * n - 1 END) AS BIGINT) AS bytes, CAST(sum(5 * n - 1) AS BIGINT) AS tokens, CAST(sum(2 * n) AS BIGINT) AS words,
             CAST(sum(n) AS BIGINT) AS sentences, count(*) AS paragraphs, TRUE AS rebuilt, file = 7 AS cyrillic, TRUE AS translit_rebuilt FROM r GROUP BY file)
SELECT *, sentences / paragraphs > 3 * (SELECT median(sentences / paragraphs) FROM t) AS outlier FROM t
""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made corpus: sizes, tokens, words and sentences by file, and the file with far more sentences than the median."""
    file = F.col(KEY) % 50
    n = F.when(file == 3, 30).otherwise(F.col(KEY) % 4 + 1).cast("int")
    value = F.array_join(F.array_repeat(F.when(file == 7, "Бакы јахшы.").otherwise("Söz axar."), n), " ")
    return jobs.corpus_report(_table(spark, sf_dir, "orders").select(file.alias("file"), value.alias("value"))).drop("ratio")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'V' END AS pos, 'söz' || o_orderkey AS lemma FROM orders")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written as lines and read again."""
    key, path = F.col(KEY), _fresh(spark, "dictionary")
    vocabularies.write_dictionary(_table(spark, sf_dir, "orders").select(F.when(key % 2 == 0, "N").otherwise("V").alias("pos"), F.concat(F.lit("söz"), key).alias("lemma")), path)
    return vocabularies.dictionary(spark, path)


@query("SELECT 'iki söz' || o_orderkey AS word, CAST(o_orderkey % 1000 AS BIGINT) AS freq FROM orders")
def frequency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of words, with spaces in them, written as lines and read again."""
    key, path = F.col(KEY), _fresh(spark, "frequencies")
    vocabularies.write_frequencies(_table(spark, sf_dir, "orders").select(F.concat(F.lit("iki söz"), key).alias("word"), (key % 1000).alias("freq")), path)
    return vocabularies.frequencies(spark, path)


@query("SELECT 'rəy ' || o_orderkey || ' yaxşı' AS content, CAST(o_orderkey % 5 + 1 AS INTEGER) AS score FROM orders")
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written with tabs and read again; ratings beyond 1 to 5 are left out."""
    key, path = F.col(KEY), _fresh(spark, "reviews")
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("rəy "), key, F.lit(" yaxşı")).alias("content"), (key % 5 + 1).cast("int").alias("score"))
    vocabularies.write_reviews(rows.union(spark.createDataFrame([("artıq", 9)], "content string, score int")), path)
    return vocabularies.reviews(spark, path)


@query("SELECT 'k' || o_orderkey AS stem, CAST((o_orderkey % 20 - 10) / 10 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 3 <> 0")
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a lexicon among comments and malformed ones."""
    key, path = F.col(KEY), _fresh(spark, "lexicon")
    line = F.concat(F.lit("k"), key, F.lit("\t"), ((key % 20 - 10) / 10).cast("string"))
    bad = F.when(key % 2 == 0, F.concat(F.lit("# "), line)).otherwise(F.concat(F.lit("k"), key, F.lit("\tx")))
    _table(spark, sf_dir, "orders").select(F.when(key % 3 == 0, bad).otherwise(line).alias("value")).write.text(path)
    return vocabularies.lexicon(spark, path).select("stem", "score")


@query("SELECT 'w' || o_orderkey AS word, ['noun', 'verb'][CAST(o_orderkey % 2 AS INTEGER) + 1] AS pos FROM orders WHERE o_orderkey % 5 <> 0")
def dump_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a dump, some of them broken."""
    key, path = F.col(KEY), _fresh(spark, "dump")
    line = F.to_json(F.struct(F.concat(F.lit("w"), key).alias("word"), _pick(["noun", "verb"], key).alias("pos")))
    _table(spark, sf_dir, "orders").select(F.when(key % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return vocabularies.dump(spark, path)


@query("SELECT DISTINCT CAST(o_orderkey % 7 AS BIGINT) AS part, 'sətir ' || o_orderkey AS value FROM orders")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files in a tree of folders."""
    key, path = F.col(KEY), _fresh(spark, "corpus")
    lines = _table(spark, sf_dir, "orders").select((key % 7).alias("part"), F.concat(F.lit("sətir "), key).alias("value"))
    lines.write.partitionBy("part").text(path)
    return vocabularies.corpus(spark, path).select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "value")
