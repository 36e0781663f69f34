"""Every query of the library (without the optional llm subpackage) and its SQL.

The standard tables hold no Azerbaijani, so most queries make Azerbaijani strings from keys and dates by the same rule in
both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import casing, detect, entities, numbers, tokens, translit
from ..operators import chunks, datetimes, lexical, morphology, quality, texts
from ..sources.shared import settled
from ..streaming import streams
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Azerbaijani words that stand for a key, by its remainder.
WORDS = ["kitab", "İşıq", "gözəl", "Iğdır", "dəniz", "ÇAY", "şəhər", "qış", "öyrənci", "ümid"]
CYRILLIC = ["китаб", "Ҝүнәш", "Гара", "Ганун", "объект", "гиш", "Бакы", "шәһәр", "Ҹәнуб", "өлкә"]
LEXICON = [("gözəl", 0.9), ("yaxşı", 0.7), ("pis", -0.8), ("zəif", -0.5), ("əla", 1.0)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, key) -> object:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_words(spark, sf_dir)


@query("""
WITH w AS (
  SELECT lang, lower(translate(unnest(regexp_extract_all(text, '\\p{L}+')), 'Iİ', 'ıi')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word)
SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM c
QUALIFY rank <= 10
""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest words of each language."""
    docs = _table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", casing.az_lower(F.col("word")).alias("word")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


_CASES = f"""
WITH t AS (SELECT c_custkey, {_sql_pick(WORDS, 'c_custkey')} || ' ' || c_name AS s FROM customer)
SELECT c_custkey, lower(translate(s, 'Iİ', 'ıi')) AS low, upper(translate(s, 'iı', 'İI')) AS high,
       upper(translate(s[1], 'iı', 'İI')) || s[2:] AS first_high,
       regexp_matches(s, '^\\p{{Lu}}') AND regexp_matches(s[2:], '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS title,
       regexp_matches(s, '\\p{{L}}') AND NOT regexp_matches(s, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AS all_high,
       regexp_matches(s, '\\p{{Nd}}') AS has_digit
FROM t
"""


@query(_CASES)
def case_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    t = _table(spark, sf_dir, "customer").select(key, F.concat_ws(" ", _pick(WORDS, key), "c_name").alias("s"))
    s = F.col("s")
    return t.select(
        "c_custkey", casing.az_lower(s).alias("low"), casing.az_upper(s).alias("high"), casing.upper_first(s).alias("first_high"),
        casing.is_title_case(s).alias("title"), casing.is_all_upper(s).alias("all_high"), casing.contains_digit(s).alias("has_digit"),
    )


@query(f"""
SELECT c_custkey, nfc_normalize({_sql_pick(WORDS, 'c_custkey')}) AS composed FROM customer
""")
def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken apart into base letters and marks, composed again."""
    key = F.col("c_custkey")
    word = _pick(WORDS, key)
    for composed, pair in ((v, k) for k, v in casing.COMPOSED.items()):
        word = F.replace(word, F.lit(composed), F.lit(pair))
    return _table(spark, sf_dir, "customer").select(key, casing.compose_nfc(word).alias("composed"))


@query(f"""
SELECT p_partkey, translate({_sql_pick(WORDS, 'p_partkey')} || ' ' || p_name, '{translit.LATIN}', '{translit.CYRILLIC}') AS cyrillic
FROM part
""")
def to_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(key, translit.latin_to_cyrillic(F.concat_ws(" ", _pick(WORDS, key), "p_name")).alias("cyrillic"))


@query(f"""
WITH t AS (SELECT p_partkey, {_sql_pick(CYRILLIC, 'p_partkey')} AS s FROM part),
g AS (SELECT p_partkey, s, CASE WHEN regexp_matches(s, '[Ҝҝ]') THEN s ELSE
  regexp_replace(regexp_replace(s, 'Г(\\P{{L}}*[ӘәЕеИиӨөҮү])', 'G\\1', 'g'), 'г(\\P{{L}}*[ӘәЕеИиӨөҮү])', 'g\\1', 'g') END AS r FROM t)
SELECT p_partkey, translate(r, '{translit.CYRILLIC}Йй' || 'ЬьЪъ', '{translit.LATIN}Yy') AS latin FROM g
""")
def to_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(key, _pick(CYRILLIC, key).alias("s")).select("p_partkey", translit.cyrillic_to_latin(F.col("s")).alias("latin"))


def _sql_words(n: str) -> str:
    """Cardinal words of a positive number below 10^12 in SQL."""
    ones, tens = str(numbers.ONES), str([""] + numbers.TENS[1:])
    parts = []
    for power in (3, 2, 1, 0):
        g = f"(({n} // {1000**power}) % 1000)"
        said = (
            f"concat_ws(' ', CASE WHEN {g} // 100 > 1 THEN {ones}[CAST({g} // 100 + 1 AS INTEGER)] END, "
            f"CASE WHEN {g} // 100 > 0 THEN '{numbers.HUNDRED}' END, "
            f"CASE WHEN {g} % 100 // 10 > 0 THEN {tens}[CAST({g} % 100 // 10 + 1 AS INTEGER)] END, "
            f"CASE WHEN {g} % 10 > 0 THEN {ones}[CAST({g} % 10 + 1 AS INTEGER)] END"
        )
        unit = f", '{numbers.MAGNITUDES[power]}')" if power else ")"
        said += unit
        if power == 1:
            said = f"CASE WHEN {g} = 1 THEN '{numbers.MAGNITUDES[1]}' ELSE {said} END"
        parts.append(f"CASE WHEN {g} > 0 THEN {said} END")
    return f"concat_ws(' ', {', '.join(parts)})"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 'sıfır' ELSE {_sql_words('(o_orderkey * 1000003)')} END AS words FROM orders")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", (F.col("o_orderkey") * 1000003).alias("n")).select("o_orderkey", numbers.to_words(F.col("n")).alias("words"))


@query(f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 'sıfır' ELSE {_sql_words('o_orderkey')} END AS w FROM orders),
v AS (SELECT o_orderkey, w, translate(regexp_extract(w, '^.*([aıoueəiöü])', 1), 'aıoueəiöü', 'ııuuiiiüü') AS x FROM t)
SELECT o_orderkey, w || CASE WHEN regexp_matches(w, '[aıoueəiöü]$') THEN '' ELSE x END || 'nc' || x AS ordinal FROM v
""")
def ordinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    said = orders.select("o_orderkey", numbers.to_words(F.col("o_orderkey")).alias("w"))
    return said.select("o_orderkey", numbers.ordinal_of(F.col("w")).alias("ordinal"))


@query("SELECT o_orderkey, o_orderkey AS parsed FROM orders")
def parse_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys through words and back."""
    said = _table(spark, sf_dir, "orders").select("o_orderkey", numbers.to_words(F.col("o_orderkey")).alias("w"))
    return said.select("o_orderkey", numbers.parse_words(F.col("w")).alias("parsed"))


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS w, CAST(round(l_discount * 100) AS BIGINT) + 10 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN w = 0 THEN 'sıfır' ELSE {_sql_words('w')} END || ' tam yüzdə ' || {_sql_words('f')} AS words FROM t
""")
def decimal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(","), (F.round(F.col("l_discount") * 100).cast("long") + 10).cast("string"))
    return numbers.with_decimal_words(lines.select("l_orderkey", "l_linenumber", text.alias("s")), "s", "words").select("l_orderkey", "l_linenumber", "words")


@query("""
WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')) AS s FROM conversations)
SELECT conv_id, turn, CAST(len(regexp_extract_all(s, '[a-z]+')) AS BIGINT) AS n_words,
       CAST(len(regexp_extract_all(s, ' +')) AS BIGINT) AS n_spaces FROM t WHERE s <> ''
""")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and white space of plain text by the typed tokens."""
    plain = F.lower(F.regexp_replace("text", "[^A-Za-z ]", " "))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("s")).where("s != ''")
    typed = rows.select("conv_id", "turn", F.transform(tokens.token_texts(F.col("s")), tokens.token_type).alias("types"))
    return typed.select(
        "conv_id", "turn", F.size(F.filter("types", lambda t: t == "Word")).cast("long").alias("n_words"),
        F.size(F.filter("types", lambda t: t == "Space")).cast("long").alias("n_spaces"),
    )


@query("SELECT conv_id, turn, strlen(text) AS n_bytes FROM conversations WHERE text <> ''")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last token ends: tokens tile the text in bytes."""
    rows = _table(spark, sf_dir, "conversations").where("text != ''")
    return rows.select("conv_id", "turn", F.element_at(tokens.word_tokens(F.col("text")), -1)["end"].cast("long").alias("n_bytes"))


@query("SELECT item_id, text AS rebuilt FROM benchmark")
def sentence_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences put together again."""
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens.sentences(F.col("text")), "").alias("rebuilt"))


@query("""
WITH t AS (SELECT item_id, text, len(text) AS n FROM benchmark WHERE text <> ''),
s AS (SELECT item_id, text, n, unnest(range(0, n, 48)) AS a FROM t),
k AS (SELECT *, n - a AS left_over, min(CASE WHEN n - a < 10 AND a > 0 THEN a END) OVER (PARTITION BY item_id) AS tail FROM s)
SELECT item_id, a // 48 AS index, CASE WHEN tail IS NOT NULL AND a + 48 = tail THEN text[a + 1 :] ELSE text[a + 1 : a + 64] END AS chunk
FROM k WHERE tail IS NULL OR a < tail
""")
def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 characters, 16 shared."""
    rows = _table(spark, sf_dir, "benchmark").where("text != ''")
    cut = rows.select("item_id", F.explode(tokens.chunks_by_size(F.col("text"), 64, 16)).alias("c"))
    return cut.select("item_id", F.col("c.index").cast("long").alias("index"), F.col("c.text").alias("chunk"))


@query("SELECT item_id, text AS rebuilt, TRUE AS tiled FROM benchmark WHERE text <> ''")
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks put together again, each beginning where the one before it ends."""
    rows = _table(spark, sf_dir, "benchmark").where("text != ''")
    cut = chunks.with_chunks(rows.select("item_id", "text"), "text", 120, 20)
    starts, ends = F.transform("chunks", lambda c: c["start"]), F.transform("chunks", lambda c: c["end"])
    tiled = F.slice(starts, F.lit(2), F.size("chunks")) == F.slice(ends, F.lit(1), F.size("chunks") - 1)
    return cut.select("item_id", F.array_join(F.transform("chunks", lambda c: c["text"]), "").alias("rebuilt"), tiled.alias("tiled"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = chunks.with_chunks(rows, "text", 500, 100, "sentence")
    return cut.select("doc_id", F.size("chunks").alias("n_chunks"))


def _class_count(pattern: str, of: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({of}, '{pattern}')) AS DOUBLE)"


@query(f"""
WITH n AS (SELECT doc_id, {_class_count('\\p{L}')} AS letters, {_class_count('[A-Za-z]')} AS plain,
           {_class_count('[' + detect.TURKIC + ']')} AS shared, {_class_count('[əƏ]')} AS schwa FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN letters < 10 OR plain = 0 THEN '' ELSE 'en' END AS code FROM n WHERE shared = 0 AND schwa = 0
""")
def detect_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without Turkic letters are English or nothing."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").where(~F.col("text").rlike(f"[{detect.TURKIC}əƏ]"))
    return detect.with_languages(rows.select("doc_id", "text"), "text").select("doc_id", detect.code(F.col("languages")).alias("code"))


@query()
def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.with_languages(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text")
    best = detect.best(F.col("languages"))
    return rows.select("doc_id", "lang", best["lang"].alias("found"), F.round(best["confidence"], 9).alias("confidence"))


_DIGITS = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"


@query(f"""
WITH t AS (SELECT c_custkey, {_DIGITS} AS d FROM customer)
SELECT c_custkey, 'Phone' AS type, '+994 ' || d[1:2] || ' ' || d[3:5] || ' ' || d[6:7] || ' ' || d[8:9] AS text, 5 AS start FROM t
UNION ALL SELECT c_custkey, 'LicensePlate', d[1:2] || '-AB-' || d[3:5], 24 FROM t
UNION ALL SELECT c_custkey, 'IBAN', 'AZ21NABZ00000000000' || d, 35 FROM t
UNION ALL SELECT c_custkey, 'Email', 'u' || d || '@mail.az', 64 FROM t
UNION ALL SELECT c_custkey, 'VOEN', '1' || d, 89 FROM t
UNION ALL SELECT c_custkey, 'FIN', 'AB' || d[5:9], 105 FROM t
UNION ALL SELECT c_custkey, 'URL', 'https://a.az/' || d, 113 FROM t
""")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each type in a sentence made from a key."""
    d = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    part = lambda a, n: d.substr(a, n)
    text = F.concat(
        F.lit("Tel: +994 "), part(1, 2), F.lit(" "), part(3, 3), F.lit(" "), part(6, 2), F.lit(" "), part(8, 2), F.lit(", "),
        part(1, 2), F.lit("-AB-"), part(3, 3), F.lit(", AZ21NABZ00000000000"), d, F.lit(" u"), d, F.lit("@mail.az VOEN: 1"), d,
        F.lit(" FIN: AB"), part(5, 5), F.lit(" https://a.az/"), d, F.lit("."),
    )
    rows = _table(spark, sf_dir, "customer").select("c_custkey", text.alias("t")).select("c_custkey", F.explode(entities.recognize(F.col("t"))).alias("e"))
    return rows.select("c_custkey", F.col("e.type").alias("type"), F.col("e.text").alias("text"), F.col("e.start").alias("start"))


@query("""
SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS email FROM documents
""")
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return rows.select("doc_id", F.explode(entities.texts_of(F.col("text"), "Email")).alias("email"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS text, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS time, 'Date' AS type FROM orders
""")
def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("Sifariş "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" tarixli")).alias("t"))
    found = datetimes.with_datetimes(orders, "t", "o_orderdate").select("o_orderkey", F.explode("datetimes").alias("r"))
    return found.select("o_orderkey", F.col("r.text").alias("text"), F.col("r.time").alias("time"), F.col("r.type").alias("type"))


@query("""
SELECT o_orderkey, (o_orderkey % 9 + 1) || ' gün əvvəl' AS text, CAST(o_orderdate - to_days(CAST(o_orderkey % 9 + 1 AS INTEGER)) AS TIMESTAMP) AS time FROM orders
""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" gün əvvəl"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.alias("t"))
    found = datetimes.with_datetimes(orders, "t", "o_orderdate").select("o_orderkey", F.explode("datetimes").alias("r"))
    return found.select("o_orderkey", F.col("r.text").alias("text"), F.col("r.time").alias("time"))


_MONTHS = str(datetimes.MONTHS)


@query(f"""
SELECT o_orderkey, day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' 14:30' AS text,
       CAST(date_trunc('day', o_orderdate) + INTERVAL 870 MINUTE AS TIMESTAMP) AS time, 'DateTime' AS type, 31 AS explicit FROM orders
""")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    name = F.element_at(F.array(*map(F.lit, datetimes.MONTHS)), F.month(day))
    text = F.concat_ws(" ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string"), F.lit("14:30"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.alias("t"))
    r = datetimes.with_datetimes(orders, "t", "o_orderdate").select("o_orderkey", F.explode("datetimes").alias("r"))
    return r.select("o_orderkey", F.col("r.text").alias("text"), F.col("r.time").alias("time"), F.col("r.type").alias("type"), F.col("r.explicit").alias("explicit"))


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zöüçéèß]{2,}"), F.lit(0))).alias("stem"))


_DOCUMENT_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zöüçéèß]{2,}')) AS stem FROM documents"


@query(f"""
WITH w AS ({_DOCUMENT_WORDS}), d AS (SELECT DISTINCT stem AS lemma FROM w WHERE regexp_matches(stem, '[öüç]')),
u AS (SELECT translate(lemma, 'əöüğçş', 'eougcs') AS plain, count(*) AS n, min(lemma) AS lemma FROM d GROUP BY 1),
p AS (SELECT DISTINCT translate(lemma, 'əöüğçş', 'eougcs') AS word FROM d)
SELECT word, CASE WHEN n = 1 AND len(regexp_replace(word, '[^eougcs]', '', 'g')) <= 10 AND u.lemma <> word
             AND NOT regexp_matches(word, '[əöüğçş]') THEN u.lemma ELSE word END AS restored
FROM p LEFT JOIN u ON word = plain
""")
def diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked words of the documents, their marks taken away and restored."""
    lemmas = _document_words(spark, sf_dir).select(F.col("stem").alias("lemma")).where("lemma rlike '[öüç]'").distinct()
    return lexical.restore_diacritics(lemmas.select(lexical.folded(F.col("lemma")).alias("word")), lemmas)


@query(f"""
WITH w AS ({_DOCUMENT_WORDS}), f AS (SELECT stem, count(*) AS freq FROM w GROUP BY stem),
c AS (SELECT doc_id, stem, count(*) AS count FROM w GROUP BY doc_id, stem),
s AS (SELECT doc_id, c.stem, c.count,
        round(c.count / sum(c.count) OVER (PARTITION BY doc_id) * ln((SELECT sum(freq) FROM f) / (1 + f.freq)), 9) AS score
      FROM c JOIN f ON c.stem = f.stem)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, stem) AS INTEGER) AS rank, stem, score, count FROM s QUALIFY rank <= 5
""")
def keywords_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _document_words(spark, sf_dir)
    return lexical.tfidf(stems, stems.groupBy("stem").agg(F.count("*").alias("freq")), 5)


@query()
def keywords_textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-zöüçéèß]{2,}"), F.lit(0)).alias("stems"))
    return lexical.textrank(docs, 5)


def _sentences_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    words = F.array(F.lit("kitab"), _pick([w for w, _ in LEXICON], key), _pick(["deyil", "idi", "və"], key), _pick([w for w, _ in LEXICON], key + 2))
    return _table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.posexplode(words).alias("pos", "stem"))


@query(f"""
WITH w AS (SELECT o_orderkey AS doc_id, unnest(range(4)) AS pos,
             ['kitab', {_sql_pick([w for w, _ in LEXICON], 'o_orderkey')}, {_sql_pick(['deyil', 'idi', 'və'], 'o_orderkey')},
              {_sql_pick([w for w, _ in LEXICON], '(o_orderkey + 2)')}] AS s FROM orders),
n AS (SELECT doc_id, s[pos + 1] AS stem, s[pos + 2] AS next FROM w),
l AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {v})" for w, v in LEXICON)}) AS t(stem, value)),
v AS (SELECT doc_id, CASE WHEN n.stem <> 'deyil' THEN CASE WHEN next = 'deyil' THEN -value ELSE CAST(value AS DOUBLE) END END AS x FROM n LEFT JOIN l ON n.stem = l.stem),
t AS (SELECT doc_id, round(coalesce(avg(CAST(x AS DOUBLE)), 0.0), 9) AS score, count(*) FILTER (WHERE x > 0) AS positive, count(*) FILTER (WHERE x < 0) AS negative, count(*) AS total FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment, score, positive, negative, total FROM t
""")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "stem string, score double")
    return lexical.sentiment(_sentences_of_keys(spark, sf_dir), lexicon)


SEED = "kitab ev gəl gözəl su ana baba gün gecə sevgi dəniz alma yaz oxu dost məktəb burun oğul ağız kənd"


@query()
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of inflected words made from keys."""
    dictionary = spark.createDataFrame([(w,) for w in SEED.split()], "lemma string")
    key = F.col("p_partkey")
    word = F.concat(_pick(SEED.split(), key), _pick(["", "lar", "da", "ım", "lardan", "çı", "mı"], key))
    made = _table(spark, sf_dir, "part").select(word.alias("word"))
    return morphology.analyse_words(made, dictionary).select("word", "stem", "inflected", F.size("analyses").alias("n_analyses"))


@query()
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents without its third letter, and the three best of what it may have been."""
    freq = settled(_document_words(spark, sf_dir).groupBy(F.col("stem").alias("word")).agg(F.count("*").alias("freq")))
    wrong = freq.select(F.concat(F.col("word").substr(1, 2), F.expr("substring(word, 4)")).alias("word"))
    return lexical.suggestions(wrong, freq, top=3)


def _vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    words = SEED.split()
    lemmas = spark.createDataFrame([(w,) for w in words], "lemma string")
    return lemmas, spark.createDataFrame([(w, 100 + i) for i, w in enumerate(words)], "word string, freq long")


def _texts_of_keys(spark: SparkSession, sf_dir: str, *choices: list[str]) -> DataFrame:
    """A text of chosen words between its key and an address, for every order."""
    key = F.col("o_orderkey")
    parts = [_pick(words, key + 3 * i) for i, words in enumerate(choices)]
    text = F.concat(key.cast("string"), F.lit(": "), F.concat_ws(", ", *parts), F.lit(" – a.b@c.az"))
    return _table(spark, sf_dir, "orders").select(key, text.alias("text"))


def _sql_texts(*choices: list[str]) -> str:
    parts = " || ', ' || ".join(_sql_pick([w.replace("'", "''") for w in words], f"(o_orderkey + {3 * i})") for i, words in enumerate(choices))
    return f"SELECT o_orderkey, o_orderkey || ': ' || {parts} || ' – a.b@c.az' AS text FROM orders"


@query(_sql_texts(["Gözəl", "DƏNİZ", "kənd-məktəb", "ağız'ın", "naməlum"], ["su", "gün", "gecə", "oğul"]))
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose marks were left out; each word has one spelling in the dictionary or stays."""
    made = _texts_of_keys(spark, sf_dir, ["Gozel", "DENİZ", "kend-mekteb", "agız'ın", "naməlum"], ["su", "gun", "gece", "ogul"])
    done = texts.normalize_texts(made, "o_orderkey", "text", _vocabulary(spark)[0])
    return done.select("o_orderkey", F.col("normalized").alias("text"))


@query(_sql_texts(["kitab", "KİTAB", "Ketab", "kitablardan", "qqqqqqqq"], ["dəniz", "məktəb", "su", "alma"]))
def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words, in capitals and with suffixes too; a name and a word without a near one stay."""
    made = _texts_of_keys(spark, sf_dir, ["ketab", "KETAB", "Ketab", "ketablardan", "qqqqqqqq"], ["dənizz", "məkətb", "su", "alma"])
    done = texts.correct_texts(made, "o_orderkey", "text", *_vocabulary(spark))
    return done.select("o_orderkey", F.col("corrected").alias("text"))


@query(f"""
SELECT unnest(['kitablar', 'Dənizdən', 'gozel', 'xyzw', 'ev-xyzw', 'ev-kitab', 'x9yz', 'məktəb''in', 'q']) AS word,
       unnest([TRUE, TRUE, TRUE, FALSE, FALSE, TRUE, TRUE, TRUE, TRUE]) AS correct
""")
def checked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["kitablar", "Dənizdən", "gozel", "xyzw", "ev-xyzw", "ev-kitab", "x9yz", "məktəb'in", "q"]
    made = _table(spark, sf_dir, "orders").select(_pick(words, F.col("o_orderkey")).alias("word"))
    return texts.check_words(made, *_vocabulary(spark))


_KEYED, _STEMS = ["kitablardan", "Dənizdə", "gozel", "evlər"], ["kitab", "dəniz", "gözəl", "ev"]


@query(f"""
WITH s AS (SELECT o_orderkey, [{_sql_pick(_STEMS, 'o_orderkey')}, {_sql_pick(_STEMS, '(o_orderkey + 1)')}, {_sql_pick(_STEMS, 'o_orderkey')}] AS s FROM orders)
SELECT o_orderkey, CAST(unnest([0, 4, 6]) AS INTEGER) AS pos, unnest(s) AS stem FROM s
""")
def keyword_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the words of a text, normalised, without function words."""
    key = F.col("o_orderkey")
    text = F.concat_ws(" ", _pick(_KEYED, key), F.lit("və"), _pick(_KEYED, key + 1), _pick(_STEMS, key))
    made = _table(spark, sf_dir, "orders").select(key, text.alias("text"))
    return texts.keyword_stems(made, "o_orderkey", "text", _vocabulary(spark)[0]).select("o_orderkey", "pos", "stem")


def _sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _sentences_of_keys(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("w"))
    return parts.select("doc_id", F.concat_ws(" ", F.transform("w", lambda p: p["stem"])).alias("text"))


@query(ORACLE_SQL["sentiment"])
def sentiment_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the query ``sentiment`` as texts, from which tokens and stems are taken."""
    lexicon = spark.createDataFrame(LEXICON, "stem string, score double")
    dictionary = spark.createDataFrame([(w,) for w in [*SEED.split(), *[w for w, _ in LEXICON], "deyil", "idi", "və"]], "lemma string")
    return texts.sentiment_of_texts(_sentence_texts(spark, sf_dir), "doc_id", "text", dictionary, lexicon)


_FLAWS = [
    (" su", 100, "", ""), ("  su", 97, "punctuation", "multiple spaces"), (" , su", 97, "punctuation", "space before punctuation"),
    (".Su", 97, "punctuation", "missing space after punctuation"), ("!!", 99, "punctuation", "repeated punctuation"), ("...", 100, "", ""),
    (" k\u0456tab", 90, "layout", quality.TWIN), (" \u0442\u0434\u0436", 99, "mixed_script", quality.FOREIGN),
]


@query(f"""
WITH f AS (SELECT o_orderkey, CAST(o_orderkey % {len(_FLAWS)} AS INTEGER) + 1 AS i FROM orders)
SELECT o_orderkey, CAST({[x[1] for x in _FLAWS]}[i] AS INTEGER) AS score, {[x[2] for x in _FLAWS]}[i] AS type, {[x[3] for x in _FLAWS]}[i] AS message FROM f
""")
def flawed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with one flaw or none: its score and issue."""
    text = F.concat(F.lit("Bu gözəl kitab məktəbdədir"), _pick([x[0] for x in _FLAWS], F.col("o_orderkey")))
    judged = quality.validate(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text")
    joined = lambda field: F.array_join(F.transform("issues", lambda i: i[field]), ",")
    return judged.select("o_orderkey", "score", joined("type").alias("type"), joined("message").alias("message"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN '2 saat' END AS text,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS time,
       CASE WHEN o_orderkey % 3 = 1 THEN 7200 END AS duration_s, CASE WHEN o_orderkey % 3 = 2 THEN 'unrecognized input' END AS error FROM orders
""")
def parsed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One moment, duration or error of each text."""
    key = F.col("o_orderkey") % 3
    text = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, "2 saat").otherwise("heç nə")
    made = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.alias("t"))
    found = datetimes.with_moment(made, "t", "o_orderdate")
    return found.select("o_orderkey", "moment.text", "moment.time", "moment.duration_s", F.col("moment_error").alias("error"))


@query(f"""
SELECT word, CASE word {' '.join(f"WHEN '{w}' THEN '{p}'" for w, p in [('kitab', 'N'), ('gəl', 'V'), ('gözəl', 'A')])} END AS pos
FROM (SELECT DISTINCT {_sql_pick(['kitab', 'gəl', 'gözəl', 'naməlum'], 'o_orderkey')} AS word FROM orders)
""")
def stem_parts_of_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = spark.createDataFrame([("N", "kitab"), ("V", "gəl"), ("A", "gözəl"), ("V", "kitab")], "pos string, lemma string")
    made = _table(spark, sf_dir, "orders").select(_pick(["kitab", "gəl", "gözəl", "naməlum"], F.col("o_orderkey")).alias("word"))
    return morphology.stem_parts_of_speech(made, dictionary)


@query(f"""
WITH s AS (SELECT o_orderkey, {_sql_pick(['kitab', 'gözəl kitab', 'pis kitab', 'gözəl pis', '12 %'], 'o_orderkey')} AS t FROM orders)
SELECT o_orderkey, CASE WHEN t = 'pis kitab' THEN 'negative' WHEN contains(t, 'gözəl') THEN 'positive' ELSE 'neutral' END AS predicted FROM s
""")
def predicted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of reviews by the lexicon; marks are left out in the texts and restored, suffixes cut."""
    made = _table(spark, sf_dir, "orders").select("o_orderkey", _pick(["kitablar", "gozel kitabda", "pis kitab", "gözəl pis", "12 %"], F.col("o_orderkey")).alias("text"))
    dictionary = spark.createDataFrame([("kitab",), ("gözəl",), ("pis",)], "lemma string")
    stems = jobs.review_stems(made, "o_orderkey", "text", dictionary)
    return jobs.predicted_classes(made, "o_orderkey", stems, spark.createDataFrame(LEXICON, "stem string, score double"))


@query("""
WITH t AS (SELECT lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')) AS s FROM conversations),
n AS (SELECT sum(len(regexp_extract_all(s, '[a-z]+'))) AS w, sum(len(regexp_extract_all(s, ' +'))) AS b FROM t),
k AS (SELECT unnest(['Word', 'Number', 'Punctuation', 'Space', 'Symbol', 'URL', 'Email']) AS type)
SELECT type, CAST(CASE type WHEN 'Word' THEN w WHEN 'Space' THEN b ELSE 0 END AS BIGINT) AS n,
       round(CASE type WHEN 'Word' THEN 100.0 * w / (w + b) WHEN 'Space' THEN 100.0 * b / (w + b) ELSE 0.0 END, 1) AS percent FROM k, n
""")
def token_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.lower(F.regexp_replace("text", "[^A-Za-z ]", " "))
    return jobs.token_type_shares(_table(spark, sf_dir, "conversations").select(plain.alias("value")))


@query(f"""
WITH t AS (SELECT p_partkey, {_sql_pick(WORDS, 'p_partkey')} AS a, {_sql_pick(WORDS, '(p_partkey + p_partkey // 10)')} AS b FROM part),
x AS (SELECT DISTINCT a, b, hex(encode(a)) AS p, hex(encode(b)) AS q FROM t),
y AS (SELECT *, list_min(list_filter(range(0, least(len(p), len(q)) // 2 + 1), lambda i: i = least(len(p), len(q)) // 2 OR p[2 * i + 1 : 2 * i + 2] <> q[2 * i + 1 : 2 * i + 2])) AS i FROM x WHERE a <> b)
SELECT a, b, CAST(i AS INTEGER) AS pos, rpad(q[2 * i + 1 : 2 * i + 2], 2, '0') AS got, rpad(p[2 * i + 1 : 2 * i + 2], 2, '0') AS want FROM y
""")
def first_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pairs of words part."""
    key = F.col("p_partkey")
    pairs = _table(spark, sf_dir, "part").select(_pick(WORDS, key).alias("a"), _pick(WORDS, key + F.floor(key / 10)).alias("b")).distinct()
    return pairs.where("a != b").select("a", "b", jobs.first_divergence(F.col("a"), F.col("b")).alias("d")).select("a", "b", "d.*")


@query()
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.validate(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return judged.select("doc_id", "score", F.size("issues").alias("n_issues"), quality.is_valid(F.col("issues")).alias("valid"))


@query("""
SELECT CASE WHEN o_totalprice < 100000 THEN 'negative' WHEN o_totalprice < 200000 THEN 'neutral' ELSE 'positive' END AS actual,
       CASE WHEN o_orderkey % 5 < 2 THEN 'negative' WHEN o_orderkey % 5 < 3 THEN 'neutral' ELSE 'positive' END AS predicted, count(*) AS n
FROM orders GROUP BY 1, 2
""")
def review_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("o_totalprice") < 100000, 1).when(F.col("o_totalprice") < 200000, 3).otherwise(5)
    rows = _table(spark, sf_dir, "orders").select(
        jobs.review_class(rating).alias("actual"), jobs.review_class(F.col("o_orderkey") % 5 + 1).alias("predicted")
    )
    return jobs.confusion(rows)


@query("""
WITH c AS (
  SELECT CASE WHEN o_totalprice < 100000 THEN 'negative' WHEN o_totalprice < 200000 THEN 'neutral' ELSE 'positive' END AS a,
         CASE WHEN o_orderkey % 5 < 2 THEN 'negative' WHEN o_orderkey % 5 < 3 THEN 'neutral' ELSE 'positive' END AS p FROM orders),
k AS (SELECT DISTINCT a AS class FROM c UNION SELECT DISTINCT p FROM c),
m AS (SELECT class, (SELECT count(*) FROM c WHERE a = class AND p = class) AS tp, (SELECT count(*) FROM c WHERE a = class) AS na,
             (SELECT count(*) FROM c WHERE p = class) AS np FROM k),
r AS (SELECT class, round(coalesce(tp / nullif(np, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(na, 0), 0.0), 6) AS recall FROM m)
SELECT class, precision, recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r
""")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.class_metrics(review_confusion(spark, sf_dir))


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, stem FROM ({_DOCUMENT_WORDS})),
k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'positive' WHEN doc_id % 3 = 1 THEN 'negative' ELSE 'neutral' END AS class FROM documents),
t AS (SELECT CAST(count(*) FILTER (WHERE class = 'positive') AS DOUBLE) AS ap, CAST(count(*) FILTER (WHERE class = 'negative') AS DOUBLE) AS an FROM k),
n AS (SELECT stem, CAST(count(*) FILTER (WHERE class = 'positive') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE class = 'negative') AS DOUBLE) AS b, count(*) FILTER (WHERE class = 'neutral') AS neu FROM w JOIN k USING (doc_id) GROUP BY stem),
g AS (SELECT stem, a, b, neu, ap - a AS c, an - b AS d FROM n, t WHERE a + b + neu >= 10 AND greatest(a, b) >= 5),
x AS (SELECT stem, a, b, neu, round(2 * ({' + '.join(f"(CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END)" for v in 'abcd')}
  - ({' + '.join(f"(CASE WHEN {v} > 0 THEN ({v}) * ln({v}) ELSE 0 END)" for v in ('(a+b)', '(c+d)', '(a+c)', '(b+d)'))}) + (a+b+c+d) * ln(a+b+c+d)), 4) AS llr FROM g)
SELECT CAST(row_number() OVER (ORDER BY llr DESC, stem) AS INTEGER) AS rank, stem, CAST(a AS BIGINT) AS pos, CAST(b AS BIGINT) AS neg, neu, llr,
       round(round((a - b) / (a + b) * 0.9 / 0.05) * 0.05, 2) AS score FROM x WHERE llr >= 10.83 ORDER BY llr DESC, stem LIMIT 500
""")
def lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _document_words(spark, sf_dir)
    key = F.col("doc_id") % 3
    classes = _table(spark, sf_dir, "documents").select("doc_id", F.when(key == 0, "positive").when(key == 1, "negative").otherwise("neutral").alias("class"))
    return jobs.mine_lexicon(stems, classes, spark.createDataFrame([], "stem string"))


@query("""
WITH r AS (SELECT turn, conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content FROM conversations WHERE text IS NOT NULL)
SELECT content, min(conv_id * 100 + turn) % 5 + 1 AS score FROM r WHERE len(content) >= 10 GROUP BY content
""")
def cleaned_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("conv_id") * 100 + F.col("turn")
    rows = _table(spark, sf_dir, "conversations").select(F.col("text").alias("content"), (at % 5 + 1).alias("score"), at.alias("at"))
    return jobs.clean_reviews(rows, "at")


@query()
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _document_words(spark, sf_dir).select(F.col("stem").alias("word")).distinct()
    return jobs.build_dictionary(words.select("word", _pick(["noun", "verb", "adj", "suffix"], F.length("word")).alias("pos")))


@query("""
WITH w AS (SELECT lower(translate(unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')), 'Iİ', 'ıi')) AS word FROM benchmark)
SELECT word, count(*) AS freq FROM w GROUP BY word HAVING count(*) >= 50
""")
def frequency_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_replace("text", "[^A-Za-z]", " ")).alias("value"))
    return jobs.word_frequencies(corpus, spark.createDataFrame([], "word string, stem string"))


@query("SELECT lang AS file, sum(strlen(text)) AS bytes, TRUE AS rebuilt, count(*) FILTER (WHERE text <> '') AS paragraphs FROM documents GROUP BY lang")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _table(spark, sf_dir, "documents").select(F.col("lang").alias("file"), F.col("text").alias("value"))
    return jobs.corpus_report(corpus).select("file", "bytes", "rebuilt", "paragraphs")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
