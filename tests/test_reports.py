import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sozlab.functions import display, entities, tokens
from sozlab.operators import chunks, datetimes, lexical, morphology, quality
from sozlab.plans import jobs
from sozlab.sources import reports, vocabularies


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_debug_forms(spark):
    shown = lambda items, form: _one(spark, F.transform(items, form))
    assert shown(tokens.word_tokens(F.lit("Şən 5!")), display.token) == ['Word("Şən")[0:5]', 'Space(" ")[5:6]', 'Number("5")[6:7]', 'Punctuation("!")[7:8]']
    assert shown(tokens.word_tokens(F.lit('"\n\\')), display.token)[:2] == ['Punctuation("\\"")[0:1]', 'Space("\\n")[1:2]']
    assert shown(entities.recognize(F.lit("FIN: AB12345, 0501234567")), display.entity) == ['FIN("AB12345")[5:12,labeled]', 'Phone("0501234567")[14:24]']
    assert shown(tokens.chunks_by_size(F.lit("əbc"), 5, 0), display.chunk) == ["Chunk(0)[0:4](4 bytes)"]
    made = F.struct(F.lit("kitab").alias("stem"), F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(t).alias("tag")) for s, t in (("lar", "Plural"), ("dan", "CaseAbl"))]).alias("morphemes"))
    assert _one(spark, display.analysis(made)) == "kitab[Plural:lar|CaseAbl:dan]" and _one(spark, display.suffixes(made)) == "lardan"
    bare = F.struct(F.lit("ev").alias("stem"), F.filter(made["morphemes"], lambda m: F.lit(False)).alias("morphemes"))
    assert _one(spark, display.analysis(bare)) == "ev"
    assert _one(spark, display.sentiment(F.lit("Positive"), F.lit(0.5), F.lit(1), F.lit(0), F.lit(2))) == "Positive(score=0.50, pos=1, neg=0, total=2)"
    assert [_one(spark, display.parts(F.lit(m))) for m in (7, 56, 0, 63)] == ["YMD", "hms", "none", "YMDhms"]


def test_names_go_both_ways(spark):
    for kind, names in display.NAMES.items():
        first = display.FIRST.get(kind, 0)
        got = [_one(spark, display.named(kind, F.lit(first + i))) for i in range(len(names))]
        assert got == names and [_one(spark, display.from_name(kind, F.lit(n))) for n in names] == list(range(first, first + len(names)))
        assert _one(spark, display.from_name(kind, F.lit("?"))) is None and _one(spark, display.named(kind, F.lit(99))) is None
    assert json.loads(_one(spark, display.json(tokens.word_tokens(F.lit("a"))))) == [{"text": "a", "start": 0, "end": 1, "type": "Word"}]


def test_moments_and_default_chunks(spark):
    frame = spark.createDataFrame([(1, "5 mart 2026"), (2, ""), (3, None), (4, "heç nə"), (5, "x" * ((1 << 20) + 1))], "id long, t string").withColumn("ref", F.lit("2026-02-20").cast("timestamp_ntz"))
    got = {r.id: (r.moment and (r.moment.text, str(r.moment.time)), r.moment_error) for r in datetimes.with_moment(frame, "t", "ref").collect()}
    assert got == {
        1: (("5 mart 2026", "2026-03-05 00:00:00"), None), 2: (None, "empty input"), 3: (None, "empty input"), 4: (None, "unrecognized input"),
        5: (None, "input exceeds 1048576 bytes"),
    }
    text = "Bir cümlə budur. " * 100
    rows = chunks.with_chunk_texts(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t").collect()
    assert "".join(rows[0].chunks) == text and all(len(c) <= 512 for c in rows[0].chunks) and rows[1].chunks is None and rows[2].chunks is None


@pytest.mark.parametrize(
    "words, script, want",
    [
        ([" ", " x"], None, []),
        (["  ", "söz"], "Latn", ["multiple spaces"]),
        (["söz", " \n ", "söz"], "Latn", ["multiple spaces"]),
        ([" ", ",", "söz"], "Latn", ["space before punctuation"]),
        (["söz", "!", "!", "söz"], "Latn", ["repeated punctuation", "missing space after punctuation"]),
        (["(", "("], "Latn", ["repeated punctuation"]),
        ([".", ".", "."], "Latn", []),
        ([".", ".", ".", "."], "Latn", ["repeated punctuation"]),
        (["мама"], "Latn", [quality.TWIN, quality.FOREIGN]),
        (["сор"], "Latn", [quality.TWIN]),
        (["тдж"], "Latn", [quality.FOREIGN]),
        (["кitab"], "Latn", []),
        (["китaб"], "Cyrl", [quality.TWIN]),
        (["https://a.az", ".", "x@y.az"], "Latn", []),
    ],
)
def test_issues_of_tokens(words, script, want):
    assert [i["message"] for i in quality.issues(words, script, 0.9)[1]] == want


def test_reports_of_jobs(spark, tmp_path):
    stems = [(i, "yaxşı" if i < 30 else "pis") for i in range(60)] + [(i, "və") for i in range(60)]
    classes = [(i, "positive" if i < 30 else "negative" if i < 55 else "neutral") for i in range(60)]
    candidates = jobs.mine_lexicon(
        spark.createDataFrame(stems, "doc_id long, stem string"), spark.createDataFrame(classes, "doc_id long, class string"), spark.createDataFrame([], "stem string")
    )
    assert [(r.rank, r.stem, r.pos, r.neg, r.neu, r.score) for r in candidates.collect()] == [(1, "pis", 0, 25, 5, -0.9), (2, "yaxşı", 30, 0, 0, 0.9)]
    reports.write_candidates(candidates, f"{tmp_path}/candidates")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/candidates").collect()]
    assert lines[0].startswith("# ") and lines[2].startswith("pis\t-0.90\t0\t25\t5\t30\t") and len(lines) == 4
    assert [r.stem for r in vocabularies.lexicon(spark, f"{tmp_path}/candidates").collect()] == []
    matrix = jobs.confusion(spark.createDataFrame([("positive", "positive")] * 3 + [("negative", "neutral")], "actual string, predicted string"))
    shown = reports.evaluation(matrix, jobs.class_metrics(matrix), candidates, 7)
    assert shown[2] == "Dataset: 4 reviews (3 positive, 1 negative, 0 neutral)" and shown[3] == "Lexicon: 7 entries" and "Accuracy: 75.00%" in shown
    assert "Actual Pos        3     0     0" in shown and "Positive: P=1.00 R=1.00 F1=1.00" in shown and "Negative: P=0.00 R=0.00 F1=0.00" in shown
    reports.write_lines(spark, shown, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == shown


def test_corpus_lines_and_failures(spark):
    corpus = spark.createDataFrame([("f", "Salam dünya."), ("f", ""), ("g", "Бакы")], "file string, value string")
    totals = jobs.corpus_totals(jobs.corpus_report(corpus))
    assert totals.first().asDict() == {
        "files": 2, "bytes": 21, "rebuilt": 2, "not_rebuilt": 0, "outliers": 0, "cyrillic": 1, "translit_rebuilt": 1, "translit_not_rebuilt": 0,
    }
    lines = reports.corpus_lines(totals, jobs.token_type_shares(corpus))
    assert "Files scanned:           2" in lines and "  Word:           3  (60.0%)" in lines and "  URL:            0  (0.0%)" in lines
    assert jobs.reconstruction_failures(corpus).count() == 0
    pairs = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("abc", "ab"), ("", "x"), ("ə", "ı"), ("a", "a"), (None, "a")], "a string, b string")
    got = [tuple(r.d) if r.d else None for r in pairs.select(jobs.first_divergence(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [(2, "64", "63"), (2, "63", "00"), (2, "00", "63"), (0, "78", "00"), (0, "C4", "C9"), None, None]


def test_arrow_and_json_files(spark, tmp_path):
    table = pa.table({"score": pa.array([1, 5, None], pa.int64()), "content": ["pis", None, "əla"], "more": [1.0, 2.0, 3.0]})
    for n in range(2):
        with pa.OSFile(f"{tmp_path}/{n}.arrow", "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=2)
    rows = vocabularies.arrow_streams(spark, f"{tmp_path}/*.arrow", "content string, score int").collect()
    assert sorted(map(str, rows)) == sorted(2 * ["Row(content='pis', score=1)", "Row(content=None, score=5)", "Row(content='əla', score=None)"])
    (tmp_path / "golden.json").write_text(json.dumps([{"name": "a", "results": [{"text": "x"}]}, {"name": "b", "results": None}]))
    got = vocabularies.json_records(spark, f"{tmp_path}/golden.json", "name string, results array<struct<text:string>>").collect()
    assert [(r.name, r.results and r.results[0].text) for r in got] == [("a", "x"), ("b", None)]


def test_suggestions_match_brute_force(spark):
    terms = ["kitab", "kitabın", "ev", "evlər", "dəniz", "dənizçi", "a", "ab", "abc", "məktəbəqədərki", "məktəbəqədər"]
    asked = ["ktab", "kitba", "e", "ve", "evlr", "dəni", "məktəbəqədəki", "xxxxx", "ab", "Kitab"]
    freq = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "word string, freq long")
    got = {(r.word, r.term, r.distance) for r in lexical.suggestions(spark.createDataFrame([(a,) for a in asked], "word string"), freq).collect()}
    want = {(a.lower(), t, lexical.alignment_distance(a.lower(), t)) for a in asked for t in terms if len(a) > 1}
    near = {w for w in want if w[2] <= 2 and (w[0] not in terms or w[0] == w[1])}  # a term has no other suggestion
    assert got <= near and {w for w in near if min(len(w[0]), len(w[1])) > 3} <= got


def test_first_letter_of_a_lemma_counts(spark):
    dictionary = spark.createDataFrame([("V", "yaz", 0), ("N", "yaz", 1), ("A", "ağ", 2)], "pos string, lemma string, ord int")
    words = spark.createDataFrame([("yaz",), ("ağ",), ("yox",), ("",), (None,)], "word string")
    assert {r.word: r.pos for r in morphology.stem_parts_of_speech(words, dictionary).collect()} == {"yaz": "V", "ağ": "A", "yox": None}
