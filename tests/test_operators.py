from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sozlab.operators import chunks, datetimes, lexical, morphology, quality, texts
from sozlab.plans import jobs

REF = datetime(2026, 2, 20, 10, 30)


@pytest.mark.parametrize(
    "text, want",
    [
        ("sabah", ("sabah", "Date", "2026-02-21 00:00")),
        ("3 gün əvvəl", ("3 gün əvvəl", "Date", "2026-02-17 10:30")),
        ("5 mart 2026 14:30", ("5 mart 2026 14:30", "DateTime", "2026-03-05 14:30")),
        ("martın 15-i", ("martın 15-i", "Date", "2026-03-15 00:00")),
        ("keçən bazar ertəsi", ("keçən bazar ertəsi", "Date", "2026-02-16 00:00")),
        ("gələn cümə", ("gələn cümə", "Date", "2026-02-27 00:00")),
        ("axşam saat 7", ("axşam saat 7", "Time", "2026-02-20 19:00")),
        ("gələn ay", ("gələn ay", "Date", "2026-03-01 00:00")),
        ("tarix 05.03.2026 idi", ("05.03.2026", "Date", "2026-03-05 00:00")),
        ("beş saat əvvəl", ("beş saat əvvəl", "DateTime", "2026-02-20 05:30")),
        ("32 mart 2026", ("mart 2026", "Date", "2026-03-01 00:00")),
    ],
)
def test_datetimes(text, want):
    (r,) = datetimes.extract(text, REF)
    assert (r["text"], r["type"], r["time"].strftime("%Y-%m-%d %H:%M")) == want


def test_durations_and_nothing():
    (r,) = datetimes.extract("2 saat 30 dəqiqə", REF)
    assert (r["type"], r["duration_s"]) == ("Duration", 9000)
    assert datetimes.extract("abc 25:99 2026-02-30", REF) == [] and datetimes.extract("", REF) is None and datetimes.extract("sabah", None) is None


def test_stems(spark):
    dictionary = spark.createDataFrame([("kitab",), ("gəl",), ("oğul",), ("yaz",)], "lemma string")
    words = ["kitablar", "Kitablardan", "gəlməyəcək", "oğlum", "kitab", "bilinməz-kitabda", "Bakı'nın", None]
    got = {r.word: r.stem for r in morphology.analyse_words(spark.createDataFrame([(w,) for w in words], "word string"), dictionary).collect()}
    assert got["kitablar"] == "kitab" and got["Kitablardan"] == "Kitab" and got["oğlum"] == "oğul" and got["kitab"] == "kitab"
    assert got["Bakı'nın"] == "Bakı" and got["bilinməz-kitabda"].endswith("-kitab") and None not in got


def test_diacritics(spark):
    dictionary = spark.createDataFrame([("gözəl",), ("üç",), ("uç",), ("ev",)], "lemma string")
    words = spark.createDataFrame([("Gozel",), ("uc",), ("ev",), ("gözel",)], "word string")
    got = {r.word: r.restored for r in lexical.restore_diacritics(words, dictionary).collect()}
    assert got == {"Gozel": "Gözəl", "uc": "uc", "ev": "ev", "gözel": "gözel"}


def test_suggestions_match_brute_force(spark):
    terms = ["kitab", "kitabça", "katib", "dəniz", "gözəl", "məktəb", "universitet", "kənd"]
    freq = spark.createDataFrame([(t, 10 + i) for i, t in enumerate(terms)], "word string, freq long")
    words = ["ketab", "kitba", "dniz", "mektəb", "universtet", "kənd", "xyz"]
    got = {(r.word, r.term): r.distance for r in lexical.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), freq).collect()}
    want = {(w, t): lexical.alignment_distance(w, t) for w in words for t in terms if lexical.alignment_distance(w, t) <= 2}
    assert got == want and lexical.alignment_distance("ca", "abc") == 3 and lexical.alignment_distance("ab", "ba") == 1
    best = {r.word: r.corrected for r in lexical.correct_words(spark.createDataFrame([("dniz",), ("xyz",)], "word string"), freq).collect()}
    assert best == {"dniz": "dəniz", "xyz": "xyz"}


def test_page_ranks():
    ranks = lexical.page_ranks("a b a c a d".split())
    assert max(ranks, key=ranks.get) == "a" and lexical.page_ranks([]) == {} and abs(sum(ranks.values()) - 1) < 0.01


def test_sentiment(spark):
    stems = [(1, "gözəl"), (1, "deyil"), (2, "gözəl"), (2, "pis"), (2, "əla"), (3, "kitab")]
    rows = spark.createDataFrame([(d, i, s) for i, (d, s) in enumerate(stems)], "doc_id long, pos int, stem string")
    lexicon = spark.createDataFrame([("gözəl", 0.9), ("pis", -0.8), ("əla", 1.0)], "stem string, score double")
    got = {r.doc_id: (r.sentiment, r.positive, r.negative, r.total) for r in lexical.sentiment(rows, lexicon).collect()}
    assert got == {1: ("Negative", 0, 1, 2), 2: ("Positive", 2, 1, 3), 3: ("Neutral", 0, 0, 1)}


@pytest.mark.parametrize("text", ["Bir. İki uzun cümlə budur. Üç.\n\nYeni abzas da var burada.", "söz " * 50, "ə" * 95, "A.\n\nB"])
def test_chunks_tile(text):
    for made in (chunks.recursive(text, 20), chunks.by_sentence(text, 30, 0)):
        assert "".join(c["text"] for c in made) == text
        assert [c["start"] for c in made][1:] == [c["end"] for c in made][:-1]
    assert chunks.recursive("", 10) is None and chunks.by_sentence("x", 0, 0) is None


def test_quality():
    score, found = quality.issues(["Salam", "  ", "dünya", " ", ",", "necə", "?", "?"], "Latn", 0.9)
    assert {i["message"] for i in found} == {"multiple spaces", "space before punctuation", "repeated punctuation"} and score == 100 - 3 - 3 - 1
    score, found = quality.issues(["kitаb"], "Latn", 0.9)
    assert found[0]["severity"] == "error" and found[0]["suggestion"] == "kitab" and score == 90
    assert quality.issues(None, None, None) == (100, [])


def test_jobs(spark):
    dump = spark.createDataFrame([("Kitab", "noun"), ("kitablar", "noun"), ("yazmaq", "verb"), ("x", "noun"), ("lar", "suffix"), ("ab1", "noun")], "word string, pos string")
    assert {(r.pos, r.lemma) for r in jobs.build_dictionary(dump).collect()} == {("N", "kitab"), ("V", "yaz")}
    corpus = spark.createDataFrame([("kitab kitablar " * 30,)], "value string")
    stems = spark.createDataFrame([("kitablar", "kitab"), ("evlər", "ev")], "word string, stem string")
    assert {r.word: r.freq for r in jobs.word_frequencies(corpus, stems).collect()} == {"kitab": 60, "ev": 1}
    reviews = spark.createDataFrame([(1, "çox yaxşı məhsul", 5), (2, "çox yaxşı məhsul", 1), (3, "pis", 1)], "at long, content string, score int")
    assert [tuple(r) for r in jobs.clean_reviews(reviews, "at").collect()] == [("çox yaxşı məhsul", 5)]
    report = jobs.corpus_report(spark.createDataFrame([("f", "Salam dünya."), ("f", ""), ("g", "Бакы")], "file string, value string")).collect()
    assert {r.file: (r.words, r.paragraphs, r.rebuilt, r.cyrillic) for r in report} == {"f": (2, 1, True, False), "g": (1, 1, True, True)}


@pytest.mark.parametrize("word, want", [("kіtab", "kitab"), ("Уşaq", "Yşaq"), ("Јalə", "Jalə"), ("kitab", None)])
def test_letters_of_the_other_script(word, want):
    score, found = quality.issues([word], "Latn", 0.9)
    assert [i["suggestion"] for i in found if i["type"] == "layout"] == ([want] if want else []) and (score < 100) == bool(want)


@pytest.fixture(scope="module")
def vocabulary(spark):
    lemmas = ["kitab", "gözəl", "dəniz", "ev", "məktəb", "gəlmək", "uç", "üç"]
    return (
        spark.createDataFrame([(w,) for w in lemmas], "lemma string"),
        spark.createDataFrame([(w, 100 - i) for i, w in enumerate(lemmas)], "word string, freq long"),
    )


def _by_id(frame, column):
    return {r.id: r[column] for r in frame.collect()}


def test_texts_get_their_marks_back(spark, vocabulary):
    rows = [(1, "Gozel ev, GOZEL-deniz; mekteb'in uc ..."), (2, ""), (3, None), (4, "  "), (5, "-".join(["gozel"] * 9)), (6, "go\u0308zəl deniz")]
    got = _by_id(texts.normalize_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", vocabulary[0]), "normalized")
    assert got == {1: "Gözəl ev, GÖZƏL-dəniz; məktəb'in uc ...", 2: "", 3: None, 4: "  ", 5: "-".join(["gozel"] * 9), 6: "gözəl dəniz"}


def test_words_are_checked(spark, vocabulary):
    want = {
        "kitab": True, "Kitablardan": True, "gozel": True, "xyzw": False, "ev-xyzw": False, "ev-kitab": True, "x9yz": True, "q": True,
        "dəniz'xx": True, "xyzw'da": False, "-".join(["zz"] * 9): True, "z" * 300: True,
    }
    words = spark.createDataFrame([(w,) for w in want] + [(None,), ("",)], "word string")
    assert {r.word: r.correct for r in texts.check_words(words, *vocabulary).collect()} == want


def test_texts_are_corrected(spark, vocabulary):
    rows = [(1, "ketab, KETAB Ketab ketablardan 12 dənzi!"), (2, ""), (3, None), (4, "kitab gozel qqqqqqq")]
    got = _by_id(texts.correct_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", *vocabulary), "corrected")
    assert got == {1: "kitab, KİTAB Ketab kitablardan 12 dəniz!", 2: "", 3: None, 4: "kitab gozel qqqqqqq"}


def test_keywords_and_sentiment_of_texts(spark, vocabulary):
    rows = [(1, "Kitablar və kitabda deniz. Gozel dəniz, kitab! O, bu"), (2, "və"), (3, None)]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = _by_id(texts.keywords(frame, "id", "text", vocabulary[0]), "keywords")
    assert list(got) == [1] and set(got[1]) == {"kitab", "dəniz", "gözəl"}
    lexicon = spark.createDataFrame([("gözəl", 1.0), ("ev", -0.5)], "stem string, score double")
    told = spark.createDataFrame([(1, "gözəl kitab"), (2, "gözəl deyil"), (3, "evlər"), (4, "")], "id long, text string")
    got = _by_id(texts.sentiment_of_texts(told, "id", "text", vocabulary[0].union(spark.createDataFrame([("deyil",)], "lemma string")), lexicon), "sentiment")
    assert got == {1: "Positive", 2: "Negative", 3: "Negative"}


def test_unknown_words_are_issues(spark, vocabulary):
    frame = spark.createDataFrame([(1, "kitab gözəl ketab Qqqqq x7xx"), (2, None)], "id long, text string")
    got = {r.id: r for r in quality.validate(frame, "text", "id", *vocabulary).collect()}
    assert [(i.text, i.start, i.type, i.suggestion) for i in got[1].issues] == [("ketab", 14, "spelling", "kitab")]
    assert got[1].score == 90 and got[2].score == 100 and got[2].issues == []
