import pytest
from pyspark.sql import functions as F

from sozlab.functions import casing, detect, entities, numbers, tokens, translit


@pytest.fixture
def one(spark):
    def evaluate(value, column, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y

    return evaluate


@pytest.mark.parametrize(
    "text, low, high", [("İSTANBUL", "istanbul", "İSTANBUL"), ("ışıq", "ışıq", "IŞIQ"), ("straße", "straße", "STRAßE"), ("ΣΑΣ", "σασ", "ΣΑΣ"), ("", "", ""), (None, None, None)]
)
def test_case_mapping(one, text, low, high):
    assert one(text, casing.az_lower) == low and one(text, casing.az_upper) == high


def test_case_patterns(one):
    assert one("KİTAB", lambda c: casing.apply_case(c, F.lit("ilma"))) == "İLMA"
    assert one("Kitab", lambda c: casing.apply_case(c, F.lit("ilma"))) == "İlma"
    assert one("kitab", lambda c: casing.apply_case(c, F.lit("ilma"))) == "ilma"
    assert not one("K", casing.is_title_case) and one("Kitab", casing.is_title_case)
    assert one("öüş", casing.compose_nfc) == "öüş"


def test_transliteration(one):
    assert one("Азәрбајҹан", translit.cyrillic_to_latin) == "Azərbaycan"
    assert one("Гара гим", translit.cyrillic_to_latin) == "Qara gim"
    assert one("Ҝүн гим", translit.cyrillic_to_latin) == "Gün qim"
    assert one("объект", translit.cyrillic_to_latin) == "obekt"
    assert one("Qarabağ", translit.latin_to_cyrillic) == "Гарабағ"


@pytest.mark.parametrize(
    "n, words",
    [(0, "sıfır"), (7, "yeddi"), (100, "yüz"), (211, "iki yüz on bir"), (1001, "min bir"), (-5, "mənfi beş"), (10**6, "bir milyon"),
     (10**18, "bir kvintilyon"), (10**18 + 1, ""), (None, None)],
)
def test_numbers_to_words_and_back(one, n, words):
    assert one(n, numbers.to_words, "long") == words
    if words:
        assert one(words, numbers.parse_words) == n


def test_ordinals_and_invalid_words(one):
    assert [one(w, numbers.ordinal_of) for w in ("altı", "üç", "on", "dörd")] == ["altıncı", "üçüncü", "onuncu", "dördüncü"]
    assert [one(w, numbers.parse_words) for w in ("bir sıfır", "mənfi", "", "birinci", "yüz " * 12)] == [None] * 5


def test_decimals(spark):
    cases = {"3.14": "üç tam yüzdə on dörd", "-0,5": "mənfi sıfır tam onda beş", ".5": "sıfır tam onda beş", "-0.0": "sıfır tam onda sıfır",
             "1.": "", "a": "", "+7": "yeddi", "12.0045": "on iki tam on mində qırx beş"}
    rows = numbers.with_decimal_words(spark.createDataFrame([(c,) for c in cases], "s string"), "s", "w").collect()
    assert {r.s: r.w for r in rows} == cases
    digits = numbers.with_decimal_words(spark.createDataFrame([("3.05",)], "s string"), "s", "w", "digit").first().w
    assert digits == "üç vergül sıfır beş"


def test_tokens_tile_and_have_types(one):
    text = "Salam! 3.14 və 5km COVID-19 a--b user@mail.az https://a.az/x. O'nun $"
    found = one(text, tokens.word_tokens)
    assert "".join(t.text for t in found) == text and found[-1].end == len(text.encode())
    kinds = {t.text: t.type for t in found}
    assert kinds["COVID-19"] == "Word" and kinds["user@mail.az"] == "Email" and kinds["https://a.az/x"] == "URL" and kinds["$"] == "Symbol"
    assert kinds["--"] == "Punctuation" and kinds["5"] == "Number" and one("", tokens.word_tokens) is None


def test_sentences(one):
    assert one("Prof. Əliyev gəldi. Bakıya getdi.", tokens.sentences) == ["Prof. Əliyev gəldi.", " Bakıya getdi."]
    assert one("A.\n\nB", tokens.sentences) == ["A.", "\n\n", "B"]


def test_size_chunks(one):
    got = one("ə" * 25, lambda c: tokens.chunks_by_size(c, 10, 0))
    assert [(c.start, c.end) for c in got] == [(0, 20), (20, 50)]


def test_languages(spark):
    cases = {"Azərbaycan gözəl ölkədir": "az", "Hello there my friend": "en", "Это русский язык, мы": "ru", "qısa": ""}
    rows = detect.with_languages(spark.createDataFrame([(c,) for c in cases], "s string"), "s").select("s", detect.code(F.col("languages")).alias("c"))
    assert {r.s: r.c for r in rows.collect()} == cases


def test_entities(one):
    found = one("Tel +994 50 123 45 67, FIN: 5ABCD12 və 10-AA-123 (http://a.az/b).", entities.recognize)
    assert [(e.text, e.type, e.labeled) for e in found] == [
        ("+994 50 123 45 67", "Phone", False), ("5ABCD12", "FIN", True), ("10-AA-123", "LicensePlate", False), ("http://a.az/b", "URL", False),
    ]
    assert one("x@y.az", lambda c: entities.texts_of(c, "Email")) == ["x@y.az"] and one("", entities.recognize) is None




def test_offsets_of_long_texts(spark):
    """More tokens and entities than a block of running sums holds; offsets are those of the text's bytes."""
    made = ["şa@b.cc ", "söz, "] * 700
    frame = spark.createDataFrame([("".join(made),)], "t string").select(
        F.transform(entities.recognize(F.col("t")), lambda e: F.struct(e["text"], e["start"], e["end"])).alias("e"),
        F.transform(tokens.word_tokens(F.col("t")), lambda e: F.struct(e["text"], e["start"], e["end"])).alias("w"),
    )
    row, whole = frame.first(), "".join(made).encode()
    assert len(row.e) == 700 and all(whole[a:b].decode() == t == "a@b.cc" for t, a, b in row.e)
    assert all(whole[a:b].decode() == t for t, a, b in row.w) and b"".join(t.encode() for t, _, _ in row.w) == whole
