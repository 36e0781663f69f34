from sozlab.llm import neardup

COLUMNS = "doc_id long, text string, rank_id string, row int"
A, B, C = ("alpha beta gamma delta epsilon", "one two three four five six", "another text of its own words")


def test_one_row_of_each_group_stays(spark):
    rows = [(3, A), (5, A), (5, B), (7, C), (7, C), (None, C), (None, "no id at all here"), (None, "no id at all here"), (9, ""), (10, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], COLUMNS)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, A), (5, B), (7, C), (None, "no id at all here"), (9, ""), (9, ""), (10, None)], key=str)
    decided = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert {(3, 2, 3, True), (5, 2, 3, False), (5, 3, 5, True), (None, 3, 7, False), (9, 0, 9, True)} <= decided
    assert neardup.deduplicated(docs.limit(0)).count() == 0
