import duckdb
import pytest

import __spark_entry__ as entry
from sozlab.plans import registry
from sozlab.sources import vocabularies
from sozlab.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_their_sql(spark, sql, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    result = sql.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in frame.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("Nkitab\nbad\n\nVyaz\n")
    (tmp_path / "freq.txt").write_text("kitab 12\niki söz 3\nbroken\n")
    (tmp_path / "lexicon.txt").write_text("# comment\nyaxşı\t0.7\npis\tx\nyaxşı\t0.8\n")
    assert {tuple(r) for r in vocabularies.dictionary(spark, f"{tmp_path}/dict.txt").collect()} == {("N", "kitab"), ("V", "yaz")}
    assert {tuple(r) for r in vocabularies.frequencies(spark, f"{tmp_path}/freq.txt").collect()} == {("kitab", 12), ("iki söz", 3)}
    assert [(r.stem, r.score) for r in vocabularies.lexicon(spark, f"{tmp_path}/lexicon.txt").collect()] == [("yaxşı", 0.7), ("yaxşı", 0.8)]


def test_streams_match_tables(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    counted = streams.windowed_counts(streams.read_stream(spark, f"{tmp_path}/in"), "ts", "event_type", late="100 days")
    run = counted.writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    run.awaitTermination(120)
    last = {(r.start, r.event_type): r.n for r in spark.table("counted").orderBy("n").collect()}
    assert last == {(r.start, r.event_type): r.n for r in streams.windowed_counts(events, "ts", "event_type").collect()}
