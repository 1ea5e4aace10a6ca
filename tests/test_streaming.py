"""Hits from a stream of files, and counts per window."""

from tests.test_extract import SENTENCES, tokens
from verbatlas.operators import extract
from verbatlas.streaming import hits


def test_stream_equals_batch(spark, tmp_path):
    for k, name in enumerate(("vl", "vol", "voo")):
        tokens(spark, name).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert name in SENTENCES and k < 3
    schema = tokens(spark, "vl").schema.simpleString()[7:-1].replace(":", " ")
    q = hits.extracted(hits.token_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.utterance_id, r.construction) for r in spark.read.parquet(str(tmp_path / "out")).where("not extra").collect()}
    assert got == {(r.utterance_id, r.construction) for r in extract.extract(tokens(spark, "vl", "vol", "voo")).where("not extra").collect()}


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 05:00:00", "a")]
    spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) as ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = hits.windowed_counts(stream).writeStream.format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} >= {("a", 2), ("b", 1)}
