import pytest

from tessera.sources import interchange
from tessera.streaming import event_stream


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x,"y"\nz', 1), ("b", None, 2)], "key string, text string, n int")
    for kind in ("parquet", "csv", "jsonl"):
        path = str(tmp_path / f"t.{kind}")
        interchange.write(rows, path)
        back = sorted((r["key"], r["text"], r["n"]) for r in interchange.read(spark, path).collect())
        assert back == [("a", 'x,"y"\nz', 1), ("b", None, 2)]
    with pytest.raises(interchange.ImportError_):
        interchange.format_of("x.txt")


def test_columns(spark):
    rows = spark.createDataFrame([("1", "v", 2), (None, "w", 3)], "_id string, title string, n int")
    assert [tuple(r) for r in interchange.to_kv(rows).collect()] == [("1", '{"title":"v","n":2}')]
    assert [tuple(r) for r in interchange.to_kv(rows.drop("n")).collect()] == [("1", "v")]
    assert interchange.skipped(rows).first()[0] == 1
    with pytest.raises(interchange.ImportError_):
        interchange.key_column(rows.drop("_id"))
    with pytest.raises(interchange.ImportError_):
        interchange.to_vectors(rows)


def test_event_stream(spark, tmp_path):
    first = spark.createDataFrame([(0, "a", "{}", None), (1, "b", '{"x":1}', None), (2, "", "{}", None)], "seq long, event_type string, payload string, ts timestamp")
    first.write.parquet(str(tmp_path / "in"))
    run = lambda: event_stream.ingest(event_stream.source(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    first.selectExpr("seq + 10 AS seq", "event_type", "payload", "ts").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    logged = spark.read.schema(event_stream.SCHEMA).parquet(str(tmp_path / "log"))
    assert sorted(r["seq"] for r in logged.collect()) == [0, 1, 10, 11]
    assert sorted(r["seq"] for r in event_stream.follow(logged, 1).collect()) == [10, 11]
    q = event_stream.stats_by_type(event_stream.source(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_type"]: (r["n"], r["last_seq"]) for r in spark.sql("SELECT * FROM stats").collect()} == {"a": (2, 10), "b": (2, 11)}


def test_chained_stream(spark, tmp_path):
    from tessera.operators import events

    schema = "space string, event_type string, payload string, ts_us long"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = event_stream.chain(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    write([("a", "x", "{}", 5), ("a", "y", "{}", 3), ("b", "x", "{}", 1)])
    run()
    write([("a", "z", "{}", 9)])
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["space"], r["seq"], r["event_type"]) for r in out.collect()) == [("a", 0, "y"), ("a", 1, "x"), ("a", 2, "z"), ("b", 0, "x")]
    assert events.verify_chain(out.where("space = 'a'")).first()["valid"]
