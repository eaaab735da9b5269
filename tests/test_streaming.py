import json

from pyspark.sql import functions as F

from quarry.operators import trace as tr
from quarry.streaming import jobs

SCHEMA = "message_id long, seq long, kind string, props string, value double, ts timestamp"


def events(spark):
    rows = [(m, s, k, f"{k}{s}", float(s)) for m in (1, 2) for s, k in enumerate(["retrieval", "delta", "delta", "retrieval", "done"][: 5 - (m == 2)])]
    return spark.createDataFrame(rows, "message_id long, seq long, kind string, props string, value double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_fold_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.where("seq < 3").union(e.where("seq = 1")).write.parquet(f"{tmp_path}/in")
    e.where("seq >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    with jobs.rocks(spark):
        got = drain(jobs.fold_stream(stream), tmp_path, "folded", "update")
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    last = {r.message_id: r for r in got.orderBy("n_events").collect()}
    for r in tr.folded(e).collect():
        s = last[r.message_id]
        assert (s.content, s.n_events, s.last_retrieval, s.done, s.status) == (r.content, r.n_events, r.last_retrieval, r.done, r.status)


def test_windows_equal_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/ev")
    kind = spark.read.parquet(f"{tmp_path}/ev").schema
    got = drain(jobs.windowed(spark.readStream.schema(kind).parquet(f"{tmp_path}/ev")), tmp_path, "win", "update")
    want = jobs.windowed(spark.read.parquet(f"{tmp_path}/ev"))
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted((r.start, r.event_type, r.n) for r in want.collect())


def test_ingest_keeps_the_newest_version(spark, tmp_path):
    schema = "doc_id string, title string, text string"
    long = "# A\n" + "word " * 500
    spark.createDataFrame([("a", "t", long), ("b", "t", "one")], schema).write.parquet(f"{tmp_path}/docs")
    run = lambda: jobs.ingest_stream(jobs.documents_in(spark, f"{tmp_path}/docs", schema), f"{tmp_path}/store", f"{tmp_path}/ck").awaitTermination(120)
    run()
    assert jobs.chunks(spark, f"{tmp_path}/store").where("doc_id = 'a'").count() > 1
    spark.createDataFrame([("a", "t", "short now")], schema).write.mode("append").parquet(f"{tmp_path}/docs")
    run()
    got = jobs.chunks(spark, f"{tmp_path}/store")
    assert [r.text for r in got.where("doc_id = 'a'").collect()] == ["t :: short now"] and got.where("doc_id = 'b'").count() == 1


def test_fold_keeps_one_entry_a_batch():
    """Calls to the store are by message and batch, not by event."""
    calls, kept = [], []

    class Store:
        def getListState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return iter(list(kept))

        def appendValue(self, entry):
            calls.append("append")
            kept.append(entry)

        def registerTimer(self, ms):
            calls.append(("timer", ms))

    fold = jobs.Fold(1000)
    fold.init(Store())
    rows = lambda seqs: iter([(7, json.dumps({"seq": n, "kind": "delta", "props": f"<{n}>", "ms": 10 * n}), None) for n in seqs])
    assert [r.content for r in fold.handleInputRows((7,), rows([3, 1, 3]), None)] == ["<1><3>"]
    assert list(fold.handleInputRows((7,), rows([1]), None)) == []
    assert [(r.content, r.n_events) for r in fold.handleInputRows((7,), rows([2, 1]), None)] == [("<1><2><3>", 3)]
    assert calls == ["get", ("timer", 1030), "append", "get", "get", "append"]


def test_fold_stream_of_odd_values(spark, tmp_path):
    rows = [(1, 1, "delta", 'a"\\\né', None), (1, 2, "delta", None, 1.0), (1, 3, None, "x", 2.0), (1, 4, "done", None, float("inf")), (2, 1, "done", "p", float("nan")), (3, 2**60, "retrieval", None, 0.1), (3, 5, "done", "", 0.1 + 0.2), (4, None, "delta", "no", 1.0)]
    e = spark.createDataFrame(rows, "message_id long, seq long, kind string, props string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/in")
    with jobs.rocks(spark):
        got = drain(jobs.fold_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")), tmp_path, "odd", "update")
    assert sorted(tuple(r) for r in got.select(*"message_id content n_events last_retrieval done status".split()).collect()) == [
        (1, 'a"\\\né', 4, None, float("inf"), "done"), (2, "", 1, None, None, "done"), (3, "", 2, None, 0.1 + 0.2, "done")
    ]
