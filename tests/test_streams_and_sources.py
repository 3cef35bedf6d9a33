"""Streams from files give what the batch gives; sinks and sources round trip."""

import numpy as np
from pyspark.sql import functions as F

from cinegrain.operators import datasets, preference
from cinegrain.sources import tables as sources
from cinegrain.streaming import events


def _run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def test_gap_sessions_join_at_the_gap(spark):
    rows = spark.createDataFrame([(1, 0), (1, 30), (1, 61)], "e long, s long").select("e", F.timestamp_seconds("s").alias("t"))
    assert sorted(r.n for r in events.gap_sessions(rows, "t", "e").collect()) == [1, 2]


def test_sliding_rates(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 30), ("a", 61)], "c string, s long").select("c", F.timestamp_seconds("s").alias("t"))
    got = {r.start.timestamp(): r.n for r in events.sliding_rates(rows, "t", "c", 60, 30).collect()}
    assert sorted(got.values()) == [1, 1, 2, 2]


def test_incremental_work_is_done_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in batch], "id long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        _run(events.incremental(stream, out, ["id"], lambda df: df.withColumn("twice", F.col("id") * 2), str(tmp_path / "check")))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 2), (2, 4), (3, 6)]


def test_change_feed(spark, tmp_path):
    for batch in ([(1, 1, False, "a"), (2, 2, False, "b"), (1, 3, False, "c")], [(2, 4, True, None)]):
        spark.createDataFrame(batch, "id long, seq long, deleted boolean, v string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, seq long, deleted boolean, v string").parquet(str(tmp_path / "in"))
        _run(events.change_feed(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "check")))
    assert [(r.id, r.v) for r in events.current(spark.read.parquet(str(tmp_path / "out")), ["id"]).collect()] == [(1, "c")]


def test_online_preferences_equal_the_fold(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("m", i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for i in range(12)]
    schema = "m string, seq long, w array<double>, l array<double>"
    spark.createDataFrame(rows[:5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[5:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    seen, out = [], events.online_preferences(stream, "m", "w", "l")
    listener = events.progress_listener(lambda name, batch, n: seen.append((batch, n)))
    spark.streams.addListener(listener)
    _run(out.writeStream.outputMode("update").format("memory").queryName("models").option("checkpointLocation", str(tmp_path / "check")))
    spark.streams.removeListener(listener)
    got = max(spark.table("models").collect(), key=lambda r: r.n)
    want = preference.fold(spark.createDataFrame(rows, schema), "m", "seq", "w", "l").collect()[0]
    assert got.n == 12 and np.allclose(got["mean"], want["mean"], atol=1e-5)


def test_partitions_deletes_and_tails(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write_vectors(spark.createDataFrame([(1, "a"), (2, "b")], "id long, model_key string"), path)
    sources.write_vectors(spark.createDataFrame([(3, "a")], "id long, model_key string"), path)
    table = spark.read.parquet(path)
    assert sorted((r.id, r.model_key) for r in table.collect()) == [(2, "b"), (3, "a")]
    assert [r.id for r in sources.without(table, "id", spark.createDataFrame([(2,), (2,), (None,)], "id long")).collect()] == [3]
    newest, some = sources.last_lines(spark.range(100), "id", 31, 16)
    assert [r.id for r in newest.collect()][:2] == [99, 98] and [r.id for r in some.collect()] == list(range(99, 68, -2))
    sources.write_results(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).collect()[0].value == '{"a":1,"b":null}'


def test_matrices_and_tars(spark, tmp_path):
    import tarfile

    df = spark.range(10).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    sources.write_npy(df, "id", "v", str(tmp_path / "npy"))
    back = sources.read_npy(spark, str(tmp_path / "npy" / "part-?????.npy"))
    assert sorted(r.v[0] for r in back.collect()) == list(map(float, range(10)))
    datasets.write_tar_shards(df.select(F.concat(F.lit("f"), "id").alias("name"), F.lit("a caption").alias("c"), F.lit(None).cast("string").alias("n")), "name", {"txt": "c", "neg.txt": "n"}, str(tmp_path / "tar"))
    names = [m for f in sorted((tmp_path / "tar").iterdir()) for m in tarfile.open(f).getnames()]
    assert sorted(names) == [f"f{i}.txt" for i in range(10)]
