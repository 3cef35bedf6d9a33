"""Core operators on small data with answers that can be worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cinegrain.operators import datasets, frames, kernels, recommend, vectors
from cinegrain.sources import tables as sources
from cinegrain.streaming import events


def test_cosine_and_top_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<float>")
    q = df.where("id = 0").select(F.col("id").alias("q_key"), F.col("v").alias("q"))
    assert [tuple(r) for r in vectors.similar_to(df, "id", "v", q, 5).collect()] == [(0, 1, 1.0, 1), (0, 2, 0.0, 2)]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (9, 8), (None, 4)], "parent long, child long")
    got = {tuple(r) for r in vectors.closure(edges, spark.createDataFrame([(1,), (None,)], "id long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 1)}


def test_segments_novelty_sessions(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 1.0]), (2, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "item long, i int, v array<float>")
    got = {(r.item, r.first, r.last) for r in frames.segments(df, ["item"], "i", "v", 0.8).collect()}
    assert got == {(1, 0, 1), (1, 2, 3), (2, 0, 0)}
    nov = {(r.item, r.i): r.novelty for r in frames.novelty(df, "item", "i", "v", 2).collect()}
    assert nov[2, 0] == 0.0 and 0 < nov[1, 0] < 1 and nov[1, 2] > nov[1, 0] / 2
    hits = spark.createDataFrame([(1, 0.0, 0.5), (1, 30.0, 0.9), (1, 61.0, 0.4)], "e long, t double, s double")
    assert sorted(tuple(r) for r in frames.sessions(hits, "e", "t", 30.0, "s").collect()) == [(1, 0.0, 30.0, 2, 0.9), (1, 61.0, 61.0, 1, 0.4)]


def test_best_label_in_lots(spark, monkeypatch):
    f = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None), (10, [0.0, 0.0]), (11, [1.0])], "k long, v array<float>")
    tags = spark.createDataFrame([(f"t{i}", [float(i), 2.0]) for i in range(7)] + [(None, [1.0, 1.0])], "t string, w array<float>")

    def best():
        rows = kernels.scored(f, ["k"], "v", tags, "t", "w", kernels.best, "k long, t string, s double")
        return sorted(map(tuple, rows.groupBy("k").agg(F.min(F.struct(-F.col("s"), "t")).alias("b")).collect()))

    whole = best()
    assert len(whole) == 6
    monkeypatch.setattr(kernels, "SIDE_BYTES", 60)
    assert best() == whole


def test_recommend_leaves_out_what_was_seen(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "id long, v array<float>")
    scores = spark.createDataFrame([(0, 3.0)], "id long, s double")
    p = recommend.profile(scores, v, "id", "v", "s")
    assert [r.id for r in recommend.recommend(p, v, "id", "v", scores, 5).collect()] == [1, 2]
    assert [r.id for r in recommend.recommend(p, v, "id", "v", scores, 5, only=True).collect()] == [0]


def test_rewatch_blend_ranks_all_seen_items(spark, tmp_path):
    from cinegrain import queries

    n = 1_000_001
    items = spark.range(n).withColumn("far", F.col("id") == 7)
    vector = F.when(F.col("far"), F.array(F.lit(1.0), F.lit(-1.0))).when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    items.select(F.col("id").alias("vec_id"), vector.alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    views = items.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("far"), 50).otherwise(1))))
    views.select(F.col("id").alias("user_id"), F.lit("view").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    top = queries.rec_rewatch_blend(spark, str(tmp_path)).collect()
    assert top[0].vec_id == 7 and len(top) == 20


def test_datasets(spark):
    df = spark.createDataFrame([(1, " a \n b "), (2, "  "), (3, None)], "g long, t string")
    assert [r.c for r in df.select(datasets.clean_caption(F.col("t")).alias("c")).collect()] == ["a b", None, None]
    split = datasets.group_split(spark.range(500).withColumn("g", F.col("id") % 50), "g", 0.3)
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_upsert_and_files(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 11)], "k long, v string, created_at int")
    new = spark.createDataFrame([(2, "c", 20), (3, "d", 21)], "k long, v string, created_at int")
    assert sorted(map(tuple, sources.upserted(old, new, ["k"]).collect())) == [(1, "a", 10), (2, "c", 11), (3, "d", 21)]
    captions = spark.createDataFrame([("x.jpg", 'say "hi",\nthen go')], "filepath string, caption string")
    sources.write_captions(captions, str(tmp_path / "c"))
    assert [tuple(r) for r in sources.read_captions(spark, str(tmp_path / "c")).collect()] == [("x.jpg", 'say "hi",\nthen go')]
    sources.append_jsonl(old, str(tmp_path / "j"))
    assert sources.read_jsonl(spark, str(tmp_path / "j"), old.schema).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4} 10:00:00", "view") for i in range(20)], "id long, t string, kind string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "kind")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, events.windowed_counts(rows, "t", "kind").collect()))


def test_entry_works_without_the_llm_subpackage(spark):
    import __spark_entry__ as entry
    from cinegrain import queries

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("text", ["unix_s(ts)", "unix_s(lag(ts) OVER w)"])
def test_dialects(text):
    from cinegrain.queries import _check_text, _spark_text

    assert _spark_text(text).startswith("unix_timestamp(") and "epoch(" in _check_text(text)
