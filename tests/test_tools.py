"""The tools' surface and their semantics on a small library whose answers can be worked out by hand."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinegrain.catalog import Catalog
from cinegrain.functions import text as fn
from cinegrain.functions import udf
from cinegrain.operators import datasets as ds
from cinegrain.operators import kernels
from cinegrain.tools import base, details, library, recommend, similar

AT = dt.datetime(2024, 5, 1, 12)


def _vector(*head):
    return [float(x) for x in head] + [0.0] * (40 - len(head))


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("library"))

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).withColumn("extra", F.lit("x")).write.parquet(f"{d}/{name}.parquet")

    tag, person = lambda *ids: [{"id": i, "name": f"t{i}"} if i is not None else None for i in ids], lambda *ids: [{"id": i, "name": f"p{i}"} for i in ids]
    file = lambda path, size, s: [{"path": path, "size": size, "duration": s}]
    lib = [
        (1, "Alpha", 3, 2, 80, True, 1, tag(1, 8, 8, None), person(1, 2), file("/a/one.MKV", 100, 90.2), AT, AT, AT),
        (1, "Alpha old", 9, 9, 10, False, 2, tag(2), person(3), [], AT, AT - dt.timedelta(days=1), AT),
        (2, "alpha", None, -1, None, None, 1, tag(9), person(1), file("/a/two.mp4", 100, 90.4), AT, AT, AT),
        (3, None, 1, 0, 100, False, 2, tag(2), None, file("/b/three", 7, 30.0), AT, AT, AT),
        (4, "", 0, 0, 20, True, None, None, person(2, 3, 1), [], AT, AT, AT),
        (None, "lost", 1, 1, 1, True, 1, None, None, [], AT, AT, AT),
    ]
    thing = "array<struct<id: long, name: string>>"
    write("sample_library", lib, f"id long, title string, play_count int, o_counter int, rating100 int, organized boolean, studio_id long, tags {thing}, performers {thing}, files array<struct<path: string, size: long, duration: double>>, created_at timestamp_ntz, updated_at timestamp_ntz, exported_at timestamp_ntz")
    write("tags", [(i, n, None, i == 1, AT, AT) for i, n in ((1, "Ibis"), (2, "Ibis Travel"), (8, "Kiln (old)"), (9, "Loom"), (64, "Deep"))], "id long, name string, description string, favorite boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    write("studios", [(1, "Films", 2, True, 3), (2, "Big Films", None, False, None), (3, "Films North", 1, False, None)], "id long, name string, parent_id long, favorite boolean, rating int")
    write("performers", [(i, n, a, b, None, i == 2, None, AT, AT) for i, n, a, b in ((1, "Anna Berg", None, "1980-05-01"), (2, "Ann", "tall", "1999"), (3, "Joanna Berglund", "anna", None), (5, None, None, None))], "id long, name string, disambiguation string, birthdate string, country string, favorite boolean, rating int, created_at timestamp_ntz, updated_at timestamp_ntz")
    write("scenes_view_dates", [(1, AT, AT), (1, AT, AT), (1, AT + dt.timedelta(hours=1), AT), (3, AT, AT), (3, None, AT), (None, AT, AT)], "scene_id long, view_date timestamp_ntz, received_at timestamp_ntz")
    scenes = [(1, _vector(1), AT), (2, _vector(0.9, 0.1), AT), (3, _vector(0, 1), AT), (4, _vector(0), AT), (99, _vector(1), AT), (1, _vector(0, 1), AT - dt.timedelta(days=1))]
    write("scene_embeddings", [(i, "siglip", v, t) for i, v, t in scenes], "scene_id long, model_key string, composite_embedding array<float>, updated_at timestamp_ntz")
    frames = [(1, k, "siglip", float(k), _vector(1, 0.01 * k), AT) for k in range(20)] + [(3, 0, "siglip", 5.0, None, AT), (98, 0, "siglip", 0.0, _vector(1), AT)]
    write("frame_embeddings", frames, "scene_id long, frame_index int, model_key string, timestamp_s double, embedding array<float>, created_at timestamp_ntz")
    return Catalog(spark, d)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_calls_and_schemas(cat):
    assert base.call(cat, "top_tags", sort_by="items").success
    assert "no tool" in base.call(cat, "nothing").error
    assert base.call(cat, "tag_persons").error == "missing parameter: tag_name"
    assert base.call(cat, "tag_persons", tag_name="x", aggregation="daily").error == "unknown parameter: aggregation"
    assert base.call(cat, "top_tags", sort_by="colour").error.startswith("sort_by is one of")
    with pytest.raises(ValueError):
        library.top_tags(cat, sort_by="colour")
    s = base.schema("storage")
    assert s["parameters"]["properties"]["group_by"]["enum"][0] == "org" and s["parameters"]["required"] == []
    assert all(base.schema(t)["description"] for t in base.TOOLS)


def test_resolvers(cat):
    one = lambda df: [r.id for r in df.collect()]
    assert one(base.resolved(cat.persons, "ANN")) == [2]
    assert one(base.resolved(cat.persons, "anna", "disambiguation")) == [3]
    assert one(base.resolved(cat.persons, "anna")) == [1]  # the shortest name that holds it
    assert one(base.resolved(cat.persons, "nobody")) == []
    assert one(base.found_by_name(cat.orgs, "films")) == [1] and one(base.found_by_name(cat.orgs, "film")) == [2]


def test_current_rows_and_bridges(cat):
    assert _rows(cat.items.select("id", "plays", "peaks")) == [(1, 3, 2), (2, 0, 0), (3, 1, 0), (4, 0, 0)]
    assert _rows(cat.item_tags) == [(1, 1), (1, 8), (2, 9), (3, 2)]
    assert _rows(cat.view_counts.select("item_id", "views")) == [(1, 2), (3, 1)]


def test_exclusions_take_all_tags_below(cat):
    assert _rows(cat.tags_below(["ibis"])) == [(1,), (8,), (9,), (64,)]
    less = Catalog(cat.spark, cat.data_dir, excluded=("Ibis",))
    assert _rows(less.shown(less.item_tags)) == [(2, 3)]
    assert _rows(library.items_of_tags(cat, tag_names=("ibis",))) == [(1, 2), (2, 1)]
    assert _rows(library.items_of_tags(cat, tag_names=("ibis", "kiln (old)"), match_mode="all")) == [(1, 2)]
    assert _rows(details.plain_tags(cat).select("tag_id")) == [(1,), (2,), (9,), (64,)]


def test_duplicates_and_orphans(cat):
    assert [(r.items, r.first_item, r.confidence) for r in library.duplicate_files(cat, method="fingerprint").collect()] == [(2, 1, "high")]
    assert [(r.items, r.first_item) for r in library.duplicate_files(cat, method="size").collect()] == [(2, 1)]
    assert [(r.items, r.key) for r in library.duplicate_files(cat, method="duration").collect()] == [(2, "90")]
    assert _rows(details.orphans_of(cat)) == [(98, "frame_embeddings"), (99, "scene_embeddings")]


def test_profiles_and_progress(cat):
    p = library.person_profile(cat, person_name="Anna Berg").collect()[0]
    assert (p.age, p.items, p.views, p.peaks, p.partners) == (45, 3, 2, 2, "Ann, Joanna Berglund")
    o = library.org_profile_of(cat, org_name="films").collect()[0]
    assert (o.parent, o.items, o.below) == ("Big Films", 2, "Films North (0)")
    assert _rows(library.series_state(cat)) == [(1, 2, 1, 50.0, 2), (2, 1, 1, 100.0, -1)]
    e = {r.item_id: r for r in library.enriched(cat).collect()}
    assert e[4].display == "Ann, Anna Berg + 1" and e[3].display == "three" and e[1].score == 2 * 20 + 1 * 2 + 4 * 1.5
    assert [r.item_id for r in library.enriched(cat, item_ids=(3, 1)).collect()] == [3, 1]
    assert _rows(library.items_of_persons(cat, person_names=("Ann", "Anna Berg"), match_mode="all").select("item_id")) == [(1,), (4,)]
    assert _rows(library.names_not_found(cat, person_names=("Ann", "zzz"))) == [(1, "zzz")]
    h = {r.bucket: r.n for r in details.rating_histogram(cat).collect()}
    assert h == {"unrated": 0, "1_star": 0, "2_star": 0, "3_star": 0, "4_star": 1, "5_star": 1}


def test_hierarchies(cat):
    assert _rows(details.org_hierarchy(cat, org_name="big films")) == [(2, 1, 1), (2, 3, 2)]
    assert _rows(details.org_hierarchy(cat, mode="totals")) == [(1, 2, 2), (2, 3, 3), (3, 1, 0)]
    assert _rows(details.tag_hierarchy(cat, tag_name="Kiln (old)").select("tag_id", "depth")) == [(1, -1), (8, 0), (64, 1)]


def test_pages_and_lines(cat):
    rows = cat.spark.range(5)
    page = details.page_of(rows, ["id"], 2, 2)
    assert [tuple(r) for r in page.collect()] == [(2, 5, 3, True), (3, 5, 3, True)]
    assert base.format_rows(cat.spark.createDataFrame([("a", None)], "x string, y int"), "{x}: {y}!").collect()[0].line == "a: !"


def test_vectors(cat):
    near = similar.similar_items(cat, every=1, limit=2, min_similarity=0.5)
    assert {(r.query_id, r.item_id) for r in near.collect()} == {(1, 99), (1, 2), (2, 1), (2, 99), (99, 1), (99, 2)}
    at = similar.frame_at(cat, every_seconds=10.0).collect()
    assert {(r.item_id, r.asked, r.frame) for r in at} == {(1, 0.0, 0), (1, 10.0, 10), (1, 20.0, 19), (98, 0.0, 0)}
    ids = [r.frame for r in similar.smart_frames(cat, most=4).where("item_id = 1").orderBy("frame").collect()]
    assert len(ids) == 2 and ids == [0, 19]  # the others are too much like those in time
    assert similar.representative_frames(cat, k=3).where("item_id = 1").count() == 3
    m = similar.similarity_matrix(cat, item_id=1)
    assert m.count() == 20 * 21 // 2 and m.where("a = b AND similarity = 1").count() == 20


def test_means_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = spark.range(200).select((F.col("id") % 3).alias("g"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).unionByName(spark.createDataFrame([(None, [1.0, 1.0]), (1, None)], "g long, v array<double>"))
    got = {r.g: (r.n, r.v) for r in kernels.weighted_means(rows, "g", "v").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        own = [i for i in range(200) if i % 3 == g]
        x, y = sum(own), len(own)
        assert got[g][0] == y and got[g][1] == [round(x / (x * x + y * y) ** 0.5, 6), round(y / (x * x + y * y) ** 0.5, 6)]


def test_recommendations_need_three_items(cat):
    assert recommend.profile(cat).count() == 0 and recommend.discover(cat).count() == 0
    assert recommend.least_score(7) == 5.0 and recommend.least_score(365) == 0.5 and recommend.least_score(None) == 0.0
    assert [tuple(r)[0] for r in recommend.for_session(cat, item_ids=(1,)).collect()] == [2, 3]
    lists = cat.spark.createDataFrame([("a", 1, 1, 0.75), ("a", 2, 2, 0.75), ("b", 1, 1, 0.25), ("b", 3, 2, 0.25)], "s string, k int, place int, w double")
    assert [r.k for r in recommend.interleaved(lists, "s", "k", "place", "w", 5).collect()] == [1, 2, 3]


def test_datasets_and_texts(spark):
    texts = ["[ERROR: x]", "A black frame.", "The word on a black background", "A big logo that is shown on a very solid white background here", "The credits roll", "A dog", "x" * 210 + ". text on black frame", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.r for r in df.orderBy("i").select(ds.caption_reason(F.col("t")).alias("r")).collect()]
    assert got == ["error", "black_blank", "title_logo", "title_logo", "title_logo", None, None, None]
    rows = ds.in_chunks(spark.range(1000), 300, F.col("id").desc())
    assert {(r.chunk, r.n, r.lo) for r in rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("lo")).collect()} == {(0, 300, 700), (1, 300, 400), (2, 300, 100), (3, 100, 0)}
    split = ds.counted_split(spark.range(95).select((F.col("id") % 19).alias("g")), "g", 0.1)
    assert split.where("split = 'val'").select("g").distinct().count() == 1
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0].c
    assert one(fn.clock(F.lit(3725.9))) == "1:02:05" and one(fn.clock(F.lit(65))) == "1:05" and one(fn.seconds_of(F.lit("at 1:02:05 sharp"))) == 3725
    assert one(fn.noise_free(F.lit("The_Red.Kiln-1080p (Red) x264.mp4"))) == ["red", "kiln"]
    assert one(fn.caption(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "x {tags}")) == "x a, b, and c" and one(fn.negative_caption(F.array().cast("array<string>"))) == ""
    assert one(fn.xml_block(F.lit("a <v> b </v>"), "v")) == "b" and one(fn.json_array(F.lit('so ["a", "b"] it is'))) == ["a", "b"]
    assert one(ds.even_places(F.lit(10), 4)) == [0, 3, 6, 9] and one(ds.even_places(F.lit(2), 4)) == [0, 1]


def test_suggested_tags(spark, cat):
    text = "Nice.\nSuggested tags:\n- Ibis (sure)\n* loom\n- Deep, unknown\n\nOther: Ibis Travel"
    got = details.suggested_tags(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t", cat.tags, spark.createDataFrame([(1, 9)], "id long, tag_id long"))
    assert {r.tag_id for r in got.collect()} == {1, 64}


def test_plug_ins(spark, cat):
    udf.register_embedder("length", lambda texts: [[len(t), 1] for t in texts])
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r.v for r in df.select(udf.embedded("length", F.col("t")).alias("v")).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    rows = spark.createDataFrame([(1, [3.0, 0.0], 1.0), (1, [0.0, 4.0], 1.0), (2, None, 1.0)], "g int, v array<double>, w double")
    assert {r.g: r.m for r in rows.groupBy("g").agg(udf.l2_weighted_mean("v", "w").alias("m")).collect()} == {1: [0.6, 0.8], 2: None}
    udf.DETECTORS["x"] = udf.Detector((1,), 0.5, needs_tags=(1,))
    assert udf.detect(cat, "x").count() == 0  # no tag has three items


def test_retrieval_metrics_and_loss(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.1]), (2, [0.0, 1.0], [0.1, 1.0]), (3, [1.0, 1.0], [1.0, 0.0])], "id long, i array<double>, t array<double>")
    got = {r.k: (r.image_to_text, r.text_to_image) for r in similar.retrieval_metrics(rows, "id", "i", "t", (1, 2, 5)).collect()}
    assert set(got) == {1, 2} and got[1][0] == round(1 / 3, 6)
    assert similar.contrastive_loss(rows, "id", "i", "t", 1.0).collect()[0].loss > 0


def test_representatives_equal_the_matrix():
    import numpy as np

    g = np.random.default_rng(2)
    x = np.repeat(g.normal(size=(9, 5)), 7, axis=0) + g.normal(size=(63, 5)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    taken = similar.spread_frames(x, 6, "maximin").tolist()
    for i in range(1, 6):
        far = s[:, taken[:i]].max(axis=1)
        assert far[taken[i]] == np.delete(far, taken[:i]).min()
    open_ = np.ones(63, dtype=bool)
    for at in similar.spread_frames(x, 6, "coverage", 0.2):
        n = ((s >= 0.8) & open_).sum(axis=1)
        assert n[at] == n.max()
        open_ &= s[at] < 0.8


def test_novelty_over_many_batches(spark, cat):
    import numpy as np

    g = np.random.default_rng(3)
    sizes = {1: 150, 2: 3, 5: 1, 7: 40}
    x = {e: g.normal(size=(n, 40)) for e, n in sizes.items()}
    df = spark.createDataFrame([(e, i, v.tolist()) for e, m in x.items() for i, v in enumerate(m)], "e long, i int, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    run = lambda c, begin, end: [pa.array(similar.novelty_of(kernels.unit_rows(c["v"], 40)[1], (2, 9), (1.0, 2.0))[begin:end])]
    got = {(r.e, r.i): r.n for r in kernels.sliding(df, "e", "i", ["v"], 9, run, "n double").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for e, m in x.items():
        want = similar.novelty_of(m / np.linalg.norm(m, axis=1)[:, None], (2, 9), (1.0, 2.0))
        assert np.allclose([got[e, i] for i in range(len(m))], want)


def test_deduplication_over_many_batches(spark):
    import numpy as np

    from cinegrain.operators import frames

    g = np.random.default_rng(4)
    x = np.cumsum(g.normal(size=(300, 6)) * 0.2, axis=0) + 1
    df = spark.createDataFrame([(i // 200, i, v.tolist()) for i, v in enumerate(x)] + [(0, 900, None), (0, 901, [0.0] * 6), (0, 902, [1.0])], "e long, i int, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    got = sorted(tuple(r) for r in frames.deduplicated(df, "e", "i", "v", 0.98, 3).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u, want = x / np.linalg.norm(x, axis=1)[:, None], []
    for e, own in ((0, range(200)), (1, range(200, 300))):
        last = None
        for n, i in enumerate(own):
            if n < 3 or round(float(u[i] @ u[last]), 6) < 0.98:
                want.append((e, i))
                last = i
    assert got == want
