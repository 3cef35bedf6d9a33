"""Registered dataset operators and scalar functions with their SQL; documents are captions, their scene the item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import datasets as ds
from ..shared import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def _in(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_SOME = "(" + " OR ".join(f"regexp_matches(t, '{p}')" for p in ds.TITLE_PATTERNS) + ")"
_FITS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN length(t) <= 200 OR regexp_matches(split_part(t, '.', 1), '{p}')" for p in ds.TITLE_PATTERNS) + " ELSE false END"
_NAMES = ", ".join(f"'{n}'" for n in ds.BLANK_NAMES)
_REASON = f"""CASE WHEN starts_with(t, '[ERROR') THEN 'error'
 WHEN regexp_replace(trim(low), '\\.+$', '') IN ({_NAMES}) OR (length(t) < 60 AND regexp_matches(low, '{ds.BLANK_SHORT}')) OR (length(t) < 50 AND {_in(ds.BLANK_WORDS)}) THEN 'black_blank'
 WHEN {_in(ds.TITLE_WORDS)} OR CASE WHEN {_SOME} THEN {_FITS} ELSE length(t) < 150 AND {_in(ds.TEXT_SIGNS)} AND {_in(ds.PLAIN_SIGNS)} END THEN 'title_logo' END"""


@query(f"SELECT doc_id, coalesce({_REASON}, 'kept') AS reason FROM (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents)")
def data_caption_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reason of every caption."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(ds.caption_reason(F.col("text")), F.lit("kept")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT coalesce({_REASON}, CASE WHEN scene_id IS NULL THEN 'missing_image' END, 'kept') AS reason FROM (SELECT scene_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents)) GROUP BY 1")
def data_caption_stats(spark: SparkSession, d: str) -> DataFrame:
    """Captions by reason; one without an item has no image."""
    reason = F.coalesce(ds.caption_reason(F.col("text"), F.col("scene_id").isNotNull()), F.lit("kept"))
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"SELECT doc_id, caption FROM (SELECT doc_id, trim(regexp_replace(text, '{_SPACE.replace(chr(92) + 'x{1c}-' + chr(92) + 'x{1f}', '')}', ' ', 'g'), ' ') AS caption FROM documents) WHERE caption <> ''")
def data_caption_clean(spark: SparkSession, d: str) -> DataFrame:
    """Captions with one kind of space."""
    return table(spark, d, "documents").select("doc_id", ds.clean_caption(F.col("text")).alias("caption")).where("caption IS NOT NULL")


@query("WITH g AS (SELECT scene_id, row_number() OVER (ORDER BY md5('42:' || scene_id::VARCHAR), scene_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT scene_id FROM documents WHERE scene_id IS NOT NULL)) SELECT doc_id, scene_id, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM documents LEFT JOIN g USING (scene_id)")
def data_group_split(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the items, all captions of one together, held out."""
    return ds.counted_split(table(spark, d, "documents").select("doc_id", "scene_id"), "scene_id", 0.1)


@query("SELECT o_orderkey AS item, count(DISTINCT l_partkey) AS tags FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey >= 50 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 5")
def data_enough_tags(spark: SparkSession, d: str) -> DataFrame:
    """Orders with at least five parts besides the first 50, which stand for admin tags."""
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("tag")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("item")), "item", "left_semi")
    return ds.with_enough_tags(bridge, "item", "tag", table(spark, d, "part").where("p_partkey < 50").select(F.col("p_partkey").alias("tag")))


@query("WITH c AS (SELECT scene_id, count(*) AS n FROM documents WHERE scene_id IS NOT NULL GROUP BY 1) SELECT scene_id, array_to_string(CASE WHEN n <= 4 THEN range(0, n) ELSE list_sort(list_distinct([0, round((n - 1) / 3)::BIGINT, round(2 * (n - 1) / 3)::BIGINT, n - 1])) END, ',') AS places FROM c")
def data_even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four captions of each item, evenly spread over their order."""
    rows = table(spark, d, "documents").where("scene_id IS NOT NULL").groupBy("scene_id").agg(F.count("*").alias("n"))
    return rows.select("scene_id", F.array_join(F.array_sort(ds.even_places(F.col("n"), 4)).cast("array<string>"), ",").alias("places"))


@query("SELECT DISTINCT id AS scene_id FROM sample_library WHERE id IS NOT NULL AND id NOT IN (SELECT scene_id FROM documents WHERE scene_id IS NOT NULL) ORDER BY 1 LIMIT 50")
def data_work_queue(spark: SparkSession, d: str) -> DataFrame:
    """The next 50 items without a caption."""
    return ds.work_queue(table(spark, d, "sample_library").select(F.col("id").alias("scene_id")).dropna(), table(spark, d, "documents").select("scene_id"), ["scene_id"], 50)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 400)::INT AS chunk FROM documents")
def data_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Captions in chunks of 400 requests."""
    return ds.in_chunks(table(spark, d, "documents").select("doc_id"), 400, "doc_id")


@query("SELECT u.t.name AS tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM sample_library), 6) AS share FROM sample_library, unnest(tags) AS u(t) WHERE u.t.name IS NOT NULL GROUP BY 1")
def data_tag_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each tag name is written in the exports."""
    rows = table(spark, d, "sample_library").select(F.transform("tags", lambda t: t["name"]).alias("names"))
    return ds.tag_report(rows, "names")


#: Fixed values of the example: a clause for each category of part types.
CATEGORIES = {"kind": ("A {} part.", ["ECONOMY", "STANDARD", "PROMO"]), "brand": ("Made by {}.", [f"Brand#{i}" for i in range(1, 20)]), "size": ("Its size is {}.", ["small", "large", "big"])}


@query("SELECT p_partkey, concat_ws(' ', CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'A ' || lower(p_type) || ' part.' END, CASE WHEN regexp_full_match(p_brand, 'Brand#([1-9]|1[0-9])') THEN 'Made by ' || lower(p_brand) || '.' END, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'large', 'big') THEN 'Its size is ' || split_part(p_name, ' ', 1) || '.' END) AS caption FROM part")
def data_rule_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of parts from their type, brand and the first word of their name."""
    names = F.array("p_type", "p_brand", F.split("p_name", " ")[0])
    return table(spark, d, "part").select("p_partkey", ds.rule_caption(names, CATEGORIES).alias("caption"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    key = F.format_string("s%d_f%04d", F.floor(F.col("doc_id") / 10), F.col("doc_id") % 10)
    answer = F.to_json(F.struct(key.alias("key"), F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("t").alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    none = F.to_json(F.struct(key.alias("key"), F.struct(F.array().cast("array<struct<content: struct<parts: array<struct<text: string>>>>>").alias("candidates")).alias("response")))
    line = F.when(F.col("doc_id") % 7 == 0, F.to_json(F.struct(key.alias("key"), F.lit("quota").alias("error")))).when(F.col("doc_id") % 7 == 1, F.to_json(F.struct(key.alias("key")))).when(F.col("doc_id") % 7 == 2, none).otherwise(answer)
    return docs.select(line.alias("line"))


@query("SELECT format('s{}_f{:04d}', doc_id // 10, doc_id % 10) AS key, doc_id // 10 AS item, doc_id % 10 AS frame, CASE doc_id % 7 WHEN 0 THEN '[ERROR: quota]' WHEN 1 THEN '[ERROR: empty response]' WHEN 2 THEN '[ERROR: no candidates]' ELSE CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '[ERROR: empty caption]' ELSE trim(text, ' ') END END AS caption, doc_id % 7 < 3 OR trim(coalesce(text, ''), ' ') = '' OR starts_with(trim(text, ' '), '[ERROR') AS failed FROM documents")
def data_batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Captions from the lines of a batch job made of the documents, some of them failed."""
    return ds.batch_results(_lines(spark, d), "line")


@query("SELECT doc_id // 10 AS item, count(*) AS frames FROM documents WHERE doc_id % 7 < 3 OR text IS NULL OR trim(text, ' ') = '' OR starts_with(trim(text, ' '), '[ERROR') GROUP BY 1")
def data_uncaptioned(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose batch line gave no caption, by item."""
    rows = ds.batch_results(_lines(spark, d), "line").select(F.col("key").alias("stem"), "failed")
    return ds.uncaptioned(rows, rows.where("NOT failed"), "stem")


@query("WITH f AS (SELECT id, files[1].duration AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1) SELECT id AS item_id, least(900, greatest(8, floor(coalesce(s, 0) * 0.2)))::INT AS frames FROM f WHERE id IN (SELECT id FROM sample_library WHERE len(files) > 0)")
def data_frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames to take of each item with files: one in five seconds, 8 to 900."""
    from ..catalog import Catalog

    return Catalog(spark, d).primary.select("item_id", ds.frame_count(F.col("duration"), 0.2, 8, 900).alias("frames"))


@query("SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS used, count(*) OVER w >= 3 OR round(sum(value) OVER w, 4) >= 50 AS wait FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
def data_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Requests and tokens of the last 60 seconds of each client (event type)."""
    rows = ds.rate_windows(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value", 60, 3, 50)
    return rows.select("event_id", "requests", "used", "wait")


@query("WITH w AS (SELECT DISTINCT id FROM sample_library WHERE id IS NOT NULL), d AS (SELECT DISTINCT scene_id AS id FROM scene_embeddings), f AS (SELECT DISTINCT scene_id AS id FROM documents), x AS (SELECT id IN (SELECT id FROM d WHERE id IS NOT NULL) AS done, id IN (SELECT id FROM f WHERE id IS NOT NULL) AS failed FROM w) SELECT count(*) AS wanted, count(*) FILTER (done) AS done, count(*) FILTER (NOT done AND failed) AS failed, count(*) FILTER (NOT done AND NOT failed) AS left, round(100 * count(*) FILTER (done) / count(*), 4) AS pct FROM x")
def data_job_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of embedding the library: items with a vector are done, other ones with a document stand for failed."""
    item = lambda t, c="scene_id": table(spark, d, t).select(F.col(c).alias("id")).dropna()
    return ds.job_status(item("sample_library", "id"), item("scene_embeddings"), item("documents"), "id")


@query("SELECT c_custkey AS run, c_name, n_name, coalesce(n, 0) AS steps, last_loss, least_loss FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, round(arg_max(o_totalprice, o_orderkey), 6) AS last_loss, round(min(o_totalprice), 6) AS least_loss FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def data_run_listing(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for runs, their nation for the config, their orders for the steps."""
    c = table(spark, d, "customer")
    losses = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", "o_totalprice")
    configs = c.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("run"), "n_name")
    return ds.run_listing(c.select(F.col("c_custkey").alias("run"), "c_name"), configs, losses, "run", "c_name", "o_orderkey", "o_totalprice").select("run", "c_name", "n_name", "steps", "last_loss", "least_loss")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type").isin("view", "purchase"), "labeled").when(F.col("event_type") == "error", "skipped").otherwise("open")
    return e.select(F.col("user_id").alias("session"), F.floor("value").cast("bigint").alias("frame"), F.col("event_id").alias("seq"), status.alias("status"))


@query("WITH l AS (SELECT user_id AS session, floor(value)::BIGINT AS frame, arg_max(event_type, event_id) AS k FROM events GROUP BY 1, 2), c AS (SELECT session, count(*) FILTER (k IN ('view', 'purchase')) AS labeled, count(*) FILTER (k = 'error') AS skipped FROM l GROUP BY 1) SELECT c_custkey AS session, coalesce(labeled, 0) AS labeled, coalesce(skipped, 0) AS skipped FROM customer LEFT JOIN c ON session = c_custkey")
def label_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Labelling sessions with their counters; events stand for the reports."""
    return ds.synced_sessions(table(spark, d, "customer").select(F.col("c_custkey").alias("session")), _progress(spark, d), "session", ["frame"])


_SUPP = "(SELECT l_orderkey AS item, 'tag ' || (l_partkey % 40)::VARCHAR AS tag, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'confirmed' END AS label FROM lineitem)"
_LIST = "CASE len(y) WHEN 1 THEN y[1] WHEN 2 THEN y[1] || ' and ' || y[2] ELSE array_to_string(list_slice(y, 1, -2), ', ') || ', and ' || y[-1] END"


@query(f"SELECT item, 'a frame featuring ' || {_LIST} AS caption, CASE WHEN len(n) > 0 THEN 'not featuring ' || array_to_string(n, ', not featuring ') ELSE '' END AS negative FROM (SELECT item, list_sort(list_distinct(list(tag) FILTER (label = 'confirmed'))) AS y, coalesce(list_sort(list_distinct(list(tag) FILTER (label = 'rejected'))), []) AS n FROM {_SUPP} GROUP BY 1) WHERE len(y) > 0")
def label_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of orders from their parts: returned ones are rejected tags."""
    return ds.labelled_frames(_annotations(spark, d), ["item"], "tag", "label")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit("tag "), (F.col("l_partkey") % 40).cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), tag.alias("tag"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("confirmed").alias("label"))


@query(f"SELECT tag, count(*) FILTER (label = 'confirmed') AS confirmed, count(*) FILTER (label = 'rejected') AS rejected FROM {_SUPP} GROUP BY 1")
def label_tag_stats(spark: SparkSession, d: str) -> DataFrame:
    """How often each tag was confirmed and rejected."""
    return _annotations(spark, d).groupBy("tag").agg(F.count_if(F.col("label") == "confirmed").alias("confirmed"), F.count_if(F.col("label") == "rejected").alias("rejected"))


_NOISE = ", ".join(f"'{n}'" for n in fn.NOISE)


@query(f"SELECT id AS item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS tokens FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(lower(split_part(files[1].path, '/', -1)), '[._\\-\\s]+'), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda t: t <> '' AND t NOT IN ({_NOISE})) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1) WHERE w IS NOT NULL")
def text_noise_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of the primary files' names."""
    from ..catalog import Catalog

    file = F.element_at(F.split("path", "/"), -1)
    return Catalog(spark, d).primary.where("path IS NOT NULL").select("item_id", F.array_join(fn.noise_free(file), " ").alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{}:{:02d}', s // 60, s % 60) END AS clock, s AS seconds FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 10)::BIGINT AS s FROM lineitem)")
def text_clock(spark: SparkSession, d: str) -> DataFrame:
    """Seconds as a clock and back."""
    c = fn.clock(F.col("l_extendedprice") / 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("clock"), fn.seconds_of(c).alias("seconds"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-W%W') AS week, dayofweek(o_orderdate)::INT AS weekday FROM orders")
def text_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks from Monday and weekdays from Sunday."""
    return table(spark, d, "orders").select("o_orderkey", fn.week_text(F.col("o_orderdate")).alias("week"), (F.dayofweek("o_orderdate") - 1).alias("weekday"))


@query("WITH p AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1) SELECT user_id, array_to_string(list_slice(l, 1, 5), ', ') || CASE WHEN len(l) > 5 THEN ' ... and ' || (len(l) - 5)::VARCHAR || ' more' ELSE '' END AS line FROM p")
def text_shortened(spark: SparkSession, d: str) -> DataFrame:
    """The first five event types of a user and how many more."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    five = e.withColumn("place", place).where("place <= 5").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"]).alias("l"))
    return five.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", fn.shortened(F.col("l"), 5, F.col("n")).alias("line"))


@query("SELECT doc_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS links, CASE WHEN length(t) > 200 THEN t[:200] || '…' ELSE t END AS cut, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM (SELECT doc_id, t, list_transform(regexp_extract_all(t, '(?i)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: replace(x, '&amp;', '&')) AS u FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    """Links, cut and escaped texts of the documents."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.array_join(fn.links(t), " ").alias("links"), fn.cut(t).alias("cut"), fn.escaped(t).alias("escaped"))


@query("WITH o AS (SELECT *, o_orderkey % 3 = 0 AS renewed FROM orders) SELECT o_orderkey, o_custkey, CASE WHEN renewed THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderdate AS created_at FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 0.0, TIMESTAMP '2024-01-01' FROM o WHERE o_orderkey % 2 = 1 AND renewed")
def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Even orders as a table, every third order renewed with a price of 0: what was there keeps its time of creation."""
    from ..sources.tables import upserted

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").alias("created_at"))
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return upserted(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


@query("SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def source_delete(spark: SparkSession, d: str) -> DataFrame:
    """Line items without those of deleted orders."""
    from ..sources.tables import without

    return without(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")))


@query("SELECT event_id, ts, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) - 1 AS k FROM events) WHERE k < 200 AND k IN (SELECT round_even(i * 199 / 15.0, 0) FROM range(16) r(i))")
def source_tail(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen samples of the last 200 events."""
    from ..sources.tables import last_lines

    return last_lines(table(spark, d, "events").select("event_id", "ts", "event_type"), "event_id", 200)[1]


_TAGS3 = "(SELECT id, list_slice(tags, 1, 3) AS l, tags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM sample_library WHERE id IS NOT NULL) WHERE rn = 1)"


@query(f"SELECT DISTINCT x.id, t.id AS tag_id, t.name FROM (SELECT id, unnest(l).name AS n FROM {_TAGS3}) x JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM tags WHERE id IS NOT NULL) WHERE rn = 1) t ON lower(trim(t.name)) = lower(regexp_replace(x.n, '^\\s+|\\s+$', '', 'g')) WHERE trim(x.n) <> '' AND NOT (x.id % 2 = 1 AND EXISTS (SELECT 1 FROM sample_library s, unnest(s.tags) u(q) WHERE s.id = x.id AND u.q.id = t.id AND s.updated_at = (SELECT max(updated_at) FROM sample_library m WHERE m.id = x.id)))")
def text_suggested_tags(spark: SparkSession, d: str) -> DataFrame:
    """Known tags in texts that list the first three tags of an item as suggested; items of odd ids have their tags already."""
    from ..catalog import Catalog, newest
    from ..tools.details import suggested_tags

    cat = Catalog(spark, d)
    rows = newest(cat.table("sample_library").select("id", "tags", "updated_at"), ["id"], "updated_at")
    names = F.filter(F.transform(F.slice("tags", 1, 3), lambda t: t["name"]), lambda n: n.isNotNull())
    texts = rows.select("id", F.concat(F.lit("Seen.\nSuggested tags:\n- "), F.array_join(names, " (likely)\n* "), F.lit("\n\nEnd.")).alias("t"))
    return suggested_tags(texts, "id", "t", cat.tags, cat.item_tags.where("item_id % 2 = 1").select(F.col("item_id").alias("id"), "tag_id"))
