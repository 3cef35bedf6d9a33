"""Preparing caption datasets: cleaning, queues, splits, tag merges, rule captions, results of batch jobs, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import caption, negative_caption, stem_ids
from ..shared import stored

#: Captions of frames without content. Exact ones without a final full stop, words of title frames,
#: signs of text and of plain backgrounds, patterns.
BLANK_NAMES = ["black frame", "a black frame", "black screen", "a black screen", "black image", "a black image", "solid black frame", "a solid black frame", "solid black screen", "a solid black screen", "completely black frame", "a completely black frame", "entirely black frame", "an entirely black frame", "solid black", "completely black", "entirely black"]
BLANK_SHORT = r"^(a |the |an )?(solid |plain |completely |entirely )?(black|dark|white|blank|empty)\s*(frame|screen|image)\.?$"
BLANK_WORDS = ["solid black", "solid white", "completely black", "entirely black"]
TITLE_WORDS = ["title card", "title screen", "title frame", "title page", "intro screen", "intro card", "intro frame", "outro screen", "outro card", "outro frame", "end screen", "end card", "end frame", "splash screen", "credits", "copyright notice"]
TITLE_PATTERNS = [
    r"(?i)\b(logo|icon|watermark)\b.{0,40}\b(black|white|solid|dark|plain)\s+(background|screen|frame)\b",
    r"(?i)^.{0,60}\bon a (solid )?(black|white|dark) (background|screen)\b",
    r"(?i)^a?\s*(solid |plain |dark )?(black|white)\s*(frame|screen|image|background)\s*(with|featuring|displaying|containing)\s*(the\s+)?(text|logo|watermark|icon|word|url|link)",
    r"(?i)^.{0,40}(text|font|letter).{0,60}(black|dark|solid)\s*(background|screen|frame)",
]
TEXT_SIGNS = ["text that reads", "text reading", "featuring the text", "with the text", "displays the text", "displaying", "written in", "twitter", "instagram", "subscribe", "follow me", ".com/", "@"]
PLAIN_SIGNS = ["black background", "white background", "dark background", "solid background", "plain background", "black frame", "black screen"]


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def caption_reason(text: Column, has_image: Column | None = None) -> Column:
    """Why a caption is left out, the first that holds: error, black_blank, title_logo, missing_image; null for a caption that is kept. A null counts as an empty caption."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    blank = F.regexp_replace(F.trim(low), r"\.+$", "").isin(BLANK_NAMES)
    blank = blank | ((F.length(text) < 60) & low.rlike(BLANK_SHORT)) | ((F.length(text) < 50) & _any(low, BLANK_WORDS))
    head = F.split(text, r"\.")[0]
    # The first pattern that fits decides; in a long caption it must fit the first sentence.
    fits = F.lit(False)
    for p in reversed(TITLE_PATTERNS):
        fits = F.when(text.rlike(p), (F.length(text) <= 200) | head.rlike(p)).otherwise(fits)
    some = _any(low, ["\x00"])
    for p in TITLE_PATTERNS:
        some = some | text.rlike(p)
    signs = (F.length(text) < 150) & _any(low, TEXT_SIGNS) & _any(low, PLAIN_SIGNS)
    title = _any(low, TITLE_WORDS) | F.when(some, fits).otherwise(signs)
    out = F.when(text.startswith("[ERROR"), "error").when(blank, "black_blank").when(title, "title_logo")
    return out if has_image is None else out.when(~has_image, "missing_image")


def clean_caption(text: Column) -> Column:
    """One kind of space, no spaces at the ends; an empty caption becomes null."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(out) > 0, out)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place, from 1 on in a total order, without bringing all rows into one task: a range sort, a count for each
    part, and the rank inside the part."""
    parts = stored(df.sort(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition.
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def group_split(df: DataFrame, group: str, held_out: float, seed: int = 0) -> DataFrame:
    """Adds split ('train' or 'val'): all rows of a group on one side, decided by a hash, so the same on every run and without a shuffle."""
    u = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return df.withColumn("split", F.when(u < held_out, "val").otherwise("train"))


def counted_split(df: DataFrame, group: str, held_out: float, salt: str = "42") -> DataFrame:
    """The same with exactly max(1, floor(held_out * groups)) groups in 'val': the first in the order of a salted md5. Rows with a null group are in 'train'."""
    groups = numbered(df.select(F.col(group).alias("g")).where("g IS NOT NULL").distinct().withColumn("h", F.md5(F.concat(F.lit(salt + ":"), F.col("g").cast("string")))), "h", "g")
    most = groups.agg(F.greatest(F.lit(1), F.floor(F.count("*") * held_out)).alias("most"))
    chosen = groups.crossJoin(F.broadcast(most)).where("place <= most").select(F.col("g").alias(group), F.lit("val").alias("split"))  # one row
    return df.join(chosen, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def merge_tags(bridge: DataFrame, item: str, tag: str, keep: int, merged: list[int]) -> DataFrame:
    """The bridge with the merged tags replaced by the kept one, each pair once."""
    return bridge.select(item, F.when(F.col(tag).isin(merged), keep).otherwise(F.col(tag)).alias(tag)).distinct()


def with_enough_tags(bridge: DataFrame, item: str, tag: str, admin: DataFrame, least: int = 5) -> DataFrame:
    """(item, tags): items with at least `least` tags that aren't among the admin ones."""
    return bridge.join(admin.select(tag), tag, "left_anti").groupBy(item).agg(F.count_distinct(tag).alias("tags")).where(F.col("tags") >= least)


def even_places(total: Column, n: int) -> Column:
    """n places from 0 to total - 1, evenly spread with both ends: round(i * (total - 1) / (n - 1)); all of them if there are no more."""
    total = total.cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda i: F.round(i * (total - 1) / F.lit(max(1, n - 1))).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= n, F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)))).otherwise(F.array_distinct(spread))


def work_queue(wanted: DataFrame, done: DataFrame, keys: list[str], batch: int | None = None) -> DataFrame:
    """What is wanted and not done, each once; the next batch of it in order."""
    left = wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")
    return left if batch is None else left.orderBy(*keys).limit(batch)


def in_chunks(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """Adds chunk, from 0 on: runs of `size` rows in a total order, to write with partitionBy."""
    return numbered(df, *order).withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int")).drop("place")


def tag_report(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n, share): how often each element of a list occurs and its share of all rows."""
    total = df.agg(F.count("*").alias("all"))
    counts = df.select(F.explode(tags).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


def rule_caption(names: Column, categories: dict[str, tuple[str, list[str]]]) -> Column:
    """A caption from a set of names: for each category (template with {}, names) that has any of them one clause, with those in alphabetical order; clauses joined by spaces."""
    clauses = []
    for template, members in categories.values():
        own = F.array_sort(F.array_intersect(names, F.array(*[F.lit(m) for m in members])))
        clauses.append(F.when(F.size(own) > 0, F.replace(F.lit(template), F.lit("{}"), F.lower(F.array_join(own, ", ")))))
    return F.concat_ws(" ", *clauses)


BATCH = "key string, error string, response struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>"


def batch_results(lines: DataFrame, line: str) -> DataFrame:
    """(key, item, frame, caption, failed) of the JSON lines of a batch job; what has no text becomes an [ERROR...] caption, a line that doesn't parse a row without key."""
    r = F.from_json(F.col(line), BATCH)
    rows = lines.select(r.alias("r"), F.get_json_object(F.col(line), "$.error").alias("error"))
    parts = F.get(F.get(F.col("r.response.candidates"), F.lit(0))["content"]["parts"], F.lit(0))["text"]
    text = F.trim(parts)
    state = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR: "), F.col("error"), F.lit("]")))
        .when(F.col("r.response").isNull(), "[ERROR: empty response]")
        .when(F.coalesce(F.size("r.response.candidates"), F.lit(0)) < 1, "[ERROR: no candidates]")
        .when(parts.isNull(), "[ERROR: no text in response]")
        .when(text == "", "[ERROR: empty caption]")
        .otherwise(text)
    )
    item, frame = stem_ids(F.col("r.key"))
    return rows.select(F.col("r.key").alias("key"), item.alias("item"), frame.alias("frame"), state.alias("caption"), state.startswith("[ERROR").alias("failed"))


def uncaptioned(images: DataFrame, captions: DataFrame, stem: str) -> DataFrame:
    """(item, frames): images without a caption by the item in their name."""
    left = images.select(stem).join(captions.select(stem), stem, "left_anti")
    return left.select(stem_ids(F.col(stem))[0].alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("frames"))


def frame_count(seconds: Column, fps: float = 1.0, least: int = 1, most: int | None = None) -> Column:
    """Frames of a length: floor(seconds * fps), at least `least`, at most `most`; `least` for an unknown length."""
    n = F.greatest(F.lit(least), F.floor(F.coalesce(seconds, F.lit(0.0)) * fps).cast("int"))
    return n if most is None else F.least(F.lit(most), n)


def rate_windows(requests: DataFrame, client: str, time: str, tokens: str, seconds: int = 60, most_requests: int = 60, most_tokens: int = 100_000) -> DataFrame:
    """Adds requests, tokens of the last `seconds` of each client and whether the next one must wait."""
    w = Window.partitionBy(client).orderBy(F.unix_timestamp(F.col(time).cast("timestamp"))).rangeBetween(-seconds, 0)
    return requests.withColumn("requests", F.count("*").over(w)).withColumn("used", F.round(F.sum(tokens).over(w), 4)).withColumn("wait", (F.col("requests") >= most_requests) | (F.col("used") >= most_tokens))


def job_status(wanted: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """One row of a job's state: wanted, done, failed (and not done since), left, percent."""
    rows = wanted.select(key).distinct().join(done.select(key, F.lit(1).alias("d")).distinct(), key, "left").join(failed.select(key, F.lit(1).alias("f")).distinct(), key, "left")
    out = rows.agg(F.count("*").alias("wanted"), F.count("d").alias("done"), F.count_if(F.col("d").isNull() & F.col("f").isNotNull()).alias("failed"))
    return out.select("*", (F.col("wanted") - F.col("done") - F.col("failed")).alias("left"), F.round(100 * F.col("done") / F.nullif(F.col("wanted"), F.lit(0)), 4).alias("pct"))


def run_listing(states: DataFrame, configs: DataFrame, losses: DataFrame, run: str, started: str, step: str, loss: str) -> DataFrame:
    """Runs newest first with their config, number of steps, last and least loss."""
    sums = losses.groupBy(run).agg(F.count("*").alias("steps"), F.round(F.max_by(loss, step), 6).alias("last_loss"), F.round(F.min(loss), 6).alias("least_loss"))
    return states.join(configs, run, "left").join(sums, run, "left").withColumn("steps", F.coalesce("steps", F.lit(0))).orderBy(F.desc_nulls_last(started), run)


# ---- labelling


def synced_sessions(sessions: DataFrame, progress: DataFrame, session: str, frame: list[str]) -> DataFrame:
    """The sessions with the numbers of labelled and skipped frames: of the reports of a frame the one with the greatest seq counts."""
    last = progress.groupBy(session, *frame).agg(F.max_by("status", "seq").alias("status"))
    sums = last.groupBy(session).agg(F.count_if(F.col("status") == "labeled").alias("labeled"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    return sessions.join(sums, session, "left").withColumn("labeled", F.coalesce("labeled", F.lit(0))).withColumn("skipped", F.coalesce("skipped", F.lit(0)))


def labelled_frames(annotations: DataFrame, frame: list[str], tag: str, label: str, template: str = "a frame featuring {tags}") -> DataFrame:
    """(frame, caption, negative): frames with confirmed tags, captions of these and of the rejected ones, in alphabetical order."""
    picked = lambda kind: F.array_sort(F.collect_set(F.when(F.col(label) == kind, F.col(tag))))
    rows = annotations.groupBy(*frame).agg(picked("confirmed").alias("_yes"), picked("rejected").alias("_no")).where(F.size("_yes") > 0)
    return rows.select(*frame, caption(F.col("_yes"), template).alias("caption"), negative_caption(F.col("_no")).alias("negative"))


def write_tar_shards(rows: DataFrame, name: str, columns: dict[str, str], folder: str) -> None:
    """Writes rows as tar files, one per partition: a member name.extension for each (extension: column). Streams a partition, so its size doesn't matter; folder must be one all executors share."""
    import io
    import os
    import tarfile

    def write(part):
        from pyspark import TaskContext

        context = TaskContext.get()
        path = os.path.join(folder, f"shard-{context.partitionId():05d}.tar")
        temporary = f"{path}.{context.taskAttemptId()}"
        any_row = False
        with tarfile.open(temporary, "w") as tar:
            for r in part:
                any_row = True
                for extension, column in columns.items():
                    value = r[column]
                    if value is not None and value != "":
                        data = bytes(value) if isinstance(value, (bytes, bytearray)) else str(value).encode("utf-8")
                        info = tarfile.TarInfo(f"{r[name]}.{extension}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        os.replace(temporary, path) if any_row else os.remove(temporary)

    os.makedirs(folder, exist_ok=True)
    rows.foreachPartition(write)
