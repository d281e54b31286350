"""Operations tables: reports, logs, storage, catalogs and runs. IDs are those of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import VERDICTS
from .similar import dealt


def verdict_tally(report: DataFrame, by: list[str] = ()) -> DataFrame:
    """[D9] Lines of each verdict, others, and the share that match."""
    v = F.coalesce("verdict", F.lit("other"))
    counts = [F.count_if(v == x).alias(x) for x in reversed(VERDICTS)]
    d = report.groupBy(*by).agg(*counts, F.count_if(~v.isin(VERDICTS)).alias("other"), F.count("*").alias("total"))
    return d.withColumn("rate", F.when(F.col("total") > 0, F.col("match") / F.col("total")).otherwise(0.0))


def step_summary(log: DataFrame, by: list[str] = ("run_id",)) -> DataFrame:
    """[D10] log(run_id, idx, ok, engine, error, source): totals, distinct first failures and retries, engines, failed rows."""
    return log.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("source") == "skip").alias("skipped"),
        F.count_distinct(F.when(~F.col("ok") & (F.col("source") == "fresh"), F.col("idx"))).alias("first_failures"), F.count_distinct(F.when(F.col("source") == "retry", F.col("idx"))).alias("retried"),
        F.array_sort(F.collect_set("engine")).alias("engines"), F.array_sort(F.filter(F.collect_list(F.when(~F.col("ok"), F.struct("idx", "error"))), lambda x: x.isNotNull())).alias("failures"),
    )


def storage_rollup(items: DataFrame) -> DataFrame:
    """[D11] Bytes and files of each group, each tier and overall, and what could be reclaimed (safe and deletable)."""
    d = items.rollup("tier", "group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"), F.coalesce(F.sum(F.when((F.col("tier") == "safe") & F.col("deletable"), F.col("size"))), F.lit(0)).alias("reclaimable"), F.grouping_id().alias("level"))
    return d


def timeline_summary(segs: DataFrame, by: str = "media_id", most: int = 60) -> DataFrame:
    """[D12] Number, total, longest and shortest segment, range of volume, and the numbers of short, muted and invalid ones."""
    n = F.col("end_s") - F.col("start_s")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("seg_no"))))
    return segs.groupBy(by).agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.min("volume").alias("volume_min"), F.max("volume").alias("volume_max"), listed(n < 1).alias("short"), listed(F.col("volume") <= 0.001).alias("muted"), listed(n < 0.05).alias("invalid"), (F.count("*") > most).alias("too_many"))


def all_tags(meta: DataFrame) -> DataFrame:
    """[D13] Distinct tags in order."""
    return meta.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def task_counts(tasks: DataFrame, by: list[str] = ()) -> DataFrame:
    """[D18] Running, done and failed tasks."""
    return tasks.groupBy(*by).agg(F.count_if(~F.col("done")).alias("running"), F.count_if(F.col("done") & F.col("error").isNull()).alias("done"), F.count_if(F.col("done") & F.col("error").isNotNull()).alias("failed"))


def alignment_coverage(alignment: DataFrame, lines: DataFrame, by: str = "media_id") -> DataFrame:
    """[D19] Share of lines with a scene, with a warning under 95 %."""
    hit = alignment.select(by, "line_no").distinct().withColumn("hit", F.lit(1))
    d = lines.hint("merge").join(hit, [by, "line_no"], "left").groupBy(by).agg(F.count("*").alias("total"), F.count("hit").alias("aligned"))
    return d.withColumn("percent", F.col("aligned") / F.col("total") * 100).withColumn("warn", F.col("aligned") < 0.95 * F.col("total"))


def ab_compare(rows: DataFrame, baselines: list[str], variant: str = "variant", order: str | list[str] = ("media_id", "line_no")) -> DataFrame:
    """[D20] rows(variant, media_id, line_no, overlap, cosine, density, start_s, end_s, dur): means of each variant, steps back,
    spans out of bounds, and the gain of its mean overlap over the strongest baseline."""
    order = [order] if isinstance(order, str) else list(order)
    before = F.lag("end_s").over(W.partitionBy(variant, *order[:-1]).orderBy(order[-1]))
    d = rows.withColumn("_cw_b", before).groupBy(variant).agg(
        F.avg("overlap").alias("mean_overlap"), F.count_if(F.col("overlap") >= 0.15).alias("hits"), F.avg("cosine").alias("mean_cosine"), F.avg("density").alias("mean_density"),
        F.count_if(F.col("start_s") < F.col("_cw_b") - 0.01).alias("backward"), F.count_if((F.col("start_s") < 0) | (F.col("end_s") > F.col("dur") + 0.01)).alias("out_of_bounds"),
    )
    best = d.where(F.col(variant).isin(baselines)).agg(F.max("mean_overlap").alias("base"))
    return d.crossJoin(F.broadcast(best)).withColumn("gain", F.when(F.col("base") > 0, F.col("mean_overlap") / F.col("base") - 1)).drop("base")  # one row


def analysis_health(segs: DataFrame, by: str = "run_id") -> DataFrame:
    """[D21] segs(run_id, dialogue, main_line, draft): share of segments with each, in percent."""
    share = lambda c: (F.avg(F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, 100.0).otherwise(0.0))).alias(f"{c}_percent")
    return segs.groupBy(by).agg(F.count("*").alias("segments"), share("dialogue"), share("main_line"), share("draft"))


def mean_abs_error(pred: DataFrame, truth: DataFrame, keys: list[str] = ("media_id", "line_no"), limit: float = 90.0) -> DataFrame:
    """[D22] Mean and largest time error of each timeline, and how many exceed the limit."""
    d = pred.select(*keys, F.col("t_s").alias("p")).join(truth.select(*keys, F.col("t_s").alias("q")), list(keys))
    e = F.abs(F.col("p") - F.col("q"))
    return d.groupBy(keys[0]).agg(F.avg(e).alias("mean_error"), F.max(e).alias("max_error"), F.count_if(e > limit).alias("far"))


def act_groups(scenes: DataFrame, n: int = 12, by: str = "media_id") -> DataFrame:
    """[D23] Ordered stories in n groups of nearly equal number, bounds at round(a * m / n): start, end and items of each."""
    w = W.partitionBy(by)
    d = scenes.withColumn("_cw_i", F.row_number().over(w.orderBy("scene_no")) - 1).withColumn("_cw_n", F.count("*").over(w))
    bound = lambda a: F.bround(a * F.col("_cw_n") / F.lit(n), 0)
    groups = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda a: (bound(a) <= F.col("_cw_i")) & (F.col("_cw_i") < bound(a + 1)))
    d = d.withColumn("act_no", F.get(groups, 0))
    return d.groupBy(by, "act_no").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("scene_no", "story"))).alias("items"))


def material_digest(story: DataFrame, cap: int = 40, by: str = "media_id") -> DataFrame:
    """[D24] Ordered stories merged in runs of ceil(n / cap), with the first three distinct ones of each run."""
    w = W.partitionBy(by)
    d = story.withColumn("_cw_i", F.row_number().over(w.orderBy("scene_no")) - 1).withColumn("_cw_step", F.ceil(F.count("*").over(w) / cap))
    d = d.groupBy(by, F.floor(F.col("_cw_i") / F.col("_cw_step")).cast("int").alias("part"))
    d = d.agg(F.min("scene_no").alias("first_scene"), F.array_sort(F.collect_list(F.struct("scene_no", "story"))).alias("s"))
    return d.select(by, "part", "first_scene", F.array_join(F.slice(F.array_distinct(F.col("s.story")), 1, 3), "；").alias("digest"))


def append_run(history: DataFrame, entry: DataFrame, keep: int = 100) -> tuple[DataFrame, DataFrame]:
    """[A12] (kept, dropped): the newest ``keep`` rows of history and entry, and the rest. Each task keeps its own newest rows, so the
    history never stands in one task."""
    d = history.unionByName(entry, allowMissingColumns=True)
    kept = d.orderBy(F.desc("time"), "file", *[c for c in d.columns if c not in ("time", "file")]).limit(keep)
    return kept, d.exceptAll(kept)


# Kinds of media by extension.
KINDS = {"mp4": "video", "mkv": "video", "mov": "video", "avi": "video", "webm": "video", "flv": "video", "jpg": "image", "jpeg": "image", "png": "image", "webp": "image", "gif": "image", "bmp": "image"}


def material_catalog(files: DataFrame, meta: DataFrame | None = None, kinds: dict[str, str] = KINDS) -> DataFrame:
    """[A13] files(name, size, mtime) of known extensions, with tags and favourites of meta(name, tags, favorite) or defaults."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    d = files.withColumn("kind", kind).where(F.col("kind").isNotNull())
    if meta is None:
        return d.withColumn("tags", F.array().cast("array<string>")).withColumn("favorite", F.lit(False))
    d = d.join(meta.select("name", "tags", "favorite"), "name", "left")
    return d.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("favorite", F.coalesce("favorite", F.lit(False)))


# Order of artefact kinds and of names among videos.
ARTEFACTS = [("video", r"\.(?:mp4|mov|mkv|webm)$"), ("cover", r"\.(?:jpg|jpeg|png|webp)$"), ("audio", r"\.(?:wav|mp3|m4a)$"), ("subtitle", r"\.(?:srt|ass|vtt)$"), ("data", r"\.json$"), ("text", r"\.(?:txt|md)$")]
VIDEO_RANK = [r"final|成片", r"output|result", r"narrat", r"clip"]


def artefact_inventory(files: DataFrame, by: str = "run_id") -> DataFrame:
    """[A14] files(run_id, name, size): kind of each by extension, its order, and whether it is the run's best video or first small
    text. Files are dealt by run to a given number of parts and sorted once, so a task holds a part of them once."""
    files = dealt(files, by)
    rank, kind = F.lit(len(ARTEFACTS)), F.lit("other")
    for k, (name, pattern) in reversed(list(enumerate(ARTEFACTS))):
        hit = F.lower("name").rlike(pattern)
        rank, kind = F.when(hit, k).otherwise(rank), F.when(hit, name).otherwise(kind)
    video: Column = F.lit(len(VIDEO_RANK))
    for k, pattern in reversed(list(enumerate(VIDEO_RANK))):
        video = F.when(F.lower("name").rlike(pattern), k).otherwise(video)
    d = files.withColumn("kind", kind).withColumn("kind_rank", rank)
    d = d.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy("kind_rank", "name")) - 1)
    small, run = (F.col("kind") == "text") & (F.col("size") <= 1 << 20), W.partitionBy(by)
    best = F.min(F.when(F.col("kind") == "video", F.struct(video.alias("rank"), "name", "pos"))).over(run)
    d = d.withColumn("best_video", (F.col("kind") == "video") & (F.col("pos") == best["pos"]))
    d = d.withColumn("first_text", small & (F.col("pos") == F.min(F.when(small, F.col("pos"))).over(run)))
    return d.select(*files.columns, "kind", "kind_rank", "best_video", "first_text", "pos")
