"""Filters, validation, top-k and thinning, all native. IDs are those of the survey."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import IMPORTANCE
from ..functions.text import cjk_count, is_placeholder, is_promotion, line_weight, strip_markup
from .joins import midpoint_join

MEDIA = "media_id"


def clean_cues(cues: DataFrame, media: DataFrame | None = None, near: Column | None = None, window: float = 240.0) -> DataFrame:
    """[B1] Cues with readable times, end > start and text; with media(media_id, dur) none that end over half a second late; with
    ``near`` only those within ``window`` seconds."""
    d = cues.withColumn("start_s", F.col("start_s").try_cast("double")).withColumn("end_s", F.col("end_s").try_cast("double"))
    d = d.where((F.col("end_s") > F.col("start_s")) & (F.trim("text") != ""))
    if media is not None:
        d = d.join(media.select(MEDIA, "dur"), MEDIA).where(F.col("end_s") <= F.col("dur") + 0.5).drop("dur")
    return d.where((F.col("end_s") >= near - window) & (F.col("start_s") <= near + window)) if near is not None else d


def _clamped(segs: DataFrame, shortest: float, longest: float) -> DataFrame:
    a = F.least(F.greatest(F.col("start_s").try_cast("double"), F.lit(0.0)), F.col("dur"))
    b = F.least(F.greatest(F.col("end_s").try_cast("double"), F.lit(0.0)), F.col("dur"))
    d = segs.withColumn("start_s", a).withColumn("end_s", b).where(F.col("end_s") - F.col("start_s") >= shortest)
    return d.withColumn("end_s", F.bround(F.least("end_s", F.col("start_s") + longest), 2)).withColumn("start_s", F.bround("start_s", 2))


def validate_segments(segs: DataFrame, shortest: float = 3.0, longest: float = 600.0, n: int = 20) -> DataFrame:
    """[B2] segs(media_id, start_s, end_s, dur): held in [0, dur], short ones dropped, long ones cut, the first n by start."""
    d = _clamped(segs, shortest, longest)
    place = F.row_number().over(W.partitionBy(MEDIA).orderBy("start_s", "end_s"))
    return d.withColumn("_cw", place).where(F.col("_cw") <= n).drop("_cw")


def validate_timeline(segs: DataFrame, shortest: float = 2.0, longest: float = 600.0, n: int = 60, pos: str = "pos") -> DataFrame:
    """[B3] As B2 in the user's own order, with a volume held in 0..2; one that is missing or not a number is 1."""
    volume = F.coalesce(F.nanvl(F.col("volume").try_cast("double"), F.lit(1.0)), F.lit(1.0))
    d = _clamped(segs, shortest, longest).withColumn("volume", F.least(F.greatest(volume, F.lit(0.0)), F.lit(2.0)))
    place = F.row_number().over(W.partitionBy(MEDIA).orderBy(pos))
    return d.withColumn("_cw", place).where(F.col("_cw") <= n).drop("_cw")


def search_runs(runs: DataFrame, keyword: str) -> DataFrame:
    """[B4] Runs whose time, file, captions or kind hold the keyword, in any case."""
    text = F.lower(F.concat_ws(" ", F.col("time").cast("string"), "file", F.array_join("captions", " "), "kind"))
    return runs.where(F.contains(text, F.lit(keyword.strip().lower())))


def search_catalog(music: DataFrame, query: str | None) -> DataFrame:
    """[B5] Tracks whose title, genre or id hold the query; an empty query keeps all."""
    q = (query or "").strip().lower()
    return music.where(F.contains(F.lower(F.concat_ws(" ", "title", "genre", F.col("id").cast("string"))), F.lit(q))) if q else music


def informative_lines(cues: DataFrame, least: float = 0.40, text: str = "text") -> DataFrame:
    """[B6] Cues that are not one unit said over and over."""
    return cues.where(line_weight(text) >= least)


def clean_onscreen(cues: DataFrame, extra: list[str] = (), text: str = "text") -> DataFrame:
    """[B7] Without burnt-in captions that are blank, digits or promotion."""
    return cues.where(~is_promotion(text, list(extra)))


def reject_placeholders(lines: DataFrame, text: str = "text") -> DataFrame:
    """[B8] Lines with a flag where they only echo a template."""
    return lines.withColumn("placeholder", is_placeholder(text))


# What a cleaner may list, as anchored paths.
ALLOWED = [r"^run_[\w-]+/.+$", r"^previews/[^/]+$", r"^thumbs/[^/]+$", r"^cache/.+$", r"^tmp/.+$", r"^logs/[^/]+\.log$", r"^outputs/[^/]+\.(?:mp4|srt|json|wav)$"]


def allowlist(items: DataFrame, patterns: list[str] = ALLOWED, rel: str = "rel") -> DataFrame:
    """[B9] Items whose relative path matches a pattern, does not start with a slash and has no '..' part."""
    ok = F.col(rel).rlike("|".join(f"(?:{p})" for p in patterns)) & ~F.col(rel).rlike(r"^[/\\]")
    return items.where(ok & ~F.exists(F.split(rel, r"[/\\]"), lambda x: x == ".."))


def line_filter_min(lines: DataFrame, zh_ratio: float = 0.7, min_len: int = 10, by: str = MEDIA, text: str = "text") -> DataFrame:
    """[B10] Where 70 % of a script's lines have two CJK letters, lines with fewer go; so do lines under ten characters without
    their marks."""
    zh = (cjk_count(text) >= 2).cast("double")
    d = lines.withColumn("_cw_share", F.avg(zh).over(W.partitionBy(by)))
    return d.where((F.col("_cw_share") < zh_ratio) | (cjk_count(text) >= 2)).where(F.length(strip_markup(text)) >= min_len).drop("_cw_share")


def keep_default(segs: DataFrame, cues: DataFrame) -> DataFrame:
    """[B11] keep where a cue's middle lies in the segment, else cut_candidate with a reason."""
    said = midpoint_join(cues.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0), segs.select(MEDIA, "seg_no", "start_s", "end_s")).groupBy(MEDIA, F.col("seg_seg_no").alias("seg_no")).agg(F.count("*").alias("n_cues"))
    d = segs.hint("merge").join(said, [MEDIA, "seg_no"], "left").withColumn("n_cues", F.coalesce("n_cues", F.lit(0)))
    return d.withColumn("decision", F.when(F.col("n_cues") > 0, "keep").otherwise("cut_candidate")).withColumn("why", F.when(F.col("n_cues") > 0, "dialogue").otherwise("no dialogue"))


def force_cut(plans: DataFrame) -> DataFrame:
    """[B12] Whether a plan removes something or covers under 80 %."""
    return plans.withColumn("force_cut", (F.col("removed") > 0) | (F.col("coverage") < 80))


def filter_materials(materials: DataFrame, tags: list[str] = (), favorite: bool = False, query: str = "") -> DataFrame:
    """[B13] Materials with all of the tags, favourites if asked, names that hold the query."""
    d = materials.where(F.forall(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), lambda t: F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), t))) if tags else materials
    d = d.where(F.coalesce("favorite", F.lit(False))) if favorite else d
    return d.where(F.contains(F.lower("name"), F.lit(query.lower()))) if query else d


def tail(log: DataFrame, n: int = 200, pos: str = "pos") -> DataFrame:
    """[B14] The last n rows, n held in 1..2000."""
    return log.orderBy(F.desc(pos)).limit(max(1, min(2000, n)))


def bucket_argmax(beats: DataFrame, top_k: int, t: str = "t_s", strength: str = "strength", by: str = "track_id") -> DataFrame:
    """With more than top_k beats, the strongest (the earliest of equal ones) of each of top_k equal stretches of time."""
    all_ = W.partitionBy(by)
    d = beats.withColumn("_cw_n", F.count("*").over(all_)).withColumn("_cw_end", F.max(t).over(all_))
    bucket = F.least(F.floor(F.col(t) / F.greatest(F.col("_cw_end") / top_k, F.lit(1e-9))), F.lit(top_k - 1))
    few = d.where(F.col("_cw_n") <= top_k).select(by, F.col(t), F.col(strength))
    many = d.where(F.col("_cw_n") > top_k).groupBy(by, bucket.alias("_cw_b")).agg(F.max_by(F.struct(t, strength), F.struct(F.col(strength), -F.col(t))).alias("m"))
    return few.unionByName(many.select(by, f"m.{t}", f"m.{strength}"))


def even_cap(rows: DataFrame, cap: int, order: str | list[str], by: str = MEDIA, last: bool = False) -> DataFrame:
    """At most ``cap`` rows a timeline: those at int(k * n / cap); with ``last`` the last row takes the last place."""
    w = W.partitionBy(by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    d = rows.withColumn("_cw_n", n).withColumn("_cw_i", i)
    k = F.ceil(F.col("_cw_i") * cap / F.col("_cw_n"))
    hit = F.floor(k * F.col("_cw_n") / cap) == F.col("_cw_i")
    if last:
        hit = (hit & (k < cap - 1)) | (F.col("_cw_i") == F.col("_cw_n") - 1)
    return d.where((F.col("_cw_n") <= cap) | (hit & (k < cap)) | (F.lit(last) & (F.col("_cw_i") == F.col("_cw_n") - 1))).drop("_cw_n", "_cw_i")


def keep_budget(lines: DataFrame, target: Column | float, dur: Column | float, by: str = MEDIA) -> DataFrame:
    """lines(media_id, line_no, importance, dur): keep by importance, then the shorter, until the target; 'advance' may fill
    110 % of it, 'key' is always kept, and so are the first max(2, int(0.35 n)). Targets outside (0, 0.98 dur) keep all. What
    is kept is a prefix of the order, so running sums suffice."""
    target, whole = (x if isinstance(x, Column) else F.lit(float(x)) for x in (target, dur))
    rank = F.array_position(F.array(*[F.lit(x) for x in IMPORTANCE]), F.coalesce("importance", F.lit("advance")))
    w = W.partitionBy(by).orderBy(F.desc("_cw_r"), "dur", "line_no")
    d = lines.withColumn("_cw_r", rank).withColumn("_cw_n", F.count("*").over(W.partitionBy(by)))
    d = d.withColumn("_cw_i", F.row_number().over(w)).withColumn("_cw_before", F.coalesce(F.sum("dur").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    floor = F.greatest(F.lit(2), F.floor(0.35 * F.col("_cw_n")))
    keep = (F.col("importance") == "key") | (F.col("_cw_before") < target) | ((F.coalesce("importance", F.lit("advance")) == "advance") & (F.col("_cw_before") < 1.1 * target)) | (F.col("_cw_i") <= floor)
    return d.withColumn("keep", F.when((target <= 0) | (target >= 0.98 * whole), F.lit(True)).otherwise(keep)).drop("_cw_r", "_cw_n", "_cw_i", "_cw_before")


def select_expired(items: DataFrame, now: float, days: float = 14, most: int = 60, by: list[str] = ()) -> DataFrame:
    """Items to delete: older than ``days`` or beyond the newest ``most``; never within 24 hours."""
    age = (F.lit(float(now)) - F.col("mtime")) / 86400.0
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("mtime"), "name"))
    return items.withColumn("age_days", age).withColumn("_cw", place).where(((F.col("age_days") > days) | (F.col("_cw") > most)) & (F.col("age_days") >= 1)).drop("_cw")


def best_cover(frames: DataFrame, by: str = MEDIA) -> DataFrame:
    """[F8] The frame of best 0.6 contrast + 2 detail - 40 extreme; the first of equals."""
    score = 0.6 * F.col("contrast") + 2 * F.col("detail") - 40 * F.col("extreme")
    d = frames.withColumn("score", score)
    return d.groupBy(by).agg(F.max_by(F.struct("frame_no", "score"), F.struct("score", -F.col("frame_no"))).alias("b")).select(by, "b.frame_no", "b.score")


def argmax_scene(scores: DataFrame, by: list[str] = (MEDIA, "line_no")) -> DataFrame:
    """The best scene of each line, the first of equals."""
    return scores.groupBy(*by).agg(F.max_by(F.struct("scene_no", "score"), F.struct("score", -F.col("scene_no"))).alias("b")).select(*by, "b.scene_no", "b.score")


def sort_timeline(segs: DataFrame, by: str = MEDIA) -> DataFrame:
    """Place of each segment by start, then end."""
    return segs.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy("start_s", "end_s")) - 1)


def top_k_non_overlapping(cands: DataFrame, k: int = 3, ratio: float = 0.5, by: list[str] = (MEDIA,)) -> DataFrame:
    """Candidates by score; one is passed over if a kept one covers more than ``ratio`` of it; k are kept. -> (by..., rank, start_s,
    end_s, score). Groups stream through their tasks sorted, a task holds k kept ones; a candidate without times is kept only as
    the first of its group."""
    by = list(by)
    d = cands.select(*by, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.col("score").cast("double").alias("score"))
    schema = T.StructType([*[d.schema[c] for c in by], T.StructField("rank", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("start_s", "end_s", "score")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            *keys, starts, ends, _ = (c.to_pylist() for c in batch.columns)
            take, rank = [], []
            for i, (own, start, end) in enumerate(zip(zip(*keys, strict=True), starts, ends, strict=True)):
                if own != group:
                    group, kept = own, []
                if len(kept) == k:
                    continue
                if kept and (start is None or end is None or any(a is None or b is None or (min(end, b) - max(start, a)) / max(end - start, 1e-9) > ratio for a, b in kept)):
                    continue
                take.append(i)
                rank.append(len(kept))
                kept.append((start, end))
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[: len(by)], pa.array(rank, pa.int32()), *out.columns[len(by) :]], schema.names)

    order = [*by, F.desc_nulls_first("score"), "start_s", "end_s"]
    return d.repartition(*by).sortWithinPartitions(*order).mapInArrow(run, schema)


def order_tasks(tasks: DataFrame) -> DataFrame:
    """Unfinished first, then by run id."""
    return tasks.orderBy("done", "run_id")
