"""Window operators on signals: one row a window or a frame, ordered within a timeline. IDs are those of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .similar import written

MEDIA = "media_id"


def _w(by: str | list[str], order: str | list[str]) -> W:
    return W.partitionBy(by).orderBy(order)


def pct_rank(df: DataFrame, col: str, order: str = "win", out: str = "rank", ties: bool = False, by: str = MEDIA) -> DataFrame:
    """[E1, E2] Rank in 0..1 within a timeline: (row - 1) / (n - 1) by (value, order); with ``ties`` the mean rank of equal
    values; 0.5 where values differ by at most 1e-9 overall."""
    w = _w(by, col) if ties else _w(by, [col, order])
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one order for all of them: one sort
    n = F.count("*").over(all_)
    flat = (F.max(col).over(all_) - F.min(col).over(all_) <= 1e-9) | (n <= 1)
    place = (F.rank().over(w) + F.count("*").over(w)) / 2 - 1 if ties else F.row_number().over(w) - 1  # the first and last of equals
    return df.withColumn(out, F.when(flat, 0.5).otherwise(place / (n - 1)))


def range_places(df: DataFrame, order: list[str], by: str = MEDIA, out: str = "place", count: str = "n") -> DataFrame:
    """Place of each row (from 0) within its timeline by ``order``, and the timeline's number of rows, however many tasks it lies in: rows
    are sorted over ranges of (timeline, order) and numbered in each range; what stands before a range is a sum over ranges."""
    d = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_cw_id", F.monotonically_increasing_id())
    d = written(d).withColumn("_cw_p", F.shiftright("_cw_id", 33))
    parts = d.groupBy(by, "_cw_p").agg(F.min("_cw_id").alias("_cw_first"), F.count("*").alias("_cw_k"))
    w = W.partitionBy(by)
    before = F.coalesce(F.sum("_cw_k").over(w.orderBy("_cw_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_cw_b", before).withColumn(count, F.sum("_cw_k").over(w)).drop("_cw_k")
    key = F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("a._cw_p") == F.col("b._cw_p"))
    d = d.alias("a").join(parts.alias("b").hint("merge"), key)
    return d.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_cw_id") - F.col("_cw_first") + F.col("_cw_b")).alias(out), count)


def pct_rank_wide(df: DataFrame, col: str, order: str = "win", out: str = "rank", ties: bool = False, by: str = MEDIA) -> DataFrame:
    """[E1, E2] As pct_rank, for timelines of any length: no task sorts one alone. The mean rank of equal values comes from their counts."""
    d = range_places(df, [col, order], by, "_cw_i", "_cw_n")
    flat = d.groupBy(by).agg((F.max(col) - F.min(col) <= 1e-9).alias("_cw_flat")).withColumnRenamed(by, "_cw_by")
    if ties:
        same = d.groupBy(F.col(by).alias("_cw_m"), F.col(col).alias("_cw_v")).agg(F.avg("_cw_i").alias("_cw_mean"))
        d = d.hint("merge").join(same, F.col(by).eqNullSafe(F.col("_cw_m")) & F.col(col).eqNullSafe(F.col("_cw_v")))
    d = d.hint("merge").join(flat, F.col(by).eqNullSafe(F.col("_cw_by")))
    place = F.col("_cw_mean") if ties else F.col("_cw_i")
    rank = F.when(F.coalesce("_cw_flat", F.lit(False)) | (F.col("_cw_n") <= 1), 0.5).otherwise(place / (F.col("_cw_n") - 1))
    return d.select(*df.columns, rank.alias(out))


def percentiles_wide(df: DataFrame, col: str, shares: list[float], by: str = MEDIA) -> DataFrame:
    """[D17] (by, q): the percentiles of each timeline, between neighbours in proportion, from the places of its values; a timeline may be
    of any length. Nulls are left out."""
    d = range_places(df.where(F.col(col).isNotNull()).select(by, F.col(col).cast("double").alias("_cw_x")), ["_cw_x"], by, "_cw_i", "_cw_n")
    at = lambda q: F.lit(q) * (F.col("_cw_n") - 1)
    one = [F.max(F.when(F.col("_cw_i") == f(at(q)), F.col("_cw_x"))).alias(f"_cw_{name}{k}") for k, q in enumerate(shares) for name, f in (("a", F.floor), ("b", F.ceil))]
    d = d.groupBy(by).agg(F.max("_cw_n").alias("_cw_n"), *one)
    q = [F.col(f"_cw_a{k}") + (F.col(f"_cw_b{k}") - F.col(f"_cw_a{k}")) * (at(s) - F.floor(at(s))) for k, s in enumerate(shares)]
    return d.select(by, F.array(*q).alias("q"))


def smooth(df: DataFrame, col: str, k: int, order: str = "win", out: str = "smooth", by: str = MEDIA) -> DataFrame:
    """[E3] Centred moving sum over min(k, n) windows, divided by that count; nothing beyond the ends."""
    n = F.count("*").over(_w(by, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    full = F.sum(col).over(_w(by, order).rowsBetween(-(k // 2), (k - 1) // 2)) / k
    short = df
    if k > 1:  # timelines shorter than k use k = n
        for m in range(1, k):
            own = F.sum(col).over(_w(by, order).rowsBetween(-(m // 2), (m - 1) // 2)) / m
            full = F.when(n == m, own).otherwise(full)
    return short.withColumn(out, full)


def fuse(df: DataFrame, weights: dict[str, float], out: str = "fused", by: str = MEDIA) -> DataFrame:
    """[E4] Weighted mean of rank columns; one that is null all through a timeline drops out and its weight goes to the rest,
    single nulls count as 0.5."""
    here = {c: F.max(F.col(c).isNotNull().cast("int")).over(W.partitionBy(by)) for c in weights}
    top = sum((F.lit(w) * here[c] * F.coalesce(F.col(c), F.lit(0.5)) for c, w in weights.items()), F.lit(0.0))
    low = sum((F.lit(w) * here[c] for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, F.when(low > 0, top / low).otherwise(0.0))


def local_peaks(df: DataFrame, col: str, half: int, threshold: Column | float = 0.0, order: str = "win", by: str = MEDIA) -> DataFrame:
    """[E5] Rows at or above the threshold that equal the maximum of ``half`` rows to either side."""
    top = F.max(col).over(_w(by, order).rowsBetween(-half, half))
    out = df.withColumn("_cw_top", top)
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return out.where((F.col(col) >= threshold) & (F.col(col) >= F.col("_cw_top") - 1e-9)).drop("_cw_top")


def thin_min_gap(df: DataFrame, gap: float, t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """Points at least ``gap`` after the last kept one, in order of time. -> (by, t)"""
    kept = F.aggregate(F.array_sort(F.collect_set(t)), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= gap), F.array_append(a, x.cast("double"))).otherwise(a))
    return df.groupBy(by).agg(kept.alias("_cw_t")).select(by, F.explode("_cw_t").alias(t))


def onset_peaks(df: DataFrame, delta: float, wait: float, col: str = "strength", t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[E6] Onsets: at least delta, the maximum of 8 rows either way, above their mean by delta, and ``wait`` apart."""
    w = _w(by, t).rowsBetween(-8, 8)
    found = df.withColumn("_cw_m", F.max(col).over(w)).withColumn("_cw_a", F.avg(col).over(w))
    found = found.where((F.col(col) >= delta) & (F.col(col) >= F.col("_cw_m") - 1e-9) & (F.col(col) > F.col("_cw_a") + delta))
    return thin_min_gap(found, wait, t, by)


def motion_cuts(frames: DataFrame, strength: str = "normal", gap: float = 0.6, col: str = "frac", t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[E7] Peaks of motion above max(P75 + 1.5 IQR, 0.004) (soft 1.6 times, strong half of it) and pauses below 0.9 P25, rounded,
    distinct, thinned. The first frame is left out of quantiles; timelines under five frames give none."""
    w = _w(by, t)
    d = frames.withColumn("_cw_n", F.row_number().over(w)).withColumn("_cw_all", F.count("*").over(W.partitionBy(by)))
    d = d.withColumn("_cw_b", F.lag(col).over(w)).withColumn("_cw_f", F.lead(col).over(w))
    q = d.where("_cw_n > 1").groupBy(by).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    scale = {"soft": 1.6, "strong": 0.5}.get(strength, 1.0)
    d = d.where("_cw_all >= 5 and _cw_n > 1").join(q, by)
    high = F.greatest(F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]), F.lit(0.004)) * scale
    x, before, after = F.col(col), F.col("_cw_b"), F.col("_cw_f")
    peak = (x > high) & (x >= before) & (x >= F.coalesce(after, x))
    pause = (x < 0.9 * F.col("q")[0]) & (x <= before) & (x <= F.coalesce(after, x))
    return thin_min_gap(d.where(peak | pause).select(by, F.bround(t, 2).alias(t)).distinct(), gap, t, by)


def visual_cuts(frames: DataFrame, strength: str = "normal", t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[E8] Frames whose histogram moved by more than max(0.8 P80, 0.05) or whose brightness jumped by more than
    max(0.7 P90, 8), times strength, thinned to half a second. Frames of one time come in order of frame_no."""
    scale = {"soft": 1.3, "strong": 0.75}.get(strength, 1.0)
    d = frames.withColumn("_cw_j", F.abs(F.col("bright") - F.lag("bright").over(_w(by, [t, "frame_no"])))).where(F.col("_cw_j").isNotNull())
    q = d.groupBy(by).agg(F.percentile("hist", F.lit(0.8)).alias("h"), F.percentile("_cw_j", F.lit(0.9)).alias("b"))
    d = d.join(q, by).where((F.col("hist") > F.greatest(0.8 * F.col("h"), F.lit(0.05)) * scale) | (F.col("_cw_j") > F.greatest(0.7 * F.col("b"), F.lit(8.0)) * scale))
    return thin_min_gap(d.select(by, F.bround(t, 2).alias(t)).distinct(), 0.5, t, by)


def frame_diffs(frames: DataFrame, hist: str = "histogram", order: str = "frame_no", out: str = "hist", by: str = MEDIA) -> DataFrame:
    """[E9] L1 distance of each histogram from the one before; 0 for the first."""
    before = F.lag(hist).over(_w(by, order))
    d = F.aggregate(F.zip_with(hist, before, lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return frames.withColumn(out, F.when(before.isNull(), 0.0).otherwise(d))


def onset_envelope(df: DataFrame, wide: str = "energy", band: str = "band", order: str = "frame_no", out: str = "strength", by: str = MEDIA) -> DataFrame:
    """[E10] Rises of log energy, wide plus half of the band's, over the timeline's largest."""
    rise = lambda c: F.greatest(F.log(F.col(c) + 1e-6) - F.lag(F.log(F.col(c) + 1e-6)).over(_w(by, order)), F.lit(0.0))
    d = df.withColumn(out, F.coalesce(rise(wide) + 0.5 * rise(band), F.lit(0.0)))
    top = F.max(out).over(W.partitionBy(by))
    return d.withColumn(out, F.when(top > 0, F.col(out) / top).otherwise(0.0))


def prefix_sums(df: DataFrame, col: str, order: str = "win", out: str = "total", by: str = MEDIA) -> DataFrame:
    """[E11] Running totals; a range is the difference of two."""
    return df.withColumn(out, F.sum(col).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0)))


def range_sum(prefix: DataFrame, ranges: DataFrame, order: str = "win", total: str = "total", out: str = "range_total", by: str = MEDIA) -> DataFrame:
    """[E11] Totals over windows lo <= win < hi of ranges(by, lo, hi), from two equi-joins with the running totals."""
    p = prefix.select(by, F.col(order).alias("_cw_w"), F.col(total).alias("_cw_t"))
    hi = p.select(by, (F.col("_cw_w") + 1).alias("hi"), F.col("_cw_t").alias("_cw_hi"))
    lo = p.select(by, (F.col("_cw_w") + 1).alias("lo"), F.col("_cw_t").alias("_cw_lo"))
    d = ranges.hint("merge").join(hi, [by, "hi"], "left").hint("merge").join(lo, [by, "lo"], "left")
    return d.withColumn(out, F.coalesce("_cw_hi", F.lit(0)) - F.coalesce("_cw_lo", F.lit(0))).drop("_cw_hi", "_cw_lo")


def forward_window_agg(cues: DataFrame, score: str = "score", start_ms: str = "start_ms", lead: tuple[int, int] = (4000, 30000), by: str | list[str] = MEDIA) -> DataFrame:
    """[E12] Score plus half of the best score among cues that start 4 to 30 s later."""
    best = F.max(score).over(_w(by, start_ms).rangeBetween(*lead))
    return cues.withColumn("forward", F.col(score) + 0.5 * F.coalesce(best, F.lit(0.0)))


def islands(df: DataFrame, new: Column, order: str | list[str], out: str = "island", by: str | list[str] = MEDIA) -> DataFrame:
    """Number of the run a row belongs to, where ``new`` says that a run begins."""
    return df.withColumn(out, F.sum(F.when(new, 1).otherwise(0)).over(_w(by, order)))


def collapse_repeats(cues: DataFrame, order: str = "cue_no", min_run: int = 2, by: str = MEDIA) -> DataFrame:
    """[E13] Consecutive cues of the same text (letters and digits compared) become one, up to the end of the last; a cue
    without letters stays on its own."""
    key = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s，。！？、,.!?;；:：\"'“”‘’…—\-]+", "")
    d = cues.withColumn("_cw_key", key)
    before = F.lag("_cw_key").over(_w(by, order))
    d = islands(d, before.isNull() | (before != F.col("_cw_key")) | (F.col("_cw_key") == ""), order, "_cw_run", by)
    n = F.count("*").over(W.partitionBy(by, "_cw_run"))
    if min_run > 2:
        d = d.withColumn("_cw_run", F.struct("_cw_run", F.when(n >= min_run, F.lit(-1)).otherwise(F.col(order))))
    return d.groupBy(by, "_cw_run").agg(F.min(order).alias(order), F.min_by("start_s", order).alias("start_s"), F.max_by("end_s", order).alias("end_s"), F.min_by("text", order).alias("text"), F.count("*").alias("n")).drop("_cw_run")


def merge_intervals(spans: DataFrame, eps: float = 0.05, shortest: float = 0.02, by: str = MEDIA) -> DataFrame:
    """[E14] Intervals longer than ``shortest``, merged where one starts within ``eps`` of the running end."""
    d = spans.where(F.col("end_s") - F.col("start_s") > shortest)
    end = F.max("end_s").over(_w(by, ["start_s", "end_s"]).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_cw_end", end)
    d = islands(d, F.col("_cw_end").isNull() | (F.col("start_s") > F.col("_cw_end") + eps), ["start_s", "end_s"], "_cw_run", by)
    return d.groupBy(by, "_cw_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("_cw_run")


def order_checks(spans: DataFrame, dur: str = "dur", order: str = "seg_no", by: str | list[str] = MEDIA) -> DataFrame:
    """[E15] How many spans step back by over 0.01 s, and how many leave [0, dur]."""
    d = spans.withColumn("_cw_before", F.lag("end_s").over(_w(by, order)))
    by = [by] if isinstance(by, str) else by
    return d.groupBy(*by).agg(F.count_if(F.col("start_s") < F.col("_cw_before") - 0.01).alias("backward"), F.count_if((F.col("start_s") < 0) | (F.col("end_s") > F.col(dur) + 0.01)).alias("out_of_bounds"))


def merge_adjacent_equal(env: DataFrame, tier: str = "tier", eps: float = 0.02, by: str = MEDIA) -> DataFrame:
    """[E16] Rows of one tier that touch become one."""
    w = _w(by, "start_s")
    d = env.withColumn("_cw_t", F.lag(tier).over(w)).withColumn("_cw_e", F.lag("end_s").over(w))
    d = islands(d, F.col("_cw_t").isNull() | (F.col("_cw_t") != F.col(tier)) | (F.abs(F.col("start_s") - F.col("_cw_e")) >= eps), "start_s", "_cw_run", by)
    return d.groupBy(by, "_cw_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by(tier, "start_s").alias(tier)).drop("_cw_run")


def beats_per_second(beats: DataFrame, t: str = "t_s", by: str = "track_id") -> DataFrame:
    """[E17] One over the median gap, of gaps over 0.2 s."""
    d = beats.withColumn("gap", F.col(t) - F.lag(t).over(_w(by, t))).where("gap > 0.2")
    return d.groupBy(by).agg((1 / F.median("gap")).alias("beats_per_second"))


def detect_opening(scenes: DataFrame, cues: DataFrame, words: list[str], win: float = 90.0, by: str = MEDIA) -> DataFrame:
    """[E18] Media whose first ``win`` seconds are an opening: no cue of six letters or more, at least two scenes whose texts
    repeat (mean ratio over 0.95), and a keyword. -> (by, content_start)"""
    from ..functions.text import edit_ratio

    early = scenes.where(F.col("start_s") < win)
    d = early.withColumn("_cw_b", F.lag("text").over(_w(by, "start_s")))
    d = d.withColumn("_cw_r", F.when(F.col("_cw_b").isNotNull(), edit_ratio("_cw_b", "text")))
    said = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.coalesce("text", F.lit("")), w))
    d = d.groupBy(by).agg(F.count("*").alias("n"), F.avg("_cw_r").alias("r"), F.max(said).alias("said"), F.max("end_s").alias("content_start"))
    spoken = cues.where((F.col("start_s") < win) & (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 6)).select(by).distinct()
    return d.where("n >= 2 and r > 0.95 and said").join(spoken, by, "left_anti").select(by, "content_start")


def tail_budget(lines: DataFrame, end: str = "end_s", tail: float = 0.35, order: str = "line_no", by: str = MEDIA) -> DataFrame:
    """[E19] Latest start of each line: the end less the time that later lines need (voice and tail, half a second if silent)."""
    need = F.when(F.coalesce("voice_s", F.lit(0.0)) > 0, F.col("voice_s") + tail).otherwise(0.5)
    later = F.sum(need).over(_w(by, order).rowsBetween(1, W.unboundedFollowing))
    return lines.withColumn("need_after", F.coalesce(later, F.lit(0.0))).withColumn("latest_start", F.col(end) - F.col("need_after"))


def relative_position(lines: DataFrame, text: str = "text", order: str = "line_no", by: str = MEDIA) -> DataFrame:
    """[E20] Middle of each line on the script's axis of characters, 0..1."""
    n = F.length(F.coalesce(text, F.lit("")))
    before = F.coalesce(F.sum(n).over(_w(by, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("position", (before + n / 2) / F.greatest(F.sum(n).over(W.partitionBy(by)), F.lit(1)))


def cumulative_starts(items: DataFrame, dur: str = "dur", order: str = "pos", out: str = "start_s", by: str = MEDIA) -> DataFrame:
    """[E23] Running start of each item."""
    return items.withColumn(out, F.coalesce(F.sum(dur).over(_w(by, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
