"""Signals on a grid of windows and other aggregations over timelines. IDs are those of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import HIGHLIGHT_WORDS
from ..functions.text import line_weight, sentence_kind
from .joins import spread_to_windows
from .windows import percentiles_wide

MEDIA = "media_id"


def grid(media: DataFrame, window: float | None = None, by: str = MEDIA) -> DataFrame:
    """media(media_id, n_win) or, with ``window``, (media_id, dur) -> one row for each window."""
    n = F.col("n_win") if window is None else F.floor(F.col("dur") / window)
    return media.where(n > 0).select(by, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("win"))


def window_of(t: str | Column, window: float) -> Column:
    """Window of a time, truncated towards zero; a missing time is 0."""
    t = F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(0.0))
    return (t / window).cast("long").cast("int")


def fill(grid_: DataFrame, values: DataFrame, cols: list[str], by: str = MEDIA) -> DataFrame:
    """Values on the whole grid, 0 where there are none; windows beyond the grid drop out."""
    return grid_.hint("merge").join(values, [by, "win"], "left").select(by, "win", *[F.coalesce(c, F.lit(0).cast("double")).alias(c) for c in cols])


def chat_curve(events: DataFrame, grid_: DataFrame, window: float, t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[D1] Messages in each window. A hot session is combined in its tasks before the shuffle."""
    n = events.where(F.coalesce(F.col(t), F.lit(0.0)) >= 0).groupBy(by, window_of(t, window).alias("win")).agg(F.count("*").cast("double").alias("chat"))
    return fill(grid_, n, ["chat"], by)


def motion_curve(frames: DataFrame, grid_: DataFrame, window: float, col: str = "motion", t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[D2] Mean motion of each window, 0 without frames."""
    m = frames.groupBy(by, window_of(t, window).alias("win")).agg(F.avg(col).alias("motion"))
    return fill(grid_, m, ["motion"], by)


def activity_curves(events: DataFrame, grid_: DataFrame, window: float, col: str = "motion", t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[D1, D2] chat and motion of one event table, in one pass."""
    d = events.groupBy(by, window_of(t, window).alias("win"))
    d = d.agg(F.count_if(F.coalesce(F.col(t), F.lit(0.0)) >= 0).cast("double").alias("chat"), F.avg(col).alias("motion"))
    return fill(grid_, d, ["chat", "motion"], by)


def rms_curve(chunks: DataFrame, window: float, by: str = MEDIA) -> DataFrame:
    """[D3] audio(media_id, chunk_no, sample_rate, pcm): root mean square of samples / 32768 in each full window; chunks lie end
    to end in order of chunk_no, so offsets are sums of sizes, and each chunk gives a partial sum a window."""
    w = W.partitionBy(by).orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    sizes = chunks.select(by, "chunk_no", "sample_rate", F.size("pcm").alias("n"))
    sizes = sizes.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n", "sample_rate")
    d = chunks.join(sizes, [by, "chunk_no"]).withColumn("per", (F.col("sample_rate") * window).cast("long"))
    at = d.select(by, "per", "first", F.posexplode("pcm").alias("i", "x"))
    at = at.groupBy(by, "per", F.floor((F.col("first") + F.col("i")) / F.col("per")).cast("int").alias("win")).agg(F.sum(F.pow(F.col("x") / 32768.0, 2)).alias("s"), F.count("*").alias("n"))
    return at.where("n = per").select(by, "win", F.sqrt(F.col("s") / F.col("n")).alias("audio"))


def keyword_hits(text: str | Column, words: list[str] = HIGHLIGHT_WORDS) -> Column:
    """Occurrences of the words in a text."""
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return sum(((F.length(c) - F.length(F.replace(c, F.lit(w)))) / len(w) for w in words), F.lit(0.0)).cast("int")


def speech_curve(cues: DataFrame, grid_: DataFrame, window: float, words: list[str] = HIGHLIGHT_WORDS, by: str = MEDIA) -> DataFrame:
    """[D4] Seconds spoken times line weight, and keyword hits (three a cue at most, times weight) in every window a cue covers."""
    d = cues.withColumn("w", line_weight("text")).withColumn("hits", F.least(F.lit(3), keyword_hits("text", words)) * F.col("w"))
    d = spread_to_windows(d, window, F.col("w")) if "w" in d.columns else d
    d = d.groupBy(by, "win").agg(F.sum("covered").alias("speech"), F.sum("hits").cast("double").alias("kw"))
    return fill(grid_, d, ["speech", "kw"], by)


def char_density(cues: DataFrame, dur: DataFrame, step: float = 0.5, by: str = MEDIA) -> DataFrame:
    """[D5] Characters on a grid of ``step`` seconds: each cue's length over its cells, added to each. -> (media_id, win, density)"""
    cells = F.greatest(F.lit(1.0), (F.col("end_s") - F.col("start_s")) / step)
    last = F.greatest(F.floor(F.col("start_s") / step), F.ceil(F.col("end_s") / step) - 1)
    d = cues.withColumn("win", F.explode(F.sequence(F.floor(F.col("start_s") / step), last))).withColumn("win", F.col("win").cast("int"))
    d = d.groupBy(by, "win").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) / cells).alias("density"))
    return fill(grid(dur.withColumn("dur", F.ceil(F.col("dur") / step) * step), step, by), d, ["density"], by)


def line_durations(segs: DataFrame, by: list[str] = (MEDIA, "line_no")) -> DataFrame:
    """[D6] Seconds of each line."""
    return segs.groupBy(*by).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("dur"))


def cut_plan_summary(segs: DataFrame, by: str = MEDIA) -> DataFrame:
    """[D7] segs(media_id, seg_no, start_s, end_s, keep): totals, coverage in percent and the segments in order."""
    n = F.col("end_s") - F.col("start_s")
    return segs.groupBy(by).agg(
        F.count_if("keep").alias("kept"),
        F.count_if(~F.col("keep")).alias("removed"),
        F.coalesce(F.sum(F.when(~F.col("keep"), n)), F.lit(0.0)).alias("removed_sec"),
        (F.coalesce(F.sum(F.when(F.col("keep"), n)), F.lit(0.0)) / F.sum(n) * 100).alias("coverage"),
        F.array_sort(F.collect_list(F.struct("start_s", "end_s", "seg_no", "keep"))).alias("segments"),
    )


def sync_report(cues: DataFrame, durations: DataFrame, by: str = MEDIA) -> DataFrame:
    """[D8] Health of a transcript against its medium: gaps at head and tail, largest gap between cues, cues beyond the end, share
    covered, rows without times -> level ok, warn or bad with messages."""
    s, e = F.col("start_s").try_cast("double"), F.col("end_s").try_cast("double")
    good = s.isNotNull() & e.isNotNull() & (e >= s)
    d = cues.select(by, s.alias("s"), e.alias("e"), good.alias("good"))
    d = d.withColumn("prev", F.max(F.when(F.col("good"), F.col("e"))).over(W.partitionBy(by).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)))
    d = d.join(durations.select(by, "dur"), by, "right").groupBy(by, "dur").agg(
        F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad_rows"), F.min(F.when(F.col("good"), F.col("s"))).alias("first"), F.max(F.when(F.col("good"), F.col("e"))).alias("last"),
        F.count_if(F.col("good") & (F.col("s") > F.col("dur") + 0.5)).alias("beyond"), F.max(F.when(F.col("good"), F.col("s") - F.col("prev"))).alias("largest_gap"), F.coalesce(F.sum(F.when(F.col("good"), F.col("e") - F.col("s"))), F.lit(0.0)).alias("spoken"),
    )
    d = d.select(by, "dur", "n", "bad_rows", "beyond", F.coalesce("first", F.lit(0.0)).alias("head_gap"), F.greatest(F.lit(0.0), F.col("dur") - F.coalesce("last", F.lit(0.0))).alias("tail_gap"), F.greatest(F.lit(0.0), F.coalesce("largest_gap", F.lit(0.0))).alias("largest_gap"), F.coalesce(F.col("last") >= 0.9 * F.col("dur"), F.lit(False)).alias("to_end"), (F.col("spoken") / F.col("dur")).alias("coverage"))
    tail = F.col("tail_gap") > F.greatest(F.lit(60.0), 0.15 * F.col("dur"))
    notes = F.array_compact(F.array(F.when(F.col("n") == 0, "no cues"), F.when((F.col("n") > 0) & (F.col("head_gap") > F.greatest(F.lit(60.0), 0.15 * F.col("dur"))), "late start"), F.when((F.col("n") > 0) & tail, "ends early"), F.when(F.col("beyond") > 0, "beyond the end"), F.when(F.col("bad_rows") > 0, "rows without times")))
    level = F.when((F.col("n") == 0) | (F.col("beyond") > 0.2 * F.col("n")) | tail, "bad").when(F.size("notes") > 0, "warn").otherwise("ok")
    return d.withColumn("notes", notes).withColumn("level", level)


def peaks(samples: DataFrame, points: int = 180, cell: int = 200, by: str = MEDIA) -> DataFrame:
    """[D16] samples(media_id, i, x): largest |x| / 32768 of each cell of 200 samples, then of ``points`` equal buckets, to 4
    decimals; points are held in 8..1000."""
    points = max(8, min(1000, points))
    cells = samples.groupBy(by, F.floor(F.col("i") / cell).alias("c")).agg(F.max(F.abs("x") / 32768.0).alias("p"))
    n = F.count("*").over(W.partitionBy(by))
    d = cells.withColumn("n", n)
    # bucket i holds cells i*n//points up to the next bound, one cell at least
    first = F.explode(F.filter(F.sequence(F.greatest(F.lit(0), F.floor(F.col("c") * points / F.col("n")) - 1), F.least(F.lit(points - 1), F.floor((F.col("c") + 1) * points / F.col("n")))), lambda i: (F.floor(i * F.col("n") / points) <= F.col("c")) & (F.col("c") < F.greatest(F.floor((i + 1) * F.col("n") / points), F.floor(i * F.col("n") / points) + 1))))
    return d.withColumn("bucket", first).withColumn("bucket", F.col("bucket").cast("int")).groupBy(by, "bucket").agg(F.bround(F.max("p"), 4).alias("peak"))


def robust_thresholds(frames: DataFrame, col: str, by: str = MEDIA, approximate: bool = False, wide: bool = False) -> DataFrame:
    """[D17] P25, median, P75, P80, P90, P95 with linear interpolation, IQR, and thresholds for motion and pauses. The exact form
    keeps a timeline's counts of distinct values in one task; ``approximate`` bounds that, ``wide`` sorts over ranges instead."""
    shares = [0.25, 0.5, 0.75, 0.8, 0.9, 0.95]
    points = F.array(*[F.lit(p) for p in shares])
    q = F.percentile_approx(col, points, 10000) if approximate else F.percentile(col, points)
    d = percentiles_wide(frames, col, shares, by) if wide else frames.groupBy(by).agg(q.alias("q"))
    d = d.select(by, *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "median", "p75", "p80", "p90", "p95"))])
    return d.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("motion_threshold", F.greatest(F.col("p75") + 1.5 * (F.col("p75") - F.col("p25")), F.lit(0.004))).withColumn("pause_threshold", 0.9 * F.col("p25"))


def kind_histogram(lines: DataFrame, text: str = "text", by: list[str] = ()) -> DataFrame:
    """[D15] Lines of each sentence class."""
    return lines.groupBy(*by, sentence_kind(text).alias("kind")).agg(F.count("*").alias("n"))


def union_cuts(scene: DataFrame, motion: DataFrame, visual: DataFrame, t: str = "t_s", by: str = MEDIA) -> DataFrame:
    """[G1] Cuts of three sources with weights 3, 2, 1; the largest weight of each time rounded to 2 decimals."""
    all_ = [d.select(by, F.bround(t, 2).alias(t), F.lit(w).alias("weight")) for d, w in ((scene, 3), (motion, 2), (visual, 1))]
    return all_[0].unionByName(all_[1]).unionByName(all_[2]).groupBy(by, t).agg(F.max("weight").alias("weight"))


def distinct_points(points: DataFrame, t: str = "t_s", places: int = 2, by: str = MEDIA) -> DataFrame:
    """[G5] Distinct times, rounded."""
    return points.select(by, F.bround(t, places).alias(t)).distinct()
