"""Range joins made equi-joins by time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Columns renamed with a prefix, but those of ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))


def timed_bins(df: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """A row for each bin of ``width`` that its time meets."""
    return df.withColumn("_cw_bin", F.explode(_bins(F.col(low), F.col(high), width)))


def _identified(df: DataFrame) -> DataFrame:
    """A digest of each row. Equal rows share it, which is right here: they match alike. Numbers of rows would not do, as a plan
    that reads the table twice may number it twice."""
    cols = [F.col(c) for c in df.columns]
    return df.withColumn("_cw_row", F.struct(F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], width: float, tol: float = 0.0, closed: bool = False, l: tuple[str, str] = ("start_s", "end_s"), r: tuple[str, str] = ("start_s", "end_s"), prefix: str = "r_", how: str = "inner") -> DataFrame:  # noqa: E741
    """Pairs whose intervals overlap within ``tol`` on each side (strictly, or with ends that touch if ``closed``).

    Both sides are exploded to bins of ``width``; a pair is kept in its first common bin only, so none comes twice. Right
    columns get ``prefix``. ``how``: inner, left, left_semi or left_anti. Long intervals cost one row a bin: choose ``width``
    near the usual length. Join on (keys, bin) lets skewed timelines spread over their bins. Exploded sides are sorted and merged,
    as Spark cannot tell their size."""
    right = prefixed(right, prefix, on)
    rl, rh = prefix + r[0], prefix + r[1]
    a = _identified(left) if how == "left" else left
    a2 = a.withColumn("_cw_bin", F.explode(_bins(F.col(l[0]) - tol, F.col(l[1]) + tol, width)))
    b2 = right.withColumn("_cw_bin", F.explode(_bins(F.col(rl), F.col(rh), width)))
    first = F.greatest(F.floor((F.col(l[0]) - tol) / width), F.floor(F.col(rl) / width))
    if closed:
        hit = (F.col(l[1]) + tol >= F.col(rl)) & (F.col(l[0]) - tol <= F.col(rh))
    else:
        hit = (F.col(l[1]) + tol > F.col(rl)) & (F.col(l[0]) - tol < F.col(rh))
    if how in ("left_semi", "left_anti"):
        keys = _identified(a)
        probe = keys.withColumn("_cw_bin", F.explode(_bins(F.col(l[0]) - tol, F.col(l[1]) + tol, width)))
        found = probe.hint("merge").join(b2, [*on, "_cw_bin"]).where(hit).select("_cw_row").distinct()
        return keys.hint("merge").join(found, "_cw_row", how).select(*left.columns)
    pairs = a2.hint("merge").join(b2, [*on, "_cw_bin"]).where(hit & (F.col("_cw_bin") == first)).drop("_cw_bin")
    if how == "left":
        extra = [c for c in right.columns if c not in on]
        rest = a.hint("merge").join(pairs.select("_cw_row").distinct(), "_cw_row", "left_anti").select(*a.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
        pairs = pairs.select(*a.columns, *extra).unionByName(rest).drop("_cw_row")
    return pairs


def point_in_interval(points: DataFrame, intervals: DataFrame, on: list[str], width: float, at: str = "t_s", r: tuple[str, str] = ("start_s", "end_s"), prefix: str = "r_") -> DataFrame:
    """Pairs with start <= point < end."""
    b = prefixed(intervals, prefix, on)
    rl, rh = F.col(prefix + r[0]), F.col(prefix + r[1])
    b = b.withColumn("_cw_bin", F.explode(_bins(rl, rh, width)))
    a = points.withColumn("_cw_bin", F.floor(F.col(at) / width))
    return a.hint("merge").join(b, [*on, "_cw_bin"]).where((F.col(at) >= rl) & (F.col(at) < rh)).drop("_cw_bin")
