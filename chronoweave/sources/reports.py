"""JSON reports, run history and incremental results. IDs are those of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import seconds_to_tc

ROW = "i int, narr string, verdict string, why string, out array<double>, `desc` array<string>"


def parse_reports(files: DataFrame) -> DataFrame:
    """[A7] files(run_id, value): an array of rows, or an object with summary and report -> (run_id, line_no, narr, verdict, why, out,
    desc). A file of neither form raises an error when it is read."""
    plain = F.from_json("value", f"array<struct<{_struct(ROW)}>>")
    nested = F.from_json("value", f"struct<summary:string,report:array<struct<{_struct(ROW)}>>>")
    first = F.left(F.ltrim("value"), F.lit(1))
    rows = F.when(first == "[", plain).when(first == "{", nested["report"])
    rows = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("not a report: "), F.col("run_id").cast("string")))).otherwise(rows)
    d = files.select("run_id", F.posexplode(rows).alias("pos", "r"))
    return d.select("run_id", F.coalesce("r.i", "pos").alias("line_no"), "r.narr", "r.verdict", "r.why", "r.out", "r.desc")


def _struct(ddl: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(", "))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """[A7] All JSON reports under a path; run_id is the file's path."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    return parse_reports(files.select(F.input_file_name().alias("run_id"), "value"))


RUN = "time timestamp, file string, duration double, w int, h int, music string, voice string, captions array<string>, kind string, _corrupt_record string"


def read_runs(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """[A8] Run history, newest first; what is not a list of runs gives none, and broken files are set aside (see broken_runs)."""
    d = spark.read.schema(RUN).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", timestampFormat="yyyy-MM-dd HH:mm:ss")
    return d.where("_corrupt_record is null and file is not null").drop("_corrupt_record").orderBy(F.desc("time"), "file").limit(limit)


def broken_runs(spark: SparkSession, path: str) -> DataFrame:
    """[A8] History files that could not be read."""
    d = spark.read.schema(RUN).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    broken = F.col("_corrupt_record").isNotNull() & F.coalesce(F.length("file") >= 0, F.lit(True))  # the reader wants a data column named as well
    return d.where(broken).select(F.input_file_name().alias("path"), "_corrupt_record")


def fingerprint(*columns: str | Column) -> Column:
    """[A9] Digest of a file's size and time, parameters and the like."""
    return F.sha2(F.concat_ws(":", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]), 256)


def incremental(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """[A9] Inputs without a stored result under the same keys (version, parameters, fingerprint); empty results count as stored."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def store_results(results: DataFrame, path: str, version: str = "analysis_version") -> None:
    """[A9] Append results, a folder for each version, so that a stale version is never read."""
    results.write.mode("append").partitionBy(version).parquet(path)


def clip_report(clips: DataFrame, by: str = "media_id") -> DataFrame:
    """[A11] clips(media_id, start_s, end_s, score, reasons) -> one readable line and one JSON object a clip."""
    line = F.format_string("%s - %s  %.1f s  score %.3f  %s", seconds_to_tc("start_s", False), seconds_to_tc("end_s", False), F.col("end_s") - F.col("start_s"), F.col("score"), F.array_join("reasons", ", "))
    return clips.select(by, "start_s", line.alias("line"), F.to_json(F.struct("start_s", "end_s", "score", "reasons")).alias("json"))


def write_clip_report(clips: DataFrame, path: str) -> None:
    """[A11] Reports as text, a folder a medium, in order of time."""
    clip_report(clips).repartition("media_id").sortWithinPartitions("media_id", "start_s").select("media_id", F.col("line").alias("value")).write.partitionBy("media_id").mode("overwrite").text(path)
