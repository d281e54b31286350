"""The driver's tables as timelines: events of a user are a live session, conversations are transcripts, orders are files and runs,
embeddings are frames. The same bindings in SQL stand beside them, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAYS_S = 2_592_000.0  # thirty days
EPOCH_MS = 1_704_067_200_000  # 2024-01-01 UTC


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def live(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, event_id, t_ms, t_s, text, value, cents)"""
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    e = table(spark, d, "events").select(F.col("user_id").alias("media_id"), "event_id", ms.alias("t_ms"), F.col("event_type").alias("text"), "value", F.bround(F.col("value") * 100, 0).cast("long").alias("cents"))
    return e.withColumn("t_s", F.col("t_ms") / F.lit(1000.0))


EV = "ev AS (SELECT user_id AS media_id, event_id, t_ms, t_ms / 1000.0::DOUBLE AS t_s, text, value, cents FROM (SELECT user_id, event_id, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS t_ms, event_type AS text, value, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events))"


def users(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, dur) of every user with events."""
    return live(spark, d).select("media_id").distinct().withColumn("dur", F.lit(DAYS_S))


def cues(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, cue_no, start_s, end_s, text) of conversations: a turn every ten seconds, 5.2 characters a second."""
    t = table(spark, d, "conversations").where("text is not null")
    start = F.col("turn") * F.lit(10.0)
    return t.select(F.col("conv_id").alias("media_id"), F.col("turn").cast("int").alias("cue_no"), start.alias("start_s"), (start + F.length("text") / F.lit(5.2)).alias("end_s"), "text")


CU = "cu AS (SELECT conv_id AS media_id, CAST(turn AS INTEGER) AS cue_no, turn * 10.0::DOUBLE AS start_s, turn * 10.0::DOUBLE + length(text) / 5.2::DOUBLE AS end_s, text FROM conversations WHERE text IS NOT NULL)"


def media(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, dur) of conversations."""
    return cues(spark, d).groupBy("media_id").agg(F.max("end_s").alias("dur"))


ME = f"{CU}, me AS (SELECT media_id, max(end_s) AS dur FROM cu GROUP BY media_id)"


def segs(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, seg_no, start_s, end_s): stretches of fifteen seconds of conversations."""
    n = F.ceil(F.col("dur") / 15.0).cast("int")
    s = media(spark, d).where(n > 0).select("media_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_no"))
    return s.select("media_id", "seg_no", (F.col("seg_no") * 15.0).alias("start_s"), ((F.col("seg_no") + 1) * 15.0).alias("end_s"))


SE = f"{ME}, se AS (SELECT media_id, CAST(k AS INTEGER) AS seg_no, k * 15.0::DOUBLE AS start_s, (k + 1) * 15.0::DOUBLE AS end_s FROM (SELECT media_id, unnest(range(CAST(ceil(dur / 15.0::DOUBLE) AS BIGINT))) AS k FROM me))"


def visits(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, seg_no, start_s, end_s, text): from each event of a user to the next."""
    w = W.partitionBy("media_id").orderBy("t_ms", "event_id")
    e = live(spark, d).withColumn("seg_no", F.row_number().over(w) - 1).withColumn("end_s", F.lead("t_s").over(w))
    return e.where("end_s is not null").select("media_id", "seg_no", F.col("t_s").alias("start_s"), "end_s", "text")


VI = f"{EV}, vi AS (SELECT * FROM (SELECT media_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_no, t_s AS start_s, lead(t_s) OVER w AS end_s, text FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ms, event_id)) WHERE end_s IS NOT NULL)"


def lines(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """(media_id, line_no, text): non-empty lines of documents."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return t.where(F.trim("text") != "")


LI = "li AS (SELECT * FROM (SELECT doc_id AS media_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL) WHERE trim(text) <> '')"


def items(spark: SparkSession, d: str) -> DataFrame:
    """(rel, name, group_key, tier, deletable, size, mtime): orders as stored files."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    mtime = (F.unix_millis(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long")
    tier = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "keep").otherwise("review")
    return o.select(F.concat(F.lit("outputs/"), name).alias("rel"), name.alias("name"), F.col("o_custkey").alias("group_key"), tier.alias("tier"), (F.col("o_orderpriority") != "1-URGENT").alias("deletable"), F.bround("o_totalprice", 0).cast("long").alias("size"), mtime.alias("mtime"))


IT = "it AS (SELECT 'outputs/o' || o_orderkey || '.mp4' AS rel, 'o' || o_orderkey || '.mp4' AS name, o_custkey AS group_key, CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'keep' ELSE 'review' END AS tier, o_orderpriority <> '1-URGENT' AS deletable, CAST(round_even(o_totalprice, 0) AS BIGINT) AS size, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS mtime FROM orders)"


def step_log(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, idx, ok, engine, error, source): events as steps; errors have failed."""
    e = live(spark, d)
    return e.select(F.col("media_id").alias("run_id"), (F.col("event_id") % 50).alias("idx"), (F.col("text") != "error").alias("ok"), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("engine"), F.when(F.col("text") == "error", F.element_at(F.array(*[F.lit(x) for x in ("Connection refused", "read timed out", "No space left", "Permission denied", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))).alias("error"), F.when(F.col("event_id") % 7 == 0, "retry").when(F.col("event_id") % 11 == 0, "skip").otherwise("fresh").alias("source"))


LO = f"{EV}, lo AS (SELECT media_id AS run_id, event_id % 50 AS idx, text <> 'error' AS ok, 'e' || (event_id % 4) AS engine, CASE WHEN text = 'error' THEN (['Connection refused', 'read timed out', 'No space left', 'Permission denied', 'odd'])[event_id % 5 + 1] END AS error, CASE WHEN event_id % 7 = 0 THEN 'retry' WHEN event_id % 11 = 0 THEN 'skip' ELSE 'fresh' END AS source FROM ev)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, frame_no, t_s, motion, frac, hist, bright): events of a user as frames."""
    w = W.partitionBy("media_id").orderBy("t_ms", "event_id")
    v = F.col("cents") / F.lit(100.0)
    return live(spark, d).select("media_id", (F.row_number().over(w) - 1).alias("frame_no"), "t_s", F.col("cents").alias("motion"), (v / 500.0).alias("frac"), (v / 250.0).alias("hist"), v.alias("bright"))


FR = f"{EV}, fr AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t_ms, event_id) - 1 AS frame_no, t_s, cents AS motion, cents / 100.0::DOUBLE / 500.0::DOUBLE AS frac, cents / 100.0::DOUBLE / 250.0::DOUBLE AS hist, cents / 100.0::DOUBLE AS bright FROM ev)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, frame_no, vec): embeddings of a label as frames of a medium."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    return e.select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").alias("frame_no"), F.col("embedding").alias("vec"))
