"""Structured Streaming forms of the batch operators. IDs are those of the survey.

Late rows: a watermark of 30 s by default; later ones are dropped and counted in the query's progress. A rank over a whole
timeline cannot be had on an unbounded stream; stream_highlights states its horizon instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lexicon import HIGHLIGHT_WORDS
from ..operators.signals import keyword_hits

LATE = "30 seconds"
#: Files of a day of a batch of counts.
FILES = 8


def stream_chat_counts(events: DataFrame, window: str = "2 seconds", late: str = LATE) -> DataFrame:
    """[K1] events(media_id, ts, text) -> messages of each tumbling window."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", window), "media_id").agg(F.count("*").alias("chat"))
    return d.select("media_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "chat")


def stream_smoothed(events: DataFrame, length: str = "10 seconds", slide: str = "2 seconds", k: int = 5, late: str = LATE) -> DataFrame:
    """[K2] Sliding sum over k windows, divided by k."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "media_id").agg((F.count("*") / k).alias("smooth"))
    return d.select("media_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "smooth")


def stream_sessions(events: DataFrame, gap: str = "30 seconds", late: str = LATE) -> DataFrame:
    """[K3] Bursts of messages that no gap parts."""
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "media_id").agg(F.count("*").alias("n"))
    return d.select("media_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_collapse(cues: DataFrame, late: str = LATE, idle_ms: int = 60_000) -> DataFrame:
    """[K4] cues(media_id, ts, end_ts, text) -> one row for each run of equal texts: (media_id, start_ts, end_ts, text, n). The open run
    of a medium is its only state; a timer in event time flushes it when nothing follows."""
    out = "media_id long, start_ts timestamp, end_ts timestamp, text string, n long"
    state = "start_ts timestamp, end_ts timestamp, text string, n long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            row = held.get
            held.remove()
            yield pd.DataFrame([[key[0], *row]], columns=["media_id", "start_ts", "end_ts", "text", "n"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        open_ = list(held.get) if held.exists else None
        done = []
        for r in rows.itertuples():
            if open_ is not None and open_[2] == r.text:
                open_[1], open_[3] = max(pd.Timestamp(open_[1]), r.end_ts), open_[3] + 1
            else:
                if open_ is not None:
                    done.append([key[0], *open_])
                open_ = [r.ts, r.end_ts, r.text, 1]
        held.update((pd.Timestamp(open_[0]).to_pydatetime(), pd.Timestamp(open_[1]).to_pydatetime(), open_[2], int(open_[3])))
        held.setTimeoutTimestamp(max(int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000), held.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(done, columns=["media_id", "start_ts", "end_ts", "text", "n"])

    return cues.withWatermark("ts", late).groupBy("media_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def highlights_batch(counts: DataFrame, half: int = 2, horizon: str = "1 hour") -> DataFrame:
    """[K5] Windows of the last ``horizon`` of each medium that reach median + 0.4 (P95 - median) and are the maximum of ``half`` windows
    either way, once those have arrived."""
    from ..operators.windows import local_peaks

    last = counts.groupBy("media_id").agg(F.max("start").alias("last"))
    d = counts.join(last, "media_id").where(F.col("start") >= F.col("last") - F.expr(f"interval {horizon}"))
    q = d.groupBy("media_id").agg(F.percentile("chat", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    d = d.join(q, "media_id").withColumn("floor", F.col("q")[0] + 0.4 * (F.col("q")[1] - F.col("q")[0]))
    d = local_peaks(d, "chat", half, F.col("floor"), order="start")
    return d.where(F.col("q")[1] > F.col("q")[0]).select("media_id", "start", "chat", "floor")


def stream_highlights(counts: DataFrame, sink: Callable[[DataFrame, int], None], store: str, checkpoint: str, half: int = 2, horizon: str = "1 hour"):
    """[K5] counts of K1 kept in ``store`` by batch and day; each batch hands the highlights of the retained horizon of its media to
    ``sink``. A batch that is run again replaces its own folder, and only folders of days within the horizon are read. A day of a batch is ``FILES`` files at most, however many tasks counted it, and what
    follows reads them, so that a batch is counted once."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.date_format("start", "yyyyMMdd").cast("long").alias("day")
        rows = batch.select("*", day).repartition(F.col("day"), F.pmod(F.xxhash64("media_id"), F.lit(FILES)))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={number}")
        stored = spark.read.schema(f"{batch._jdf.schema().toDDL()}, batch long, day long").parquet(store)
        own = stored.where(F.col("batch") == number)
        since = F.min("start") - F.expr(f"interval {horizon}")
        since = own.agg(F.date_format(since, "yyyyMMdd").cast("long")).first()[0]
        if since is None:
            return
        kept = stored.where((F.col("day") >= since) & (F.col("batch") <= number)).drop("batch", "day")
        kept = kept.hint("merge").join(own.select("media_id").distinct(), "media_id", "left_semi")
        sink(highlights_batch(kept.dropDuplicates(["media_id", "start"]), half, horizon), number)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)


def stream_dedup_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """[K6] One row for each (media_id, event_id), so that sources that repeat rows keep counts right."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["media_id", "event_id"])


def stream_keyword_alerts(events: DataFrame, window: str = "10 seconds", threshold: int = 3, words: list[str] = HIGHLIGHT_WORDS, late: str = LATE) -> DataFrame:
    """[K7] Windows whose messages hold at least ``threshold`` keywords."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", window), "media_id").agg(F.sum(keyword_hits("text", words)).alias("hits"))
    return d.where(F.col("hits") >= threshold).select("media_id", F.col("window.start").alias("start"), "hits")
