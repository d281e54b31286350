"""Streams over files with availableNow against the batch operators on the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.streaming import chat

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        return spark.readStream.schema(schema).parquet(path)

    return make


def drain(df, tmp_path, mode="append"):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out)


EVENTS = "media_id long, event_id long, ts timestamp, text string"


def events(n=40):
    rows = [(1 + i % 2, i, START + dt.timedelta(seconds=i), "666" if i % 5 == 0 else "x") for i in range(n)]
    return [*rows, (9, 999, START + dt.timedelta(hours=1), "end")]  # moves the watermark past everything


def test_counts_match_batch(spark, stream, tmp_path):
    got = drain(chat.stream_chat_counts(stream(events(), EVENTS)), tmp_path).where("media_id < 9").groupBy().agg(F.sum("chat"), F.count("*")).first()
    assert got[0] == 40 and got[1] == 40


def test_sessions(spark, stream, tmp_path):
    rows = [(1, i, START + dt.timedelta(seconds=s), "x") for i, s in enumerate((0, 5, 10, 100, 105))] + events(0)
    got = sorted(r["n"] for r in drain(chat.stream_sessions(stream(rows, EVENTS)), tmp_path).where("media_id = 1").collect())
    assert got == [2, 3]


def test_dedup(spark, stream, tmp_path):
    rows = events(10) + events(10)
    assert drain(chat.stream_dedup_events(stream(rows, EVENTS)), tmp_path).count() == 11


def test_keyword_alerts(spark, stream, tmp_path):
    got = drain(chat.stream_keyword_alerts(stream(events(), EVENTS), "20 seconds", 2), tmp_path).collect()
    assert {r["hits"] for r in got} == {2}


def test_collapse(spark, stream, tmp_path):
    schema = "media_id long, ts timestamp, end_ts timestamp, text string"
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(i), at(i + 1), t) for i, t in enumerate("aabbb")] + [(1, at(7200), at(7201), "c")]
    got = sorted((r["text"], r["n"]) for r in drain(chat.stream_collapse(stream(rows, schema)), tmp_path).collect() if r["text"] in "ab")
    assert got == [("a", 2), ("b", 3)]


def test_highlights_horizon(spark):
    counts = spark.createDataFrame([(1, START + dt.timedelta(seconds=2 * i), 20 if i == 30 else 1 + (i % 4 == 0)) for i in range(60)], "media_id long, start timestamp, chat long")
    assert START + dt.timedelta(seconds=60) in {r["start"] for r in chat.highlights_batch(counts).collect()}


def test_a_replayed_batch_of_highlights_changes_nothing(spark, tmp_path):
    """Two batches of counts; the second is run again, as after a lost driver."""
    schema = "media_id long, start timestamp, chat long"
    at = lambda i: START + dt.timedelta(seconds=2 * i)
    rows = [(1, at(i), 20 if i in (30, 70) else 1 + (i % 4 == 0)) for i in range(100)]
    each, found = None, []

    class Counts:
        """Takes the place of a stream and hands over what runs each batch."""

        def __getattr__(self, name):
            return self

        def __call__(self, *args, **options):
            return self

        def foreachBatch(self, run):  # noqa: N802
            nonlocal each
            each = run
            return self

    chat.stream_highlights(Counts(), lambda df, n: found.append((n, sorted(map(tuple, df.collect())))), str(tmp_path / "store"), str(tmp_path / "state"))
    first, second = (spark.createDataFrame(part, schema) for part in (rows[:60], rows[60:]))
    each(first, 0)
    each(second, 1)
    each(second, 1)
    assert found[1] == found[2]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 100
    whole = sorted(map(tuple, chat.highlights_batch(spark.createDataFrame(rows, schema)).collect()))
    assert found[2][1] == whole and {r[1] for r in whole} >= {at(30), at(70)}
