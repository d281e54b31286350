"""Steps whose cost must not grow faster than their input: files a medium, sorts a task, pairs as rows."""

import os
from datetime import datetime, timedelta

import numpy as np

from chronoweave.functions import text as tx
from chronoweave.operators import joins, tables
from chronoweave.plans import registry
from chronoweave.streaming import chat
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_c9_few_queries_are_counted_in_blocks_with_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcde "), 30)) for _ in range(40)]
    texts += [t[:-2] + "zz" for t in texts[:20]] + ["", " ", "a", None]
    d = spark.createDataFrame(list(enumerate(texts)), "d_id long, text string")
    q = d.withColumnRenamed("d_id", "q_id").where("q_id % 2 = 0")
    few = joins.bigram_join(q, d, "jaccard", 0.6)
    assert "FlatMapCoGroupsInArrow" in _plan(few)
    monkeypatch.setattr(joins, "FEW", 0)
    many = joins.bigram_join(q, d, "jaccard", 0.6)
    assert "FlatMapCoGroupsInArrow" not in _plan(many)
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.collect())) and len(got) > 30


def test_h14_counts_by_bytes(spark):
    rows = [("枪枪",), ("枪 and 枪",), ("plain text, no letter wider",), ("",), (None,), ("é枪é",), ("死死枪枪枪",), ("真相秘密 then 死",)]
    df = spark.createDataFrame(rows, "text string")
    out = df.select("text", tx.emotion_of("text").alias("e"), tx.clause_emotion("text").alias("c"))
    assert {r.text: (r.e, r.c) for r in out.collect()} == {
        "枪枪": ("紧张", "解说"), "枪 and 枪": ("紧张", "解说"), "plain text, no letter wider": ("解说", "解说"), "": ("解说", "解说"), None: ("解说", "解说"),
        "é枪é": ("解说", "解说"), "死死枪枪枪": ("紧张", "解说"), "真相秘密 then 死": ("严肃", "严肃"),
    }
    ascii_ = df.select("text", tx.emotion_of("text", {"x": ["枪"], "y": ["text", "wider"]}).alias("e"))
    assert {r.text: r.e for r in ascii_.collect()}["plain text, no letter wider"] == "y"
    assert _plan(out).count("length(") < 2 * 60 + 120 and "octet_length" in _plan(out)


def test_a14_sorts_once_in_a_given_number_of_parts(spark):
    names = ["clip_1.mp4", "final_1.mp4", "a.txt", "a.txt", "b.txt", "x.json", "noise"]
    rows = [(run, n, 2_000_000 if k == 2 else 10) for run in range(3) for k, n in enumerate(names)] + [(9, "b.mkv", 1)]
    out = tables.artefact_inventory(spark.createDataFrame(rows, "run_id long, name string, size long"))
    assert _plan(out).count("Sort [") == 1 and "REPARTITION_BY_NUM" in _plan(out)
    got = out.where("run_id = 1").orderBy("pos").select("name", "size", "kind", "best_video", "first_text", "pos").collect()
    assert [(r.name, r.best_video) for r in got if r.kind == "video"] == [("clip_1.mp4", False), ("final_1.mp4", True)]
    assert [(r.name, r.size) for r in got if r.first_text] == [("a.txt", 10)] and [r.pos for r in got] == list(range(7))
    assert out.where("run_id = 9 and best_video").count() == 1


def test_c13_tiles_have_the_pairs_of_the_interval_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 3)
    monkeypatch.setattr(joins, "SLAB", 2)
    rng = np.random.default_rng(5)
    at = lambda: float(rng.integers(0, 200))
    some = lambda k: None if k % 11 == 0 else [None, 1.0, 2.0] if k % 7 == 0 else [float(x) for x in rng.normal(size=2 if k % 5 == 0 else 3)]
    lines = [(m, k, (t := at()), t + 15, some(k)) for m in (1, 2) for k in range(40)] + [(None, 99, 0.0, 5.0, [1.0, 1.0, 1.0]), (3, 1, 0.0, 5.0, [1.0])]
    scenes = [(m, (t := at()), t + 40, some(k)) for m in (1, 2) for k in range(40)] + [(2, 0.0, 500.0, [3.0, 0.0, 0.0])] * 20
    a = spark.createDataFrame(lines, "media_id long, line_no long, start_s double, end_s double, vec array<double>")
    b = spark.createDataFrame(scenes, "media_id long, start_s double, end_s double, vec array<double>")
    want = {}
    for m, no, s, e, v in lines:
        best = 0.0
        for m2, s2, e2, w in scenes:
            if m == m2 and m is not None and e > s2 and s < e2 and v and w and len(v) == len(w) and None not in v and None not in w:
                best = max(best, float(np.dot(v, w)))
        want[m, no] = round(best, 9)
    out = joins.cosine_join(a, b)
    assert {(r.media_id, r.line_no): round(r.cosine, 9) for r in out.collect()} == want
    assert "FlatMapCoGroupsInArrow" in _plan(out)


def test_a4_logs_share_files(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = [(m, 0, "user", f"a < b & c > d\n{m}") for m in range(60)] + [(7, 1, "user", "“quoted” \"too\""), (8, 1, "user", "  ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    monkeypatch.setattr(registry, "scratch_dir", lambda s: str(tmp_path / "out"))
    got = registry.QUERIES["a4_live_events"](spark, str(tmp_path / "in"))
    assert {(r.media_id, r.t_s) for r in got.collect()} == {(m, 0.0) for m in range(60)} | {(7, 5.0)}
    assert got.where(F.col("text_md5") == F.md5(F.lit("a < b & c > d 7").cast("binary"))).count() == 1
    assert len(_files(tmp_path / "out")) <= 8


def test_a4_broken_log_gives_none_and_spares_its_neighbours(spark):
    from chronoweave.sources import subtitles

    logs = [(1, '<i><d p="1.5,1">one</d></i>'), (2, '<i><d p="1,1">broken</i>'), (3, '<i><d p="-4,1"> b </d><d p="soon">x</d></i>'), (4, "<i></i>"), (5, None)]
    got = subtitles.parse_live_events(spark.createDataFrame(logs, "media_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "one"), (3, 0.0, "b")]


def test_k5_a_day_of_a_batch_is_a_few_files(spark, tmp_path):
    each, found = None, []

    class Counts:
        def __getattr__(self, name):
            return self

        def __call__(self, *args, **options):
            return self

        def foreachBatch(self, run):  # noqa: N802
            nonlocal each
            each = run
            return self

    rows = [(m, datetime(2024, 1, 1) + timedelta(hours=h), 1 + (m * h) % 5) for m in range(40) for h in range(12)]
    counts = spark.createDataFrame(rows, "media_id long, start timestamp, chat long").repartition(16)
    chat.stream_highlights(Counts(), lambda df, n: found.append(df.count()), str(tmp_path / "store"), str(tmp_path / "state"), horizon="20 days")
    each(counts, 0)
    assert found and spark.read.parquet(str(tmp_path / "store")).count() == 480
    assert len(_files(tmp_path / "store")) <= chat.FILES
