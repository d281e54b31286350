"""Hand-made cases of the timeline operators: small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import numbers as num
from chronoweave.functions import text as tx
from chronoweave.operators import joins, select, sequences, signals, tables, windows
from chronoweave.sources import reports, subtitles

M = "media_id"


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def scalar(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def curve(spark, peaks, n=600, base=0.3, media=1):
    data = [[media, i, base] for i in range(n)]
    for centre, height in peaks:
        for i in range(centre - 6, centre + 7):
            data[i][2] = max(data[i][2], height)
    return spark.createDataFrame([(m, i, v, n * 2.0) for m, i, v in data], "media_id long, win int, fused double, dur double")


def test_d1_counts_and_bounds(spark):
    ev = spark.createDataFrame([(1, t) for t in (0.5, 2.0, 3.9, 999.0, -3.0, None)], "media_id long, t_s double")
    grid = signals.grid(spark.createDataFrame([(1, 20.0)], "media_id long, dur double"), 2.0)
    got = dict(rows(signals.chat_curve(ev, grid, 2.0), "win", "chat"))
    assert [got[i] for i in range(10)] == [2, 2] + [0] * 8


def test_e1_constant_is_half(spark):
    df = spark.createDataFrame([(1, i, 3.0) for i in range(5)], "media_id long, win int, v double")
    assert {r[0] for r in rows(windows.pct_rank(df, "v"), "rank")} == {0.5}


def test_e2_ties_share_a_rank(spark):
    df = spark.createDataFrame([(1, i, 5.0 if i in (10, 11) else 0.0) for i in range(100)], "media_id long, win int, v double")
    got = dict(rows(windows.pct_rank(df, "v", ties=True), "win", "rank"))
    assert len({v for k, v in got.items() if k not in (10, 11)}) == 1 and got[10] == got[11] > 0.9


@pytest.mark.parametrize("k,want", [(2, [0.5, 1.5, 2.5, 3.5]), (3, [1.0, 2.0, 3.0, 7 / 3]), (9, [6 / 4, 10 / 4, 9 / 4, 7 / 4])])
def test_e3_divides_by_k(spark, k, want):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(4)], "media_id long, win int, v double")
    got = [r[0] for r in rows(windows.smooth(df, "v", k).orderBy("win"), "smooth")]
    if k == 9:  # k falls to the number of windows
        want = [sum([1, 2, 3, 4][max(0, i - 2) : i + 2]) / 4 for i in range(4)]
    assert got == pytest.approx(want)


def test_e4_absent_signal_leaves_the_mean(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None), (1, 1, 0.0, None)], "media_id long, win int, a double, b double")
    assert [r[0] for r in rows(windows.fuse(df, {"a": 0.5, "b": 0.3}).orderBy("win"), "fused")] == [1.0, 0.0]


def test_f1_picks_the_two_high_peaks(spark):
    got = rows(sequences.select_clips(curve(spark, [(100, 0.95), (400, 0.90), (300, 0.55)]), 2.0, 2), "start_s", "end_s", "peak_t")
    assert len(got) == 2 and got == sorted(got) and all(b - a <= 60 for a, b, _ in got)
    assert abs(got[0][2] - 200) < 20 and abs(got[1][2] - 800) < 20


def test_f1_touching_peaks_stay_within_the_longest(spark):
    got = rows(sequences.select_clips(curve(spark, [(100, 0.9), (110, 0.9), (120, 0.9)]), 2.0, 5, gap=0.0), "start_s", "end_s")
    assert got and all(b - a <= 60 + 1e-6 for a, b in got)


def test_groups_do_not_leak(spark):
    one = curve(spark, [(100, 0.95)], 300)
    both = one.unionByName(curve(spark, [(50, 0.8), (200, 0.9)], 300, media=2))
    a = sorted(rows(sequences.select_clips(one, 2.0)))
    assert [r for r in sorted(rows(sequences.select_clips(both, 2.0))) if r[0] == 1] == a


def test_f2_flat_curve_gives_none(spark):
    assert sequences.detect_points(curve(spark, []), 2.0).count() == 0
    got = rows(sequences.detect_points(curve(spark, [(100, 0.9), (200, 0.8), (300, 0.9), (400, 0.8)]), 2.0), "start_s", "end_s", "dur")
    assert got and all(abs(b - a - d) < 0.02 and d >= 1 for a, b, d in got)


@pytest.mark.parametrize("ages,days,most,gone", [([1, 30, 60, 90], 14, 2, "bcd"), ([2] * 5, 14, 3, "de"), ([0.2] * 5, 14, 2, "")])
def test_f7_expired(spark, ages, days, most, gone):
    now = 1e9
    df = spark.createDataFrame([(n, now - a * 86400) for n, a in zip("abcde", ages)], "name string, mtime double")
    got = sorted(r[0] for r in rows(select.select_expired(df, now, days, most), "name"))
    assert "".join(got) == gone


def test_c8_only_real_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 5.0, 15.0), (1, 2, 30.0, 40.0), (1, 3, 39.6, 50.0)], "media_id long, seg_no int, start_s double, end_s double")
    assert rows(joins.self_overlaps(df)) == [(1, 0, 1, 5.0)]


def test_f11_shortest_first(spark):
    df = spark.createDataFrame([(1, 40.0, 50.0), (1, 10.0, 30.0), (1, 10.0, 20.0)], "media_id long, start_s double, end_s double")
    assert [r[:2] for r in sorted(rows(select.sort_timeline(df), "pos", "end_s"))] == [(0, 20.0), (1, 30.0), (2, 50.0)]


def test_i16_keeps_order(spark):
    segs = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 5) for i in range(3)], "media_id long, seg_no int, start_s double, end_s double")
    said = ["他走进房间", "她开始哭泣", "汽车爆炸了"]
    cues = spark.createDataFrame([(1, i, i * 5.0 + 1, i * 5.0 + 4, t) for i, t in enumerate(said)], "media_id long, cue_no int, start_s double, end_s double, text string")
    ev = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "media_id long, event_no int, text string")
    assert sorted(rows(sequences.align_events(ev, segs, cues), "event_no", "seg_no")) == [(0, 0), (1, 1), (2, 2)]


def test_c16_pairs_by_text(spark):
    s = "line_no int, narr string, verdict string"
    old = spark.createDataFrame([(0, "一，二", "related"), (1, "三四", "match"), (2, "五六", "wrong")], s)
    new = spark.createDataFrame([(0, "一二。", "match"), (1, "三四", "wrong"), (2, "五六!", "wrong"), (3, "七八", "match")], s)
    got = {r["change"]: r["n"] for r in joins.pair_reports(old, new).groupBy("change").agg(F.count("*").alias("n")).collect()}
    assert got == {"better": 1, "worse": 1, "same": 1, "only_new": 1}


def test_c5_ties_go_to_the_earlier(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 20.0)], "media_id long, t_s double")
    t = spark.createDataFrame([(1, 4.0), (1, 6.0)], "media_id long, t_s double")
    assert sorted(rows(joins.snap_nearest(p, t, 2.0), "t_s", "snapped")) == [(5.0, 4.0), (20.0, 20.0)]


def test_f3_folds(spark):
    p = spark.createDataFrame([(1, t) for t in (0.0, 0.5, 1.0, 1.4, 2.5)], "media_id long, t_s double")
    assert sorted(r[0] for r in rows(windows.thin_min_gap(p, 1.0), "t_s")) == [0.0, 1.0, 2.5]


def test_e14_running_end_is_a_maximum(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 2.0), (1, 9.0, 12.0), (1, 20.0, 20.01)], "media_id long, start_s double, end_s double")
    assert rows(windows.merge_intervals(s), "start_s", "end_s", "n") == [(0.0, 12.0, 3)]


def test_e13_empty_key_never_collapses(spark):
    c = spark.createDataFrame([(1, i, float(i), i + 1.0, t) for i, t in enumerate(["a", "A!", "a", "…", "…"])], "media_id long, cue_no int, start_s double, end_s double, text string")
    got = sorted(rows(windows.collapse_repeats(c.withColumn("text", F.lower("text"))), "cue_no", "end_s", "n"))
    assert got == [(0, 3.0, 3), (3, 4.0, 1), (4, 5.0, 1)]


def test_i2_pool(spark):
    assert sequences.pool_adjacent([1, 3, 2, 4]).tolist() == [1, 2.5, 2.5, 4]


def test_i1_follows_scores_in_order(spark):
    lines = spark.createDataFrame([(1, i, "x" * 10) for i in range(3)], "media_id long, line_no int, text string")
    scenes = spark.createDataFrame([(1, j, j * 10.0, j * 10.0 + 10) for j in range(9)], "media_id long, scene_no int, start_s double, end_s double")
    scores = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 4, 1.0), (1, 2, 7, 1.0)], "media_id long, line_no int, scene_no int, score double")
    first = {}
    for line, scene in sorted(rows(sequences.align_lines(lines, scenes, scores), "line_no", "scene_no")):
        first.setdefault(line, scene)
    assert first == {0: 1, 1: 4, 2: 7}


def test_i22_keeps_the_number(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 5.0, 10.0), (1, 1, 4.0, 4.01, 10.0), (1, 2, 9.0, 30.0, 10.0)], "media_id long, seg_no int, start_s double, end_s double, dur double")
    got = sorted(rows(sequences.remap_spans(s), "seg_no", "start_s", "end_s"))
    assert len(got) == 3 and all(b > a for _, a, b in got) and all(x[2] <= y[1] + 1e-9 for x, y in zip(got, got[1:]))


def test_i7_holds_every_voice(spark):
    s = spark.createDataFrame([(1, i, i // 2, i * 3.0, i * 3.0 + 2, 4.0 + i // 2, 60.0) for i in range(6)], "media_id long, seg_no int, line_no int, start_s double, end_s double, voice_s double, dur double")
    got = sorted(rows(sequences.fit_spans(s), "seg_no", "start_s", "end_s"))
    for line in range(3):
        assert sum(b - a for k, a, b in got if k // 2 == line) >= 4.0 + line + 0.35 - 0.01
    assert all(x[2] <= y[1] + 1e-6 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("text,want", [("", 0.0), ("哈", 0.0), ("哈哈", 0.12), ("好的好的好的", 0.12), ("好的好的", 1.0), ("今天打翻盘", 1.0)])
def test_h1_line_weight(spark, text, want):
    assert scalar(spark, tx.line_weight(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("no, no, no, no, no", "no"), ("哈哈哈哈哈", "哈哈"), ("大人计大人计大人计大", "大人计"), ("好，好", "好，好"), ("a​b", "ab")])
def test_h2_collapse(spark, text, want):
    assert scalar(spark, tx.collapse_runs(F.lit(text))) == want


@pytest.mark.parametrize("text,kind", [("啊！", "blank"), ("他喊道快跑", "quote"), ("注意看这个人", "hook"), ("随后天亮了", "transition"), ("就在这时他拔枪而出", "concrete"), ("他走进房间", "concrete")])
def test_h13_kinds(spark, text, kind):
    assert scalar(spark, tx.sentence_kind(F.lit(text))) == kind


def test_h12_last_class_wins(spark):
    assert scalar(spark, tx.action_tokens(F.lit("他开枪射击"))) == ["ACT:持械"]


def test_h10_forms_agree(spark):
    df = spark.createDataFrame([("abcde，fgh", "xxcdefgyy"), ("ab", "cd"), ("", None), ("aaaaaaaaaaaa", "aaaaaaaaaaaaa")], "a string, b string")
    got = rows(df.select(tx.lcs_contiguous("a", "b"), tx.lcs_up_to_ten("a", "b")))
    assert [min(10, x) for x, _ in got] == [y for _, y in got] == [5, 0, 0, 10]


def test_h14_needs_two(spark):
    assert scalar(spark, tx.emotion_of(F.lit("真相与秘密"))) == "严肃" and scalar(spark, tx.emotion_of(F.lit("真相"))) == "解说"


def test_h17_quotes_stay_whole(spark):
    got = scalar(spark, tx.split_clauses(F.lit("他说“好，走吧。”然后，走了")))
    assert [tuple(x) for x in got] == [("他说“好，走吧。”然后", "，"), ("走了", "")]


def test_h20_h25(spark):
    assert scalar(spark, tx.clamp_text(F.lit("一二三四五六七。九十十一"), 10)) == "一二三四五六七。"
    assert scalar(spark, tx.safe_title(F.lit('“a/b:c”'))) == "abc"


def test_h22_guards(spark):
    text = "他走进房间，仿佛有人在看，桌上放着一把刀。"
    assert scalar(spark, tx.drop_speculation(F.lit(text))) == "他走进房间，桌上放着一把刀。"
    assert scalar(spark, tx.drop_speculation(F.lit("仿佛有人，走了"))) == "仿佛有人，走了"
    assert scalar(spark, tx.scrub(F.lit("Only English text here."))) == "Only English text here."


def test_h6_h24(spark):
    assert [tuple(x) for x in scalar(spark, tx.pause_pieces(F.lit("{情绪:悲伤}a{/情绪}{停顿:0.30}b")))] == [("a", 0.3), ("b", 0.0)]
    assert scalar(spark, tx.quotes(F.lit("他说：“快跑啊”，然后“不算”"))) == ["快跑啊"]


@pytest.mark.parametrize("text,want", [("1:02:03,5", 3723.5), ("02:03.25", 123.25), ("7", 7.0), ("x", 0.0), ("a:b", 0.0)])
def test_t1(spark, text, want):
    assert scalar(spark, num.tc_to_seconds(F.lit(text))) == want


def test_j1_nested_and_broken(spark):
    assert scalar(spark, num.extract_json(F.lit('ok {"a": {"b": "}"}} end'), "a struct<b:string>"))["a"]["b"] == "}"
    assert scalar(spark, num.extract_json(F.lit("no json"), "a int")) is None


def test_j2(spark):
    df = spark.sql("select array(named_struct('i', 1, 'v', 'x'), named_struct('i', 1, 'v', 'y')) r, array(named_struct('i', 1, 'v', 'x'), named_struct('i', 0, 'v', 'y')) q")
    got = df.select(num.index_or_positional("r", F.lit(2)).alias("r"), num.index_or_positional("q", F.lit(2)).alias("q"), num.index_or_positional("r", F.lit(3)).alias("none")).first()
    assert [x["i"] for x in got["r"]] == [0, 1] and [x["i"] for x in got["q"]] == [1, 0] and got["none"] == []


def test_a1_srt_vtt_ass(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello\nworld\n\n2\n00:00:03,000 --> 00:00:04,000 tail\n\n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,a\\Nb, c\nDialogue: 0,0:00:05.00,0:00:05.00,D,,0,0,0,,zero"
    f = spark.createDataFrame([("s", srt), ("v", "WEBVTT\n\nNOTE x\n00:01.000 --> 00:02.000\nhi"), ("a", ass), ("e", None)], "path string, text string")
    got = sorted(rows(subtitles.parse_cues(f), "path", "cue_no", "start_s", "end_s", "text"))
    assert got == [("a", 1, 1.0, 2.0, "a b, c"), ("s", 1, 1.0, 2.5, "hello world"), ("s", 2, 3.0, 4.0, "tail"), ("v", 1, 1.0, 2.0, "hi")]


def test_a2_encodings(spark):
    text = "你好 world"
    raw = [text.encode(), b"\xef\xbb\xbf" + text.encode(), text.encode("utf-16"), text.encode("gb18030")]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, content binary")
    assert {r[0] for r in rows(df.select(tx.decode_bytes("content")))} == {text}


def test_a4_broken_file_gives_none(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<i><d p="3.5,1">hi</d><d p="-2">early</d><d p="x">bad</d><d p="1"></d></i>')
    got = sorted(rows(subtitles.read_live_events(spark, str(tmp_path)), "t_s", "text"))
    assert got == [(0.0, "early"), (3.5, "hi")]


def test_a7_both_layouts(spark):
    f = spark.createDataFrame([("a", '[{"i": 3, "verdict": "match"}]'), ("b", '{"summary": {"x": 1}, "report": [{"narr": "n"}]}')], "run_id string, value string")
    assert sorted(rows(reports.parse_reports(f), "run_id", "line_no")) == [("a", 3), ("b", 0)]
    with pytest.raises(Exception, match="not a report"):
        reports.parse_reports(spark.createDataFrame([("c", "nope")], "run_id string, value string")).collect()


def test_a8_and_a10_files(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"time": "2026-01-02 03:04:05", "file": "a"}, {"time": "2026-01-03 03:04:05", "file": "b"}]')
    assert [r[0] for r in rows(reports.read_runs(spark, str(tmp_path / "h.json")), "file")] == ["b", "a"]
    cues = spark.createDataFrame([(1, 0, 0.5, 1.5, "x"), (1, 1, 2.0, 3.0, " ")], "media_id long, cue_no int, start_s double, end_s double, text string")
    subtitles.write_srt(cues, str(tmp_path / "srt"))
    assert "00:00:00,500 --> 00:00:01,500" in next((tmp_path / "srt" / "media_id=1").glob("part*")).read_text()


def test_empty_inputs(spark):
    cues = spark.createDataFrame([], "media_id long, cue_no int, start_s double, end_s double, text string")
    segs = spark.createDataFrame([], "media_id long, seg_no int, start_s double, end_s double")
    for df in (joins.overlap_join(cues, segs), windows.collapse_repeats(cues), windows.merge_intervals(segs), sequences.cap_segments(segs), select.sort_timeline(segs), signals.kind_histogram(cues), tables.all_tags(spark.createDataFrame([], "tags array<string>"))):
        assert df.count() == 0
