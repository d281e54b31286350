"""Chains and text scrubbing that SQL does not say, against plain Python over the same rows."""

import difflib
import os
import re
from pathlib import Path

import numpy as np
import pytest
from chronoweave.functions import text as tx
from chronoweave.operators import sequences as sq
from chronoweave.operators import signals, windows
from chronoweave.plans import bindings as b
from chronoweave.plans import pipelines, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.QUERIES[name](spark, DATA).toPandas()


# ---- H22, H23


def bare(text):
    return re.sub(r"\{[^}]*\}", "", text)


def clauses(text):
    """(clause, mark) pairs: cut after a mark, never inside an open pair of quotes, brackets or braces."""
    pairs, out, now, until = dict(zip("“‘「『（({", "”’」』）)}", strict=True)), [], "", None
    for at, c in enumerate(text):
        if until is None and c == "{" and "}" not in text[at:]:
            return None  # a brace that nothing closes
        if until is None and c in "，,。；;！!？?":
            out.append((now, c))
            now = ""
            continue
        now += c
        if until is None and c in pairs:
            until = pairs[c]
        elif c == until:
            until = None
    return [*out, (now, "")] if now else out


def tidy(s):
    s = re.sub(r"[，,；;、]((?:\{[^}]*\})*)\s*$", r"。\1", s)
    s = re.sub(r"([，。！？；：])\1+", r"\1", s)
    return re.sub(r"[，、；]\s*(?=[。！？])", "", s).strip(" ")


def scrubbed(raw):
    """The scrubbing chain of a text without Latin letters."""
    s = raw or ""
    if any(g in s or re.search(g, s) for g in tx.GUESSES):
        parts = clauses(s)
        guess = lambda c: any(re.search(g, c) for g in tx.GUESSES) and c[:1] not in tuple("他她它") and (len(c) <= 16 or any(re.match(g, c) for g in tx.GUESSES))
        kept = [p for p in parts if not guess(bare(p[0]).strip(" "))]
        if len(parts) >= 3 and 2 <= len(kept) < len(parts):
            s = tidy("".join(c + m for c, m in kept).strip(" "))
    parts = clauses(s)
    kept = [p for p in parts if not re.search(tx.BROKEN, bare(p[0]).strip(" "))]
    if len(parts) >= 2 and 0 < len(kept) < len(parts):
        s = tidy("".join(c + m for c, m in kept).strip(" "))
    s = tidy(s)
    return raw if bare(s).strip(" ") == "" else s


def test_h22_scrub_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    words = ["他走了", "她回头看", "天黑了", "警察提到", "他大声说道", "门口传来", "也许他错了", "或许没有人", "（其实，不是）", "“你好，走吧”", "{停顿:1}", "风很大", *[g for g in tx.GUESSES if re.fullmatch(r"[一-鿿]+", g)][:6]]
    texts = ["".join(rng.choice(words) + rng.choice(list("，，。；！？")) for _ in range(rng.integers(1, 7))) + rng.choice(["", "尾", "，", "。。"]) for _ in range(600)] + ["", "，"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, text string")
    got = {r.line_no: r.s for r in df.select("line_no", tx.scrub("text").alias("s")).collect()}
    assert {i: got[i] for i in got} == {i: scrubbed(t) for i, t in enumerate(texts)}
    assert sum(got[i] != t for i, t in enumerate(texts)) > 100
    kept = tx.scrub_texts(df).collect()
    assert len(kept) == len(texts) and all(r.changed == (r.text != texts[r.line_no]) and r.text == got[r.line_no] for r in kept)


# ---- I10


def test_i10_tempo_equals_plain_sums(spark):
    rng, rows, want = np.random.default_rng(9), [], {}
    for media, rate in enumerate((4.0,) * 6):
        x = rng.random(240).round(3)
        x[:: int(rng.integers(2, 4))] += 2
        rows += [(media, i, float(v)) for i, v in enumerate(x)]
        y = x - x.mean()
        auto = [float(np.dot(y[: len(y) - k], y[k:])) for k in range(len(y))]
        lo, hi = max(1, int(rate * 60 / 180)), min(len(x) - 1, int(rate * 60 / 60))
        lag = max(range(lo, hi + 1), key=lambda k: (round(auto[k], 6), -k))
        best = (-1.0, 0.0, 0.0)
        for period in sorted({lag * f * s for f in (0.5, 1.0, 2.0) for s in (0.99, 1.0, 1.01)}):
            if lo <= period <= hi:
                for phase in range(int(period)):
                    at, beats = [], 0
                    while phase + beats * period < len(x) - 0.5:
                        at.append(round(phase + beats * period))
                        beats += 1
                    best = max(best, (float(np.mean([x[k] for k in at if k < len(x)])), rate * 60 / period, phase / rate))
        want[media] = (round(best[1], 2), round(best[2], 3))
    got = sq.tempo(spark.createDataFrame(rows, "media_id long, frame_no long, strength double"), 4.0).collect()
    assert {r.media_id: (r.bpm, r.phase_s) for r in got} == want


# ---- I23


def test_i23_quotes_take_the_most_alike_cue(spark, run):
    cues = b.cues(spark, DATA).toPandas()
    norm = lambda t: re.sub("[^一-鿿A-Za-z0-9]", "", t)
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} - {"  "}
    want = {}
    for _, group in cues.groupby("media_id"):
        for c in group.itertuples():
            for pos, said in enumerate(re.split(r"[.!?\n]+", c.text)):
                said = said.strip(" ")
                if not 2 <= len(said) <= 80 or set(said) & set("”’」』“‘「『\"'"):
                    continue
                best = None
                for o in group.itertuples():
                    if o.end_s >= c.start_s - 240 and o.start_s <= c.start_s + 240 and pairs(said) & pairs(o.text) and min(len(norm(said)), len(norm(o.text))) > 1:
                        ratio = difflib.SequenceMatcher(None, norm(said), norm(o.text)).ratio()
                        if ratio >= 0.55 and (best is None or (ratio, -o.start_s) > best[:2]):
                            best = (ratio, -o.start_s, o.cue_no)
                if best:
                    want[c.media_id, c.cue_no * 1000 + pos] = (best[2], round(best[0], 6))
    got = {(r.media_id, r.line_no): (r.cue_no, r.ratio) for r in run("i23_quote_slots").itertuples()}
    assert want and {k: v for k, v in got.items() if k in want} == want and len(set(got) - set(want)) <= len(want) // 10


# ---- P1, P2


def ranks(x):
    if x.max() - x.min() <= 1e-9 or len(x) < 2:
        return np.full(len(x), 0.5)
    return np.array([((x < v).sum() + (x <= v).sum() - 1) / 2 for v in x]) / (len(x) - 1)


def test_p1_clips_of_four_signals(spark):
    """Counts, means and ranks by hand, then the walk that tests/test_brute.py holds against its own brute force."""
    window, given = registry.GRID, registry._four_signals(spark, DATA)
    end, n = b.DAYS_S, int(np.ceil(b.DAYS_S / registry.GRID))
    curve = {(r.media_id, r.win): r for r in pipelines.curves(b.users(spark, DATA), window, **given).collect()}
    live, frames, cues = given["events"].toPandas(), given["frames"].toPandas(), given["cues"].toPandas()
    weight = {(r.media_id, r.cue_no): r.w for r in given["cues"].select("media_id", "cue_no", tx.line_weight("text").alias("w")).collect()}
    want = []
    for media, own in live.groupby("media_id"):
        win = (own.t_s / window).astype(int).to_numpy()
        frame = frames[frames.media_id == media]
        fwin = (frame.t_s / window).astype(int).to_numpy()
        x = {"chat": np.bincount(win, minlength=n)[:n].astype(float)}
        x["audio"] = np.array([np.sqrt(np.mean((own.cents[win == k] / 32768.0) ** 2)) if (win == k).any() else 0.0 for k in range(n)])
        x["motion"] = np.array([frame.motion[fwin == k].mean() if (fwin == k).any() else 0.0 for k in range(n)])
        x["speech"] = np.zeros(n)
        for c in cues[cues.media_id == media].itertuples():
            stop = c.end_s if c.end_s > c.start_s else c.start_s + 0.5
            for k in range(int(c.start_s // window), min(n, max(int(c.start_s // window), int(np.ceil(stop / window)) - 1) + 1)):
                x["speech"][k] += max(0.0, min(min(stop, (k + 1) * window) - max(c.start_s, k * window), window)) * weight[media, c.cue_no]
        here = {k: np.abs(v).max() > 0 for k, v in x.items()}
        weights = {k: pipelines.WEIGHTS[f"{k}_rank"] for k in x if here[k]}
        fused = sum(w * ranks(x[k].round(9)) for k, w in weights.items()) / sum(weights.values())
        got = np.array([curve[media, k].fused for k in range(n)])
        assert np.abs(got - fused).max() < 1e-6, media
        want.append(media)
    assert want
    clips = sq.select_clips(pipelines.curves(b.users(spark, DATA), window, **given), window, 3).toPandas()
    top = registry.QUERIES["p1_highlights_of_four_signals"](spark, DATA).toPandas()
    assert sorted(zip(clips.media_id, clips.start_s, clips.end_s)) == sorted(zip(top.media_id, top.start_s, top.end_s)) and (clips.end_s <= end).all()
    for _, group in top.groupby("media_id"):
        assert 1 <= len(group) <= 3 and (group.reasons != "").all()


def test_p2_points_lie_on_the_curve(run):
    got = run("p2_points_of_four_signals")
    assert len(got) and (got.start_s <= got.peak_t).all() and (got.peak_t <= got.end_s).all() and got.pct.between(0, 100).all()
    for _, group in got.sort_values("start_s").groupby("media_id"):
        assert (group.end_s.to_numpy()[:-1] <= group.start_s.to_numpy()[1:] + 1e-6).all() and len(group) <= 30


# ---- P3, P4


def test_p3_results_fit_together(spark, run):
    x = registry._aligned_corpus(spark, DATA)
    lines = {(r.media_id, r.line_no): r.text for r in x["lines"].collect()}
    segments, caps, plan = run("p3_captioned_segments"), run("p3_quotes_and_caps"), run("p3_align_corpus")
    assert len(segments) and set(segments.importance) <= {"key", "advance", "transition"}
    for r in segments.itertuples():
        assert r.caption == lines[r.media_id, r.line_no] and r.end_s >= r.start_s
    ends = b.media(spark, DATA).toPandas().set_index("media_id").dur
    for media, group in segments.groupby("media_id"):
        assert group.start_s.min() >= 0 and group.start_s.max() <= np.ceil(ends[media] / 15) * 15
        assert not group.duplicated(["line_no", "part"]).any()
    assert set(caps.media_id) == set(segments.media_id) and (caps.jump_cap > 0).all()
    scenes = x["alignment"].toPandas()
    total = {m: len([k for k in lines if k[0] == m]) for m in plan.media_id}
    assert all(r.total == total[r.media_id] and r.aligned == scenes[scenes.media_id == r.media_id].line_no.nunique() for r in plan.itertuples())


def test_p4_is_its_steps_by_hand(spark, run):
    """Cuts of three kinds joined by weight and the strongest beats, then the plan that tests/test_brute.py holds against its rules."""
    live, frames = b.live(spark, DATA), b.frames(spark, DATA)
    cuts = signals.union_cuts(live.where("text = 'signup'"), windows.motion_cuts(frames), windows.visual_cuts(frames)).toPandas()
    beats = live.where("text = 'purchase'").select("media_id", "t_s", "cents").toPandas()
    got = run("p4_beat_cut_plan")
    assert set(got.media_id) == set(b.users(spark, DATA).toPandas().media_id)
    for media, group in got.sort_values("pos").groupby("media_id"):
        t = group.t_s.to_numpy()
        assert t[0] == 0 and abs(t[-1] - b.DAYS_S) < 1e-3 and (np.diff(t) > 0).all() and group.pos.tolist() == list(range(len(t)))
        known = np.concatenate([cuts[cuts.media_id == media].t_s, beats[beats.media_id == media].t_s])
        assert len(known) and all(np.abs(known - x).min() < 0.51 for x in t[1:-1])
