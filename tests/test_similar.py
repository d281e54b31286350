"""Similarity joins, classes of near lines, chains, alignment and common stretches against plain Python."""

import difflib
import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from chronoweave.functions.text import longest_common
from chronoweave.operators import joins, select, signals, similar, windows
from chronoweave.operators import sequences as sq

LETTERS = "abcdefgh 天地😀"


def bigrams(text):
    return {text[i : i + 2] for i in range(len(text or "") - 1)} - {"  "}


def texts(seed, n, size=40):
    rng = random.Random(seed)
    out = ["", None, "a", "  ", "ab"]
    while len(out) < n:
        base = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, size)))
        for _ in range(rng.choice([1, 1, 3])):
            k = rng.randrange(len(base))
            out.append(base[:k] + rng.choice(LETTERS) + base[k + 1 :])
    return out[:n]


@pytest.mark.parametrize(("metric", "least"), [("jaccard", 0.0), ("jaccard", 0.2), ("jaccard", 0.6), ("containment", 0.3), ("containment", 0.8), ("coverage", 0.5), ("jaccard", 1.0)])
def test_c9_forms_equal_all_pairs(spark, monkeypatch, metric, least):
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "SLICE", 11)
    left, right = list(enumerate(texts(1, 40))), list(enumerate(texts(2, 60) + texts(1, 20)))
    want = []
    for i, a in left:
        for k, b in right:
            g, h = bigrams(a), bigrams(b)
            s = len(g & h)
            if s:
                score = s / {"jaccard": len(g | h), "containment": min(len(g), len(h)), "coverage": len(g)}[metric]
                if score >= least:
                    want.append((i, k, s, round(score, 9)))
    q, d = spark.createDataFrame(left, "q_id int, text string"), spark.createDataFrame(right, "d_id long, text string")
    forms = [joins.bigram_join(q, d, metric, least), similar.block_join(q, d, metric, least)]
    if least:
        forms.append(similar.prefix_join(q, d, metric, least))
    for form in forms:
        assert sorted((r.q_id, r.d_id, r.shared, round(r.score, 9)) for r in form.collect()) == sorted(want)


def test_c9_within_keys(spark):
    rows = [(k % 3, i, t) for k, (i, t) in enumerate(enumerate(texts(4, 60)))]
    df = spark.createDataFrame(rows, "media_id long, q_id int, text string")
    docs = df.withColumnRenamed("q_id", "d_id")
    for least in (0.0, 0.25):
        got = {(r.media_id, r.q_id, r.d_id) for r in joins.bigram_join(df, docs, "coverage", least, on=["media_id"]).collect()}
        want = {(m, i, k) for m, i, a in rows for n, k, b in rows if m == n and (s := len(bigrams(a) & bigrams(b))) and s >= least * len(bigrams(a))}
        assert got == want


def test_i17_near_lines_are_the_classes_of_all_pairs(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for _ in range(120):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([4, 20, 80, 200])))
        for _ in range(rng.choice([1, 2, 6])):
            k = rng.randrange(len(base))
            rows.append((at % 17, at, base if rng.random() < 0.3 else base[:k] + rng.choice("xyz") + base[k + 1 :]))
            at += 1
    rows += [(50, k, "one line that a third of all has") for k in range(100)] + [(51, 0, ""), (51, 1, "q"), (51, 2, "")]
    grams, root = [bigrams(t) for _, _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(grams[i] & grams[k])
            if rows[i][2] == rows[k][2] or (both and both >= 0.8 * len(grams[i] | grams[k])):
                root[find(i)] = find(k)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[:2])
    want = sorted((*r[:2], *min(groups[find(i)]), len(groups[find(i)])) for i, r in enumerate(rows))
    got = similar.near_lines(spark.createDataFrame(rows, "media_id long, line_no int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert similar.near_lines(spark.createDataFrame([], "media_id long, line_no int, text string")).count() == 0


def test_i17_kept_lines_of_a_long_script():
    rng, kept, want = random.Random(3), sq._Kept(0.52, 0.45), []
    for t in [t or "" for t in texts(9, 400, 30)]:
        own = bigrams(t)
        alike = any((own | g) and len(own & g) >= 0.52 * len(own | g) for g in want)
        told = bool(want) and len(own & want[-1]) > 0 and len(own & want[-1]) >= 0.45 * min(len(own), len(want[-1]))
        if keep := not alike and not told:
            want.append(own)
        assert kept.add(t) == keep
    assert rng and len(want) > 10


def chain_brute(line, t, score):
    best, back = [(1, float(x)) for x in score], [-1] * len(line)
    for i in range(len(line)):
        for k in range(i):
            if line[k] < line[i] and t[k] < t[i] and (value := (best[k][0] + 1, best[k][1] + score[i])) > best[i]:
                best[i], back[i] = value, k
    at, out = max(range(len(line)), key=lambda i: (best[i], -i)), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def test_f10_chain_equals_every_earlier_row_and_is_fast():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        line, t = np.sort(rng.integers(0, 12, n)), rng.integers(0, 12, n).astype(float)
        order = np.lexsort((t, line))
        line, t, score = line[order], t[order], rng.integers(0, 4, n).astype(float)
        assert sq._chain(line, t, score) == chain_brute(line, t, score)
    n = 100_000
    began = time.perf_counter()
    assert len(sq._chain(np.arange(n), rng.permutation(n).astype(float), np.ones(n))) > 400
    assert time.perf_counter() - began < 30


def test_h10_common_stretch():
    rng = random.Random(4)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab天😀") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        assert longest_common(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size
    shared = "".join(rng.choice("abcdefgh") for _ in range(5000))
    x, y = ("".join(rng.choices("abcdefgh", k=300_000)) + shared + c + "".join(rng.choices("abcdefgh", k=300_000)) for c in "xy")
    assert 5000 <= longest_common("0" + x, "1" + y) < 5040
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    assert longest_common(morse, morse.translate(str.maketrans("ab", "ba"))) == difflib.SequenceMatcher(None, morse, morse.translate(str.maketrans("ab", "ba")), autojunk=False).find_longest_match().size


def best_before_brute(best, starts, ends, band, limit, cost):
    top, gap = [], []
    for j in range(len(best)):
        found = [(best[k] - (cost if k == j else 0.0), j - k) for k in range(max(0, j - band), j + 1) if limit is None or -1e-6 <= starts[j] - ends[k] <= limit]
        value, back = max(found, default=(-np.inf, 0))
        top.append(value)
        gap.append(back)
    return top, gap


def test_i1_bands_equal_every_earlier_scene():
    rng = np.random.default_rng(8)
    for _ in range(200):
        m = int(rng.integers(1, 30))
        starts = np.sort(rng.integers(0, 60, m)).astype(float)
        ends, best, band = starts + rng.integers(0, 9, m), rng.integers(0, 5, m).astype(float), int(rng.integers(0, m))
        for limit, cost in ((12.0, 0.0), (None, 0.25)):
            top, gap = sq._best_before(best, starts, ends, band, limit, cost)
            want, back = best_before_brute(best, starts, ends, band, limit, cost)
            assert top.tolist() == want
            assert [g for g, t in zip(gap.tolist(), want, strict=True) if np.isfinite(t)] == [g for g, t in zip(back, want, strict=True) if np.isfinite(t)]


# ---- timelines of any length: ranks, percentiles, picks


def hot_rows(seed, n=3000):
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None]), i, rng.choice([0.0, 0.0, 1.0, round(rng.random() * 20, 1)])) for i in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_e1_wide_ranks_equal_windows(spark, ties):
    rows = [*hot_rows(3), (9, 0, 5.0), (8, 0, 2.0), (8, 1, 2.0)]
    df = spark.createDataFrame(rows, "media_id long, win int, x double").repartition(7)
    one = {(r.media_id, r.win): r["rank"] for r in windows.pct_rank(df, "x", ties=ties).collect()}
    two = {(r.media_id, r.win): r["rank"] for r in windows.pct_rank_wide(df, "x", ties=ties).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    assert windows.pct_rank_wide(spark.createDataFrame([], df.schema), "x", ties=ties).count() == 0


def test_ranges_split_a_hot_timeline(spark):
    df = spark.createDataFrame(hot_rows(5), "media_id long, win int, x double")
    d = df.repartitionByRange(8, "media_id", "x", "win").withColumn("p", F.spark_partition_id())
    assert d.where("media_id = 1").select("p").distinct().count() > 2
    got = windows.range_places(df, ["x", "win"]).collect()
    for m in (1, 2, None):
        own = sorted((r.x, r.win, r.place, r.n) for r in got if r.media_id == m)
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}


def test_d17_wide_percentiles(spark):
    df = spark.createDataFrame([*hot_rows(7), (5, 0, None), (6, 0, 2.5)], "media_id long, win int, x double")
    one = {r.media_id: r for r in signals.robust_thresholds(df.where("x is not null"), "x").collect()}
    two = {r.media_id: r for r in signals.robust_thresholds(df, "x", wide=True).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert all(abs(one[k][c] - two[k][c]) < 1e-9 for c in one[k].asDict() if c != "media_id")


def test_f14_streams_sorted_groups(spark):
    rng = random.Random(12)
    rows = [(1 if i % 3 else rng.randrange(2, 9), float(a := rng.randrange(60)), float(a + rng.randrange(12)), float(rng.randrange(6))) for i in range(600)]
    got = select.top_k_non_overlapping(spark.createDataFrame(rows, "media_id long, start_s double, end_s double, score double"), 4)
    want = []
    for m in {r[0] for r in rows}:
        kept = []
        for _, a, b, s in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[3], r[1], r[2])):
            if len(kept) < 4 and not any((min(b, y) - max(a, x)) / max(b - a, 1e-9) > 0.5 for x, y, _ in kept):
                kept.append((a, b, s))
        want += [(m, k, *c) for k, c in enumerate(kept)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_e21_leaders_carry_over_blocks(spark):
    """One medium holds most frames; blocks are small, so keys pass over many of them."""
    rng = np.random.default_rng(11)
    for step in (0.02, 0.4):
        rows, want = [], []
        for media, n in ((1, 400), (2, 37), (3, 1)):
            v, key = rng.normal(size=4), None
            for no in np.sort(rng.choice(900, n, replace=False)).tolist():
                v = v + step * rng.normal(size=4)
                x = (v / np.linalg.norm(v)).tolist()
                rows.append((media, no, x))
                same = key is not None and float(np.dot(key[1], x)) >= 0.9
                want.append((media, no, key[0] if same else None))
                key = key if same else (no, x)
        df = spark.createDataFrame(rows, "media_id long, frame_no long, vec array<double>").repartition(5)
        for block in (10, 10_000):
            assert sorted(tuple(r) for r in sq.repeat_leader(df, 0.9, block).collect()) == sorted(want)
    assert sq.repeat_leader(spark.createDataFrame([], "media_id long, frame_no long, vec array<double>"), 0.9).count() == 0


def test_i17_bands_of_unlike_lines_are_not_stored(spark, monkeypatch):
    # lines of few letters: many meet another one in a band by chance, few are alike
    rng, stored, write = random.Random(8), [], similar.written
    rows = [(k % 7, k, "".join(rng.choice("abcdefgh") for _ in range(60))) for k in range(600)]

    def counted(df):
        out = write(df)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(similar, "written", counted)
    got = similar.near_lines(spark.createDataFrame(rows, "media_id long, line_no int, text string"))
    assert got.count() == len(rows)
    assert max(n for columns, n in stored if "bucket" in columns) < 2 * len(rows)


def test_i17_rows_of_large_buckets_meet_all_that_are_near(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(5, 60, 900))
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    sketch = base[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, (900, 4), dtype=np.uint64))
    limit = similar._limit(0.8)
    near = np.triu(np.bitwise_count(sketch[:, None] ^ sketch).sum(axis=-1) <= limit, 1) & (n[:, None] >= 0.8 * n - 1e-9)
    x, y, more = similar._starred(n, sketch, 0.8, limit)
    starred = set(zip(y.tolist(), x.tolist(), strict=True))
    pairs = set(zip(*(k.tolist() for k in np.nonzero(near)), strict=True))
    assert starred <= pairs
    assert all(more[i] and more[k] for i, k in pairs - starred)
