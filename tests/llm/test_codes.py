"""Vector codes against entry-by-entry assignment, and against the query's SQL."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from chronoweave.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, n long, sums string, code string"


def brute(rows, k=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 16)) * 16
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)), lab) for i, v, lab in kept]
    width = dims // 16
    parts = [[tuple(v[p * width : (p + 1) * width]) for p in range(16)] for _, v, _ in whole]
    order = sorted(range(len(whole)), key=lambda j: (whole[j][0] is None, whole[j][0] or 0, whole[j][1]))[:k]
    books = [[parts[j][p] for j in order] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(16):
            own = {}
            for row in parts:
                own.setdefault(near(p, row[p])[1], []).append(row[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[n], strict=True)) if n in own else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(p, row[p]) for p in range(16)] for row in parts]
    errors = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, _, lab), e in zip(whole, errors, strict=True):
        label[lab] = label.get(lab, 0) + e
    return sorted(((i, "".join(f"{n:02x}" for _, n in f), e, label[lab], digest) for (i, _, lab), f, e in zip(whole, found, errors, strict=True)), key=str)


def run(spark, rows, **options):
    got = codes.codes(spark.createDataFrame(rows, SCHEMA), **options).drop("label")
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    hot = [rng.gauss(0, spread) for _ in range(dims)]
    return [(i, hot if rng.random() < 0.3 else [round(rng.gauss(0, spread), rng.choice([1, 3])) for _ in range(dims)], rng.choice([1, 2, None]), 0, "", "") for i in range(n)]


@pytest.mark.parametrize(("n", "dims"), [(300, 32), (90, 16), (40, 64)])
def test_codes_are_those_of_entry_by_entry(spark, n, dims):
    rows = vectors(n, dims, n)
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(80, 32, 3) + [(900, None, 1, 0, "", ""), (901, [float("nan")] * 32, 1, 0, "", ""), (902, [None] + [0.0] * 31, 1, 0, "", ""), (903, [float("inf")] * 32, 1, 0, "", ""), (904, [], None, 0, "", ""), (905, [1.0, -1.0], 9, 0, "", ""), (906, [0.5] * 35, 9, 0, "", ""), (None, [0.25] * 32, 9, 0, "", ""), (3, [0.1] * 32, 9, 0, "", ""), (3, [0.1] * 32, 9, 0, "", "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, rows[80:83]) == []
    assert len(run(spark, [(1, [3e38] * 16, 1, 0, "", ""), (2, [-3e38] * 16, 1, 0, "", "")])) == 2


def test_many_labels_and_small_runs_of_leaves(spark, monkeypatch):
    rows = vectors(120, 32, 9)
    monkeypatch.setattr(codes, "LABELS", 0)
    assert run(spark, rows) == brute(rows)
    leaves = np.unique(np.array([r[1] for r in rows]).round(2) * 100 // 1, axis=0).astype(np.int64)
    whole = codes.walk(leaves, leaves[::3])
    monkeypatch.setattr(codes, "LEAVES", 7)
    assert all((a == b).all() for a, b in zip(whole, codes.walk(leaves, leaves[::3]), strict=True))


def test_query_is_its_sql(spark):
    got = codes.query(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con.execute(f"create view embeddings as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(codes.SQL).fetchall()
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
