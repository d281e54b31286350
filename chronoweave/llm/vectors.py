"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is learned from a bounded sample; every distinct vector is put into a leaf. A query walks the tree through a
priority queue of nodes by the distance of their centres and visits leaves in that order. How many leaves is calibrated: for
a bounded number of queries the true neighbours are found by brute force over all vectors, and visits widen until the share
found reaches ``RECALL``. Equal vectors are one entry with its smallest ids, so thousands of copies cost one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

SAMPLE, SAMPLE_BYTES, BRANCH, LEAF_ROWS, CALIBRATE, RECALL, GROUP_ROWS = 20_000, 64 << 20, 8, 400, 96, 0.96, 16_384


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has finite components, not all zero, and the most common length (the smallest of those that tie)."""
    v = F.col(column)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(v) == (common["d"] if common else 0)).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Tree:
    """Centres of all nodes; children of inner nodes; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [[]], [-1]
        work, leaves = [(0, np.arange(len(sample)))], 0
        while work:
            node, rows = work.pop()
            x = sample[rows]
            if len(rows) <= leaf_size or not (own := self._means(x, rng))[0].size:
                self.leaf[node], leaves = leaves, leaves + 1
                continue
            centres, of = own
            for k, c in enumerate(centres):
                self.centres.append(c)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                work.append((len(self.centres) - 1, rows[of == k]))
        self.centres, self.leaves = np.array(self.centres), leaves

    @staticmethod
    def _means(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        c = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(12):
            of = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
            used = np.unique(of)
            c = np.array([x[of == k].mean(axis=0) for k in used])
        of = (-2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
        used, of = np.unique(of, return_inverse=True)
        return (c[used], of) if len(used) > 1 else (np.zeros((0, 1)), of)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres."""
        return (x**2).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, nearest child after nearest child."""
        out = np.zeros(len(x), np.int32)
        for at in range(0, len(x), 2048):
            d = self.distances(x[at : at + 2048])
            node = np.zeros(len(d), np.int64)
            todo = np.arange(len(d))
            while len(todo):
                for n in np.unique(node[todo]):
                    own = todo[node[todo] == n]
                    if kids := self.children[n]:
                        node[own] = np.array(kids)[d[np.ix_(own, kids)].argmin(axis=1)]
                todo = todo[[bool(self.children[n]) for n in node[todo]]]
            out[at : at + len(d)] = np.array(self.leaf)[node]
        return out

    def visits(self, d: np.ndarray, most: int) -> list[int]:
        """Leaves of one query in the order of a best-bin-first walk. d: its distances to all centres."""
        queue, out = [(d[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for k in self.children[node]:
                heapq.heappush(queue, (d[k], k))
        return out


def _best(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, names: list[list[int]], k: int) -> tuple[list, list, list]:
    """For each query the k nearest ids of these entries but its own, by (distance, id)."""
    qs, vs, ds = [], [], []
    for q, own in zip(queries, ids.tolist(), strict=True):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        near = np.arange(len(d)) if len(d) <= k + 1 else np.flatnonzero(d <= np.partition(d, k)[k])
        found = sorted((d[i], v) for i in near for v in names[i] if v != own)[:k]
        qs += [own] * len(found)
        vs += [v for _, v in found]
        ds += [s for s, _ in found]
    return qs, vs, ds


def search(vectors: DataFrame, queries_of, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> DataFrame:
    """vectors(vec_id, embedding), queries_of: a condition on vec_id -> (query_id, rank, vec_id, score) with the k nearest
    found among all rows but the query's own, nearest first, ties to the smaller id; score is the Euclidean distance of the
    original vectors in double precision. Unusable vectors (see usable()) take no part; of a repeated vec_id with one vector
    one counts, with several vectors each is a candidate; an empty table gives none."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors)
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    kept = rows.distinct().withColumn("r", first).where(F.col("r") <= k + 1)  # the limit holds before the shuffle as well
    entries = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = write_table(entries, "entries")
    queries = rows.where(queries_of).distinct().select(F.col("vec_id").alias("query_id"), "v")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = entries.select(F.size("v")).first()[0]
    size = min(sample, max(1000, SAMPLE_BYTES // (8 * dim)))
    seen = entries.select("v").orderBy(F.xxhash64("v")).limit(size).toArrow()  # at most ``sample`` rows
    seen = _matrix(seen["v"].combine_chunks())
    tree = Tree(seen, max(4, round(leaf_rows * len(seen) / n)), seed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(_matrix(b.column(0))))], ["v", "ids", "leaf"])

    index = write_table(entries.mapInArrow(put, "v array<double>, ids array<long>, leaf int"), "leaves")
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATE).toPandas()  # at most CALIBRATE rows
    if some.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked, asked_ids = np.stack(some["v"]), some["query_id"].to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v, d = _best(asked, asked_ids, _matrix(b.column(0)), b.column(1).to_pylist(), k)
            of = {v: leaf for ids, leaf in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for v in ids}
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64()), pa.array([of[x] for x in v], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

    ranked = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    truth = index.mapInArrow(brute, f"{schema}, leaf int").withColumn("rank", ranked).where(F.col("rank") <= k).toPandas()  # k rows for each
    order = {q: {leaf: i for i, leaf in enumerate(tree.visits(d, tree.leaves))} for q, d in zip(asked_ids.tolist(), tree.distances(asked), strict=True)}
    needed = np.sort([order[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    most = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else tree.leaves

    # Leaves of neighbouring numbers are packed into groups of about GROUP_ROWS entries, larger leaves are cut into slices: a query
    # gets k rows from each group it visits, not from each leaf. The tree bounds the number of leaves.
    group, slices, filled = np.zeros(tree.leaves, np.int64), [1], 0
    for r in sorted(index.groupBy("leaf").count().collect()):
        if filled and filled + r["count"] > GROUP_ROWS:
            slices, filled = [*slices, 1], 0
        group[r["leaf"]], filled = len(slices) - 1, filled + r["count"]
        slices[-1] = max(slices[-1], -(-r["count"] // GROUP_ROWS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, d in enumerate(tree.distances(_matrix(b.column(1)))):
                by_group: dict[int, list[int]] = {}
                for leaf in tree.visits(d, most):
                    by_group.setdefault(int(group[leaf]), []).append(leaf)
                rows += [(i, g, s, leaves) for g, leaves in by_group.items() for s in range(slices[g])]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int32()))))], ["query_id", "v", "group", "slice", "leaves"])

    places = spark.createDataFrame([(i, int(g), slices[g]) for i, g in enumerate(group)], "leaf int, group int, n int").hint("broadcast")  # a row for each leaf of the tree
    left = index.join(places, "leaf").select("group", F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("slice"), "leaf", "v", "ids")
    right = queries.mapInArrow(walk, "query_id long, v array<double>, group int, slice int, leaves array<int>")

    def near(x: pa.Table, q: pa.Table) -> pa.Table:
        out = ([], [], [])
        if x.num_rows and q.num_rows:
            m, names, leaf = _matrix(x["v"].combine_chunks()), x["ids"].to_pylist(), x["leaf"].to_numpy()
            asked, ids, lists = _matrix(q["v"].combine_chunks()), q["query_id"].to_numpy(), q["leaves"].to_pylist()
            for i, leaves in enumerate(lists):
                use = np.flatnonzero(np.isin(leaf, leaves))
                for c, got in zip(out, _best(asked[i : i + 1], ids[i : i + 1], m[use], [names[j] for j in use], k), strict=True):
                    c += got
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    found = left.groupBy("group", "slice").cogroup(right.groupBy("group", "slice")).applyInArrow(near, schema)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
