"""Vector codes: sixteen parts a vector, each known by the nearest entry of its position's codebook (product quantisation).

Assignment walks a trie: the distinct parts of a batch in lexicographic order are its leaves, their common prefixes its inner nodes. A
node adds one dimension's squared differences from all entries to what its parent has accumulated, so vectors that share a prefix share
that sum; leaves take the nearest entry, and their sums are weighted by how many vectors have the part. The walk is depth first by runs
of ``LEAVES`` leaves, level by level within a run, so a task holds as many accumulated vectors as a run has nodes. Nothing is
shuffled but one row for each task, position and entry; the driver holds codebooks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, make_room, unused

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAVES = 4096
#: Labels whose sums are broadcast; beyond it they are joined by merge.
LABELS = 100_000


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct parts (rows in lexicographic order) and the entries of their position -> each one's nearest entry, the lower of
    equals, and its squared distance."""
    near, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for s in range(0, len(parts), LEAVES):
        leaves = parts[s : s + LEAVES]
        node = np.zeros(len(leaves), np.int64)  # each leaf's node of the level above
        sums = np.zeros((1, len(book)), np.int64)
        new = np.zeros(len(leaves), bool)
        new[:1] = True
        for k in range(parts.shape[1]):
            new[1:] |= leaves[1:, k] != leaves[:-1, k]
            first = np.flatnonzero(new)
            sums = sums[node[first]] + (leaves[first, k][:, None] - book[:, k][None, :]) ** 2
            node = np.cumsum(new) - 1
        best = sums.argmin(axis=1)
        near[s : s + LEAVES], far[s : s + LEAVES] = best[node], sums[np.arange(len(best)), best][node]
    return near, far


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, dims // PARTS)


def _summed(books: np.ndarray, dims: int):
    """Vectors -> for each position and entry the number and the sums of the parts that are nearest to it, a task's in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            rows = _rows(batch.column(0), dims)
            for p in range(PARTS if len(rows) else 0):
                leaves, weight = np.unique(rows[:, p], axis=0, return_counts=True)
                near, _ = walk(leaves, books[p])
                np.add.at(count[p], near, weight)
                np.add.at(sums[p], near, leaves * weight[:, None])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            rows = _rows(batch.column(2), dims)
            code, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(PARTS if len(rows) else 0):
                leaves, back = np.unique(rows[:, p], axis=0, return_inverse=True)
                near, far = walk(leaves, books[p])
                code[:, p], error = near[back.ravel()], error + far[back.ravel()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _integers(vector: Column, dims: int) -> Column:
    """floor(256 x) of each component, zeros after the last; beyond what squared distances of a long allow, the nearest such."""
    most = isqrt(2**61 // dims) // 2
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * SCALE))))))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors -> (vec_id, label, code, error, label_error, codebooks_sha256), a row for each vector that is usable.

    Vectors that are null or hold null or non-finite components are left out. All others take part: where lengths differ, or 16 does not
    divide them, zeros follow up to the least multiple of 16 that holds the longest (an empty vector is all zeros). Components whose
    squares no long could hold, from about 2**21 on, count as the nearest that one can. Of repeated vec_ids each row is coded;
    null vec_ids come last where the entries are drawn. With fewer vectors than entries the codebooks are as small; an empty
    table gives none. Null labels share one sum."""
    usable = F.coalesce(~F.exists(embedding, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True))), F.lit(False))
    kept = vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    dims = max(1, -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)) * PARTS
    kept = kept.select("vec_id", "label", _integers(F.col("v"), dims).alias("v"))
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), PARTS, dims // PARTS).swapaxes(0, 1).copy()
    schema = f"vec_id long, label {vectors.schema[label].dataType.simpleString()}, code string, error long"
    for _ in range(rounds if len(start) else 0):
        sums = kept.select("v").mapInArrow(_summed(books, dims), "part int, entry int, n long, sums array<long>")
        one = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims // PARTS)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *one).collect():  # a row for each entry
            books[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(dims // PARTS)]
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = kept.mapInArrow(_coded(books, dims), schema) if len(start) else kept.sparkSession.createDataFrame([], schema)
    out = checkpointed(out)
    sums = checkpointed(out.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    sums = F.broadcast(sums) if sums.count() <= LABELS else sums.hint("merge")
    out = out.join(sums, out["label"].eqNullSafe(sums["of"]))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _sql() -> str:
    ctes = """
with kept as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
    select vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as part from kept, range(16) t(p)
), book0 as (
    select p, row_number() over (partition by p order by vec_id) - 1 as e, part as entry
    from parts qualify row_number() over (partition by p order by vec_id) <= 64
)"""
    for r in range(3):
        ctes += f""", near{r} as (
    select d.p, d.part, min(struct_pack(d := list_sum(list_transform(list_zip(d.part, b.entry), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), e := b.e)) as m
    from (select distinct p, part from parts) d join book{r} b on d.p = b.p group by d.p, d.part
)"""
        if r < 2:
            ctes += f""", mean{r} as (
    select p, e, list(c order by i) as entry from (
        select s.p, n.m.e as e, i, cast(floor(sum(s.part[i]) / count(*)) as bigint) as c
        from parts s join near{r} n on s.p = n.p and s.part = n.part, unnest(range(1, len(s.part) + 1)) t(i) group by s.p, n.m.e, i
    ) group by p, e
), book{r + 1} as (
    select b.p, b.e, coalesce(m.entry, b.entry) as entry from book{r} b left join mean{r} m on b.p = m.p and b.e = m.e
)"""
    return (
        ctes
        + """, coded as (
    select s.vec_id, s.label, string_agg(printf('%02x', n.m.e), '' order by s.p) as code, cast(sum(n.m.d) as bigint) as error
    from parts s join near2 n on s.p = n.p and s.part = n.part group by s.vec_id, s.label
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) from book2) as codebooks_sha256
from coded"""
    )


SQL = _sql()
