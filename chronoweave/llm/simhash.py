"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

Candidates share bit blocks (a difference of at most four bits leaves two of six blocks equal, three of seven, and so on; the more
fingerprints, the more blocks, so that a bucket holds about one fingerprint by chance and work grows little faster than the
fingerprints). Inside a bucket each fingerprint carries its distances to reference fingerprints; a pair whose distances differ by more than the
radius in any coordinate cannot be near (triangle inequality) and is discarded; survivors are verified by their exact
distance.  Large buckets are cut into tiles of bounded size, and a tile gives a spanning forest of its links, never all
pairs: components lose nothing by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, make_room, write_table

WORDS, RADIUS, PIVOTS, TILE = 4, 4, 16, 512


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The bit majority of XXH64 (seed 42) over all shingles; zero without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    k = min(words, len(parts))
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    votes, n, xx = np.zeros(64, np.int64), len(parts) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        stop = min(n, at + (1 << 15))
        pairs = zip(starts[at:stop].tolist(), ends[at + k - 1 : stop + k - 1].tolist(), strict=True)
        h = np.array([xx(joined[s:e], 42) for s, e in pairs], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp) with the fingerprint as a signed long. Null texts count as empty; every row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def block_count(points: int, radius: int) -> int:
    """The least number of blocks of which those that must be equal have at least as many bits as ``points`` has."""
    blocks = radius + 2
    while (blocks - radius) * 64 // blocks < points.bit_length() and blocks < 3 * radius:
        blocks += 1
    return blocks


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of all but ``radius`` of the blocks: whatever differs in at most ``radius`` bits is equal under one of them."""
    n = blocks or radius + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, n - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable over links a-b, for each of n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, step := root[root]):
            root = step
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _near(fa: np.ndarray, fb: np.ndarray, pivots: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are near: by pivot tables first, by the exact distance for what they leave."""
    keep = np.arange(len(fa))
    for p in pivots:
        da, db = np.bitwise_count(fa[keep] ^ p).astype(np.int8), np.bitwise_count(fb[keep] ^ p).astype(np.int8)
        keep = keep[np.abs(da - db) <= radius]
    return keep[np.bitwise_count(fa[keep] ^ fb[keep]) <= radius]


def _tile_links(fp: np.ndarray, side: np.ndarray, cross: bool, pivots: np.ndarray, radius: int) -> np.ndarray:
    """Roots within one tile (positions). Pivot tables of all rows at once, then row blocks against all columns."""
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(fp)),) * 2
    table = np.stack([np.bitwise_count(fp ^ p) for p in pivots]).astype(np.int8)
    a, b = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        ok = np.ones((len(rows), len(right)), bool)
        for t in table[:4]:
            ok &= np.abs(t[rows][:, None] - t[right][None, :]) <= radius
        i, j = np.nonzero(ok)
        i, j = rows[i], right[j]
        if not cross:
            i, j = i[i < j], j[i < j]
        keep = np.abs(table[4:, i] - table[4:, j]).max(axis=0, initial=0) <= radius
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        a.append(i[keep])
        b.append(j[keep])
    return _forest(len(fp), np.concatenate(a), np.concatenate(b))


def _links(pivots: np.ndarray, radius: int):
    """Rows of tiles in order -> links of a spanning forest of each tile."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        fp = t["fp"].to_numpy().view(np.uint64)
        node = t["node"].to_numpy()
        side, cross = t["side"].to_numpy(), t["tile_a"].to_numpy() != t["tile_b"].to_numpy()
        cols = [t[c].to_numpy() for c in ("k", "bucket", "tile_a", "tile_b")]
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        first = np.append(np.flatnonzero(new), len(fp))
        size = np.diff(first)
        out_a, out_b = [], []
        small = np.flatnonzero((size > 1) & (size <= 48))
        for n in np.unique(size[small]):  # tiles of one size together
            i, j = np.triu_indices(n, 1)
            for part in np.array_split(first[small[size[small] == n]], max(1, int((size[small] == n).sum() * len(i) >> 20))):
                a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                use = ~cross[a] | (side[a] != side[b])
                a, b = a[use], b[use]
                keep = _near(fp[a], fp[b], pivots, radius)
                if len(keep):
                    nodes, at = np.unique(np.concatenate([a[keep], b[keep]]), return_inverse=True)
                    root = _forest(len(nodes), at[: len(keep)], at[len(keep) :])
                    moved = np.flatnonzero(root != np.arange(len(nodes)))
                    out_a.append(node[nodes[moved]])
                    out_b.append(node[nodes[root[moved]]])
        for g in np.flatnonzero(size > 48):
            s, e = first[g], first[g + 1]
            root = _tile_links(fp[s:e], side[s:e], bool(cross[s]), pivots, radius)
            moved = np.flatnonzero(root != np.arange(e - s))
            out_a.append(node[s + moved])
            out_b.append(node[s + root[moved]])
        if out_a and sum(map(len, out_a)):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            last = [t[c][-1].as_py() for c in ("k", "bucket", "tile_a", "tile_b")] if t.num_rows else None
            if last is None:
                continue
            same = np.all([t[c].to_numpy() == v for c, v in zip(("k", "bucket", "tile_a", "tile_b"), last, strict=True)], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = t.slice(cut)
            if cut and (out := solve(t.slice(0, cut).combine_chunks())) is not None:
                yield out
        if rest is not None and rest.num_rows and (out := solve(rest.combine_chunks())) is not None:
            yield out

    return run


def near_links(points: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """points(node long, fp long), fps distinct -> links (a, b) that connect just what chains of near fingerprints connect."""
    masks = [_signed(m) for m in block_masks(radius, blocks or block_count(points.count(), radius))]
    reference = np.frombuffer(b"".join(xxhash.xxh64_digest(str(i).encode(), seed=i) for i in range(pivots)), np.uint64)
    keys = points.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "bucket"))
    counts = keys.groupBy("k", "bucket").count().where("count > 1")
    rows = keys.hint("merge").join(counts, ["k", "bucket"])
    slices = F.ceil(F.col("count") / tile).cast("int")
    rows = rows.withColumn("n", slices).withColumn("own", F.when(F.col("n") > 1, F.pmod(F.xxhash64("fp", "k"), F.col("n"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))))
    rows = rows.select("k", "bucket", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp")
    order = ["k", "bucket", "tile_a", "tile_b"]
    return rows.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(_links(reference, radius), "a long, b long")


def near_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links of at
    most ``radius`` differing bits, itself included. Null and empty texts have fingerprint zero and link like any other; texts of
    any length count whole; of equal fingerprints one is compared, whichever of them ties; repeated rows stay as rows; rows of a null doc_id are returned with a null component; an empty table gives none."""
    prints = write_table(fingerprints(docs, words), "fingerprints")
    points = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    found = components(near_links(points, radius))
    of = points.hint("merge").join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    of = checkpointed(of)
    return prints.hint("merge").join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest doc_id stays (one row, if that id repeats;
    rows of a null doc_id all stay). All columns of ``docs`` are returned."""
    keep = near_components(docs, words, radius).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.hint("merge").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
