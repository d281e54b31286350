"""Sharding by a k-d tree: every node is split at a distributed weighted median along its widest metadata dimension.

The tree is built over groups (rows that must stay together, such as equal texts), summed up first: one row a group, however many
rows it has. A level of the tree sorts the groups of its nodes by (node, widest dimension, other dimensions) over ranges, sums each
range, and reads the one range in which a node's mark lies for the group to cut at. Cuts travel to the groups as a table with a row
for each node. Only numbers leave the metadata table, never texts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unused, write_table

LOWEST = -(1 << 63)


def _ordered() -> Column:
    """What the groups of a node are compared by: its widest dimension, then all."""
    return F.concat(F.array(F.element_at("keys", F.col("dim") + 1)), "keys")


def _cuts(table: DataFrame, nodes: dict[int, tuple[int, int]]) -> list[tuple[int, int, list[int], bool]]:
    """table(node, keys, weight), nodes: node -> (number of its widest dimension, bytes wanted on the left) -> (node, dimension,
    keys of the group to cut at, whether that group itself goes left), a row for each node."""
    spark = table.sparkSession
    plan = spark.createDataFrame([(n, d) for n, (d, _) in nodes.items()], "node int, dim int").hint("broadcast")
    rows = table.join(plan, "node").select("node", _ordered().alias("o"), "weight")
    rows = rows.repartitionByRange("node", "o").sortWithinPartitions("node", "o")
    rows = write_table(rows.withColumn("part", F.spark_partition_id()), "ranges")
    sums: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}
    for r in sorted(rows.groupBy("node", "part").agg(F.sum("weight").alias("w")).collect()):  # ranges and nodes, once each
        sums[r["node"]].append((r["part"], r["w"]))
    found = []
    for n, (_, want) in nodes.items():
        ends = list(accumulate(w for _, w in sums[n]))
        k = next(i for i, e in enumerate(ends) if e >= want)
        found.append((n, sums[n][k][0], ends[k] - sums[n][k][1], want))
    place = spark.createDataFrame(found, "node int, part int, before long, want long").hint("broadcast")
    near = rows.where(F.col("part").isin(sorted({p for _, p, _, _ in found}))).join(place, ["node", "part"])
    near = near.withColumn("end", F.col("before") + F.sum("weight").over(W.partitionBy("node").orderBy("o").rowsBetween(W.unboundedPreceding, 0)))
    near = near.where("end >= want").groupBy("node").agg(F.min(F.struct("end", "o", "weight")).alias("m"))
    out = []
    for r in near.collect():  # a row for each node
        m, want = r["m"], nodes[r["node"]][1]
        out.append((r["node"], nodes[r["node"]][0], list(m["o"]), m["end"] - want <= want - (m["end"] - m["weight"])))
    return out


def assign(rows: DataFrame, shards: int, dims: list[str], group: list[str], weight: str = "size") -> DataFrame:
    """All columns of ``rows`` and shard (replaced where it exists): 0 to shards - 1, of nearly equal weight.

    ``dims`` are columns of whole numbers, the metadata; ``group`` columns of whole numbers (such as two hashes of a text) that
    rows which must stay together share. A group stands where its least metadata stand, and no group is ever cut: a shard differs
    from its share of the weight by at most half of the heaviest group a level of the tree, and a group of more than a share has
    a shard nearly to itself. Nulls count as the lowest number; ties in one dimension are broken by the others, then by the
    group; repeated rows are one group; an empty table gives none. ``shards`` may be any number: a node of m shards gives its
    left side floor(m / 2) of them. No text is read, so texts may have any length."""
    rows = rows.drop("shard")
    key = [F.coalesce(F.col(c).cast("long"), F.lit(LOWEST)) for c in group]
    low = [F.min(F.coalesce(F.col(c).cast("long"), F.lit(LOWEST))) for c in dims]
    names = [f"g{i}" for i in range(len(group))]
    summed = rows.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(F.sum(weight).cast("long").alias("weight"), F.array(*low).alias("low"))
    groups = write_table(summed.select(*names, F.concat("low", F.array(*names)).alias("keys"), "weight"), "groups")
    table = groups.withColumn("node", F.lit(0))
    spread = [(F.max(F.element_at("keys", i + 1)).cast("double") - F.min(F.element_at("keys", i + 1))).alias(f"d{i}") for i in range(len(dims))]
    whole, open_ = None, {0: shards}
    while any(m > 1 for m in open_.values()):
        split = {n: m for n, m in open_.items() if m > 1}
        stats = table.where(F.col("node").isin(list(split))).groupBy("node").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *spread)
        nodes = {}
        for r in stats.collect():  # a row for each node
            whole = whole or [r[f"d{i}"] or 1.0 for i in range(len(dims))]
            width = [r[f"d{i}"] / whole[i] for i in range(len(dims))]
            if r["n"] > 1:
                nodes[r["node"]] = (max(range(len(dims)), key=lambda i, width=width: width[i]), r["w"] * (split[r["node"]] // 2) // split[r["node"]])
        move = [(n, split[n] // 2) for n in nodes]
        if nodes:
            cuts = [(n, d, o, left, dict(move)[n]) for n, d, o, left in _cuts(table, nodes)]
            cuts = groups.sparkSession.createDataFrame(cuts, "node int, dim int, cut array<long>, left boolean, move int").hint("broadcast")
            table = table.join(cuts, "node", "left").withColumn("o", _ordered())
            right = (F.col("o") > F.col("cut")) | ((F.col("o") == F.col("cut")) & ~F.col("left"))
            table = table.select(*groups.columns, F.when(right, F.col("node") + F.col("move")).otherwise(F.col("node")).alias("node"))
        open_ = {**{n: m for n, m in open_.items() if m == 1}, **{n: m // 2 for n, m in split.items()}, **{n + m // 2: m - m // 2 for n, m in split.items()}}
    temp = unused([*rows.columns, "shard"], *names)
    of = write_table(table.select(*[F.col(n).alias(t) for n, t in zip(names, temp, strict=True)], F.col("node").cast("int").alias("shard")), "shards")
    keyed = rows.select("*", *[k.alias(t) for k, t in zip(key, temp, strict=True)])
    return keyed.hint("merge").join(of, temp).select(*rows.columns, "shard")


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """All columns of ``rows`` and slot (replaced where it exists): its place within its shard, from 0 without gaps, by ``order``.
    Rows are dealt by ranges of (shard, order), numbered where they lie, and shifted by the counts of earlier ranges."""
    rows = rows.drop("slot")
    at, part, first, before = unused([*rows.columns, "slot"], "at", "part", "first", "before")
    dealt = rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    dealt = write_table(dealt.withColumn(at, F.monotonically_increasing_id()), "slots").withColumn(part, F.shiftright(at, 33))
    counts = dealt.groupBy(part, "shard").agg(F.min(at).alias(first), F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("shard").orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(part, "shard", first, F.coalesce(earlier, F.lit(0)).alias(before))  # a row for each task and shard in it
    out = dealt.join(F.broadcast(counts), [part, "shard"])
    return out.select(*rows.columns, (F.col(at) - F.col(first) + F.col(before)).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [F.crc32(F.col(c).cast("binary")).alias(c) for c in ("lang", "source")]
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *names, F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.xxhash64(text).alias("same"), F.xxhash64(F.lit(1), text).alias("same_too"))
    out = slots(assign(rows, 8, ["source", "lang", "chars"], ["same", "same_too"]), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
