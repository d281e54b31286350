"""Similarity of texts by their sets of character bigrams: joins of two tables, and near-duplicate classes of one over all media.
IDs are those of the survey."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_bigrams
from ..session import scratch_dir

MEDIA = "media_id"
#: Rows and bytes of text of one block of queries and of one slice of documents.
BLOCK, SLICE, BYTES = 1024, 2048, 32 << 20
#: Bytes of text of a timeline up to which one task compares its texts; those of longer ones are spread by their bigrams.
HELD = 1 << 20
#: MinHash bands of so many rows each: of two lines that are alike by 0.8, one in 1,300 is missed; by 0.5, one in eleven meets.
BANDS, ROWS = 50, 9
#: Words of 64 bits of a sketch, the lowest bits of as many MinHashes: alike lines differ in (1 - jaccard) / 2 of them.
SKETCH, SIGMAS = 4, 3.5
#: Rows of bands that a task holds at once.
PART = 1 << 20


def score_of(metric: str, shared: Column, q: Column, d: Column) -> Column:
    """[C9] jaccard, containment (shared / smaller) or coverage (shared / query) of set sizes."""
    return {"jaccard": shared / (q + d - shared), "containment": shared / F.least(q, d), "coverage": shared / q}[metric]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams of all rows as (row, bigram) in order; pairs of spaces go."""
    rows = [t or "" for t in texts.to_pylist()]
    code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(t) for t in rows])
    pair = (row[1:] == row[:-1]) & ~((code[1:] == 32) & (code[:-1] == 32))
    row, gram = row[:-1][pair], code[:-1][pair] << np.uint64(21) | code[1:][pair]
    names, gram = np.unique(gram, return_inverse=True)
    both = np.unique(row * np.uint64(max(1, len(names))) + gram.astype(np.uint64))
    return (both // np.uint64(max(1, len(names)))).astype(np.int64), names[(both % np.uint64(max(1, len(names)))).astype(np.int64)]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as a shuffle has. The number is given, as Spark would join parts of few bytes, however much work
    their rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Tokens:
    """The distinct bigrams of some texts, numbered: ``row`` and ``token`` of each, and how many there are of either. ``extra``: further
    tokens of each text. ``clauses``: line feeds part the clauses of a text, and no pair crosses them; pairs of spaces always go."""

    def __init__(self, texts: list[str | None], extra: list[list[str] | None] | None = None, clauses: bool = False) -> None:
        rows = [t or "" for t in texts]
        code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
        pair = (row[1:] == row[:-1]) & ~((code[1:] == 32) & (code[:-1] == 32))
        if clauses:
            pair &= (code[1:] != 10) & (code[:-1] != 10)
        row, gram = row[:-1][pair], code[:-1][pair] << 21 | code[1:][pair]
        of = [(i, x) for i, own in enumerate(extra or []) for x in own or []]
        if of:
            self.words = sorted({x for _, x in of})
            number = {x: k for k, x in enumerate(self.words)}
            row, gram = np.append(row, [i for i, _ in of]), np.append(gram, [-1 - number[x] for _, x in of])
        token, names = pd.factorize(gram)
        both = np.sort(pd.unique(row * max(1, len(names)) + token))
        self.row, self.token = both // max(1, len(names)), both % max(1, len(names))
        self.n, self.kinds, self.extra = len(rows), len(names), names < 0

    def split(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and tokens of the first ``at`` texts, and of the rest, numbered from 0."""
        k = int(np.searchsorted(self.row, at))
        return self.row[:k], self.token[:k], self.row[k:] - at, self.token[k:]


def within_media(a: DataFrame, b: DataFrame, fn: Callable, values: str, ids: tuple[str, str], spread: Callable[[DataFrame, DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """Pairs of rows of a and b, each (media_id, id, text, and what both have), of one timeline -> (media_id, ids..., values). A task
    gets timelines whole, one after the other, and fn(rows of a, rows of b) lists of columns from which it makes arrays (place in a, place in
    b, values...). So texts are shuffled, and no bigrams. Timelines of over ``most`` bytes of text (HELD) go to ``spread`` instead, which has the
    same pairs of any two tables. Pairs, and the rows of such timelines, are written once: whoever reads them several times shuffles no
    text again."""
    i, j = ids
    more = [c for c in a.columns if c not in (MEDIA, i)]
    side = lambda df, no, k: df.select(MEDIA, F.lit(k).alias("_cw_side"), *(F.col(no).alias(c) if no == own else F.lit(None).cast(t).alias(c) for c, own, t in (("_cw_a", i, a.schema[i].dataType), ("_cw_b", j, b.schema[j].dataType))), *more)
    rows = side(a, i, 0).unionByName(side(b, j, 1)).where(F.col(MEDIA).isNotNull())
    rows = dealt(rows, MEDIA).withColumn("_cw_bytes", F.sum(F.octet_length("text")).over(W.partitionBy(MEDIA)))
    rows = rows.withColumn("_cw_long", F.coalesce(F.col("_cw_bytes"), F.lit(0)) > (HELD if most is None else most)).drop("_cw_bytes")
    kinds = T.StructType([a.schema[MEDIA], T.StructField(i, a.schema[i].dataType), T.StructField(j, b.schema[j].dataType), *T._parse_datatype_string(values).fields])
    own = [f for f in rows.schema if f.name not in (MEDIA, "_cw_long")]
    both = T.StructType([T.StructField(f.name, f.dataType) for f in (*kinds, *own)])
    rows = rows.sortWithinPartitions(MEDIA, "_cw_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out, far, n = None, [], [], [], 0

        def pairs() -> None:
            nonlocal n
            left, right = ([list(c) for c in zip(*(r[3:] for r in own if r[0] == k), strict=True)] for k in (0, 1))
            if left and right:
                x, y, *got = fn(left, right)
                first, second = [r[1] for r in own if r[0] == 0], [r[2] for r in own if r[0] == 1]
                out.append([[key] * len(x), [first[k] for k in x.tolist()], [second[k] for k in y.tolist()], *got])
                n += len(x)

        def table(columns: list, at: int) -> Iterator[pa.RecordBatch]:
            made = [pa.array(columns[k - at], type=t) if at <= k < at + len(columns) else pa.nulls(len(columns[0]), t) for k, t in enumerate(arrow)]
            yield from pa.table(made, names=both.names).to_batches(1 << 14)

        def drained() -> Iterator[pa.RecordBatch]:
            nonlocal out, far, n
            made, out, passed, far, n = out, [], far, [], 0
            whole = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*made, strict=True)]
            if whole:
                yield from table(whole, 0)
            if passed:  # the key stands in front of the pairs' columns
                media, *columns = (list(c) for c in zip(*passed, strict=True))
                for b in table(columns, len(kinds)):
                    yield b.set_column(0, MEDIA, pa.array(media[: b.num_rows], type=arrow[0]))
                    del media[: b.num_rows]

        for batch in batches:
            for media, *row, is_long in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_long:
                    far.append([media, *row])
                    if len(far) >= 1 << 10:
                        yield from drained()
                    continue
                if media != key:
                    if own:
                        pairs()
                    key, own = media, []
                    if n >= 1 << 16:
                        yield from drained()
                own.append(row)
        if own:
            pairs()
        yield from drained()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in both]
    got = written(rows.mapInArrow(run, both))
    far = got.where(F.col("_cw_side").isNotNull())
    far = spread(*(far.where(F.col("_cw_side") == k).select(MEDIA, F.col(c).alias(no), *more) for k, c, no in ((0, "_cw_a", i), (1, "_cw_b", j))))
    return got.where(F.col("_cw_side").isNull()).select(*kinds.names).unionByName(far)


def _shared(metric: str, at_least: float) -> Callable:
    def fn(a: list, b: list) -> list[np.ndarray]:
        both = Tokens(a[0] + b[0])
        row_a, token_a, row_b, token_b = both.split(len(a[0]))
        n, m = np.bincount(row_a, minlength=len(a[0])), np.bincount(row_b, minlength=len(b[0]))
        first = np.searchsorted(row_a, np.arange(len(a[0]) + 1))
        has, out = np.zeros(both.kinds, bool), []
        for k in range(len(n)):
            own = token_a[first[k] : first[k + 1]]
            has[own] = True
            shared = np.bincount(row_b[has[token_b]], minlength=len(m))
            has[own] = False
            below = {"jaccard": n[k] + m - shared, "containment": np.minimum(n[k], m), "coverage": np.full(len(m), n[k])}[metric]
            j = np.flatnonzero((shared > 0) & (shared / np.maximum(below, 1) >= at_least))
            out.append(np.stack([np.full(len(j), k), j, shared[j], n[k] + 0 * j, m[j]]))
        return list(np.concatenate(out, axis=1))

    return fn


def media_bigrams(queries: DataFrame, docs: DataFrame, metric: str, at_least: float, q_id: str, d_id: str, spread: Callable) -> DataFrame:
    """[C9] As bigram_join, for texts of one timeline."""
    q, d = queries.select(MEDIA, F.col(q_id).alias("_cw_q"), "text"), docs.select(MEDIA, F.col(d_id).alias("_cw_d"), "text")
    found = lambda x, y: spread(x, y).select(MEDIA, "_cw_q", "_cw_d", "shared", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), "score")
    fn = _shared(metric, at_least)

    def scored(a: list, b: list) -> list[np.ndarray]:
        x, y, shared, n, m = fn(a, b)
        return [x, y, shared, n, m, shared / {"jaccard": n + m - shared, "containment": np.minimum(n, m), "coverage": n}[metric]]

    got = within_media(q, d, scored, "shared long, n long, m long, score double", ("_cw_q", "_cw_d"), found)
    return got.select(MEDIA, F.col("_cw_q").alias(q_id), F.col("_cw_d").alias(d_id), "shared", "score")


def _deal(df: DataFrame, rows: int, key: str, name: str) -> tuple[DataFrame, int]:
    """Rows dealt by a hash to parts of about ``rows`` rows and BYTES bytes."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // rows), -(-(size or 0) // BYTES))
    return df.withColumn(name, F.pmod(F.xxhash64(key, "text"), F.lit(parts)).cast("int")), parts


def block_join(queries: DataFrame, docs: DataFrame, metric: str = "jaccard", at_least: float = 0.0, q_id: str = "q_id", d_id: str = "d_id") -> DataFrame:
    """[C9] As bigram_join, for thresholds that most pairs reach: every block of queries meets every slice of documents, and a task
    counts shared bigrams as sums of rows of an incidence table. Only texts are shuffled, no bigrams. Blocks and slices are bounded;
    a single text over BYTES has one to itself."""
    q, blocks = _deal(queries.select(F.col(q_id).alias("q"), "text"), BLOCK, "q", "block")
    d, slices = _deal(docs.select(F.col(d_id).alias("d"), "text"), SLICE, "d", "slice")
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select(*[F.col(c).alias(c) for c in d.columns])  # both sides may come of one table

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        row_q, gram_q = _grams(left["text"].combine_chunks())
        names = np.unique(gram_q)
        has = np.zeros((len(names), left.num_rows), np.uint8)
        has[np.searchsorted(names, gram_q), row_q] = 1
        size_q = np.bincount(row_q, minlength=left.num_rows)
        row_d, gram_d = _grams(right["text"].combine_chunks())
        size_d = np.bincount(row_d, minlength=right.num_rows)
        at = np.searchsorted(names, gram_d)
        known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == gram_d) if len(names) else np.zeros(len(at), bool)
        row_d, at = row_d[known], at[known]
        first = np.searchsorted(row_d, np.arange(right.num_rows + 1))
        found = []
        for i in np.flatnonzero(np.diff(first)).tolist():
            shared = has[at[first[i] : first[i + 1]]].sum(axis=0, dtype=np.int64)
            below = {"jaccard": size_q + size_d[i] - shared, "containment": np.minimum(size_q, size_d[i]), "coverage": size_q}[metric]
            j = np.flatnonzero((shared > 0) & (shared / np.maximum(below, 1) >= at_least))
            found.append(np.stack([j, np.full(len(j), i), shared[j], size_q[j], np.full(len(j), size_d[i])]))
        a = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        return pa.table([left["q"].take(pa.array(a[0])), right["d"].take(pa.array(a[1])), *(pa.array(x) for x in a[2:])], ["q", "d", "shared", "n", "m"])

    schema = T.StructType([T.StructField("q", queries.schema[q_id].dataType), T.StructField("d", docs.schema[d_id].dataType), *[T.StructField(c, T.LongType()) for c in ("shared", "n", "m")]])
    pairs = q.groupBy("block", "slice").cogroup(d.groupBy("block", "slice")).applyInArrow(count, schema)
    return pairs.select(F.col("q").alias(q_id), F.col("d").alias(d_id), "shared", score_of(metric, F.col("shared"), F.col("n"), F.col("m")).alias("score"))


def prefix_join(queries: DataFrame, docs: DataFrame, metric: str = "jaccard", at_least: float = 0.5, q_id: str = "q_id", d_id: str = "d_id", on: list[str] = ()) -> DataFrame:
    """[C9] As bigram_join, for thresholds that few pairs reach: sets are sorted by how many texts have a bigram, rarest first, and only
    the first ones are looked up: of n bigrams, a pair that shares k shares one of the first n - k + 1. Pairs that the place of a
    common bigram rules out go at once, the rest are counted whole."""
    on = list(on)
    q = queries.select(*on, F.col(q_id).alias("q"), char_bigrams("text").alias("g"))
    d = docs.select(*on, F.col(d_id).alias("d"), char_bigrams("text").alias("h"))
    often = q.select(*on, F.explode("g").alias("gram")).unionByName(d.select(*on, F.explode("h").alias("gram"))).groupBy(*on, "gram").agg(F.count("*").alias("df"))

    def placed(side: DataFrame, who: str, grams: str, n: str, place: str) -> DataFrame:
        rows = side.select(*on, who, F.size(grams).alias(n), F.explode(grams).alias("gram")).hint("merge").join(often, [*on, "gram"])
        sets = rows.groupBy(*on, who, n).agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("s"))
        least = F.ceil(F.lit(at_least) * F.col(n) - 1e-9)
        first = F.col(n) - least + 1 if metric == "jaccard" or (metric == "coverage" and who == "q") else F.col(n)
        return sets.select(*on, who, n, F.posexplode(F.slice("s", F.lit(1), first.cast("int"))).alias(place, "x")).select(*on, who, n, place, F.col("x.gram").alias("gram"))

    a, b = placed(q, "q", "g", "n", "i"), placed(d, "d", "h", "m", "j")
    n, m = F.col("n"), F.col("m")
    pairs = a.hint("merge").join(b, [*on, "gram"])
    if metric == "containment":  # the smaller set's first ones are looked up among all of the larger's
        pairs = pairs.where(F.when(n <= m, F.col("i") <= n - F.ceil(at_least * n - 1e-9)).otherwise(F.col("j") <= m - F.ceil(at_least * m - 1e-9)))
    least = {"jaccard": F.ceil(at_least / (1 + at_least) * (n + m) - 1e-9), "containment": F.ceil(at_least * F.least(n, m) - 1e-9), "coverage": F.ceil(at_least * n - 1e-9)}[metric]
    most = F.least("i", "j") + 1 + F.least(n - F.col("i"), m - F.col("j")) - 1
    pairs = pairs.where(most >= least).select(*on, "q", "d").distinct()
    full = pairs.hint("merge").join(q, [*on, "q"]).hint("merge").join(d, [*on, "d"])
    full = full.select(*on, "q", "d", F.size("g").cast("long").alias("n"), F.size("h").cast("long").alias("m"), F.size(F.array_intersect("g", "h")).cast("long").alias("shared")).distinct()
    score = score_of(metric, F.col("shared"), F.col("n"), F.col("m"))
    return full.select(*on, F.col("q").alias(q_id), F.col("d").alias(d_id), "shared", score.alias("score")).where(F.col("score") >= at_least)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder: iterations start from it, and a lost executor costs a reread."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def classes(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of longs -> (node, class): the smallest node that links lead to. Every round hangs a node's larger neighbours, then all of
    its neighbours, on the smallest of them, until nothing moves. Nodes without a link do not appear."""
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = written(both.hint("merge").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.hint("merge").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("class"))
        seen = now
    raise RuntimeError("classes did not settle")


SKETCHED = [f"s{k}" for k in range(SKETCH)]


def _limit(jaccard: float) -> float:
    """In how many bits the sketches of alike lines may differ."""
    share, n = (1 - jaccard) / 2, 64 * SKETCH
    return share * n + SIGMAS * (n * share * (1 - share)) ** 0.5


def _signed(bands: int, rows: int):
    """(node, text) -> a row (bucket, node, n, sketch) for each band of the MinHash signature of the text's n bigrams. Texts without a
    bigram have none."""
    rng, size = np.random.default_rng(17), max(bands * rows, 64 * SKETCH)
    mul, add = (rng.integers(1, 2**63, (1, size), dtype=np.uint64) | np.uint64(1)), rng.integers(0, 2**63, (1, size), dtype=np.uint64)
    fold = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                row, gram = _grams(part.column(1))
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = np.flatnonzero(np.diff(first))
                if not len(own):
                    continue
                gram = (gram + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)
                keys, bits = np.empty((len(own), bands), np.uint64), np.empty((len(own), 64 * SKETCH), np.uint8)
                for k, i in enumerate(own.tolist()):
                    h = gram[first[i] : first[i + 1], None] * mul + add
                    least = (h ^ (h >> np.uint64(32))).min(axis=0)
                    bits[k] = least[: 64 * SKETCH] & np.uint64(1)
                    keys[k] = (least[: bands * rows].reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                columns = [part.column(0).to_numpy()[own], np.diff(first)[own].astype(np.int32), *sketch.T]
                node, n, *sketch = (np.repeat(c, bands) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.view(np.int64).ravel(), node, n, *sketch)], ["bucket", "node", "n", *SKETCHED])

    return run


def _rows_of(batches: Iterator[pa.RecordBatch], also: str | None = None, places: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All rows of a part that share a bucket with another one, in order of (bucket, n, node) -> [bucket, node, n(, also)(, place)], sketches, and
    where the buckets begin and end. ``also``: a column of which a bucket must have two values. ``places``: where each row was."""
    cols = ["bucket", "node", "n", *([also] if also else []), *SKETCHED]
    held = [[b.column(b.schema.get_field_index(c)).to_numpy() for c in cols] for b in batches if b.num_rows]
    got = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64) for _ in cols]
    if places:
        got.insert(-len(SKETCHED), np.arange(len(got[0])))
    of, k = np.unique(got[0], return_inverse=True, return_counts=True)[1:]
    keep = np.flatnonzero(k[of] > 1)
    got = [c[keep] for c in got]
    order = np.lexsort((got[1], got[2], got[0]))
    got = [c[order] for c in got]
    edges = np.flatnonzero(np.diff(got[0], prepend=got[0][:1] - 1, append=got[0][-1:] + 1)) if len(order) else np.zeros(1, int)
    if also and len(order):
        mixed = np.minimum.reduceat(got[3], edges[:-1]) != np.maximum.reduceat(got[3], edges[:-1])
        keep = np.repeat(mixed, np.diff(edges))
        got, edges = [c[keep] for c in got], np.append(0, np.cumsum(np.diff(edges)[mixed]))
    return got[: -len(SKETCHED)], np.stack(got[-len(SKETCHED) :], axis=1).view(np.uint64), edges


def _near(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= limit


def _slabs(n: np.ndarray, of: np.ndarray, jaccard: float) -> Iterator[tuple[slice, slice]]:
    """Rows ``of`` sizes, some at a time, and the rows of sizes ``n`` that may be alike to one of them; both are in order of size."""
    s = 0
    while s < len(of):
        lo = np.searchsorted(n, jaccard * of[s] - 1e-9)
        e = min(len(of), s + max(1, (1 << 18) // max(1, int(np.searchsorted(n, of[s] / jaccard + 1e-9, "right") - lo))))
        yield slice(s, e), slice(lo, np.searchsorted(n, of[e - 1] / jaccard + 1e-9, "right"))
        s = e


def _firsts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs the first y of each x, and whoever is in another pair."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    one = np.diff(x, prepend=-1) != 0
    return x[one], y[one], np.concatenate([x[~one], y[~one]])


def _starred(n: np.ndarray, sketch: np.ndarray, jaccard: float, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows in order of size: pairs of a row and one that is near it, so that every row with a near one has a pair, and
    rows that are near others besides. Rows near a leader leave the rest, so a bucket of many copies costs few comparisons a row."""
    whose, leader, more = [], [], np.zeros(len(n), bool)
    active, size, own = np.arange(len(n)), n, sketch
    while len(active) > 1:
        stop = int(np.searchsorted(size, size[0] / jaccard + 1e-9, "right"))
        near = np.flatnonzero(_near(own[1:stop], own[0], limit)) + 1
        if len(near):
            whose.append(active[near])
            leader.append(np.full(len(near), active[0]))
            more[active[near]] |= len(near) > 1
            rest = np.delete(np.arange(1, len(active)), near - 1)
            for some, others in _slabs(size[rest], size[near], jaccard):
                i, j = np.nonzero(_near(own[near[some], None], own[rest[others]], limit))
                more[active[near[some][i]]] = more[active[rest[others][j]]] = True
            active, size, own = active[rest], size[rest], own[rest]
        else:
            active, size, own = active[1:], size[1:], own[1:]
    none = np.zeros(0, int)
    return np.concatenate([none, *whose]), np.concatenate([none, *leader]), more


#: Buckets of up to so many rows are compared all at once; those of up to so many one by one, each with all; larger ones from leaders on.
SMALL, MIDDLE = 16, 256
MET = "a long, b long, bucket long, node long, n int, " + ", ".join(f"{c} long" for c in SKETCHED)


def _met(jaccard: float):
    """Rows of _signed, a part of the buckets -> pairs (a, b) of near nodes, and rows of nodes that are near others of their bucket besides."""
    limit = _limit(jaccard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bucket, node, n), sketch, edges = _rows_of(batches)
        size, more = np.diff(edges), np.zeros(len(n), bool)
        left = np.repeat(edges[1:], size) - np.arange(len(n))  # rows from here to the end of the bucket
        at, pairs = np.flatnonzero(np.repeat(size <= SMALL, size)), []
        for d in range(1, SMALL):
            at = at[left[at] > d]
            at = at[n[at] >= jaccard * n[at + d] - 1e-9]
            near = at[_near(sketch[at], sketch[at + d], limit)]
            pairs.append(np.stack([near + d, near]))
        x, y, besides = _firsts(*np.concatenate(pairs, axis=1))
        more[besides] = True
        a, b = [x], [y]
        for s, e in zip(edges[:-1][size > SMALL].tolist(), edges[1:][size > SMALL].tolist(), strict=True):
            if e - s <= MIDDLE:
                pairs = [np.zeros((2, 0), int)]
                for some, others in _slabs(n[s:e], n[s:e], jaccard):
                    i, j = np.nonzero(_near(sketch[s:e][some, None], sketch[s:e][others], limit))
                    pairs.append(np.stack([i + some.start, j + others.start]))
                i, j = np.concatenate(pairs, axis=1)
                x, y, besides = _firsts(i[j < i], j[j < i])
                more[s + besides] = True
            else:
                x, y, more[s:e] = _starred(n[s:e], sketch[s:e], jaccard, limit)
            a.append(s + x)
            b.append(s + y)
        a, b, more = node[np.concatenate(a)], node[np.concatenate(b)], np.flatnonzero(more)
        none, nil = pa.nulls(len(a), pa.int64()), pa.nulls(len(more), pa.int64())
        names = ["a", "b", "bucket", "node", "n", *SKETCHED]
        table = pa.table([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.int32()), *[none] * SKETCH], names)
        rows = pa.table([nil, nil, pa.array(bucket[more]), pa.array(node[more]), pa.array(n[more], pa.int32()), *(pa.array(c) for c in sketch[more].view(np.int64).T)], names)
        yield from pa.concat_tables([table, rows]).to_batches(1 << 14)

    return run


def _others(of: np.ndarray, n: np.ndarray, sketch: np.ndarray, jaccard: float, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a bucket's rows in order of size: near pairs of different classes ``of``, some at a time. Rows of its largest class meet only the rest."""
    kind, k = np.unique(of, return_inverse=True, return_counts=True)[1:]
    main = kind == k.argmax()
    odd = np.flatnonzero(~main)
    for some, others in _slabs(n, n[odd], jaccard):
        own = odd[some]
        here = _near(sketch[own][:, None], sketch[others], limit) & (kind[own][:, None] != kind[others])
        i, j = np.nonzero(here & (main[others] | (np.arange(others.start, others.stop) < own[:, None])))
        if len(i):
            yield own[i], others.start + j


DOUBTED = "bucket long, node long, n int, class long, " + ", ".join(f"{c} long" for c in SKETCHED)


def _doubted(jaccard: float):
    """Rows (DOUBTED), a part of the buckets -> those near one of another class in their bucket."""
    limit = _limit(jaccard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bucket, node, n, of), sketch, edges = _rows_of(batches, "class")
        keep = np.zeros(len(n), bool)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i, j in _others(of[s:e], n[s:e], sketch[s:e], jaccard, limit):
                keep[s + i] = keep[s + j] = True
        got = [pa.array(c[keep], k) for c, k in zip((bucket, node, n, of), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
        yield from pa.table([*got, *(pa.array(c) for c in sketch[keep].view(np.int64).T)], ["bucket", "node", "n", "class", *SKETCHED]).to_batches(1 << 14)

    return run


def _reach(both: np.ndarray, n: np.ndarray, m: np.ndarray, jaccard: float) -> np.ndarray:
    return (both > 0) & (both >= jaccard * (n + m - both))


def _common(gram: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bigrams texts i and j have in common, pair by pair, as sets of bits; those of text k are ``gram[first[k] : first[k + 1]]``."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n = first[rows + 1] - first[rows]
    ends, bits = np.cumsum(n), []
    token = np.unique(gram[np.arange(n.sum()) + np.repeat(first[rows] - ends + n, n)], return_inverse=True)[1]
    for s in range(0, len(rows), 4096):
        own, begin = n[s : s + 4096], int(ends[s] - n[s])
        has = np.zeros((len(own), -(-(int(token.max()) + 1) // 64) * 64), bool)
        has[np.repeat(np.arange(len(own)), own), token[begin : begin + int(own.sum())]] = True
        bits.append(np.packbits(has, axis=1).view(np.uint64))
    bits, x, y = np.concatenate(bits), at[: len(i)], at[len(i) :]
    some = max(1, (1 << 20) // bits.shape[1])
    return np.concatenate([np.bitwise_count(bits[x[s : s + some]] & bits[y[s : s + some]]).sum(axis=1, dtype=np.int64) for s in range(0, len(x), some)])


def _linked(jaccard: float):
    """Rows (DOUBTED, text), a part of the buckets -> pairs of alike nodes of different classes in one bucket, by all their bigrams."""
    limit = _limit(jaccard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        (_, node, n, of, at), sketch, edges = _rows_of(iter(batches), "class", places=True)
        text = pa.chunked_array([b.column(b.schema.get_field_index("text")) for b in batches], pa.string())
        own, place = np.unique(node, return_index=True, return_inverse=True)[1:]  # a node is in many buckets
        grams = [_grams(text.take(pa.array(at[own[s : s + 1024]])).combine_chunks()) for s in range(0, len(own), 1024)]
        gram, first = np.concatenate([np.zeros(0, np.uint64), *(g for _, g in grams)]), np.append(0, np.cumsum(n[own], dtype=np.int64))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def alike(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            ok = _reach(_common(gram, first, place[i], place[j]), n[i].astype(np.int64), n[j].astype(np.int64), jaccard)
            return pa.RecordBatch.from_arrays([pa.array(node[i[ok]]), pa.array(node[j[ok]])], ["a", "b"])

        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i, j in _others(of[s:e], n[s:e], sketch[s:e], jaccard, limit):
                held.append((s + i, s + j))
                if sum(len(x) for x, _ in held) >= 1 << 15:
                    yield alike(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
        if held:
            yield alike(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _alike(pairs: DataFrame, texts: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts are alike, by all their bigrams."""
    d = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    d = d.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                (row, gram), (row_y, gram_y) = _grams(batch.column(2)), _grams(batch.column(3))
                n, m = (np.bincount(r, minlength=batch.num_rows) for r in (row, row_y))
                key, key_y = (r.astype(np.uint64) << np.uint64(42) | g for r, g in ((row, gram), (row_y, gram_y)))
                both = np.bincount(row[np.isin(key, key_y, assume_unique=True)], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(list(batch.select(["a", "b"]).filter(pa.array(_reach(both, n, m, jaccard))).columns), ["a", "b"])

    return d.mapInArrow(run, "a long, b long")


def near_lines(lines: DataFrame, jaccard: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """[I17] lines(media_id, line_no, text), of all media -> (media_id, line_no, first_media, first_line, n_lines): the class of lines that
    chains of alike ones connect, by its first line, and how many lines it has. Lines without a bigram are their own class.

    Equal texts are one node. Candidates share a band of their MinHash signature, have sketches as close as alike lines have them, and
    are compared by all bigrams: first every node with the one that it shares most bands with; then what lies in another class and is
    close to it in a bucket. So a class of many costs a comparison a member, and pairs in one class are never listed. A band is a row of two
    numbers, the size and the sketch, and is shuffled once; buckets are compared where they arrive, and only rows with several close ones go on."""
    lines = lines.select(MEDIA, "line_no", "text").where("text is not null")
    node = F.xxhash64("text")
    texts = written(lines.select(node.alias("node"), "text").groupBy("node").agg(F.min("text").alias("text")))
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * bands // PART))
    signed = texts.mapInArrow(_signed(bands, rows), "bucket long, node long, n int, " + ", ".join(f"{c} long" for c in SKETCHED))
    met = written(signed.repartition(parts, "bucket").mapInArrow(_met(jaccard), MET))
    pairs = met.where("bucket is null").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = written(pairs.withColumn("best", F.row_number().over(W.partitionBy("a").orderBy(F.desc("k"), "b")) == 1).select("a", "b", "best"))
    several = met.where("bucket is not null").select("bucket", "node", "n", *SKETCHED)
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(several.select("node")).distinct()
    texts = written(texts.hint("merge").join(some, "node", "left_semi"))
    links = written(_alike(pairs.where("best").select("a", "b"), texts, jaccard))
    found = classes(links)
    known = lambda df, no, name: df.hint("merge").join(found.select(F.col("node").alias(no), F.col("class").alias(name)), no, "left").withColumn(name, F.coalesce(name, no))
    rest = known(known(pairs.where("not best"), "a", "of"), "b", "class").where("of <> class").select("a", "b")
    doubted = known(several, "node", "class").select("bucket", "node", "n", "class", *SKETCHED)
    doubted = written(doubted.repartition(parts, "bucket").mapInArrow(_doubted(jaccard), DOUBTED))
    few = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-doubted.count() // (PART >> 4)))
    doubted = doubted.hint("merge").join(texts, "node").select("bucket", "node", "n", "class", *SKETCHED, "text")
    more = written(_alike(rest, texts, jaccard).unionByName(doubted.repartition(few, "bucket").mapInArrow(_linked(jaccard), "a long, b long")).distinct())
    if not more.isEmpty():
        found = classes(links.unionByName(more))
    d = lines.withColumn("node", node).select(MEDIA, "line_no", "node").hint("merge").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    d = written(d.select(MEDIA, "line_no", "class"))
    first = d.groupBy("class").agg(F.min(F.struct(MEDIA, "line_no")).alias("f"), F.count("*").alias("n_lines"))
    return d.hint("merge").join(first, "class").select(MEDIA, "line_no", F.col(f"f.{MEDIA}").alias("first_media"), F.col("f.line_no").alias("first_line"), "n_lines")
