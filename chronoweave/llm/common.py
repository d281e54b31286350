"""What the operators of this subpackage share: scratch tables, word splitting and hashing over Arrow buffers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of every word rule here.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Odd multipliers for polynomial hashes modulo 2**64.
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local master (tests on one machine) gets a temporary folder and a
    cluster an error, as its machines share none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not (folder := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Bytes of an Arrow batch that a Python worker gets; Spark's own bound is 64 MB, held several times over in a task.
BATCH_BYTES = 8 << 20


def bounded_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with Arrow batches of BATCH_BYTES at most, where the session keeps Spark's own larger bound."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(key) == "67108864b":
            spark.conf.set(key, f"{BATCH_BYTES}b")
        return query(spark, sf_dir)

    return run


#: What empties the tables that operators keep in a Python worker between tasks, by operator.
HELD: dict[str, Callable[[], None]] = {}


def make_room(operator: str = "") -> None:
    """Called by a task of ``operator`` when it starts: a worker serves stage after stage, and what other operators have kept in
    it would stay beside this one's data."""
    for name, empty in HELD.items():
        if name != operator:
            empty()


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for small tables of an iteration; Spark cleans those up."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes, one row at least, so that temporaries stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the number of words before it (one more than rows)."""
    inside = ~IS_SPACE[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of the input."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Words of more bytes are hashed by XXH3: long words of two letters only can be equal under every polynomial modulo 2**64.
LONG = 24
#: A second odd multiplier, for a hash that does not depend on the first.
SECOND = 0xA24BAED4963EE407


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word: of short ones from prefix sums of a polynomial over their bytes, worked in pieces, so that
    temporaries stay small however long the text is; of long ones by XXH3, seeded by ``base``. Another base, another hash."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, "right")))
        lo, n = starts[at], int(ends[stop - 1] - starts[at])
        size = 1 << max(10, (n - 1).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * _powers(base, size)[:n], out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix((sums[e] - sums[s]) * _powers(pow(base, -1, 1 << 64), size)[s] + (e - s).astype(np.uint64))
        at = stop
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), base)
    return out


class WordNames(dict):
    """XXH3 hashes of words; those of the first ``KEPT`` different words are kept, so the table is bounded."""

    KEPT, PIECE = 200_000, 1 << 20

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEPT and len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words, in order; a long text is worked in pieces that end between words."""
        out, at = [], 0
        while at < len(text):
            end = at + self.PIECE
            while end < len(text) and text[end] not in SPACES:
                end += 1
            words = (text if end >= len(text) and not at else text[at:end]).split()
            out.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of symbols h[start:end], from prefix sums."""
    size = 1 << max(10, (len(h)).bit_length())
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(GRAM_BASE, size)[: len(h)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(pow(GRAM_BASE, -1, 1 << 64), size)[starts] + (ends - starts).astype(np.uint64))


def unused(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that a table with ``columns`` does not have (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n symbols (len(h) - n + 1 of them, rows ignored)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[n - 1 :].copy()
    for k in range(n - 2, -1, -1):
        out = out * np.uint64(GRAM_BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: edges(a, b) of longs -> (node, component), the smallest
    node reachable. Nodes without an edge are not returned. Each round is a partial minimum and a join on the node; the minima
    are written and read back, so that the join shuffles both sides itself and can split the edges of a hub."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = checkpointed(e), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        e = both.hint("merge").join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = write_table(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = e.hint("merge").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
