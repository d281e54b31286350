"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard.

The table that ``write`` makes has a row for each chunk (whole documents, at least ``CHUNK`` ids unless it is a part's last),
which holds its blocks' planes and its index: the documents' ids and lengths, and the place of its first id within the part.
Parts follow one another in ascending doc_id order.  Parquet is only the container, so any store that Spark reaches works.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import words_of
from .common import buffers, shared_dir, spans

BLOCK, CHUNK, LEVEL = 1 << 16, 1 << 20, 1
FORMAT = "part int, chunk int, first long, n_ids long, kind string, block int, doc_ids array<long>, lengths array<long>, planes array<array<binary>>"
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.list_(pa.binary())))])


def to_planes(ids: np.ndarray, kind: str, level: int = LEVEL) -> list[bytes]:
    """One block of unsigned 32-bit ids -> its compressed planes, lowest first (4 of bytes or 32 of bits)."""
    parts = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "bit":
        parts = np.concatenate([np.packbits((p[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) for p in parts])
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(p.tobytes()) for p in parts]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block of n ids."""
    un = zstandard.ZstdDecompressor()
    width = n if kind == "byte" else (n + 7) // 8
    parts = [np.frombuffer(un.decompress(p, max_output_size=max(width, 1)), np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(p)[:n] for p in parts]).reshape(4, 8, n)
        parts = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(np.stack(parts).T).reshape(-1).view("<u4")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, kind: str = "byte", block: int = BLOCK, chunk: int = CHUNK) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order (nulls first, equal ids by their text) and write the files.

    Null and empty texts give the end id alone; repeated rows are written each; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, docs_held, lengths, first, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = [to_planes(ids[at : at + block], kind) for at in range(0, len(ids), block)]
            row = {"part": part, "chunk": number, "first": first, "n_ids": len(ids), "kind": kind, "block": block, "doc_ids": docs_held, "lengths": lengths, "planes": planes}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            _, offsets = buffers(batch.column(1).cast(pa.binary()))
            for s, e in spans(offsets):
                rows = batch.slice(s, e - s)
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.ids_only([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    held += [ids, end]
                    docs_held.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    if (n := sum(lengths) if len(lengths) == 1 else n + lengths[-1]) >= chunk:
                        yield flush()
                        first, number = first + n, number + 1
                        held, docs_held, lengths = [], [], []
        if lengths:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("same").asc()]  # rows of one doc_id may lie in several ranges
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("same")).repartitionByRange(*order)
    docs = docs.sortWithinPartitions(*order).select("doc_id", "text")
    docs.mapInArrow(run, FORMAT).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``path`` -> (doc_id, start long: ids of all documents before it, ids binary). Places of parts come from a
    sum over parts, a row for each task that wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in ("before", "first", "n_ids", "kind", "block", "doc_ids", "lengths", "planes")}
                n, block, kind = r["n_ids"].as_py(), r["block"].as_py(), r["kind"].as_py()
                ids = np.concatenate([from_planes(p, min(block, n - k * block), kind) for k, p in enumerate(r["planes"].as_py())])
                lengths = np.array(r["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                starts = ends - lengths + r["before"].as_py() + r["first"].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"].as_py(), pa.int64()), pa.array(starts), data.cast(pa.binary())], ["doc_id", "start", "ids"])

    chunks = spark.read.schema(FORMAT).parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))  # as many rows as the writing stage had tasks
    return chunks.join(F.broadcast(parts), "part").mapInArrow(run, "doc_id long, start long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
