"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Banding a whole document's signature finds hardly any short item in a long document (their Jaccard similarity is near zero),
so the sketch is asymmetric: of an item with q distinct shingles only the k = q - ceil(t * q) + 1 of least hash are kept. A
document that contains a share t of the item holds one of those at least, so no match is missed. Items are partitioned by
size; a partition's largest kept hash bounds what a document's shingles need to be looked up for, and documents with fewer
shingles than a partition's items need are passed over. Items of fewer words than a shingle are partitions of their own: the whole
item is its one shingle, looked up among the documents' runs of that many words. Survivors are compared shingle by shingle, as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, gram_hashes, make_room, mix, spans, word_bounds, word_hashes, write_table

WORDS, SHARE = 5, 0.8
#: Up to so many bytes of items are sent to every task; beyond, sketches and pairs are joined by shuffles.
BROADCAST_BYTES = 32 << 20
#: Capital letters to small ones, ASCII punctuation to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)


def folded(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    """The distinct runs of ``words`` words, folded and joined by one space."""
    w = folded(text)
    return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if words else set()


def _hashes(data: np.ndarray, offsets: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width the MinHash values of all runs of so many words, and the row of each."""
    data = _FOLD[data]
    starts, ends, before = word_bounds(data, offsets)
    row, words = np.repeat(np.arange(len(offsets) - 1), np.diff(before)), word_hashes(data, starts, ends)
    for width in widths:
        h = gram_hashes(words, width)
        inside = row[: len(h)] == row[width - 1 :] if len(h) else np.zeros(0, bool)
        yield width, mix(h[inside] + np.uint64(0x5BD1E995 * width)), row[: len(h)][inside]


def sketch(text: bytes | None, words: int = WORDS, share: float = SHARE) -> tuple[np.ndarray, int, int]:
    """The least hashes of an item that a match cannot miss all of, its number of distinct shingle hashes, and the words of a
    shingle: ``words``, or all that the item has."""
    width = min(words, len(folded(text)))
    data = np.frombuffer(text or b"", np.uint8)
    h = np.zeros(0, np.uint64)
    for _, all_, _ in _hashes(data, np.array([0, len(data)]), [width] if width else []):
        h = np.unique(all_)
    return h[: len(h) - math.ceil(share * len(h) - 1e-9) + 1] if len(h) else h, len(h), width


class Index:
    """Sketches of many items, in partitions by size (powers of two)."""

    def __init__(self, items: list[tuple[int, bytes]], words: int, share: float) -> None:
        self.share = share
        found = [(i, *sketch(t, words, share)) for i, (_, t) in enumerate(items)]
        self.width = [w for _, _, _, w in found]
        self.parts: dict[int, list] = {}
        for width, size in sorted({(w, q.bit_length()) for _, _, q, w in found if q}):
            own = [(i, h, q) for i, h, q, w in found if (w, q.bit_length()) == (width, size)]
            h = np.concatenate([h for _, h, _ in own])
            item = np.concatenate([np.full(len(h), i) for i, h, _ in own])
            order = np.argsort(h, kind="stable")
            self.parts.setdefault(width, []).append((h[order], item[order], math.ceil(share * min(q for _, _, q in own) - 1e-9)))
        self.ids = [i for i, _ in items]
        self.exact = [shingles(t, w) for (_, t), w in zip(items, self.width, strict=True)]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs that share a sketch hash."""
        out = set()
        for width, h, row in _hashes(data, offsets, list(self.parts)):
            count = np.bincount(row, minlength=len(offsets) - 1)
            for keys, item, least in self.parts[width]:
                use = np.flatnonzero((h <= keys[-1]) & (count[row] >= least))
                lo = np.searchsorted(keys, h[use], "left")
                hit = use[keys[np.minimum(lo, len(keys) - 1)] == h[use]]
                for k in np.unique(h[hit]).tolist():
                    a, b = np.searchsorted(keys, np.uint64(k), "left"), np.searchsorted(keys, np.uint64(k), "right")
                    rows = np.unique(row[hit[h[hit] == np.uint64(k)]]).tolist()
                    out.update((r, i) for r in rows for i in item[a:b].tolist())
        return sorted(out)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item_id, shingles of the item, shared shingles) for every verified pair."""
        data, offsets = buffers(texts)
        out = []
        for s, e in spans(offsets, 1 << 20):
            own: dict[int, set[bytes]] = {}
            last = -1
            for row, i in self.candidates(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]):
                if row != last:
                    own, last = {}, row
                w = self.width[i]
                if w not in own:
                    own[w] = shingles(data[offsets[s + row] : offsets[s + row + 1]].tobytes(), w)
                both = len(own[w] & self.exact[i])
                if both >= self.share * len(self.exact[i]) - 1e-9:
                    out.append((s + row, self.ids[i], len(self.exact[i]), both))
        return out


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, n_shingles, n_shared, containment), one row for each pair
    whose containment of the item in the document is ``share`` or more, by distinct shingles.

    An item of fewer than ``words`` words is one shingle. Items and texts that are null or without words match nothing; null ids
    are passed over; of repeated rows the best pair counts; texts of any length are searched whole; empty tables give none."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("item"))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    names = ["doc_id", "item_id", "n_shingles", "n_shared"]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names)

    if (items.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0) <= broadcast_bytes:
        index = docs.sparkSession.sparkContext.broadcast(items.collect())  # of the size just checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make_room()
            own = Index([(r[0], bytes(r[1])) for r in index.value], words, share)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield rows([(ids[r], *rest) for r, *rest in own.matches(batch.column(1))])

        found = docs.mapInArrow(run, schema)
    else:

        def item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    h, _, width = sketch(t, words, share)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), width))], ["item_id", "h", "width"])

        sketches = write_table(items.mapInArrow(item_hashes, "item_id long, h long, width long"), "sketches")
        sign = F.lit(-(1 << 63))
        top = sketches.groupBy("width").agg(F.max(F.col("h").bitwiseXOR(sign)).alias("h")).collect()  # at most ``words`` rows
        if not top:
            return docs.sparkSession.createDataFrame([], schema + ", containment double")
        most = {r["width"]: np.uint64((r["h"] ^ -(1 << 63)) & (1 << 64) - 1) for r in top}

        def doc_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make_room()
            for batch in batches:
                data, offsets = buffers(batch.column(1))
                for s, e in spans(offsets, 1 << 20):
                    for width, h, row in _hashes(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], list(most)):
                        use = h <= most[width]
                        yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(s + row[use])), pa.array(h[use].view(np.int64))], ["doc_id", "h"])

        pairs = docs.mapInArrow(doc_hashes, "doc_id long, h long").hint("merge").join(sketches, "h").select("doc_id", "item_id").distinct()
        pairs = write_table(pairs, "pairs")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for d, i, t, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")), strict=True):
                    width = min(words, len(folded(item)))
                    want = shingles(item, width)
                    both = len(want & shingles(t, width))
                    if want and both >= share * len(want) - 1e-9:
                        found.append((d, i, len(want), both))
                yield rows(found)

        both = pairs.hint("merge").join(items, "item_id").hint("merge").join(docs, "doc_id").select("doc_id", "item_id", "text", "item")
        found = both.mapInArrow(verify, schema)
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("m"))
    return found.select("doc_id", "item_id", "m.n_shingles", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; rows of a null doc_id stay."""
    hit = matches(docs, items).select("doc_id").distinct()
    return docs.hint("merge").join(hit, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
