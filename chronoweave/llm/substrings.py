"""Substring dedup by recompression.

Every round names runs of one symbol, then pairs of neighbours: a symbol of class L and one of class R after it become one
symbol, the class being a bit of the name. A name is a hash of what it stands for, so tasks name alike without a dictionary,
and equal substrings have equal symbols inside, wherever they stand. Spark groups three levels of symbols over all documents,
each only where the level above left something open:

1. High symbols (some twenty-five words) cut a text into blocks. A block with the words that its last window needs gets a 96-bit
   name; a block that a document of smaller doc_id has too is a repeat as a whole. Of a text that thousands copy, one goes on.
2. Low symbols (two rounds, pairs only: up to four words, where they begin and end depends on two words to either side). Every
   window holds some; the least of their names, each taken with two words on both sides, is its anchor. Anchors of open blocks that two
   documents have reveal where a repeat can be.
3. Windows of such anchors are verified by a 96-bit name of their words.

All three are plain rows and partial minima, so a passage that a third of all documents share costs each task one row a name;
texts are shuffled once. Tasks work through texts in pieces of about ``PIECE`` bytes, one very long text as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, IS_SPACE, SECOND, buffers, make_room, mix, span_hashes, spans, unused, word_bounds, word_hashes, write_table

WINDOW, EDGE, ROUNDS, LONGEST, UPPER = 13, 2, 2, 4, 11
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LAST = np.iinfo(np.int64).max
PIECE = 1 << 20


def _pairs(names: np.ndarray, at: np.ndarray, first: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of pairs: equal neighbours share a class and never pair."""
    left = (names * np.uint64((BASE * (2 * salt + 1)) & (1 << 64) - 1)).view(np.int64) < 0
    i = np.flatnonzero(left[:-1] & ~left[1:] & ~first[1:])
    named = names.copy()
    named[i] = mix(names[i] * np.uint64(0xC2B2AE3D27D4EB4F) + names[i + 1])
    stays = np.ones(len(names), bool)
    stays[i + 1] = False
    return named[stays], at[stays], first[stays]


def _runs(names: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of runs: a symbol that repeats becomes one, named by the symbol and how often it stands there."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | first[1:]
    if new.all():
        return names, at, first
    i = np.flatnonzero(new)
    count = np.diff(np.append(i, len(names)))
    named = np.where(count > 1, mix(names[i] * np.uint64(0x9E6C63D0876A9A47) + count.astype(np.uint64)), names[i])
    return named, at[i], first[i]


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """names of the words, first: which words begin a document -> places and names of the low symbols."""
    at = np.arange(len(names))
    for r in range(rounds):
        names, at, first = _pairs(names, at, first, r)
    return at, names


def high_symbols(at: np.ndarray, names: np.ndarray, begins: np.ndarray, rounds: int = UPPER) -> np.ndarray:
    """Places where the high symbols begin, from the low ones; begins: for every word whether it begins a document."""
    first = begins[at]
    for r in range(rounds):
        names, at, first = _pairs(*_runs(names, at, first), ROUNDS + r)
    return at


class Slice:
    """Words and windows of some rows, or of one piece of a long row (``base`` words of which come before)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, base: int = 0) -> None:
        self.data, self.offsets, self.row, self.base = data, offsets, row, base
        self.starts, self.ends, self.before = word_bounds(data, offsets)
        self.doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.before))

        self.hashes = word_hashes(data, self.starts, self.ends)
        self.begins = np.zeros(len(self.starts), bool)
        self.begins[self.before[:-1][np.diff(self.before) > 0]] = True

    def low_symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and names of the low symbols."""
        return recompress(self.hashes, self.begins)

    def anchors(self, windows: np.ndarray) -> np.ndarray:
        """For each window its anchor's name, of 48 bits: where names coincide, a window more is verified. It is the least among
        the names of the low symbols that stand, with their context, in the window."""
        n = len(self.starts)
        at, _ = self.low_symbols()
        length = np.diff(np.append(at, n))
        inside = (at >= EDGE) & (at + length + EDGE <= n)
        at, length = at[inside], length[inside]
        name = span_hashes(self.hashes, at - EDGE, at + length + EDGE) >> np.uint64(16)
        least = np.full(len(windows), NONE)
        for longest in range(1, LONGEST + 1):  # symbols of up to so many words, at the places that only they reach
            v = np.full(n, NONE)
            v[at[length <= longest]] = name[length <= longest]
            if longest < LONGEST:
                np.minimum(least, v[windows + WINDOW - EDGE - longest], out=least)
        width, have = WINDOW - 2 * EDGE - LONGEST + 1, 1
        while have < width:  # the least of ``width`` places in a row, by doubling
            step = min(have, width - have)
            v[:-step] = np.minimum(v[:-step], v[step:])
            have += step
        return np.minimum(least, v[windows + EDGE]).view(np.int64)

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """96-bit names of words first to last, from two hashes of each word that do not depend on one another."""
        hi = span_hashes(self.hashes, first, last + 1)
        lo = span_hashes(word_hashes(self.data, self.starts, self.ends, base=SECOND), first, last + 1)
        return pa.array(hi.view(np.int64)), pa.array((lo >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _packed(text: str):
    """The text column compressed row by row, as it travels once but is read several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            own = pc.cast(batch.column(i), pa.binary())
            yield batch.set_column(i, text, pa.array([(press.compress(t.as_buffer()) if len(t.as_buffer()) else b"") if t.is_valid else None for t in own], pa.binary()))

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], text: str | int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches in parts of bounded size, each with its texts as they were (null as empty)."""
    make_room()
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        column = batch.column(text)
        for s, e in spans(buffers(column)[1], 2 * PIECE):
            part = batch.slice(s, e - s)
            yield part, pa.array([press.decompress(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in part.column(text)], pa.large_binary())


def _slices(texts: pa.Array, shared: int = WINDOW - 1) -> Iterator[Slice]:
    """All rows in slices of about PIECE bytes; a longer row in pieces, neighbours of which share ``shared`` words."""
    data, offsets = buffers(texts)
    for s, e in spans(offsets, PIECE):
        lo, hi = int(offsets[s]), int(offsets[e])
        if hi - lo <= 2 * PIECE:
            yield Slice(data[lo:hi], offsets[s : e + 1] - lo, s)
            continue
        base, size = 0, PIECE
        while True:
            end = min(hi, lo + size)
            while end < hi and not IS_SPACE[data[end]]:
                end += 1
            piece = Slice(data[lo:end], np.array([0, end - lo]), s, base)
            n = len(piece.starts)
            if end < hi and n <= shared:  # words of such length that a piece holds too few
                size *= 2
                continue
            yield piece
            if end == hi:
                break
            lo, base, size = (lo + int(piece.starts[n - shared]), base + n - shared, PIECE) if shared else (end, base + n, PIECE)


def _doc_windows(s: Slice) -> np.ndarray:
    """First words of the windows, none of which spans two rows."""
    count = len(s.starts) - WINDOW + 1
    return np.flatnonzero(s.doc_of[:count] == s.doc_of[WINDOW - 1 :]) if count > 0 else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text) -> a row for each block: its place, number of windows and name."""
    make_room()
    for batch in batches:
        doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for s in _slices(pc.cast(batch.column(2), pa.binary())):
            w = _doc_windows(s)
            if not len(w):
                continue
            cut = np.zeros(len(s.starts), bool)
            cut[high_symbols(*s.low_symbols(), s.begins)] = True
            block = cut[w]
            block[0] = True
            block[1:] |= w[1:] != w[:-1] + 1
            b = np.flatnonzero(block)
            n, b = np.diff(np.append(b, len(w))), w[b]
            k = s.doc_of[b]
            at = b - s.before[:-1][k] + s.base
            yield pa.RecordBatch.from_arrays([pa.array(doc[s.row + k]), pa.array(key[s.row + k]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), *s.digests(b, b + n + WINDOW - 2)], ["doc", "key", "at", "n", "hi", "lo"])


def _ranges(column: pa.Array, row: int) -> np.ndarray:
    """(at, n) of a row's list of structs, a row each; empty where the list is null."""
    got = column[row].values
    return np.zeros((0, 2), np.int64) if got is None else np.stack([got.field("at").to_numpy(), got.field("n").to_numpy()], axis=1).astype(np.int64)


def _open_windows(s: Slice, done: pa.Array) -> np.ndarray:
    """Windows of no block that is known to repeat."""
    edge = np.zeros(len(s.starts) + 1, np.int64)
    for k in range(len(s.offsets) - 1):
        r = _ranges(done, s.row + k)
        if len(r):
            lo, hi = s.before[k], s.before[k + 1]
            np.add.at(edge, (r[:, 0] - s.base).clip(0, hi - lo) + lo, 1)
            np.add.at(edge, (r[:, 0] + r[:, 1] - s.base).clip(0, hi - lo) + lo, -1)
    w = _doc_windows(s)
    return w[np.cumsum(edge)[w] == 0]


def _anchors(text: str, doc_: str, key_: str, done: str):
    """Rows and the blocks of them that repeat -> a row for each anchor of open windows in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches, text):
            doc, key = batch.column(doc_).to_numpy(), batch.column(key_).to_numpy()
            for s in _slices(texts):
                w = _open_windows(s, batch.column(done))
                if not len(w):
                    continue
                name, k = s.anchors(w), s.doc_of[w]
                new = np.ones(len(w), bool)
                new[1:] = (name[1:] != name[:-1]) | (k[1:] != k[:-1])
                name, k = name[new], s.row + k[new]
                yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(key[k]), pa.array(name)], ["doc", "key", "name"])

    return run


def _windows(text: str, doc_: str, key_: str, done: str, names: str):
    """Rows, the blocks of them that repeat and anchors -> a row for each open window of such an anchor: its place and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches, text):
            doc, key, wanted = batch.column(doc_).to_numpy(), batch.column(key_).to_numpy(), batch.column(names)
            for s in _slices(texts):
                w = _open_windows(s, batch.column(done))
                if not len(w):
                    continue
                name = s.anchors(w)
                edges, use = np.searchsorted(w, s.before), np.zeros(len(w), bool)
                for k in np.flatnonzero(np.diff(edges)):
                    own = slice(edges[k], edges[k + 1])
                    use[own] = np.isin(name[own], wanted[int(s.row + k)].values.to_numpy())
                w = w[use]
                if len(w):
                    k = s.doc_of[w]
                    at = (w - s.before[:-1][k] + s.base).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[s.row + k]), pa.array(key[s.row + k]), pa.array(at), *s.digests(w, w + WINDOW - 1)], ["doc", "key", "at", "hi", "lo"])

    return run


def _cutter(text: str, ranges: str, keep: list[str]):
    """Rows with their repeats -> rows with counts and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches, text):
            repeats = batch.column(batch.schema.get_field_index(ranges))
            n_words, n_removed, kept = (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)])
            for s in _slices(texts, shared=0):
                raw = s.data.tobytes()
                for k in range(len(s.offsets) - 1):
                    lo, hi = int(s.before[k]), int(s.before[k + 1])
                    r, row = _ranges(repeats, s.row + k), s.row + k
                    n_words[row] += hi - lo
                    edge = np.zeros(hi - lo + 1, np.int64)
                    if len(r):
                        a, b = (r[:, 0] - s.base).clip(0, hi - lo), (r[:, 0] + r[:, 1] + WINDOW - 1 - s.base).clip(0, hi - lo)
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b, -1)
                    stays = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    n_removed[row] += hi - lo - len(stays)
                    if len(stays) == hi - lo:
                        kept[row] += raw[s.offsets[k] : s.offsets[k + 1]].split()
                    else:
                        kept[row] += [raw[a:b] for a, b in zip(s.starts[lo + stays].tolist(), s.ends[lo + stays].tolist(), strict=True)]
                    kept[row] = [b" ".join(kept[row])] if kept[row] else []
            left = pa.array([b"".join(p) for p in kept], pa.binary()).cast(pa.string())
            own = [c if f.name != text else pa.array([None if gone else t.as_py() for t, gone in zip(texts, pc.is_null(c).to_pylist(), strict=True)], pa.binary()).cast(pa.string()) for f, c in zip(batch.schema, batch.columns, strict=True)]
            own = [own[batch.schema.get_field_index(c)] for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), pa.array(n_removed), left], [*keep, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with n_words, n_removed and kept_text (replaced where such columns exist).

    Words are runs of anything but ASCII white space. A word is removed if a window of 13 consecutive words over it, as the
    input has them, also starts in a document of smaller doc_id. kept_text is the rest joined by one space. Null and empty
    texts have no words; texts of any length are whole; a null doc_id counts as the largest; rows that share a doc_id never
    remove from one another, equal rows lose the same words; an empty table gives none."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    doc, key, repeats, names = unused(docs.columns, "doc", "key", "repeats", "names")
    first = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    repeated = not docs.groupBy(first.alias(doc)).count().where("count > 1").isEmpty()
    # A row is known by its doc_id and, where doc_ids repeat, by its text; rows equal in both lose the same words.
    rows = docs.select("*", first.alias(doc), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias(key))
    ranges = F.collect_set(F.struct("at", "n"))  # a set: rows that repeat add nothing
    own = [F.col("doc").alias(doc), F.col("key").alias(key)]
    several = F.count("*") > 1
    blocks = rows.select(doc, key, text).mapInArrow(_blocks, "doc long, key long, at int, n int, hi long, lo int")
    least = blocks.groupBy("hi", "lo").agg(F.min("doc").alias("low"), several.alias("several")).where("several").select("hi", "lo", "low")
    done = blocks.hint("merge").join(least, ["hi", "lo"]).where("doc > low").groupBy(*own).agg(ranges.alias(repeats))
    done = write_table(done, "done")

    packed = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in rows.schema.fields])
    keyed = rows.mapInArrow(_packed(text), packed)
    open_ = keyed.hint("merge").join(done, [doc, key], "left")
    anchors = open_.mapInArrow(_anchors(text, doc, key, repeats), "doc long, key long, name long")
    shared = anchors.groupBy("name").agg(several.alias("several")).where("several").select("name")
    wanted = anchors.hint("merge").join(shared, "name").groupBy(*own).agg(F.collect_set("name").alias(names))
    asked = open_.hint("merge").join(wanted, [doc, key])
    windows = asked.mapInArrow(_windows(text, doc, key, repeats, names), "doc long, key long, at int, hi long, lo int")
    least = windows.groupBy("hi", "lo").agg(F.min("doc").alias("low"), several.alias("several")).where("several").select("hi", "lo", "low")
    found = windows.hint("merge").join(least, ["hi", "lo"]).where("doc > low").select(*own, F.struct("at", F.lit(1).alias("n")).alias("r"))
    found = done.select(doc, key, F.explode(repeats).alias("r")).unionByName(found).groupBy(doc, key).agg(F.collect_set("r").alias(repeats))

    joined = keyed.hint("merge").join(found, [doc, key], "left")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cutter(text, repeats, docs.columns), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Windows as texts; a word goes if one of them that covers it also starts in a document of smaller doc_id.
SQL = """
with words as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 12], ' ') as t from words, unnest(range(1, len(w) - 11)) u(i)
), first as (select t, min(doc_id) as low from windows group by t having min(doc_id) < max(doc_id)
), gone as (
    select distinct doc_id, k from windows join first using (t), unnest(range(i, i + 13)) u(k) where low < doc_id
), cut as (select doc_id, list(k order by k) as ks from gone group by doc_id
), kept as (
    select doc_id, len(w) as n, coalesce(len(ks), 0) as m,
        case when ks is null then w else list_filter(list_transform(list_zip(w, range(1, len(w) + 1)), lambda p: case when list_contains(ks, p[2]) then null else p[1] end), lambda x: x is not null) end as left_
    from words left join cut using (doc_id)
)
select doc_id, cast(n as bigint) as n_words, cast(m as bigint) as n_removed, sha256(array_to_string(left_, ' ')) as kept_sha256 from kept
"""
