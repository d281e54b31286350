"""N-gram Jaccard join: a size-aware heavy-light join of the documents' sets of five-word shingles.

Small sets (light) list all subsets of the size that a partner of each size must share with them; two light sets that list one
subset are linked, and nothing is left to verify. Large sets (heavy) scan inverted lists of their elements: of a set of n, the
n - ceil(0.8 n) + 1 first elements in one global order are listed, since linked sets share one of those. The boundary between the
two is where the rows of both sides together cost least, from the counts of set sizes.

Elements that many sets hold come last in the global order, so that lists stay short and a set's listed elements hold what no other
set has. Those of its own tell two sets apart whatever else they share: where both together have more than the threshold
allows to differ, or one has more than a set of the other's size leaves it, the pair goes, before it is ever made; and it is made only in
lists whose element is among the first of both that must hold one in common. For that sets are listed up to steps of the order, so that most end at one. What is left in one list is linked in two rounds. In the first, every set is
compared with one other, that of fewest own elements in most of its lists (of a group of near copies, the text they stem from); then,
once more, one set of each component with one of another. A group of near copies becomes one component that way, at the cost
of a comparison a copy. In the second, sets of one list that are still in different components are counted over all lists they
share; pairs whose counts allow the threshold are compared by their whole sets. So no link between components is lost.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordNames, checkpointed, components, gram_hashes, make_room, mix, write_table

WORDS, PERCENT = 5, 80
#: Light sets have fewer elements than this at most; POSTING is the cost of a row of an inverted list, in rows of a subset.
LIGHT, POSTING = 24, 3.0
#: Elements that go last in the global order: the most frequent, by what tasks have seen. Any choice gives the same result.
FREQUENT, SEEN = 1 << 18, 2
#: Bits of a place in the order below its step; the step of sets that are listed beyond all elements that are not frequent.
STEP, BEYOND = 57, 64
#: Sets of a list that are paired in one piece; sets that a semi-join by broadcast may fetch, beyond it a merge does.
TILE, FETCH = 512, 1_000_000


def element_set(text: bytes, names: WordNames, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words, one of the whole sequence; of none, nothing."""
    h = names.of(text.lower())
    if len(h) < words:
        return mix(gram_hashes(h, len(h)) + np.uint64(len(h))) if len(h) else h
    return np.unique(gram_hashes(h, words))


def set_name(elements: np.ndarray) -> int | None:
    """The node of a set: a hash of all its elements, as a signed long; none for an empty set."""
    return int(np.array(xxhash.xxh3_64_intdigest(elements.tobytes()), np.uint64).view(np.int64)) if len(elements) else None


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Elements that sets of a and b elements must share: 100 * shared >= percent * (a + b - shared)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Elements of a set of n, first in the global order, of which every linked set has one."""
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int, stop: int) -> range:
    """Sizes below ``stop`` that a set linked with one of n elements can have."""
    return range(-(-percent * n // 100), min(100 * n // percent + 1, stop))


def light_rows(n: int, boundary: int, percent: int = PERCENT) -> int:
    return sum(comb(n, needed(n, m, percent)) for m in partners(n, percent, boundary))


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary of least cost; sizes: number of sets of each size, those of LIGHT or more under LIGHT."""

    def cost(x: int) -> float:
        low = -(-percent * x // 100)
        return sum(k * (light_rows(n, x, percent) * (n < x) + POSTING * prefix(n, percent) * (n >= low)) for n, k in sizes.items() if n < LIGHT)

    return min(range(1, LIGHT + 1), key=cost)


@cache
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


#: Places of rows of subsets: partners of one size, and the smaller and the larger of partners of two.
EQUAL, SMALLER, LARGER = -1, -2, -3


def subset_keys(elements: np.ndarray, boundary: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A key for each subset of the size that a light partner must share, and each size of partner; which side of the key it is."""
    n, keys, sides = len(elements), [], []
    for m in partners(n, percent, boundary):
        pair = np.array([min(n, m) * LIGHT + max(n, m)], np.uint64)
        keys.append(mix(elements[_choices(n, needed(n, m, percent))].sum(axis=1, dtype=np.uint64) + mix(pair)))
        sides.append(np.full(len(keys[-1]), EQUAL if n == m else SMALLER if n < m else LARGER, np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def light_links(lists: DataFrame) -> DataFrame:
    """Links (a, b) that connect what shares a subset: all of one size with one another, smaller sets with larger ones."""
    least = lists.groupBy("elem").agg(*[F.min(F.when(F.col("pos") == side, F.col("node"))).alias(name) for name, side in (("equal", EQUAL), ("smaller", SMALLER), ("larger", LARGER))])
    other = F.when(F.col("pos") == EQUAL, F.col("equal")).when(F.col("pos") == SMALLER, F.col("larger")).otherwise(F.col("smaller"))
    return lists.hint("merge").join(least, "elem").select(F.col("node").alias("a"), other.alias("b")).where("a <> b").distinct()


def surveyed(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, node, n, key), and rows (elem, n) of elements that SEEN sets of a batch or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        names = WordNames()
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            nodes, sizes = [], []
            for text in batch.column(1):
                e = element_set(text.as_py() or b"", names, words)
                nodes.append(set_name(e))
                sizes.append(len(e))
                if len(e):
                    found[nodes[-1]] = e
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(nodes), pa.int64()), batch.column(2)], ["doc_id", "node", "n", "elem", "key"])
            if found:
                e, count = np.unique(np.concatenate(list(found.values())), return_counts=True)
                e, count = e[count >= SEEN], count[count >= SEEN]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(e), pa.int64()), pa.nulls(len(e), pa.int64()), pa.array(count, pa.int64()), pa.array(e.view(np.int64)), pa.nulls(len(e), pa.int64())], ["doc_id", "node", "n", "elem", "key"])

    return keyed(docs).mapInArrow(run, "doc_id long, node long, n long, elem long, key long")


ROWS = "elem long, node long, n int, pos int, step int, cold int"


def listed(docs: DataFrame, boundary: int, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(elem, node, n, pos, step, cold): the subsets of light sets (pos below 0), the first elements of sets that can have a heavy partner,
    up to the end of a step, and how many of those are not frequent. Equal sets are listed once a task. frequent: elements that
    go last, the most frequent last of all."""
    low = -(-percent * boundary // 100)
    rank = np.argsort(frequent)
    ordered = frequent[rank]

    def keys_of(e: np.ndarray) -> np.ndarray:
        keys = e >> np.uint64(1)
        if len(ordered):
            at = np.minimum(np.searchsorted(ordered, e), len(ordered) - 1)
            often = ordered[at] == e
            keys[often] = np.uint64(1 << 63) + rank[at[often]].astype(np.uint64)
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        names, seen = WordNames(), set()
        for batch in batches:
            elems, nodes, sizes, places, steps, colds = [], [], [], [], [], []

            def add(keys: np.ndarray, pos: np.ndarray, node: int, n: int, step: int, cold: int) -> None:
                elems.append(keys)
                places.append(pos)
                nodes.append(np.full(len(keys), node))
                for held, x in ((sizes, n), (steps, step), (colds, cold)):
                    held.append(np.full(len(keys), x, np.int32))

            for text in batch.column(0):
                e = element_set(text.as_py() or b"", names, words)
                n, node = len(e), set_name(e)
                if not n or node in seen:
                    continue
                seen.add(node)
                if n < boundary:
                    add(*subset_keys(e, boundary, percent), node, n, 0, 0)
                if n >= low:
                    keys, k = np.sort(keys_of(e)), prefix(n, percent)
                    step = min(int(keys[k - 1]) >> STEP, BEYOND)
                    cold = int(np.searchsorted(keys, np.uint64(min(step + 1, BEYOND) << STEP)))
                    keys = keys[: max(k, cold)]
                    add(keys, np.arange(len(keys), dtype=np.int32), node, n, step, cold)
            if elems:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(elems).view(np.int64)), pa.array(np.concatenate(nodes), pa.int64()), *(pa.array(np.concatenate(x)) for x in (sizes, places, steps, colds))], ["elem", "node", "n", "pos", "step", "cold"])

    return docs.select("text").mapInArrow(run, ROWS)


def shared_lists(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of lists that two sets or more are in. Lists stream through sorted; a task holds no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        last, open_ = None, False  # the row before; whether it begins a list and waits for a second
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            cols = [np.concatenate([[x], c]) if last is not None else c for x, c in zip(last or cols, cols, strict=True)]
            elem, node, light = cols[0], cols[1], cols[3] < 0
            same = np.zeros(len(elem), bool)  # whether a row goes on with the list of the row before
            same[1:] = (elem[1:] == elem[:-1]) & (light[1:] == light[:-1])
            again = same.copy()
            again[1:] &= node[1:] == node[:-1]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(elem))))
            fresh = np.add.reduceat(~again, np.flatnonzero(~same))  # different sets of each list
            busy = (fresh > 1)[np.cumsum(~same) - 1] & ~again
            held = last is not None
            if held and not open_:  # its list has been shared before this batch
                busy = busy | ((start == 0) & ~again)
                busy[0] = False
            i = np.flatnonzero(busy)
            end = start == start[-1]
            open_ = not busy[end].any() and not (held and not open_ and start[-1] == 0)
            last = [c[-1] for c in cols]
            if open_:
                last = [c[np.flatnonzero(end)[0]] for c in cols]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c[i], t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["elem", "node", "n", "pos", "step", "cold"])

    order = ["elem", "light", "n", "node"]
    rows = postings.withColumn("light", F.col("pos") < 0).repartition("elem").sortWithinPartitions(*order).drop("light")
    return rows.mapInArrow(run, ROWS)


def _shared(a: str, b: str, percent: int) -> Column:
    """How many elements linked sets of sizes a and b share at least; neither has more than the rest of its own."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def _allowed(a: str, b: str, percent: int) -> Column:
    """By how many elements linked sets of sizes a and b may differ."""
    return F.col(a) + F.col(b) - 2 * _shared(a, b, percent)


def with_own(lists: DataFrame) -> DataFrame:
    """Lists with ``own``, how many elements a set has listed that are neither frequent nor listed by another set."""
    own = lists.groupBy("node", "cold").agg(F.count(F.when(F.col("elem") >= 0, 1)).alias("k")).select("node", (F.col("cold") - F.col("k")).cast("int").alias("own"))
    return lists.drop("cold").hint("merge").join(own, "node")


def some_of(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in wanted(column): by broadcast, if those are FETCH at most, else by merge."""
    wanted = F.broadcast(wanted) if wanted.count() <= FETCH else wanted.hint("merge")
    return df.join(wanted, column, "left_semi")


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a 64-bit name of the row."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def fetched(nodes: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """nodes(node) -> (node, data): one text of each, compressed. Rows are found by their names, so no set is made for it."""
    ids = checkpointed(found.hint("merge").join(nodes, "node").groupBy("node").agg(F.min("key").alias("key")))
    texts = keyed(docs).join(ids.hint("broadcast" if ids.count() <= FETCH else "merge"), "key").select("node", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            nodes, data = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    data.append(press.compress(text.as_py() or b""))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["node", "data"])

    texts = texts.mapInArrow(packed, "node long, data binary")
    return write_table(texts.groupBy("node").agg(F.min("data").alias("data")), "sets")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs(a, b) of nodes -> those whose whole sets, made anew from the texts, are linked."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        names, un, held = WordNames(), zstandard.ZstdDecompressor(), OrderedDict()

        def elements(node: int, data: pa.Scalar) -> np.ndarray:
            if node in held:
                held.move_to_end(node)
            else:
                held[node] = element_set(un.decompress(data.as_py()), names, words)
                while len(held) > 2 and sum(map(len, held.values())) > 1 << 20:
                    held.popitem(last=False)
            return held[node]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s, t = elements(a, x), elements(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays(list(batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).columns), ["a", "b"])

    texts = some_of(texts, "node", checkpointed(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    both = both.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(compared, "a long, b long")


def labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Lists with the component of each node."""
    rows = lists.hint("merge").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return write_table(rows, "labelled")


def stars(rows: DataFrame, percent: int) -> DataFrame:
    """rows: labelled lists -> a pair (a, b) for each component that meets another in a list and may be linked with it: a set of its own
    and the set of fewest own elements of the list, from most of its lists."""
    least = F.min(F.struct("own", "n", "node", "step", "pos"))
    of = rows.groupBy("elem", "component").agg(least.alias("x"))
    first = rows.groupBy("elem").agg(F.min(F.struct("own", "n", "node", "step", "pos", "component")).alias("f"))
    met = of.hint("merge").join(first, "elem").where("component <> f.component")
    own = [F.when(F.col(f"{a}.step") <= F.col(f"{b}.step"), F.col(f"{a}.own")).otherwise(0) for a, b in (("x", "f"), ("f", "x"))]
    met = met.where((own[0] + own[1] <= _allowed("x.n", "f.n", percent)) & (100 * F.least("x.n", "f.n") >= percent * F.greatest("x.n", "f.n")))
    for k, side in enumerate("xf"):
        most = F.col(f"{side}.n") - _shared("x.n", "f.n", percent)
        met = met.where((own[k] <= most) & (F.col(f"{side}.pos") <= most))
    counted = met.groupBy("component", F.col("x.node").alias("a"), F.col("f.node").alias("b")).agg(F.count("*").alias("k"))
    best = counted.groupBy("component").agg(F.max_by(F.struct("a", "b"), F.struct("k", "a", "b")).alias("p"))
    return write_table(best.select("p.a", "p.b"), "stars")


def met_pairs(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """Pairs of sets of one labelled list that lie in different components, once for each list in which they may be linked."""
    mixed = rows.groupBy("elem").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("elem", "size")
    rows = rows.hint("merge").join(mixed, "elem").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("elem", F.least("mine", "other").alias("tile_a"), F.greatest("mine", "other").alias("tile_b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "n", "node", "pos", "step", "own", "component")

    def pair_up(t: pa.Table) -> pa.RecordBatch | None:
        node, n, pos, step, own, comp, side = (t[c].to_numpy() for c in ("node", "n", "pos", "step", "own", "component", "side"))
        n = n.astype(np.int64)
        cross = t["tile_a"].to_numpy() != t["tile_b"].to_numpy()
        key = [t[c].to_numpy() for c in ("elem", "tile_a", "tile_b")]
        new = np.ones(len(node), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        first = np.append(np.flatnonzero(new), len(node))
        size, out = np.diff(first), []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            both = n[i] + n[j]
            ok = (comp[i] != comp[j]) & (100 * n[i] >= percent * n[j]) & (~cross[i] | (side[i] != side[j]))  # rows of a tile are in order of n
            # what a set has listed of its own is not in one that is listed as far; beyond that it may be
            a, b = own[i] * (step[i] <= step[j]), own[j] * (step[j] <= step[i])
            shared = -(-percent * both // (100 + percent))
            ok &= (a + b <= both - 2 * shared) & (a <= n[i] - shared) & (b <= n[j] - shared)
            ok &= (pos[i] <= n[i] - shared) & (pos[j] <= n[j] - shared)  # the first element that linked sets share is among these of both
            i, j = i[ok], j[ok]
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append(np.stack([node[i], node[j], n[i], n[j], pos[i], pos[j]]))

        for k in np.unique(size[size > 1]).tolist():  # lists of one size together, some at a time
            i, j = np.triu_indices(k, 1)
            starts = first[:-1][size == k]
            for part in np.array_split(starts, len(starts) * len(i) // (1 << 20) + 1):
                keep((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
        if not out:
            return None
        a = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in a], ["a", "b", "na", "nb", "pa", "pb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            same = np.all([t[c].to_numpy() == t[c][-1].as_py() for c in ("elem", "tile_a", "tile_b")], axis=0)
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            rest = t.slice(cut)
            if cut and (out := pair_up(t.slice(0, cut).combine_chunks())) is not None:
                yield out
        if rest is not None and (out := pair_up(rest.combine_chunks())) is not None:
            yield out

    order = ["elem", "tile_a", "tile_b"]
    return rows.repartition(*order).sortWithinPartitions(*order, "n", "node").mapInArrow(run, "a long, b long, na long, nb long, pa long, pb long")


def open_pairs(rows: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Pairs of sets of one labelled list that lie in different components and whose common places in all lists allow the threshold."""
    pairs = met_pairs(rows, percent, tile).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    apart = F.col("pa") + F.col("pb") + 2 - 2 * F.col("k")  # up to the last element that both have listed
    return pairs.where(apart <= _allowed("na", "nb", percent)).select("a", "b")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, boundary: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id): the size of the document's set and the smallest doc_id reachable over
    links of 100 * shared >= percent * union, itself included.

    Null, empty and blank texts have an empty set, are linked with nothing and are their own component. Equal sets are one node, so
    copies cost a row each. Rows of one doc_id are rows of their own, rows of a null doc_id take part and get the component's
    smallest id (null, if it has none); an empty table gives none; other columns are ignored. ``boundary`` overrides the chosen one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    survey = write_table(surveyed(docs, words), "surveyed")
    found = survey.where("elem is null").select("doc_id", "node", "n", "key")
    if boundary is None:
        sizes = found.where("node is not null").groupBy(F.least("n", F.lit(LIGHT)).alias("n")).agg(F.approx_count_distinct("node").alias("k"))
        boundary = choose_boundary({r["n"]: r["k"] for r in sizes.collect()}, percent)  # LIGHT rows at most
    often = survey.where("elem is not null").groupBy("elem").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "elem").limit(FREQUENT)
    frequent = often.select("elem").toArrow()["elem"].to_numpy()[::-1].astype(np.int64).view(np.uint64)  # FREQUENT rows at most
    lists = write_table(shared_lists(listed(docs, boundary, frequent, words, percent), percent), "lists")
    links = light_links(lists.where("pos < 0"))
    lists = write_table(with_own(lists.where("pos >= 0")), "own")
    texts = fetched(lists.select("node").distinct(), docs, found)
    first = stars(lists.withColumn("component", F.col("node")), percent)
    links = write_table(links.unionByName(verified(first, texts, words, percent)), "links")
    second = stars(labelled(lists, components(links)), percent)
    links = write_table(links.unionByName(verified(second, texts, words, percent)), "links")
    rest = write_table(open_pairs(labelled(lists, components(links)), percent), "open")
    more = verified(rest, texts, words, percent)
    linked = components(links.unionByName(more))
    ids = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own")).hint("merge").join(linked, "node", "left")
    of = ids.withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("own").alias("component_id"))
    of = write_table(of.hint("merge").join(least, "component").select("node", "component_id"), "members")
    out = found.hint("merge").join(of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Links by counting shared shingles, classes by label propagation.
SQL = """
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s
    from words
), held as (select doc_id, len(s) as n, unnest(s) as e from sets),
counted as (
    select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k
    from held a join held b on a.e = b.e and a.doc_id < b.doc_id
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by all
), links as (select a, b from counted where 100 * k >= 80 * (na + nb - k)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
from sets s left join reach r on r.a = s.doc_id
group by s.doc_id, s.s
"""
