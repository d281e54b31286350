"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words that together cover its whole text. Each passage is encoded from the
shares of character and word kinds, repetition, and signed sums of 64 hash bits of its words; a hidden layer, gated attention
(tanh times sigmoid) and a logistic layer are learned from document labels alone. Learning takes at most ``SAMPLE`` labelled
documents, those of least hash, and of each at most ``PASSAGES`` passages, evenly spaced; scoring covers every passage of every
row, in the tasks that read it. A long text is scored in pieces: attention weights are kept relative to the largest so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, buffers, make_room, spans, word_bounds, word_hashes

SAMPLE, PASSAGES, PASSAGE_WORDS, SIGNS, STYLE = 6000, 64, 64, 64, 14
PIECE = 1 << 19
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 24, 12, 300, 0.02, 1e-3
KINDS = np.zeros((6, 256), np.int64)
for _row, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b".,;:?!'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    KINDS[_row, list(_set)] = 1
KINDS[5, 33] = 1  # an exclamation mark counts as a symbol as well


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and for each text how many passages it has (one at least)."""
    starts, ends, before = word_bounds(data, offsets)
    words = np.diff(before)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    n, of = int(count.sum()), np.repeat(np.arange(len(words)), words)
    base = np.cumsum(count) - count
    p = base[of] + (np.arange(len(starts)) - before[:-1][of]) // PASSAGE_WORDS
    have = np.bincount(p, minlength=n).astype(float)
    out = np.zeros((n, STYLE + SIGNS), np.float32)
    if len(starts):
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))  # passages are runs of words
        full, some = p[first], np.maximum(have, 1)

        def total(v: np.ndarray) -> np.ndarray:
            sums = np.zeros(n)
            sums[full] = np.add.reduceat(v, first, dtype=np.float64)
            return sums

        length = (ends - starts).astype(float)
        chars = np.maximum(total(length), 1)
        for k in range(6):
            c = np.append(0, np.cumsum(KINDS[k][data]))
            share = c[ends] - c[starts]
            out[:, k] = total(share) / chars
            if k in (0, 5):
                out[:, 6 + k // 5] = total(share * 2 > length) / some
        h = word_hashes(data, starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        out[:, 8] = total(same) / some
        order = np.lexsort((h, p))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (p[order][1:] != p[order][:-1])
        out[:, 9] = total(fresh) / some
        out[:, 10] = np.log1p(total(length) / some)
        out[:, 11] = total(length <= 3) / some
        tail = data[ends - 1]
        out[:, 12] = total((tail == 46) | (tail == 44)) / some
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        out[full, STYLE:] = np.add.reduceat(bits, first, axis=0, dtype=np.int32) * (2 / have[full, None]) - 1
    out[:, 13] = np.log1p(have)
    return out, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _encode(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden layer, the two gates and the attention logit of each passage."""
    h = np.tanh((x - m["mean"]) / m["scale"] @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    return h, t, g, (t * g) @ m["w"]


def _forward(m: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    at, of = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    h, t, g, e = _encode(m, x)
    e = np.exp(e - np.maximum.reduceat(e, at)[of])
    a = e / np.add.reduceat(e, at)[of]
    z = np.add.reduceat(a[:, None] * h, at)
    return {"at": at, "of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ m["c"] + m["d"])}


def _score_long(m: dict[str, np.ndarray], data: np.ndarray) -> float:
    """The score of one long text, piece by piece; pieces end at white space (a piece that is one word ends where it may)."""
    at, top, weight, z = 0, -np.inf, 0.0, np.zeros(HIDDEN)
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data) and (gap := np.flatnonzero(IS_SPACE[data[at:end]])).size:
            end = at + int(gap[-1]) + 1
        h, _, _, e = _encode(m, passages(data[at:end], np.array([0, end - at]))[0])
        new = max(top, float(e.max()))
        w = np.exp(e - new)
        z, weight, top = z * np.exp(top - new) + w @ h, weight * np.exp(top - new) + w.sum(), new
        at = end
    return float(_sigmoid(z / weight @ m["c"] + m["d"])[0])


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean logistic loss; gradients by hand. With one label only, the score is that label's smoothed share."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    m = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3, "W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.1, ATTENTION), "c": rng.normal(0, 0.1, HIDDEN), "d": np.zeros(1)}
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return m | {"c": np.zeros(HIDDEN), "d": np.array([np.log(share / (1 - share))])}
    names = ("W", "b", "V", "U", "w", "c", "d")
    first, second = ({k: np.zeros_like(m[k]) for k in names} for _ in range(2))
    xs = (x - m["mean"]) / m["scale"]
    for step in range(1, STEPS + 1):
        r = _forward(m, x, count)
        h, t, g, a, of = r["h"], r["t"], r["g"], r["a"], r["of"]
        dl = (r["score"] - y) / len(y)
        grad = {"c": r["z"].T @ dl, "d": np.array([dl.sum()])}
        dz = dl[:, None] * m["c"]
        da = (dz[of] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, r["at"])[of])
        grad["w"] = (t * g).T @ de
        dt, dg = de[:, None] * m["w"] * g * (1 - t**2), de[:, None] * m["w"] * t * g * (1 - g)
        grad["V"], grad["U"] = h.T @ dt, h.T @ dg
        dh = (a[:, None] * dz[of] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
        grad["W"], grad["b"] = xs.T @ dh, dh.sum(axis=0)
        for k in names:
            d = grad[k] + (DECAY * m[k] if k in "WVU" else 0)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d**2
            m[k] = m[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id: str = "doc_id"):
    """Rows that learning never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learn from docs(doc_id, text) and labels(doc_id, quality). Several labels of one document count by their mean; of rows
    that share a doc_id the one of least features is learned from; null ids and labels are ignored; without labels every score is
    one half."""
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    wanted = wanted.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows: small enough to broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            bags = []
            for s, e in spans(offsets, PIECE):
                x, count = passages(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
                for bag in np.split(x, np.cumsum(count)[:-1]):
                    bags.append(bag[np.unique(np.linspace(0, len(bag) - 1, PASSAGES).round().astype(int))])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(b) for b in bags], pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())], ["doc_id", "y", "count", "x"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(wanted), "doc_id").select("text", F.col("doc_id").cast("string"), "y")
    got = rows.mapInArrow(run, "doc_id string, y double, count long, x binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("count", "x", "y")).alias("bag")).select("doc_id", "bag.*").toPandas()  # at most ``sample`` rows
    if got.empty:
        return fit(np.zeros((1, STYLE + SIGNS)), np.ones(1, np.int64), np.zeros(0))
    got = got.sort_values("doc_id")  # arrival order must not matter
    x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, STYLE + SIGNS) for v in got["x"]]).astype(float)
    return fit(x, got["count"].to_numpy(), got["y"].to_numpy())


def scored(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score, 0 to 1 (replaced where it exists). Null and empty texts are one empty passage; texts
    of any length are scored whole; rows of a null doc_id are scored as any other, repeated rows alike; an empty table gives none."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            data, offsets = buffers(pc.cast(batch.column(batch.schema.get_field_index(text)), pa.binary()))
            out = []
            for s, e in spans(offsets, PIECE):
                own = data[offsets[s] : offsets[e]]
                if len(own) > 2 * PIECE:
                    out.append(np.array([_score_long(model, own)]))
                else:
                    out.append(_forward(model, *passages(own, offsets[s : e + 1] - offsets[s]))["score"])
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that score one half or more."""
    return scored(docs, model).where("score >= 0.5").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
