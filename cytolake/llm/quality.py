"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing gives every token a fixed sparse vector of +1 and -1, drawn from its hash; a token's word vector is the
sum of the sparse vectors of its neighbours in the labelled sample, plus its own, at unit length. Tokens share vectors
by hash bucket, so the table has a fixed size. A document pools its tokens' vectors (the mean, and the mean product of
neighbours, which shows repetition) and its length. A network with one hidden layer scores it, and a temperature fitted
on a part of the sample that the network has not seen calibrates the probability.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._common import SLICE_BYTES, U64, mix, range_hash, stored, texts_of

DIM, BUCKETS, NONZERO, REACH = 32, 1 << 15, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 4e-3, 1e-4
#: The bound of the labelled sample: so many documents fit the classifier, whatever the size of the corpus.
SAMPLE = 12_000
#: Tasks that sum word vectors over the sample, and ranges of buckets whose sums meet.
SAMPLE_TASKS, RANGES = 12, 8

# kinds of bytes: a token is a run of one kind; white space is none
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in ((65, 90), (97, 122), (128, 255)):
    _KIND[_lo : _hi + 1] = 1
_KIND[48:58] = 2


def index_vectors() -> np.ndarray:
    """The sparse vector of each bucket."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        h = mix(np.arange(BUCKETS, dtype=U64) * U64(NONZERO) + U64(k + 1))
        np.add.at(out, (np.arange(BUCKETS), (h >> U64(8)) % U64(DIM)), np.where(h & U64(1), 1, -1))
    return out


def token_buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of a text's tokens, in slices of bounded size cut between tokens."""
    lo = 0
    while lo < len(data):
        part = data[lo : lo + SLICE_BYTES]
        kind = _KIND[part]
        edges = np.flatnonzero(np.diff(kind)) + 1
        if lo + len(part) < len(data) and len(edges):  # the last token may go on
            part, kind, edges = part[: edges[-1]], kind[: edges[-1]], edges[:-1]
        starts, ends = np.r_[0, edges], np.r_[edges, len(part)]
        keep = kind[starts] > 0
        yield (range_hash(part, starts[keep], ends[keep]) % U64(BUCKETS)).astype(np.int64)
        lo += len(part)


def contexts(texts: Iterator[np.ndarray | None], index: np.ndarray) -> np.ndarray:
    """For each bucket the sum of its neighbours' sparse vectors."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for data in texts:
        for b in token_buckets(data) if data is not None else ():
            for step in range(1, REACH + 1):
                if len(b) > step:
                    np.add.at(out, b[step:], index[b[:-step]])
                    np.add.at(out, b[:-step], index[b[step:]])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def pooled(data: np.ndarray | None, vectors: np.ndarray) -> np.ndarray:
    """Mean vector, mean product of neighbours, and log length; zeros for a text without tokens."""
    total, product, n, pairs = np.zeros(DIM), np.zeros(DIM), 0, 0
    for b in token_buckets(data) if data is not None else ():
        for lo in range(0, len(b), 65536):
            v = vectors[b[lo : lo + 65536]]
            total += v.sum(axis=0)
            product += np.einsum("ij,ij->j", v[1:], v[:-1])
            n += len(v)
            pairs += len(v) - 1
    return np.r_[total / max(n, 1), product / max(pairs, 1), np.log1p(n) / 10]


@dataclasses.dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 3) -> Model:
    """Adam on the log loss over four fifths of the sample, then the temperature on the last fifth.

    Without labels the score is 0.5, with labels of one kind it is the smoothed share of that kind."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(vectors, x.mean(axis=0) if len(x) else np.zeros(n), np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(n), rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        model.w2 = np.zeros(HIDDEN)
        return model
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    params = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - model.center) / model.spread
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            off = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(off, params[2]) * (1 - hidden**2)
            t += 1
            for k, g in enumerate((z[rows].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ off + DECAY * params[2], off.sum(keepdims=True))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = *params[:3], float(params[3][0])
    if len(held):
        raw = model.logits(x[held])

        def loss(log_t: float) -> float:
            s = raw / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, s) - y[held] * s))

        lo, hi = -2.0, 2.5  # golden section: the loss is convex in 1/T, and so has one minimum
        for _ in range(40):
            a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled documents, those with the smallest hash of their id; labels (id, 0 or 1) that
    are null are left out, ids labelled twice count once (the smaller label), and so do documents that repeat an id
    (the text with the smallest hash)."""
    some = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    some = some.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    d = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).alias("d")
    # the sample's ids are bounded by the parameter
    rows = d.join(F.broadcast(some).alias("s"), F.col("d.doc_id") == F.col("s.id")).select("id", "y", "text")
    rows = stored(rows.groupBy("id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")), "quality-sample")
    index = index_vectors()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((contexts(texts_of(b.column("text")), index) for b in batches), np.zeros((BUCKETS, DIM), np.float32))
        parts = [x.tobytes() for x in np.split(total, RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["range", "sums"])

    def added(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in part.column("sums").to_pylist())
        return pa.table({"range": part.column("range")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    ranged = rows.repartition(SAMPLE_TASKS).mapInArrow(sums, "range int, sums binary").groupBy("range").applyInArrow(added, "range int, sums binary")
    total = index.copy()
    for r in ranged.collect():  # one table of a fixed size
        lo = r["range"] * (BUCKETS // RANGES)
        total[lo : lo + BUCKETS // RANGES] += np.frombuffer(r["sums"], np.float32).reshape(-1, DIM)
    vectors = unit(total)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM: a fixed size

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(t, shipped.value).tobytes() for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.binary())], names=["id", "y", "x"])

    found = rows.mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    shipped.unpersist()
    found.sort(key=lambda r: r["id"])  # one row for each id of the sample
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), 2 * DIM + 1)
    return fit(x, np.array([r["y"] for r in found], np.float64), vectors)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id and score (0 to 1), then the columns named in keep. Null and empty texts are
    scored like any text, from a pool of zeros. Only the text enters the score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            x = np.array([pooled(t, m.vectors) for t in texts_of(b.column("text"))]).reshape(b.num_rows, -1)
            s = m.scores(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), *b.columns[2:]], names=["doc_id", "score", *b.schema.names[2:]])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double" + (f", {ddl}" if ddl else ""))
    return out.select("doc_id", "score", *[F.col(f"`keep_{c}`").alias(c) for c in keep])


def held_out(doc_id: str, parts: int, rest: int):
    """Is crc32 of the id as text equal to rest, modulo parts? False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == rest, F.lit(False))
