"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Words are told apart by hash, in BUCKETS of them (2^17: a fixed size, so that the vectors can be broadcast). Every bucket has a sparse ternary index vector; its word vector is the sum of the index vectors of its neighbours within
WINDOW over the whole corpus, scaled to unit length after the corpus' mean direction is taken out. A document is the mean of its words' vectors.
A two-layer network is fitted on at most `max_labels` labelled documents (picked by key digest) in STEPS steps of 256 rows, whatever their number, the
second half of them at half the rate, and its logits are divided by the temperature that minimises held-out log loss, so probabilities are calibrated.

Defined results: null or blank text pools to the zero vector and is scored like any other; text is read whole; repeated documents
count in the corpus and get a row each; a doc_id with several labels has the mean label, rounded; labels of null doc_id or
null quality are left out; with no labels or one class the probability is the class share (0.5 without labels); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, arrow_batches, hash_words, materialize, mix64, sized

BUCKETS, PART, DIM, NONZERO, WINDOW = 1 << 17, 1 << 10, 64, 4, 2
HIDDEN, STEPS, MAX_LABELS = 24, 6_000, 20_000
HOLD_OUT = 0.2
KEEP = 0.5


def buckets_of(t: Tokens) -> np.ndarray:
    """The bucket of each token; tokens keep their punctuation, which tells much about quality."""
    h = hash_words(t.words)
    return (mix64(h) % np.uint64(BUCKETS)).astype(np.int64)[t.ids] if len(h) else np.zeros(0, np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS, NONZERO) places and signs of the ternary index vectors, from a fixed mix of the bucket number."""
    x = mix64(np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)[None, :] + np.uint64(77))
    return (x % np.uint64(DIM)).astype(np.int64), np.where((x >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)


def context_sums(t: Tokens, place: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sums): summed index vectors of the neighbours of one batch's buckets."""
    used, b = np.unique(buckets_of(t), return_inverse=True)
    rows = t.rows
    out = np.zeros(len(used) * DIM)
    at, up = place[used], sign[used]
    for o in range(1, WINDOW + 1):
        if len(b) <= o:
            break
        same = rows[:-o] == rows[o:]
        left, right = b[:-o][same], b[o:][same]
        for x, y in ((left, right), (right, left)):
            for k in range(NONZERO):
                out += np.bincount(x * DIM + at[y, k], weights=up[y, k], minlength=len(out))
    return used, out.reshape(len(used), DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) unit vectors from all documents. What tasks send is of fixed size, and so is the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros((BUCKETS, DIM), np.int32)
        for b in arrow_batches(batches):
            used, sums = context_sums(Tokens(b.column(0), trim=False), place, sign)
            total[used] += sums.astype(np.int32)
        # blocks of buckets, mostly zeros and small numbers, are sent compressed
        blocks = total.reshape(-1, PART * DIM)
        some = np.flatnonzero(blocks.any(1))
        for k in some:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zstandard.compress(blocks[k].tobytes(), 1)], pa.binary())], ["part", "v"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(zstandard.decompress(v), np.int32)
                sums[k] = sums[k] + v if k in sums else v.astype(np.int64)
        for k, v in sums.items():
            # only the direction counts from here on
            v = v.reshape(PART, DIM)
            unit = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([unit.tobytes()], pa.binary())], ["part", "v"])

    sent = docs.select("text").mapInArrow(run, "part long, v binary").repartition(BUCKETS // PART, "part")
    got = sent.mapInArrow(add, "part long, v binary").collect()
    unit = np.zeros((BUCKETS, DIM), np.float32)
    for r in got:
        unit[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.v, np.float32).reshape(PART, DIM)
    seen = unit.any(1)
    if seen.any():
        unit[seen] -= unit[seen].mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        unit[~seen] = 0
    return unit


def pool(t: Tokens, vectors: np.ndarray) -> np.ndarray:
    """(rows, DIM) means of the tokens' vectors."""
    used, b = np.unique(buckets_of(t), return_inverse=True)
    rows, n, own = t.rows, len(t.lengths), np.ascontiguousarray(vectors[used].T)
    # one dimension at a time: a token's whole vector would be a hundred times its text
    sums = np.stack([np.bincount(rows, weights=own[k][b], minlength=n) for k in range(DIM)], axis=1)
    return sums / np.maximum(t.lengths, 1)[:, None]


class Network:
    """Standardised input, one tanh layer, a logistic output, and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = STEPS) -> Network:
    """Adam on the rows not held out; the temperature is searched on those held out."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    tr = ~held if (~held).sum() and len(set(y[~held])) == 2 else np.ones(len(y), bool)
    mean, scale = x[tr].mean(0), x[tr].std(0) + 1e-6
    z, t = (x[tr] - mean) / scale, y[tr]
    p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    size, order, at = 256, rng.permutation(len(t)), 0
    for step in range(1, steps + 1):
        if at >= len(t):
            order, at = rng.permutation(len(t)), 0
        pick, at = order[at : at + size], at + size
        h = np.tanh(z[pick] @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[pick]) / len(pick)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [z[pick].T @ back + 1e-5 * p[0], back.sum(0), h.T @ e + 1e-5 * p[2], np.array([e.sum()])]
        rate = 0.01 * (0.5 if 2 * step > steps else 1)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logit, target = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.clip(logit / c, -50, 50) * (2 * target - 1))) for c in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


class Model:
    def __init__(self, vectors: np.ndarray, net: Network, report: dict):
        self.vectors, self.net, self.report = vectors, net, report


def pooled(docs: DataFrame, vectors: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, v): pooled vectors."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in arrow_batches(batches):
            x = pool(Tokens(b.column(1), trim=False), held.value)
            flat = pa.array(x.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * DIM, pa.int32()), flat)], [key, "v"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, v array<double>")


def fit(docs: DataFrame, labels: DataFrame, features: DataFrame, vectors: np.ndarray, max_labels: int = MAX_LABELS) -> Model:
    """`features` are the pooled vectors of `docs`, materialized."""
    wanted = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    n = wanted.count()
    step = max(1, -(-n // max_labels))
    wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    rows = features.join(sized(materialize(wanted, "qlabels"), 16), "doc_id").select("doc_id", "y", "v").orderBy("doc_id").toPandas()
    x = np.array(rows.v.tolist()).reshape(len(rows), DIM)
    y = rows.y.to_numpy(float)
    ids = hash_words([str(i) for i in rows.doc_id])
    held = (mix64(ids) % np.uint64(1000)) < np.uint64(int(1000 * HOLD_OUT))
    net = fit_network(x, y, held)
    report = {"labelled": len(y)}
    if held.any():
        p = net.probability(x[held])
        report |= {"held_out": int(held.sum()), "accuracy": float(((p >= KEEP) == (y[held] == 1)).mean()), "temperature": net.temperature}
    return Model(vectors, net, report)


def classify(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, quality_prob, keep) for each row of `docs`."""
    vectors = word_vectors(docs)
    features = materialize(pooled(docs, vectors), "pooled")
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, features, vectors, max_labels).net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(1)
            x = np.asarray(col.flatten()).reshape(b.num_rows, DIM)
            p = held.value.probability(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= KEEP)], ["doc_id", "quality_prob", "keep"])

    return features.select("doc_id", "v").mapInArrow(run, f"doc_id {kind}, quality_prob double, keep boolean")
