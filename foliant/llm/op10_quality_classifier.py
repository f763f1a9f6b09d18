"""Quality classifier: random-indexing word vectors pooled per document, then a small network with calibrated probabilities.

Tokens are runs of letters, of digits or of one kind of symbol, hashed to `1 << BITS` rows. Every row has a fixed sparse
ternary index vector; its word vector is the sum of the index vectors around all its occurrences in the whole corpus.
The sums of the tasks have a fixed size and are added up in rounds of bounded fan-in. A document is the mean and the
spread of its tokens' vectors, and how far neighbouring tokens' vectors agree; a two-layer network in numpy is trained on a bounded sample of labelled rows, and a
temperature fitted on rows kept out of training calibrates it.

Defined cases: a null or empty text has the zero vector and still gets a score; labels that are null are not learned; several
labels of a document count as the lowest; without labels of both kinds every score is the share of label 1, or 0.5;
repeated rows are scored one by one, equal texts alike; a very long text is read whole and pooled to one vector; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import each_batch, fold, joined, list_array, lower_ascii, span_hashes, stash, table, texts_as_bytes

BITS, WIDTH, WINDOW, FAN_IN = 12, 32, 2, 64
FEATURES = 4 * WIDTH
_KIND = np.full(256, 3, np.uint8)  # punctuation and symbols
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The row of each token and the number of its text."""
    data, starts = joined(texts)
    kind = _KIND[data]
    edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)])) if len(data) else np.zeros(1, np.int64)
    begin, end = edge[:-1], edge[1:]
    real = kind[begin] > 0
    begin, end = begin[real], end[real]
    rows = (span_hashes(lower_ascii(data), begin, end) >> np.uint64(64 - BITS)).astype(np.int64)
    upper = (data[begin] >= 65) & (data[begin] <= 90) & (data[end - 1] >= 65) & (data[end - 1] <= 90) & (end - begin > 1)
    rows[upper] ^= 1  # words in capitals are other words
    return rows, np.searchsorted(starts, begin, side="right") - 1


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two positions and signs for each row."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (2, 1 << BITS)), rng.choice([-1.0, 1.0], (2, 1 << BITS))


def tree_sum(parts: DataFrame, tasks: int) -> DataFrame:
    """Adds up the arrays of (chunk, task, total) by chunk, in rounds that give no task more than FAN_IN arrays."""
    kind, schema = pa.schema([("chunk", pa.int32()), ("task", pa.int64()), ("total", pa.list_(pa.float64()))]), "chunk int, task long, total array<double>"

    def add(got: pa.Table) -> pa.Table:
        flat = got.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = flat.reshape(got.num_rows, -1).sum(axis=0)
        return pa.Table.from_arrays([got.column("chunk").slice(0, 1), pc.floor(pc.divide(got.column("task").slice(0, 1), FAN_IN)).cast(pa.int64()), pa.chunked_array([list_array(total, [len(total)], pa.float64())])], schema=kind)

    while tasks > 1:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / FAN_IN).alias("of")).applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    return parts


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vector of each row, from every text of docs (text)."""
    places, signs = index_vectors()
    chunks, size = 16, (1 << BITS) * WIDTH

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * 4e6 / max(batch.nbytes, 1)) + 1))
            for at in range(0, batch.num_rows, step):
                rows, doc = tokens(texts_as_bytes(batch.column(0).slice(at, step)))
                for gap in range(1, WINDOW + 1):
                    same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
                    left, right = rows[: len(same)][same], rows[gap:][: len(same)][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(2):
                            total += np.bincount(a * WIDTH + places[k][b], weights=signs[k][b], minlength=size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks), pa.int32()), pa.array(np.full(chunks, part), pa.int64()), list_array(total, np.full(chunks, size // chunks), pa.float64())], names=["chunk", "task", "total"])

    texts = docs.select("text")
    sums = tree_sum(texts.mapInArrow(count, "chunk int, task long, total array<double>"), texts.rdd.getNumPartitions())
    vectors = np.zeros((chunks, size // chunks))
    for r in sums.collect():  # always 16 rows
        vectors[r["chunk"]] = r["total"]
    vectors = vectors.reshape(1 << BITS, WIDTH)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's tokens, and the mean product with the next and the second next token's."""
    rows, doc = tokens(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    if len(rows):
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        n = np.diff(np.concatenate((at, [len(doc)])))[:, None]
        v = vectors[rows]
        mean = np.add.reduceat(v, at, axis=0) / n
        out[doc[at], :WIDTH] = mean
        out[doc[at], WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / n - mean * mean, 0))
        for gap in (1, 2):
            near = np.zeros_like(v)
            near[:-gap] = v[:-gap] * v[gap:] * (doc[:-gap] == doc[gap:])[:, None]
            out[doc[at], (gap + 1) * WIDTH : (gap + 2) * WIDTH] = np.add.reduceat(near, at, axis=0) / n
    return out


class Network:
    """Two layers with tanh between, on standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.a, self.b = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden)
        self.c, self.d = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.temperature = 1.0
        out = np.arange(len(y)) % 5 == 4
        if len(set(y[out])) < 2:
            out[:] = False
        tx, ty = (x[~out] - self.mean) / self.scale, y[~out]
        params = [self.a, self.b, self.c, self.d]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(ty))
            for at in range(0, len(order), 64):
                i = order[at : at + 64]
                h = np.tanh(tx[i] @ self.a + self.b)
                g = (1 / (1 + np.exp(-(h @ self.c + self.d))) - ty[i]) / len(i)
                back = np.outer(g, self.c) * (1 - h * h)
                grads = [tx[i].T @ back + 1e-4 * self.a, back.sum(axis=0), h.T @ g + 1e-4 * self.c, g.sum(keepdims=True)]
                t += 1
                for k, (p, q) in enumerate(zip(params, grads)):
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    p -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        raw, truth = (self.logit(x[out]), y[out]) if out.any() else (self.logit(x), y)
        grid = np.geomspace(0.3, 10, 60)
        loss = [np.mean(np.logaddexp(0, raw / s) - truth * raw / s) for s in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.a + self.b) @ self.c + self.d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_train: int = 6000) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text).

    labels (doc_id, quality): of its rows at most about max_train, chosen by a hash of the id, are learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    vectors = word_vectors(docs)
    arrow = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def features(cols: dict) -> dict:
        x = pooled(texts_as_bytes(cols["text"]), vectors)
        return {"doc_id": cols["doc_id"], "features": list_array(x.ravel(), np.full(len(x), FEATURES), pa.float32())}

    known = stash(docs.mapInArrow(each_batch(features, arrow, 1000), "doc_id long, features array<float>"))
    truth = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, max_train / max(truth.count(), 1))
    chosen = truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = known.join(chosen, "doc_id").limit(2 * max_train).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    x, y = np.array([r["features"] for r in rows], np.float64), np.array([float(r["quality"] > 0) for r in rows])
    network = Network(x, y) if len(set(y)) == 2 else None
    default = float(y.mean()) if len(y) else 0.5

    def score(cols: dict) -> dict:
        flat = cols["features"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)
        return {"doc_id": cols["doc_id"], "score": network.score(flat) if network else np.full(len(flat), default)}

    return known.mapInArrow(each_batch(score, pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])), "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fold(table(spark, sf_dir, "labels"), 4, 2).filter(~F.col("held_out")).select("doc_id", "quality")
    scores = quality_scores(table(spark, sf_dir, "documents"), labels)
    return fold(scores, 4, 2).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
