"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it.

A document is the set of its hashed lower-case words and their beginnings. The categories are learned in the given order; the linear model of
a category sees the words and the earlier categories' probabilities. In training these are out-of-fold predictions, so a
later model learns from probabilities as uncertain as those it gets for new documents. Training uses a bounded sample of
labelled rows; every document is scored. Where labels name one category only, the earlier ones are its kinds: clusters of its rows by the words that are far
more frequent in them.

Defined cases: a null or empty text is the empty set and gets the intercepts; labels that are null are not learned; several labels of a
document count as the highest; a category without both kinds of label has its base rate for all, 0 without labels; repeated rows are
scored one by one, equal texts alike; a very long text is read whole, as a set it is no larger than its different words; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import each_batch, fold, list_array, table

BITS = 18
_WORD = re.compile(r"[^\W\d_]+")

PREFIXES = (3, 4, 5, 6)
_SEEN: dict[str, tuple[int, ...]] = {}


def buckets(word: str) -> tuple[int, ...]:
    """The bucket of the word and of its beginnings, which catch inflected forms never seen in training."""
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple(crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts)


def word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text, flat, and how many each text has."""
    flat, sizes = [], []
    for t in texts:
        found: set[int] = set()
        for w in set(_WORD.findall((t or "").lower())):
            known = _SEEN.get(w)
            if known is None:
                if len(_SEEN) >= 300_000:
                    _SEEN.clear()
                known = _SEEN[w] = buckets(w)
            found.update(known)
        flat.extend(sorted(found))
        sizes.append(len(found))
    return np.array(flat, np.int64), np.array(sizes, np.int64)


def sums(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over each row's buckets."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc, weights=weights[flat], minlength=len(sizes))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Linear:
    """Logistic regression on bucket sets and a few dense inputs, by full-batch Adam with an L2 penalty.

    Only buckets in at least `least` rows whose share among the positive rows lies `least_z` deviations off get a weight.
    """

    def __init__(self, flat, sizes, dense, y, *, steps: int = 250, least: int = 5, least_z: float = 4.0):
        self.words, self.dense, self.base = np.zeros(1 << BITS), np.zeros(dense.shape[1]), 0.0
        rate = y.mean() if len(y) else 0.0
        self.base = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
        if not 0 < rate < 1:
            return
        doc = np.repeat(np.arange(len(sizes)), sizes)
        share = np.bincount(flat, minlength=1 << BITS) / len(y)
        shown = np.bincount(flat, weights=y[doc], minlength=1 << BITS)
        spread = np.sqrt(y.sum() * share * (1 - share)) + 1e-9
        telling = (share * len(y) >= least) & (np.abs(shown - y.sum() * share) >= least_z * spread)
        kept = telling[flat]
        doc = doc[kept]
        used, column = np.unique(flat[kept], return_inverse=True)
        weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
        params = [np.zeros(len(used)), np.zeros(dense.shape[1]), np.array([self.base])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            z = np.bincount(doc, weights=params[0][column], minlength=len(y)) + dense @ params[1] + params[2]
            g = weight * (sigmoid(z) - y) / len(y)
            grads = [np.bincount(column, weights=g[doc], minlength=len(used)) + 1e-4 * params[0], dense.T @ g, np.array([g.sum()])]
            for k, q in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                params[k] -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.words[used], self.dense, self.base = params[0], params[1], float(params[2][0])

    def predict(self, flat, sizes, dense) -> np.ndarray:
        return sigmoid(sums(flat, sizes, self.words) + dense @ self.dense + self.base)


def telling(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, least_z: float = 4.0, least: int = 5) -> np.ndarray:
    """Buckets that rows with y have far more often than chance would give them."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    share = np.bincount(flat, minlength=1 << BITS) / max(len(y), 1)
    shown = np.bincount(flat, weights=y[doc], minlength=1 << BITS)
    spread = np.sqrt(y.sum() * share * (1 - share)) + 1e-9
    return np.flatnonzero((share * len(y) >= least) & (shown - y.sum() * share >= least_z * spread))


def kinds_of(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, kinds: int, rounds: int = 20) -> np.ndarray:
    """A 0/1 column for each kind of the rows with y: clusters by cosine of their telling buckets, the largest first; no kinds where nothing tells them apart.

    The first centre is the rows' mean direction, each next one the row farthest from those before it, so reruns agree.
    """
    out = np.zeros((len(y), kinds))
    words, rows = telling(flat, sizes, y) if kinds else [], np.flatnonzero(y > 0)
    if not len(words) or len(rows) < 2 * kinds:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.full(1 << BITS, -1)
    place[words] = np.arange(len(words))
    x = np.zeros((len(y), len(words)), np.float32)
    seen = place[flat] >= 0
    x[doc[seen], place[flat[seen]]] = 1
    x = x[rows]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x.mean(axis=0, keepdims=True)
    while len(centres) < kinds:
        centres = np.vstack((centres, x[np.argmin((x @ centres.T).max(axis=1))]))
    for _ in range(rounds):
        of = (x @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).T).argmax(axis=1)
        centres = np.stack([x[of == k].mean(axis=0) if (of == k).any() else centres[k] for k in range(kinds)])
    for column, k in enumerate(sorted(range(kinds), key=lambda k: (-(of == k).sum(), k))):
        out[rows[of == k], column] = 1
    return out


def train_chain(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, folds: int = 4) -> list[Linear]:
    """One model per column of labels; the inputs from earlier categories are out-of-fold predictions."""
    n, chain = len(sizes), []
    dense, fold_of = np.zeros((n, 0)), np.arange(n) % folds
    ends = np.cumsum(sizes)

    def part(rows):
        return np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in rows] or [flat[:0]]), sizes[rows]

    for y in labels.T:
        out = np.zeros(n)
        for k in range(folds):
            rest, own = np.flatnonzero(fold_of != k), np.flatnonzero(fold_of == k)
            out[own] = Linear(*part(rest), dense[rest], y[rest]).predict(*part(own), dense[own])
        chain.append(Linear(flat, sizes, dense, y))
        dense = np.column_stack((dense, out))
    return chain


def classifier_chain(docs: DataFrame, labelled: DataFrame, categories: list[str], *, kinds: int = 0, max_train: int = 5000) -> DataFrame:
    """doc_id and a probability p_<category> for every row of docs (doc_id, text).

    labelled: doc_id, text and a 0/1 column for each category. About max_train of its rows at most, chosen by a hash of
    the id, are learned from. kinds: so many kinds of the last category's rows come first in the chain, as categories kind_1, kind_2 and so on.
    """
    given, categories = categories, [f"kind_{k + 1}" for k in range(kinds)] + categories
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = labelled.select(F.col("doc_id").cast("long"), "text", F.array(*[F.col(c).cast("double") for c in given]).alias("y"))
    share = min(1.0, max_train / max(labelled.filter(F.col("doc_id").isNotNull()).count(), 1))
    known = known.filter(F.col("doc_id").isNotNull() & ~F.exists("y", lambda x: x.isNull()))
    arrow = pa.schema([("doc_id", pa.int64()), ("y", pa.list_(pa.float64())), ("words", pa.list_(pa.int32()))])

    def sets(cols: dict) -> dict:
        flat, sizes = word_sets(cols["text"].to_pylist())
        return {"doc_id": cols["doc_id"], "y": cols["y"], "words": list_array(flat, sizes, pa.int32())}

    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.mapInArrow(each_batch(sets, arrow), "doc_id long, y array<double>, words array<int>").limit(2 * max_train).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"], r["y"]))
    flat = np.array([w for r in rows for w in r["words"]], np.int64)
    sizes, labels = np.array([len(r["words"]) for r in rows], np.int64), np.array([r["y"] for r in rows]).reshape(len(rows), len(given))
    chain = train_chain(flat, sizes, np.column_stack((kinds_of(flat, sizes, labels[:, -1], kinds), labels)))
    out = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in categories)])

    def score(cols: dict) -> dict:
        flat, sizes = word_sets(cols["text"].to_pylist())
        found, dense = {"doc_id": cols["doc_id"]}, np.zeros((len(sizes), 0))
        for c, model in zip(categories, chain):
            found[f"p_{c}"] = model.predict(flat, sizes, dense)
            dense = np.column_stack((dense, found[f"p_{c}"]))
        return found

    return docs.mapInArrow(each_batch(score, out, 2000), ", ".join(["doc_id long", *(f"p_{c} double" for c in categories)]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document. Learns from labels whose crc32(doc_id) modulo 4 is not 2, as the quality query does."""
    docs = table(spark, sf_dir, "documents")
    labels = fold(table(spark, sf_dir, "labels"), 4, 2).filter(~F.col("held_out") & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    found = classifier_chain(docs, docs.select("doc_id", "text").join(labels, "doc_id"), ["toxic"], kinds=2)
    return fold(found, 4, 2).withColumn("toxic_pred", (F.col("p_toxic") >= 0.5).cast("int"))
