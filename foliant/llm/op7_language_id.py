"""Language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text is the average of the embeddings of its hashed byte 3- and 4-grams (lower case, anything that is no letter counts
as a space); a linear softmax over that average gives the language. Embeddings and weights are trained together by
stochastic gradient descent in numpy, on a bounded sample per language; documents outside the sample only get scored. Part
of the sample is kept out of training to fit a temperature and the rejection threshold.

Defined cases: a null text, or one without a letter, gets `und`, score 0, and is rejected; null languages are never
learned; without any labelled row everything is `und`; repeated rows are scored one by one; ties go to the
language first by name; texts of any length are read whole; other columns pass through, but columns named like the results are replaced; ids
that are null are never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import each_batch, fold, joined, pieces, table, unused

BITS, WIDTH = 15, 16
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """The hash bucket of the 3-gram and of the 4-gram that begins at each byte."""
    a = np.concatenate((_FOLD[data], np.full(3, 32, np.uint8))).astype(np.uint32)
    three = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16)
    four = three | a[3:] << np.uint32(24)
    return [(g * np.uint32(m) >> np.uint32(32 - BITS)).astype(np.int32) for g, m in ((three, 2654435761), (four, 2246822519))]


def lowered(texts: list[str | None]) -> list[bytes]:
    return [b" " + (t or "").lower().encode("utf-8", "replace") for t in texts]


class Model(NamedTuple):
    langs: list[str]
    scores: np.ndarray  # of each bucket and language: embedding times weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def logits(texts: list[bytes], scores: np.ndarray, bias: np.ndarray) -> np.ndarray:
    data, starts = joined(texts)
    total = np.zeros((len(texts), scores.shape[1]), np.float64)
    for g in grams(data):
        total += np.add.reduceat(scores[g], starts[:-1], axis=0)
    return total / (2 * np.diff(starts))[:, None] + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list, *, epochs: int = 10, rate: float = 0.3, seed: int = 7) -> Model:
    """rows: (lang, buckets, share of each bucket), sorted so that reruns agree."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    embed, weights, bias = rng.normal(0, 0.5, (1 << BITS, WIDTH)), np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    seen, seen_weights = np.full(1 << BITS, 1e-8), np.full(WIDTH, 1e-8)  # sums of squared gradients, for the step of each row
    data = [(langs.index(lang), np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for lang, b, s in rows]
    kept_out = {i for i in range(len(data)) if i % 5 == 4} if len(data) >= 10 * len(langs) else set()
    order = np.array([i for i in range(len(data)) if i not in kept_out])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(order):
            y, buckets, share = data[i]
            hidden = share @ embed[buckets]
            p = softmax((hidden @ weights + bias)[None])[0]
            p[y] -= 1
            back = weights @ p
            seen_weights += hidden * hidden * (p @ p)
            weights -= step * np.outer(hidden / np.sqrt(seen_weights), p)
            bias -= 0.1 * step * p
            seen[buckets] += share * share * (back @ back)
            embed[buckets] -= (step * share / np.sqrt(seen[buckets]))[:, None] * back
    scores = (embed @ weights).astype(np.float32)
    held = [data[i] for i in sorted(kept_out) or range(len(data))]
    raw = np.array([s @ scores[b] + bias for _, b, s in held])
    truth = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(raw / temperature).max(axis=1)
    right = softmax(raw / temperature).argmax(axis=1) == truth
    low = float(np.quantile(sure[right], 0.001)) if right.any() else 0.0
    return Model(langs, scores, bias, temperature, min(low, 0.5))


def fit(labelled: DataFrame, per_lang: int) -> Model | None:
    """Trains on about `per_lang` rows of each language, chosen by a hash of their id; labelled: doc_id, text, lang."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))])
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def shares(cols: dict) -> dict:
        buckets, counts = [], []
        for text in lowered(cols["text"].to_pylist()):
            found = np.bincount(np.concatenate(grams(np.frombuffer(text + b" ", np.uint8))), minlength=1 << BITS)
            at = np.flatnonzero(found)
            buckets.append(at.astype(np.int32).tobytes())
            counts.append((found[at] / found.sum()).astype(np.float32).tobytes())
        return {"doc_id": cols["doc_id"], "lang": cols["lang"], "buckets": buckets, "share": counts}

    arrow = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("share", pa.binary())])
    rows = chosen.mapInArrow(each_batch(shares, arrow), "doc_id long, lang string, buckets binary, share binary")
    seen = rows.limit(2 * per_lang * len(counts)).collect()
    return train([(r["lang"], r["buckets"], r["share"]) for r in sorted(seen, key=lambda r: (r["doc_id"], r["lang"], len(r["buckets"])))])


def language_verdict(labelled: DataFrame, *, per_lang: int = 400) -> Callable[[Column | str], Column]:
    """A function of a text column that gives (lang_pred, score, rejected), learned from labelled (doc_id, text, lang).

    At most about per_lang rows of each language are learned from. Rejected: no letter, or a calibrated probability below
    the threshold under which hardly any right answer of the kept-out rows lies.
    """
    model = fit(labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()), per_lang)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def verdict(column: pa.Array) -> pa.Array:
        langs, scores, rejected = [], [], []
        for part in pieces(column):
            texts = part.to_pylist()
            read = np.array([bool(t) and _LETTER.search(t) is not None for t in texts])
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and read.any():
                p = softmax(logits(lowered(texts), model.scores, model.bias) / model.temperature)
                lang[read] = np.array(model.langs, object)[p.argmax(axis=1)][read]
                score[read] = p.max(axis=1)[read]
            langs += lang.tolist()
            scores.append(score)
            rejected.append(~read | (score < (model.reject_below if model else 1.0)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(np.concatenate([*rejected, np.zeros(0, bool)]))], names=["lang_pred", "score", "rejected"])

    return verdict


def language_id(docs: DataFrame, labelled: DataFrame, *, per_lang: int = 400) -> DataFrame:
    """Adds lang_pred, score and rejected to each row of docs (text), in place of columns of these names; see language_verdict."""
    name = unused(docs.columns, "verdict")
    found = docs.withColumn(name, language_verdict(labelled, per_lang=per_lang)("text"))
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    return found.select(*[F.col(f"`{c}`") for c in own], *[F.col(name)[c].alias(c) for c in ("lang_pred", "score", "rejected")])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fold(table(spark, sf_dir, "documents"), 5, 0)
    found = language_id(docs.select("doc_id", "held_out", "text"), docs.filter(~F.col("held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score")
