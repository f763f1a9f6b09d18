"""Recall of near vectors in 64 dimensions, very long texts and equal texts through the scoring operators, a classifier's sums by hand."""

import re

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import op2_embedding_dedup, op4_quality_rules, op5_toxicity, op10_quality_classifier

DATA = "/root/testdata/sf0.01"


def test_near_vectors_are_found_in_64_dimensions(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(1200, 64))
    side -= (side * base[:1200]).sum(axis=1, keepdims=True) * base[:1200]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.95, 1200)[:, None]
    x = np.concatenate([base, cosine * base[:1200] + np.sqrt(1 - cosine**2) * side])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in op2_embedding_dedup.embedding_components(rows).collect()}
    want = linked.sum(axis=1)
    assert want.sum() > 1000 and all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.95 * want.sum()
    assert op2_embedding_dedup.embedding_components(rows.limit(0)).count() == 0


LONG = "the quick brown fox. " * 40_000 + " ".join(f"word{i}" for i in range(60_000))


def test_long_and_equal_texts_are_measured_alike(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "short text"), (3, LONG), (None, "short text")], "doc_id long, text string")
    rows = [r.asDict() for r in op4_quality_rules.suffix_array_rules(docs).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["n_words"], []).append({k: v for k, v in r.items() if k != "doc_id"})
    assert len(rows) == 4 and all(x == group[0] for group in by.values() for x in group)
    long = by[220_000][0]
    assert long["longest_repeat"] == 159_996 and long["covered_words"] == 160_000 and long["base_failed"] and not long["kept"]


def test_long_and_equal_texts_are_scored_alike(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = spark.createDataFrame([(10**6, LONG), (10**6 + 1, LONG), (10**6 + 2, None), (10**6 + 3, "")], "doc_id long, text string")
    every = docs.unionByName(odd)
    quality = {r["doc_id"]: r["score"] for r in op10_quality_classifier.quality_scores(every, labels).filter("doc_id >= 1000000").collect()}
    labelled = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    scored = op5_toxicity.classifier_chain(every, labelled, ["toxic"]).filter("doc_id >= 1000000")
    kind = [c for c, t in scored.dtypes if t == "double"][0]
    toxic = {r["doc_id"]: r[kind] for r in scored.collect()}
    for scores in (quality, toxic):
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores.values())
        assert np.isclose(scores[10**6], scores[10**6 + 1], rtol=1e-9) and np.isclose(scores[10**6 + 2], scores[10**6 + 3], rtol=1e-9)


def test_tokens_and_word_sets_are_those_of_plain_patterns():
    texts = ["One two, two 33!!", "", "Ünï x_y\nx"]
    ids, docs = op10_quality_classifier.tokens([t.encode() for t in texts])
    assert len(ids) == len(docs) and set(docs.tolist()) == {0, 2}
    flat, many = op5_toxicity.word_sets([*texts, None])
    weights = np.arange(flat.max() + 1, dtype=float)
    total = op5_toxicity.sums(flat, many, weights)
    at = np.concatenate(([0], np.cumsum(many)))
    assert np.allclose(total, [weights[flat[a:b]].sum() for a, b in zip(at, at[1:])]) and many[1] == many[3] == 0
    assert many[0] > 0 and len(set(flat[: many[0]])) == many[0] and re.findall(r"\w+", texts[0])


def test_kinds_of_toxic_rows_are_their_clusters():
    rng = np.random.default_rng(2)
    rows, kind = [], []
    for i in range(600):
        k = 0 if i % 3 == 0 else 1 if i % 3 == 1 else None
        words = {f"plain{w}" for w in rng.integers(0, 60, 20)} | ({f"insult{w}" for w in rng.integers(0, 6, 4)} if k == 0 and i % 2 else set()) | ({f"threat{w}" for w in rng.integers(0, 6, 4)} if k == 1 else set())
        rows.append(" ".join(sorted(words)))
        kind.append(0 if k == 0 and i % 2 else 1 if k == 1 else None)
    flat, sizes = op5_toxicity.word_sets(rows)
    y = np.array([float(k is not None) for k in kind])
    got = op5_toxicity.kinds_of(flat, sizes, y, 2)
    assert (got.sum(axis=1) == y).all()
    groups = [{kind[i] for i in np.flatnonzero(got[:, c])} for c in range(2)]
    assert groups == [{1}, {0}]  # the larger kind first
    assert not op5_toxicity.kinds_of(flat, sizes, np.zeros(600), 2).any() and not op5_toxicity.kinds_of(flat[:0], sizes[:0], y[:0], 2).any()
