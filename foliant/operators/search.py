"""Retrieval: vector and keyword branches, fusion, reranking and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X


def semantic_topk(chunks: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score (rounded to 6 places) and rank of the k chunks nearest to query; ties by key."""
    scored = chunks.select(key, F.round(X.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def bm25(docs: DataFrame, query: list[str], *, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the documents that hold a query term (ASCII letters and digits). One pass counts terms, one row of totals is joined back."""
    low = F.lower("text")
    counted = docs.select(key, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("length"), *[F.regexp_count(low, F.lit(f"(?<![a-z0-9]){q}(?![a-z0-9])")).alias(f"tf{i}") for i, q in enumerate(query)])
    sums = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    joined = counted.join(F.broadcast(sums))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    score = sum((part(i) for i in range(len(query))), F.lit(0.0))
    return joined.select(key, F.round(score, 6).alias("score")).filter("score > 0")


def ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(vector: DataFrame, keyword: DataFrame, *, key: str, k: int = 60, limit: int = 30) -> DataFrame:
    """Both ranked lists by reciprocal rank; ties keep the vector list's order, then the keyword list's."""
    v, w = vector.select(key, F.col("rank").alias("vector_rank")), keyword.select(key, F.col("rank").alias("keyword_rank"))
    fused = v.join(w, key, "full_outer").withColumn("fused", F.round(X.rrf(F.col("vector_rank"), F.col("keyword_rank"), k=k), 8))
    order = [F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col(key)]
    return fused.orderBy(*order).limit(limit)


def min_max_by(scored: DataFrame, group: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group)
    return scored.withColumn("normal", F.round(X.min_max(F.col(value), F.min(value).over(w), F.max(value).over(w)), 6))


def to_unit(scored: DataFrame, group: list[str], value: str) -> DataFrame:
    """Scores already within 0 and 1 stay; otherwise the sigmoid of all scores of the group."""
    inside = F.bool_and(F.col(value).between(0, 1)).over(Window.partitionBy(*group))
    return scored.withColumn("unit", F.round(F.when(inside, F.col(value)).otherwise(1 / (1 + F.exp(-F.col(value)))), 6))


def rerank(docs: DataFrame, query: str, *, key: str, least: float | None = 0.35, limit: int = 10) -> DataFrame:
    scored = docs.select(key, F.round(X.lexical_overlap(F.lit(query), F.col("text")), 6).alias("score"))
    return ranked(scored if least is None else scored.filter(F.col("score") >= least), limit, key)


def nearest_of_others(queries: DataFrame, vectors: DataFrame, k: int, *, block: int = 2000) -> DataFrame:
    """vec_id, other_id, score, rank: for each query its k nearest among vectors of other labels, exact, ties by id.

    queries are a stated set, such as the statements of one new version. They are dealt into blocks of about `block` rows, and so are the vectors;
    each pair of blocks is one matrix product that keeps k rows a query, and a window joins the blocks' results. Up to `block`
    queries, every vector is shuffled once; beyond, once for each block of queries. Zero vectors and null ids are near nothing.
    """

    def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
        n = max(1, -(-rows.count() // block))
        return rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n))), n

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    (asked, many), (held, parts) = dealt(queries), dealt(vectors)
    left = asked.select(F.col("part").alias("i"), every(parts).alias("j"), "vec_id", "label", "v")
    right = held.select(every(many).alias("i"), F.col("part").alias("j"), "vec_id", "label", "v")
    schema = pa.schema([("vec_id", pa.int64()), ("other_id", pa.int64()), ("score", pa.float64())])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("vec_id")
        x, y = (np.array(t.column("v").to_pylist()) for t in (a, b))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        score = np.round(x @ y.T, 6)
        score[a.column("label").to_numpy()[:, None] == b.column("label").to_numpy()] = -np.inf
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(score, at, axis=1)
        ids = np.repeat(a.column("vec_id").to_numpy(), at.shape[1])
        keep = np.isfinite(found.ravel())
        return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(b.column("vec_id").to_numpy()[at.ravel()][keep]), pa.array(found.ravel()[keep])], schema=schema)

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "vec_id long, other_id long, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "other_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def candidate_pairs(queries: DataFrame, vectors: DataFrame, *, k: int = 5, least: float = 0.83) -> DataFrame:
    """a < b, score and rank: a is a query and b among its k nearest; of an unordered pair only the direction from the smaller id counts, after the cut."""
    near = nearest_of_others(queries, vectors, k).filter((F.col("score") >= least) & (F.col("other_id") > F.col("vec_id")))
    return near.select(F.col("vec_id").alias("a"), F.col("other_id").alias("b"), "score", "rank")


def search(chunks: DataFrame, query: str, vector: list[float], matched: DataFrame, *, mode: str = "hybrid", top_k: int = 10, key: str = "doc_id", branch: int = 50, candidates: int = 30, least: float = 0.35, most: int = 50) -> DataFrame:
    """key, relevance and place: the search in one of three modes over chunks (key, text, embedding) that the caller's scope left.

    matched: key and rank of the keyword branch over the same chunks. hybrid: the best `branch` of both branches, fused, the first `candidates` reranked by lexical overlap; those under
    `least` go. semantic: the vector branch, reranked likewise. keyword: that branch alone, its ranks between 0 and 1. An unknown mode is hybrid, a blank query finds
    nothing, and no more than `most` rows are returned. Reranked ties keep the order they came in.
    """
    if not query.strip():
        return chunks.select(key, F.lit(0.0).alias("relevance"), F.lit(0).alias("place")).filter(F.lit(False))
    limit = min(top_k, most)
    words = matched.orderBy(F.desc("rank"), key).limit(branch)
    order = Window.orderBy(F.desc("relevance"), "_at")
    if mode.lower() == "keyword":
        spread = X.min_max(F.col("rank"), F.min("rank").over(Window.partitionBy()), F.max("rank").over(Window.partitionBy()))
        found = words.select(key, F.round(spread, 6).alias("relevance"), F.row_number().over(Window.orderBy(F.desc("rank"), key)).alias("_at"))
    else:
        near = semantic_topk(chunks, vector, branch, key=key, vector="embedding")
        if mode.lower() == "semantic":
            pool = near.select(key, F.col("rank").alias("_at"))
        else:
            fused = fuse(near, words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank"), key))), key=key, limit=candidates)
            by = [F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col(key)]
            pool = fused.select(key, F.row_number().over(Window.orderBy(*by)).alias("_at"))
        text = chunks.join(F.broadcast(pool), key)  # at most `branch` rows
        found = text.select(key, "_at", F.round(X.lexical_overlap(F.lit(query), F.col("text")), 6).alias("relevance")).filter(F.col("relevance") >= least)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(key, "relevance", "place")
