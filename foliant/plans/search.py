"""Search queries over embeddings and documents."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import finding, keyword
from foliant.operators import search as S
from foliant.operators import vectors as V
from foliant.operators.compare import shared_folder
from foliant.plans.registry import query, table

TERMS, QUESTION = ["the", "that", "with"], "the that with which tion"
_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_BM25 = """bm AS (
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM (
    SELECT doc_id, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS length, avg(len(t)) OVER (PARTITION BY term) AS mean,
           count(*) OVER (PARTITION BY term) AS n, count(*) FILTER (list_contains(t, term)) OVER (PARTITION BY term) AS df
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), (VALUES ('the'), ('that'), ('with')) v(term))
  GROUP BY doc_id HAVING round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) > 0)"""


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def vector_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 50)


def keyword_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(S.bm25(table(spark, sf_dir, "documents"), TERMS), 50, "doc_id")


@query(f"SELECT vec_id, {_COS} AS score, CAST(row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS INT) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    return S.semantic_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10)


@query(f"SELECT vec_id, {_COS} AS score, CAST(row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS INT) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label IN (1, 2, 3, 5, 8) ORDER BY score DESC, vec_id LIMIT 10")
def semantic_topk_scoped(spark, sf_dir):
    return S.semantic_topk(table(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 2, 3, 5, 8)), first_vector(spark, sf_dir), 10)


@query(f"WITH {_BM25} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def keyword_topk(spark, sf_dir):
    return keyword_branch(spark, sf_dir)


_FUSED = f"""WITH {_BM25}, k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS keyword_rank FROM bm ORDER BY score DESC, doc_id LIMIT 50),
 v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS vector_rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, vec_id LIMIT 50)
 SELECT id, CAST(vector_rank AS INT) AS vector_rank, CAST(keyword_rank AS INT) AS keyword_rank, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 8) AS fused
 FROM v FULL JOIN k USING (id) ORDER BY fused DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id LIMIT 30"""


@query(_FUSED)
def hybrid_rrf(spark, sf_dir):
    vector, keyword = vector_branch(spark, sf_dir), keyword_branch(spark, sf_dir)
    return S.fuse(vector.withColumnRenamed("vec_id", "id"), keyword.withColumnRenamed("doc_id", "id"), key="id")


@query(f"WITH {_BM25} SELECT doc_id, score, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS normal, round(1 / (1 + exp(-score)), 6) AS unit FROM bm")
def score_normalising(spark, sf_dir):
    scored = S.bm25(table(spark, sf_dir, "documents"), TERMS).withColumn("query", F.lit(1))
    return S.to_unit(S.min_max_by(scored, ["query"], "score"), ["query"], "score").drop("query")


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT doc_id, round(len(list_intersect(['the', 'that', 'with', 'which', 'tion'], {_WORDS})) / 5.0::DOUBLE, 6) AS score FROM documents) WHERE score >= 0.35 ORDER BY score DESC, doc_id LIMIT 10")
def lexical_rerank(spark, sf_dir):
    return S.rerank(table(spark, sf_dir, "documents"), QUESTION, key="doc_id")


#: The vectors, and for each a near one of another label: every component moved a little.
_TWINS = """twins AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings UNION ALL
 SELECT vec_id + 1000000, label + 1, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + ((vec_id * 7 + i) % 5 - 2) / 4.0::DOUBLE)) FROM embeddings)"""
NEAR_PAIRS = f"""WITH {_TWINS}, s AS (SELECT a.vec_id AS q, b.vec_id AS o, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM twins a JOIN twins b ON a.label <> b.label WHERE a.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, o) AS n FROM s), near AS (SELECT q AS a, o AS b, score, CAST(n AS INT) AS rank FROM r WHERE n <= 5 AND score >= 0.83 AND o > q)"""


def twins(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = F.transform("embedding", lambda x, i: x * (1 + ((F.col("vec_id") * 7 + i + 1) % 5 - 2) / 4))
    return vectors.unionByName(vectors.select((F.col("vec_id") + 1000000).alias("vec_id"), (F.col("label") + 1).alias("label"), moved.alias("embedding")))


def near_pairs(spark, sf_dir):
    vectors = twins(spark, sf_dir)
    return S.candidate_pairs(vectors.filter("vec_id % 100 = 0"), vectors)


@query(f"{NEAR_PAIRS} SELECT * FROM near")
def similar_pairs_topk(spark, sf_dir):
    return near_pairs(spark, sf_dir)


@query(f"{NEAR_PAIRS} SELECT * FROM near")
def indexed_pairs(spark, sf_dir):
    """similar_pairs_topk by the stored index: a third of its cells are probed, and all of them where that leaves an answer uncertain."""
    vectors = twins(spark, sf_dir)
    index = V.build(vectors, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", cells=24)
    near = V.exact_by_index(index, vectors.filter("vec_id % 100 = 0"), 5, probes=8)
    return near.filter("score >= 0.83 AND other_id > vec_id").select(F.col("vec_id").alias("a"), F.col("other_id").alias("b"), "score", "rank")


SENTENCE = "ing tions of er"


def scoped_chunks(spark, sf_dir):
    """Documents of five sources with the vector of their number."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src1", "src2", "src3", "src5"))
    return docs.select("doc_id", "text").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def search_in(spark, sf_dir, mode):
    chunks = scoped_chunks(spark, sf_dir)
    parsed = keyword.parse(spark, SENTENCE)
    return S.search(chunks, SENTENCE, first_vector(spark, sf_dir), keyword.matches(keyword.postings(chunks), parsed), mode=mode, top_k=20)


def _search_sql(mode: str) -> str:
    from foliant.plans.keyword import _WORDS, _all

    terms = ["er", "ing", "tion"]
    lists = ", ".join(f"max(positions) FILTER (term = '{t}') AS t{i}" for i, t in enumerate(terms))
    overlap = f"round(len(list_intersect(['ing', 'tions', 'of', 'er'], {_WORDS_OF_TEXT})) / 4.0::DOUBLE, 6)"
    chunks = "chunks AS (SELECT doc_id, text, embedding::DOUBLE[] AS embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src5'))"
    base = f"""WITH {chunks}, {_WORDS.replace("FROM documents", "FROM chunks")}, held AS (SELECT doc_id, {lists} FROM postings WHERE term IN ('er', 'ing', 'tion') GROUP BY doc_id),
 hits AS (SELECT doc_id, {_all(terms)} AS rank FROM held WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t2 IS NOT NULL ORDER BY rank DESC, doc_id LIMIT 50),
 near AS (SELECT doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(c.embedding, q.embedding::DOUBLE[]), 6) DESC, doc_id) AS r FROM chunks c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r <= 50),"""
    if mode == "keyword":
        return base + """ n AS (SELECT doc_id, row_number() OVER (ORDER BY rank DESC, doc_id) AS at_no, round(CASE WHEN max(rank) OVER () = min(rank) OVER () THEN 1 ELSE (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()) END, 6) AS relevance FROM hits)
 SELECT doc_id, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, at_no) AS INT) AS place FROM n ORDER BY place LIMIT 20"""
    pool = "pool AS (SELECT doc_id, r AS at_no FROM near)" if mode == "semantic" else """k AS (SELECT doc_id, row_number() OVER (ORDER BY rank DESC, doc_id) AS r FROM hits),
 pool AS (SELECT doc_id, row_number() OVER (ORDER BY round(coalesce(1.0::DOUBLE / (60 + near.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0), 8) DESC, near.r NULLS LAST, k.r NULLS LAST, doc_id) AS at_no FROM near FULL JOIN k USING (doc_id) QUALIFY at_no <= 30)"""
    return base + f""" {pool}, scored AS (SELECT doc_id, at_no, {overlap} AS relevance FROM pool JOIN chunks USING (doc_id))
 SELECT doc_id, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, at_no) AS INT) AS place FROM scored WHERE relevance >= 0.35 ORDER BY place LIMIT 20"""


_WORDS_OF_TEXT = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(_search_sql("hybrid"))
def search_hybrid(spark, sf_dir):
    return search_in(spark, sf_dir, "unknown")


@query(_search_sql("semantic"))
def search_semantic(spark, sf_dir):
    return search_in(spark, sf_dir, "semantic")


@query(_search_sql("keyword"))
def search_keyword(spark, sf_dir):
    return search_in(spark, sf_dir, "KEYWORD")


_TERMS = ["Tion ", "the of", "ing", "É", "ein", "erer", "thnt", "x", "la ou", " nd", "er. T"]


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT DISTINCT lower(trim(x)) AS term FROM unnest([{", ".join(f"'{t}'" for t in _TERMS)}]) u(x))
 SELECT doc_id, term, (len(t) - len(replace(t, term, ''))) // len(term) AS hits, CAST(strpos(t, term) - 1 AS BIGINT) AS first FROM t JOIN p ON contains(t, term)""")
def text_finds(spark, sf_dir):
    hits = finding.find_terms(table(spark, sf_dir, "documents"), _TERMS)
    return hits.groupBy("doc_id", "term").agg(F.count("*").alias("hits"), F.min("begin").alias("first"))
