"""Queries over joins and row rules around retrieval, conflicts, summaries and jobs, on the star tables."""

from pyspark.sql import functions as F

from foliant.operators import assembly as A
from foliant.plans.registry import query, table


@query("""SELECT l_orderkey, l_linenumber, o_custkey, c_name AS name, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE p_brand || ' ' || p_name END AS label
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND l_returnflag <> 'R'""")
def retrieval_star(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("version_id"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("section_id"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"))
    kind = F.col("p_size") % 3
    sections = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section_id"), F.when(kind != 0, F.col("p_brand")).alias("number"), F.when(kind != 1, F.col("p_name")).alias("title"))
    return A.retrieval_rows(chunks, versions, documents, sections).select("l_orderkey", "l_linenumber", F.col("document_id").alias("o_custkey"), "name", "label")


@query("WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_suppkey % 40 AS query, l_partkey % 300 AS conflict_id FROM lineitem) SELECT r.query, s.conflict_id, count(DISTINCT chunk_id) AS n FROM c r JOIN c s USING (chunk_id) GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) >= 2")
def shared_conflicts(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").withColumn("chunk_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.shared_conflicts(chunks.select((F.col("l_suppkey") % 40).alias("query"), "chunk_id"), chunks.select("chunk_id", (F.col("l_partkey") % 300).alias("conflict_id")))


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, min(a.l_orderkey) AS conflict_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_partkey = a.l_partkey + 1 GROUP BY 1, 2")
def exact_pairs(spark, sf_dir):
    statements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), F.col("l_partkey").alias("chunk_id"))
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return A.exact_pairs(candidates, statements)


@query("SELECT l_partkey AS chunk_id, max(l_discount) AS similarity, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1")
def best_per_chunk(spark, sf_dir):
    return A.best_per_chunk(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_discount").alias("similarity"), F.col("l_orderkey").alias("seen")))


@query("SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median FROM documents GROUP BY 1")
def upper_median(spark, sf_dir):
    return A.upper_median(table(spark, sf_dir, "documents").select("source", "n_chars"), "source", "n_chars")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT doc_id, source FROM r WHERE n <= 7 OR pos IN (SELECT i * n // 7 FROM range(7) t(i))""")
def even_sample(spark, sf_dir):
    return A.even_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 7)


@query("SELECT event_id, round(greatest(0.5::DOUBLE, 1 - (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.00005::DOUBLE), 6) AS relevance FROM events")
def positional_relevance(spark, sf_dir):
    return A.positional_relevance(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "relevance")


@query("SELECT m.o_custkey AS message_id, m.o_orderkey AS place, arg_min(s.o_orderkey, s.o_orderkey) AS claim FROM orders m JOIN orders s ON s.o_custkey = m.o_custkey AND m.o_orderkey BETWEEN s.o_orderkey AND s.o_orderkey + 500 GROUP BY 1, 2")
def claim_of_marker(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    markers = orders.select(F.col("o_custkey").alias("message_id"), F.col("o_orderkey").alias("place"))
    spans = orders.select(F.col("o_custkey").alias("message_id"), F.col("o_orderkey").alias("claim"), F.col("o_orderkey").alias("begin"), (F.col("o_orderkey") + 500).alias("end"))
    return A.claim_of_marker(markers, spans)


_JOBS = "jobs AS (SELECT o_custkey AS document_id, o_orderkey AS job_id, CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CAST(o_orderkey % 130 - 10 AS INT) AS progress, o_orderdate AS day FROM orders)"


def jobs(spark, sf_dir):
    kind = F.col("o_orderkey") % 9
    status = F.when(kind == 0, "PENDING").when(kind == 1, "PROCESSING").when(kind.isin(2, 3), "FAILED").otherwise("COMPLETED")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_orderkey") % 130 - 10).cast("int").alias("progress"), F.col("o_orderdate").alias("at"))


@query(f"""WITH {_JOBS}, l AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY status IN ('PENDING', 'PROCESSING') DESC, day DESC, job_id DESC) AS n FROM jobs)
 SELECT c_custkey AS document_id, coalesce(l.status, CASE WHEN c_acctbal > 5000 THEN 'READY' ELSE 'UPLOADED' END) AS status, CASE WHEN c_acctbal > 5000 THEN 100 ELSE greatest(0, least(100, coalesce(progress, 0))) END AS progress
 FROM customer LEFT JOIN l ON l.document_id = c_custkey AND n = 1""")
def job_progress(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") > 5000, "READY").otherwise("UPLOADED").alias("status"))
    return A.job_progress(jobs(spark, sf_dir), documents)


@query(f"WITH {_JOBS} SELECT document_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY day DESC, job_id DESC) AS n FROM jobs WHERE status = 'FAILED') WHERE n = 1 AND document_id NOT IN (SELECT document_id FROM jobs WHERE status IN ('PENDING', 'PROCESSING'))")
def retryable_jobs(spark, sf_dir):
    return A.retryable(jobs(spark, sf_dir)).select("document_id", "job_id")


@query(f"WITH {_JOBS} SELECT c_custkey AS org FROM customer WHERE c_custkey NOT IN (SELECT document_id FROM jobs WHERE status IN ('PENDING', 'PROCESSING'))")
def scan_due(spark, sf_dir):
    return A.scan_due(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org")), jobs(spark, sf_dir).select(F.col("document_id").alias("org"), "status"))


@query("SELECT o_orderkey AS version_id, coalesce((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) > o_orderdate + INTERVAL 60 DAY, false) AS stale FROM orders")
def stale_summaries(spark, sf_dir):
    summaries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("summarized_at"))
    chunked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_shipdate").alias("chunked_at"))
    return A.stale_summaries(summaries, chunked).select("version_id", "stale")


@query("SELECT doc_id FROM documents WHERE doc_id > 120")
def resumed_documents(spark, sf_dir):
    return A.resumed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 120)


@query("SELECT CASE WHEN c_custkey IS NOT NULL THEN 'succeeded' ELSE 'failed' END AS outcome, count(*) AS n FROM (SELECT o_custkey + 40 AS id FROM orders) a LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) c ON c_custkey = id GROUP BY 1")
def bulk_outcomes(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, F.lit("2025-01-01").cast("timestamp")).alias("deleted_at"))
    return A.bulk_outcomes(table(spark, sf_dir, "orders").select((F.col("o_custkey") + 40).alias("document_id")), documents)


@query("""SELECT n_nationkey, 'event: status' || chr(10) || 'data: {"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10) || chr(10) AS frame FROM nation""")
def event_frames(spark, sf_dir):
    return A.frames(table(spark, sf_dir, "nation"), "status", ["n_nationkey", "n_name"]).select("n_nationkey", "frame")
