"""Scope, version, list, KPI and job queries, with the star tables standing in for the engine's own.

documents: customer (nation = organisation); versions: orders (date = effective date, status P = not ready); audit log and jobs: events.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import catalog, jobs, scope
from foliant.plans.registry import query, table

NOW = "2026-01-01 00:00:00"
DAY = date(1997, 6, 30)
_DOCS = """docs AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS org, c_custkey % 7 AS owner, c_mktsegment AS type,
 CASE c_custkey % 5 WHEN 0 THEN 'organization' WHEN 1 THEN 'private' WHEN 2 THEN 'restricted' WHEN 3 THEN 'organization' ELSE 'secret' END AS access,
 CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status FROM customer)"""
_GRANTS = "grants AS (SELECT o_custkey AS document_id, o_orderkey % 7 AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'admin' ELSE 'none' END AS permission, o_orderkey % 3 AS kind FROM orders)"
_VERSIONS = """versions AS (SELECT o_orderkey AS id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS effective_date, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS expiration_date,
 CASE WHEN o_orderstatus = 'P' THEN 'PROCESSING' ELSE 'READY' END AS status FROM orders)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.element_at(F.array(*map(F.lit, ["organization", "private", "restricted", "organization", "secret"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("org"), (F.col("c_custkey") % 7).alias("owner"), F.col("c_mktsegment").alias("type"),
        levels.alias("access"), F.when(F.col("c_acctbal") < 0, "archived").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["read", "write", "admin", "none"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    expiry = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2020-01-01").cast("timestamp")).when(F.col("o_orderkey") % 3 == 1, F.lit("2099-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 7).alias("user_id"), kind.alias("permission"), expiry.alias("expires_at"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version_number"),
        F.when(F.col("o_orderkey") % 11 != 0, day).alias("effective_date"), F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 400)).alias("expiration_date"),
        F.when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("READY").alias("status"),
    )


@query(f"""WITH {_DOCS}, {_GRANTS} SELECT id, access, owner FROM docs WHERE org = 7 AND status = 'active' AND (access = 'organization' OR (access = 'private' AND owner = 3)
 OR (access = 'restricted' AND (owner = 3 OR id IN (SELECT document_id FROM grants WHERE user_id = 3 AND permission <> 'none' AND kind <> 0))))""")
def access_scope(spark, sf_dir):
    return scope.readable(documents(spark, sf_dir), grants(spark, sf_dir), 7, 3, NOW).select("id", "access", "owner")


@query(f"WITH {_DOCS} SELECT id, access FROM docs WHERE org = 7 AND status = 'active' AND (access = 'organization' OR owner = 3)")
def chat_scope(spark, sf_dir):
    return scope.chat_scope(documents(spark, sf_dir), 7, 3).select("id", "access")


@query(f"WITH {_DOCS} SELECT DISTINCT l_orderkey AS conflict_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN docs ON docs.id = l_suppkey WHERE access = 'private' AND owner <> 3)")
def visible_conflicts(spark, sf_dir):
    statements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), F.col("l_suppkey").alias("document_id"))
    return scope.visible_conflicts(statements, documents(spark, sf_dir), 3)


@query(f"WITH {_DOCS} SELECT id, type FROM docs WHERE type IN ('BUILDING', 'MACHINERY') AND owner = 2 AND id IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def metadata_filters(spark, sf_dir):
    members = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("document_id"))
    return scope.metadata_filter(documents(spark, sf_dir), types=["BUILDING", "MACHINERY"], owner=2, members=members).select("id", "type")


@query("SELECT s_suppkey AS user_id, list_sort(list(DISTINCT r_name)) AS permissions FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_suppkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def permission_keys(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    roles = s.select(F.col("s_suppkey").alias("user_id"), F.explode(F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 25)).alias("role"))
    return scope.permission_keys(roles, n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("role"), F.col("r_name").alias("permission")))


_CURRENT = f"""current AS (SELECT id, document_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY effective_date DESC NULLS LAST, version_number DESC) AS n FROM versions
 WHERE status = 'READY' AND (effective_date IS NULL OR effective_date <= DATE '{DAY}') AND (expiration_date IS NULL OR expiration_date > DATE '{DAY}')) WHERE n = 1)"""


@query(f"WITH {_VERSIONS}, {_CURRENT} SELECT id, document_id, version_number FROM current")
def asof_version(spark, sf_dir):
    return scope.as_of(versions(spark, sf_dir), DAY).select("id", "document_id", "version_number")


@query(f"WITH {_VERSIONS}, {_CURRENT} SELECT id, CASE WHEN id IN (SELECT id FROM current) THEN 'CURRENT' WHEN effective_date > DATE '{DAY}' THEN 'SCHEDULED' ELSE 'SUPERSEDED' END AS state FROM versions")
def version_state(spark, sf_dir):
    return scope.with_state(versions(spark, sf_dir), DAY).select("id", "state")


@query(f"WITH {_VERSIONS} SELECT document_id, max(id) AS id, max(version_number) AS version_number FROM versions GROUP BY 1")
def latest_version(spark, sf_dir):
    return scope.latest_version(versions(spark, sf_dir))


@query(f"WITH {_VERSIONS}, {_CURRENT}, s AS (SELECT l_partkey % 50 AS conflict, l_orderkey AS id FROM lineitem) SELECT conflict, CASE WHEN bool_and(id IN (SELECT id FROM current)) THEN 'ACTIVE' ELSE 'LIKELY_RESOLVED' END AS priority, count(*) AS statements FROM s GROUP BY 1")
def conflict_priority(spark, sf_dir):
    states = scope.with_state(versions(spark, sf_dir), DAY).select("id", "state")
    statements = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("conflict"), F.col("l_orderkey").alias("id")).join(states, "id", "left")
    live = F.bool_and(F.coalesce(F.col("state") == "CURRENT", F.lit(False)))
    return statements.groupBy("conflict").agg(F.when(live, "ACTIVE").otherwise("LIKELY_RESOLVED").alias("priority"), F.count("*").alias("statements"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def document_list_keyset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    return catalog.keyset_page(rows, time="o_orderdate", key="o_orderkey", limit=20, after=("1997-01-01 00:00:00", 5000))


@query("SELECT e.user_id, event_id, ts, event_type, c_name AS name FROM (SELECT * FROM events WHERE upper(event_type) IN ('CLICK', 'PURCHASE') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10) e LEFT JOIN customer ON c_custkey = e.user_id")
def audit_page(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return catalog.audit_page(events, users, actions=["click", "purchase"], since="2024-01-05", until="2024-01-20", offset=10, limit=50)


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def groundedness_histogram(spark, sf_dir):
    return catalog.histogram(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")


@query("""SELECT count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers, count(DISTINCT conv_id) AS conversations,
 CASE WHEN count(*) = 0 THEN 0 ELSE round_even(count(*) FILTER (role = 'assistant') / count(*)::DOUBLE * 100, 1) END AS answer_percent FROM conversations""")
def kpi_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = F.count_if(F.col("role") == "assistant")
    return c.agg(F.count_if(F.col("role") == "user").alias("questions"), answers.alias("answers"), F.count_distinct("conv_id").alias("conversations"), catalog.ratio_percent(answers, F.count("*")).alias("answer_percent"))


@query("SELECT count(DISTINCT conv_id) AS covered FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def citation_coverage(spark, sf_dir):
    cited = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").join(cited, "conv_id", "left_semi").agg(F.count_distinct("conv_id").alias("covered"))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM
 (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 3""")
def history_window(spark, sf_dir):
    kept = catalog.history_window(table(spark, sf_dir, "conversations"), group="conv_id", order="turn", roles=["user", "assistant"], last=3)
    return kept.select("conv_id", "turn", "role", "place")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return catalog.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT c_custkey + 100 AS k, c_acctbal * 2 AS v FROM customer) b USING (k)")
def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return catalog.upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.select((F.col("c_custkey") + 100).alias("k"), (F.col("c_acctbal") * 2).alias("v")), ["k"])


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT c_custkey + 100 AS k, c_acctbal * 2 AS v FROM customer) b USING (k)")
def insert_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return catalog.insert_ignore(c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), c.select((F.col("c_custkey") + 100).alias("k"), (F.col("c_acctbal") * 2).alias("v")), ["k"])


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' ELSE 'delete' END AS action FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48) b USING (k) WHERE a.k IS NULL OR b.k IS NULL")
def set_replace(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    return catalog.set_changes(l.filter("l_returnflag = 'R'"), l.filter("l_returnflag = 'A' AND l_quantity > 48"), ["k"])


@query("SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> event_type")
def change_feed(spark, sf_dir):
    return jobs.change_feed(table(spark, sf_dir, "events"), key="user_id", time="ts", status="event_type", tie="event_id").select("user_id", "event_id", "event_type", "previous")


@query("SELECT event_id, in_window, in_window > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events)")
def rate_limit(spark, sf_dir):
    return jobs.rate_limited(table(spark, sf_dir, "events"), key="user_id", time="ts", seconds=3600, most=2).select("event_id", "in_window", "limited")


_JOBS = "SELECT event_id AS id, ts AS updated_at, CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM events"


@query(f"SELECT id, status FROM ({_JOBS}) WHERE (status IN ('PENDING', 'RETRYING') AND date_sub('second', updated_at, TIMESTAMP '2024-01-10') > 120) OR (status = 'PROCESSING' AND date_sub('second', updated_at, TIMESTAMP '2024-01-10') > 600) ORDER BY updated_at, id LIMIT 200")
def job_sweep(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ["PENDING", "RETRYING", "PROCESSING", "COMPLETED"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), states.alias("status"))
    return jobs.sweep(rows, "2024-01-10 00:00:00").select("id", "status")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_linenumber >= 4 THEN 'FAILED' ELSE 'RETRYING' END AS next_status, CASE WHEN NOT (l_returnflag = 'R' OR l_linenumber >= 4) THEN CAST(least(300, 5 * pow(2, l_linenumber - 1)) AS BIGINT) END AS delay FROM lineitem")
def retry_backoff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("attempts", F.col("l_linenumber")).withColumn("max_attempts", F.lit(4)).withColumn("deterministic", F.col("l_returnflag") == "R")
    return jobs.retry_decisions(l).select("l_orderkey", "l_linenumber", "next_status", "delay")


@query("SELECT c_custkey AS id, count(o_orderkey) AS versions FROM (SELECT * FROM (SELECT c_custkey, TIMESTAMP '2025-01-01' + to_days(CAST(c_custkey % 365 AS INT)) AS deleted_at FROM customer) WHERE deleted_at <= TIMESTAMP '2025-09-01' - INTERVAL 90 DAY ORDER BY deleted_at, c_custkey LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def purge_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("c_custkey") % 365)).alias("deleted_at"))
    return jobs.purge_candidates(docs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id")), "2025-09-01 00:00:00").select("id", "versions")


@query("""SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS failures FROM (SELECT *, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events WHERE value IS NOT NULL) WHERE value < 50 GROUP BY user_id, island HAVING count(*) >= 5""")
def circuit_breaker(spark, sf_dir):
    calls = table(spark, sf_dir, "events").filter("value IS NOT NULL").withColumn("failed", F.col("value") < 50)
    return jobs.failure_runs(calls, key="user_id", order="event_id", failed="failed")


_STEPS = ["PENDING", "PROCESSING", "RETRYING", "COMPLETED", "FAILED"]


@query("""SELECT event_id, before, after, coalesce((before = 'PENDING' AND after IN ('PROCESSING', 'FAILED')) OR (before = 'PROCESSING' AND after IN ('COMPLETED', 'RETRYING', 'FAILED')) OR (before = 'RETRYING' AND after IN ('PROCESSING', 'FAILED')), false) AS ok FROM (
 SELECT event_id, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before, status AS after FROM (SELECT *, ['PENDING', 'PROCESSING', 'RETRYING', 'COMPLETED', 'FAILED'][1 + event_id * 7 % 5] AS status FROM events)) WHERE before IS NOT NULL""")
def job_transitions(spark, sf_dir):
    """The events of a user as the states of a job, and whether each step from one to the next is allowed."""
    status = F.get(F.array(*map(F.lit, _STEPS)), (F.col("event_id") * 7 % 5).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.lag(status).over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"), status.alias("after"))
    return rows.filter("before IS NOT NULL").withColumn("ok", jobs.allowed("before", "after"))


@query("SELECT p_partkey, severity FROM (SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'MAJOR' WHEN p_size % 4 < 2 THEN 'MODERATE' WHEN p_size % 3 = 0 THEN CASE WHEN p_size / 50.0 >= 0.3 THEN 'MAJOR' ELSE 'MODERATE' END WHEN p_size % 3 = 1 THEN 'MINOR' WHEN p_size / 50.0 >= 0.5 THEN 'MODERATE' ELSE 'MINOR' END AS severity FROM part)")
def comparison_severity(spark, sf_dir):
    from foliant.functions import expressions as X

    change = F.element_at(F.array(*map(F.lit, ["ADDED", "REMOVED", "MODIFIED", "MODIFIED"])), (F.col("p_size") % 4 + 1).cast("int"))
    verdict = F.when(F.col("p_size") % 3 == 0, "material").when(F.col("p_size") % 3 == 1, "stylistic")
    return table(spark, sf_dir, "part").select("p_partkey", X.comparison_severity(change, X.critical_section(F.col("p_type"), ["brass"]), verdict, F.col("p_size") / 50).alias("severity"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 3 THEN 'MAJOR' WHEN s_suppkey % 4 >= 3 THEN CASE WHEN s_suppkey % 100 / 100.0 >= 0.75 THEN 'MAJOR' ELSE 'MODERATE' END WHEN s_suppkey % 100 / 100.0 >= 0.85 THEN 'MODERATE' ELSE 'MINOR' END AS severity FROM supplier")
def conflict_severity(spark, sf_dir):
    from foliant.functions import expressions as X

    return table(spark, sf_dir, "supplier").select("s_suppkey", X.conflict_severity(F.col("s_suppkey") % 4, F.col("s_suppkey") % 100 / 100, F.col("s_nationkey") < 3).alias("severity"))
