"""Queries over listings, life cycles, conflicts and text rules, with the star tables standing in for the engine's own."""

from pyspark.sql import functions as F

from foliant.functions import rules as R
from foliant.operators import library as L
from foliant.operators import scope, structure
from foliant.plans import records
from foliant.plans.registry import query, table
from foliant.plans.texts import _LINES, _MARKED, marked

_STATES = f"WITH {records._VERSIONS}, {records._CURRENT}, states AS (SELECT id AS version_id, CASE WHEN id IN (SELECT id FROM current) THEN 'CURRENT' WHEN effective_date > DATE '{records.DAY}' THEN 'SCHEDULED' ELSE 'SUPERSEDED' END AS state FROM versions)"


def states(spark, sf_dir):
    return scope.with_state(records.versions(spark, sf_dir), records.DAY).select(F.col("id").alias("version_id"), "state")


@query("SELECT o_orderkey, 'organizations/' || (o_custkey % 25) || '/documents/' || o_custkey || '/versions/' || o_orderkey || '/original.pdf' AS key FROM orders")
def storage_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", R.storage_key((F.col("o_custkey") % 25).cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_orderdate AS DATE) END AS day, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS year_end,
 CASE WHEN o_orderkey % 3 = 2 THEN true ELSE CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 - 4 AS INT) >= CAST(o_orderdate AS DATE) END AS valid FROM orders""")
def date_rules(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 3
    value = F.when(kind == 0, F.concat(day, F.lit("T10:00:00"))).when(kind == 1, day).otherwise("2024-13-45")
    effective = R.coerced_date(value)
    expiration = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 9 - 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", effective.alias("day"), R.year_end(F.year("o_orderdate")).alias("year_end"), R.valid_window(effective, expiration).alias("valid"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN [p_type] WHEN 1 THEN ['ECONOMY'] ELSE ['none'] END AS types, CASE p_size % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'hybrid' END AS mode FROM (SELECT * REPLACE (CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type ELSE 'STANDARD' END AS p_type) FROM part)""")
def filter_rules(spark, sf_dir):
    kind, mode = F.col("p_size") % 3, F.col("p_size") % 4
    p = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), F.col("p_type")).otherwise("STANDARD"))
    asked = F.when(kind == 0, F.array("p_type", F.lit("typo"))).when(kind == 1, F.array(F.lit("ECONOMY"))).otherwise(F.array(F.lit("none")))
    asked_mode = F.when(mode == 0, "semantic").when(mode == 1, "keyword").when(mode == 2, "fuzzy")
    return p.select("p_partkey", R.known_types(asked, ["ECONOMY", "STANDARD"]).alias("types"), R.search_mode(asked_mode).alias("mode"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_TOKENS = "CASE WHEN len({0}) = 0 THEN 0 ELSE greatest(1, ceil(greatest(len(list_filter(regexp_split_to_array({0}, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2000}}-\\x{{200a}}]+'), lambda w: w <> '')) / 0.75::DOUBLE, len({0}) / 4.0::DOUBLE))) END"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, text, {_TOKENS.format('text')} AS tokens FROM documents), c AS (SELECT doc_id, substr(text, 1, 80) AS cut FROM t WHERE tokens > 20
 UNION ALL SELECT doc_id, substr(cut, 1, len(cut) // 2) FROM c WHERE {_TOKENS.format('cut')} > 20), l AS (SELECT doc_id, arg_min(cut, len(cut)) AS cut FROM c GROUP BY 1),
 w AS (SELECT *, {_WORDS} AS parts FROM t)
 SELECT doc_id, CASE WHEN tokens <= 20 THEN text ELSE cut || ' [...]' END AS clipped, array_to_string(list_slice(parts, 1, CAST(greatest(1, floor(50 / greatest(1.0::DOUBLE, tokens / greatest(len(parts), 1)::DOUBLE))) AS BIGINT)), ' ') AS leading, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS header FROM w LEFT JOIN l USING (doc_id)""")
def token_cuts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", R.clip_to_tokens(t, 20).alias("clipped"), R.keep_words(t, 50).alias("leading"), R.inert_metadata(t).alias("header"))


@query("""WITH m AS (SELECT doc_id, replace(text, ', ', ', §CANARY-x ') AS text FROM documents), s AS (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM m)
 SELECT doc_id, CASE WHEN contains(text, '§CANARY-') THEN array_to_string(list_filter(list_transform(list_filter(parts, lambda p: NOT contains(p, '§CANARY-')), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), ' ') ELSE text END AS clean FROM s""")
def canary_strip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(", "), F.lit(", §CANARY-x ")))
    return docs.select("doc_id", R.strip_canary(F.col("text")).alias("clean"))


@query(f"WITH m AS ({_MARKED}) SELECT message_id, regexp_replace(regexp_replace(text, '\\[(?:SOURCE\\s*)?(?:00?|0?[7-9]|[1-9][0-9])\\]', '', 'g'), ' {{2,}}', ' ', 'g') AS text FROM m")
def marker_strip(spark, sf_dir):
    valid = F.array(*[F.lit(i) for i in range(1, 7)])
    return marked(spark, sf_dir).select("message_id", R.strip_markers(F.col("text"), valid).alias("text"))


@query(f"""WITH m AS ({_MARKED}), p AS (SELECT message_id, len(text) AS n, string_split(regexp_replace(regexp_replace(text, '([.!?])(\\s+)([A-Z0-9"''(])', '\\1\\2' || chr(1) || '\\3', 'g'), '(\\])(\\s+)', '\\1\\2' || chr(1), 'g'), chr(1)) AS parts FROM m),
 q AS (SELECT message_id, n, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM p), r AS (SELECT *, sum(len(piece)) OVER (PARTITION BY message_id ORDER BY i) AS after FROM q)
 SELECT message_id, CAST(after - len(piece) + len(piece) - len(regexp_replace(piece, '^\\s+', '')) AS INT) AS "begin", CAST(CASE WHEN after = n THEN n ELSE after - len(piece) + len(regexp_replace(piece, '\\s+$', '')) END AS INT) AS "end", sha256(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) AS digest
 FROM r WHERE regexp_replace(piece, '\\s+$', '') <> ''""")
def sentence_spans(spark, sf_dir):
    spans = marked(spark, sf_dir).select("message_id", F.explode(R.sentence_spans(F.col("text"))).alias("s"))
    return spans.select("message_id", "s.begin", "s.end", F.sha2("s.sentence", 256).alias("digest"))


@query("SELECT a.p_partkey, CASE WHEN a.p_size % 2 = 0 AND a.p_size % 3 = 0 THEN p_name || ' / ' || p_brand || ' disagreement' WHEN a.p_size % 2 = 0 THEN p_name || ' disagreement' WHEN a.p_size % 3 = 0 THEN p_brand || ' disagreement' ELSE 'Cross-document disagreement' END AS topic FROM part a")
def fallback_topics(spark, sf_dir):
    a, b = F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", R.fallback_topic(a, b).alias("topic"))


@query("""WITH h AS (SELECT doc_id, sha256(unhex(sha256(text))) AS a FROM documents), d AS (SELECT doc_id, a || sha256(unhex(a)) AS hex FROM h),
 r AS (SELECT doc_id, list_transform(range(12), lambda i: CAST('0x' || substr(hex, i * 8 + 1, 8) AS BIGINT)) AS raw FROM d),
 s AS (SELECT doc_id, list_transform(raw, lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END / 2147483648::DOUBLE) AS v FROM r)
 SELECT doc_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS vector FROM s""")
def stub_embeddings(spark, sf_dir):
    # as the SQL rounds: the scaled double, half away from zero, and -0.0 for a small negative number
    vector = F.transform(R.stub_embedding(F.col("text"), 12), lambda x: F.signum(x) * F.round(F.abs(x) * 1e6) / 1e6)
    return table(spark, sf_dir, "documents").select("doc_id", vector.alias("vector"))


@query("SELECT p_partkey, regexp_replace(p_name, '(' || split_part(p_name, ' ', 1) || '|WIDGET)', '<mark>\\1</mark>', 'gi') AS marked FROM part")
def highlights(spark, sf_dir):
    terms = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("WIDGET"))
    return table(spark, sf_dir, "part").select("p_partkey", R.highlighted(F.col("p_name"), terms).alias("marked"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def reply_fields(spark, sf_dir):
    reply = F.when(F.col("event_id") % 5 == 0, "no object here").otherwise(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", R.json_object(reply, "k long")["k"].alias("k"))


_ITEMS = "CASE WHEN l_linenumber = 5 THEN 'party' WHEN l_linenumber = 6 THEN 'date' WHEN l_returnflag = 'A' THEN 'requirement' WHEN l_returnflag = 'N' THEN 'risk' ELSE 'other' END"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, category, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE category WHEN 'requirement' THEN 0 WHEN 'risk' THEN 1 WHEN 'date' THEN 2 WHEN 'party' THEN 3 ELSE 4 END, l_linenumber, l_partkey) AS INT) AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM (SELECT *, {_ITEMS} AS category FROM lineitem)")
def extraction_items(spark, sf_dir):
    flag = F.col("l_returnflag")
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.when(line == 5, "party").when(line == 6, "date").when(flag == "A", "requirement").when(flag == "N", "risk").otherwise("other").alias("category"))
    return L.numbered(rows, ["l_orderkey"], [R.category_rank(F.col("category")), "l_linenumber", "l_partkey"])


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) AS place, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) WHERE place BETWEEN 11 AND 15")
def page_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return L.page_of(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 10, 5)


@query("SELECT *, (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) AS total FROM (SELECT id, kind, amount FROM (SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier) ORDER BY amount DESC, kind, id LIMIT 20 OFFSET 5)")
def merged_runs(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("amount"))
    return L.merged_runs([a, b], [F.desc("amount"), "kind", "id"], 5, 20)


@query("SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def forbidden_scope(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return L.forbidden(asked, table(spark, sf_dir, "supplier").filter("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").select("l_orderkey", "l_suppkey")


@query(f"WITH {records._DOCS}, {records._GRANTS}, {records._VERSIONS} SELECT v.id, document_id, version_number, effective_date FROM versions v JOIN docs d ON d.id = document_id WHERE org = 7 AND d.status = 'active' AND (access = 'organization' OR (access = 'private' AND owner = 3) OR (access = 'restricted' AND (owner = 3 OR d.id IN (SELECT document_id FROM grants WHERE user_id = 3 AND permission <> 'none' AND kind <> 0))))")
def authorized_versions(spark, sf_dir):
    docs = scope.readable(records.documents(spark, sf_dir), records.grants(spark, sf_dir), 7, 3, records.NOW).select(F.col("id").alias("document_id"))
    return records.versions(spark, sf_dir).join(docs, "document_id", "left_semi").select("id", "document_id", "version_number", "effective_date")


@query("SELECT k, id, id IS NULL AS created FROM (SELECT DISTINCT o_custkey AS k FROM orders) LEFT JOIN (SELECT l_partkey AS k, max(l_orderkey) AS id FROM lineitem GROUP BY 1) USING (k)")
def get_or_create(spark, sf_dir):
    existing = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("id"))
    return L.get_or_create(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), existing, ["k"])


@query("""SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE o_orderstatus END AS status, CASE WHEN o_custkey % 3 = 0 THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'new' END, o_orderpriority) ELSE o_orderpriority END AS payload,
 CASE WHEN o_custkey % 3 = 0 THEN false ELSE o_orderkey % 4 = 0 END AS stale FROM orders""")
def run_life_cycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    rows = o.select("id", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payload"), (F.col("id") % 4 == 0).alias("stale"))
    updates = o.filter("o_custkey % 3 <> 2").select("id", F.when(F.col("o_custkey") % 3 == 0, "COMPLETED").otherwise("FAILED").alias("status"), F.when(F.col("id") % 2 == 0, "new").alias("payload"))
    return L.life_cycle(rows, updates)


@query("""SELECT c_custkey AS conflict_id, CASE WHEN c_acctbal > 0 AND r.who IS NOT NULL THEN 'RESOLVED' WHEN c_acctbal > 0 THEN 'OPEN' ELSE 'DISMISSED' END AS status, CASE WHEN c_acctbal > 0 THEN r.who ELSE -1 END AS resolved_by
 FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS who FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON o_custkey = c_custkey""")
def conflict_resolution(spark, sf_dir):
    is_open = F.col("c_acctbal") > 0
    conflicts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conflict_id"), F.when(is_open, "OPEN").otherwise("DISMISSED").alias("status"), F.when(~is_open, F.lit(-1).cast("long")).alias("resolved_by"))
    return L.resolve_once(conflicts, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("conflict_id"), F.col("o_orderkey").alias("by")))


@query("SELECT p_partkey AS conflict_id, p_name AS topic FROM part WHERE p_size > 10 AND (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red')) ORDER BY p_size DESC, p_partkey DESC LIMIT 10")
def recent_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conflict_id"), F.col("p_name").alias("topic"), F.when(F.col("p_size") > 10, "OPEN").otherwise("RESOLVED").alias("status"), F.col("p_size").alias("at"))
    return L.recent_conflicts(rows, ["Ring", " ", "red"]).select("conflict_id", "topic")


@query(f"{_STATES}, s AS (SELECT l_partkey AS conflict_id, l_suppkey AS document_id, l_orderkey AS version_id FROM lineitem), c AS (SELECT conflict_id, count(*) AS statements, count(DISTINCT document_id) AS documents, bool_and(coalesce(state = 'CURRENT', false)) AS live FROM s LEFT JOIN states USING (version_id) GROUP BY 1) SELECT p_partkey AS conflict_id, p_name AS topic, coalesce(statements, 0) AS statements, coalesce(documents, 0) AS documents, CASE WHEN live THEN 'ACTIVE' ELSE 'LIKELY_RESOLVED' END AS priority FROM part LEFT JOIN c ON conflict_id = p_partkey")
def conflict_list(spark, sf_dir):
    conflicts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conflict_id"), F.col("p_name").alias("topic"))
    statements = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("conflict_id"), F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("version_id"))
    return L.conflict_rows(conflicts, statements, states(spark, sf_dir))


@query(f"{_STATES} SELECT l_orderkey * 10 + l_linenumber AS change_id, coalesce(CASE WHEN l_linenumber > 2 THEN 'Part ' || l_partkey END, 'Document') || ' — Version Discrepancy' AS topic FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 25 AND l_linenumber <> 4 AND l_orderkey IN (SELECT version_id FROM states WHERE state = 'CURRENT') AND l_partkey IN (SELECT version_id FROM states WHERE state = 'CURRENT')")
def seeded_conflicts(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"), F.when(F.col("l_returnflag") == "N", "MODIFIED").otherwise("ADDED").alias("change_type"),
        F.when(F.col("l_quantity") > 25, "MAJOR").otherwise("MINOR").alias("severity"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("section"),
        F.col("l_orderkey").alias("a_version"), F.col("l_partkey").alias("b_version"), F.col("l_suppkey").alias("a_chunk"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey")).alias("b_chunk"),
    )
    return L.seeded_conflicts(changes, states(spark, sf_dir))


@query("""WITH j AS (SELECT o_custkey % 40 AS org, o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'PROCESSING' END AS status, o_orderdate AS ts, o_custkey AS made FROM orders WHERE o_custkey % 40 < 30),
 l AS (SELECT org, arg_max(status, (ts, job_id)) AS last_status FROM j GROUP BY 1), d AS (SELECT org, max(ts) AS completed_at, arg_max(made, (ts, job_id)) AS created FROM j WHERE status = 'COMPLETED' GROUP BY 1)
 SELECT org, last_status, CAST(completed_at AS DATE) AS completed_day, created, (SELECT count(*) FROM lineitem WHERE l_suppkey % 40 = o.org AND (d.completed_at IS NULL OR l_shipdate > d.completed_at)) AS unscanned FROM (SELECT DISTINCT c_custkey % 40 AS org FROM customer) o LEFT JOIN l USING (org) LEFT JOIN d USING (org)""")
def scan_status(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    jobs = table(spark, sf_dir, "orders").filter("o_custkey % 40 < 30").select((F.col("o_custkey") % 40).alias("org"), F.col("o_orderkey").alias("job_id"), F.when(kind == 0, "COMPLETED").when(kind == 1, "FAILED").otherwise("PROCESSING").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("completed_at"), F.col("o_custkey").alias("created"))
    docs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("org"), F.col("l_shipdate").alias("made_at"))
    orgs = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("org")).distinct()
    return L.scan_status(orgs, jobs, docs).select("org", "last_status", F.col("completed_at").cast("date").alias("completed_day"), "created", "unscanned")


@query("SELECT o_orderkey AS version_id, CASE WHEN NOT bool_or(coalesce(l_linenumber = 1, false)) THEN 'EXTRACTION' WHEN NOT bool_or(coalesce(l_linenumber = 2, false)) THEN 'CHUNKING' WHEN NOT bool_or(coalesce(l_linenumber = 3, false)) THEN 'EMBEDDING' WHEN NOT bool_or(coalesce(l_linenumber = 4, false)) THEN 'INDEXING' ELSE 'READY' END AS next FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def next_jobs(spark, sf_dir):
    job = F.get(F.array(*map(F.lit, R.PIPELINE_JOBS)), F.col("l_linenumber").cast("int") - 1)
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), job.alias("job")).filter("job IS NOT NULL")
    return L.next_job(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id")), done)


@query("""WITH h AS (SELECT user_id, event_id, CASE event_id * 7 % 9 WHEN 8 THEN 'FAILED' ELSE ['UPLOADED', 'PROCESSING', 'EXTRACTING', 'OCR', 'CHUNKING', 'EMBEDDING', 'INDEXING', 'READY'][event_id * 7 % 9 + 1] END AS status, event_id * 7 % 9 AS n FROM events),
 s AS (SELECT *, lag(status) OVER w AS before, lag(n) OVER w AS m FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, before, status, CASE WHEN m = 8 THEN n = 1 WHEN m = 7 THEN false ELSE n > m END AS allowed FROM s WHERE before IS NOT NULL""")
def version_transitions(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, [*R.VERSION_STATES, "FAILED"])), (F.col("event_id") * 7 % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return L.transitions(rows, "user_id", ["event_id"]).select("event_id", "before", "status", "allowed")


@query("SELECT l_orderkey AS chat_id, min(l_suppkey) AS first, CASE WHEN count(DISTINCT l_suppkey) = 2 THEN max(l_suppkey) END AS second FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) BETWEEN 1 AND 2")
def effective_scopes(spark, sf_dir):
    return L.effective_scope(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chat_id"), F.col("l_suppkey").alias("document_id")))


@query("""WITH RECURSIVE k AS (SELECT l_orderkey AS q, l_quantity::BIGINT AS cost, l_returnflag = 'A' AS claimed, l_linenumber * 1000000 + l_partkey AS o, l_partkey AS chunk FROM lineitem),
 f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, chunk, cost) AS n FROM k WHERE NOT claimed), t AS (SELECT q, coalesce(sum(cost) FILTER (claimed), 0)::BIGINT AS taken FROM k GROUP BY 1),
 p AS (SELECT q, 0::BIGINT AS n, taken AS used, []::BIGINT[] AS added FROM t UNION ALL SELECT p.q, f.n, CASE WHEN used + cost <= 90 THEN used + cost ELSE used END, CASE WHEN used + cost <= 90 THEN list_append(added, chunk) ELSE added END FROM p JOIN f ON f.q = p.q AND f.n = p.n + 1)
 SELECT q AS document_id, arg_max(used, n) AS used, arg_max(added, n) AS added FROM p GROUP BY 1""")
def budget_fill(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("order"), F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").alias("cost"), (F.col("l_returnflag") == "A").alias("claimed"))
    return L.fill_budget(chunks, 90)


@query(f"WITH {_LINES}, h AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS sort_order FROM lines WHERE line_no % 5 = 3) SELECT doc_id, line_no, CAST((SELECT max(sort_order) FROM h WHERE h.doc_id = l.doc_id AND h.line_no <= l.line_no) AS INT) AS section FROM lines l")
def carried_sections(spark, sf_dir):
    rows = structure.lines(table(spark, sf_dir, "documents"))
    heads = L.numbered(rows.filter("line_no % 5 = 3"), ["doc_id"], ["line_no"]).withColumnRenamed("place", "sort_order")
    return L.carried_sections(rows, heads).select("doc_id", "line_no", "section")


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS questions, max(turn) AS last_turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def conversation_list(spark, sf_dir):
    deleted = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return L.conversations(table(spark, sf_dir, "conversations"), deleted)


@query("SELECT l_suppkey AS document_id, chunk_id, CAST((row_number() OVER (PARTITION BY l_suppkey ORDER BY chunk_id) - 1) // 10 AS INT) AS batch FROM (SELECT DISTINCT l_suppkey, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_returnflag = 'R')")
def pending_embeddings(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_returnflag") != "R", F.array(F.lit(0.0))).alias("embedding")).distinct()
    return L.pending_embeddings(chunks, "chunk_id", 10)
