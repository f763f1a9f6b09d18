"""Queries over single tables and their rows, with the star tables standing in for the engine's own."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.operators import answers, assembly, catalog, jobs, rows, scope
from foliant.operators.compare import shared_folder
from foliant.plans import records
from foliant.plans.registry import query, table
from foliant.sources import files


@query("""SELECT id, count(o_orderkey) AS versions, coalesce(list_sort(list('versions/' || o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS keys
 FROM (SELECT c_custkey AS id, TIMESTAMP '2025-01-01' + to_days(CAST(c_custkey % 365 AS INT)) AS deleted_at FROM customer WHERE TIMESTAMP '2025-01-01' + to_days(CAST(c_custkey % 365 AS INT)) <= TIMESTAMP '2025-09-01' - INTERVAL 90 DAY ORDER BY deleted_at, id LIMIT 50) LEFT JOIN orders ON o_custkey = id GROUP BY 1""")
def purge_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("c_custkey") % 365)).alias("deleted_at"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("versions/"), F.col("o_orderkey").cast("string")).alias("key"))
    return jobs.purge_candidates(docs, versions, "2025-09-01 00:00:00").select("id", "versions", "keys")


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey < 3 DESC, s_name) AS INT) AS place FROM supplier WHERE s_nationkey < 3 OR s_nationkey = 7")
def role_list(spark, sf_dir):
    """System roles first, then an organisation's own, by name."""
    roles = table(spark, sf_dir, "supplier").withColumn("is_system", F.col("s_nationkey") < 3)
    return rows.numbered_by(roles.filter("is_system OR s_nationkey = 7"), F.desc("is_system"), "s_name").select("s_suppkey", "place")


@query("""WITH l AS (SELECT l_orderkey, l_suppkey % 3 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
 SELECT l_orderkey, list(s ORDER BY first) AS asked FROM (SELECT l_orderkey, s, min(n) AS first FROM l GROUP BY ALL) GROUP BY 1""")
def distinct_in_order(spark, sf_dir):
    listed = rows.listed_by(table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), (F.col("l_suppkey") % 3).alias("s")), "l_orderkey", "at", "s")
    return listed.select("l_orderkey", F.array_distinct(F.transform("rows", lambda r: r["s"])).alias("asked"))


@query("SELECT doc_id, sha256(substr(text, 1, 500)) AS card, sha256(substr(text, 1, 2000)) AS stored, CASE WHEN greatest(1, len(text) // 6) > 2000 THEN sha256(substr(text, 1, 12000) || ' [...]') ELSE sha256(text) END AS clipped, greatest(1, len(text) // 6) > 2000 AS cut FROM documents")
def snippets(spark, sf_dir):
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").withColumn("c", rows.clipped(text))
    return docs.select("doc_id", F.sha2(rows.snippet(text, 500), 256).alias("card"), F.sha2(rows.snippet(text, 2000), 256).alias("stored"), F.sha2("c.text", 256).alias("clipped"), "c.cut")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 THEN NULL WHEN p_partkey % 9 = 5 THEN []::DOUBLE[] ELSE [p_size::DOUBLE, -p_size / 4.0::DOUBLE, 0.5::DOUBLE] END AS vector FROM part")
def vector_texts(spark, sf_dir):
    """Vectors read back from their stored texts, some of them spoilt or empty."""
    text = rows.text_of(F.array(F.col("p_size").cast("double"), -F.col("p_size") / 4, F.lit(0.5)))
    stored = F.when(F.col("p_partkey") % 9 == 4, F.replace(text, F.lit("0.5"), F.lit("x"))).when(F.col("p_partkey") % 9 == 5, " [ ] ").otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", rows.vector_of(stored).alias("vector"))


_CHANGES = "changes AS (SELECT l_orderkey AS comparison_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CASE l_returnflag WHEN 'A' THEN 'MAJOR' WHEN 'N' THEN 'MODERATE' ELSE 'MINOR' END AS severity, CASE WHEN l_linestatus = 'O' THEN 'MODIFIED' ELSE 'ADDED' END AS change, CASE WHEN l_partkey % 4 > 0 THEN 'Part ' || l_partkey % 20 END AS section FROM lineitem)"


def changes(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    severity = F.when(F.col("l_returnflag") == "A", "MAJOR").when(F.col("l_returnflag") == "N", "MODERATE").otherwise("MINOR")
    section = F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("Part "), (F.col("l_partkey") % 20).cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("comparison_id"), F.row_number().over(order).alias("order"), severity.alias("severity"), F.when(F.col("l_linestatus") == "O", "MODIFIED").otherwise("ADDED").alias("change"), section.alias("section"))


@query(f"WITH {_CHANGES} SELECT comparison_id, list_sort(list(DISTINCT section) FILTER (section IS NOT NULL AND severity = 'MAJOR')) AS major, list_sort(list(DISTINCT section) FILTER (section IS NOT NULL)) AS sections FROM changes GROUP BY 1")
def comparison_rows(spark, sf_dir):
    """Which sections each comparison has written, and those of them with a major change."""
    every = changes(spark, sf_dir)
    done, major = rows.done_sections(every), rows.done_sections(every.filter("severity = 'MAJOR' AND section IS NOT NULL")).withColumnRenamed("sections", "major")
    none = F.when(F.size("sections") > 0, F.col("sections"))
    return done.select("comparison_id", none.alias("sections")).join(major, "comparison_id", "left")


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, CAST(min(l_orderkey) OVER (PARTITION BY least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey)) AS BIGINT) AS first FROM lineitem")
def comparison_pairs(spark, sf_dir):
    pair = rows.ordered_pair(F.col("l_suppkey"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.min("l_orderkey").alias("first"))


@query(f"""WITH {_CHANGES}, g AS (SELECT comparison_id, severity, count(*) AS k, string_agg('  • [' || change || '] ' || coalesce(section, 'Unknown section'), chr(10) ORDER BY n) AS t FROM changes GROUP BY ALL)
 SELECT comparison_id, 'Document comparison results:' || chr(10) || string_agg(chr(10) || severity || ' changes (' || k || '):' || chr(10) || t, chr(10) ORDER BY CASE severity WHEN 'MAJOR' THEN 0 WHEN 'MODERATE' THEN 1 ELSE 2 END) AS text FROM g GROUP BY 1""")
def narrated_changes(spark, sf_dir):
    return rows.narrated_changes(changes(spark, sf_dir))


_KINDS = "CASE l_linenumber % 5 WHEN 0 THEN 'requirement' WHEN 1 THEN 'risk' WHEN 2 THEN 'date' WHEN 3 THEN 'party' ELSE 'other' END"


@query(f"""WITH i AS (SELECT l_orderkey AS document_id, {_KINDS} AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, 'Part ' || l_partkey AS label FROM lineitem),
 g AS (SELECT document_id, category, string_agg('- ' || label, chr(10) ORDER BY n) AS t FROM i WHERE category <> 'other' GROUP BY ALL)
 SELECT document_id, 'Here is what I found in this document:' || coalesce(string_agg(chr(10) || chr(10) || '**' || CASE category WHEN 'requirement' THEN 'Requirements' WHEN 'risk' THEN 'Risks' WHEN 'date' THEN 'Dates' ELSE 'Parties' END || ':**' || chr(10) || t, '' ORDER BY CASE category WHEN 'requirement' THEN 0 WHEN 'risk' THEN 1 WHEN 'date' THEN 2 ELSE 3 END), '') AS text
 FROM (SELECT DISTINCT document_id FROM i) LEFT JOIN g USING (document_id) GROUP BY 1""")
def narrated_items(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["requirement", "risk", "date", "party", "other"]))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.get(kinds, (F.col("l_linenumber") % 5).cast("int")).alias("category"), F.row_number().over(order).alias("item_index"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("label"))
    return rows.narrated_items(items)


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS conflict_id, CASE o_orderkey % 3 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' ELSE 'MODERATE' END AS severity, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS topic FROM orders),
 s AS (SELECT l_orderkey AS conflict_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, coalesce(CASE WHEN l_suppkey % 5 > 0 THEN 'Doc ' || l_suppkey END, 'Unknown document') AS name, repeat('x' || l_partkey || ' ', 60) AS text FROM lineitem),
 t AS (SELECT conflict_id, list_sort(list(DISTINCT name)) AS names, string_agg('    - ' || name || ': "' || substr(text, 1, 200) || '"', chr(10) ORDER BY place) FILTER (place <= 4) AS said FROM s GROUP BY 1)
 SELECT g AS "group", 'I found the following recorded conflicts:' || chr(10) || string_agg(chr(10) || '• [' || severity || '] ' || coalesce(topic, 'Unlabelled conflict') || ' — conflicting sources: ' || coalesce(array_to_string(names, ', '), '') || CASE WHEN said IS NULL THEN '' ELSE chr(10) || said END, chr(10) ORDER BY CASE severity WHEN 'MAJOR' THEN 1 WHEN 'MODERATE' THEN 2 ELSE 3 END, conflict_id) AS text
 FROM c LEFT JOIN t USING (conflict_id) GROUP BY 1""")
def narrated_conflicts(spark, sf_dir):
    severities = F.array(*map(F.lit, ["MINOR", "MAJOR", "MODERATE"]))
    conflicts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("conflict_id"), F.get(severities, (F.col("o_orderkey") % 3).cast("int")).alias("severity"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("topic"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    name = F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("Doc "), F.col("l_suppkey").cast("string")))
    said = F.repeat(F.concat(F.lit("x"), F.col("l_partkey").cast("string"), F.lit(" ")), 60)
    numbered = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.row_number().over(order).alias("place"))  # texts are made after the shuffle
    return rows.narrated_conflicts(conflicts, numbered.select(F.col("l_orderkey").alias("conflict_id"), "place", name.alias("name"), said.alias("text")))


#: Settings of every shape.
_SETTINGS = ['{"comparison": {"critical_sections": ["NAME", " ", 5, "pay"]}}', '{"comparison": {"critical_sections": "pay"}}', '{"comparison": {}}', "[]", "{bad", '{"comparison": {"critical_sections": []}}', '{"comparison": [1]}']


@query(f"""WITH s AS (SELECT c_custkey, replace([{", ".join(f"'{x}'" for x in _SETTINGS)}][1 + c_custkey % 7], 'NAME', c_mktsegment) AS j FROM customer)
 SELECT c_custkey, CASE WHEN json_valid(j) THEN CASE WHEN json_type(j, '$.comparison.critical_sections') = 'ARRAY' THEN list_filter(list_transform(list_filter(CAST(json_extract(j, '$.comparison.critical_sections') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), lambda s: trim(s) <> '') ELSE [] END ELSE [] END AS patterns FROM s""")
def critical_patterns(spark, sf_dir):
    settings = F.replace(F.get(F.array(*map(F.lit, _SETTINGS)), (F.col("c_custkey") % 7).cast("int")), F.lit("NAME"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", rows.critical_patterns(settings).alias("patterns"))


@query("SELECT l_orderkey AS message_id, list(struct_pack(l_linenumber := l_linenumber, l_suppkey := l_suppkey, l_partkey := l_partkey) ORDER BY l_linenumber, l_suppkey, l_partkey) AS rows FROM lineitem GROUP BY 1")
def citations_by_message(spark, sf_dir):
    return rows.listed_by(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").withColumnRenamed("l_orderkey", "message_id")


@query("SELECT o_orderkey AS message_id, max(CASE WHEN l_returnflag = 'A' THEN 'up' ELSE 'down' END) AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderstatus = 'O' GROUP BY 1")
def feedback_of_messages(spark, sf_dir):
    """The rating of each message of open orders; at most one a message."""
    rated = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("message_id"), F.when(F.col("l_returnflag") == "A", "up").otherwise("down").alias("rating"))
    asked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("message_id"))
    return rated.join(asked, "message_id", "left_semi").groupBy("message_id").agg(F.max("rating").alias("rating"))


@query("""WITH g AS (SELECT o_custkey AS document_id, o_orderkey % 7 AS user_id FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey AS document_id, o_orderkey % 7 AS user_id, max(o_orderpriority) AS permission FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
 SELECT a.*, CASE WHEN (document_id, user_id) IN (SELECT (document_id, user_id) FROM g) THEN 'conflict' ELSE 'created' END AS outcome FROM a""")
def grant_requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 7).alias("user_id"), F.col("o_orderpriority").alias("permission"), "o_orderstatus")
    return rows.granted(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"))


@query("SELECT document_id, user_id, name, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at, user_id) AS INT) AS place FROM (SELECT o_custkey AS document_id, o_orderkey AS user_id, o_orderdate AS created_at FROM orders) JOIN (SELECT s_suppkey AS user_id, s_name AS name FROM supplier) USING (user_id)")
def grant_list(spark, sf_dir):
    grants = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return rows.grant_list(grants, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))).select("document_id", "user_id", "name", "place")


@query(f"WITH {records._VERSIONS} SELECT l_orderkey * 10 + l_linenumber AS citation_id, version_number, v.effective_date FROM lineitem LEFT JOIN versions v ON v.id = l_orderkey + l_linenumber - 1")
def citation_versions(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation_id"), (F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("version_id"))
    return rows.enriched(cited, records.versions(spark, sf_dir).withColumnRenamed("id", "version_id")).select("citation_id", "version_number", "effective_date")


@query(f"""WITH {records._VERSIONS}, {records._DOCS} SELECT d.id, name, type, count(v.id) AS versions, max(v.version_number) AS latest, list(v.id ORDER BY v.version_number DESC) FILTER (v.id IS NOT NULL) AS version_ids FROM docs d LEFT JOIN versions v ON v.document_id = d.id WHERE org = 7 GROUP BY ALL""")
def document_detail(spark, sf_dir):
    """The documents of an organisation with their versions, newest first."""
    own = records.documents(spark, sf_dir).filter("org = 7").select("id", "name", "type")
    versions = records.versions(spark, sf_dir).select(F.col("document_id").alias("id"), F.col("id").alias("version_id"), "version_number")
    listed = rows.listed_by(versions.join(own, "id", "left_semi").withColumn("at", -F.col("version_number")), "id", "at", "version_id", "version_number")
    found = own.join(listed, "id", "left")
    many = F.coalesce(F.size("rows"), F.lit(0))
    return found.select("id", "name", "type", F.greatest(many, F.lit(0)).cast("long").alias("versions"), F.get("rows", F.lit(0))["version_number"].alias("latest"), F.transform("rows", lambda r: r["version_id"]).alias("version_ids"))


@query("""SELECT o_orderkey AS conflict_id, o_orderpriority AS topic, count(l_orderkey) AS statements, count(DISTINCT l_suppkey) AS documents, list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)) AS names FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'O' GROUP BY ALL""")
def conflict_detail(spark, sf_dir):
    """Open conflicts with their statements, documents and the documents' names."""
    conflicts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("conflict_id"), F.col("o_orderpriority").alias("topic"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), "l_suppkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    counted = said.groupBy("conflict_id").agg(F.count("*").alias("statements"), F.count_distinct("l_suppkey").alias("documents"), F.array_sort(F.collect_set("s_name")).alias("names"))
    found = conflicts.join(counted, "conflict_id", "left").na.fill(0, ["statements", "documents"])
    return found.withColumn("names", F.when(F.size("names") > 0, F.col("names")))


@query("SELECT conv_id, messages, CAST(row_number() OVER (ORDER BY last DESC, conv_id DESC) AS INT) AS place FROM (SELECT conv_id, count(*) AS messages, max(turn) AS last FROM conversations WHERE conv_id % 6 <> 0 GROUP BY 1)")
def conversation_recency(spark, sf_dir):
    """Conversations that are not deleted, the one with the latest turn first."""
    live = table(spark, sf_dir, "conversations").filter("conv_id % 6 <> 0").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"))
    return rows.numbered_by(live, F.desc("last"), F.desc("conv_id")).select("conv_id", "messages", "place")


@query("""SELECT l_orderkey * 10 + l_linenumber AS chunk_id, o_custkey AS document_id, c_name AS name, nullif(concat_ws(' ', nullif(CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END, ''), CASE WHEN l_partkey % 3 > 0 THEN p_name END), '') AS label
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND l_partkey % 5 > 0 WHERE l_orderkey * 10 + l_linenumber IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'F')""".replace("CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END", "CASE WHEN l_partkey % 2 = 0 AND p_partkey IS NOT NULL THEN CAST(l_partkey AS VARCHAR) END").replace("CASE WHEN l_partkey % 3 > 0 THEN p_name END", "CASE WHEN l_partkey % 3 > 0 THEN p_name END"))
def chunk_provenance(spark, sf_dir):
    """Where a set of chunks is from: the first line items of finished orders."""
    asked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("chunk_id"))
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("section_id"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"))
    part = F.col("p_partkey")
    sections = table(spark, sf_dir, "part").filter(part % 5 > 0).select(part.alias("section_id"), F.when(part % 2 == 0, part.cast("string")).alias("number"), F.when(part % 3 > 0, F.col("p_name")).alias("title"))
    return assembly.retrieval_rows(chunks.join(asked, "chunk_id", "left_semi"), versions, docs, sections).select("chunk_id", "document_id", "name", "label")


@query(f"WITH {records._DOCS} SELECT id FROM docs WHERE status = 'active' AND access = 'organization' AND contains(lower(name), '00012')")
def document_filters(spark, sf_dir):
    return scope.metadata_filter(records.documents(spark, sf_dir), status="active", access="organization", name="00012").select("id")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS asked, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def recent_activity(spark, sf_dir):
    """Clicks and users by day in the last week there is."""
    events = table(spark, sf_dir, "events")
    since = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    kept = events.filter("event_type = 'click'").join(F.broadcast(since)).filter("ts >= since")  # one row
    return kept.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("asked"), F.count_distinct("user_id").alias("users"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-01-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 51")
def keyset_forward(spark, sf_dir):
    """The next fifty orders after a cursor, oldest first, and one more."""
    return catalog.keyset_page(table(spark, sf_dir, "orders"), time="o_orderdate", key="o_orderkey", limit=50, after=("1996-01-01 00:00:00", 500), newest=False).select("o_orderkey")


@query("SELECT event_id, e.user_id, s_name AS name FROM events e LEFT JOIN (SELECT s_suppkey AS user_id, s_name FROM supplier) USING (user_id) WHERE user_id = 3 AND event_type IN ('click', 'view') AND event_id % 4 = 1 ORDER BY ts DESC, event_id DESC LIMIT 25")
def audit_of_user(spark, sf_dir):
    """A user's newest events on one resource."""
    events = table(spark, sf_dir, "events").withColumn("resource", F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")))
    users = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    page = catalog.audit_page(events, users, actions=["Click", "VIEW"], since="1900-01-01", until="2100-01-01", offset=0, limit=25, user=3, resource="r1")
    return page.select("event_id", "user_id", "name")


@query(f"WITH {records._DOCS} SELECT DISTINCT id FROM docs JOIN lineitem ON l_suppkey = id WHERE l_returnflag = 'A'")
def collection_documents(spark, sf_dir):
    """Documents in any of the named collections, each once."""
    members = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("document_id"))
    return scope.metadata_filter(records.documents(spark, sf_dir), members=members).select("id")


@query(f"WITH {_CHANGES} SELECT severity AS value, count(*) AS n FROM changes GROUP BY 1")
def severity_histogram(spark, sf_dir):
    return catalog.histogram(changes(spark, sf_dir), "severity")


_BULK = """d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2025-01-01' END AS deleted_at, c_mktsegment AS tag FROM customer),
 a AS (SELECT l_suppkey * 40 AS id, max(CASE WHEN l_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'OTHER' END) AS t FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_BULK}, j AS (SELECT a.id, t, d.id IS NOT NULL AS there, deleted_at, tag FROM a LEFT JOIN d USING (id))
 SELECT 'delete' AS action, id, CASE WHEN NOT there THEN 'missing' WHEN deleted_at IS NULL THEN 'done' ELSE 'unchanged' END AS outcome, CASE WHEN there THEN coalesce(deleted_at, TIMESTAMP '2026-01-01') END AS deleted_at, tag FROM j
 UNION ALL SELECT 'restore', id, CASE WHEN NOT there THEN 'missing' WHEN deleted_at IS NOT NULL THEN 'done' ELSE 'unchanged' END, NULL, tag FROM j
 UNION ALL SELECT 'tag', id, CASE WHEN NOT there THEN 'missing' WHEN deleted_at IS NULL AND tag <> t THEN 'done' ELSE 'unchanged' END, deleted_at, CASE WHEN there AND deleted_at IS NULL AND tag <> t THEN t ELSE tag END FROM j""")
def bulk_rows(spark, sf_dir):
    """What a bulk deletion, restoring and tagging leave of each document."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.lit("2025-01-01").cast("timestamp")).alias("deleted_at"), F.col("c_mktsegment").alias("tag"))
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 40).alias("document_id"), F.when(F.col("l_suppkey") % 2 == 0, "BUILDING").otherwise("OTHER").alias("tag"))
    parts = [rows.bulk_rows(docs, asked, a, F.lit("2026-01-01").cast("timestamp")).withColumn("action", F.lit(a)) for a in ("delete", "restore", "tag")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))


_BLANK = "[\\s\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace('  ' || replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace('  ' || replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM documents),
 c AS (SELECT doc_id, n, trim(regexp_replace(line, '[\\s\\x{0b}\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]+', ' ', 'g'), ' ') AS line FROM l),
 k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM c)
 SELECT doc_id, sha256(regexp_replace(array_to_string(list(line ORDER BY n) FILTER (line <> '' OR before IS DISTINCT FROM ''), chr(10)), '^\\n+|\\n+$', '', 'g')) AS digest FROM k GROUP BY 1""")
def diff_normal_forms(spark, sf_dir):
    """Normal forms of texts with blank lines and mixed line ends put in."""
    text = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".\r\n\n\n  ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.diff_normal(text), 256).alias("digest"))


@query("SELECT vec_id, greatest(0, least(1, label / 4.0::DOUBLE - 0.5)) AS score FROM embeddings")
def clamped_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", X.clamp01(F.col("label") / 4 - 0.5).alias("score"))


#: File types by first bytes, with what a file is called and declared as.
_HEADS = ["25504446", "504B0304", "D0CF11E0", "89504E47"]
_NAMES = ["report.PDF", "report.docx", "report.doc", "report", "report.exe"]
_DECLARED = ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"]


@query(f"""WITH f AS (SELECT doc_id, {_HEADS}[1 + doc_id % 4] AS head, {_NAMES}[1 + doc_id % 5] AS name, {_DECLARED}[1 + doc_id % 3] AS declared, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS length FROM documents),
 t AS (SELECT *, CASE head WHEN '25504446' THEN 'application/pdf' WHEN '504B0304' THEN 'application/zip' WHEN 'D0CF11E0' THEN 'application/msword' END AS detected, CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN '{_DECLARED[1]}' WHEN 'doc' THEN 'application/msword' END AS due,
   CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/zip' WHEN 'doc' THEN 'application/msword' END AS bytes FROM f)
 SELECT doc_id, detected, CASE WHEN due IS NULL THEN 'extension' WHEN length = 0 THEN 'empty' WHEN length > 104857600 THEN 'size' WHEN declared <> due THEN 'declared type' WHEN detected IS DISTINCT FROM bytes THEN 'content' END AS reason FROM t""")
def upload_checks(spark, sf_dir):
    """Documents as uploads whose name, declared type and first bytes may disagree."""

    def pick(values):
        return F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))

    content = F.concat(F.unhex(pick(_HEADS)), F.encode("text", "UTF-8"))
    uploads = table(spark, sf_dir, "documents").select("doc_id", pick(_NAMES).alias("name"), pick(_DECLARED).alias("declared"), X.sniff_type(content).alias("detected"), F.when(F.col("doc_id") % 17 == 0, 0).otherwise(F.col("n_chars")).alias("length"))
    return files.check_uploads(uploads).select("doc_id", "detected", "reason")


@query("""SELECT CAST(l_suppkey AS INT) AS page, l_orderkey AS block, string_agg('w' || l_partkey, ' ' ORDER BY l_linenumber, 'w' || l_partkey) AS text, min(l_quantity)::INT AS x0, min(l_linenumber)::INT AS y0, max(l_quantity + 10)::INT AS x1, max(l_linenumber + 5)::INT AS y1, round(avg(l_discount * 100), 2) AS conf
 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""")
def recognised_lines(spark, sf_dir):
    """Lines of recognised words: a supplier's line items of one order; returned ones were not recognised."""
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("page"), F.col("l_orderkey").alias("block"), F.lit(1).alias("par"), F.lit(1).alias("line"), F.col("l_linenumber").alias("word_no"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        F.when(F.col("l_returnflag") == "R", -1.0).otherwise(F.col("l_discount") * 100).alias("conf"), F.col("l_quantity").cast("int").alias("left"), F.col("l_linenumber").cast("int").alias("top"), F.lit(10).alias("width"), F.lit(5).alias("height"),
    )
    return files.ocr_lines(words).select("page", "block", "text", "x0", "y0", "x1", "y1", "conf")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 > 0")
def exported_events(spark, sf_dir):
    """Events exported as CSV and read back."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    files.export_csv(table(spark, sf_dir, "events").filter("event_id % 3 > 0").select("event_id", "user_id", "event_type"), path)
    return spark.read.option("header", "true").schema("event_id long, user_id long, event_type string").csv(path)


@query("SELECT event_id FROM events WHERE value < 20 ORDER BY ts DESC, event_id DESC LIMIT 1000")
def dead_letters(spark, sf_dir):
    """The thousand newest failures."""
    return files.newest(table(spark, sf_dir, "events").filter("value < 20"), "ts", "event_id").select("event_id")


@query("SELECT user_id AS job_id, min(event_id) AS event_id FROM events GROUP BY 1")
def claimed_once(spark, sf_dir):
    """The first pointer of each job."""
    return catalog.latest_per_key(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id"), "job_id", [F.asc("event_id")])
