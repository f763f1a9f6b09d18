"""Listings, life cycles and assembled rows of versions, conflicts, messages and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.functions import rules


def numbered(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """Adds place (from 1) and total in each group: ordered children as rows, so no group becomes one list."""
    w = Window.partitionBy(*group)
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))


def page_of(rows: DataFrame, group: list[str], order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of each group's rows in order, with place and total."""
    return numbered(rows, group, order).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def merged_runs(runs: list[DataFrame], order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of the rows of all runs merged in order, with the total over the runs (one number, so one row is broadcast)."""
    rows = runs[0]
    for more in runs[1:]:
        rows = rows.unionByName(more)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def forbidden(asked: DataFrame, accessible: DataFrame, key: str) -> DataFrame:
    """Asked rows outside what is accessible; any such row forbids the request."""
    return asked.join(accessible.select(key).distinct(), key, "left_anti")


def get_or_create(asked: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id and created: the latest existing row (keys, id) of each asked key, or none yet. Equal asked keys are one."""
    latest = existing.groupBy(*keys).agg(F.max("id").alias("id"))
    return asked.select(*keys).distinct().join(latest, keys, "left").withColumn("created", F.col("id").isNull())


def life_cycle(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """id, status, payload, stale: rows after updates (id, status, payload). A failure keeps the old payload; success clears stale."""
    u = updates.select("id", F.col("status").alias("_status"), F.col("payload").alias("_payload"))
    done = F.col("_status") == "COMPLETED"
    joined = rows.join(u, "id", "left")
    payload = F.when(done, F.coalesce("_payload", "payload")).otherwise(F.col("payload"))
    return joined.select("id", F.coalesce("_status", "status").alias("status"), payload.alias("payload"), F.when(done, False).otherwise(F.col("stale")).alias("stale"))


def resolve_once(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """conflict_id, status, resolved_by: only OPEN conflicts take a resolution (conflict_id, by); resolved ones stay as they are."""
    taken = (F.col("status") == "OPEN") & F.col("by").isNotNull()
    first = resolutions.groupBy("conflict_id").agg(F.min("by").alias("by"))
    joined = conflicts.join(first, "conflict_id", "left")
    return joined.select("conflict_id", F.when(taken, "RESOLVED").otherwise(F.col("status")).alias("status"), F.when(taken, F.col("by")).otherwise(F.col("resolved_by")).alias("resolved_by"))


def recent_conflicts(conflicts: DataFrame, hints: list[str], most: int = 10) -> DataFrame:
    """The newest open conflicts (conflict_id, topic, status, at) whose topic holds any hint; no hint: all."""
    hints = [h.lower() for h in hints if h.strip()]
    rows = conflicts.filter("status = 'OPEN'")
    if hints:
        rows = rows.filter(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower("topic"), h)))
    return rows.orderBy(F.desc("at"), F.desc("conflict_id")).limit(most)


def conflict_rows(conflicts: DataFrame, statements: DataFrame, states: DataFrame) -> DataFrame:
    """conflicts with statements, documents and priority: ACTIVE if every statement's version (version_id, state) is CURRENT.

    statements: conflict_id, document_id, version_id. Unknown versions count as superseded; a conflict without statements has 0 and is LIKELY_RESOLVED.
    """
    live = F.coalesce(F.col("state") == "CURRENT", F.lit(False))
    counted = statements.join(states, "version_id", "left").groupBy("conflict_id").agg(
        F.count("*").alias("statements"), F.count_distinct("document_id").alias("documents"), F.bool_and(live).alias("_live")
    )
    joined = conflicts.join(counted, "conflict_id", "left")
    zero = F.lit(0).cast("long")
    return joined.withColumn("statements", F.coalesce("statements", zero)).withColumn("documents", F.coalesce("documents", zero)).withColumn("priority", F.when(F.col("_live"), "ACTIVE").otherwise("LIKELY_RESOLVED")).drop("_live")


def seeded_conflicts(changes: DataFrame, states: DataFrame) -> DataFrame:
    """change_id and topic of changes that start a conflict: MODIFIED, MAJOR, both chunks known, both versions CURRENT.

    changes: change_id, change_type, severity, section, a_version, b_version, a_chunk, b_chunk; states: version_id, state.
    """
    current = states.filter("state = 'CURRENT'").select("version_id")
    rows = changes.filter("change_type = 'MODIFIED' AND severity = 'MAJOR' AND a_chunk IS NOT NULL AND b_chunk IS NOT NULL")
    for side in ("a_version", "b_version"):
        rows = rows.join(current, rows[side] == current["version_id"], "left_semi")
    return rows.select("change_id", F.concat(F.coalesce("section", F.lit("Document")), F.lit(" — Version Discrepancy")).alias("topic"))


def scan_status(orgs: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """org, last_status, completed_at, created and unscanned (active documents made after the last completed scan).

    jobs: org, job_id, status, at, completed_at, created; documents: org, made_at.
    """
    latest = jobs.groupBy("org").agg(F.max_by("status", F.struct("at", "job_id")).alias("last_status"))
    done = jobs.filter("status = 'COMPLETED'").groupBy("org").agg(F.max("completed_at").alias("completed_at"), F.max_by(F.coalesce("created", F.lit(0)), F.struct("completed_at", "job_id")).alias("created"))
    fresh = documents.join(done.select("org", "completed_at"), "org", "left").filter("completed_at IS NULL OR made_at > completed_at").groupBy("org").agg(F.count("*").alias("unscanned"))
    out = orgs.select("org").join(latest, "org", "left").join(done, "org", "left").join(fresh, "org", "left")
    return out.withColumn("unscanned", F.coalesce("unscanned", F.lit(0).cast("long")))


def next_job(versions: DataFrame, done: DataFrame) -> DataFrame:
    """version_id and next: the first pipeline job that the version has not done (version_id, job), or READY."""
    jobs = F.array(*map(F.lit, rules.PIPELINE_JOBS))
    finished = done.groupBy("version_id").agg(F.collect_set("job").alias("_done"))
    left = F.array_except(jobs, F.coalesce("_done", F.array().cast("array<string>")))
    return versions.join(finished, "version_id", "left").select("version_id", F.coalesce(F.get(left, F.lit(0)), F.lit("READY")).alias("next"))


def transitions(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each step of a key's states in order with allowed; the first state of a key is no step."""
    rows = history.withColumn("before", F.lag("status").over(Window.partitionBy(key).orderBy(*order))).filter("before IS NOT NULL")
    return rows.withColumn("allowed", rules.version_step_allowed(F.col("before"), F.col("status")))


def effective_scope(scopes: DataFrame) -> DataFrame:
    """chat_id, first and second document of chats that name exactly one or two documents (chat_id, document_id); others have no scope."""
    named = scopes.filter("document_id IS NOT NULL").groupBy("chat_id").agg(F.count_distinct("document_id").alias("n"), F.min("document_id").alias("first"), F.max("document_id").alias("_last"))
    return named.filter("n <= 2").select("chat_id", "first", F.when(F.col("n") == 2, F.col("_last")).alias("second"))


def fill_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """document_id, used and added: chunks not claimed by a section (document_id, order, chunk_id, cost, claimed) join in reading order while they fit.

    One fold over the chunks of one document; those over what is left are passed over.
    """
    free = F.array_sort(F.collect_list(F.when(~F.col("claimed"), F.struct("order", "chunk_id", F.col("cost").cast("long").alias("cost")))))
    grouped = chunks.groupBy("document_id").agg(free.alias("rows"), F.coalesce(F.sum(F.when(F.col("claimed"), F.col("cost"))), F.lit(0)).cast("long").alias("taken"))
    start = F.struct(F.col("taken").alias("used"), F.array().cast("array<long>").alias("added"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["added"], F.array(x["chunk_id"].cast("long")))).otherwise(s["added"]).alias("added"))

    packed = F.aggregate("rows", start, step)
    return grouped.select("document_id", packed["used"].alias("used"), packed["added"].alias("added"))


def carried_sections(lines: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, line_no) with section: the order of the last heading (key, line_no, sort_order) at or before the line, null before the first."""
    marked = lines.join(heads.select(key, "line_no", "sort_order"), [key, "line_no"], "left")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("section", F.last("sort_order", ignorenulls=True).over(before)).drop("sort_order")


def conversations(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """conv_id, messages, questions, last_turn of conversations not deleted."""
    live = rows.join(deleted.select("conv_id"), "conv_id", "left_anti")
    return live.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))


def pending_embeddings(chunks: DataFrame, key: str, batch: int = 100) -> DataFrame:
    """key and batch number of chunks whose vector is missing, in order within each document (document_id)."""
    at = F.row_number().over(Window.partitionBy("document_id").orderBy(key)) - 1
    return chunks.filter("embedding IS NULL").select("document_id", key, F.floor(at / batch).cast("int").alias("batch"))
