"""The streams give what the batch twins give."""

from pyspark.sql import functions as F

from foliant.operators import jobs
from foliant.streaming import feed


def run(spark, tmp_path, stream, name):
    out = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    return spark.table(name)


def test_status_changes_over_several_batches(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("key"), "id", F.when(F.col("id") % 7 < 4, "A").otherwise("B").alias("status"))
    for i in range(3):
        rows.filter(f"id >= {20 * i} AND id < {20 * i + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run(spark, tmp_path, feed.status_changes(stream), "changes").select("key", "id", "status").collect()))
    batch = jobs.change_feed(rows, key="key", time="id", status="status", tie="id").select("key", "id", "status")
    assert got == sorted(map(tuple, batch.collect()))


def test_pointers_are_claimed_once(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 5).alias("job"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, feed.claim_once(stream, key="job", time="ts"), "claims").count() == 5


EVENTS = "job_id long, event_id long, ts timestamp, kind string, deterministic boolean, max_attempts int"


def job_events():
    """Three jobs through start, failure, retry and end, with steps that are not allowed; later rows only push the watermark on."""
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    rows = [
        (1, 0, "submit"), (1, 1, "start"), (1, 2, "fail"), (1, 3, "start"), (1, 30, "start"), (1, 31, "succeed"), (1, 32, "start"), (1, 33, "submit"),
        (2, 0, "submit"), (2, 1, "start"), (2, 2, "fail"), (2, 20, "start"), (2, 21, "fail"), (2, 22, "start"), (3, 5, "start"), (3, 6, "submit"), (3, 7, "submit"),
    ]
    out = [(job, i, begin + timedelta(seconds=at), kind, False, 3 if job == 1 else 2) for i, (job, at, kind) in enumerate(rows)]
    return out + [(99, 100 + i, begin + timedelta(seconds=s), "submit", False, 1) for i, s in enumerate((18, 19, 60, 9000, 9100))], begin


def by_batches(spark, tmp_path, rows, schema, cuts):
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame([r for r in rows if low <= (r[2] - rows[0][2].replace(hour=0, minute=0, second=0)).total_seconds() < high], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{low}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_jobs_wait_and_end_over_batches_and_restarts(spark, tmp_path):
    from foliant.streaming import lifecycle

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKS)
    rows, begin = job_events()
    for cuts in ([0, 3, 15, 18.5], [18.5, 19.5, 25, 50, 100, 9050, 10000]):  # stopped after the first batches, then taken up from the checkpoint
        stream = by_batches(spark, tmp_path, rows, EVENTS, cuts)
        query = lifecycle.job_steps(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = [(r["job_id"], int((r["ts"] - begin).total_seconds()), r["before"], r["status"], r["attempts"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("job_id < 99").orderBy("job_id", "ts").collect()]
    assert got == [
        (1, 0, None, "PENDING", 0, True), (1, 1, "PENDING", "PROCESSING", 1, True), (1, 2, "PROCESSING", "RETRYING", 1, True), (1, 3, "RETRYING", "PROCESSING", 2, True),
        (1, 30, "PROCESSING", "PROCESSING", 2, False), (1, 31, "PROCESSING", "COMPLETED", 2, True), (1, 32, "COMPLETED", "COMPLETED", 2, False), (1, 33, "COMPLETED", "COMPLETED", 2, False),
        (2, 0, None, "PENDING", 0, True), (2, 1, "PENDING", "PROCESSING", 1, True), (2, 2, "PROCESSING", "RETRYING", 1, True), (2, 7, "RETRYING", "PENDING", 1, True),
        (2, 20, "PENDING", "PROCESSING", 2, True), (2, 21, "PROCESSING", "FAILED", 2, True), (2, 22, "FAILED", "FAILED", 2, False), (3, 5, None, None, 0, False), (3, 6, None, "PENDING", 0, True), (3, 7, "PENDING", "PENDING", 0, False),
    ]
    state = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "state"))
    assert {r["key"][0] for r in state.select("key").collect()} == {3, 99}  # final jobs are forgotten


def test_breaker_over_batches(spark, tmp_path):
    from datetime import datetime, timedelta

    from foliant.streaming import lifecycle

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKS)
    begin = datetime(2024, 1, 1)
    calls = [("a", i, begin + timedelta(seconds=10 * i), i not in (3, 30)) for i in range(40)] + [("b", 100, begin, False)]
    stream = by_batches(spark, tmp_path, calls, "provider string, call_id long, ts timestamp, failed boolean", [0, 55, 130, 1000])
    want, failures, until = {}, 0, begin
    for _, i, ts, failed in calls[:40]:
        admitted, opened = ts >= until, False
        if admitted:
            failures = failures + 1 if failed else 0
            opened = failures >= 5
            until = ts + timedelta(seconds=60) if opened else begin
        want[i] = (admitted, opened)
    got = {r["call_id"]: (r["admitted"], r["opened"]) for r in run(spark, tmp_path, lifecycle.breaker_calls(stream), "calls").collect()}
    assert got == want | {100: (True, False)} and not all(a for a, _ in want.values())


def test_status_changes_forget_final_keys(spark, tmp_path):
    rows = [(1, 1, "A"), (1, 2, "COMPLETED"), (2, 3, "A")]
    spark.createDataFrame(rows, "key long, id long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema("key long, id long, status string").parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, feed.status_changes(stream), "finals").count() == 3
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() == 1


def stopped_then_resumed(spark, tmp_path, stream, write):
    """Runs a sink that stops right after it has written its second batch, and again from the checkpoint."""
    seen = []

    def fails(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch_id)
        if len(seen) == 2:
            raise RuntimeError("stopped")

    for go in range(2):
        query = stream.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as stop:
            assert go == 0 and "stopped" in str(stop)
    assert seen.count(1) == 2  # the second batch came twice


def batches_of(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_upserts_resume_without_loss_or_repeat(spark, tmp_path):
    from foliant.streaming import sinks

    parts = [[(1, 1, "a", 1), (1, 2, "b", 1), (2, 1, "c", 1)], [(1, 2, "B", 2), (1, 3, "d", 2), (1, 3, "D", 3)], [(3, 1, "e", 1)]]
    stream = batches_of(spark, tmp_path, parts, "version long, chunk long, content string, at long")
    stopped_then_resumed(spark, tmp_path, stream, sinks.upsert_batches(str(tmp_path / "out"), "version", ["chunk"], ["at"]))
    got = {(r["version"], r["chunk"]): r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): "a", (1, 2): "B", (1, 3): "D", (2, 1): "c", (3, 1): "e"} and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_appends_resume_without_loss_or_repeat(spark, tmp_path):
    from foliant.streaming import sinks

    stream = batches_of(spark, tmp_path, [[(i, "x")] * 2 for i in range(4)], "id long, v string")
    stopped_then_resumed(spark, tmp_path, stream, sinks.append_batches(str(tmp_path / "out")))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_embeddings_resume_and_skip_what_is_stored(spark, tmp_path):
    from foliant.streaming import sinks

    parts = [[(1, "one"), (2, "two")], [(2, "two"), (3, "one"), (3, "one")], [(4, "four")]]
    stream = batches_of(spark, tmp_path, parts, "chunk_id long, content string")
    stopped_then_resumed(spark, tmp_path, stream, sinks.embedding_batches(str(tmp_path / "out"), 16))
    got = {r["chunk_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert got[1]["embedding"] == got[3]["embedding"] != got[2]["embedding"] and got[3]["batch"] == 1 and len(got[4]["embedding"]) == 16
