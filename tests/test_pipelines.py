"""The extraction pipeline on a reply worked out by hand, and odd replies."""

import json

from foliant.operators import pipelines
from foliant.sources import files
from pyspark.sql import functions as F


def test_items_stand_by_their_claims(spark):
    reply = {
        "requirement": ["Staff report losses [1].", "Staff report losses [1].", "Nobody knows."],
        "risk": ["Late filing costs money [2].", "Wrong source [9].", "Not true [1]."],
        "party": ["Acme pays [1][2]."],
    }
    replies = spark.createDataFrame([(1, f"Sure\n```json\n{json.dumps(reply)}\n```"), (2, "no object"), (3, "{}"), (4, None)], "message_id long, raw string")
    sources = spark.createDataFrame([(1, 1, "Staff report losses at once."), (1, 2, "Late filing costs money. Acme pays."), (3, 1, "x")], "message_id long, citation_index int, content string")
    said = [(1, c, i, "no" if c == 5 else "yes") for c in range(7) for i in (1, 2)]
    verdicts = spark.createDataFrame(said, "message_id long, claim_no int, citation_index int, verdict string")
    got = sorted((r["category"], r["item_index"], r["label"], r["citation_index"], r["quoted"]) for r in pipelines.extracted_items(replies, sources, verdicts).collect())
    assert got == [
        ("party", 0, "Acme pays .", 1, "Staff report losses at once."),
        ("requirement", 0, "Staff report losses .", 1, "Staff report losses at once."), ("requirement", 1, "Staff report losses .", 1, "Staff report losses at once."),
        ("risk", 0, "Late filing costs money .", 2, "Late filing costs money. Acme pays."),
    ]


def test_quotes_are_sought_once_and_replies_are_parsed_once(spark):
    replies = spark.createDataFrame([(1, json.dumps({"risk": ["Late filing costs money [1]."]}))], "message_id long, raw string")
    sources = spark.createDataFrame([(1, 1, "s")], "message_id long, citation_index int, content string")
    verdicts = spark.createDataFrame([(1, 0, 1, "yes")], "message_id long, claim_no int, citation_index int, verdict string")
    found = pipelines.extracted_items(replies, sources, verdicts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_backing(") == 1 and "parse_json" not in plan
    assert [(r["label"], r["quoted"]) for r in found.collect()] == [("Late filing costs money .", "s")]


def test_budget_of_checks_leaves_later_items_unverified_but_kept(spark):
    reply = {"date": [f"Day {i} counts [1]." for i in range(8)]}
    replies = spark.createDataFrame([(1, json.dumps(reply))], "message_id long, raw string")
    sources = spark.createDataFrame([(1, 1, "s")], "message_id long, citation_index int, content string")
    verdicts = spark.createDataFrame([(1, c, 1, "no") for c in range(8)], "message_id long, claim_no int, citation_index int, verdict string")
    got = sorted(r["label"] for r in pipelines.extracted_items(replies, sources, verdicts).collect())
    assert got == [f"Day {i} counts ." for i in (5, 6, 7)]  # the first five were checked and fell


def test_files_go_to_the_parser_of_their_kind(spark):
    rows = [("a", b"plain \xc3\xa9", "text"), ("b", b"\xff\xfe", "text"), ("c", b"no zip", "docx"), ("d", b"%PDF", "pdf"), ("e", None, "text")]
    got = {r["path"]: (r["page_number"], r["text"], r["reason"]) for r in files.parsed_pages(spark.createDataFrame(rows, "path string, content binary, kind string")).collect()}
    assert got["a"] == (1, "plain é", None) and got["c"] == (None, None, "unreadable") and got["d"] == (None, None, "unsupported") and got["b"] == got["e"] == (None, None, "unreadable")


def test_a_missing_summary_is_told(spark):
    rows = spark.createDataFrame([(1, None), (2, (" Whole. ", ["a", " "], None, [], ["t", "u"]))], "id int, s struct<executive_summary:string,key_points:array<string>,dates:array<string>,roles:array<string>,topics:array<string>>")
    rows = rows.withColumn("s", F.when(F.col("s").isNotNull(), F.struct("s.*", F.array().cast("array<string>").alias("requirements"), F.lit(None).cast("array<string>").alias("risks"))))
    got = {r["id"]: r["text"] for r in pipelines.narrated_summary(rows, "s").collect()}
    assert got[1].startswith("The summary") and got[2].startswith("Whole.\n\n**Key points:**\n- a\n\n**Dates:**\n_No dates") and got[2].endswith("**Topics:** t, u")
