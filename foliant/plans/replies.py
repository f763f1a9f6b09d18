"""Replies of a model, well formed and not, made from parts, and what their checks leave of them."""

from pyspark.sql import functions as F

from foliant.functions import replies as R
from foliant.plans.registry import query, table

#: Ten replies of each kind; NAME, TYPE and SIZE are a part's.
CONFLICT = [
    '{"is_conflict": true, "confidence": 0.SIZE, "reason": " NAME ", "conflict_topic": "TYPE"}', '```json\n{"is_conflict": false, "confidence": 1, "reason": "NAME"}\n```', 'Sure: {"is_conflict": true, "confidence": 1.SIZE} Anything else?',
    '{"is_conflict": true, "confidence": -SIZE, "conflict_topic": "  "}', '{"is_conflict": true, "confidence": "0.9"}', '{"is_conflict": "yes", "confidence": 0.9}', '{"is_conflict": tru', "[SIZE, 2]", '{"is_conflict": true, "confidence": true, "reason": 5}', "NAME",
]
MATERIALITY = [
    '{"materiality": "material", "rationale": " NAME "}', '```\n{"materiality": "stylistic"}\n```', '{"materiality": "Material"}', '{"materiality": 5}', "{}", '{"materiality": "stylistic", "rationale": SIZE}', 'so {"materiality": "material", "rationale": ""}', "none", '{"materiality": null}', '{"rationale": "TYPE"}',
]
ENTAILMENT = ['{"verdict": "yes"}', '{"verdict": " NO "}', '```json\n{"verdict": "Partial"}\n```', '{"verdict": "maybe"}', '{"verdict": true}', "yes", '{"verdict": ""}', "{}", '{"verdict": "partial", "x": "NAME"}', '{"verdict": "no"} SIZE']
ANALYSIS = [
    '{"intent": "comparison", "temporal_scope": {"year": 20SIZE}, "scope_hints": ["NAME", " ", 5, "TYPE "], "topic": " TYPE "}', '{"intent": "SUMMARY", "temporal_scope": {"year": "20SIZE"}, "temporal_scope_secondary": {"relative": " Last Year "}}', '{"topic": "NAME"}',
    '{"intent": "dance"}', '{"intent": 5}', '{"intent": "QUESTION", "temporal_scope": {"year": "soon", "relative": "NOW"}, "scope_hints": "NAME"}', "no", '{"intent": "EXTRACTION", "temporal_scope": 20SIZE, "topic": 5, "scope_hints": ["1","2","3","4","5","6","7","8","9","10","11","12"]}',
    '{"intent": "CHANGE_DETECTION", "temporal_scope": {"year": 20.5}}', '{"intent": null}',
]
EXTRACTION = [
    '{"requirement": ["NAME", " TYPE "], "risk": [], "date": ["SIZE"]}', '```json\n{"party": ["a", "b", "c", "d"], "risk": [1, null, "NAME", {"x": 1}]}\n```', '{"requirement": "NAME"}', "[]", "{}", '{"date": [["x"], "TYPE"]}', '{"risk": ["", " ", "NAME"]', "NAME", 'Here {"party": ["TYPE"]} done', '{"requirement": null, "date": true}',
]
SUMMARY = [
    '{"executive_summary": " NAME ", "key_points": ["a", " b "], "topics": ["TYPE"]}', '{"executive_summary": 5, "roles": ["NAME"]}', '```json\n{"risks": ["NAME", 5], "dates": "x"}\n```', "{}", '"NAME"', '{"executive_summary": null}', "{bad}", '{"requirements": ["", "TYPE", "NAME"]}', "[SIZE]", '{"executive_summary": "TYPE", "key_points": [null]}',
]


def replies(spark, sf_dir, kind):
    raw = F.get(F.array(*map(F.lit, kind)), (F.col("p_partkey") % 10).cast("int"))
    for mark, column in (("NAME", "p_name"), ("TYPE", "p_type"), ("SIZE", "p_size")):
        raw = F.replace(raw, F.lit(mark), F.col(column).cast("string"))
    # parts are one small file, which would be one task; a reply takes far longer to check than to move
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select("p_partkey", raw.alias("raw"))


def _rows(kind: list[str]) -> str:
    """SQL tables that end in rows (p_partkey, j: the reply's object as JSON, or null)."""
    listed = ", ".join("'" + k.replace("'", "''") + "'" for k in kind)
    return f"""raws AS (SELECT p_partkey, replace(replace(replace([{listed}][1 + p_partkey % 10], 'NAME', p_name), 'TYPE', p_type), 'SIZE', CAST(p_size AS VARCHAR)) AS raw FROM part),
 texts AS (SELECT p_partkey, CASE WHEN regexp_matches(raw, '(?s)\\{{.*\\}}') THEN regexp_extract(raw, '(?s)\\{{.*\\}}') ELSE regexp_replace(raw, '(?s)^```(?:json)?\\s*(.*?)\\s*```$', '\\1') END AS t FROM raws),
 rows AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t::JSON END END AS j FROM texts)"""


_NUMBER = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _text(name: str, most: int) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN nullif(substr(trim(json_extract_string(j, '$.{name}'), ' '), 1, {most}), '') END"


def _list(name: str, most: int = 1000000) -> str:
    items = f"list_transform(list_filter(CAST(json_extract(j, '$.{name}') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(json_extract_string(x, '$'), ' '))"
    return f"CASE WHEN json_type(j, '$.{name}') = 'ARRAY' THEN (list_filter({items}, lambda s: s <> ''))[1:{most}] ELSE [] END"


@query(f"""WITH {_rows(CONFLICT)}, ok AS (SELECT *, coalesce(json_type(j, '$.is_conflict') = 'BOOLEAN' AND json_type(j, '$.confidence') IN {_NUMBER}, false) AS valid FROM rows)
 SELECT p_partkey, valid, CASE WHEN valid THEN CAST(json_extract(j, '$.is_conflict') AS BOOLEAN) END AS is_conflict, CASE WHEN valid THEN greatest(0, least(1, CAST(json_extract(j, '$.confidence') AS DOUBLE))) END AS confidence,
  CASE WHEN valid THEN {_text("reason", 300)} END AS reason, CASE WHEN valid THEN {_text("conflict_topic", 80)} END AS topic FROM ok""")
def conflict_replies(spark, sf_dir):
    rows = replies(spark, sf_dir, CONFLICT).withColumn("r", R.conflict_reply(F.col("raw")))
    return rows.select("p_partkey", F.col("r").isNotNull().alias("valid"), "r.is_conflict", "r.confidence", "r.reason", "r.topic")


@query(f"""WITH {_rows(MATERIALITY)} SELECT p_partkey, CASE WHEN json_type(j, '$.materiality') = 'VARCHAR' AND json_extract_string(j, '$.materiality') IN ('material', 'stylistic') THEN json_extract_string(j, '$.materiality') END AS materiality,
 CASE WHEN json_type(j, '$.materiality') = 'VARCHAR' AND json_extract_string(j, '$.materiality') IN ('material', 'stylistic') THEN {_text("rationale", 200)} END AS rationale FROM rows""")
def materiality_replies(spark, sf_dir):
    rows = replies(spark, sf_dir, MATERIALITY).withColumn("r", R.materiality_reply(F.col("raw")))
    return rows.select("p_partkey", "r.materiality", "r.rationale")


@query(f"WITH {_rows(ENTAILMENT)}, w AS (SELECT p_partkey, CASE WHEN json_type(j, '$.verdict') = 'VARCHAR' THEN lower(trim(json_extract_string(j, '$.verdict'), ' ')) END AS word FROM rows) SELECT p_partkey, CASE WHEN word IN ('yes', 'no', 'partial') THEN word END AS verdict FROM w")
def entailment_replies(spark, sf_dir):
    return replies(spark, sf_dir, ENTAILMENT).select("p_partkey", R.entailment_reply(F.col("raw")).alias("verdict"))


def _time(name: str) -> tuple[str, str]:
    year = f"CASE WHEN json_type(j, '$.{name}.year') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(j, '$.{name}.year') AS BIGINT) WHEN json_type(j, '$.{name}.year') = 'VARCHAR' AND regexp_matches(json_extract_string(j, '$.{name}.year'), '^\\d+$') THEN CAST(json_extract_string(j, '$.{name}.year') AS BIGINT) END"
    return year, f"CASE WHEN ({year}) IS NULL AND json_type(j, '$.{name}.relative') = 'VARCHAR' THEN nullif(lower(trim(json_extract_string(j, '$.{name}.relative'), ' ')), '') END"


_YEAR, _RELATIVE = _time("temporal_scope")
_YEAR_2, _RELATIVE_2 = _time("temporal_scope_secondary")


@query(f"""WITH {_rows(ANALYSIS)}, w AS (SELECT *, CASE WHEN json_extract(j, '$.intent') IS NULL THEN CASE WHEN j IS NOT NULL THEN 'QUESTION' END WHEN json_type(j, '$.intent') = 'VARCHAR' THEN upper(json_extract_string(j, '$.intent')) END AS word FROM rows),
 ok AS (SELECT *, coalesce(word IN ('QUESTION', 'COMPARISON', 'CHANGE_DETECTION', 'SUMMARY', 'CONFLICT_DETECTION', 'EXTRACTION'), false) AS understood FROM w)
 SELECT p_partkey, understood, CASE WHEN understood THEN word ELSE 'QUESTION' END AS intent, CASE WHEN understood THEN {_YEAR} END AS year, CASE WHEN understood THEN {_RELATIVE} END AS relative, CASE WHEN understood THEN {_YEAR_2} END AS year_2,
  CASE WHEN understood THEN {_RELATIVE_2} END AS relative_2, CASE WHEN understood THEN {_list("scope_hints", 10)} ELSE [] END AS hints, CASE WHEN understood THEN {_text("topic", 60)} END AS topic FROM ok""")
def analysis_replies(spark, sf_dir):
    rows = replies(spark, sf_dir, ANALYSIS).withColumn("r", R.analysis_reply(F.col("raw")))
    times = ["r.scope.year", "r.scope.relative", F.col("r.scope_secondary.year").alias("year_2"), F.col("r.scope_secondary.relative").alias("relative_2")]
    return rows.select("p_partkey", "r.understood", "r.intent", *times, "r.hints", "r.topic")


@query(f"WITH {_rows(EXTRACTION)} SELECT p_partkey, j IS NOT NULL AS valid, " + ", ".join(f"CASE WHEN j IS NOT NULL THEN {_list(c, 3)} END AS {c}" for c in ("requirement", "risk", "date", "party")) + " FROM rows")
def extraction_replies(spark, sf_dir):
    rows = replies(spark, sf_dir, EXTRACTION).withColumn("r", R.extraction_reply(F.col("raw"), 3))
    return rows.select("p_partkey", F.col("r").isNotNull().alias("valid"), "r.*")


@query(f"WITH {_rows(SUMMARY)} SELECT p_partkey, j IS NOT NULL AS valid, CASE WHEN j IS NOT NULL THEN coalesce({_text('executive_summary', 1000000)}, '') END AS executive_summary, " + ", ".join(f"CASE WHEN j IS NOT NULL THEN {_list(c)} END AS {c}" for c in R.SUMMARY_LISTS) + " FROM rows")
def summary_replies(spark, sf_dir):
    rows = replies(spark, sf_dir, SUMMARY).withColumn("r", R.summary_reply(F.col("raw")))
    return rows.select("p_partkey", F.col("r").isNotNull().alias("valid"), "r.*")
