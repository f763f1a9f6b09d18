"""Pipelines over documents: extraction with evidence, summaries told, conflicts seeded by comparisons, files read by type."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from foliant.functions import replies as R
from foliant.operators import library, pipelines
from foliant.plans import conflicts
from foliant.plans import library as library_plans
from foliant.plans import replies as reply_plans
from foliant.plans.registry import query, table
from foliant.sources import files


@query("""WITH q AS (SELECT vec_id AS at_no, embedding FROM embeddings WHERE vec_id < 4), s AS (SELECT e.vec_id AS chunk_id, at_no, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY at_no ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8), b AS (SELECT chunk_id, max(score) AS similarity, min((at_no, rank)) AS first FROM r GROUP BY 1)
 SELECT chunk_id, similarity, CAST(row_number() OVER (ORDER BY first) AS INT) AS place FROM b""")
def category_evidence(spark, sf_dir):
    """The first four vectors stand for the questions of the four categories."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = {str(r["vec_id"]): list(r["embedding"]) for r in vectors.filter("vec_id < 4").orderBy("vec_id").collect()}
    return pipelines.category_evidence(vectors.withColumnRenamed("vec_id", "chunk_id"), asked)


def answered(spark, sf_dir):
    """For each group of twenty documents a reply that quotes the first sentences of its sources; some items have no source, a wrong one, or are no text."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.floor(F.col("doc_id") / 20).alias("message_id"), (F.col("doc_id") % 20 + 1).cast("int").alias("citation_index"), F.col("text").alias("content"))
    said = F.regexp_replace(F.substring(F.regexp_extract("content", r"^[^.!?\n\[\]]*", 0), 1, 80), r"\s+$", "")
    mark = F.when(F.col("citation_index") % 4 == 0, "").when(F.col("citation_index") % 7 == 0, " [77]").otherwise(F.concat(F.lit(" ["), F.col("citation_index").cast("string"), F.lit("]")))
    items = docs.select("message_id", "citation_index", F.concat(said, F.lit(" holds"), mark, F.lit(".")).alias("item"))
    every = F.array_sort(F.collect_list(F.struct("citation_index", "item")))

    def of(kind: int):
        return F.transform(F.filter("items", lambda x: x["citation_index"] % 4 == kind), lambda x: x["item"])

    listed = items.groupBy("message_id").agg(every.alias("items"))
    raw = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(of(1).alias("requirement"), of(2).alias("risk"), of(3).alias("date"), of(0).alias("party"))), F.lit("\n```"))
    return listed.select("message_id", raw.alias("raw")), docs


@query(None)
def extraction_pipeline(spark, sf_dir):
    """The items that stand of each group's reply; every fifth check says no."""
    replies, sources = answered(spark, sf_dir)
    numbers = sources.select("message_id", "citation_index").withColumn("claim_no", F.explode(F.sequence(F.lit(0), F.lit(19))))
    verdicts = numbers.withColumn("verdict", F.when((F.col("claim_no") + F.col("citation_index")) % 5 == 0, "no").otherwise("yes"))
    return pipelines.extracted_items(replies, sources, verdicts).select("message_id", "category", "item_index", "label", "citation_index", F.sha2("quoted", 256).alias("quoted"))


def _told(name: str, heading: str, empty: str) -> str:
    items = reply_plans._list(name)
    return f"chr(10) || chr(10) || '**{heading}:**' || chr(10) || CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10)) ELSE '_{empty}_' END"


@query(f"""WITH {reply_plans._rows(reply_plans.SUMMARY)} SELECT p_partkey, CASE WHEN j IS NULL THEN 'The summary for this document is not available yet.' ELSE coalesce({reply_plans._text("executive_summary", 1000000)}, '_The document produced no executive summary._') || {" || ".join(_told(*s) for s in pipelines.SECTIONS)}
 || CASE WHEN len({reply_plans._list("topics")}) > 0 THEN chr(10) || chr(10) || '**Topics:** ' || array_to_string({reply_plans._list("topics")}, ', ') ELSE '' END END AS text FROM rows""")
def narrated_summaries(spark, sf_dir):
    rows = reply_plans.replies(spark, sf_dir, reply_plans.SUMMARY).withColumn("summary", R.summary_reply(F.col("raw")))
    return pipelines.narrated_summary(rows, "summary").select("p_partkey", "text")


_SEEDED = f"""{library_plans._STATES.replace("WITH", "WITH RECURSIVE", 1)}, pairs AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS change_id, l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 25 AND l_linenumber <> 4 AND l_orderkey IN (SELECT version_id FROM states WHERE state = 'CURRENT') AND l_partkey IN (SELECT version_id FROM states WHERE state = 'CURRENT')
   QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_suppkey, l_partkey) = 1),
 members AS (SELECT CAST(s_nationkey AS BIGINT) AS conflict_id, s_suppkey AS chunk_id, CASE WHEN s_nationkey % 2 = 0 THEN 'OPEN' ELSE 'REVIEWED' END AS status, s_nationkey AS detected_at FROM supplier WHERE s_nationkey < 10)"""


@query(f"{_SEEDED}, {conflicts.merged_sql('change_id')} SELECT f.change_id, f.a, f.b, f.outcome, f.conflict_id, o.change_id AS opened_by, f.joined FROM final f LEFT JOIN numbered o ON o.seq = f.opened")
def seeded_merge(spark, sf_dir):
    """Conflicts that comparisons open or extend: seeds among the line items, merged into conflicts of suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"), F.when(F.col("l_returnflag") == "N", "MODIFIED").otherwise("ADDED").alias("change_type"),
        F.when(F.col("l_quantity") > 25, "MAJOR").otherwise("MINOR").alias("severity"), F.lit(None).cast("string").alias("section"), F.col("l_orderkey").alias("a_version"), F.col("l_partkey").alias("b_version"),
        F.col("l_suppkey").alias("a_chunk"), F.when(F.col("l_linenumber") != 4, 1000000 + F.col("l_partkey")).alias("b_chunk"),
    )
    kept = lines.join(library.seeded_conflicts(lines, library_plans.states(spark, sf_dir)).select("change_id").distinct(), "change_id", "left_semi")
    valid = kept.filter("change_type = 'MODIFIED' AND severity = 'MAJOR' AND b_chunk IS NOT NULL")
    current = library_plans.states(spark, sf_dir).filter("state = 'CURRENT'").select(F.col("version_id").alias("b_version"))
    one = valid.join(current, "b_version", "left_semi").groupBy("change_id").agg(F.min(F.struct("a_chunk", "b_chunk")).alias("c")).select("change_id", "c.a_chunk", "c.b_chunk")
    seeds = one.select("change_id", F.lit("Document — Version Discrepancy").alias("topic"))
    supplier = table(spark, sf_dir, "supplier").filter("s_nationkey < 10")
    members = supplier.select(F.col("s_nationkey").cast("long").alias("conflict_id"), F.col("s_suppkey").alias("chunk_id"), F.when(F.col("s_nationkey") % 2 == 0, "OPEN").otherwise("REVIEWED").alias("status"), F.col("s_nationkey").alias("detected_at"))
    merged = pipelines.seeded_merge(one, seeds, members)
    return merged.select(F.col("seq").alias("change_id"), "a", "b", "outcome", "conflict_id", "opened_by", "joined")


def docx_bytes(text: str) -> bytes:
    """A small DOCX with a paragraph for each line; lines with bars are table rows."""
    body = []
    for line in (text or "").split("\n"):
        if " | " in line:
            cells = "".join(f'<w:tc><w:p><w:r><w:t xml:space="preserve">{escape(c)}</w:t></w:r></w:p></w:tc>' for c in line.split(" | "))
            body.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
        else:
            body.append(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


_CLEAN_TEXT = "regexp_replace(text, '[\\x{00}-\\x{08}\\x{0b}-\\x{1f}\\x{fffe}\\x{ffff}]', '', 'g')"


@query(f"""SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 < 2 THEN 1 END AS page_number, sha256(CASE doc_id % 3 WHEN 0 THEN array_to_string(list_filter(string_split({_CLEAN_TEXT}, chr(10)), lambda x: regexp_replace(x, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}\\x{{2028}}\\x{{2029}}]+', '', 'g') <> ''), chr(10)) WHEN 1 THEN {_CLEAN_TEXT} END) AS digest, CASE WHEN doc_id % 3 = 2 THEN 'unsupported' END AS reason FROM documents""")
def parsed_files(spark, sf_dir):
    """Documents as files of three kinds, read by the parser of their type."""

    @F.pandas_udf("binary")
    def as_docx(texts: pd.Series) -> pd.Series:
        return texts.map(docx_bytes)

    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]", "")
    kind = F.col("doc_id") % 3
    content = F.when(kind == 0, as_docx(clean)).when(kind == 1, F.encode(clean, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("25504446")), F.encode(clean, "UTF-8")))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    pages = files.parsed_pages(table(spark, sf_dir, "documents").select(name.alias("path"), content.alias("content"), F.when(kind == 0, "docx").when(kind == 1, "text").otherwise("pdf").alias("kind")))
    return pages.select("path", "page_number", F.sha2("text", 256).alias("digest"), "reason")
