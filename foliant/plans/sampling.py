"""Sampling of long documents: a supplier's line items are the chunks of one document."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import sampling as S
from foliant.plans.registry import query, table

BUDGET, TAKE = 900, 2
#: Sections 100 to 102 by return flag, with one child a ship mode, and 900 to 903 that hold pages alone; every seventh supplier has none, every fifth is short.
_INPUT = """chunks AS (SELECT l_suppkey AS document_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_index, l_orderkey * 10 + l_linenumber AS chunk_id, CAST((row_number() OVER w - 1) // 8 + 1 AS INT) AS page,
   CASE WHEN l_linenumber <= 5 THEN 100 + ascii(l_returnflag) % 3 + 10 * (1 + l_quantity::BIGINT % 7) END AS section_id, CAST(l_quantity AS BIGINT) // CASE WHEN l_suppkey % 5 = 0 THEN 60 ELSE 1 END AS cost
   FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)),
 named AS (SELECT DISTINCT document_id, section_id FROM chunks WHERE section_id IS NOT NULL AND document_id % 7 <> 3),
 sections AS (SELECT document_id, section_id::BIGINT AS section_id, (100 + section_id % 10)::BIGINT AS parent_id, (section_id - 100)::INT AS sort_order, 1 AS page, 1 AS end_page FROM named
   UNION ALL SELECT DISTINCT document_id, (100 + section_id % 10)::BIGINT, NULL, (section_id % 10)::INT, 1, 1 FROM named
   UNION ALL SELECT document_id, 900 + i, NULL, (200 + i)::INT, (2 * i)::INT, CASE WHEN i = 1 THEN NULL ELSE (2 * i + (document_id + i) % 3)::INT END FROM (SELECT DISTINCT document_id FROM named), unnest(range(0, 4)) n(i))"""


def parts(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    at = F.row_number().over(order) - 1
    section = F.when(F.col("l_linenumber") <= 5, 100 + F.ascii("l_returnflag") % 3 + 10 * (1 + F.col("l_quantity").cast("long") % 7)).cast("long")
    cost = F.floor(F.col("l_quantity").cast("long") / F.when(F.col("l_suppkey") % 5 == 0, 60).otherwise(1))
    rows = table(spark, sf_dir, "lineitem").withColumn("chunk_index", at)
    chunks = rows.select(F.col("l_suppkey").alias("document_id"), "chunk_index", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), (F.floor(F.col("chunk_index") / 8) + 1).cast("int").alias("page"), section.alias("section_id"), cost.alias("cost"))
    named = chunks.filter("section_id IS NOT NULL AND document_id % 7 <> 3").select("document_id", "section_id").distinct()
    kind = (F.col("section_id") % 10).cast("int")
    one, none = F.lit(1), F.lit(None).cast("long")
    children = named.select("document_id", "section_id", (100 + kind).cast("long").alias("parent_id"), (F.col("section_id") - 100).cast("int").alias("sort_order"), one.alias("page"), one.alias("end_page"))
    top = named.select("document_id", (100 + kind).cast("long").alias("section_id"), none.alias("parent_id"), kind.alias("sort_order"), one.alias("page"), one.alias("end_page")).distinct()
    paged = named.select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    end = F.when(F.col("i") != 1, 2 * F.col("i") + (F.col("document_id") + F.col("i")) % 3).cast("int")
    paged = paged.select("document_id", (900 + F.col("i")).cast("long").alias("section_id"), none.alias("parent_id"), (200 + F.col("i")).alias("sort_order"), (2 * F.col("i")).alias("page"), end.alias("end_page"))
    return children.unionByName(top).unionByName(paged), chunks


@query(f"""WITH RECURSIVE {_INPUT}, docs AS (SELECT document_id, list(struct_pack(at_no := chunk_index, id := chunk_id, cost := cost, page := page, top := CASE WHEN document_id % 7 <> 3 THEN (section_id % 10)::INT END) ORDER BY chunk_index) AS r, sum(cost)::BIGINT AS total FROM chunks GROUP BY 1),
 tops AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY sort_order) AS n, sort_order, section_id, page, coalesce(end_page, page) AS end_page FROM sections WHERE parent_id IS NULL),
 walk AS (SELECT document_id, 0::BIGINT AS n, []::INT[] AS taken, []::BIGINT[] AS included FROM docs
   UNION ALL SELECT document_id, n, list_concat(taken, picked), CASE WHEN len(picked) > 0 THEN list_append(included, section_id) ELSE included END FROM (
   SELECT *, list_transform(from_rows[1 + (len(from_rows) - least(len(from_rows), {TAKE})) // 2 : (len(from_rows) - least(len(from_rows), {TAKE})) // 2 + least(len(from_rows), {TAKE})], lambda x: x.at_no) AS picked FROM (
   SELECT t.document_id, t.n, t.section_id, w.taken, w.included, CASE WHEN len(list_filter(d.r, lambda x: x.top = t.sort_order)) > 0 THEN list_filter(d.r, lambda x: x.top = t.sort_order) ELSE list_filter(d.r, lambda x: x.page BETWEEN t.page AND t.end_page AND NOT list_contains(w.taken, x.at_no)) END AS from_rows
   FROM walk w JOIN tops t ON t.document_id = w.document_id AND t.n = w.n + 1 JOIN docs d ON d.document_id = w.document_id))),
 last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1),
 filled AS (SELECT document_id, -1 AS at_no, {BUDGET} - coalesce(list_sum(list_transform(list_filter(r, lambda x: list_contains(taken, x.at_no)), lambda x: x.cost)), 0)::BIGINT AS room, taken AS kept FROM last JOIN docs USING (document_id)
   UNION ALL SELECT f.document_id, c.chunk_index, CASE WHEN NOT list_contains(l.taken, c.chunk_index) AND room > 0 AND c.cost <= room THEN room - c.cost ELSE room END, CASE WHEN NOT list_contains(l.taken, c.chunk_index) AND room > 0 AND c.cost <= room THEN list_append(kept, c.chunk_index) ELSE kept END
   FROM filled f JOIN chunks c ON c.document_id = f.document_id AND c.chunk_index = f.at_no + 1 JOIN last l ON l.document_id = f.document_id),
 full_ AS (SELECT document_id, kept FROM filled QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY at_no DESC) = 1),
 even AS (SELECT document_id, 0 AS i, 0::BIGINT AS used, []::INT[] AS kept, greatest(1, floor(len(r) * ({BUDGET}::DOUBLE / total)))::INT AS target FROM docs WHERE total > {BUDGET} AND document_id % 7 = 3
   UNION ALL SELECT document_id, i + 1, CASE WHEN used + x.cost <= {BUDGET} THEN used + x.cost ELSE used END, CASE WHEN used + x.cost <= {BUDGET} THEN list_append(kept, x.at_no) ELSE kept END, target
   FROM (SELECT e.*, d.r[1 + least(floor(i * (len(d.r) / target::DOUBLE))::INT, len(d.r) - 1)] AS x FROM even e JOIN docs d USING (document_id) WHERE i < target)),
 spaced AS (SELECT document_id, CASE WHEN len(kept) = 0 THEN [0] ELSE kept END AS kept FROM even QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1)
 SELECT document_id, list_transform(list_filter(r, lambda x: total <= {BUDGET} OR list_contains(coalesce(s.kept, f.kept), x.at_no)), lambda x: x.id) AS chosen, total > {BUDGET} AS sampled, CASE WHEN total <= {BUDGET} THEN 'full' ELSE 'section_diverse' END AS strategy,
  CASE WHEN total > {BUDGET} AND document_id % 7 <> 3 THEN included ELSE [] END AS included, CAST(CASE WHEN total > {BUDGET} AND document_id % 7 <> 3 THEN (SELECT count(*) FROM tops t WHERE t.document_id = docs.document_id) - len(included) ELSE 0 END AS INT) AS excluded
 FROM docs JOIN last USING (document_id) JOIN full_ f USING (document_id) LEFT JOIN spaced s USING (document_id)""")
def representative_chunks(spark, sf_dir):
    return S.represented(*parts(spark, sf_dir), budget=BUDGET, per_section=TAKE)
