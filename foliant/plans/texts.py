"""Queries over document texts: lines, tokens, structure, comparison, answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.operators import answers, compare, structure
from foliant.plans.registry import query, table

_LINES = "lines AS (SELECT doc_id, source, CAST(n AS INT) AS line_no, trim(line, ' ') AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE trim(line, ' ') <> '')"


@query(f"WITH {_LINES} SELECT doc_id, line_no, len(line) AS chars, len(string_split(line, ' | ')) >= 3 AS tabular FROM lines")
def page_lines(spark, sf_dir):
    rows = structure.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", F.length("line").cast("long").alias("chars"), structure.is_table(F.col("line")).alias("tabular"))


@query(f"WITH {_LINES} SELECT source, line, count(DISTINCT doc_id) AS pages FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id) AS a, max(line_no) OVER (PARTITION BY doc_id) AS b FROM lines) WHERE line_no IN (a, b) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def furniture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = structure.lines(docs).join(docs.select("doc_id", "source"), "doc_id")
    return structure.furniture(rows, "source", "doc_id")


def _first_words(n: int) -> str:
    return f"array_to_string(regexp_split_to_array(line, '\\s+')[1:{n}], ' ')"


#: Lines of documents on pages of five, some of them made headings of every kind, in capitals, or a running head.
_POLICY = f"""{_LINES}, kinds AS (SELECT *, (doc_id + line_no) % 13 AS kind, doc_id % 4 <> 0 AS numbered FROM lines),
 policy AS (SELECT doc_id, CAST((line_no - 1) // 5 + 1 AS INT) AS page, line_no, CASE WHEN numbered AND kind = 0 THEN line_no || '.' || (line_no % 3 + 1) || ' ' || {_first_words(5)} WHEN numbered AND kind = 3 THEN 'Section ' || line_no || ': ' || {_first_words(3)}
   WHEN numbered AND kind = 5 THEN 'Appendix ' || chr(CAST(65 + line_no % 26 AS INT)) || '.' || line_no % 4 || ' ' || {_first_words(3)} WHEN numbered AND kind = 7 THEN 'IV. ' || {_first_words(3)} WHEN numbered AND kind = 9 THEN line_no || ') ' || {_first_words(4)}
   WHEN kind = 11 THEN regexp_replace(upper(replace({_first_words(4)}, 'ß', 'ss')), '[.!?,;:]', '', 'g') WHEN line_no % 5 = 1 AND doc_id % 3 = 0 THEN '7. Running head' ELSE line END AS line FROM kinds)"""
_CAPS = "len(regexp_split_to_array(line, '\\s+')) BETWEEN 2 AND 8 AND len(line) <= 60 AND line = upper(line) AND regexp_matches(line, '\\pL') AND NOT regexp_matches(line, '[.!?,;:]$')"


def policy_lines(spark, sf_dir):
    """doc_id, page, line_no and line of documents, with planted headings (see _POLICY)."""
    rows = structure.lines(table(spark, sf_dir, "documents"))
    kind, numbered, n = (F.col("doc_id") + F.col("line_no")) % 13, F.col("doc_id") % 4 != 0, F.col("line_no")

    def first_words(many):
        return F.array_join(F.slice(F.split("line", r"\s+"), 1, many), " ")

    line = (
        F.when(numbered & (kind == 0), F.concat(n, F.lit("."), n % 3 + 1, F.lit(" "), first_words(5))).when(numbered & (kind == 3), F.concat(F.lit("Section "), n, F.lit(": "), first_words(3)))
        .when(numbered & (kind == 5), F.concat(F.lit("Appendix "), F.char(65 + n % 26), F.lit("."), n % 4, F.lit(" "), first_words(3))).when(numbered & (kind == 7), F.concat(F.lit("IV. "), first_words(3)))
        .when(numbered & (kind == 9), F.concat(n, F.lit(") "), first_words(4))).when(kind == 11, F.regexp_replace(F.upper(F.replace(first_words(4), F.lit("ß"), F.lit("ss"))), "[.!?,;:]", ""))
        .when((n % 5 == 1) & (F.col("doc_id") % 3 == 0), "7. Running head").otherwise(F.col("line"))
    )
    return rows.select("doc_id", (F.floor((n - 1) / 5) + 1).cast("int").alias("page"), "line_no", line.alias("line"))


@query(f"WITH {_POLICY} SELECT doc_id, line_no, line FROM policy WHERE {_CAPS}")
def caps_headings(spark, sf_dir):
    return policy_lines(spark, sf_dir).filter(structure.is_caps_heading(F.col("line"))).select("doc_id", "line_no", "line")


def _numbered_case(column: str) -> str:
    """SQL of the number, title or level of a numbered heading, or null; the kinds in their order."""
    words = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))"
    out = []
    for kind, pattern, depth in structure.NUMBERING:
        pattern = pattern.replace("'", "''")
        number, rest = f"regexp_extract(line, '{pattern}', 1)", f"trim(regexp_extract(line, '{pattern}', 2), ' ')"
        value = {"number": ("'Appendix ' || " if kind == "appendix" else "") + number, "title": rest, "level": f"CAST(len(string_split({number}, '.')) AS INT)" if depth == 0 else f"CAST({depth} AS INT)"}[column]
        out.append(f"WHEN regexp_matches(line, '{pattern}') THEN CASE WHEN {rest} <> '' AND {words} <= {8 if kind == 'single' else 24} THEN {value} END")
    return "CASE " + " ".join(out) + " END"


_TEXT_HEADS = f"""{_POLICY}, norms AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') AS norm, min(line_no) OVER p AS a, max(line_no) OVER p AS b, count(*) OVER p AS n FROM policy WINDOW p AS (PARTITION BY doc_id, page)),
 running AS (SELECT doc_id, norm FROM norms WHERE line_no IN (a, b) GROUP BY ALL HAVING count(DISTINCT page) >= 2), solo AS (SELECT DISTINCT doc_id, norm FROM norms WHERE n = 1),
 numbers AS (SELECT doc_id, page, line_no, line, norm, {_numbered_case("number")} AS number, {_numbered_case("title")} AS title, {_numbered_case("level")} AS level FROM norms ANTI JOIN running USING (doc_id, norm)),
 latched AS (SELECT *, coalesce(max(number IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen, (doc_id, norm) IN (SELECT (doc_id, norm) FROM solo) AS alone FROM numbers),
 shaped AS (SELECT *, number IS NULL AND NOT seen AND NOT alone AND {_CAPS} AS caps FROM latched),
 found AS (SELECT doc_id, page, line_no, number, coalesce(title, line) AS title, coalesce(level, 2) AS level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS INT) AS sort_order FROM shaped WHERE number IS NOT NULL OR caps),
 ends AS (SELECT doc_id, max(page) AS last_page FROM policy GROUP BY 1),
 tree AS (SELECT f.*, (SELECT max(o.sort_order) FROM found o WHERE o.doc_id = f.doc_id AND o.sort_order < f.sort_order AND o.level < f.level) AS parent_order,
   coalesce((SELECT arg_min(o.page, o.sort_order) FROM found o WHERE o.doc_id = f.doc_id AND o.sort_order > f.sort_order AND o.level <= f.level), last_page) AS end_page FROM found f JOIN ends USING (doc_id))"""


def text_sections_of(spark, sf_dir):
    """The lines of planted documents and the tree of their headings."""
    rows = structure.marked_lines(policy_lines(spark, sf_dir))
    tree = structure.section_tree(structure.headings(rows), rows.groupBy("doc_id").agg(F.max("page").alias("last_page")), chains=True)
    return rows, tree


@query(f"WITH {_TEXT_HEADS} SELECT doc_id, page, line_no, number, title, level FROM found")
def text_headings(spark, sf_dir):
    return structure.headings(structure.marked_lines(policy_lines(spark, sf_dir))).select("doc_id", "page", "line_no", "number", "title", "level")


@query(f"""WITH RECURSIVE {_TEXT_HEADS}, chain AS (SELECT doc_id, sort_order, parent_order AS up, [title] AS path FROM tree UNION ALL SELECT c.doc_id, c.sort_order, t.parent_order, list_prepend(t.title, c.path) FROM chain c JOIN tree t ON t.doc_id = c.doc_id AND t.sort_order = c.up)
 SELECT doc_id, sort_order, t.parent_order, t.end_page, path FROM chain JOIN tree t USING (doc_id, sort_order) WHERE up IS NULL""")
def text_sections(spark, sf_dir):
    _, tree = text_sections_of(spark, sf_dir)
    return tree.select("doc_id", "sort_order", "parent_order", "end_page", structure.titles(F.col("chain")).alias("path"))


@query("SELECT doc_id, len(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) < 25 AS needs_ocr, sha256(text) AS digest, CASE WHEN len(text) = 0 THEN 0 ELSE CAST(greatest(1, ceil(greatest(len(list_filter(regexp_split_to_array(text, '[\\s\\x{00a0}\\x{0085}\\x{2000}-\\x{200a}]+'), lambda w: w <> '')) / 0.75::DOUBLE, len(text) / 4.0::DOUBLE))) AS BIGINT) END AS tokens FROM documents")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.needs_ocr(t).alias("needs_ocr"), F.sha2(t, 256).alias("digest"), X.token_estimate(t).alias("tokens"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')) AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat, CASE WHEN len(line) > 60 THEN rtrim(substr(line, 1, 59)) || '…' ELSE line END AS title FROM (SELECT *, trim(string_split(ltrim(text, ' '), chr(10))[1], ' ') AS line FROM documents)")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse(F.col("text")).alias("flat"), X.first_line_title(F.col("text")).alias("title"))


_MARKED = "SELECT doc_id AS message_id, regexp_replace(text, '\\. ', ' [' || CAST(doc_id % 12 AS VARCHAR) || ']. ', 'g') AS text FROM documents"


def marked(spark, sf_dir):
    """Answers with markers, made from documents."""
    mark = F.concat(F.lit(" ["), (F.col("doc_id") % 12).cast("string"), F.lit("]. "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.replace(F.col("text"), F.lit(". "), mark).alias("text"))


@query(f"WITH m AS ({_MARKED}), c AS (SELECT message_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\[(?:SOURCE\\s*)?(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INT)))) AS citation_index FROM m) SELECT message_id, citation_index, CAST(0 AS INT) AS place, l_orderkey AS source_id FROM c JOIN lineitem ON l_linenumber = citation_index AND l_orderkey % 1000 = message_id")
def citation_resolution(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("message_id"), F.col("l_linenumber").cast("int").alias("citation_index"), F.col("l_orderkey").alias("source_id"))
    return answers.resolve_citations(marked(spark, sf_dir), sources)


@query("""WITH RECURSIVE r AS (SELECT doc_id // 20 AS q, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS n, doc_id, n_chars AS cost FROM documents),
 p AS (SELECT q, n, CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 6000 THEN [doc_id] ELSE [] END AS chosen FROM r WHERE n = 1
 UNION ALL SELECT r.q, r.n, CASE WHEN used + cost <= 6000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 6000 THEN list_append(chosen, doc_id) ELSE chosen END FROM p JOIN r ON r.q = p.q AND r.n = p.n + 1)
 SELECT q, used, chosen FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC) AS last FROM p) WHERE last = 1""")
def context_pack(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("q"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("source_id"), F.col("n_chars").alias("cost"))
    return answers.pack_budget(sources, "q", 6000)


@query("""WITH RECURSIVE r AS (SELECT doc_id // 20 AS q, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY n_chars DESC, doc_id) AS n, doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS t FROM documents),
 p AS (SELECT q, n, CASE WHEN t = '' THEN [] ELSE [doc_id] END AS kept, CASE WHEN t = '' THEN [] ELSE [t] END AS texts FROM r WHERE n = 1
 UNION ALL SELECT q, n, CASE WHEN twin THEN kept ELSE list_append(kept, doc_id) END, CASE WHEN twin THEN texts ELSE list_append(texts, t) END FROM
 (SELECT r.q, r.n, r.doc_id, r.t, kept, texts, r.t = '' OR len(list_filter(texts, lambda x: contains(x, r.t) OR contains(r.t, x))) > 0 AS twin FROM p JOIN r ON r.q = p.q AND r.n = p.n + 1))
 SELECT q, kept FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC) AS last FROM p) WHERE last = 1""")
def dedup_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("q"), F.col("doc_id").alias("source_id"), F.col("n_chars").alias("score"), "text")
    return answers.drop_contained(sources, "q")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE pos >= (n - least(n, 3)) // 2 AND pos < (n - least(n, 3)) // 2 + 3")
def median_sample(spark, sf_dir):
    return answers.median_pick(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


def segment_rows(spark, sf_dir):
    """Segments of planted documents, each with its section, and the tree of the sections. The lines and what they are heads of are stored once."""
    rows = structure.headings(structure.marked_lines(policy_lines(spark, sf_dir)), every=True)
    rows = compare.stored(rows.select("doc_id", "page", "line_no", "line", "number", "title", "level"))
    tree = structure.section_tree(rows.filter("title IS NOT NULL"), rows.groupBy("doc_id").agg(F.max("page").alias("last_page")), chains=True)
    return structure.segments(structure.in_sections(rows).select("doc_id", "page", "line_no", "line", "heading", "section")), tree


@query(f"""WITH {_TEXT_HEADS}, placed AS (SELECT p.doc_id, p.page, p.line_no, p.line, f.sort_order IS NOT NULL AS head, last_value(f.sort_order IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.line_no) AS section FROM policy p LEFT JOIN found f USING (doc_id, line_no)),
 kinded AS (SELECT *, CASE WHEN head THEN 'heading' WHEN len(string_split(line, ' | ')) >= 3 THEN 'table' WHEN regexp_matches(line, '^(?:[-•*‣◦▪]|\\(?\\d{{1,2}}[.)]|\\(?[a-z][.)])\\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM placed),
 cut AS (SELECT *, CASE WHEN head OR kind IS DISTINCT FROM lag(kind) OVER w OR section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS new FROM kinded WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM cut)
 SELECT doc_id, segment::BIGINT AS segment, any_value(kind) AS kind, any_value(section)::BIGINT AS section, min(page) AS page, max(page) AS end_page, sha256(CASE WHEN kind = 'table' THEN array_to_string(list(line ORDER BY line_no), chr(10)) ELSE array_to_string(list(line ORDER BY line_no), ' ') END) AS digest FROM runs GROUP BY doc_id, segment, kind""")
def text_segments(spark, sf_dir):
    rows, _ = segment_rows(spark, sf_dir)
    return rows.select("doc_id", "segment", "kind", "section", "page", "end_page", F.sha2("text", 256).alias("digest"))


@query(None)
def chunk_documents(spark, sf_dir):
    rows, tree = segment_rows(spark, sf_dir)
    named = tree.select("doc_id", F.col("sort_order").cast("long").alias("section"), "number", structure.titles(F.col("chain")).alias("path"))
    chunks = structure.chunk(rows).join(named, ["doc_id", "section"], "left")
    flags = ["contains_table", "contains_list", "forced_split"]
    return chunks.select("doc_id", "chunk_index", "section", "number", "path", "page", "end_page", "token_count", F.sha2("content", 256).alias("content_hash"), *flags)


_OUTLINE = """heads AS (SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS line_no, CAST((l_linenumber + 1) // 2 AS INT) AS page, 1 + l_suppkey % 4 AS level, 'Part ' || l_partkey AS title,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS sort_order FROM lineitem),
 tree AS (SELECT *, (SELECT max(o.sort_order) FROM heads o WHERE o.doc_id = h.doc_id AND o.sort_order < h.sort_order AND o.level < h.level) AS parent_order FROM heads h)"""
_CHAINS = f"""WITH RECURSIVE {_OUTLINE}, chain AS (SELECT doc_id, sort_order, sort_order AS top, parent_order AS up, [title] AS path FROM tree
 UNION ALL SELECT c.doc_id, c.sort_order, t.sort_order, t.parent_order, list_prepend(t.title, c.path) FROM chain c JOIN tree t ON t.doc_id = c.doc_id AND t.sort_order = c.up)"""


def outline(spark, sf_dir):
    """Heading lines (doc_id, page, line_no, line) made of line items: an order is a document, an item a numbered heading of one to four parts."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    number = F.array_join(F.array_repeat(F.lit("1"), (F.col("l_suppkey") % 4 + 1).cast("int")), ".")
    line = F.concat(number, F.when(F.col("l_suppkey") % 4 == 0, ". ").otherwise(" "), F.lit("Part "), F.col("l_partkey").cast("string"))
    page = F.floor((F.col("l_linenumber") + 1) / 2).cast("int")
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id").select("doc_id", page.alias("page"), F.row_number().over(order).alias("line_no"), line.alias("line"))


def outline_tree(spark, sf_dir, chains=False):
    heads = structure.headings(outline(spark, sf_dir)).select("doc_id", "page", "line_no", "level", *["title"] * chains)
    return structure.section_tree(heads, None, chains=chains)


@query(f"""WITH {_OUTLINE} SELECT doc_id, sort_order, parent_order, CAST(coalesce((SELECT arg_min(o.page, o.sort_order) FROM heads o WHERE o.doc_id = t.doc_id AND o.sort_order > t.sort_order AND o.level <= t.level),
 (SELECT max(o.page) FROM heads o WHERE o.doc_id = t.doc_id)) AS INT) AS end_page FROM tree t""")
def section_tree(spark, sf_dir):
    return outline_tree(spark, sf_dir).select("doc_id", "sort_order", "parent_order", "end_page")


@query(f"{_CHAINS} SELECT doc_id, sort_order, path FROM chain WHERE up IS NULL")
def heading_paths(spark, sf_dir):
    return structure.heading_paths(outline_tree(spark, sf_dir, chains=True))


@query(f"{_CHAINS} SELECT doc_id, top, sort_order AS member FROM chain")
def section_closure(spark, sf_dir):
    return structure.descendants(outline_tree(spark, sf_dir, chains=True))


@query(f"{_CHAINS} SELECT doc_id, sort_order, CAST(len(path) AS INT) AS level, path[-1] AS title FROM chain WHERE up IS NULL")
def contents_table(spark, sf_dir):
    return structure.heading_paths(outline_tree(spark, sf_dir, chains=True)).select("doc_id", "sort_order", F.size("path").alias("level"), F.element_at("path", -1).alias("title"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 30 * 1.4::DOUBLE THEN 1 WHEN l_quantity >= 30 * 1.2::DOUBLE THEN 2 WHEN l_returnflag = 'R' AND l_quantity >= 30 * 1.15::DOUBLE THEN 3 END AS level FROM lineitem""")
def font_headings(spark, sf_dir):
    line = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    level = structure.font_heading(line, F.col("l_quantity").cast("double"), F.lit(30.0), F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))


@query(f"WITH {_LINES} SELECT doc_id, min(line) AS line FROM lines GROUP BY 1 HAVING count(*) = 1")
def solo_lines(spark, sf_dir):
    return structure.solo_lines(structure.lines(table(spark, sf_dir, "documents")), "doc_id")


_VERSIONS = """rows AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS sort_order FROM lineitem),
 a AS (SELECT l_orderkey AS pair, sort_order, CASE WHEN l_quantity >= 20 THEN CAST(l_suppkey AS VARCHAR) END AS number, 'Part ' || l_partkey % 20 AS title FROM rows WHERE l_returnflag <> 'A'),
 b AS (SELECT l_orderkey AS pair, sort_order, CASE WHEN l_quantity < 40 THEN CAST(l_suppkey AS VARCHAR) END AS number, 'PART-' || l_partkey % 20 AS title FROM rows WHERE l_returnflag <> 'R')"""


def versions(spark, sf_dir):
    """Sections (pair, sort_order, number, title, text) of an old and a new version, made of the line items of each order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("sort_order", F.row_number().over(order))

    def side(kept, numbered, prefix):
        number = F.when(numbered, F.col("l_suppkey").cast("string"))
        text = F.concat_ws(" ", F.lit(prefix), F.col("l_partkey").cast("string"), "l_linestatus", F.col("l_linenumber").cast("string"))
        return rows.filter(kept).select(F.col("l_orderkey").alias("pair"), "sort_order", number.alias("number"), F.concat(F.lit(prefix), (F.col("l_partkey") % 20).cast("string")).alias("title"), text.alias("text"))

    return side("l_returnflag <> 'A'", F.col("l_quantity") >= 20, "Part "), side("l_returnflag <> 'R'", F.col("l_quantity") < 40, "PART-")


_ALIGNED = f"""{_VERSIONS}, n AS (SELECT pair, a_order, b_order, 'number' AS method FROM (SELECT pair, number, min(sort_order) AS a_order FROM a WHERE number IS NOT NULL GROUP BY ALL) JOIN (SELECT pair, number, min(sort_order) AS b_order FROM b WHERE number IS NOT NULL GROUP BY ALL) USING (pair, number)),
 a2 AS (SELECT pair, sort_order, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS bare FROM a ANTI JOIN n ON a.pair = n.pair AND sort_order = a_order), b2 AS (SELECT pair, sort_order, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS bare FROM b ANTI JOIN n ON b.pair = n.pair AND sort_order = b_order),
 t AS (SELECT pair, a_order, b_order, 'title' AS method FROM (SELECT pair, bare, min(sort_order) AS a_order FROM a2 GROUP BY ALL) JOIN (SELECT pair, bare, min(sort_order) AS b_order FROM b2 GROUP BY ALL) USING (pair, bare)),
 every AS (FROM n UNION ALL FROM t UNION ALL SELECT a2.pair, sort_order, NULL, 'removed' FROM a2 ANTI JOIN t ON a2.pair = t.pair AND sort_order = a_order UNION ALL SELECT b2.pair, NULL, sort_order, 'added' FROM b2 ANTI JOIN t ON b2.pair = t.pair AND sort_order = b_order),
 lost AS (SELECT pair FROM every GROUP BY 1 HAVING count(a_order) > 0 AND count(b_order) >= 3 AND count(*) FILTER (a_order IS NOT NULL AND b_order IS NOT NULL) / count(b_order)::DOUBLE < 0.3)
"""


@query(f"""WITH {_ALIGNED} SELECT every.* FROM every ANTI JOIN lost USING (pair) UNION ALL SELECT pair, NULL, NULL, 'whole_document' FROM lost""")
def section_alignment(spark, sf_dir):
    return compare.align(*versions(spark, sf_dir))


@query(None)
def version_comparison(spark, sf_dir):
    a, b = map(compare.stored, versions(spark, sf_dir))  # read by every step below
    near = a.select("pair", F.col("sort_order").alias("a_order"), "title").join(b.select("pair", F.col("sort_order").alias("b_order"), F.replace("title", F.lit("PART-"), F.lit("Part ")).alias("other")), "pair")
    scores = near.select("pair", "a_order", "b_order", F.round(1 - F.levenshtein("title", "other") / F.greatest(F.length("title"), F.length("other")), 6).alias("score"))
    return compare.section_changes(compare.stored(compare.align(a, b, scores)), a, b, ["part 7"]).drop("old_text", "new_text")


def text_pairs(spark, sf_dir):
    """Each text as the old version of the one numbered 5 higher; the last ones have none."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("text").alias("old_text")).join(docs.select((F.col("doc_id") - 5).alias("doc_id"), F.col("text").alias("new_text")), "doc_id", "left")


@query(None)
def text_difference(spark, sf_dir):
    return compare.text_changes(text_pairs(spark, sf_dir)).select("doc_id", "unchanged", "changed_words", "proportion")


@query(None)
def text_spans(spark, sf_dir):
    """The sentences each text shares with, loses to and gains from its next version, in order."""
    rows = compare.text_changes(text_pairs(spark, sf_dir)).select("doc_id", F.posexplode("spans").alias("place", "span"))
    return rows.select("doc_id", "place", "span.tag", "span.old", "span.new")


@query(f"WITH {_ALIGNED} SELECT DISTINCT pair, pair IN (SELECT pair FROM lost) AS degraded FROM every")
def alignment_degraded(spark, sf_dir):
    """Whether the two versions of an order are so unlike that they are compared whole."""
    return compare.align(*versions(spark, sf_dir)).groupBy("pair").agg(F.bool_or(F.col("method") == "whole_document").alias("degraded"))


@query(None)
def comparison_summaries(spark, sf_dir):
    a, b = map(compare.stored, versions(spark, sf_dir))  # read by every step below, as is the alignment
    aligned = compare.stored(compare.align(a, b))
    return compare.comparison_summary(aligned, compare.section_changes(aligned, a, b, ["part 7"]))


@query(None)
def greedy_alignment(spark, sf_dir):
    """Line items of an order stand for the sections of its two versions; likeness is that of their quantities."""
    sized = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), "l_linenumber", "l_quantity")
    a, b = (sized.filter(sized.l_linenumber % 2 == n).groupBy("pair", F.col("l_linenumber").alias(o)).agg(F.max("l_quantity").alias(q)) for n, o, q in ((1, "a_order", "x"), (0, "b_order", "y")))
    scores = a.join(b, "pair").select("pair", "a_order", "b_order", F.round(1 - F.abs(F.col("x") - F.col("y")) / 50, 6).alias("score"))
    return compare.greedy_match(scores)


@query("SELECT conv_id, turn, turn > 0 AND (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 12 OR regexp_matches(lower(text), '\\b(it|this|that|those|these|they|them|above|previous)\\b')) AS rewrite FROM conversations WHERE role = 'user'")
def rewrite_trigger(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.wants_rewrite(F.col("text"), F.col("turn")).alias("rewrite"))
