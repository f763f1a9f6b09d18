"""Lines, headings, section trees and chunks of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from foliant.functions.packing import Limits, pack_section, token_estimate
from foliant.operators.compare import cut

#: Numbering kinds in the order they are tried, with the heading level they give (0: the number of parts).
NUMBERING = [
    ("decimal", r"^(\d+(?:\.\d+)+)[.)]?\s+(\S.*)$", 0),
    ("section", r"(?i)^section\s+(\d+)\s*[:.–—-]?\s*(.*)$", 1),
    ("appendix", r"(?i)^appendix\s+([A-Z](?:\.\d+)*)\s*[:.–—-]?\s*(.*)$", 0),
    ("roman", r"^([IVXLCDM]{1,7})[.)]\s+(\S.*)$", 1),
    ("single", r"^(\d+)[.)]\s+(\S.*)$", 1),
]


#: Most words of a heading, and of one with a single number, which may be a list item.
MOST_WORDS, MOST_SINGLE_WORDS = 24, 8


def lines(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 1 among all lines of the page) and the trimmed line; blank lines are left out."""
    out = pages.select(key, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    return out.select(key, (F.col("line_no") + 1).alias("line_no"), F.trim("line").alias("line")).filter("line <> ''")


def is_table(line):
    return F.size(F.split(line, r" \| ")) >= 3


def is_list(line):
    return line.rlike(r"^(?:[-•*‣◦▪]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+")


def is_caps_heading(line):
    """2 to 8 words, at most 60 characters, upper case with a letter, no sentence end or comma."""
    words = F.size(F.split(line, r"\s+"))
    return words.between(2, 8) & (F.length(line) <= 60) & (line == F.upper(line)) & line.rlike(r"\p{L}") & ~line.rlike(r"[.!?,;:]$")


def furniture(page_lines: DataFrame, group: str, page: str) -> DataFrame:
    """group and line of first and last lines that stand on at least two pages of the group."""
    w = Window.partitionBy(page)
    edge = (F.col("line_no") == F.min("line_no").over(w)) | (F.col("line_no") == F.max("line_no").over(w))
    edges = page_lines.withColumn("_edge", edge).filter("_edge")
    return edges.groupBy(group, "line").agg(F.count_distinct(page).alias("pages")).filter("pages >= 2")


def marked_lines(page_lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds running (equal to a first or last line of two or more pages of the document) and solo (equal to a line that is all a page holds).

    page_lines: key, page, line_no, line. Lines are compared with runs of white space as one space. One shuffle by key.
    """
    on_page, alike = Window.partitionBy(key, "page"), Window.partitionBy(key, "_norm")
    norm = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    rows = page_lines.withColumn("_norm", norm).repartition(key)
    rows = rows.withColumns({"_first": F.min("line_no").over(on_page), "_last": F.max("line_no").over(on_page), "_n": F.count("*").over(on_page)})
    edge = F.when((F.col("line_no") == F.col("_first")) | (F.col("line_no") == F.col("_last")), F.col("page"))
    rows = rows.withColumns({"running": F.coalesce(F.min(edge).over(alike) < F.max(edge).over(alike), F.lit(False)), "solo": F.max(F.col("_n") == 1).over(alike)})
    return rows.drop("_norm", "_first", "_last", "_n")


def headings(rows: DataFrame, key: str = "doc_id", *, every: bool = False) -> DataFrame:
    """Adds number, title and level to heading lines (key, page, line_no, line); other lines go, or with every stay without them.

    Numbered lines are headings if short enough, or whatever their length if in bold. Until the first numbered one of the document, lines set larger than the body text
    are headings, and where there are no fonts, capitals, of level 2. Optional columns: size, body and bold of the line's font (null: none at hand);
    running, whose lines are no headings; solo, whose capitals are none (see marked_lines).
    """
    have = {c: F.col(c) if c in rows.columns else F.lit(None).cast(kind) for c, kind in (("size", "double"), ("body", "double"), ("bold", "boolean"), ("running", "boolean"), ("solo", "boolean"))}
    bold, running, solo = (F.coalesce(have[c], F.lit(False)) for c in ("bold", "running", "solo"))
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    tried = F.lit(None)
    for n, (_, pattern, _) in reversed(list(enumerate(NUMBERING))):
        tried = F.when(F.col("line").rlike(pattern), n).otherwise(tried)
    found = rest = fits = depths = F.lit(None)
    for n, (kind, pattern, depth) in enumerate(NUMBERING):
        own = F.col("_kind") == n
        short = words <= (MOST_SINGLE_WORDS if kind == "single" else MOST_WORDS)
        found = F.when(own, F.regexp_extract("line", pattern, 1)).otherwise(found)
        rest = F.when(own, F.trim(F.regexp_extract("line", pattern, 2))).otherwise(rest)
        fits = F.when(own, short | bold if kind in ("decimal", "single") else short).otherwise(fits)
        depths = F.when(own, F.size(F.split("_found", r"\.")) if depth == 0 else F.lit(depth)).otherwise(depths)
    appendix = F.col("_kind") == [kind for kind, _, _ in NUMBERING].index("appendix")
    rows = (rows if every else rows.filter(~running)).withColumn("_kind", tried).withColumns({"_found": found, "_rest": rest, "_fits": fits})
    taken = (F.col("_rest") != "") & F.col("_fits") & ~running
    number = F.when(taken, F.when(appendix, F.concat(F.lit("Appendix "), F.col("_found"))).otherwise(F.col("_found")))
    title, level = F.when(taken, F.col("_rest")), F.when(taken, depths)
    out = rows.withColumns({"number": number, "title": title, "level": level.cast("int")}).drop("_kind", "_found", "_rest", "_fits")
    before = Window.partitionBy(key).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    fresh = ~F.coalesce(F.max(F.col("number").isNotNull()).over(before), F.lit(False))
    shape = F.when(have["size"].isNotNull() & have["body"].isNotNull(), font_heading(F.col("line"), have["size"], have["body"], bold))
    shape = F.coalesce(shape, F.when(have["size"].isNull() & ~solo & is_caps_heading(F.col("line")), 2))
    out = out.withColumn("_shape", F.when(F.col("number").isNull() & fresh & ~running, shape))
    out = out.withColumns({"title": F.coalesce("title", F.when(F.col("_shape").isNotNull(), F.col("line"))), "level": F.coalesce("level", "_shape")})
    return (out if every else out.filter("title IS NOT NULL")).drop("_shape")


def in_sections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds heading and section (the sort_order of the last heading at or before the line, null before the first; see section_tree) to every line with what headings tells of it."""
    heading = F.col("title").isNotNull()
    before = Window.partitionBy(key).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"heading": heading, "section": F.nullif(F.count_if(heading).over(before), F.lit(0))})


def font_heading(line, size, body, bold):
    """Level 1, 2 or 3 of a line set larger than the body text (3 only if bold), else null; long lines and whole sentences are none."""
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    level = F.when(size >= body * 1.4, 1).when(size >= body * 1.2, 2).when(bold & (size >= body * 1.15), 3)
    return F.when((F.length(line) <= 100) & (words <= 14) & ~line.rlike(r"[.!?:;]\s*$"), level)


def solo_lines(page_lines: DataFrame, page: str) -> DataFrame:
    """Lines that are all a page holds (stamps); capitals there are no headings."""
    return page_lines.groupBy(page).agg(F.count("*").alias("n"), F.first("line").alias("line")).filter("n = 1").select(page, "line")


class _Tree:
    """The sections of sorted headings that come in batches; what is open goes on to the next batch, one section of a level at most."""

    def __init__(self, last: bool, chains: bool):
        self.last, self.chains = last, chains
        self.key, self.count, self.page = None, 0, None
        self.open: list[tuple] = []  # level, sort_order, title, row
        self.held: pa.Table | None = None  # rows of open sections
        self.known: list[list] = [[], [], []]  # of these rows parent_order, end_page and chain

    def run(self, batch: pa.Table, keys: list, levels: list, pages: list, titles: list) -> pa.Table:
        """The rows that are closed with parent_order, _end and chain."""
        rows = batch if self.held is None else pa.concat_tables([self.held, batch])
        at = rows.num_rows - len(keys)
        parents, ends, chains = (list(x) + [None] * len(keys) for x in self.known)
        stack, key, count, page = self.open, self.key, self.count, self.page
        for k, level, its_page, title in zip(keys, levels, pages, titles):
            if k != key:
                if self.last:
                    for s in stack:
                        ends[s[3]] = page
                stack, key, count = [], k, 0
            count += 1
            page = its_page
            if level is not None:
                while stack and stack[-1][0] >= level:
                    ends[stack.pop()[3]] = page
                if stack:
                    parents[at] = stack[-1][1]
                stack.append((level, count, title, at))
                if self.chains:
                    chains[at] = [(s[1], s[2]) for s in stack]
            elif self.chains:
                chains[at] = [(count, title)]
            at += 1
        self.key, self.count, self.page = key, count, page
        still = [s[3] for s in stack]
        self.open = [(*s[:3], n) for n, s in enumerate(stack)]
        self.held = rows.take(pa.array(still, pa.int64())).combine_chunks()
        self.known = [[x[n] for n in still] for x in (parents, ends, chains)]
        kept = np.ones(rows.num_rows, bool)
        kept[still] = False
        return self.told(rows, parents, ends, chains).filter(pa.array(kept))

    def rest(self) -> pa.Table | None:
        if self.held is None:
            return None
        parents, ends, chains = self.known
        return self.told(self.held, parents, [self.page] * len(ends) if self.last else ends, chains)

    def told(self, rows: pa.Table, parents: list, ends: list, chains: list) -> pa.Table:
        for name, values in (("parent_order", parents), ("_end", ends)):
            rows = rows.append_column(name, pa.array(values, pa.int32()))
        if self.chains:
            flat = [x for c in chains for x in c]
            pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string())], names=["sort_order", "title"])
            rows = rows.append_column("chain", pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, chains)]), pa.int32()), pairs))
        return rows


def section_tree(heads: DataFrame, last_page: DataFrame | None, key: str = "doc_id", *, chains: bool = False) -> DataFrame:
    """sort_order, parent_order and end_page of headings (key, page, line_no, level, ...), and with chains chain: (sort_order, title) from the root down to the section.

    The parent is the last earlier section of smaller level; a section ends on the page where the next of the same or a smaller level begins.
    last_page: key and the number of the document's last page; None: the page of its last heading, and headings without a level have no end. One pass over the sorted headings, which holds the open sections
    alone (one of a level at most), so a document takes time linear in its headings and no more memory than its levels.
    """
    # the window deals the headings by document, if they do not lie so already; the sort after it is none where they are sorted
    order = F.row_number().over(Window.partitionBy(key).orderBy("page", "line_no"))
    rows = heads.filter(F.col(key).isNotNull()).withColumn("sort_order", order).sortWithinPartitions(key, "page", "line_no")
    last = last_page is None
    schema = StructType([*rows.schema.fields, *(StructField(n, IntegerType()) for n in ("parent_order", "_end"))])
    if chains:
        schema = schema.add("chain", ArrayType(StructType([StructField("sort_order", IntegerType()), StructField("title", StringType())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Tree(last, chains)
        for batch in batches:
            keys, levels, pages = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "level", "page"))
            titles = batch.column(batch.schema.get_field_index("title")).to_pylist() if chains else keys
            yield from tree.run(pa.Table.from_batches([batch]), keys, levels, pages, titles).to_batches()
        end = tree.rest()
        if end is not None:
            yield from end.to_batches()

    out = rows.mapInArrow(run, schema)
    if last:
        return out.withColumnRenamed("_end", "end_page")
    return out.join(last_page, key).withColumn("end_page", F.coalesce("_end", "last_page")).drop("_end", "last_page")


def with_ancestors(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sort_order and chain: (sort_order, title) from the root down to the section, at any depth.

    Sections that bring their chain (see section_tree) are taken as they are. Else pointers are doubled: each round puts the chain of the section pointed at before one's own and points where that one points, so there are as many rounds as
    the deepest chain has binary digits. A parent that is missing ends a chain.
    """
    if "chain" in sections.columns:
        return sections.select(key, "sort_order", "chain")
    state = sections.select(key, "sort_order", F.col("parent_order").alias("up"), F.array(F.struct("sort_order", "title")).alias("chain"))
    while True:
        state = cut(state)
        if state.filter("up IS NOT NULL").isEmpty():
            return state.drop("up")
        above = state.select(key, F.col("sort_order").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
        moved = state.filter("up IS NOT NULL").join(above, [key, "up"], "left")
        longer = F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain"))
        state = state.filter("up IS NULL").unionByName(moved.select(key, "sort_order", F.col("_up").alias("up"), longer.alias("chain")))


def titles(chain: Column) -> Column:
    return F.transform(chain, lambda x: x["title"])


def heading_paths(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sort_order, and path: titles from the root to the section; its length is the section's level in a table of contents."""
    return with_ancestors(sections, key).select(key, "sort_order", titles(F.col("chain")).alias("path"))


def descendants(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, top (any section's order) and member (itself or a section below it)."""
    return with_ancestors(sections, key).select(key, F.explode(F.transform("chain", lambda x: x["sort_order"])).alias("top"), F.col("sort_order").alias("member"))


def segments(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of lines of one kind and section (key, page, line_no, line, section): kind, text, pages. Runs go over page ends.

    An optional column heading marks lines that stand alone, of kind heading.
    """
    kind = F.when(is_table(F.col("line")), "table").when(is_list(F.col("line")), "list").otherwise("paragraph")
    if "heading" in rows.columns:
        kind = F.when(F.col("heading"), "heading").otherwise(kind)
    w = Window.partitionBy(key).orderBy("page", "line_no")
    marked = rows.withColumn("kind", kind)
    changed = (F.lag("kind").over(w) != F.col("kind")) | ~F.col("section").eqNullSafe(F.lag("section").over(w)) | F.lag("kind").over(w).isNull() | (F.col("kind") == "heading")
    numbered = marked.withColumn("segment", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))
    grouped = numbered.groupBy(key, "segment").agg(F.first("kind").alias("kind"), F.first("section").alias("section"), F.min("page").alias("page"), F.max("page").alias("end_page"), parts.alias("_lines"))
    texts = F.transform("_lines", lambda x: x["line"])
    return grouped.withColumn("text", F.when(F.col("kind") == "table", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))).drop("_lines")


CHUNK = "struct<content:string,token_count:long,page:int,end_page:int,contains_table:boolean,contains_list:boolean,forced_split:boolean>"
CHUNKS = pa.list_(pa.struct([("content", pa.string()), ("token_count", pa.int64()), ("page", pa.int32()), ("end_page", pa.int32()), *[(c, pa.bool_()) for c in ("contains_table", "contains_list", "forced_split")]]))


def chunk(segment_rows: DataFrame, *, target: int = 800, least: int = 500, most: int = 1000, overlap: int = 78, count: Callable[[str], int] = token_estimate, table_pages: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Chunks (key, chunk_index, section, content, token_count, page, end_page, contains_table, contains_list, forced_split) of segments (key, segment, kind, section, page, end_page, text).

    Segments over `most` tokens are cut at rows, sentences or at last words. Within a section, segments gather until the next one would pass `target`; then the last paragraphs
    of the chunk, or whole sentences of one, of at most `overlap` tokens open the next chunk. A chunk under `least` takes the next one in if both fit the target. A section
    always ends a chunk, so each section of a document is a group of its own. table_pages: key and page of pages known to
    hold a table, which mark the chunks that touch them.
    """
    parts = F.array_sort(F.collect_list(F.struct("segment", "kind", "text", "page", "end_page")))
    grouped = segment_rows.groupBy(key, "section").agg(F.min("segment").alias("_first"), parts.alias("_parts"))
    limits = Limits(target, least, max(most, target), overlap)

    @F.arrow_udf(f"array<{CHUNK}>")
    def pack(sections: pa.Array) -> pa.Array:
        of = iter(zip(*[column.to_pylist() for column in sections.flatten().flatten()[1:]]))  # kind, text, page and end_page
        return pa.array([pack_section(list(islice(of, n)), limits, count) for n in pc.list_value_length(sections).to_pylist()], CHUNKS)

    packed = grouped.select(key, "section", "_first", F.posexplode(pack("_parts")).alias("_place", "_chunk"))
    order = Window.partitionBy(key).orderBy("_first", "_place")
    out = packed.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "section", "_chunk.*")
    if table_pages is not None:
        touched = out.select(key, "chunk_index", F.explode(F.sequence("page", "end_page")).alias("page")).join(table_pages.select(key, "page").distinct(), [key, "page"], "left_semi")
        out = out.join(touched.select(key, "chunk_index").distinct().withColumn("_table", F.lit(True)), [key, "chunk_index"], "left")
        out = out.withColumn("contains_table", F.col("contains_table") | F.coalesce("_table", F.lit(False))).drop("_table")
    return out
