"""Which chunks of a long document stand for it: by sections, by pages, evenly spaced, and what else the budget holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.operators.structure import with_ancestors


def middle(rows: Column, take: int) -> Column:
    """The middle `take` elements of an array in order."""
    n = F.size(rows)
    many = F.least(n, F.lit(take))
    return F.slice(rows, F.floor((n - many) / 2).cast("int") + 1, many)


def evenly(rows: Column, total: Column, budget: int) -> Column:
    """Elements (at, cost) at even steps, as many as the budget's share of the total, those that no longer fit passed over; the first one if none fits."""
    n = F.size(rows)
    target = F.greatest(F.lit(1), F.floor(n * (budget / total)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(rows, lambda x: F.lit(False)).alias("picked"))

    def step(s: Column, i: Column) -> Column:
        row = F.get(rows, F.least(F.floor(i * (n / target)).cast("int"), n - 1))
        fits = s["used"] + row["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + row["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["picked"], F.array(row))).otherwise(s["picked"]).alias("picked"))

    picked = F.aggregate(F.sequence(F.lit(0), target - 1), start, step)["picked"]
    return F.when((target >= n) | (total <= 0), F.when(total <= 0, F.slice(rows, 1, 1)).otherwise(rows)).when(F.size(picked) == 0, F.slice(rows, 1, 1)).otherwise(picked)


def represented(sections: DataFrame, chunks: DataFrame, *, budget: int, per_section: int = 1) -> DataFrame:
    """document_id, chosen (chunk ids in reading order), sampled, strategy, included (top sections, in order) and excluded (how many gave nothing).

    sections: document_id, section_id, parent_id, sort_order, page, end_page; chunks: document_id, chunk_id, chunk_index (unique in the document), section_id, cost, page.
    A document within the budget is taken whole. One without sections is sampled at even steps. Else each top section, in order, gives the middle `per_section` of the
    chunks of its tree, or, if that has none, of the chunks on its pages that no earlier section took; then all chunks not taken join in reading order while they
    fit. The trees come from pointers of sections; what follows is one fold over the top sections and one over the chunks of a document.
    """
    numbered = sections.select("document_id", "section_id", "parent_id", "sort_order", "page", F.coalesce("end_page", "page").alias("end_page"))
    parents = numbered.select("document_id", F.col("section_id").alias("parent_id"), F.col("sort_order").alias("parent_order"))
    linked = numbered.join(parents, ["document_id", "parent_id"], "left")
    roots = with_ancestors(linked.select("document_id", "sort_order", F.when(F.col("parent_id").isNotNull(), F.col("parent_order")).alias("parent_order"), F.lit("").alias("title")), "document_id")
    tops = roots.select("document_id", "sort_order", F.get("chain", F.lit(0))["sort_order"].alias("top")).join(numbered.select("document_id", "sort_order", "section_id"), ["document_id", "sort_order"])
    placed = chunks.join(tops.select("document_id", "section_id", "top"), ["document_id", "section_id"], "left")
    of_top = Window.partitionBy("document_id", "top")
    at, many = F.row_number().over(of_top.orderBy("chunk_index")) - 1, F.count("*").over(of_top)
    first = F.floor((F.col("_many") - F.least("_many", F.lit(per_section))) / 2)
    own = placed.filter("top IS NOT NULL").withColumns({"_at": at, "_many": many}).filter((F.col("_at") >= first) & (F.col("_at") < first + per_section))
    own = own.groupBy("document_id", F.col("top").alias("sort_order")).agg(F.array_sort(F.collect_list(F.col("chunk_index").cast("int"))).alias("own"))
    top = F.struct("sort_order", "section_id", "page", "end_page", "own")
    listed = linked.filter("parent_id IS NULL").join(own, ["document_id", "sort_order"], "left").groupBy("document_id").agg(F.array_sort(F.collect_list(top)).alias("_tops"))
    row = F.struct(F.col("chunk_index").alias("at"), "chunk_id", F.col("cost").cast("long").alias("cost"), "page")
    docs = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.sum("cost").cast("long").alias("_total"))
    docs = docs.join(listed, "document_id", "left").join(sections.select("document_id").distinct().withColumn("_any", F.lit(True)), "document_id", "left")
    ids = dict(sections.dtypes)["section_id"]
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("taken"), F.array().cast(f"array<{ids}>").alias("included"))

    def section(s: Column, t: Column) -> Column:
        near = F.transform(F.filter("_rows", lambda r: r["page"].between(t["page"], t["end_page"]) & ~F.array_contains(s["taken"], r["at"].cast("int"))), lambda r: r["at"].cast("int"))
        picked = F.when(t["own"].isNotNull(), t["own"]).otherwise(X.let(near, lambda rows: middle(rows, per_section)))
        return X.let(picked, lambda p: F.struct(F.concat(s["taken"], p).alias("taken"), F.when(F.size(p) > 0, F.concat(s["included"], F.array(t["section_id"]))).otherwise(s["included"]).alias("included")))

    docs = docs.withColumn("_s", F.aggregate(F.coalesce("_tops", F.filter("_tops", lambda t: F.lit(False))), start, section))
    def filled(taken: Column) -> Column:
        """What sections took, and in reading order what still fits. Bound once: a column that only a lambda names is computed for each of its elements."""
        spent = F.aggregate(F.filter("_rows", lambda r: F.array_contains(taken, r["at"].cast("int"))), F.lit(0).cast("long"), lambda s, r: s + r["cost"])
        state = F.struct((F.lit(budget).cast("long") - spent).alias("left"), none.alias("more"))

        def fill(s: Column, r: Column) -> Column:
            fits = (s["left"] > 0) & (r["cost"] <= s["left"]) & ~F.array_contains(taken, r["at"].cast("int"))
            return F.when(fits, F.struct((s["left"] - r["cost"]).alias("left"), F.concat(s["more"], F.array(r["at"].cast("int"))).alias("more"))).otherwise(s)

        return F.concat(taken, F.aggregate("_rows", state, fill)["more"])

    kept = X.let(X.let(F.coalesce("_s.taken", none), filled), lambda taken: F.filter("_rows", lambda r: F.array_contains(taken, r["at"].cast("int"))))
    whole, bare = F.col("_total") <= budget, F.col("_any").isNull()
    chosen = F.when(whole, F.col("_rows")).when(bare, evenly(F.col("_rows"), F.col("_total"), budget)).otherwise(kept)
    sectioned = ~whole & ~bare
    return docs.select(
        "document_id", F.transform(chosen, lambda r: r["chunk_id"]).alias("chosen"), (~whole).alias("sampled"), F.when(whole, "full").otherwise("section_diverse").alias("strategy"),
        F.when(sectioned, F.coalesce("_s.included", F.array().cast(f"array<{ids}>"))).otherwise(F.array().cast(f"array<{ids}>")).alias("included"),
        F.when(sectioned, F.coalesce(F.size("_tops"), F.lit(0)) - F.coalesce(F.size("_s.included"), F.lit(0))).otherwise(0).alias("excluded"),
    )
