"""The conflict scan: candidate pairs, their confirmation, and the merge of confirmed pairs into conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.operators.compare import cut

#: Fixed value: a pair is confirmed from this confidence on.
LEAST_CONFIDENCE = 0.6


def confirmed(is_conflict: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Whether a verdict confirms its pair; one that is missing does not."""
    return F.coalesce(is_conflict & (confidence >= least), F.lit(False))


def recorded_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """seq and conflict_id (the least) of pairs (seq, a, b) whose chunks both stand in one recorded conflict of any status."""
    of = members.select("conflict_id", "chunk_id").distinct()
    shared = pairs.select("seq", "a", "b").join(of.withColumnRenamed("chunk_id", "a"), "a").join(of.withColumnRenamed("chunk_id", "b"), ["b", "conflict_id"], "left_semi")
    return shared.groupBy("seq").agg(F.min("conflict_id").alias("conflict_id"))


def homes(pairs: DataFrame, open_: DataFrame) -> DataFrame:
    """The open conflict each chunk of the pairs (seq, a, b) ends in: chunk, first (its first pair), was_held, conflict_id or opened_by.

    A chunk's first pair decides for good: it opens a conflict if that pair is the first of the other chunk too and neither is held by an open
    conflict; else the chunk joins the other's, which has one by then. So every chunk points at one that was placed before it, and the pointers are
    doubled until each ends at a held chunk or an opened conflict: as many rounds as the longest chain has binary digits. All steps are
    grouped minima and joins on chunks with one row a chunk on one side.
    """
    ends = pairs.select("seq", F.col("a").alias("chunk"), F.col("b").alias("other")).unionByName(pairs.select("seq", F.col("b").alias("chunk"), F.col("a").alias("other")))
    first = ends.groupBy("chunk").agg(F.min(F.struct("seq", "other")).alias("_first"))
    nodes = cut(first.select("chunk", F.col("_first.seq").alias("first"), F.col("_first.other").alias("other")).join(open_, "chunk", "left"))
    beside = nodes.select(F.col("chunk").alias("other"), F.col("first").alias("_first"), F.col("conflict_id").alias("_held"))
    opens = F.col("conflict_id").isNull() & F.col("_held").isNull() & (F.col("first") == F.col("_first"))
    state = nodes.join(beside, "other").select(
        "chunk", "first", F.col("conflict_id").isNotNull().alias("was_held"), "conflict_id", F.when(opens, F.col("first")).alias("opened_by"),
        F.when(F.col("conflict_id").isNull() & ~opens, F.col("other")).alias("parent"),
    )
    state = cut(state)
    while not state.filter("parent IS NOT NULL").isEmpty():
        above = state.select(F.col("chunk").alias("parent"), F.col("conflict_id").alias("_c"), F.col("opened_by").alias("_o"), F.col("parent").alias("_p"))
        moved = state.filter("parent IS NOT NULL").drop("conflict_id", "opened_by").join(above, "parent")
        moved = moved.select("chunk", "first", "was_held", F.col("_c").alias("conflict_id"), F.col("_o").alias("opened_by"), F.col("_p").alias("parent"))
        state = cut(state.filter("parent IS NULL").unionByName(moved))
    return state.drop("parent")


def merge_pairs(pairs: DataFrame, members: DataFrame, *, own: bool = False) -> DataFrame:
    """What taking the confirmed pairs one by one, by seq, does to the conflicts: pairs' columns, outcome, conflict_id, opened_by, joined.

    pairs: seq (unique, of any type that has an order), a, b. members: conflict_id, chunk_id, status, detected_at of recorded conflicts. Outcomes:
    `recorded` where both chunks stand in one conflict already, of any status; `created`, a new conflict of both chunks, named by opened_by = seq of the pair that
    opened it; `grown`, where one chunk is in an open conflict, which the other (joined) enters; `skipped`, where the chunks are in
    two open conflicts. Of several open conflicts that hold a chunk the first detected counts. Nothing is done pair by pair (see homes), so a chunk of
    any number of pairs is no group. Pairs with a null chunk or seq are left out, and so are those of one chunk with itself, unless own:
    then the first such pair of a chunk that no conflict holds opens one, and the others are recorded.
    """
    rows = pairs.filter(("a IS NOT NULL AND b IS NOT NULL" if own else "a <> b") + " AND seq IS NOT NULL")
    open_ = members.filter("status = 'OPEN' AND chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("chunk")).agg(F.min(F.struct("detected_at", "conflict_id")).alias("_of"))
    known = recorded_pairs(rows, members).withColumnRenamed("conflict_id", "_known")
    rows = cut(rows.join(known, "seq", "left"))
    found = homes(rows.filter("_known IS NULL"), open_.select("chunk", F.col("_of.conflict_id").alias("conflict_id")))

    def side(name: str) -> DataFrame:
        new = ~F.col("was_held")
        return found.select(F.col("chunk").alias(name), F.when(new, F.col("first")).alias(f"_{name}_at"), F.col("conflict_id").alias(f"_{name}_held"), F.col("opened_by").alias(f"_{name}_opened"))

    rows = rows.join(side("a"), "a", "left").join(side("b"), "b", "left")
    new_a, new_b = (F.coalesce(F.col(f"_{x}_at") == F.col("seq"), F.lit(False)) for x in "ab")
    one = F.col("_a_held").eqNullSafe(F.col("_b_held")) & F.col("_a_opened").eqNullSafe(F.col("_b_opened"))
    outcome = F.when(F.col("_known").isNotNull() | (one & ~new_a & ~new_b), "recorded").when(new_a & new_b, "created").when(new_a | new_b, "grown").otherwise("skipped")
    rows = rows.withColumn("outcome", outcome)
    told = (F.col("outcome") != "skipped") & F.col("_known").isNull()
    return rows.withColumns(
        {
            "conflict_id": F.coalesce("_known", F.when(told, F.col("_a_held"))),
            "opened_by": F.when(told, F.col("_a_opened")),
            "joined": F.when(F.col("outcome") == "grown", F.when(new_a, F.col("a")).otherwise(F.col("b"))),
        }
    ).drop("_known", *[f"_{x}_{y}" for x in "ab" for y in ("at", "held", "opened")])


def new_statements(merged: DataFrame) -> DataFrame:
    """conflict_id, opened_by, chunk, seq, place of the statements that merge_pairs adds: both chunks of a created conflict, one of a grown."""
    added = F.when(F.col("outcome") == "created", F.array("a", "b")).when(F.col("outcome") == "grown", F.array("joined"))
    return merged.select("conflict_id", "opened_by", "seq", F.posexplode(added).alias("place", "chunk"))


def opened_severity(critical: Column, confidence: Column) -> Column:
    """Severity a conflict is created with: it has two statements then, and growing does not change it."""
    return X.conflict_severity(F.lit(2), confidence, critical)
