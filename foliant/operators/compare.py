"""Comparing two versions: section alignment, text difference, change rows."""

from __future__ import annotations

import difflib
import re
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.functions.difference import difference, share

#: Least similarity of the third pass; from so many new sections on, fewer matches than this share mean a restructured text.
LEAST_SIMILARITY = 0.86
LEAST_MATCHED, LEAST_SECTIONS = 0.30, 3


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is named, a local master gets one of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliant-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df from compressed files in the shared folder: less disk than cut, for rows with texts that several steps read."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def align(a: DataFrame, b: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """pair, a_order, b_order, method of sections (pair, sort_order, number, title) of both versions.

    By number first, then the rest by title without marks; the first section of a key counts on both sides. With scores (pair, a_order,
    b_order, score), what is left is matched greedily by them. Then the rest is removed or added. A pair with LEAST_SECTIONS new
    sections or more and less than LEAST_MATCHED of them matched is one row whole_document without sections. Both versions are dealt by pair
    once; every step is a window within it. Rows without a pair are left out.
    """

    def side(x: DataFrame, old: bool) -> DataFrame:
        bare = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
        return x.filter("pair IS NOT NULL").select("pair", F.lit(old).alias("old"), "sort_order", "number", bare.alias("bare"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("other"))

    rows = side(a, True).unionByName(side(b, False)).repartition("pair")
    for key, name in (("number", "number"), ("bare", "title")):
        w = Window.partitionBy("pair", key, F.col("method").isNull())
        first_old, first_new = (F.min(F.when(x, F.col("sort_order"))).over(w) for x in (F.col("old"), ~F.col("old")))
        rows = rows.withColumns({"_old": first_old, "_new": first_new})
        own, its = F.when(F.col("old"), F.col("_old")).otherwise(F.col("_new")), F.when(F.col("old"), F.col("_new")).otherwise(F.col("_old"))
        hit = F.col("method").isNull() & (F.col(key) != "") & (F.col("sort_order") == own) & its.isNotNull()
        rows = rows.withColumns({"method": F.when(hit, name).otherwise(F.col("method")), "other": F.when(hit, its).otherwise(F.col("other"))}).drop("_old", "_new")
    if scores is not None:
        rows = cut(rows)
        open_a, open_b = (rows.filter(x & F.col("method").isNull()).select("pair", F.col("sort_order").alias(n)) for x, n in ((F.col("old"), "a_order"), (~F.col("old"), "b_order")))
        near = greedy_match(scores.join(open_a, ["pair", "a_order"], "left_semi").join(open_b, ["pair", "b_order"], "left_semi"))
        ends = near.select("pair", F.lit(True).alias("old"), F.col("a_order").alias("sort_order"), F.col("b_order").alias("near"))
        ends = ends.unionByName(near.select("pair", F.lit(False).alias("old"), F.col("b_order").alias("sort_order"), F.col("a_order").alias("near")))
        rows = rows.join(ends, ["pair", "old", "sort_order"], "left")
        rows = rows.withColumns({"method": F.when(F.col("near").isNotNull(), "similarity").otherwise(F.col("method")), "other": F.coalesce("other", "near")})
    w = Window.partitionBy("pair")
    sizes = {"_a": F.count_if("old").over(w), "_b": F.count_if(~F.col("old")).over(w), "_both": F.count_if(F.col("old") & F.col("method").isNotNull()).over(w)}
    rows = rows.withColumns(sizes | {"_place": F.row_number().over(w.orderBy("old", "sort_order"))})
    lost = (F.col("_a") > 0) & (F.col("_b") >= LEAST_SECTIONS) & (F.col("_both") / F.col("_b") < LEAST_MATCHED)
    kept = rows.withColumn("lost", lost).filter(F.when(F.col("lost"), F.col("_place") == 1).otherwise(F.col("old") | F.col("method").isNull()))
    a_order = F.when(F.col("old") & ~F.col("lost"), F.col("sort_order"))
    b_order = F.when(~F.col("lost"), F.when(F.col("old"), F.col("other")).otherwise(F.col("sort_order")))
    method = F.when(F.col("lost"), "whole_document").otherwise(F.coalesce("method", F.when(F.col("old"), "removed").otherwise("added")))
    return kept.select("pair", a_order.alias("a_order"), b_order.alias("b_order"), method.alias("method"))


#: A pair of versions with at most so many candidates is matched in one pass over them.
ONE_PASS = 1 << 14


def one_pass(candidates: DataFrame) -> DataFrame:
    """pair, a_order, b_order, score taken from each pair's candidates, best first, each section once."""
    kind = "array<struct<a_order:int,b_order:int,score:double>>"

    @F.pandas_udf(kind)
    def matched(lists: pd.Series) -> pd.Series:
        out = []
        for rows in lists:
            used_a, used_b, taken = set(), set(), []
            for score, i, j in sorted(((r["score"], r["a_order"], r["b_order"]) for r in rows), reverse=True):
                if i not in used_a and j not in used_b:
                    used_a.add(i)
                    used_b.add(j)
                    taken.append({"a_order": i, "b_order": j, "score": score})
            out.append(taken)
        return pd.Series(out)

    rows = candidates.groupBy("pair").agg(F.collect_list(F.struct(F.col("a_order").cast("int").alias("a_order"), F.col("b_order").cast("int").alias("b_order"), F.col("score").cast("double").alias("score"))).alias("rows"))
    return rows.select("pair", F.explode(matched("rows")).alias("m")).select("pair", "m.a_order", "m.b_order", "m.score")


def greedy_match(scores: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """pair, a_order, b_order, score: best first, each section once. scores: the candidates (pair, a_order, b_order, score).

    A pair of at most ONE_PASS candidates is one row of lists. Larger ones go by rounds until they are that small: a candidate that both its sections
    rank first is taken, and all others of the two sections go, which gives the rows of one pass over the candidates in order. Of equal scores the later
    section comes first, in the old version and then in the new. Repeated candidates count once, with their best score; null orders and scores are
    no candidates.
    """
    open_ = scores.filter((F.col("score") >= least) & F.col("a_order").isNotNull() & F.col("b_order").isNotNull())
    open_ = cut(open_.groupBy("pair", "a_order", "b_order").agg(F.max("score").alias("score")))
    found: list[DataFrame] = []
    while True:
        large = cut(open_.groupBy("pair").count().filter(F.col("count") > ONE_PASS).select("pair"))
        if large.isEmpty():
            found.append(one_pass(open_))
            break
        found.append(one_pass(open_.join(large, "pair", "left_anti")))
        open_ = open_.join(large, "pair", "left_semi")
        of_a = open_.groupBy("pair", "a_order").agg(F.max(F.struct("score", "b_order")).alias("m")).select("pair", "a_order", "m.b_order", "m.score")
        of_b = open_.groupBy("pair", "b_order").agg(F.max(F.struct("score", "a_order")).alias("m")).select("pair", "m.a_order", "b_order")
        taken = cut(of_a.join(of_b, ["pair", "a_order", "b_order"]))
        found.append(taken.select("pair", F.col("a_order").cast("int").alias("a_order"), F.col("b_order").cast("int").alias("b_order"), F.col("score").cast("double").alias("score")))
        open_ = cut(open_.join(taken.select("pair", "a_order"), ["pair", "a_order"], "left_anti").join(taken.select("pair", "b_order"), ["pair", "b_order"], "left_anti"))
    out = found[0]
    for taken in found[1:]:
        out = out.unionByName(taken)
    return out


def word_change_share(old: str, new: str) -> float:
    """Words of the longer text outside the matching blocks, over all of them; 1 where neither has a word."""
    a, b = (re.findall(r"\w+", (t or "").lower()) for t in (old, new))
    most = max(len(a), len(b))
    same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return (most - same) / most if most else 1.0


def section_changes(aligned: DataFrame, a: DataFrame, b: DataFrame, critical: list[str], materiality: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """pair, section, a_order, b_order, change, proportion, severity, old_text and new_text of the aligned sections that differ.

    a, b: pair, sort_order, number, title, text. Sections of equal text drop out undiffed, and so do those that differ in form alone;
    whole_document rows compare all texts of a pair in order. section: title, number or place among the aligned sections of the pair. A title or number that holds a critical
    pattern raises a change's severity, as does a verdict in materiality (pair, section, materiality), if there is one. Sections in done (pair, section) were written by an
    earlier attempt and drop out.
    """

    def side(x: DataFrame, name: str) -> DataFrame:
        return x.select("pair", *[F.col(c).alias(f"{name}_{n}") for c, n in (("sort_order", "order"), ("title", "title"), ("number", "number"), ("text", "text"))])

    def all_text(x: DataFrame, name: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("sort_order", "text")))
        return x.groupBy("pair").agg(F.array_join(F.transform(texts, lambda r: r["text"]), "\n\n").alias(f"{name}_text"))

    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.col("a_order").isNull(), "a_order", "b_order"))
    parts = aligned.filter("method <> 'whole_document'").withColumn("place", place).join(side(a, "a"), ["pair", "a_order"], "left").join(side(b, "b"), ["pair", "b_order"], "left")
    lost = aligned.filter("method = 'whole_document'")
    whole = lost.join(all_text(a.join(lost, "pair", "left_semi"), "a"), "pair", "left").join(all_text(b.join(lost, "pair", "left_semi"), "b"), "pair", "left")
    rows = parts.unionByName(whole, allowMissingColumns=True)
    title, number = (F.when(F.col("a_order").isNotNull(), F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")) for n in ("title", "number"))
    label = F.when(F.col("method") == "whole_document", "(whole document)").otherwise(F.coalesce(F.nullif(title, F.lit("")), F.nullif(number, F.lit("")), F.concat(F.lit("section_"), F.col("place"))))
    change = F.when(F.col("method") == "added", "ADDED").when(F.col("method") == "removed", "REMOVED").otherwise("MODIFIED")
    held = F.coalesce(X.critical_section(F.concat_ws(" ", title, number), critical), F.lit(False))
    rows = rows.withColumns({"change": change, "section": label, "held": held})
    if done is not None:
        rows = rows.join(done.select("pair", "section").distinct(), ["pair", "section"], "left_anti")
    rows = rows.filter((F.col("change") != "MODIFIED") | ~F.col("a_text").eqNullSafe(F.col("b_text")))
    rows = text_changes(rows.withColumns({"old_text": F.when(F.col("change") == "MODIFIED", F.col("a_text")), "new_text": F.when(F.col("change") == "MODIFIED", F.col("b_text"))}))
    rows = rows.filter("change <> 'MODIFIED' OR NOT unchanged").withColumn("proportion", F.when(F.col("change") != "MODIFIED", 1.0).otherwise(F.col("proportion")))
    rows = rows.withColumn("materiality", F.lit(None).cast("string")) if materiality is None else rows.join(materiality.select("pair", "section", "materiality"), ["pair", "section"], "left")
    severity = X.comparison_severity(F.col("change"), F.col("held"), F.when(F.col("change") == "MODIFIED", F.col("materiality")), F.col("proportion"))
    return rows.select("pair", "section", "a_order", "b_order", "change", "proportion", severity.alias("severity"), F.col("a_text").alias("old_text"), F.col("b_text").alias("new_text"))


def comparison_summary(aligned: DataFrame, changes: DataFrame) -> DataFrame:
    """pair, total, major, moderate, minor (numbers of changes) and alignment_degraded (compared as whole documents) of every aligned pair."""
    degraded = aligned.groupBy("pair").agg(F.bool_or(F.col("method") == "whole_document").alias("alignment_degraded"))
    counts = changes.groupBy("pair").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("MAJOR", "MODERATE", "MINOR")])
    return degraded.join(counts, "pair", "left").na.fill(0, ["total", "major", "moderate", "minor"])


#: Texts whose differences are Python objects at a time.
SLICE = 128


def text_changes(pairs: DataFrame) -> DataFrame:
    """Adds unchanged (alike but for form), proportion, changed_words and spans (tag, old, new; none if unchanged) to rows with old_text and new_text.

    Equal texts and those equal in normal form are not compared; a missing text counts as empty. One Arrow function a batch, whose answers become Arrow rows every
    SLICE texts, in memory and time about linear in the texts and their pairs of equal words.
    """
    span = pa.struct([("tag", pa.string()), ("old", pa.string()), ("new", pa.string())])
    kind = pa.struct([("spans", pa.list_(span)), ("changed", pa.int64()), ("proportion", pa.float64())])

    @F.arrow_udf("struct<spans:array<struct<tag:string,old:string,new:string>>,changed:long,proportion:double>")
    def compared(old: pa.Array, new: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for at in range(0, len(old), SLICE):
            rows = []
            for x, y in zip(old.slice(at, SLICE), new.slice(at, SLICE)):
                spans, changed, words = difference(x.as_py(), y.as_py()) if x.is_valid else ([], 0, 0)
                rows.append({"spans": [{"tag": t, "old": a, "new": b} for t, a, b in spans], "changed": changed, "proportion": round(share(changed, words, not spans), 6)})
            parts.append(pa.array(rows, kind))
        return pa.concat_arrays(parts)

    name = "_difference"
    same = F.col("old_text").eqNullSafe(F.col("new_text"))
    # normal forms are columns of their own, so that each is made once and only where the texts differ
    out = pairs.withColumns({f"{name}_{c}": F.when(~same, F.coalesce(X.diff_normal(F.col(c)), F.lit(""))) for c in ("old_text", "new_text")})
    old, new = (F.col(f"{name}_{c}") for c in ("old_text", "new_text"))
    out = out.withColumn("unchanged", same | (old == new))
    out = out.withColumn(name, compared(F.when(~F.col("unchanged"), old), F.when(~F.col("unchanged"), new)))
    return out.withColumns({"proportion": F.col(f"{name}.proportion"), "changed_words": F.col(f"{name}.changed"), "spans": F.col(f"{name}.spans")}).drop(name, f"{name}_old_text", f"{name}_new_text")
