"""A partitioned vector index: cells around coarse centres, kept as a table, probed by the nearest cells of each query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.compare import cut

#: Centres travel to every task: at most so many.
MOST_CELLS = 4096
FOUND = pa.schema([("vec_id", pa.int64()), ("other_id", pa.int64()), ("score", pa.float64())])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector at length one; null ids, zero vectors and those with null or non-finite components are left out."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.filter(F.col("vec_id").isNotNull() & fine).withColumn("length", length).filter("length > 0")
    return rows.select("vec_id", "label", F.transform("v", lambda x: x / F.col("length")).alias("v"))


@dataclass(frozen=True)
class Index:
    """Folder of the rows by cell, the centres, and of each cell its farthest row's distance and its number of rows."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def build(vectors: DataFrame, path: str, *, cells: int, sample: int = 50_000, rounds: int = 10, seed: int = 7) -> Index:
    """Fits the centres by k-means on at most `sample` vectors, deals every vector to the nearest one and stores them by cell under path."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"an index has 1 to {MOST_CELLS} cells")
    units = unit_vectors(vectors)
    some = units.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select(array_to_vector("v").alias("features"))
    if some.isEmpty():
        raise ValueError("an index needs a vector")
    model = KMeans(k=cells, maxIter=rounds, seed=seed).fit(some) if cells > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.zeros((1, len(units.first()["v"])))
    dealt = units.withColumn("near", nearest_centres(centres, 1)("v")).select("vec_id", "label", "v", F.col("near.cell")[0].alias("cell"), F.col("near.distance")[0].alias("distance"))
    dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)  # a crowded cell is dealt among tasks
    radius, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    stored = vectors.sparkSession.read.parquet(path)
    for r in stored.groupBy("cell").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect():  # one row a cell
        radius[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
    return Index(path, centres, radius, rows)


def nearest_centres(centres: np.ndarray, many: int):
    """Column function: the nearest cells of a vector and their distances, nearest first."""
    many, square = min(many, len(centres)), (centres * centres).sum(axis=1)

    @F.pandas_udf("struct<cell:array<int>,distance:array<double>>")
    def near(column):
        import pandas as pd

        cells, distances = [], []
        for at in range(0, len(column), 1024):
            v = np.array(column.iloc[at : at + 1024].to_list())
            d = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + square - 2 * v @ centres.T, 0))
            order = np.argsort(d, axis=1, kind="stable")[:, :many]
            cells += order.tolist()
            distances += np.take_along_axis(d, order, axis=1).tolist()
        return pd.DataFrame({"cell": cells, "distance": distances})

    return near


def nearest_by_index(index: Index, queries: DataFrame, k: int, *, probes: int, block: int = 4096) -> DataFrame:
    """vec_id, other_id, score, rank, certain: for each query its k nearest rows of other labels in its `probes` nearest cells; ties by id.

    Queries are copied to each part of their cells, rows of probed cells are read once and dealt in parts of about `block`, so neither a crowded cell nor one that many
    queries probe is one group. `certain`: by the triangle inequality, no row of a cell that was not probed can be nearer than the
    k-th one found. With probes = all cells every answer is exact and certain.
    """
    spark = queries.sparkSession
    units = unit_vectors(queries)
    cells = len(index.centres)
    parts = np.maximum(1, -(-index.rows // block)).tolist()
    radius = [float(x) for x in index.radius]
    filled = [bool(x) for x in index.rows]
    near = units.withColumn("near", nearest_centres(index.centres, cells)("v"))
    part_of = F.array(*map(F.lit, parts))
    # The nearest any row of an unprobed cell can lie: the centre's distance less the cell's radius.
    rest = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.when((i >= probes) & F.get(F.array(*map(F.lit, filled)), F.get("near.cell", i)), F.get("near.distance", i) - F.get(F.array(*map(F.lit, radius)), F.get("near.cell", i))))
    probed = near.select("vec_id", "label", "v", F.array_min(rest).alias("beyond"), F.slice("near.cell", 1, probes).alias("cells"))
    asked = probed.select("vec_id", "label", "v", F.explode("cells").alias("cell"))
    asked = asked.select("vec_id", "label", "v", "cell", F.explode(F.sequence(F.lit(0), F.get(part_of, F.col("cell")) - 1)).alias("part"))
    held = spark.read.parquet(index.path)
    wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    held = held.filter(F.col("cell").isin(wanted)).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(part_of, F.col("cell"))).cast("int"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        right = right.sort_by("vec_id")
        y, ids, labels = np.array(right.column("v").to_pylist()), right.column("vec_id").to_numpy(), right.column("label").to_numpy()
        out = []
        for at in range(0, left.num_rows, 1024):
            some = left.slice(at, 1024)
            score = np.round(np.array(some.column("v").to_pylist()) @ y.T, 6)
            score[some.column("label").to_numpy()[:, None] == labels] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(score, order, axis=1).ravel()
            asker = np.repeat(some.column("vec_id").to_numpy(), order.shape[1])
            keep = np.isfinite(found)
            out.append(pa.Table.from_arrays([pa.array(asker[keep]), pa.array(ids[order.ravel()][keep]), pa.array(found[keep])], schema=FOUND))
        return pa.concat_tables(out)

    pairs = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(best, "vec_id long, other_id long, score double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "other_id"))
    top = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    last = F.min("score").over(Window.partitionBy("vec_id"))
    full = F.count("*").over(Window.partitionBy("vec_id")) == k
    top = top.withColumns({"_last": last, "_full": full}).join(probed.select("vec_id", "beyond"), "vec_id")
    certain = F.col("beyond").isNull() | (F.col("_full") & (F.col("beyond") > F.sqrt(F.greatest(2 - 2 * (F.col("_last") - 1e-6), F.lit(0.0))) + 1e-5))  # scores are rounded
    return top.select("vec_id", "other_id", "score", "rank", certain.alias("certain"))


def exact_by_index(index: Index, queries: DataFrame, k: int, *, probes: int) -> DataFrame:
    """nearest_by_index where all answers are certain: queries that are not after `probes` cells are asked of all cells."""
    first = cut(nearest_by_index(index, queries, k, probes=probes).filter("certain"))
    rest = queries.join(first.select("vec_id").distinct(), "vec_id", "left_anti")
    return first.unionByName(nearest_by_index(index, rest, k, probes=len(index.centres)))
