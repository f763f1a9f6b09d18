"""Lists, pages, history, KPIs and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, *, time: str, key: str, limit: int, after: tuple | None = None, newest: bool = True) -> DataFrame:
    """The next page, newest or oldest first, after the row (time, key); one more row than asked tells that there is more."""
    if after is not None:
        at, last = F.struct(time, key), F.struct(F.lit(after[0]).cast(rows.schema[time].dataType), F.lit(after[1]).cast(rows.schema[key].dataType))
        rows = rows.filter(at < last if newest else at > last)
    order = [F.desc(time), F.desc(key)] if newest else [F.asc(time), F.asc(key)]
    return rows.orderBy(*order).limit(limit + 1)


def audit_page(events: DataFrame, users: DataFrame, *, actions: list[str], since: str, until: str, offset: int, limit: int, user: int | None = None, resource: str | None = None) -> DataFrame:
    """Events of the actions in the closed time range with the user's name, newest first; of one user or one resource (column resource) if asked."""
    if user is not None:
        events = events.filter(F.col("user_id") == user)
    if resource is not None:
        events = events.filter(F.col("resource") == resource)
    chosen = events.filter(F.upper("event_type").isin(*[a.upper() for a in actions]) & F.col("ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    page = chosen.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)
    return page.join(F.broadcast(users) if users.limit(100_001).count() <= 100_000 else users, "user_id", "left")


def histogram(rows: DataFrame, column: str, none: str = "none") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(none)).alias("value")).agg(F.count("*").alias("n"))


def ratio_percent(part: Column, whole: Column) -> Column:
    """Percent with one place, rounded half to even; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole * 100, 1))


def history_window(messages: DataFrame, *, group: str, order: str, roles: list[str], last: int) -> DataFrame:
    """The last messages of the given roles in each conversation, with their place counted from the oldest kept."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    kept = messages.filter(F.col("role").isin(*roles)).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).drop("_n")


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def one_per_key(rows: DataFrame, keys: list[str], order: list[Column | str] | None, last: bool) -> DataFrame:
    """The first or last row of each key by order, then by all columns, so that reruns agree."""
    place = F.struct(*[F.expr(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order or [])], F.to_json(F.struct(*rows.columns)).alias("row"))
    pick = (F.max_by if last else F.min_by)(F.struct(*rows.columns), place)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row")).select("_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """existing with incoming's rows in place of those with the same keys; of several incoming rows with one key the last by order."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(one_per_key(incoming, keys, order, last=True))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """existing and those rows of incoming whose keys it lacks; of several incoming rows with one key the first by order."""
    return existing.unionByName(one_per_key(incoming, keys, order, last=False).join(existing.select(*keys).distinct(), keys, "left_anti"))


def set_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns the old set into the new one: keys and action insert or delete."""
    a, b = old.select(*keys).distinct().withColumn("_old", F.lit(1)), new.select(*keys).distinct().withColumn("_new", F.lit(1))
    both = a.join(b, keys, "full_outer").filter("_old IS NULL OR _new IS NULL")
    return both.select(*keys, F.when(F.col("_old").isNull(), "insert").otherwise("delete").alias("action"))
