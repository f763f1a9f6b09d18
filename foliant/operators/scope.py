"""Who may read what, and which version counts when."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE_GRANTS = ("read", "write", "admin")


def live_grants(grants: DataFrame, user: int, now: str) -> DataFrame:
    """document_id of the user's grants that have not expired."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))
    return grants.filter((F.col("user_id") == user) & F.col("permission").isin(*LIVE_GRANTS) & alive).select("document_id").distinct()


def active(documents: DataFrame, org: int) -> DataFrame:
    return documents.filter((F.col("org") == org) & F.col("deleted_at").isNull() & (F.col("status") == "active"))


def readable(documents: DataFrame, grants: DataFrame, org: int, user: int, now: str) -> DataFrame:
    """Documents retrieval may use: open ones, own ones, and restricted ones with a live grant; unknown levels never."""
    granted = live_grants(grants, user, now).withColumn("granted", F.lit(True))
    docs = active(documents, org).join(granted, F.col("id") == F.col("document_id"), "left")
    own, granted = F.col("owner") == user, F.coalesce("granted", F.lit(False))
    ok = F.when(F.col("access") == "organization", True).when(F.col("access") == "private", own).when(F.col("access") == "restricted", own | granted).otherwise(False)
    return docs.filter(ok).select(documents.columns)


def chat_scope(documents: DataFrame, org: int, user: int) -> DataFrame:
    """Documents a chat may name: open or own; grants play no part here."""
    return active(documents, org).filter((F.col("access") == "organization") | (F.col("owner") == user))


def visible_conflicts(statements: DataFrame, documents: DataFrame, user: int) -> DataFrame:
    """conflict_id of conflicts none of whose statements is in another user's private document."""
    hidden = documents.filter((F.col("access") == "private") & (F.col("owner") != user)).select(F.col("id").alias("document_id"))
    return statements.select("conflict_id").distinct().join(statements.join(hidden, "document_id", "left_semi").select("conflict_id").distinct(), "conflict_id", "left_anti")


def metadata_filter(documents: DataFrame, *, types: list[str] | None = None, owner: int | None = None, members: DataFrame | None = None, status: str | None = None, access: str | None = None, name: str | None = None) -> DataFrame:
    """All given filters; members (document_id) tests membership without multiplying rows, name is looked for anywhere in the name, whatever the case."""
    if types:
        documents = documents.filter(F.col("type").isin(*types))
    for column, value in (("owner", owner), ("status", status), ("access", access)):
        if value is not None:
            documents = documents.filter(F.col(column) == value)
    if name:
        documents = documents.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    return documents if members is None else documents.join(members, documents["id"] == members["document_id"], "left_semi")



def permission_keys(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """user_id and the sorted union of the permission keys of its roles."""
    return user_roles.join(role_permissions, "role").groupBy("user_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))


def effective_order() -> list[Column]:
    return [F.desc_nulls_last("effective_date"), F.desc("version_number")]


def as_of(versions: DataFrame, day: date) -> DataFrame:
    """The READY version of each document in force on the day: effective by then (null: always), expiry exclusive, latest first."""
    d = F.lit(day)
    open_ = (F.col("effective_date").isNull() | (F.col("effective_date") <= d)) & (F.col("expiration_date").isNull() | (F.col("expiration_date") > d))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(*effective_order()))
    return versions.filter((F.col("status") == "READY") & open_).withColumn("_n", rank).filter("_n = 1").drop("_n")


def with_state(versions: DataFrame, day: date) -> DataFrame:
    """Adds state: CURRENT for the version in force, SCHEDULED for later ones, else SUPERSEDED."""
    current = as_of(versions, day).select("id").withColumn("_current", F.lit(True))
    state = F.when(F.col("_current"), "CURRENT").when(F.col("effective_date") > F.lit(day), "SCHEDULED").otherwise("SUPERSEDED")
    return versions.join(current, "id", "left").withColumn("state", state).drop("_current")


def latest_version(versions: DataFrame) -> DataFrame:
    """The highest version number of each document, in force or not."""
    return versions.groupBy("document_id").agg(F.max_by("id", "version_number").alias("id"), F.max("version_number").alias("version_number"))
