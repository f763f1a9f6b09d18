"""Status changes and duplicate-free job pointers as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key long, id long, status string, previous string"


#: Statuses after which nothing more comes of a key.
FINAL = ("COMPLETED", "FAILED", "READY")


def status_changes(states: DataFrame, final: tuple[str, ...] = FINAL) -> DataFrame:
    """First status of each key and then only those that differ (key, id, status). State is the last status, until it is final; a batch is taken in order of id."""

    def differ(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("id")
        before = rows["status"].shift(1)
        before.iloc[0] = last
        out = rows.assign(previous=before)
        if len(rows) and rows["status"].iloc[-1] in final:
            if state.exists:
                state.remove()
        elif len(rows):
            state.update((rows["status"].iloc[-1],))
        changed = out["previous"].isna() | (out["previous"] != out["status"])
        yield out.loc[changed, ["key", "id", "status", "previous"]]

    return states.select("key", "id", "status").groupBy("key").applyInPandasWithState(differ, CHANGES, "status string", "append", GroupStateTimeout.NoTimeout)


def claim_once(pointers: DataFrame, *, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """The first pointer of each job; repeats within the watermark are dropped and the state behind it is forgotten."""
    return pointers.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, *, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by type in tumbling windows, an extension for dashboards."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
