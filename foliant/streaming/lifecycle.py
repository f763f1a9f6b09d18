"""Job life cycles and circuit breakers as stateful streams with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.jobs import TRANSITIONS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of the first wait and of the longest, failures in a row that open a breaker and seconds that it stays open.
FIRST_WAIT, LONGEST_WAIT, FAILURES, COOLDOWN = 5, 300, 5, 60
STEPS = "job_id long, ts timestamp, before string, status string, attempts int, accepted boolean"
CALLS = "provider string, call_id long, ts timestamp, admitted boolean, opened boolean"
TARGET = {"start": "PROCESSING", "succeed": "COMPLETED"}


def ordered(frames: Iterator[pd.DataFrame], *by: str) -> list[dict]:
    """One key's rows of a batch in order; a trigger bounds how many there are."""
    return pd.concat(list(frames)).sort_values(list(by)).to_dict("records")


def micros(ts: pd.Timestamp) -> int:
    return int(ts.value // 1000)


class JobProcessor(StatefulProcessor):
    """A job's status, attempts and the time in milliseconds that it waits for: after a failed attempt its backoff, and at the end `keep` seconds, after which it is forgotten."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, until long")

    def close(self) -> None:
        pass

    def row(self, key, ts, before, status, attempts, accepted) -> dict:
        return {"job_id": key, "ts": ts, "before": before, "status": status, "attempts": attempts, "accepted": accepted}

    def handleInputRows(self, key, rows, timerValues):
        held = self.job.get() if self.job.exists() else None
        status, attempts, until = held[:3] if held else (None, 0, 0)
        out = []
        for r in ordered(rows, "ts", "event_id"):
            if status is None and r["kind"] == "submit":
                step, after = "PENDING", attempts
            else:
                final = r["deterministic"] or attempts >= r["max_attempts"]
                step = TARGET.get(r["kind"]) or ("FAILED" if final else "RETRYING") if r["kind"] != "submit" else None
                after = attempts + 1 if step == "PROCESSING" else attempts
                if status is None or step not in TRANSITIONS.get(status, []):
                    out.append(self.row(key[0], r["ts"], status, status, attempts, False))
                    continue
            out.append(self.row(key[0], r["ts"], status, step, after, True))
            status, attempts = step, after
            wait = min(FIRST_WAIT * 2 ** (attempts - 1), LONGEST_WAIT) if status == "RETRYING" else self.keep if status not in TRANSITIONS else None
            if wait is not None:
                until = micros(r["ts"]) // 1000 + 1000 * wait
                self.handle.registerTimer(until)
        if status is not None:
            self.job.update((status, attempts, until))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, attempts, until = self.job.get()[:3] if self.job.exists() else (None, 0, at + 1)
        if at < until:  # of an earlier attempt
            return
        if status == "RETRYING":  # the wait is over: the job may be taken again
            self.job.update(("PENDING", attempts, until))
            ts = pd.Timestamp(at, unit="ms")
            yield pd.DataFrame([self.row(key[0], ts, "RETRYING", "PENDING", attempts, True)])
        elif status not in TRANSITIONS:
            self.job.clear()


def job_steps(events: DataFrame, *, late: str = "10 seconds", keep: int = 3600) -> DataFrame:
    """Every step of every job: job_id, ts, before, status, attempts, accepted (false: the step is not allowed and changes nothing).

    events: job_id, event_id, ts, kind (submit, start, succeed, fail), deterministic, max_attempts. A failed attempt is RETRYING until its backoff has passed by the
    watermark, then PENDING again; it is FAILED at once if the error is deterministic or the attempts are used up.
    """
    rows = events.withWatermark("ts", late).select("job_id", "event_id", "ts", "kind", "deterministic", "max_attempts")
    return rows.groupBy("job_id").transformWithStateInPandas(JobProcessor(keep), STEPS, "append", "eventTime")


class BreakerProcessor(StatefulProcessor):
    """Failures in a row and until when the breaker is open, in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.breaker = handle.getValueState("breaker", "failures int, open_until long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        failures, until = self.breaker.get()[:2] if self.breaker.exists() else (0, 0)
        out = []
        for r in ordered(rows, "ts", "call_id"):
            at = micros(r["ts"])
            admitted, opened = at >= until, False
            if admitted:
                failures = failures + 1 if r["failed"] else 0
                opened = failures >= FAILURES
                until = at + COOLDOWN * 1_000_000 if opened else 0
            out.append({"provider": key[0], "call_id": r["call_id"], "ts": r["ts"], "admitted": admitted, "opened": opened})
        if failures:
            self.breaker.update((failures, until))
        else:
            self.breaker.clear()  # a sound provider needs no state
        if out:
            yield pd.DataFrame(out)


def breaker_calls(calls: DataFrame, *, late: str = "10 seconds") -> DataFrame:
    """provider, call_id, ts, admitted and opened of calls (provider, call_id, ts, failed): five failures in a row open the breaker, which turns calls away for a minute."""
    rows = calls.withWatermark("ts", late).select("provider", "call_id", "ts", "failed")
    return rows.groupBy("provider").transformWithStateInPandas(BreakerProcessor(), CALLS, "append", "eventTime")
