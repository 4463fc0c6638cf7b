"""A queue of tasks with leases: in batch by one top-k, as a stream by keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of a lease, and after which a completed task is due again.
LEASE, RECHECK = 300, 86_400


def claim(tasks: DataFrame, worker: str, now: str, limit: int, exhausted: DataFrame | None = None, lease: int = LEASE, recheck: int = RECHECK) -> DataFrame:
    """The tasks that a worker gets at a time, as they then are; at most limit, the most urgent and longest untouched first.

    tasks: id, priority, status, owner, attempts, updated_at, next_due_at, lease_expires_at (timestamps). A task is due without
    a next_due_at or once it has passed, if it is queued or failed, its lease ran out, or it was completed recheck seconds ago.
    exhausted: ids that are worked off: they are among the limit, as their turn came, but are not given out. Ties go by id.
    """
    at = F.lit(now).cast("timestamp")
    back = at - F.make_dt_interval(secs=F.lit(recheck))
    due = F.col("next_due_at").isNull() | (F.col("next_due_at") <= at)
    free = F.col("status").isin("queued", "failed") | ((F.col("status") == "leased") & (F.col("lease_expires_at") <= at)) | ((F.col("status") == "completed") & (F.col("updated_at") <= back))
    top = tasks.where(due & free).orderBy("priority", F.asc_nulls_first("updated_at"), "id").limit(max(0, limit))
    if exhausted is not None:
        top = top.join(exhausted.select("id").distinct(), "id", "left_anti")
    return top.withColumns({
        "status": F.lit("leased"), "owner": F.lit(worker), "attempts": F.coalesce("attempts", F.lit(0)) + 1,
        "updated_at": at, "lease_expires_at": at + F.make_dt_interval(secs=F.lit(lease)),
    })


OUT = "task string, at timestamp, what string, owner string, attempts int"
STATE = "status string, owner string, attempts int, until long"


def leases(events: DataFrame, late: str = "10 seconds", lease: int = LEASE, recheck: int = RECHECK) -> DataFrame:
    """task, at, what, owner, attempts: what becomes of each task of a stream of events (task, at, kind, worker).

    Kinds: add, claim, complete, fail. A claim is granted if the task is free (added, failed, expired or due again), else refused; only its
    owner completes or fails a lease, anyone else's word is ignored. When event time passes the end of a lease it is expired,
    and recheck seconds after its completion a task is due again: both are timers of the task's state, so they survive
    restarts. Events of a task are taken in order of time within a batch; late is the watermark's delay.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, owner, attempts, until = state.get if state.exists else ("none", "", 0, 0)
        out = []

        def tell(at: pd.Timestamp, what: str, who: str) -> None:
            out.append((key[0], at, what, who, attempts))

        def ring(now_ms: int) -> None:
            """The timer, where it has run out."""
            nonlocal status, owner, until
            if until and until <= now_ms:
                at = pd.Timestamp(until, unit="ms")
                tell(at, "expired" if status == "leased" else "due", owner)
                status, owner, until = "free", "", 0

        if state.hasTimedOut:
            ring(state.getCurrentWatermarkMs())
        else:
            events = pd.concat(list(batches)).sort_values("at", kind="stable")
            for at, kind, worker in zip(events["at"], events["kind"], events["worker"], strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                ring(ms)
                if kind == "add" and status == "none":
                    status = "free"
                    tell(at, "added", "")
                elif kind == "claim" and status == "free":
                    status, owner, attempts, until = "leased", worker, attempts + 1, ms + lease * 1000
                    tell(at, "claimed", worker)
                elif kind == "claim":
                    tell(at, "refused", worker)
                elif status == "leased" and owner == worker and kind in ("complete", "fail"):
                    status, until = ("completed", ms + recheck * 1000) if kind == "complete" else ("free", 0)
                    tell(at, "completed" if kind == "complete" else "failed", worker)
                    owner = worker if status == "completed" else ""
        state.update((status, owner, attempts, until))
        if until:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task", "at", "what", "owner", "attempts"]).astype({"attempts": "int32", "at": "datetime64[ns]"})

    rows = events.withWatermark("at", late).select("task", "at", "kind", F.coalesce("worker", F.lit("")).alias("worker"))
    return rows.groupBy("task").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
