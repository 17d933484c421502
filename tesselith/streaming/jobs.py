"""Job states from a log of events: allowed transitions, jobs that stop, late events. A stream with keyed state and timers, and a batch that gives the same states."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Which states an event leads to from which: a job begins queued, and ends completed or failed.
NEXT = {"": ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed")}
STATES = "job_id long, status string, reason string, changed_us long, applied long, rejected long"


def job_states(events: DataFrame, limit_s: int, as_of: str) -> DataFrame:
    """(job_id, status, reason, changed_at, applied, rejected) of events (job_id, ts, event_id, status), in the order of (ts, event_id).

    Events that don't lead on from a job's state are rejected, as are all after its end. A job without an allowed event for more than limit_s seconds has failed then, as stalled. A job that was
    never queued is unknown. Three rounds of minima, each combined in the tasks: a job's events are never gathered or sorted, however many it has.
    """
    e = events.where("job_id is not null and ts is not null").select("job_id", F.struct("ts", "event_id", "status").alias("k"))
    late = lambda c: c["ts"] + F.make_dt_interval(secs=F.lit(limit_s))
    first = e.where(F.col("k.status") == "queued").groupBy("job_id").agg(F.min("k").alias("a"))

    def after(states: DataFrame, last: str, kinds: tuple[str, ...], name: str) -> DataFrame:
        order = lambda c: F.struct(c["ts"], c["event_id"])
        x = e.where(F.col("k.status").isin(*kinds)).join(states.select("job_id", last), "job_id")
        x = x.where((order(F.col("k")) > order(F.col(last))) & (F.col("k.ts") <= late(F.col(last))))
        return states.join(x.groupBy("job_id").agg(F.min("k").alias(name)), "job_id", "left")

    two = after(first, "a", NEXT["queued"], "b")
    running = two.where(F.col("b.status") == "running")
    three = two.join(after(running, "b", NEXT["running"], "c").select("job_id", "c"), "job_id", "left")
    last = F.coalesce("c", "b", "a")
    d = e.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).join(three.withColumn("last", last), "job_id", "left")
    open_ = F.col("last.status").isin(*[s for s in NEXT if s])
    stalled = open_ & (late(F.col("last")) < F.lit(as_of).cast("timestamp"))
    applied = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in "abc").cast("long")
    return d.select(
        "job_id", F.when(F.col("last").isNull(), "unknown").when(stalled, "failed").otherwise(F.col("last.status")).alias("status"), F.when(stalled, "stalled").otherwise("").alias("reason"),
        F.when(stalled, late(F.col("last"))).otherwise(F.col("last.ts")).alias("changed_at"), applied.alias("applied"), (F.col("n") - applied).alias("rejected"),
    )


def step(state: tuple, ts: int, event_id: int, status: str, limit_s: int) -> tuple:
    """The state (status, reason, time of the last allowed event in microseconds, its event_id, applied, rejected) after an event."""
    now, reason, last, last_id, applied, rejected = state
    if now in NEXT and now and ts > last + limit_s * 1_000_000:
        now, reason, last = "failed", "stalled", last + limit_s * 1_000_000
    if status in NEXT.get(now, ()) and (not now or (ts, event_id) > (last, last_id)):
        return status, "", ts, event_id, applied + 1, rejected
    return now, reason, last, last_id, applied, rejected + 1


class JobProcessor(StatefulProcessor):
    """A job's state as one value; a timer stands where the job will have stalled. An event before the last allowed one is late, and rejected."""

    def __init__(self, limit_s: int):
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, reason string, us long, event_id long, applied long, rejected long")

    def _kept(self, key, state: tuple) -> Row:
        self.state.update(state)
        status, reason, us, _, applied, rejected = state
        return Row(job_id=key[0], status=status or "unknown", reason=reason, changed_us=us, applied=applied, rejected=rejected)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else ("", "", None, 0, 0, 0)
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            state = step(state, r.us, r.event_id, r.status, self.limit_s)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        if state[0] in NEXT and state[0]:
            self.handle.registerTimer(state[2] // 1000 + self.limit_s * 1000 + 1)
        yield self._kept(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, _, us, event_id, applied, rejected = tuple(self.state.get())
        if status in NEXT and status:
            yield self._kept(key, ("failed", "stalled", us + self.limit_s * 1_000_000, event_id, applied, rejected))

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, limit_s: int, late: str = "1 hour") -> DataFrame:
    """A stream of job states as they change, of a stream of events (job_id, ts, event_id, status): a job's last row is its state.

    Needs the RocksDB state store. State comes back from the checkpoint after a restart; jobs that stop are failed once the watermark (`late` behind the newest event) has passed their limit.
    """
    d = events.where("job_id is not null and ts is not null").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    out = d.groupBy("job_id").transformWithState(JobProcessor(limit_s), STATES, "Update", "EventTime")
    return out.select("job_id", "status", "reason", F.timestamp_micros("changed_us").alias("changed_at"), "applied", "rejected")
