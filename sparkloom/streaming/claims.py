"""Review claims: an idempotent queue with leases, retries, deferrals and dead letters, as keyed state.

``step`` is the whole state machine, a pure function; ``timed`` folds it over the events of a key and fires what falls due between
them. ``replayed`` does so over a table, ``claim_stream`` over a stream, with the same rows as result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LEASE, MAX_ATTEMPTS, EXPIRY, GRACE = 1200.0, 5, 1800.0, 60.0
KEEP = 30 * 86400.0
CLAIMABLE = ("queued", "expired", "abandoned")
REOPENABLE = ("skipped_closed", "superseded")
TERMINAL = ("completed_with_findings", "completed_no_findings", "general_analysis_only", "partial_request_limit")
FIELDS = ["status", "task_id", "lease_owner", "lease_until", "attempts", "dispatches", "dispatched_at", "payload", "error", "deferrals", "deferred_since", "resume_at", "clock"]
STATE = "status string, task_id string, lease_owner string, lease_until double, attempts long, dispatches long, dispatched_at double, payload string, error string, deferrals long, deferred_since double, resume_at double, clock double"
EVENT = ["at", "action", "task_id", "worker", "value", "allow_reclaim", "redelivered"]
EVENT_STATE = "at double, seq long, action string, task_id string, worker string, value string, allow_reclaim boolean, redelivered boolean"
RESULT = ["seq", "at", "action", "result", "status", "attempts", "dead_letter"]
OUT = "at double, action string, result string, status string, attempts long, dead_letter string"
LEASE_LOST = "its lease ran out on the last attempt"
NEVER_TAKEN = "no worker took the claim though it was sent the most times allowed"
BUDGET_SPENT = "the provider's rate limit outlasted the budget for waiting"


def recovery_delay(attempts: int) -> float:
    return min(30.0 * 2 ** max(0, attempts - 1), 1800.0)


def _queued(at: float) -> dict:
    return dict.fromkeys(FIELDS) | {"status": "queued", "attempts": 0, "dispatches": 1, "dispatched_at": at, "deferrals": 0}


def step(s: dict | None, e: dict) -> tuple[dict | None, str, str | None]:
    """(state, result, dead letter) after event ``e`` at time e["at"] in seconds.

    claim: the first wins; only closed and superseded claims may be taken again, and only if e["allow_reclaim"].
    acquire: a lease on a claimable or run-out claim, or for the same task delivered again, while attempts last.
    checkpoint, assert, finish, retry, fail, close, supersede: refused unless the worker holds the lease.
    unpublished: a queued claim is due at once. requeue: an operator resets a failed claim. tick: see ``reconciled``.
    defer: the worker gives the claim back for e["value"] seconds, while the budgets last (``deferral``); else it fails.
    """
    action, at = e["action"], e["at"]
    if action == "claim":
        if s is None or e.get("allow_reclaim") and s["status"] in REOPENABLE:
            return _queued(at), "queued", None
        return s, "duplicate_skipped", None
    if s is None:
        return None, "unknown", None
    if action == "tick":
        return reconciled(s, at)
    if action == "acquire":
        out = s["status"] == "processing" and (s["lease_until"] <= at or bool(e.get("redelivered")) and s["task_id"] == e.get("task_id"))
        if (s["status"] in CLAIMABLE or out) and s["attempts"] < MAX_ATTEMPTS:
            return s | {"status": "processing", "task_id": e.get("task_id"), "lease_owner": e.get("worker"), "lease_until": at + LEASE, "attempts": s["attempts"] + 1, "error": None, "resume_at": None}, "acquired", None
        return s, "refused", None
    if action == "unpublished":
        return (s | {"dispatched_at": None}, "released", None) if s["status"] == "queued" and s["lease_owner"] is None else (s, "refused", None)
    if action == "requeue":
        return (_queued(at) | {"dispatches": 0, "dispatched_at": None}, "requeued", None) if s["status"] == "failed" else (s, "refused", None)
    if s["status"] != "processing" or action not in ("close", "supersede") and s["lease_owner"] != e.get("worker"):
        return s, "fenced", None
    free = s | {"task_id": None, "lease_owner": None, "lease_until": None}
    if action == "checkpoint":
        return s | {"payload": e.get("value")}, "saved", None
    if action == "assert":
        return s, "held" if s["lease_until"] > at else "fenced", None
    if action == "finish":
        return free | {"status": e.get("value") if e.get("value") in TERMINAL else TERMINAL[0], "error": None}, "finished", None
    if action == "retry":
        return free | {"status": "queued", "dispatched_at": at}, "released", None
    if action == "fail":
        error = (e.get("value") or "")[:2000]
        return free | {"status": "failed", "error": error}, "failed", error
    if action == "defer":
        wait, since = _seconds(e.get("value")), at if s["deferred_since"] is None else s["deferred_since"]
        if not deferral(s["deferrals"], at - since, wait, s["attempts"]):
            return free | {"status": "failed", "error": BUDGET_SPENT}, "failed", BUDGET_SPENT
        return free | {"status": "queued", "dispatched_at": at, "deferrals": s["deferrals"] + 1, "deferred_since": since, "resume_at": at + max(1.0, math.ceil(wait))}, "deferred", None
    if action in ("close", "supersede"):
        return free | {"status": "skipped_closed" if action == "close" else "superseded", "error": None}, "released", None
    return s, "unknown", None


def reconciled(s: dict, at: float) -> tuple[dict, str, str | None]:
    """The repair of a claim at a time: a lease that ran out is abandoned or fails, a claim that is due is sent again or fails, one
    whose deferral is over is resumed."""
    if s["status"] == "processing" and s["lease_until"] <= at:
        free = s | {"task_id": None, "lease_owner": None, "lease_until": None}
        if s["attempts"] >= MAX_ATTEMPTS:
            return free | {"status": "failed", "error": LEASE_LOST}, "failed", LEASE_LOST
        return free | {"status": "abandoned", "error": "the worker's lease ran out; another may take the claim", "dispatched_at": at - EXPIRY - GRACE + recovery_delay(s["attempts"])}, "abandoned", None
    if s["status"] in CLAIMABLE and (s["dispatched_at"] is None or s["dispatched_at"] + EXPIRY + GRACE <= at):
        if s["attempts"] >= MAX_ATTEMPTS or s["dispatches"] >= MAX_ATTEMPTS:
            return s | {"status": "failed", "error": NEVER_TAKEN}, "failed", NEVER_TAKEN
        expired = s["status"] == "queued" and s["dispatched_at"] is not None
        again = {"status": "expired", "error": "the message expired before any worker took the claim"} if expired else {}
        return s | again | {"dispatched_at": at, "dispatches": s["dispatches"] + 1}, "dispatched", None
    if s["status"] in CLAIMABLE and s["resume_at"] is not None and s["resume_at"] <= at:
        return s | {"resume_at": None}, "resumed", None
    return s, "idle", None


def wake(s: dict, keep: float | None = None) -> float | None:
    """When a claim next needs a repair, or (``keep`` seconds after its last event) may be forgotten as it is at rest."""
    if s["status"] == "processing":
        due = s["lease_until"]
    elif s["status"] in CLAIMABLE:
        due = s["clock"] if s["dispatched_at"] is None else s["dispatched_at"] + EXPIRY + GRACE
        due = due if s["resume_at"] is None else min(due, s["resume_at"])
    elif keep is None:
        return None
    else:
        due = s["clock"] + keep
    return max(due, s["clock"])


def timed(state: dict | None, events: Iterable[dict], until: float | None, keep: float | None = None) -> Iterator[tuple[dict | None, tuple]]:
    """The state and the result row after each of a key's ``events``, in order, and after each timer that is due before it or, behind
    the last one, up to ``until``. Timers fire at the time they are set to; without ``until`` none does."""

    def row(seq, at, action, result, dead):
        return state, (seq, at, action, result, state and state["status"], state and state["attempts"], dead)

    for e in [*events, None]:
        end = until if e is None or until is None else min(e["at"], until)
        while until is not None and state is not None and (at := wake(state, keep)) is not None and at <= end:
            if state["status"] == "processing" or state["status"] in CLAIMABLE:
                state, result, dead = reconciled(state, at)
                state = state | {"clock": at}
            else:
                state, result, dead = None, "forgotten", None
            yield row(None, at, "timer", result, dead)
        if e is not None:
            state, result, dead = step(state, e)
            state = state and state | {"clock": e["at"] if state["clock"] is None else max(e["at"], state["clock"])}
            yield row(e.get("seq"), e["at"], e["action"], result, dead)


def deferral(attempt: int, elapsed: float, wait: float, claim_attempt: int, max_attempts: int = 3, max_elapsed: float = 3600.0) -> bool:
    """Whether a rate-limited review may wait once more within its budgets."""
    return attempt < max_attempts and elapsed + wait <= max_elapsed and claim_attempt < MAX_ATTEMPTS


def _seconds(value: str | None) -> float:
    """A wait as a worker gives it; none if it is not a number."""
    try:
        wait = float(value or 0)
    except ValueError:
        return 0.0
    return wait if 0 < wait < math.inf else 0.0


def _plain(row: dict) -> dict:
    return {k: (None if v is None or v != v else v) for k, v in row.items()}


def replayed(events: DataFrame, key: str, until: float | None = None, keep: float | None = None) -> DataFrame:
    """What became of each event (key, seq, at, action, ...) in order: result, status, attempts, dead_letter.

    With ``until`` also what timers did up to then, as rows without seq whose action is "timer"; with ``keep`` claims at rest
    are forgotten after as many seconds. One shuffle by key and one sort; a task then folds its sorted rows as they pass and holds the
    state of one key, so neither many keys nor one with a long history takes memory. Keys that are null are one claim.
    """
    kinds = dict(events.dtypes)
    kept = [key, "seq", *(c for c in EVENT if c in events.columns)]
    schema = f"{key} {kinds[key]}, seq {kinds['seq']}, {OUT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun, out, fixed = None, None, False, [], None

        def fold(events: list[dict], end: float | None) -> None:
            nonlocal state
            for state, row in timed(state, events, end, keep):
                out.append((last, *row))

        def full() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fixed)], names=[key, *RESULT])

        for batch in batches:
            fixed = [batch.schema.field(0).type, batch.schema.field(1).type, pa.float64(), *[pa.string()] * 3, pa.int64(), pa.string()]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or row[0] != last:
                    if begun:
                        fold([], until)
                    last, state, begun = row[0], None, True
                e = _plain(dict(zip(kept, row)))
                fold([e], None if until is None else min(e["at"], until))
                if len(out) >= 10_000:
                    yield full()
        if begun:
            fold([], until)
            yield full()

    return events.select(*kept).repartition(key).sortWithinPartitions(key, "at", "seq").mapInArrow(run, schema)


class ClaimProcessor(StatefulProcessor):
    """A claim's state, its events that wait for their turn, and a timer for whichever comes next.

    By event time, events wait until the watermark passes them and are then taken in order, with the timers due between them: the rows
    are those of ``replayed`` up to the watermark, however the events arrive. A claim at rest is forgotten by a timer. By processing
    time, events are taken as they arrive and timers go by the clock; the state has a time to live, which each event renews.
    """

    def __init__(self, key: str, keep: float, event_time: bool):
        self.key, self.keep, self.event_time = key, keep, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", STATE, None if self.event_time else int(self.keep * 1000))
        self.waiting = handle.getListState("waiting", EVENT_STATE) if self.event_time else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = [_plain(dict(zip(part.columns, e))) for part in rows for e in zip(*(part[c].tolist() for c in part.columns))]
        if not self.event_time:
            yield self.taken(key, sorted(events, key=lambda e: (e["at"], e["seq"])), timerValues.getCurrentProcessingTimeInMs())
            return
        self.waiting.appendList([(e["at"], e["seq"], *(e.get(c) for c in EVENT[1:])) for e in events])
        self.handle.registerTimer(math.ceil(min(e["at"] for e in events) * 1000))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        events = []
        if self.event_time:
            waiting = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
            due = sum(e[0] <= now / 1000 for e in waiting)
            events = [_plain(dict(zip(("at", "seq", *EVENT[1:]), e))) for e in waiting[:due]]
            if due:
                self.waiting.clear() if due == len(waiting) else self.waiting.put(waiting[due:])
            if due < len(waiting):
                self.handle.registerTimer(math.ceil(waiting[due][0] * 1000))
        yield self.taken(key, events, now)

    def taken(self, key, events: list[dict], now_ms: int) -> pd.DataFrame:
        held, out = self.claim.get(), []
        state = dict(zip(FIELDS, held)) if held else None
        for state, row in timed(state and _plain(state), events, now_ms / 1000, self.keep if self.event_time else None):
            out.append((key[0], *row))
        if state is None:
            self.claim.clear()
        elif out:
            self.claim.update(tuple(state[f] for f in FIELDS))
            due = wake(state, self.keep if self.event_time else None)
            if due is not None:
                self.handle.registerTimer(max(math.ceil(due * 1000), now_ms + 1))
        return pd.DataFrame(out, columns=[self.key, *RESULT], dtype=object)

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame, key: str, watermark: str | None = "30 minutes", keep: float = KEEP) -> DataFrame:
    """The same over a stream (key, seq, at, action, ..., and the event time ``ts``): state a key and timers, in RocksDB.

    Leases that run out, messages that expire, deferrals that end and the dead letters that follow come from timers. Events later than
    the watermark are dropped, as messages expire. Without a ``watermark`` the clock counts instead (``ClaimProcessor``); such a query
    looks again at each trigger, so it has to be stopped, not drained. Start either with ``rocksdb``'s settings.
    """
    kind = dict(events.dtypes)[key]
    kept = [key, "seq", *(c for c in EVENT if c in events.columns), *(["ts"] if watermark else [])]
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.select(*kept).groupBy(key).transformWithStateInPandas(ClaimProcessor(key, keep, bool(watermark)), f"{key} {kind}, seq long, {OUT}", "Append", "EventTime" if watermark else "ProcessingTime")


def first_claims(events: DataFrame, by: list[str], ts: str, watermark: str = "30 minutes") -> DataFrame:
    """The simple case on a stream: the first event of each key within the watermark."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(by)


def dead_letter_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("dead_letter is not null").withColumn("error", F.substring("dead_letter", 1, 2000)).drop("dead_letter")
