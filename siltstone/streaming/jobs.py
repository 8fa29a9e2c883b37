"""The life of jobs as a stream: claims, heartbeats, retries, cancellations, leases that run out.

Every change of a job comes out as a transition, and so does every request that its state forbids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from siltstone.streaming.ordered import InTimeOrder, in_time_order

SECOND = 1_000_000
FINAL = ("COMPLETED", "FAILED", "CANCELLED")
TRANSITION = "job bigint, at_us bigint, code string, old_status string, new_status string, attempt int, event_id bigint"


@dataclass(frozen=True)
class Policy:
    """Seconds of a lease, of the first wait before a retry (doubled each time) and of the longest; attempts in all."""

    lease: int = 60
    wait: int = 15
    longest_wait: int = 300
    stale_wait: int = 0
    attempts: int = 3

    def retry_at(self, now: int, attempt: int) -> int:
        return now + min(self.longest_wait, self.wait * 2**attempt) * SECOND


class JobMachine(InTimeOrder):
    """Rows are (time, event_id, kind, worker); a job is queued by its first row, whatever that is.

    Kinds: CLAIM, HEARTBEAT, COMPLETE, FAIL and RETRY of a worker, CANCEL of anybody, CREATE of a new job.
    Only the worker that holds a job may report on it.  A lease that runs out sends the job back to the
    queue, or ends it if it was to be cancelled or has no attempts left.
    """

    columns = ("us", "event_id", "kind", "worker")
    out = ("job", "at_us", "code", "old_status", "new_status", "attempt", "event_id")

    def __init__(self, policy: Policy):
        self.policy = policy

    def start(self) -> dict:
        return {"status": None, "attempt": 0, "worker": None, "lease": None, "wait": None, "cancel": False}

    def due(self, state: dict) -> int | None:
        return state["lease"] if state["status"] == "RUNNING" else state["wait"] if state["status"] == "QUEUED" else None

    def _move(self, state: dict, at: int, code: str, status: str, event: int | None, **more) -> list[tuple]:
        old = state["status"]
        state |= {"status": status, "worker": None, "lease": None, "wait": None} | more
        return [(at, code, old, status, state["attempt"], event)]

    def _same(self, state: dict, at: int, code: str, event: int) -> list[tuple]:
        return [(at, code, state["status"], state["status"], state["attempt"], event)]

    def _again(self, state: dict, at: int, event: int | None, code: str, failure: str, wait: int) -> list[tuple]:
        """Back to the queue, unless the job is to be cancelled or has had all its attempts."""
        if state["cancel"]:
            return self._move(state, at, "JOB_CANCELLED", "CANCELLED", event)
        if state["attempt"] >= self.policy.attempts:
            return self._move(state, at, failure, "FAILED", event)
        return self._move(state, at, code, "QUEUED", event, wait=wait if wait > at else None)

    def on_due(self, state: dict, at: int) -> list[tuple]:
        if state["status"] == "RUNNING":
            return self._again(state, at, None, "STALE_JOB_REQUEUED", "WORKER_LEASE_EXPIRED", at + self.policy.stale_wait * SECOND)
        state["wait"] = None
        return [(at, "RETRY_DUE", "QUEUED", "QUEUED", state["attempt"], None)]

    def on_row(self, state: dict, row: list) -> list[tuple]:
        at, event, kind, worker = row
        out = self._move(state, at, "JOB_CREATED", "QUEUED", event) if state["status"] is None else []
        if kind == "CREATE" and out:
            return out
        status, holds = state["status"], state["status"] == "RUNNING" and state["worker"] == worker
        if kind == "CANCEL":
            if status == "CANCELLED":
                return out
            if status == "QUEUED":
                return out + self._move(state, at, "JOB_CANCELLED", "CANCELLED", event)
            if status == "RUNNING":
                state["cancel"] = True
                return out + self._same(state, at, "CANCELLATION_REQUESTED", event)
        elif kind == "CLAIM" and status == "QUEUED" and state["wait"] is None and state["attempt"] < self.policy.attempts:
            state["attempt"] += 1
            return out + self._move(state, at, "JOB_CLAIMED", "RUNNING", event, worker=worker, lease=at + self.policy.lease * SECOND)
        elif kind == "HEARTBEAT" and holds:
            state["lease"] = max(state["lease"], at + self.policy.lease * SECOND)
            return out
        elif kind == "COMPLETE" and holds:
            return out + self._move(state, at, "JOB_COMPLETED", "COMPLETED", event)
        elif kind == "FAIL" and holds:
            return out + self._move(state, at, "JOB_FAILED", "FAILED", event)
        elif kind == "RETRY" and holds:
            return out + self._again(state, at, event, "RETRY_SCHEDULED", "MAX_ATTEMPTS_EXCEEDED", self.policy.retry_at(at, state["attempt"]))
        return out + self._same(state, at, f"ILLEGAL_{kind}", event)


def job_transitions(events: DataFrame, policy: Policy, lateness: str = "2 days") -> DataFrame:
    """TRANSITION rows of a stream of events (job, ts, event_id, kind, worker), in event time.

    A transition comes out once the watermark has passed it.  Requests that the job's state forbids
    come out as ILLEGAL_ and their kind and change nothing; heartbeats only prolong a lease.
    """
    return in_time_order(events, "ts", "job", JobMachine(policy), TRANSITION, lateness)
