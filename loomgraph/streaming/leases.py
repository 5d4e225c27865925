"""Leases on work items as a stateful stream: claims are fenced by owner, heartbeats extend them, event-time timers give them back, ended items leave no state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE_MS = 60_000
MAX_ATTEMPTS = 3
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "item_id long, at timestamp, status string, owner string, attempts long, rejected long"


def lease_states(events: DataFrame, lease_ms: int = LEASE_MS, max_attempts: int = MAX_ATTEMPTS, lateness: str = "10 seconds") -> DataFrame:
    """(item_id, at, status, owner, attempts, rejected) each time that an item's status changes.

    events: item_id, owner, action (claim, heartbeat, ack or fail), ts and event_id. A claim holds if nobody else's lease is
    running; heartbeats, acks and failures count from the owner of a running lease only, others are counted as rejected. A lease
    that the watermark passes is given back (retrying), a failure too, until `max_attempts` claims are used up (dead_letter). An item that
    is acked or dead ends: its row is given and its state and timer removed. A later claim begins it anew.
    """

    class Leases(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.lease = handle.getValueState("lease", "status string, owner string, until_ms long, attempts long, rejected long")

        def _now(self) -> list:
            return list(self.lease.get()) if self.lease.exists() else ["pending", None, 0, 0, 0]

        def _timer(self, old: int, new: int) -> None:
            if old != new:
                if old:
                    self.handle.deleteTimer(old)
                if new:
                    self.handle.registerTimer(new)

        def _given_back(self, state: list) -> None:
            state[0] = "dead_letter" if state[3] >= max_attempts else "retrying"

        def _keep(self, key: tuple, state: list, old: int, rows: list) -> pd.DataFrame:
            over = state[0] in ("succeeded", "dead_letter")
            if state[0] != "claimed":
                state[2] = 0
            self._timer(old, state[2])
            if over:
                self.lease.clear()
            else:
                self.lease.update(tuple(state))
            return pd.DataFrame([(key[0], *r) for r in rows], columns=["item_id", "at", "status", "owner", "attempts", "rejected"])

        def _step(self, state: list, action: str, owner: str, ms: int) -> bool:
            """Applies one event; tells whether the status or the owner changed."""
            if state[0] == "claimed" and ms > state[2]:
                self._given_back(state)  # time is up, whether or not the timer has fired
            before = tuple(state[:2])
            holds = state[0] == "claimed" and state[1] == owner
            if action == "claim" and state[0] in ("pending", "retrying", "succeeded", "dead_letter"):
                state[3] = 1 if state[0] in ("succeeded", "dead_letter") else state[3] + 1
                state[0], state[1], state[2] = "claimed", owner, ms + lease_ms
            elif action in ("heartbeat", "claim") and holds:
                state[2] = max(state[2], ms + lease_ms)
            elif action == "ack" and holds:
                state[0] = "succeeded"
            elif action == "fail" and holds:
                self._given_back(state)
            else:
                state[4] += 1
            return before != tuple(state[:2])

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state, out = self._now(), []
            old = state[2] if state[0] == "claimed" else 0
            got = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            for e in got.itertuples():
                if self._step(state, e.action, e.owner, int(pd.Timestamp(e.ts).value // 1_000_000)):
                    out.append((e.ts, state[0], state[1], state[3], state[4]))
            yield self._keep(key, state, old, out)

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            state, at = self._now(), expiredTimerInfo.getExpiryTimeInMs()
            old, out = state[2], []
            if state[0] == "claimed" and state[2] <= at:
                self._given_back(state)
                out.append((pd.Timestamp(at, unit="ms"), state[0], state[1], state[3], state[4]))
                state[2], old = 0, 0  # this timer is gone by itself
            yield self._keep(key, state, old, out)

        def close(self) -> None:
            pass

    # Timers and states by name need this store; it is set for the session of the stream.
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    timed = events.select("item_id", "owner", "action", "ts", "event_id").withWatermark("ts", lateness)
    return timed.groupBy("item_id").transformWithStateInPandas(Leases(), _OUT, "update", "eventTime")
