"""The access ledger as a stream: grammar, budget, hash chain and unlock-once, with keyed state.

Events of a run (run_id, order_key, event_type, cost) arrive in any number of micro-batches, each
run's in order. State is a few numbers and the last hash for each run, in the state store, so a
query that restarts from its checkpoint goes on where it was. With ``idle``, a run without events
for as many milliseconds of processing time is told as ``abandoned`` if it is still open; timers
make a query run on, so it ends when it is stopped, not with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "n long, used double, last string, opens int, closes int, aborts int, revisions int, releases int, unlocked int, told string"
COLUMNS = ["order_key", "event_type", "cost", "sequence", "previous", "entry", "used", "remaining", "fits", "unlocks", "violations"]
TYPES = "order_key long, event_type string, cost double, sequence long, previous string, entry string, used double, remaining double, fits boolean, unlocks boolean, violations string"
ACCESS = ("candidates_exposed", "evidence_released")


def broken(event: str, n: int, count: dict[str, int]) -> list[str]:
    """The rules that an event breaks where it stands; ``count`` has what came before it in the run."""
    rules = {
        "not_opened_first": n == 0 and event != "agent_opened",
        "multiple_opens": event == "agent_opened" and count["opens"] > 0,
        "multiple_closes": event == "agent_closed" and count["closes"] > 0,
        "records_after_close": count["closes"] > 0,
        "multiple_aborts": event == "agent_aborted" and count["aborts"] > 0,
        "records_after_abort": count["aborts"] > 0 and event != "agent_closed",
        "multiple_revisions": event == "revision_recorded" and count["revisions"] > 0,
        "revision_before_release": event == "revision_recorded" and count["revisions"] == 0 and count["releases"] == 0,
        "access_after_revision": event in ACCESS and count["revisions"] > 0,
    }
    return [k for k, v in rules.items() if v]


COUNTED = {"agent_opened": "opens", "agent_closed": "closes", "agent_aborted": "aborts", "revision_recorded": "revisions", "evidence_released": "releases"}


class Ledger(StatefulProcessor):
    def __init__(self, limit: float, unlock: str, idle: int | None):
        self.limit, self.unlock, self.idle = limit, unlock, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("order_key", kind="stable")  # one run's of one micro-batch
        n, used, last, *counts, told = self.state.get() if self.state.exists() else (0, 0.0, "0" * 64, 0, 0, 0, 0, 0, 0, "")
        count = dict(zip(("opens", "closes", "aborts", "revisions", "releases", "unlocked"), counts, strict=True))
        known, out = set(filter(None, told.split(","))), []
        for at, event, cost in zip(events["order_key"], events["event_type"], events["cost"], strict=True):
            event = "" if event is None else event
            new = [x for x in broken(event, n, count) if x not in known]
            known.update(new)
            before, last = last, hashlib.sha256(f"{n}|{event}|{last}".encode()).hexdigest()
            left = max(0.0, self.limit - used)
            fits = cost <= left if cost <= 0 else round(used, 6) + cost <= self.limit
            out.append((at, event, cost, n, before, last, used, left, bool(fits), event == self.unlock and not count["unlocked"], ",".join(new)))
            used, n = used + cost, n + 1
            count["unlocked"] += event == self.unlock
            if event in COUNTED:
                count[COUNTED[event]] += 1
        self.state.update((n, float(used), last, *count.values(), ",".join(sorted(known))))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=COLUMNS).assign(run_id=key[0])[["run_id", *COLUMNS]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, used, last, opens, closes, aborts, *_ = self.state.get()
        rows = [(None, "", 0.0, n, last, last, used, max(0.0, self.limit - used), False, False, "abandoned")] if opens and not closes and not aborts else []
        yield pd.DataFrame(rows, columns=COLUMNS).assign(run_id=key[0])[["run_id", *COLUMNS]]

    def close(self) -> None:
        pass


def checked(events: DataFrame, limit: float, unlock: str = "metric_unlocked", idle: int | None = None) -> DataFrame:
    """Each event of a stream with its ``cost``, ``sequence``, hashes, budget before it, whether it fits and whether it unlocks (the
    first ``unlock`` of its run), and the rules that the run breaks from here on, comma-joined; each rule is told once.

    Whether a cost fits is asked of the sum rounded to six digits, so that the last bits of a running sum don't decide;
    what costs nothing always fits. Null costs count as 0, a null type is an event of no kind. Needs the RocksDB state store.
    """
    key = events.schema["run_id"].dataType.simpleString()
    own = events.selectExpr("run_id", "cast(order_key as long) as order_key", "event_type", "coalesce(cast(cost as double), 0D) as cost")
    return own.groupBy("run_id").transformWithStateInPandas(Ledger(limit, unlock, idle), f"run_id {key}, {TYPES}", "Append", "None" if idle is None else "ProcessingTime")
