"""Keyed state with deadlines: leases of tasks and saved baselines, as a stream with timers or as one batch over all events.

The clock is the watermark: events wait in their key's state until it has passed them, so they are taken in order of time whatever order they arrive in, and a timer is set for
the next waiting event or deadline. The stream's rows are therefore those of the batch over the same events up to the watermark, restarts included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, ts timestamp, change string, count int"
_STATE = "saved string"
Row = tuple[str, int, str, int]


class Machine(Protocol):
    """What a key does at an event and at a deadline. States are small dictionaries; times are microseconds."""

    def start(self) -> dict: ...
    def deadline(self, state: dict) -> int | None: ...
    def expire(self, state: dict) -> tuple[str, int]: ...
    def take(self, state: dict, event: dict) -> tuple[str, int] | None: ...


class Leases(NamedTuple):
    """Events add, claim, renew, done and fail of a task. A claim holds for ``seconds``; one that runs out opens the task again, and for the ``most``-th time fails it.
    Changes: claimed, rejected (a claim of a task that isn't open), renewed, done, failed, reclaimed; ``count`` is how often the task was reclaimed."""

    seconds: int = 300
    most: int = 3

    def start(self) -> dict:
        return {"status": "open", "worker": None, "until": None, "reclaims": 0}

    def deadline(self, state: dict) -> int | None:
        return state["until"]

    def expire(self, state: dict) -> tuple[str, int]:
        n = state["reclaims"] + 1
        state.update(status="failed" if n >= self.most else "open", worker=None, until=None, reclaims=n)
        return ("failed" if n >= self.most else "reclaimed"), n

    def take(self, state: dict, event: dict) -> tuple[str, int] | None:
        kind, n = event["event"], state["reclaims"]
        mine = state["status"] == "claimed" and state["worker"] == event["worker"]
        if kind == "claim":
            if state["status"] != "open":
                return "rejected", n
            state.update(status="claimed", worker=event["worker"], until=event["us"] + self.seconds * 1_000_000)
            return "claimed", n
        if kind == "renew" and mine:
            state["until"] = event["us"] + self.seconds * 1_000_000
            return "renewed", n
        if kind in ("done", "fail") and mine:
            state.update(status="done" if kind == "done" else "failed", until=None)
            return state["status"], n
        return None


class Baselines(NamedTuple):
    """Events store and probe of a repository, with its head, stash and number of changed files. A baseline holds for ``seconds``, for the head and stash that it was stored with, and until
    more than ``many`` files have changed where no more had. Changes: stored, valid, head, stash, files (why a probe dropped it), missing, expired; ``count`` is the number of baselines stored so far."""

    seconds: int = 900
    many: int = 10

    def start(self) -> dict:
        return {"until": None, "head": None, "stash": None, "changed": 0, "n": 0}

    def deadline(self, state: dict) -> int | None:
        return state["until"]

    def expire(self, state: dict) -> tuple[str, int]:
        state["until"] = None
        return "expired", state["n"]

    def take(self, state: dict, event: dict) -> tuple[str, int]:
        if event["event"] == "store":
            state.update(until=event["us"] + self.seconds * 1_000_000, head=event["head"], stash=event["stash"], changed=event["changed"], n=state["n"] + 1)
            return "stored", state["n"]
        if state["until"] is None:
            return "missing", state["n"]
        why = "head" if event["head"] != state["head"] else "stash" if event["stash"] != state["stash"] else "files" if state["changed"] <= self.many < event["changed"] else "valid"
        if why != "valid":
            state["until"] = None
        return why, state["n"]


def _advance(machine: Machine, key: str, state: dict, events: list[dict], upto: int | None, out: list[Row]) -> None:
    """Takes events in order, each after the deadlines that come before it or with it, then the deadlines up to a time."""
    for event in [*events, {"us": upto, "event": None}] if upto is not None else events:
        while (end := machine.deadline(state)) is not None and end <= event["us"]:
            out.append((key, end, *machine.expire(state)))
        if event["event"] is not None and (change := machine.take(state, event)) is not None:
            out.append((key, event["us"], *change))


def _frame(out: list[Row]) -> pd.DataFrame:
    f = pd.DataFrame(out, columns=["key", "ts", "change", "count"])
    return f.assign(ts=pd.to_datetime(f.ts, unit="us").astype("datetime64[us]"), count=f["count"].astype("int32"))


def _prepared(events: DataFrame, key: str) -> DataFrame:
    """key, ts, us, event and what else the events hold, as JSON."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rest = F.to_json(F.struct(F.unix_micros("ts").alias("us"), *(c for c in events.columns if c not in (key, "ts"))), {"ignoreNullFields": "false"})
    return events.filter(F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("key"), "ts", F.col("seq").cast("long").alias("seq"), rest.alias("row"))


def replayed(events: DataFrame, machine: Machine, key: str, upto: Any = None) -> DataFrame:
    """key, ts, change, count of all events (``ts``, ``event``, ``seq``, ...) up to a time. A key's events pass through one task in order, a batch at a time, so its memory doesn't grow with them."""
    prepared = _prepared(events, key)
    if upto is not None:
        prepared = prepared.filter(F.col("ts") <= F.lit(upto))
    end = None if upto is None else int(pd.Timestamp(upto).value // 1000)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, machine.start(), True
        for batch in batches:
            out: list[Row] = []
            for k, row in zip(batch.key, batch.row, strict=True):
                if first or k != now:
                    if not first:
                        _advance(machine, now, state, [], end, out)
                    now, state, first = k, machine.start(), False
                _advance(machine, k, state, [json.loads(row)], None, out)
            yield _frame(out)
        if not first:
            out = []
            _advance(machine, now, state, [], end, out)
            yield _frame(out)

    return prepared.repartition("key").sortWithinPartitions("key", "ts", "seq").select("key", "row").mapInPandas(fold, OUT)


def tracked(events: DataFrame, machine: Machine, key: str, late: str = "1 minute") -> DataFrame:
    """The same rows as a stream, each once the watermark has passed its time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"state": machine.start(), "waiting": []}
        for batch in batches:
            saved["waiting"] += [json.loads(r) for r in batch.row]
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted((e for e in saved["waiting"] if e["us"] <= now), key=lambda e: (e["us"], e["seq"]))
        saved["waiting"] = [e for e in saved["waiting"] if e["us"] > now]
        out: list[Row] = []
        _advance(machine, group[0], saved["state"], ready, now, out)
        state.update((json.dumps(saved),))
        times = [e["us"] for e in saved["waiting"]] + [t for t in (machine.deadline(saved["state"]),) if t is not None]
        if times:
            state.setTimeoutTimestamp(max(-(-min(times) // 1000), now // 1000 + 1))
        yield _frame(out)

    prepared = _prepared(events, key).withWatermark("ts", late)
    return prepared.groupBy("key").applyInPandasWithState(step, OUT, _STATE, "append", "EventTimeTimeout")
