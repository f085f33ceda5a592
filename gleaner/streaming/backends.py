"""An ordered list of services that may fail: strikes, cooldowns and remembered answers as state.

A request is offered to the services in order. One that answers ends it and loses its strikes; one that
fails gets a strike and, with three of them, is left out for a while; after that one more failure
leaves it out again. A fatal failure leaves it out for the rest of the run. ``same`` (the text needs no
translation) and ``unable`` (a limit of the service) are answers about the text and give no strike. An
answered text is remembered and not asked again for a while.

A request's ``tried`` holds what each service would say: (name, outcome) in the order of preference, with
outcome ok, fail, fatal, same or unable. State is kept for each run (``key``); what a run holds is bounded by its services
and by the texts of one memory span. Times are milliseconds.

Batch and stream share ``decide``: the batch form reads a run's requests in order of time, the stream form
keeps the state between micro-batches and drops remembered texts by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STRIKES, COOLDOWN, MEMORY = 3, 180_000, 600_000
NEVER = 1 << 62
OUT = "id long, status string, served string, asked array<string>"


@dataclass
class Run:
    """name -> strikes and the time until which it is left out; text -> (service, time of the answer)."""

    strikes: dict[str, int] = field(default_factory=dict)
    until: dict[str, int] = field(default_factory=dict)
    answers: dict[str, tuple[str, int]] = field(default_factory=dict)


def decide(run: Run, at: int, text: str | None, tried: list[tuple[str, str]]) -> tuple[str, str | None, list[str]]:
    """Status, service and services asked for one request; the run is changed.

    Status: cached, ok, ``untranslatable`` (every service that answered said so), ``none`` (no service to ask) or error.
    """
    held = run.answers.get(text) if text is not None else None
    if held and at - held[1] < MEMORY:
        return "cached", held[0], []
    asked, outcomes = [], []
    for name, outcome in tried:
        if name in run.until:
            if run.until[name] > at:
                continue
            del run.until[name]  # one more failure leaves it out again
            run.strikes[name] = STRIKES - 1
        asked.append(name)
        outcomes.append(outcome)
        if outcome == "ok":
            run.strikes[name] = 0
            if text is not None:
                run.answers[text] = (name, at)
            return "ok", name, asked
        if outcome in ("fail", "fatal"):
            run.strikes[name] = run.strikes.get(name, 0) + 1
            if outcome == "fatal":
                run.until[name] = NEVER
            elif run.strikes[name] >= STRIKES:
                run.until[name] = at + COOLDOWN
    if not asked:
        return "none", None, asked
    return "untranslatable" if all(o == "same" for o in outcomes) else "error", None, asked


def _answers(run: Run, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for i, at, text, tried in rows.sort_values(["at", "id"])[["id", "at", "text", "tried"]].itertuples(index=False):
        out.append((i, *decide(run, int(at), text, [(x["name"], x["outcome"]) for x in (() if tried is None else tried)])))
    return pd.DataFrame(out, columns=["id", "status", "served", "asked"])


def batch_requests(df: DataFrame, key: str) -> DataFrame:
    """Requests (key, id, at, text, tried) -> key, id, status, served, asked, each run's in order of time, then id."""
    kind = df.schema[key].dataType.simpleString()

    def one(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _answers(Run(), rows).assign(**{key: k[0]})

    return df.select(key, "id", "at", "text", "tried").groupBy(key).applyInPandas(one, f"{OUT}, `{key}` {kind}").select(key, "id", "status", "served", "asked")


class Services(StatefulProcessor):
    """The state of one run: a value for each service, a value for each remembered text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.services = handle.getMapState("services", "name string", "strikes int, until long")
        self.answers = handle.getMapState("answers", "text string", "served string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = Run()
        for (name,), (strikes, until) in self.services.iterator():
            run.strikes[name] = strikes
            if until:
                run.until[name] = until
        for (text,), (served, at) in self.answers.iterator():
            run.answers[text] = (served, at)
        before = dict(run.answers)
        got = _answers(run, pd.concat(list(rows)))
        for name in run.strikes.keys() | run.until.keys():
            self.services.updateValue((name,), (run.strikes.get(name, 0), run.until.get(name, 0)))
        for text, (served, at) in run.answers.items():
            if before.get(text) != (served, at):
                self.answers.updateValue((text,), (served, at))
                self.handle.registerTimer(at + MEMORY)
        yield got.assign(run=str(key[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        for text in [t for t, (_, at) in self.answers.iterator() if at + MEMORY <= over]:
            self.answers.removeKey(text)
        return iter(())

    def close(self) -> None:
        pass


def stream_requests(df: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The same for a stream with an event time column ``ts``: run (the key as text), id, status, served, asked.

    Requests of a run are answered in order within a micro-batch and as they come between them. Needs the RocksDB state store.
    """
    rows = df.withColumn("at", F.unix_millis(ts)).select(key, "id", "at", "text", "tried", ts).withWatermark(ts, late)
    return rows.groupBy(key).transformWithStateInPandas(Services(), f"{OUT}, run string", "Append", "EventTime").select("run", "id", "status", "served", "asked")
