"""Keyed state machines over events in event-time order.

Rows of a key wait in state until the watermark has passed them and are then
handled in order, so micro-batches may bring them in any order.  One timer per
key is set for whatever comes next: the next waiting row, a deadline of the state
machine, or the end of the state's life.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import lexicons as L
from . import events as E

#: State of a key that has been quiet this long is dropped; later rows start anew.
TIME_TO_LIVE = 24 * 3600


class _Ordered:
    """Rows ``(ms, seq, ...)`` of a key in order; subclasses give ``STATE``, ``ROW``, ``OUT`` and ``step``.

    ``step(ready, state, until)`` gets the rows up to the watermark as a frame in
    order (it may be empty) and the state as a tuple or None, and returns output
    columns by name, the new state, and the next deadline in ms or None.

    The state of a key travels with its rows, so a key costs no calls to the store.
    """

    STATE = ROW = OUT = ""
    ttl_ms = TIME_TO_LIVE * 1000

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [field.split()[0] for field in schema.split(", ")]

    @property
    def kept(self) -> str:
        """Schema of what is kept of a key: the state, null without one, and the rows that wait."""
        return f"{self.STATE}, waiting array<struct<{self.ROW.replace(' ', ': ').replace(',:', ',')}>>"

    def _result(self, key, out: dict) -> pd.DataFrame:
        """Output rows: the key's columns come first in ``OUT``."""
        names = self._names(self.OUT)
        size = len(out[names[-1]])
        return pd.DataFrame({**{k: [v] * size for k, v in zip(names, key)}, **out}, columns=names, dtype=object)

    def handle(self, key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        """Rows that came for a key, or none when its time is up."""
        names, until = self._names(self.ROW), kept.getCurrentWatermarkMs()
        *state, waiting = kept.get if kept.exists else (None, [])
        state = tuple(state) if state and state[0] is not None else None
        held = [tuple(r) for r in waiting]
        for frame in frames:
            held += zip(*[frame[c].tolist() for c in names])
        ready = sorted((r for r in held if r[0] <= until), key=lambda r: r[:2])
        rest = [r for r in held if r[0] > until]
        deadline = None
        if ready or state:
            out, state, deadline = self.step(pd.DataFrame(ready, columns=names), state, until)
            yield self._result(key, out)
        # The first value of every state is the time of its last row.
        over = state is None or state[0] + self.ttl_ms <= until
        if over and not rest:
            kept.remove()
            return
        marks = [r[0] for r in rest] + ([] if deadline is None else [deadline]) + ([state[0] + self.ttl_ms] if state else [])
        kept.update((*(state or [None] * len(self._names(self.STATE))), rest))
        # Time is up once the watermark is past this mark, that is, when it has reached the next one.
        kept.setTimeoutTimestamp(max(min(marks) - 1, until))


def _machine(rows: DataFrame, key: list[str], machine: _Ordered) -> DataFrame:
    return rows.groupBy(*key).applyInPandasWithState(
        machine.handle, machine.OUT, machine.kept, "append", GroupStateTimeout.EventTimeTimeout)


def _start(events: DataFrame, key: list[str], machine: _Ordered, watermark: str, *columns) -> DataFrame:
    return _machine(
        events.withWatermark("at", watermark).select(*key, "at", F.unix_millis("at").alias("ms"), *columns), key, machine)


class _Agents(_Ordered):
    """Working, waiting after idle time, working again on output; done stays."""

    STATE = "ms bigint, status string"
    ROW = "ms bigint, ord bigint, status string, done boolean"
    OUT = "run_id bigint, agent_key string, ms bigint, status string"

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def step(self, ready, state, until):
        last_ms, last = state if state else (-1, "")
        times, told = [], []
        if len(ready):
            ms = ready["ms"].to_numpy()
            done = np.logical_or.accumulate(ready["done"].to_numpy(bool)) | (last == "done")
            status = np.where(done, "done", ready["status"].to_numpy(object)).astype(object)
            before_ms, before = np.concatenate([[last_ms], ms[:-1]]), np.concatenate([[last], status[:-1]])
            idle = (before == "working") & (ms - before_ms > self.idle_ms)
            changed = status != np.where(idle, "waiting", before)
            order = np.argsort(np.concatenate([2 * np.flatnonzero(idle), 2 * np.flatnonzero(changed) + 1]))
            times = np.concatenate([before_ms[idle] + self.idle_ms, ms[changed]])[order].tolist()
            told = np.concatenate([np.full(int(idle.sum()), "waiting", object), status[changed]])[order].tolist()
            last_ms, last = int(ms[-1]), str(status[-1])
        if last == "working" and last_ms + self.idle_ms < until:
            times.append(last_ms + self.idle_ms)
            told.append("waiting")
            last = "waiting"
        state = (last_ms, last) if last else None
        return {"ms": times, "status": told}, state, last_ms + self.idle_ms + 1 if last == "working" else None


def agent_changes(events: DataFrame, idle_seconds: int = 30, watermark: str = E.WATERMARK) -> DataFrame:
    """(run_id, agent_key, ms, status): every change of status of every agent, as it becomes known.

    Equals :func:`events.agent_changes` up to the watermark.
    """
    rows = E.agent_rows(events.withWatermark("at", watermark))
    rows = rows.select("run_id", "agent_key", "at", F.unix_millis("at").alias("ms"),
                       (F.col("seq") * 2 + F.col("step")).alias("ord"), "status", "done")
    return _machine(rows, ["run_id", "agent_key"], _Agents(idle_seconds))


class _Alarms(_Ordered):
    """A parent timer and, once work was delegated, a nested timer per run."""

    STATE = "ms bigint, seq bigint, nested boolean, parent_fired boolean, nested_fired boolean"
    ROW = "ms bigint, seq bigint, nested boolean"
    OUT = "run_id bigint, kind string, last_seq bigint, quiet_since_ms bigint"

    def __init__(self, parent_seconds: int, nested_seconds: int):
        self.limits = {"parent": parent_seconds * 1000, "nested": nested_seconds * 1000}

    def step(self, ready, state, until):
        last_ms, last_seq, nested, *fired = state if state else (-1, -1, False, True, True)
        fired = dict(zip(("parent", "nested"), fired))
        ms = np.concatenate([[last_ms], ready["ms"].to_numpy(np.int64)])
        seq = np.concatenate([[last_seq], ready["seq"].to_numpy(np.int64)])
        seen = np.logical_or.accumulate(np.concatenate([[nested], ready["nested"].to_numpy(bool)]))
        kinds, lasts, since, deadlines = [], [], [], []
        for kind, limit in self.limits.items():
            # The last row's quiet time lasts until the watermark at least.
            quiet = np.append(ms[1:], until) - ms
            hit = (quiet > limit) & (ms >= 0) & (seen if kind == "nested" else True)
            hit[0] &= not fired[kind]
            fired[kind] = bool(hit[-1]) or (len(ms) == 1 and fired[kind])
            kinds += [kind] * int(hit.sum())
            lasts += seq[hit].tolist()
            since += ms[hit].tolist()
            if not fired[kind]:
                deadlines.append(int(ms[-1]) + limit + 1)
        state = (int(ms[-1]), int(seq[-1]), bool(seen[-1]), fired["parent"], fired["nested"])
        return {"kind": kinds, "last_seq": lasts, "quiet_since_ms": since}, state, min(deadlines, default=None)


def run_alarms(
    events: DataFrame, parent_seconds: int = L.STALL_MINUTES * 60, nested_seconds: int = L.NESTED_STALL_MINUTES * 60,
    watermark: str = E.WATERMARK,
) -> DataFrame:
    """(run_id, kind, last_seq, quiet_since_ms): quiet times of runs, as soon as the watermark proves them.

    Equals :func:`events.run_alarms` up to the watermark.
    """
    nested = F.col("session_id").isNotNull().alias("nested")
    return _start(events, ["run_id"], _Alarms(parent_seconds, nested_seconds), watermark, "seq", nested)


class _Deltas(_Ordered):
    """New text of growing parts; of the last text only its length and a digest are kept."""

    STATE = "ms bigint, length bigint, digest string"
    ROW = "ms bigint, seq bigint, text string"
    OUT = "run_id bigint, part_key string, seq bigint, delta string"

    @staticmethod
    def _digest(text: str) -> str:
        return blake2b(text.encode(), digest_size=16).hexdigest()

    def step(self, ready, state, until):
        if not len(ready):
            return {"seq": [], "delta": []}, state, None
        texts = ready["text"].tolist()
        length, digest = state[1:] if state else (0, self._digest(""))
        first = texts[0]
        # The text before the first is known by its digest alone.
        before = first[:length] if self._digest(first[:length]) == digest else None
        deltas = [
            "" if now == old else now[len(old):].strip() if old is not None and now.startswith(old) else now
            for old, now in zip([before, *texts[:-1]], texts)
        ]
        kept = [bool(d) for d in deltas]
        state = (int(ready["ms"].iloc[-1]), len(texts[-1]), self._digest(texts[-1]))
        return {"seq": ready["seq"][kept].tolist(), "delta": [d for d in deltas if d]}, state, None


def text_deltas(parts: DataFrame, watermark: str = E.WATERMARK) -> DataFrame:
    """(run_id, part_key, seq, delta) of parts ``(run_id, part_key, seq, at, text)`` that arrive in any order.

    Parts are ordered by time, then sequence number.  Equals
    :func:`events.text_deltas` up to the watermark where both orders agree.
    """
    return _start(parts, ["run_id", "part_key"], _Deltas(), watermark, "seq", F.coalesce("text", F.lit("")).alias("text"))
