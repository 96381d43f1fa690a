"""Stateful streaming forms of the per-user operators: folds over each user's
events in event-time order (``streaming.ordered``), with late rows kept apart.

The fold's state is small: the pending suggestion for outcome resolution; the epoch
and, as map entries, the files activated in it for first activation. The batch
operators give the same rows on the same input (``tests/test_io_streaming.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators.sessions import DECIDED
from .ordered import Fold, in_order


class Outcomes(Fold):
    """A shown row waits until the first decision after it, or the next shown row."""

    columns = {"ts": "bigint", "seq": "bigint", "kind": "string"}
    output = {"shown_seq": "bigint", "shown_ts": "bigint", "outcome": "string", "outcome_ts": "bigint"}

    def init(self, handle) -> None:
        self.state = handle.getValueState("pending", "seq bigint, ts bigint")

    def load(self) -> None:
        pending = self.state.get()
        self.pending = tuple(pending) if pending else None

    def step(self, row: tuple) -> list[tuple]:
        ts, seq, kind = row
        before = self.pending
        if kind == "shown":
            self.pending = (seq, ts)
            return [(*before, "ignored", ts)] if before else []
        if before is None:
            return []
        self.pending = None
        return [(*before, "accepted" if kind == "accept" else "rejected", ts)]

    def save(self) -> None:
        if self.pending:
            self.state.update(self.pending)
        else:
            self.state.clear()


class Activations(Fold):
    """Whether a tab event is the first of its file since the last clear."""

    columns = {"ts": "bigint", "seq": "bigint", "kind": "string", "file": "string"}
    output = {"seq": "bigint", "file": "string", "epoch": "bigint", "is_first": "boolean"}

    def init(self, handle) -> None:
        self.state = handle.getValueState("epoch", "epoch bigint")
        self.files = handle.getMapState("files", "file string", "epoch bigint")

    def load(self) -> None:
        begun = self.state.get()
        self.epoch = begun[0] if begun else 0
        # Files of earlier releases count up to the first clear; a new user has none.
        self.start, self.seen = self.epoch if begun else None, set()

    def step(self, row: tuple) -> list[tuple]:
        _, seq, kind, file = row
        if kind == "clear":
            self.epoch += 1
            self.seen = set()
            return []
        name = ("x" + file if file is not None else "",)  # a file without a name is one file
        first = name not in self.seen and not (self.epoch == self.start and self.files.containsKey(name))
        if first:
            self.seen.add(name)
        return [(seq, file, self.epoch, first)]

    def save(self) -> None:
        if self.start is not None and self.epoch != self.start:
            self.files.clear()
        for name in self.seen:
            self.files.updateValue(name, (self.epoch,))
        self.state.update((self.epoch,))


def stream_outcomes(decisions: DataFrame, delay_ms: int = config.STREAM_DELAY_MS) -> DataFrame:
    """Outcome resolution on a stream of ``(user_id, ts, seq, kind)``, late rows beside."""
    kind = F.when(F.col("kind").isin("shown", *DECIDED), F.col("kind"))
    return in_order(decisions.withColumn("kind", kind), Outcomes(), "user_id", "bigint", delay_ms)


def stream_first_activation(events: DataFrame, delay_ms: int = config.STREAM_DELAY_MS) -> DataFrame:
    """First activation per (epoch, file) on a stream of session events, late rows beside."""
    kind = F.when(F.col("kind").isin("clear", "tab"), F.col("kind"))
    return in_order(events.withColumn("kind", kind), Activations(), "user_id", "bigint", delay_ms)
