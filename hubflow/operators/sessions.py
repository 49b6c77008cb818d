"""Routing chained into links: refused packets end their sender's session (R1 with W2 and P4).

The links of a run feed back on one another. A session is the stream of one step: its packets go to the next worker's link,
and its end closes the step's own link, so that what is sent to it waits from then on. So a run's events are one ordered log,
whatever the step: namespace, run, step (the sender's, or the link's), ts, seq, kind (connect, disconnect, packet,
send_failed, flush_failed), outcome and target (as ``route`` gives them), size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.names import LIMITS, Limits
from hubflow.operators.links import LEFT, REFUSED, SENT, Link

RUN = ["namespace", "run"]
LOG = "namespace string, run string, step string, ts timestamp, seq long, kind string, outcome string, target string, size long"
#: One ``sent`` row per packet: what became of it, its link (``target``), why it was refused, the buffer after it. One
#: ``left`` row per packet that leaves a buffer.
FATES = "namespace string, run string, step string, seq long, event string, at timestamp, outcome string, target string, reason string, buffer_size int, buffer_bytes long"
#: Outcomes of a packet that ends its session.
ERRORS = ("unavailable", "internal")


@dataclass
class Run:
    """The links of one run by step, and the steps whose session ended by an error and wasn't begun again."""

    limits: Limits = LIMITS
    links: dict[str, Link] = field(default_factory=dict)
    ended: set[str] = field(default_factory=set)

    def link(self, step: str) -> Link:
        return self.links.setdefault(step, Link(self.limits))

    def fail(self, step: str, now: int) -> Iterator[tuple]:
        self.ended.add(step)
        if step in self.links:
            yield from self._of(step, self.links[step].disconnect(now))

    def _of(self, step: str, events: Iterator[tuple]) -> Iterator[tuple]:
        """Rows of packets that leave the buffer of a step's link."""
        yield from ((step, seq, LEFT, at, outcome, step, None, n, total) for event, seq, at, outcome, n, total, _ in events if event == LEFT)

    def handle(self, step: str, kind: str, seq: int, now: int, outcome: str | None, target: str | None, size: int | None) -> Iterator[tuple]:
        if kind in ("connect", "disconnect", "flush_failed"):
            if kind == "connect":
                self.ended.discard(step)
            yield from self._of(step, self.link(step).handle(kind, seq, now, size))
        elif step in self.ended:
            yield step, seq, SENT, now, "unprocessed", None, None, None, None
        elif outcome in ("deliver", "heartbeat"):
            events = list(self.link(target).handle(kind, seq, now, size))
            yield from self._of(target, iter(events[:-1]))
            _, _, _, fate, n, total, _ = events[-1]
            refused = fate in REFUSED
            told = ("heartbeat_dropped" if outcome == "heartbeat" else "resource_exhausted") if refused else fate
            yield step, seq, SENT, now, told, target, fate if refused else None, n, total
            if told == "resource_exhausted":
                yield from self.fail(step, now)
        else:
            yield step, seq, SENT, now, outcome, target, None, None, None
            if outcome in ERRORS:
                yield from self.fail(step, now)

    def evict(self, now: int) -> Iterator[tuple]:
        for step, link in self.links.items():
            yield from self._of(step, link.evict(now))


def run_log(routed: DataFrame, link_events: DataFrame, size: str | Column = "size") -> DataFrame:
    """Routed packets and link events as one log; packets without a ``kind`` column are plain ones."""
    kind = F.col("kind") if "kind" in routed.columns else F.lit("packet")
    n = F.col(size) if isinstance(size, str) else size
    sent = routed.select(*RUN, F.col("step_id").alias("step"), "ts", "seq", kind.alias("kind"), "outcome", F.col("target_step").alias("target"), n.cast("long").alias("size"))
    events = link_events.select(*RUN, "step", "ts", "seq", "kind", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("target"), (F.col("size") if "size" in link_events.columns else F.lit(None)).cast("long").alias("size"))
    return sent.unionByName(events)


def run_fates(log: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """What becomes of every packet (see ``FATES``), in one ordered pass per run.

    A packet whose link refuses it is ``resource_exhausted`` and ends its session, as ``unavailable`` and ``internal`` do:
    packets that follow are ``unprocessed`` until the step connects again, and its own link is closed. A refused heartbeat
    is ``heartbeat_dropped`` and ends nothing. Rows are dealt by run and sorted by Spark; a task keeps the buffers of one
    run, at most ``max_messages`` pairs a step. A run is sequential: which packets exist depends on those before.
    """
    columns = [c.split()[0] for c in LOG.split(", ")]
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*RUN, "step")]
    rows = log.select(*keys, *columns[3:]).repartition(*RUN).sortWithinPartitions(*RUN, "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, Run(limits)
        for batch in batches:
            out: list[tuple] = []
            stamps = batch.column("ts").cast(pa.int64()).to_pylist()
            for *this, step, seq, kind, outcome, target, size, at in zip(*[batch.column(c).to_pylist() for c in (*RUN, "step", "seq", "kind", "outcome", "target", "size")], stamps, strict=True):
                if this != key:
                    key, state = this, Run(limits)
                out.extend((*key, *r) for r in state.handle(step, kind, seq, at, outcome, target, size))
            yield fates_batch(out)

    return rows.mapInArrow(run, FATES)


def fates_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC")}
    fields = [f.split() for f in FATES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])
