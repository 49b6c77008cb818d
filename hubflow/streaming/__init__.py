"""Streaming forms: packets as Structured Streaming sources, links as keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hubflow.names import LIMITS, Limits
from hubflow.operators.buffering import FATES, LINK, STRETCH
from hubflow.operators.links import SENT, Link
from hubflow.operators.route import ERRORS
from hubflow.operators.sessions import FATES as RUN_FATES
from hubflow.operators.sessions import RUN, Run, fates_batch

LOG = "namespace STRING, run STRING, step STRING, ts TIMESTAMP, seq BIGINT, kind STRING, size BIGINT"
#: What ``stream_fail_stop`` gives.
PROCESSED = "namespace string, run string, step string, seq long, ts timestamp, outcome string, processed boolean"
#: What ``stream_missed_heartbeats`` gives.
MISSED = "namespace string, run string, step string, due timestamp"
#: State that spills to disk; set on the session before a stateful query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets that the keys of a stream are dealt into. A checkpoint holds for one number of buckets.
BUCKETS = 4096


class KeyedProcessor(StatefulProcessor):
    """Keys with little state and few rows each, a bucket of them at a time.

    Spark groups by a hash of the key, so a frame, a sort and the calls of a group are those of a whole bucket. What is kept
    is a map by key: a micro-batch reads and writes that of the keys in it, never the rest of the bucket.
    """

    keys: list[str]
    kept: str  # schema of what is kept of a key

    def init(self, handle: StatefulProcessorHandle, ttl_ms: int | None = None) -> None:
        self.handle, schema = handle, ", ".join(f"{c} string" for c in self.keys)
        self.map = handle.getMapState("kept", schema, self.kept, ttl_ms) if ttl_ms else handle.getMapState("kept", schema, self.kept)

    def read(self, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, list[tuple]]:
        """The bucket's rows in order of time, and the key of each."""
        batch = pd.concat(list(rows)).sort_values(["at_us", "seq"])
        return batch, list(zip(*[batch[c].tolist() for c in self.keys], strict=True))

    def saved(self, keys: Iterable[tuple]) -> dict[tuple, tuple]:
        """What is kept of those of the keys of which something is."""
        if not self.map.exists():
            return {}
        found = ((k, self.map.getValue(k)) for k in dict.fromkeys(keys))
        return {k: v for k, v in found if v is not None}


def _dealt(rows: DataFrame, keys: list[str], buckets: int) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("bucket")


def _whole(column: pd.Series) -> list[int | None]:
    return [None if missing else int(x) for x, missing in zip(column.tolist(), column.isna(), strict=True)]


class LinkProcessor(KeyedProcessor):
    """W2 to W5 and W7 of links. Their buffers are restored from the checkpoint; ``due`` tells which links a timer is for."""

    keys = LINK
    kept = "connected boolean, total long, dropped long, last_active long, latest long, seqs array<long>, sizes array<long>"

    def __init__(self, limits: Limits = LIMITS, lateness_s: float | None = None):
        self.limits, self.lateness, self.timed = limits, lateness_s, limits.ttl_s is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.timed:
            self.due = handle.getMapState("due", "timer long", "links array<array<string>>")

    def _load(self, keys: Iterable[tuple]) -> dict[tuple, list]:
        """Each link and the time of its latest event."""
        out = {k: [Link(self.limits), -(1 << 62)] for k in keys}
        for k, (connected, total, dropped, active, latest, seqs, sizes) in self.saved(out).items():
            out[k] = [Link(self.limits, connected, list(zip(seqs, sizes, strict=True)), total, dropped, None if active < 0 else active), latest]
        return out

    def _save(self, links: dict[tuple, list]) -> None:
        timers: dict[int, list[tuple]] = {}
        for key, (x, latest) in links.items():
            self.map.updateValue(key, (x.connected, x.total, x.dropped, -1 if x.last_active is None else x.last_active, latest, [s for s, _ in x.held], [n for _, n in x.held]))
            due = x.evict_due()
            if due is not None:
                timers.setdefault(due // 1000 + 1, []).append(key)
        for timer, keys in timers.items():
            known = self.due.getValue((timer,))
            if known is None:
                self.handle.registerTimer(timer)
            self.due.updateValue((timer,), ([list(k) for k in dict.fromkeys([*(map(tuple, known[0]) if known else ()), *keys])],))

    def _rows(self, events: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, seq, event, at, outcome, n, total, cause) for key, (event, seq, at, outcome, n, total, cause) in events], columns=[x.split()[0] for x in FATES.split(", ")])
        out["at"] = pd.to_datetime(out["at"], unit="us", utc=True).dt.tz_localize(None) if len(out) else pd.to_datetime(out["at"])
        return out.astype({"seq": "int64", "buffer_size": "Int32", "buffer_bytes": "Int64", "cause": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, of = self.read(rows)
        links = self._load(of)
        behind = timerValues.getCurrentWatermarkInMs() * 1000 if self.timed else 0
        events: list[tuple] = []
        for k, seq, kind, size, at in zip(of, batch["seq"].tolist(), batch["kind"].tolist(), _whole(batch["size"]), batch["at_us"].tolist(), strict=True):
            link, latest = links[k]
            if self.lateness is not None and at < latest - self.lateness * 1e6 or self.timed and at < behind:
                events += [(k, (SENT, seq, at, "late", None, None, None))] if kind in ("packet", "send_failed") else []
                continue
            links[k][1] = max(latest, at)
            events += [(k, e) for e in link.handle(kind, seq, at, size)]
        self._save(links)
        yield self._rows(events)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer = expiredTimerInfo.getExpiryTimeInMs()
        waiting = self.due.getValue((timer,))
        links = self._load(map(tuple, waiting[0]) if waiting else ())
        events = [(k, e) for k, (link, _) in links.items() for e in link.evict(timer * 1000)]
        self.due.removeKey((timer,))
        self._save(links)
        yield self._rows(events)


class RunProcessor(KeyedProcessor):
    """R1 with W2 and P4 of runs: what is kept of a run is its links and their buffers (see ``sessions.Run``)."""

    keys = RUN
    kept = "steps array<string>, connected array<boolean>, ended array<boolean>, total array<long>, dropped array<long>, last_active array<long>, seqs array<array<long>>, sizes array<array<long>>"

    def __init__(self, limits: Limits = LIMITS):
        self.limits = limits

    def _load(self, keys: Iterable[tuple]) -> dict[tuple, Run]:
        out = {k: Run(self.limits) for k in keys}
        for k, kept in self.saved(out).items():
            for step, connected, ended, total, dropped, active, seqs, sizes in zip(*kept, strict=True):
                if ended:
                    out[k].ended.add(step)
                out[k].links[step] = Link(self.limits, connected, list(zip(seqs, sizes, strict=True)), total, dropped, None if active < 0 else active)
        return out

    def _save(self, runs: dict[tuple, Run]) -> None:
        for key, run in runs.items():
            steps = [(k, x.connected, k in run.ended, x.total, x.dropped, -1 if x.last_active is None else x.last_active, [s for s, _ in x.held], [n for _, n in x.held]) for k, x in run.links.items()]
            steps += [(k, False, True, 0, 0, -1, [], []) for k in run.ended if k not in run.links]
            if steps:
                self.map.updateValue(key, tuple(map(list, zip(*steps, strict=True))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, of = self.read(rows)
        runs, out = self._load(of), []
        columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("step", "kind", "outcome", "target")]
        for k, step, kind, outcome, target, seq, at, size in zip(of, *columns, batch["seq"].tolist(), batch["at_us"].tolist(), _whole(batch["size_"]), strict=True):
            out.extend((*k, *x) for x in runs[k].handle(step, kind, seq, at, outcome, target, size))
        self._save(runs)
        made = fates_batch(out).to_pandas()
        made["at"] = made["at"].dt.tz_localize(None)
        yield made.astype({"seq": "int64", "buffer_size": "Int32", "buffer_bytes": "Int64"})


def stream_run_fates(log: DataFrame, limits: Limits = LIMITS, *, buckets: int = BUCKETS) -> DataFrame:
    """The streaming form of ``sessions.run_fates``: routed packets and link events (see ``sessions.run_log``), keyed by run.

    Routing is a join of the stream with static dimensions; its outcomes go on into the runs' state in the same query. A
    micro-batch is sorted by (ts, seq) per run. Buffers without a time to live only; see ``stream_link_fates`` for eviction.
    """
    if limits.ttl_s is not None:
        raise ValueError("buffers of runs have no time to live; use stream_link_fates")
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*RUN, "step")]
    rows = log.select(*keys, "seq", "kind", "outcome", "target", F.col("size").alias("size_"), F.unix_micros("ts").alias("at_us"))
    return _dealt(rows, RUN, buckets).transformWithStateInPandas(RunProcessor(limits), outputStructType=RUN_FATES, outputMode="Append", timeMode="None")


class SessionProcessor(KeyedProcessor):
    """P4 of sessions: those that an error ended. They are forgotten when they begin again, or after their time to live."""

    keys, kept = LINK, "ended boolean"

    def __init__(self, errors: tuple[str, ...], ttl_ms: int | None):
        self.errors, self.ttl = errors, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, of = self.read(rows)
        before = set(self.saved(of))
        ended, processed = set(before), []
        for k, kind, outcome in zip(of, batch["kind"].tolist(), batch["outcome"].tolist(), strict=True):
            if kind == "connect":
                ended.discard(k)
            processed.append(k not in ended)
            if kind == "packet" and outcome in self.errors:
                ended.add(k)
        for k in before - ended:
            self.map.removeKey(k)
        for k in ended if self.ttl else ended - before:  # a session that goes on has its time to live anew
            self.map.updateValue(k, (True,))
        out = batch.assign(processed=processed)
        yield out.loc[out["kind"] == "packet", [c.split()[0] for c in PROCESSED.split(", ")]].astype({"seq": "int64", "processed": "bool"})


def stream_fail_stop(log: DataFrame, errors: tuple[str, ...] = ERRORS, ttl_ms: int | None = None, *, buckets: int = BUCKETS) -> DataFrame:
    """P4 over a stream of ``sessions.run_log`` rows: namespace, run, step, seq, ts, outcome, processed of every packet.

    Packets after an error of their session aren't processed until a connect of the step. ``ttl_ms`` (processing time)
    bounds how long an ended session is remembered. A micro-batch is sorted by (ts, seq) per session.
    """
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LINK]
    rows = log.select(*keys, "seq", "ts", "kind", "outcome", F.unix_micros("ts").alias("at_us"))
    return _dealt(rows, LINK, buckets).transformWithStateInPandas(SessionProcessor(errors, ttl_ms), outputStructType=PROCESSED, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def stream_link_fates(log: DataFrame, limits: Limits = LIMITS, *, lateness_s: float | None = None, watermark: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The streaming form of ``buffering.link_fates``: same rows, keyed state instead of a sorted pass.

    A micro-batch is sorted by (ts, seq) per link. W7: with ``lateness_s`` a packet that is older than the latest event
    of its link by more gets the outcome ``late`` and changes nothing. With a time to live, timers evict idle buffers
    when the watermark passes them, and packets behind the watermark are ``late``, too: the time goes on as a number, so
    Spark follows the watermark but drops no row. Every packet comes out, late ones for ``sources.write_two_sinks``.
    """
    timed = limits.ttl_s is not None
    rows = log.withWatermark("ts", watermark) if timed else log
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LINK], "seq", "kind", "size", F.unix_micros("ts").alias("at_us"))
    return _dealt(rows, LINK, buckets).transformWithStateInPandas(LinkProcessor(limits, lateness_s), outputStructType=FATES, outputMode="Append", timeMode="EventTime" if timed else "None")


class HeartbeatProcessor(StatefulProcessor):
    """W6 of one link: when its next heartbeat is due. A timer for that instant repeats itself while the link is open."""

    def __init__(self, every_us: int):
        self.every = every_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "latest long, due long, timer long")

    def _missed(self, key: tuple, due: int, end: int) -> Iterator[pd.DataFrame]:
        """What was due from ``due`` on and before ``end``, in frames of bounded size."""
        step = self.every * STRETCH
        for start in range(due, end, step):
            ticks = pd.Series(range(start, min(start + step, end), self.every), dtype="int64")
            yield pd.DataFrame({**dict(zip(LINK, key, strict=True)), "due": pd.to_datetime(ticks, unit="us")})

    def _after(self, due: int, end: int) -> int:
        """The first instant from ``due`` on in steps of a heartbeat that isn't before ``end``."""
        return due if due >= end else due - (due - end) // self.every * self.every

    def _save(self, latest: int, due: int | None, timer: int) -> None:
        new = due // 1000 + 1 if due is not None else -1
        if timer >= 0 and timer != new:
            self.handle.deleteTimer(timer)
        if due is None:
            self.wait.clear()
            return
        if timer != new:
            self.handle.registerTimer(new)
        self.wait.update((latest, due, new))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, due, timer = self.wait.get() if self.wait.exists() else (None, None, -1)
        batch = pd.concat(list(rows)).sort_values(["at_us", "seq"])
        for kind, at in zip(batch["kind"], batch["at_us"].astype("int64").tolist(), strict=True):
            if due is None:
                latest, due = (at, at + self.every) if kind == "connect" else (latest, None)
            elif at >= latest:
                yield from self._missed(key, due, at)
                # the timer may have told of more than this event, if it is late
                latest, due = at, None if kind == "disconnect" else max(at + self.every, due)
        self._save(latest, due, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.wait.exists():
            latest, due, _ = self.wait.get()
            end = timerValues.getCurrentWatermarkInMs() * 1000
            yield from self._missed(key, due, end)
            self._save(latest, self._after(due, end), -1)


def stream_missed_heartbeats(events: DataFrame, every_s: float = 10, *, watermark: str = "10 minutes") -> DataFrame:
    """The streaming form of ``buffering.missed_heartbeats``: namespace, run, step, due, told once the watermark passes it.

    The state of an open link is three numbers, that of a closed one none. A micro-batch is sorted by (ts, seq) per link.
    Events older than the last one of their open link change nothing, and what was told isn't taken back.
    """
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LINK]
    rows = events.withWatermark("ts", watermark).where("kind IN ('connect', 'disconnect', 'heartbeat')").select(*keys, "seq", "kind", F.unix_micros("ts").alias("at_us"))
    return rows.groupBy(*LINK).transformWithStateInPandas(HeartbeatProcessor(round(every_s * 1e6)), outputStructType=MISSED, outputMode="Append", timeMode="EventTime")


def read_log(spark: SparkSession, path: str, *, max_bytes: int = 256 << 20, **options: str) -> DataFrame:
    """A stream over log files; a micro-batch takes files of at most ``max_bytes`` (or one), which bounds a link's rows in it.

    Batches follow the files' times, so a link's files must be written in the order of its events, or be one file.
    """
    return spark.readStream.schema(LOG).options(**({"maxBytesPerTrigger": str(max_bytes)} if "maxFilesPerTrigger" not in options else {}) | options).parquet(path)


def with_watermark(packets: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """W7. Bounds the state of windowed metrics over a stream; a time without zone becomes an instant first."""
    return packets.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
