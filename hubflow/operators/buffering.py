"""Links as tables: sessions, admission to bounded buffers, flush and eviction.

A *log* has one row per event: namespace, run, step, ts, seq, kind, size. Kinds are connect, disconnect, packet, send_failed
(a packet whose send over an open link failed: it waits in the buffer) and flush_failed (a flush that ended after ``size``
messages: the others stay buffered, in order).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.names import LIMITS, MIB, NAMES, Limits, Names
from hubflow.operators.links import REFUSED, SENT, Link
from hubflow.operators.ranges import LINK, carried
from hubflow.sources import stored

#: Waiting packets of a (link, connect_no) from which on its admissions are searched for instead of folded in order.
HOT = 1_000_000
#: Most heartbeats of a session that are made from one row.
STRETCH = 4096
FATES = "namespace string, run string, step string, seq long, event string, at timestamp, outcome string, buffer_size int, buffer_bytes long, cause long"


def link_log(packets: DataFrame, link_events: DataFrame, size: str | Column = "size") -> DataFrame:
    """Packets and link events as one log."""
    sent = packets.select(*LINK, "ts", "seq", F.lit("packet").alias("kind"), (F.col(size) if isinstance(size, str) else size).cast("long").alias("size"))
    return sent.unionByName(link_events.select(*LINK, "ts", "seq", "kind", F.lit(None).cast("long").alias("size")))


def link_sessions(link_events: DataFrame) -> DataFrame:
    """W1. One interval per connect: started_at, ended_at (the next event of the link, null: open), replaced (by a connect)."""
    rows = carried(link_events, "ts", {"after": ("next", F.struct("ts", "kind"))})
    return rows.where("kind = 'connect'").select(*LINK, "seq", F.col("ts").alias("started_at"), F.col("after.ts").alias("ended_at"), F.coalesce(F.col("after.kind") == "connect", F.lit(False)).alias("replaced"))


def with_connection(log: DataFrame) -> DataFrame:
    """Adds to the log's packets and partial flushes: connect_no (connects before), connected, next_connect (time of the next one).

    ``connected`` is false for a packet whose send failed.
    """
    is_connect = F.col("kind") == "connect"
    rows = carried(log, "ts", {
        "connect_no": ("count", F.when(is_connect, 1)),
        "connected": ("last", F.when(F.col("kind").isin("connect", "disconnect"), is_connect)),
        "next_connect": ("next", F.when(is_connect, F.col("ts"))),
    })
    return rows.where("kind IN ('packet', 'send_failed', 'flush_failed')").withColumn("connected", F.coalesce("connected", F.lit(False)) & (F.col("kind") != "send_failed"))


def admit_equal(waiting: DataFrame, max_messages: int = 100) -> DataFrame:
    """W3 for packets of one size within the byte limit: the first ``max_messages`` of each (link, connect_no) are buffered.

    Partial flushes, which make room, need ``admit_bounded``: such a row ends the job.
    """
    n = F.row_number().over(Window.partitionBy(*LINK, "connect_no").orderBy("ts", "seq"))
    if "kind" in waiting.columns:
        n = F.when(F.col("kind") == "flush_failed", F.raise_error(F.lit("partial flushes need max_bytes"))).otherwise(n)
    return waiting.withColumn("outcome", F.when(n <= max_messages, "buffered").otherwise("buffer_full"))


def admit_bounded(waiting: DataFrame, max_messages: int = 100, max_bytes: int = 10 * MIB, hot: int = HOT) -> DataFrame:
    """W3. Adds outcome to rows of (link, connect_no, ts, seq, size): oversize, buffer_full or buffered, in that order of checks.

    Admission is greedy, so a refused packet doesn't block a later smaller one and no prefix sum can decide it. Rows
    are dealt by (link, connect_no), sorted, and folded in a stream: the state is the sizes of the packets in the buffer,
    at most ``max_messages``, so a group may be of any size. All columns pass through. Groups of more than ``hot`` rows
    are read by all tasks, in rounds, with the same outcomes (see ``_searched``). Null sizes are 0; none is negative.
    """
    return _admit(waiting, max_messages, max_bytes, hot).drop("flushed_at")


def _same(keys: list[str]) -> Column:
    """Rows of one group, null keys included; the other side's keys begin with ``admit_``."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"admit_{k}")) for k in keys])


def _admit(waiting: DataFrame, max_messages: int, max_bytes: int, hot: int) -> DataFrame:
    """``_fold``, with large groups by ``_searched``. A large group with partial flushes stays one ordered pass, as they make room again."""
    keys = [*LINK, "connect_no"]
    flushes = F.count_if(F.col("kind") == "flush_failed") if "kind" in waiting.columns else F.sum(F.lit(0))
    sizes = waiting.groupBy(*keys).agg(F.count("*").alias("n"), flushes.alias("flushes"))
    large = stored(sizes.where(f"n > {hot} AND flushes = 0").select(*[F.col(k).alias(f"admit_{k}") for k in keys]), "large")
    if large.isEmpty():
        return _fold(waiting, max_messages, max_bytes)
    rest = _fold(waiting.join(large, _same(keys), "left_anti"), max_messages, max_bytes)
    return rest.unionByName(_searched(waiting.join(large, _same(keys), "left_semi"), max_messages, max_bytes))


def _searched(waiting: DataFrame, max_messages: int, max_bytes: int) -> DataFrame:
    """``_fold`` for groups without partial flushes that are too large for one task.

    At most ``max_messages`` packets of a group are ever admitted, and the room in its buffer only shrinks. So a packet
    larger than the room is refused for good, and only the first few that fit matter next. A round finds these in all
    tasks (each passes on its own first few of a group), folds them after those admitted so far, and goes on behind the
    last one with the room that is left. The first that fits is always admitted, so there are at most ``max_messages``
    rounds; buffers that fill up at once take one or two.
    """
    keys, columns, order = [*LINK, "connect_no"], waiting.columns, ("ts", "seq", "admit_id")
    rows = stored(waiting.withColumn("admit_id", F.monotonically_increasing_id()), "waiting")
    size, take = F.coalesce("size", F.lit(0)), min(2 * max_messages + 1, 1000)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    admitted, fitting = None, rows.where(size <= max_bytes)
    while True:
        found = stored(fitting.select(*keys, *order, size.cast("long").alias("size")).withColumn("nth", nth).where(f"nth <= {take}").drop("nth"), "found")
        judged = _fold(found if admitted is None else admitted.unionByName(found), max_messages, max_bytes, order)
        admitted = stored(judged.where("outcome = 'buffered'").drop("outcome", "flushed_at"), "admitted")
        both = found.select(*keys, F.struct(*order).alias("at"), F.lit(None).cast("long").alias("size")).unionByName(admitted.select(*keys, F.lit(None).alias("at"), "size"))
        ends = both.groupBy(*[F.col(k).alias(f"admit_{k}") for k in keys]).agg(F.count("at").alias("admit_seen"), F.max("at").alias("admit_last"), F.count("size").alias("admit_n"), (max_bytes - F.coalesce(F.sum("size"), F.lit(0))).alias("admit_room"))
        ends = stored(ends.where(f"admit_seen = {take} AND admit_n < {max_messages}"), "ends")
        if ends.isEmpty():
            break
        fitting = rows.join(ends, _same(keys)).where((F.struct(*order) > F.col("admit_last")) & (size <= F.col("admit_room")))
    out = F.when(F.col("admit_in"), "buffered").when(size > max_bytes, "oversize").otherwise("buffer_full")
    marked = rows.join(admitted.select("admit_id", F.lit(True).alias("admit_in")), "admit_id", "left")
    return marked.select(*columns, out.alias("outcome"), F.lit(None).cast("timestamp").alias("flushed_at"))


def _fold(waiting: DataFrame, max_messages: int, max_bytes: int, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``admit_bounded`` with partial flushes (rows whose kind is flush_failed, which go): adds outcome and flushed_at."""
    keys, columns, kinds = [*LINK, "connect_no"], waiting.columns, "kind" in waiting.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows whose fate is open: the buffered ones of the group at hand, in order, with their sizes
        group, held, total, open_ = None, [], 0, None
        for batch in batches:
            rows = pa.Table.from_batches([*(open_.to_batches() if open_ is not None else []), batch])
            before = len(rows) - batch.num_rows
            outcomes, flushed, held = ["buffered"] * before, [None] * before, [(i, size) for i, (_, size) in enumerate(held)]
            kind = batch.column("kind").to_pylist() if kinds else ["packet"] * batch.num_rows
            for i, (*key, size, ts, what) in enumerate(zip(*[batch.column(k).to_pylist() for k in (*keys, "size")], batch.column("ts"), kind, strict=True), before):
                if key != group:
                    group, held, total = key, [], 0
                size, out = size or 0, None
                if what == "flush_failed":
                    for j, s in held[:size]:
                        flushed[j], total = ts.as_py(), total - s
                    held = held[size:]
                elif size > max_bytes:
                    out = "oversize"
                elif len(held) >= max_messages or total + size > max_bytes:
                    out = "buffer_full"
                else:
                    held.append((i, size))
                    total, out = total + size, "buffered"
                outcomes.append(out)
                flushed.append(None)
            waits = [i for i, _ in held]
            gone = [i for i in range(len(rows)) if outcomes[i] is not None and i not in set(waits)] if waits else [i for i, o in enumerate(outcomes) if o is not None]
            yield from _decided(rows, gone, outcomes, flushed)
            open_ = rows.take(pa.array(waits, pa.int64()))
        if open_ is not None:
            n = len(open_)
            yield from _decided(open_, list(range(n)), ["buffered"] * n, [None] * n)

    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    return waiting.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{layout}, outcome string, flushed_at timestamp").select(*columns, "outcome", "flushed_at")


def _decided(rows: pa.Table, which: list[int], outcomes: list, flushed: list) -> Iterator[pa.RecordBatch]:
    part = rows.take(pa.array(which, pa.int64()))
    part = part.append_column("outcome", pa.array([outcomes[i] for i in which], pa.string()))
    yield from part.append_column("flushed_at", pa.array([flushed[i] for i in which], pa.timestamp("us", "UTC"))).combine_chunks().to_batches()


def send_or_buffer(log: DataFrame, max_messages: int = 100, max_bytes: int | None = 10 * MIB, hot: int = HOT) -> DataFrame:
    """W2, W4 without eviction. One row per packet: outcome, delivered_at, next_connect, connect_no.

    Connected packets are delivered at once. Others, and those whose send failed, are admitted to the buffer of their
    (link, connect_no) and delivered by a partial flush that takes them, or else at the next connect, if one comes.
    ``max_bytes`` None: sizes don't matter, and no Python is run.
    """
    rows = with_connection(log)
    direct = rows.where("connected AND kind = 'packet'").withColumns({"outcome": F.lit("delivered"), "flushed_at": F.lit(None).cast("timestamp")})
    waiting = rows.where("NOT (connected AND kind = 'packet')")
    held = admit_equal(waiting, max_messages).withColumn("flushed_at", F.lit(None).cast("timestamp")) if max_bytes is None else _admit(waiting, max_messages, max_bytes, hot)
    at = F.when(F.col("outcome") == "delivered", F.col("ts")).when(F.col("outcome") == "buffered", F.coalesce("flushed_at", "next_connect"))
    return direct.unionByName(held).withColumn("delivered_at", at).drop("connected", "kind", "flushed_at")


def flush_on_connect(fates: DataFrame) -> DataFrame:
    """W4. One row per connect or partial flush that delivered buffered packets: link, connect_no (of the waiting packets), flushed_at, flushed."""
    return fates.where("outcome = 'buffered' AND delivered_at IS NOT NULL").groupBy(*LINK, "connect_no", F.col("delivered_at").alias("flushed_at")).agg(F.count("*").alias("flushed"))


def link_fates(log: DataFrame, limits: Limits = LIMITS, until: str | None = None) -> DataFrame:
    """W2 to W5 in one ordered pass per link: the ``sent`` row of every packet, a ``left`` row for every packet that leaves a buffer.

    Eviction feeds back on admission, so it needs the pass: a buffer that is idle for longer than ``limits.ttl_s`` is
    dropped at the next tick of the grid ``tick_origin_s + k x every_s``. ``until`` (a timestamp) is when the last ticks
    are looked at. Rows are dealt by link and sorted; the state of one link, at most ``max_messages`` (seq, size) pairs,
    is all that a task keeps.
    """
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LINK]
    rows = log.select(*keys, "ts", "seq", "kind", "size").repartition(*LINK).sortWithinPartitions(*LINK, "ts", "seq")
    end = log.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '{until}')").first()[0] if until else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, link, out = None, Link(limits), []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 10
            out.clear()
            kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FATES.split(", ")])

        def tell(events: Iterator[tuple]) -> None:
            out.extend((*key, seq, event, at, outcome, n, total, cause) for event, seq, at, outcome, n, total, cause in events)

        for batch in batches:
            stamps = batch.column("ts").cast(pa.int64()).to_pylist()
            for *this, seq, kind, size, at in zip(*[batch.column(c).to_pylist() for c in (*LINK, "seq", "kind", "size")], stamps, strict=True):
                if this != key:
                    if key is not None and end is not None:
                        tell(link.evict(end))
                    key, link = this, Link(limits)
                tell(link.handle(kind, seq, at, size))
            yield made()
        if key is not None and end is not None:
            tell(link.evict(end))
        yield made()

    return rows.mapInArrow(run, FATES)


def evict_idle(fates: DataFrame) -> DataFrame:
    """W5. The packets that were lost with an idle buffer."""
    return fates.where("event = 'left' AND outcome = 'evicted'")


def heartbeat_grid(sessions: DataFrame, every: str = "10 seconds", until: str | Column | None = None) -> DataFrame:
    """W6. The heartbeats to expect: one row per tick of each session, from one interval after its start.

    ``every`` is a number of days or less. The end of an open session is ``until``. Anti-join with observed heartbeats to
    find gaps. Ticks are made in stretches of at most ``STRETCH``, so a session of any length takes little memory.
    """
    end = F.coalesce(F.col("ended_at"), F.lit(until).cast("timestamp") if isinstance(until, str) else until if until is not None else F.col("ended_at"))
    start, step = F.unix_micros("started_at"), F.expr(f"unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {every})")
    # ticks k = 1, 2, ... with start + k x step < end
    rows = sessions.select(*LINK, start.alias("start"), step.alias("every"), F.unix_micros(end).alias("end"))
    rows = rows.withColumn("n", F.expr("(end - start - 1) div every")).where("n > 0")
    parts = rows.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRETCH})")))
    ticks = parts.withColumn("k", F.explode(F.expr(f"sequence(part * {STRETCH} + 1, least(n, (part + 1) * {STRETCH}))")))
    return ticks.select(*LINK, F.timestamp_micros(F.col("start") + F.col("k") * F.col("every")).alias("tick"))


def heartbeat_rows(sessions: DataFrame, every: str = "10 seconds", until: str | Column | None = None, names: Names = NAMES) -> DataFrame:
    """W6. The same ticks as packets: heartbeat metadata and an empty payload."""
    meta = F.create_map(F.lit(names.heartbeat), F.lit("true"))
    return heartbeat_grid(sessions, every, until).select("namespace", "run", F.col("step").alias("step_id"), F.col("tick").alias("ts"), meta.alias("metadata"), F.lit("{}").alias("payload"))


def missed_heartbeats(events: DataFrame, every: str = "10 seconds", until: str | Column | None = None) -> DataFrame:
    """W6. One row per heartbeat that was due on an open link and didn't come: link, due.

    ``events``: namespace, run, step, ts, seq, kind (connect, disconnect, heartbeat; other kinds are ignored). One is due
    ``every`` after the connect, the last heartbeat or the last one missed, and missed if the link's next event is later.
    A heartbeat on a closed link opens nothing. What is due after a link's last event counts up to ``until`` (null: not at
    all). Only what was missed becomes rows: no grid is joined with the heartbeats.
    """
    kind = F.col("kind")
    rows = carried(events.where(kind.isin("connect", "disconnect", "heartbeat")), "ts", {
        "after": ("next", F.col("ts")),
        "open": ("last", F.when(kind.isin("connect", "disconnect"), kind == "connect")),
    })
    waits = rows.where("open").select(*LINK, F.col("ts").alias("started_at"), F.col("after").alias("ended_at"))
    return heartbeat_grid(waits, every, until).withColumnRenamed("tick", "due")


def sample_drop_warnings(fates: DataFrame, every: int = 100) -> DataFrame:
    """F14. The first, 101st, 201st ... refused packet of each link, with its running number and reason."""
    drops = fates.where(F.col("outcome").isin(*REFUSED))
    at = "ts" if "ts" in fates.columns else "at"
    numbered = carried(drops, at, {"dropped_total": ("count", F.lit(1))})
    return numbered.where(F.col("dropped_total") % every == 1).select(*LINK, "seq", "dropped_total", F.col("outcome").alias("reason"))


def sent_rows(fates: DataFrame) -> DataFrame:
    return fates.where(F.col("event") == SENT)
