"""Counters, gauges and histograms as aggregates. ``window`` adds tumbling windows, which bound the state of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.functions import is_heartbeat
from hubflow.names import IDENTITY_KEYS, LIMITS, NAMES, Limits, Names

#: Upper bounds of duration buckets in seconds; the last has no bound.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _by(keys: Sequence[str | Column], window: str | None, ts: str) -> list:
    return [*keys, *([F.window(ts, window).alias("window")] if window else [])]


def messages_received(packets: DataFrame, *, window: str | None = None, ts: str = "ts", names: Names = NAMES) -> DataFrame:
    """A1. Packets by sender (run, step), heartbeats excluded, counted before any decision."""
    return packets.where(~is_heartbeat("metadata", names)).groupBy(*_by(["run", F.col("step_id").alias("step")], window, ts)).agg(F.count("*").alias("messages"))


def messages_sent(delivered: DataFrame, *, window: str | None = None, ts: str = "ts") -> DataFrame:
    """A2. Deliveries by the packet's own metadata, if both keys are there and not empty."""
    run, step = (F.coalesce(F.col("metadata")[k], F.lit("")) for k in (IDENTITY_KEYS[0], IDENTITY_KEYS[2]))
    return delivered.where((run != "") & (step != "")).groupBy(*_by([run.alias("run"), step.alias("step")], window, ts)).agg(F.count("*").alias("messages"))


def messages_dropped(outcomes: DataFrame, *, window: str | None = None, ts: str = "ts") -> DataFrame:
    """A3. Refused packets by link and reason."""
    return outcomes.where(F.col("outcome").isin("oversize", "buffer_full")).groupBy(*_by(["run", "step", F.col("outcome").alias("reason")], window, ts)).agg(F.count("*").alias("messages"))


def buffer_flushed(flushes: DataFrame, *, window: str | None = None, ts: str = "flushed_at") -> DataFrame:
    """A4. Sum of flushed packets by link; flushes of nothing don't count."""
    return flushes.where("flushed > 0").groupBy(*_by(["run", "step"], window, ts)).agg(F.sum("flushed").alias("messages"))


def buffer_gauges(fates: DataFrame) -> DataFrame:
    """A5, A6. Last buffer size and bytes by link, after adds (refused ones too), flushes (partial ones too) and evictions."""
    rows = fates.where((F.col("event") == "left") | (F.col("outcome") != "delivered"))
    # what a tick evicted comes before the event that found it
    last = F.max(F.struct("at", "cause", F.col("buffer_size").alias("n"), F.col("buffer_bytes").alias("b")))
    return rows.groupBy("run", "step").agg(last.alias("x")).select("run", "step", F.col("x.n").alias("buffer_size"), F.col("x.b").alias("buffer_bytes"))


def buffer_limits(spark: SparkSession, limits: Limits = LIMITS) -> DataFrame:
    """A7. The configured caps as one row."""
    return spark.range(1).select(F.lit(limits.max_messages).alias("max_messages"), F.lit(limits.max_bytes).cast("long").alias("max_bytes"))


def utilisation(gauges: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """A7 over A5 and A6."""
    return gauges.select("run", "step", (F.col("buffer_size") / F.lit(limits.max_messages)).alias("messages_used"), (F.col("buffer_bytes") / F.lit(limits.max_bytes)).alias("bytes_used"))


def rpc_totals(calls: DataFrame) -> DataFrame:
    """A8. Calls by method and code, OK included."""
    return calls.groupBy("method", "code").agg(F.count("*").alias("calls"))


def rpc_duration_histogram(calls: DataFrame, buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """A9. Per method, code and upper bound ``le`` (text, +Inf last): cumulative count; and the sum and count of all.

    One pass with a conditional count per bucket; rows are multiplied only after the aggregate.
    """
    d = F.col("duration_s")
    counts = [F.count_if(d <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    rows = calls.groupBy("method", "code").agg(*counts, F.count(d).alias("count"), F.sum(d).alias("sum"))
    ends = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    return rows.select("method", "code", F.explode(F.array(*ends, F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))).alias("x"), "count", "sum").select("method", "code", "x.*", "count", "sum")


def scale_signal(by_pod: DataFrame, target: int = 50, low: int = 2, high: int = 10) -> DataFrame:
    """A10. Mean buffer size over pods against the target, and the replicas that it suggests."""
    mean = F.avg("buffer_size")
    return by_pod.agg(mean.alias("mean_buffer"), F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(F.count("*") * mean / target))).cast("int").alias("replicas"))


def dropped_count(fates: DataFrame) -> DataFrame:
    """A11. Per link the refused packets of any reason and the buffered ones."""
    return fates.groupBy("run", "step").agg(F.count_if(F.col("outcome").isin("oversize", "buffer_full")).alias("dropped"), F.count_if(F.col("outcome") == "buffered").alias("buffered"))
