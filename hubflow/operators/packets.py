"""Checks and projections of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions import inputs_json
from hubflow.names import IDENTITY_KEYS, MIB


def identity_error(metadata: str = "stream_metadata") -> Column:
    """The text of the first missing part of a stream's identity, null if none is missing."""
    m = F.col(metadata)
    out = F.when(m.isNull(), F.lit("missing metadata"))
    for key in IDENTITY_KEYS:
        out = out.when(F.coalesce(F.get(m[key], F.lit(0)), F.lit("")) == "", F.lit(f"missing {key} metadata"))
    return out


def validate_identity(df: DataFrame, metadata: str = "stream_metadata") -> DataFrame:
    """F1. Adds run, namespace, step_id (first values) and identity_error from ``MAP<STRING,ARRAY<STRING>>``."""
    m = F.col(metadata)
    values = {out: F.get(m[key], F.lit(0)) for out, key in zip(("run", "namespace", "step_id"), IDENTITY_KEYS, strict=True)}
    return df.withColumns(values | {"identity_error": identity_error(metadata)})


def forward_packet(df: DataFrame, payload: Column) -> DataFrame:
    """F8. Metadata and inputs stay, the payload is replaced."""
    return df.withColumn("payload", payload)


def inputs_size(inputs: str | Column = "inputs") -> Column:
    return F.octet_length(inputs_json(inputs))


def check_inputs_size(df: DataFrame, max_bytes: int = MIB) -> DataFrame:
    """F9. Adds inputs_error where the JSON of the inputs is longer than the limit."""
    n = inputs_size()
    text = F.format_string(f"packet inputs size %d exceeds limit {max_bytes}", n)
    return df.withColumn("inputs_error", F.when(n > max_bytes, text))


def resolve_inputs(df: DataFrame, static: str = "target_with") -> DataFrame:
    """F10. Adds step_input and inputs_resolved: the packet's inputs, else the step's static ones, else null."""
    own = F.col("inputs").isNotNull()
    return df.withColumns({"step_input": F.when(own, inputs_json("inputs")).otherwise(F.col(static)), "inputs_resolved": own})


def session_deadline(packets: DataFrame, sessions: DataFrame, timeout: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """F11. Keeps packets that come before their session's start plus ``timeout``.

    ``sessions``: namespace, run, step_id, session_id, started_at; ``packets`` has session_id, so the join is by equality.
    Over two streams a packet joins the sessions that began at most ``timeout`` before it, so the state of either side
    ends once the watermarks (``watermark`` behind the latest times) are past; there no packet is older than its session.
    """
    s = sessions.select(F.col("session_id").alias("of_session"), "started_at")
    if packets.isStreaming and sessions.isStreaming:
        packets, s = packets.withWatermark("ts", watermark), s.withWatermark("started_at", watermark)
    on = (F.col("session_id") == F.col("of_session")) & (F.col("ts") < F.col("started_at") + F.expr(f"INTERVAL {timeout}"))
    if packets.isStreaming and sessions.isStreaming:
        on = on & (F.col("ts") >= F.col("started_at"))
    return packets.join(s, on).drop("of_session")


def max_message_filter(df: DataFrame, size: str | Column, recv_max: int = 10 * MIB, send_max: int = 10 * MIB) -> DataFrame:
    """F15. Keeps packets within both limits."""
    return df.where((F.col(size) if isinstance(size, str) else size) <= min(recv_max, send_max))
