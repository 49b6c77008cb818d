"""Scalar functions over columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubflow.names import HUB_PRIMITIVES, NAMES, Names


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate_size(metadata: str | Column, has_payload: str | Column, packet: str | Column | None = None) -> Column:
    """X1. Bytes of the metadata's keys and values, and 1024 for a payload; 0 for a null packet (where ``packet`` is given)."""
    pairs = F.aggregate(F.map_entries(_c(metadata)), F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(F.coalesce(e["value"], F.lit(""))))
    size = F.coalesce(pairs, F.lit(0)) + F.when(_c(has_payload), 1024).otherwise(0)
    return size if packet is None else F.when(_c(packet).isNull(), F.lit(0).cast("long")).otherwise(size)


def _varint(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


def _framed(n: int) -> int:
    """A length-delimited field of n bytes with a field number below 16."""
    return 1 + _varint(n) + n


def _value_size(x: object) -> int:
    """Encoded size of a dynamic value; a number is a double, whatever its value."""
    if isinstance(x, dict):
        return _framed(_struct_size(x))
    if isinstance(x, list):
        return _framed(sum(_framed(_value_size(y)) for y in x))
    if isinstance(x, str):
        return _framed(len(x.encode("utf-8", "surrogatepass")))
    return 9 if isinstance(x, int | float) and not isinstance(x, bool) else 2


def _struct_size(x: dict) -> int:
    return sum(_framed(_framed(len(k.encode("utf-8", "surrogatepass"))) + _framed(_value_size(v))) for k, v in x.items())


@F.pandas_udf(T.LongType())
def json_struct_size(texts: pd.Series) -> pd.Series:
    """Encoded size of JSON objects as a packet field; 0 for null, for what is no object and for values nested too deep to parse."""

    def size(t: str | None) -> int:
        try:
            x = json.loads(t) if t is not None else None
            return _framed(_struct_size(x)) if isinstance(x, dict) else 0
        except (ValueError, RecursionError):
            return 0

    return texts.map(size).astype("int64")


def _framed_length(n: Column) -> Column:
    digits = F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
    return n + digits + 1


def wire_size(metadata: str | Column, payload: str | Column, inputs: str | Column) -> Column:
    """X2. Exact encoded size of a packet; the map in closed form, the dynamic parts in Arrow batches."""

    def pair(e: Column) -> Column:
        return _framed_length(_framed_length(F.octet_length(e["key"])) + _framed_length(F.octet_length(F.coalesce(e["value"], F.lit("")))))

    pairs = F.aggregate(F.map_entries(_c(metadata)), F.lit(0).cast("long"), lambda n, e: n + pair(e))
    return F.coalesce(pairs, F.lit(0)) + json_struct_size(_c(payload)) + json_struct_size(_c(inputs))


def service_host(name: str | Column, namespace: str | Column) -> Column:
    """X3. Address of a worker's service."""
    return F.concat(_c(name), F.lit("."), _c(namespace), F.lit(".svc.cluster.local"))


def hub_host(namespace: str | Column, names: Names = NAMES) -> Column:
    """X3. Address of the hub's service in a namespace."""
    return service_host(F.lit(names.hub_service), namespace)


def step_run_name(run: str | Column, step: str | Column, ts: str | Column) -> Column:
    """X4."""
    return F.concat_ws("-", _c(run), _c(step), F.unix_millis(_c(ts)).cast("string"))


def inputs_json(inputs: str | Column) -> Column:
    """X5. JSON with sorted keys; null for null and for malformed JSON."""
    return F.to_json(F.try_parse_json(_c(inputs)))


def env_upsert(env: str | Column, key: str, value: str | Column) -> tuple[Column, Column]:
    """X6. (changed, new map): an equal value changes nothing."""
    env, value = _c(env), _c(value)
    changed = ~F.get(F.map_values(F.map_filter(env, lambda k, v: k == key)), F.lit(0)).eqNullSafe(value) | ~F.map_contains_key(env, key)
    return changed, F.map_concat(F.map_filter(env, lambda k, v: k != key), F.create_map(F.lit(key), value))


def env_remove(env: str | Column, key: str) -> tuple[Column, Column]:
    """X6. (changed, new map)."""
    env = _c(env)
    return F.map_contains_key(env, key), F.map_filter(env, lambda k, v: k != key)


def is_heartbeat(metadata: str | Column = "metadata", names: Names = NAMES) -> Column:
    """F2. True only for packets that are marked so; false without metadata."""
    return F.get(F.map_values(F.map_filter(_c(metadata), lambda k, v: k == names.heartbeat)), F.lit(0)).eqNullSafe(F.lit("true"))


def step_key(id_: str | Column = "id", name: str | Column = "name") -> Column:
    """F3. The id, or the name where the id is empty."""
    return F.coalesce(F.nullif(_c(id_), F.lit("")), _c(name))


def is_hub_primitive(kind: str | Column, kinds: tuple[str, ...] = HUB_PRIMITIVES) -> Column:
    """F12. Kinds of steps that a hub carries out."""
    return F.coalesce(_c(kind).isin(*kinds), F.lit(False))


def link_key(run: str | Column = "run", step: str | Column = "step") -> Column:
    """R3."""
    return F.concat_ws("/", _c(run), _c(step))
