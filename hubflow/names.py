"""Names and limits that a deployment can set; every operator that uses one takes it as an argument."""

from __future__ import annotations

from dataclasses import dataclass

# Keys of a stream's identity and the text of each missing one, in the order in which they are checked.
IDENTITY_KEYS = ("storyrun-name", "storyrun-namespace", "current-step-id")
UPSTREAM, DOWNSTREAM = "UPSTREAM_HOST", "DOWNSTREAM_HOST"
#: Kinds of steps that a hub carries out between two workers.
HUB_PRIMITIVES = ("transform", "filter", "set-data", "merge-data", "condition")

MIB = 1 << 20


@dataclass(frozen=True)
class Names:
    """Keys that carry a deployment's own prefix."""

    heartbeat: str = "hub-heartbeat"
    transport: str = "hub/transport"
    hub_service: str = "hub"
    label_prefix: str = "hub/"


@dataclass(frozen=True)
class Limits:
    """Bounds of a link's buffer. ``ttl_s`` None: idle buffers stay."""

    max_messages: int = 100
    max_bytes: int = 10 * MIB
    ttl_s: float | None = None
    every_s: float = 60.0
    tick_origin_s: float = 0.0


NAMES, LIMITS = Names(), Limits()
