"""The state machine of one link: connect, send, buffer, flush, evict. Used by the batch and the streaming form alike."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from hubflow.names import Limits

#: One row per packet: what became of it when it was sent, and the buffer after that.
SENT = "sent"
#: One row per buffered packet that left its buffer (delivered or evicted).
LEFT = "left"
#: Outcomes of a packet that its link refused.
REFUSED = ("oversize", "buffer_full")


@dataclass
class Link:
    """Times are microseconds. ``held`` has (seq, size) of buffered packets in order.

    Methods give (event, seq, at, outcome, buffer size, buffer bytes, cause): the buffer is that after the event, and the
    cause is the number of the log's row, None for an eviction.
    """

    limits: Limits
    connected: bool = False
    held: list[tuple[int, int]] = field(default_factory=list)
    total: int = 0
    dropped: int = 0
    last_active: int | None = None  # None: no buffer

    def evict_due(self) -> int | None:
        """The first tick at which the buffer has been idle for longer than its time to live."""
        if self.limits.ttl_s is None or self.last_active is None:
            return None
        every, origin = round(self.limits.every_s * 1e6), round(self.limits.tick_origin_s * 1e6)
        ends = self.last_active + round(self.limits.ttl_s * 1e6)
        return origin + (math.floor((ends - origin) / every) + 1) * every

    def evict(self, now: int) -> Iterator[tuple]:
        """Drops the buffer if a tick up to ``now`` found it idle."""
        due = self.evict_due()
        if due is not None and due <= now:
            yield from ((LEFT, seq, due, "evicted", 0, 0, None) for seq, _ in self.held)
            self.held, self.total, self.last_active = [], 0, None

    def connect(self, now: int, cause: int | None = None) -> Iterator[tuple]:
        """Delivers what is buffered, oldest first, and removes the buffer."""
        yield from self.evict(now)
        self.connected = True
        yield from ((LEFT, seq, now, "delivered", 0, 0, cause) for seq, _ in self.held)
        self.held, self.total, self.last_active = [], 0, None

    def flush_in_part(self, now: int, sent: int, cause: int | None = None) -> Iterator[tuple]:
        """A flush that ends after ``sent`` messages, by a failed send or a cancelled session: what is left stays, in order."""
        yield from self.evict(now)
        out, self.held = self.held[:sent], self.held[sent:]
        self.total -= sum(size for _, size in out)
        yield from ((LEFT, seq, now, "delivered", len(self.held), self.total, cause) for seq, _ in out)
        if out:
            self.last_active = now

    def disconnect(self, now: int) -> Iterator[tuple]:
        yield from self.evict(now)
        self.connected = False

    def send(self, seq: int, now: int, size: int, fails: bool = False) -> Iterator[tuple]:
        """A packet over an open link is delivered; without one, or where its send ``fails``, it waits if there is room."""
        yield from self.evict(now)
        if self.connected and not fails:
            # an open link can have a buffer that a failed send began
            yield SENT, seq, now, "delivered", len(self.held), self.total, seq
            return
        if self.last_active is None:
            self.last_active = now  # a refused packet makes a buffer, too
        if size > self.limits.max_bytes:
            outcome = "oversize"
        elif len(self.held) >= self.limits.max_messages or self.total + size > self.limits.max_bytes:
            outcome = "buffer_full"
        else:
            outcome = "buffered"
            self.held.append((seq, size))
            self.total += size
            self.last_active = now
        self.dropped += outcome != "buffered"
        yield SENT, seq, now, outcome, len(self.held), self.total, seq

    def handle(self, kind: str, seq: int, now: int, size: int | None) -> Iterator[tuple]:
        if kind == "connect":
            return self.connect(now, seq)
        if kind == "disconnect":
            return self.disconnect(now)
        if kind == "flush_failed":
            return self.flush_in_part(now, size or 0, seq)
        return self.send(seq, now, size or 0, kind == "send_failed")
