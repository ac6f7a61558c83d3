"""Bounded reading of one file: its head and tail from two windows, everything else charged to a budget by purpose."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

KIB = 1024
SNIFF, STRUCTURE, SEARCH, PAYLOAD = "sniff", "structure", "search", "payload"


@dataclass(frozen=True)
class Policy:
    head: int = 64 * KIB
    tail: int = 64 * KIB
    sniff: int = 4 * KIB
    search: int = 256 * KIB
    structure: int = 16 * KIB * KIB
    payload: int = 4 * KIB * KIB  # of one value, and what it may inflate to

    @property
    def ceiling(self) -> int:
        """More than this is never read to analyse a file, however damaged."""
        return self.head + self.tail + self.sniff + self.search + self.structure


class Changed(OSError):
    """The file changed while it was read."""


@dataclass
class Bounded:
    """pull(at, n) reads from the file."""

    length: int
    pull: Callable[[int, int], bytes]
    policy: Policy = Policy()
    refused: set[str] = field(default_factory=set)  # purposes that ran out of budget
    pulled: int = 0

    def __post_init__(self) -> None:
        whole = self.length <= self.policy.head + self.policy.tail
        self._edges = [(0, self.length)] if whole else [(0, self.policy.head), (self.length - self.policy.tail, self.length)]
        self._held: dict[int, bytes] = {}
        self._left = {SNIFF: self.policy.sniff, SEARCH: self.policy.search, STRUCTURE: self.policy.structure}

    def _fetch(self, at: int, n: int) -> bytes:
        data = self.pull(at, n) if n else b""
        if len(data) != n:
            raise Changed("the file changed while it was being read")
        self.pulled += n
        return data

    def affordable(self, purpose: str, at: int, n: int) -> bool:
        inside = at >= 0 <= n and at + n <= self.length
        return inside and (any(a <= at and at + n <= b for a, b in self._edges) or n <= self._left.get(purpose, self.policy.payload))

    def read(self, purpose: str, at: int, n: int) -> bytes | None:
        """n bytes, or None where they lie outside the file or over the budget."""
        if at < 0 or n < 0 or at + n > self.length:
            return None
        for a, b in self._edges:
            if a <= at and at + n <= b:
                if a not in self._held:
                    self._held[a] = self._fetch(a, b - a)
                return self._held[a][at - a : at - a + n]
        if not self.affordable(purpose, at, n):
            self.refused.add(purpose)
            return None
        if purpose in self._left:
            self._left[purpose] -= n
        return self._fetch(at, n)


def in_memory(data: bytes, policy: Policy = Policy()) -> Bounded:
    return Bounded(len(data), lambda at, n: data[at : at + n], policy)


class Stream:
    """Unbounded forward reading in blocks, for hashing; get() gives None past `end`."""

    BLOCK = 256 * KIB

    def __init__(self, pull: Callable[[int, int], bytes], end: int):
        self.pull, self.end, self.at, self.held = pull, end, 0, b""

    def get(self, at: int, n: int) -> bytes | None:
        if at < 0 or at + n > self.end:
            return None
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            want = min(max(n, self.BLOCK), self.end - at)
            self.at, self.held = at, self.pull(at, want)
            if len(self.held) != want:
                raise Changed("the file changed while it was being read")
        return self.held[at - self.at : at - self.at + n]


def crc_table(polynomial: int, bits: int, reflected: bool) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        crc = byte if reflected else byte << bits - 8
        for _ in range(8):
            crc = (crc >> 1) ^ (polynomial if crc & 1 else 0) if reflected else (crc << 1 ^ (polynomial if crc & top else 0)) & mask
        out.append(crc)
    return out


_ARC, _FLAC8, _FLAC16 = crc_table(0xA001, 16, True), crc_table(0x07, 8, False), crc_table(0x8005, 16, False)


def crc16_arc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = crc >> 8 ^ _ARC[(crc ^ b) & 0xFF]
    return crc


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _FLAC8[crc ^ b]
    return crc


def crc16(data: bytes, crc: int = 0) -> int:
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _FLAC16[crc >> 8 ^ b]
    return crc
