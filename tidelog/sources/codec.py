"""Byte formats: segments, dense indexes, offset journals, metadata snapshots, fences, heartbeats and backfill frames."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from ..functions.checksum import crc32c

SEGMENT_MAGIC, INDEX_MAGIC, VERSION = 0x52424B52, 0x52424958, 1
UNSET = -(1 << 63)
HEADER = struct.Struct("<ihiqq")
FRAME = struct.Struct("<iI")


def write_segment(records: Iterable[bytes], first: int = 0, checksums: bool = True) -> bytes:
    records = list(records)
    last = first + len(records) - 1 if records else UNSET
    at = first if records else UNSET
    blank = HEADER.pack(SEGMENT_MAGIC, VERSION, 0, at, last)
    crc = crc32c(blank)
    head = HEADER.pack(SEGMENT_MAGIC, VERSION, crc - (1 << 32) if crc >> 31 else crc, at, last)
    return head + b"".join(FRAME.pack(len(r), crc32c(r) if checksums else 0) + r for r in records)


def read_segment(data: bytes) -> tuple[list[tuple[int, int, bytes]], int]:
    """([(seq, position, payload)], length of the valid part): stops at zero length, torn or corrupt records.

    A stored checksum of 0 is not checked. A damaged header gives no records.
    """
    if len(data) < HEADER.size:
        return [], 0
    magic, version, crc, first, last = HEADER.unpack_from(data)
    if magic != SEGMENT_MAGIC or version != VERSION or crc & 0xFFFFFFFF != crc32c(HEADER.pack(magic, version, 0, first, last)):
        return [], 0
    out, at, seq = [], HEADER.size, 0 if first == UNSET else first
    while at + FRAME.size <= len(data):
        size, crc = FRAME.unpack_from(data, at)
        if size <= 0 or at + FRAME.size + size > len(data):
            break
        payload = data[at + FRAME.size : at + FRAME.size + size]
        if crc and crc != crc32c(payload):
            break
        out.append((seq, at, payload))
        at += FRAME.size + size
        seq += 1
    return out, at


def write_index(positions: list[int]) -> bytes:
    return struct.pack("<ihhii", INDEX_MAGIC, VERSION, 0, len(positions), 0) + struct.pack(f"<{len(positions)}i", *positions)


def read_index(data: bytes, count: int) -> list[int] | None:
    """Record positions; None unless magic, version, size and the expected count agree."""
    if len(data) < 16:
        return None
    magic, version, _, n, _ = struct.unpack_from("<ihhii", data)
    if magic != INDEX_MAGIC or version != VERSION or n != count or len(data) < 16 + 4 * n:
        return None
    return list(struct.unpack_from(f"<{n}i", data, 16))


def write_offset(topic: str, group: str, pid: int, off: int) -> bytes:
    t, g = topic.encode(), group.encode()
    return struct.pack("<i", len(t)) + t + struct.pack("<i", len(g)) + g + struct.pack("<iq", pid, off)


def read_offsets(data: bytes) -> Iterator[tuple[str, str, int, int]]:
    """Journal entries up to the first torn or impossible one."""
    at = 0
    while at + 4 <= len(data):
        parts = []
        for _ in range(2):
            if at + 4 > len(data):
                return
            (n,) = struct.unpack_from("<i", data, at)
            if n < 0 or at + 4 + n > len(data):
                return
            try:
                parts.append(data[at + 4 : at + 4 + n].decode())
            except UnicodeDecodeError:
                return
            at += 4 + n
        if at + 12 > len(data):
            return
        pid, off = struct.unpack_from("<iq", data, at)
        at += 12
        yield parts[0], parts[1], pid, off


def write_metadata(version: int, epochs: list[dict]) -> bytes:
    out = struct.pack(">qi", version, len(epochs))
    for e in epochs:
        out += struct.pack(">qqqqii", e["epoch"], e["start_seq"], e["end_seq"], e["tie_breaker"], e["ack_quorum"], len(e["storage_nodes"]))
        out += struct.pack(f">{len(e['storage_nodes'])}i", *e["storage_nodes"])
    return out


def read_metadata(data: bytes) -> tuple[int, list[dict]]:
    version, n = struct.unpack_from(">qi", data)
    at, out = 12, []
    for _ in range(n):
        epoch, start, end, tie, quorum, r = struct.unpack_from(">qqqqii", data, at)
        at += 40
        out.append({"epoch": epoch, "start_seq": start, "end_seq": end, "tie_breaker": tie, "ack_quorum": quorum, "storage_nodes": list(struct.unpack_from(f">{r}i", data, at))})
        at += 4 * r
    return version, out


def write_fence(sealed_end: int, last: int, sealed: bool) -> bytes:
    return struct.pack(">qq?", sealed_end, last, sealed)


def read_fence(data: bytes) -> tuple[int, int, bool]:
    return struct.unpack(">qq?", data)


def write_heartbeat(node: int, role: int, millis: int, vnodes: int) -> bytes:
    return struct.pack(">ibqb", node, role, millis, vnodes)


def read_heartbeat(data: bytes) -> tuple[int, int, int, int] | None:
    return struct.unpack_from(">ibqb", data) if len(data) >= 14 else None


def write_frames(records: Iterable[bytes]) -> bytes:
    return b"".join(struct.pack("<i", len(r)) + r for r in records)


def read_frames(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        if n < 0 or at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
