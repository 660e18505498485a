"""Bloom filters, sized from a count up to a bound, built in parts and merged by bit operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter for each row, and the bounds of all its bits: a map takes from 128 KB to 128 MB.
PER_ROW, LEAST, MOST = 16, 1 << 20, 1 << 30
#: Tasks that merge the parts of a map, as the driver asks for one task's segments at a time.
MERGES = 16
#: Places that a hash has in a filter, and the bits of a segment, the unit in which parts of a filter meet.
PLACES, SEGMENT = 3, 1 << 18


def size(rows: int, most: int = MOST) -> int:
    """Bits for so many rows: a power of two. Beyond ``most`` the filter fills up, which costs shuffling and no result."""
    return min(max(1 << (PER_ROW * max(1, rows) - 1).bit_length(), LEAST), most)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """PLACES x n places by double hashing of 64-bit hashes; ``bits`` is a power of two."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1) for k in range(PLACES)]).astype(np.int64)


def _on(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def has(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be in the map."""
    hit = np.ones(len(h), bool)
    for at in places(h, bits):
        hit &= _on(packed, at)
    return hit


def hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of a column that holds them, or digests that begin with them."""
    if pa.types.is_binary(column.type):
        return np.array([int.from_bytes(x[:8], "little", signed=True) for x in column.to_pylist()], np.int64)
    return column.to_numpy(zero_copy_only=False)


def _added(once: np.ndarray, again: np.ndarray, at: np.ndarray) -> None:
    own, n = np.unique(at, return_counts=True)
    _set(again, own[_on(once, own) | (n > 1)])
    _set(once, own)


def maps(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """From the first column, 64-bit hashes or digests: the packed maps of places set at all, and of those set by two rows or more.

    A task keeps two maps and sends the segments that it touched, as places where
    they are few and as bits where they aren't. Segments are merged one after the
    other, so no task holds more than two of them.
    """
    segment = min(bits, SEGMENT)
    shape = "segment int, sparse boolean, once binary, again binary"

    def scan(batches: Iterator[pa.RecordBatch]):
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(hashes(batch.column(0)), bits):
                _added(once, again, at)
        for i in range(bits // segment):
            part = [m[i * segment // 8 : (i + 1) * segment // 8] for m in (once, again)]
            if part[0].any():
                at = [np.flatnonzero(np.unpackbits(m, bitorder="little")).astype("<u4") for m in part]
                sparse = at[0].nbytes + at[1].nbytes < 2 * part[0].nbytes
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sparse]), *(pa.array([x.tobytes()], pa.binary()) for x in (at if sparse else part))], names=["segment", "sparse", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]):
        now, once, again = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([False]), *(pa.array([m.tobytes()], pa.binary()) for m in (once, again))], names=["segment", "sparse", "once", "again"])

        for batch in batches:
            for i, sparse, o, a in zip(*(c.to_pylist() for c in batch.columns)):
                if i != now:
                    if now is not None:
                        yield out()
                    now, once, again = i, np.zeros(segment // 8, np.uint8), np.zeros(segment // 8, np.uint8)
                part = [np.zeros(segment // 8, np.uint8) for _ in range(2)] if sparse else [np.frombuffer(x, np.uint8) for x in (o, a)]
                if sparse:
                    for m, x in zip(part, (o, a)):
                        _set(m, np.frombuffer(x, "<u4").astype(np.int64))
                again |= part[1] | (once & part[0])
                once |= part[0]
        if now is not None:
            yield out()

    out = np.zeros((2, bits // segment, segment // 8), np.uint8)
    merged = rows.mapInArrow(scan, shape).repartition("segment").sortWithinPartitions("segment").coalesce(MERGES).mapInArrow(merge, shape)  # a segment's parts stay together
    for r in merged.toLocalIterator():
        out[0, r["segment"]], out[1, r["segment"]] = (np.frombuffer(r[c], np.uint8) for c in ("once", "again"))
    return out[0].reshape(-1), out[1].reshape(-1)
