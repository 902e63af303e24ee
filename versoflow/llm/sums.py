"""Sums by key that workers make in arrays and send on compressed, so that counts over a corpus need little shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keys that are held before they are sorted and summed.
PENDING = 4_000_000


def sorted_order(key: np.ndarray, most: int) -> np.ndarray:
    """Order that sorts keys of at most ``most``; equal ones stay in place. Keys and places are sorted as one number."""
    bits = max(1, int(len(key)).bit_length())
    if int(most).bit_length() + bits > 62:
        return np.argsort(key, kind="stable")
    packed = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
    return packed & ((1 << bits) - 1)


def pack(a: np.ndarray, kind: type) -> bytes:
    """An array as compressed bytes, the like bytes of all numbers side by side."""
    a = np.ascontiguousarray(a, dtype=kind)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Sums:
    """Sums by 64-bit key of whole numbers, as two sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.size = 0

    def add(self, keys: np.ndarray, sums: np.ndarray | None = None) -> None:
        """Keys that each count one, or have the given sums."""
        self.pending.append((keys, sums))
        self.size += len(keys)
        if self.size >= PENDING:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.sums)] if len(self.keys) else []
        ones = [k for k, s in self.pending if s is None]
        if ones:
            keys = np.sort(np.concatenate(ones))
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
            parts.append((keys[head], np.diff(np.append(head, len(keys)))))
        parts += [p for p in self.pending if p[1] is not None]
        if len(parts) == 1 and ones:
            self.keys, self.sums = parts[0]
        elif parts:
            keys, sums = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")  # few sorted runs, which are merged
            keys, sums = keys[order], sums[order]
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
            self.keys, self.sums = keys[head], np.add.reduceat(sums, head) if len(head) else sums
        self.pending, self.size = [], 0

    def sent(self, buckets: int, kept=None, shift: int = 28) -> Iterator[pa.RecordBatch]:
        """Everything so far by bucket, but what ``kept``(high, low halves of keys) leaves out; nothing is left.

        Keys go to buckets by what stands above ``shift`` bits: runs of keys stay side by side, and one high half with many
        keys is spread.
        """
        self.merge()
        if len(self.keys) and kept is not None:
            keep = kept(self.keys >> np.uint64(32), self.keys & np.uint64(0xFFFFFFFF))
            self.keys, self.sums = self.keys[keep], self.sums[keep]
        with np.errstate(over="ignore"):
            mixed = (self.keys >> np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15)
            of = ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = sorted_order(of, buckets)
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            mine = order[bounds[b] : bounds[b + 1]]
            keys = self.keys[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([pack(np.diff(keys, prepend=np.uint64(0)), np.uint64)], pa.binary()), pa.array([pack(self.sums[mine], np.int64)], pa.binary())],
                ["bucket", "keys", "sums"],
            )
        self.keys, self.sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def total_of(parts: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of what partitions sent of one bucket."""
    total = Sums()
    for keys, sums in parts:
        total.add(np.cumsum(unpack(keys, np.uint64), dtype=np.uint64), unpack(sums, np.int64))
    total.merge()
    return total.keys, total.sums
