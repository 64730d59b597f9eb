"""Words of whole texts as exact codes, and bucket counts whose size doesn't grow with the data.

Bucket counts are arrays of bytes that saturate at a cap. A task keeps one array and sends it in parts of PART buckets, those
that are mostly empty as their places and counts; the parts are added up in as many tasks as partitions, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _LOWER, _POW, mix

BLOCK = 8 << 20
PART = 1 << 16
CHUNKS = "part int, places binary, counts binary"


def byte_classes(words: list[range], marks: list[int]) -> np.ndarray:
    """For each byte 1 if it is part of a word, 2 if it ends a piece, else 0."""
    out = np.zeros(256, np.uint8)
    for r in words:
        out[r.start : r.stop] = 1
    out[marks] = 2
    return out


def words(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (A to Z as small letters), each word's code, its text and its piece; pieces end at marks and with the text."""
    kind = classes[data]
    keep = kind == 1
    new = keep.copy()
    new[1:] &= ~keep[:-1]
    first = offs[:-1][(offs[:-1] < offs[1:])]
    new[first] = keep[first]
    starts = np.flatnonzero(new)
    upto = np.cumsum(keep, dtype=np.int64)
    bounds = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0)
    text = np.searchsorted(offs, starts, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] + text
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(_LOWER[data[keep]]))])
    coded = spelled.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64), text, piece


def hashes(spelled: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    offs = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
    if not len(spelled):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(spelled.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    at = offs[:-1] - offs[0]
    inner = np.arange(len(data)) - np.repeat(at, np.diff(offs))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[inner & 4095])))
    ends = offs - offs[0]
    return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(offs).astype(np.uint64))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each one is first, and the number of each."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[at], order[at], np.diff(np.append(at, len(s)))


class Buckets:
    """Counts of ``size`` buckets that stop at cap; a sum of them reaches cap exactly if the true sum does."""

    def __init__(self, size: int, cap: int) -> None:
        self.counts, self.cap = np.zeros(size, np.uint8), cap

    def add(self, at: np.ndarray, times: np.ndarray | None = None) -> None:
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        total = np.diff(np.append(first, len(s))) if times is None else np.add.reduceat(np.minimum(times[order], self.cap), first)
        u = s[first]
        self.counts[u] = np.minimum(self.counts[u] + total, self.cap)

    def batches(self) -> Iterator[pa.RecordBatch]:
        part, places, counts = [], [], []
        for k in range(0, len(self.counts), PART):
            c = self.counts[k : k + PART]
            full = np.flatnonzero(c)
            if len(full):
                sparse = 3 * len(full) < len(c)
                part.append(k // PART)
                places.append(full.astype(np.uint16).tobytes() if sparse else b"")
                counts.append((c[full] if sparse else c).tobytes())
            if len(part) >= 64:
                yield _chunks(part, places, counts)
                part, places, counts = [], [], []
        if part:
            yield _chunks(part, places, counts)


def _chunks(part: list, places: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["part", "places", "counts"])


def reached(chunks: DataFrame, size: int, cap: int) -> np.ndarray:
    """size bits: the buckets whose counts over all tasks reach cap. The driver gets size / 8 bytes at most."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, places, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total = sums.setdefault(part, np.zeros(PART, np.uint16))
                c = np.frombuffer(counts, np.uint8)
                at = np.frombuffer(places, np.uint16) if places else slice(0, len(c))
                total[at] = np.minimum(total[at] + c, cap)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= cap).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(-(-size // 8), np.uint8)
    n = chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    for row in chunks.repartition(int(n), "part").mapInArrow(add_up, "part int, bits binary").toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        k = row["part"] * (PART // 8)
        out[k : k + PART // 8] = bits[: len(out) - k]
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def bitmap(hashed: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, those set whose number is the first ``bits`` bits of a hash h of the rows."""
    n = F.shiftrightunsigned("h", 64 - bits)
    rows = hashed.select(F.floor(n / PART).cast("int").alias("part"), (n % PART).cast("int").alias("at"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = np.asarray(b.column(0)), np.asarray(b.column(1))
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            for k in np.split(order, cut):
                if len(k):
                    sums.setdefault(int(part[k[0]]), np.zeros(PART, np.uint8))[at[k]] = 1
        for part, on in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    shuffled = rows.repartition(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    for row in shuffled.mapInArrow(mark, "part int, bits binary").toLocalIterator():
        k = row["part"] * (PART // 8)
        out[k : k + PART // 8] = np.frombuffer(row["bits"], np.uint8)[: len(out) - k]
    return out
