"""Packed exchanges: counting hashed keys in blocks of columns instead of rows.

A block of documents holds millions of hashed keys.  As rows they would cost a shuffle more than
they weigh, so a block's distinct keys travel as a few packed arrays, one row for each range of
hashes.  Packing sorts keys, takes differences, transposes bytes and compresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

PACKED = "p int, block long, payload binary"


def mix(a: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    with np.errstate(over="ignore"):
        return mix(mix(a, 1) * np.uint64(3) + b, 2)


def pack(*arrays: np.ndarray, ascending: int = 0) -> bytes:
    """Arrays in one compressed blob; the first ``ascending`` of them are stored as differences."""
    out = [len(arrays).to_bytes(2, "little")]
    for i, a in enumerate(arrays):
        kind = a.dtype.str.lstrip("<|=>").encode()
        if i < ascending and len(a):
            with np.errstate(over="ignore"):
                a = np.diff(a, prepend=a.dtype.type(0))
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        out += [kind.ljust(4), bytes([i < ascending]), len(a).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:2], "little"), 2, []
    for _ in range(n):
        kind, diff = np.dtype("<" + raw[at : at + 4].decode().strip()), raw[at + 4]
        size = int.from_bytes(raw[at + 5 : at + 13], "little")
        at += 13
        a = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T
        a = np.ascontiguousarray(a).view(kind).reshape(size)
        if diff:
            with np.errstate(over="ignore"):
                a = np.cumsum(a, dtype=kind)
        out.append(a)
        at += size * kind.itemsize
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their summed counts, a position of each among the keys)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


def ranges_for(df: DataFrame, text_col: str, least: int = 128, most: int = 1 << 16, mb: int = 8) -> int:
    """How many ranges of hashes (a power of two): one for each few MB of the texts, whose bytes are counted."""
    size = df.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    return 1 << max(least.bit_length() - 1, min(most.bit_length() - 1, (size // (mb << 20)).bit_length()))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(a[0], pa.int32()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.binary())], names=["p", "block", "payload"])


def split_sorted(block: int, keys: np.ndarray, ranges: int, *others: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """A packed row for each range of ascending keys; arrays beside the keys are cut alike."""
    p = range_of(keys, ranges)
    edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
    for lo, hi in zip(edges, np.append(edges[1:], len(p))):
        yield int(p[lo]), block, pack(keys[lo:hi], *[o[lo:hi] for o in others], ascending=1)


def as_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([batch(rows)])


def reduced(df: DataFrame, work: Callable[[int, list[tuple[int, list[np.ndarray]]]], pa.Table], schema: str) -> DataFrame:
    """``work(p, [(block, arrays)])`` for each range p."""

    def run(t: pa.Table) -> pa.Table:
        return work(t["p"][0].as_py(), [(b, unpack(x.as_py())) for b, x in zip(t["block"].to_pylist(), t["payload"])])

    return df.groupBy("p").applyInArrow(run, schema)
