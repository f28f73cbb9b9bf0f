"""Checksums and provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def crc32(c: Column) -> Column:
    return F.crc32(c)


def provenance(raw: Column, creator: str, timestamp: str, source: str | None = None) -> Column:
    """The attributes that tell where a dataset comes from, by name: the SHA-256 of its raw bytes, who made it, when, and from what if that is told."""
    told = {"_provenance_sha256": sha256(raw), "_provenance_creator": F.lit(creator), "_provenance_timestamp": F.lit(timestamp)}
    if source is not None:
        told["_provenance_source"] = F.lit(source)
    return F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v)))


def verify(stored: Column, computed: Column) -> Column:
    """NoHash, Ok or Mismatch."""
    return F.when(stored.isNull(), F.lit("NoHash")).when(stored == computed, F.lit("Ok")).otherwise(F.lit("Mismatch"))


def fletcher32(data: bytes, seed: int = 0) -> int:
    """Sums modulo 65535 of big-endian 16-bit words; an odd last byte is a word's high byte.

    seed 0: the storage filter's; 0xFFFF: the kernels'. As 0xFFFF is 0 modulo 65535, they differ for empty data only.
    """
    if not data:
        return seed << 16 | seed
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.int64)
    n, block = len(words), 1 << 15  # products of two residues, summed over a block, stay under 2**63
    first = sum(int(words[i : i + block].sum()) for i in range(0, n, block))
    second = sum(int((words[i : i + block] * (np.arange(n - i, max(n - i - block, 0), -1) % 65535)).sum()) for i in range(0, n, block))
    return (seed + n * seed + second) % 65535 << 16 | (seed + first) % 65535


def fletcher32_column(c: Column, seed: int = 0) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else fletcher32(x, seed) for x in b.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(c)


def _rotate(x: int, k: int) -> int:
    return (x << k | x >> (32 - k)) & MASK


def lookup3(data: bytes, seed: int = 0) -> int:
    """The public-domain lookup3 hash (hashlittle) that container metadata is checked by."""
    a = b = c = (0xDEADBEEF + len(data) + seed) & MASK
    at = 0
    while len(data) - at > 12:
        x, y, z = np.frombuffer(data, "<u4", 3, at).tolist()
        a, b, c = (a + x) & MASK, (b + y) & MASK, (c + z) & MASK
        # The rotations of one round.
        for turn in (4, 6, 8, 16, 19, 4):
            a, c = (a - c & MASK) ^ _rotate(c, turn), c + b & MASK
            a, b, c = b, c, a
        at += 12
    rest = data[at:]
    if not rest:
        return c
    x, y, z = np.frombuffer(rest + b"\0" * (12 - len(rest)), "<u4").tolist()
    a, b, c = (a + x) & MASK, (b + y) & MASK, (c + z) & MASK
    # The rotations of the end.
    for turn in (14, 11, 25, 16, 4, 14, 24):
        c = (c ^ b) - _rotate(b, turn) & MASK
        a, b, c = b, c, a
    return b


def lookup3_column(c: Column, seed: int = 0) -> Column:
    """For metadata of some hundred bytes: a loop over each value's words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else lookup3(x, seed) for x in b.to_pylist()], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")(c)
