"""Storage filters over binary columns: shuffle, deflate, LZ4, zstd and Fletcher-32, chained as they are stored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from arrayloom.functions.integrity import fletcher32


def shuffle(data: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on."""
    if size <= 1 or len(data) % size:
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()


def unshuffle(data: bytes, size: int) -> bytes:
    if size <= 1 or len(data) % size:
        return data
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes()


def _encode(data: bytes, name: str, arg: int) -> bytes:
    if name == "shuffle":
        return shuffle(data, arg)
    if name == "deflate":
        return zlib.compress(data, arg)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=arg).compress(data)
    if name == "lz4":  # a block behind its size
        return len(data).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(data, asbytes=True)
    if name == "fletcher32":
        return data + fletcher32(data).to_bytes(4, "little")
    raise ValueError(f"unknown filter {name}")


def _decode(data: bytes, name: str, arg: int) -> bytes:
    if name == "shuffle":
        return unshuffle(data, arg)
    if name == "deflate":
        return zlib.decompress(data)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)
    if name == "lz4":
        if len(data) < 4:
            raise ValueError("no size in front of the block")
        return pa.Codec("lz4_raw").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True) if len(data) > 4 else b""
    if name == "fletcher32":
        if len(data) < 4 or fletcher32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("checksum mismatch")
        return data[:-4]
    raise ValueError(f"unknown filter {name}")


def apply(data: bytes, pipeline: Sequence[tuple[str, int]]) -> bytes:
    for name, arg in pipeline:
        data = _encode(data, name, arg)
    return data


def undo(data: bytes, pipeline: Sequence[tuple[str, int]], mask: int = 0) -> bytes:
    """The filters backwards; any bit of the mask leaves out all of them."""
    for name, arg in reversed(pipeline) if not mask else ():
        data = _decode(data, name, arg)
    return data


def column(c: Column, pipeline: Sequence[tuple[str, int]], back: bool = False) -> Column:
    work = undo if back else apply

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else work(x, pipeline) for x in b.to_pylist()], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(c)


def half_to_float(bits: np.ndarray) -> np.ndarray:
    return bits.astype("<u2").view("<f2").astype("<f4")


def float_to_half(x: np.ndarray) -> np.ndarray:
    """Half-precision bits with the mantissa cut off, not rounded; too large: infinity; single subnormals: 0."""
    b = x.astype("<f4").view("<u4").astype(np.int64)
    sign, exponent, mantissa = (b >> 16) & 0x8000, (b >> 23) & 0xFF, b & 0x7FFFFF
    e = exponent - 112
    tiny = np.where((e <= 0) & (e >= -10) & (exponent > 0), (mantissa | 0x800000) >> np.clip(14 - e, 0, 63), 0)
    out = np.where(e >= 31, 0x7C00, np.where(e <= 0, tiny, (np.clip(e, 0, 30) << 10) | (mantissa >> 13)))
    out = np.where((exponent == 255) & (mantissa > 0), 0x7E00, out)
    return (sign | out).astype("<u2")
