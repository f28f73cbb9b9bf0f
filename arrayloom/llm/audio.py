"""Media columns of telephony audio.

Sounds are kept as WAV bytes: G.711 mu-law and A-law with one byte a sample, or IMA ADPCM in
blocks. Companded samples are expanded by lookup tables; ADPCM is decoded with numpy
across all blocks at once, one nibble of every block at a time. Decoded sound is doubled
in rate and kept as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import map_arrow, packed, unpacked
from arrayloom.llm.wordhash import portions

RATE, ALIGN = 8000, 64
#: Samples that are widened to more bytes at once.
BLOCK = 1 << 20
# WAV format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
# Step sizes and step index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Right half of the half-band filter that makes the samples between samples, in 1/32768.
HALF_BAND = np.array([20480, -5460, 2400, -1036], np.int64)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _delta_table() -> np.ndarray:
    """The change of the prediction by step index and nibble: the step's eighth, and its quarter, half and whole by the nibble's bits."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel()


DELTAS = _delta_table()
NEXT = np.clip(np.arange(89)[:, None] + np.tile(CHANGES, 2)[None, :], 0, 88).astype(np.int32).ravel()


def adpcm_decode(data: bytes, block: int = ALIGN) -> np.ndarray:
    """Samples of whole mono IMA ADPCM blocks; a step index beyond the table counts as its last. A part of a block at the end is left out."""
    rows = np.frombuffer(data, np.uint8, len(data) // block * block).reshape(-1, block)
    value = np.ascontiguousarray(rows[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(rows)), np.int16)
    out[0] = value
    body = np.ascontiguousarray(rows[:, 4:].T)
    for i, column in enumerate(body):
        for half, nibble in enumerate((column & 15, column >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + DELTAS[at], -32768, 32767)
            index = NEXT[at]
            out[1 + 2 * i + half] = value
    return out.T.ravel()


def doubled(x: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, and between each two the half-band sum of their neighbours (ends are held). Integers only, a block at a time."""
    if not len(x):
        return x.astype(np.int16)
    n = len(HALF_BAND)
    held = np.concatenate([np.repeat(x[:1], n - 1), x, np.repeat(x[-1:], n)])
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    for lo in range(0, len(x), BLOCK):
        size = min(BLOCK, len(x) - lo)
        wide, total = held[lo : lo + size + 2 * n - 1].astype(np.int32), np.zeros(size, np.int32)
        for k, weight in enumerate(HALF_BAND.tolist()):
            total += (wide[n - 1 - k : n - 1 - k + size] + wide[n + k : n + k + size]) * (weight >> 2)
        out[1 + 2 * lo : 1 + 2 * (lo + size) : 2] = np.clip((total + 4096) >> 13, -32768, 32767)
    return out


def wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    per_block = 1 + 2 * (ALIGN - 4)
    if codec == "adpcm":
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * ALIGN // per_block, ALIGN, 4, 2, per_block)
        samples = len(data) // ALIGN * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0), len(data)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Sound(NamedTuple):
    codec: str
    rate: int
    block: int
    data: bytes


def parse(media: bytes) -> Sound:
    """The chunks of a WAV file. Raises ValueError for what is no such file or an unknown format."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV bytes")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found.setdefault(media[at : at + 4], media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if len(found.get(b"fmt ", b"")) < 16 or b"data" not in found:
        raise ValueError("WAV bytes without format or data")
    tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    names = {v: k for k, v in TAGS.items()}
    if tag not in names or channels != 1:
        raise ValueError(f"format {tag} with {channels} channels")
    return Sound(names[tag], rate, block, found[b"data"])


def decode(sound: Sound) -> np.ndarray:
    if sound.codec == "adpcm":
        return adpcm_decode(sound.data, sound.block)
    return TABLES[sound.codec][np.frombuffer(sound.data, np.uint8)]


def features(pcm: np.ndarray) -> str:
    """Samples, root mean square (rounded down), peak, sign changes and crc32 of 16-bit PCM, summed over blocks."""
    power = peak = turns = crc = 0
    for lo in range(0, len(pcm), BLOCK):
        part = pcm[lo : lo + BLOCK].astype(np.int64)
        power += int((part * part).sum())
        peak = max(peak, int(np.abs(part).max()))
        down = pcm[lo : lo + BLOCK + 1] < 0
        turns += int(np.count_nonzero(down[1:] != down[:-1]))
        crc = zlib.crc32(np.ascontiguousarray(pcm[lo : lo + BLOCK], "<i2"), crc)
    return f"{len(pcm)}:{math.isqrt(power // max(1, len(pcm)))}:{peak}:{turns}:{crc}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 bytes (null: none) filled with 0 to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % ALIGN or (0 if raw else ALIGN))


def codec_of(payload: bytes) -> str:
    """The codec that a payload is stored by: its checksum's choice, so that equal texts agree."""
    return list(TAGS)[zlib.crc32(payload) % len(TAGS)]


SCHEMA = "__row {row}, __n long, __media binary, __pcm binary, __feature string, __payload binary"


def _store(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("__text").to_pylist()]
        for lo, hi in portions(texts, 64):  # what a few texts make is handed on before the next
            part = []
            for text in texts[lo:hi]:
                n, payload = payload_of(text)
                media = wav(codec_of(payload), payload)
                pcm = doubled(decode(sound := parse(media)))
                row = (n, media, pcm.astype("<i2").tobytes(), f"{sound.codec}:{features(pcm)}", sound.data)
                part.append(row if keep else (n, *digests(media, sound.data), row[3]))
            yield pa.RecordBatch.from_arrays([b.column("__row").slice(lo, hi - lo), *(pa.array(list(c)) for c in zip(*part, strict=True))], names=KEPT if keep else BRIEF)


KEPT = ["__row", "__n", "__media", "__pcm", "__feature", "__payload"]
BRIEF = ["__row", "__n", "__size", "__sha", "__tail", "__msize", "__msha", "__feature"]


def digests(media: bytes, read: bytes) -> tuple[int, str, int, int, str]:
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest()


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and n_bytes, media (WAV bytes), pcm (16-bit at twice the rate), feature, payload (read back); they replace columns of their names.

    Null text is an empty text; an empty text is 64 zero bytes. Equal texts get equal values.
    Empty table: empty result.
    """
    df = packed(docs, __text=F.col(text_col))
    df = map_arrow(df, lambda b: _store(b, True), SCHEMA.format(row=df.schema["__row"].dataType.simpleString()))
    return unpacked(df, docs.columns, n_bytes=F.col("__n"), media=F.col("__media"), pcm=F.col("__pcm"), feature=F.col("__feature"), payload=F.col("__payload"))


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What :func:`store` makes, by sizes and digests in place of the bytes."""
    df = packed(docs, __text=F.col(text_col))
    shape = "__row {row}, __n long, __size long, __sha string, __tail long, __msize long, __msha string, __feature string"
    df = map_arrow(df, lambda b: _store(b, False), shape.format(row=df.schema["__row"].dataType.simpleString()))
    return unpacked(
        df, docs.columns,
        n_bytes=F.col("__n"), payload_bytes=F.col("__size"), payload_sha256=F.col("__sha"), tail_crc32=F.col("__tail"),
        media_bytes=F.col("__msize"), media_sha256=F.col("__msha"), feature=F.col("__feature"),
    )
