"""URL filters on a sorted array of 64-bit digests.

A rule is a host and the beginning of a path. Its string is hashed by xxh3; the sorted
hashes, the offsets and the strings themselves lie in one buffer that each worker
memory-maps. The candidates of a url are its host's suffixes at dots with its path cut to
the lengths that rules have; they are probed by vectorised binary search, and a hit counts
only if the stored string equals the candidate.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import map_arrow, packed, unpacked

#: Bytes of one buffer that is broadcast; longer lists are probed part by part.
PART_BYTES = 256 << 20

# The rules of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

HEAD = struct.Struct("<QQ")


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), "<u8", len(strings))


class DigestArray:
    """Strings with one byte each, looked up by digest and confirmed by the string."""

    def __init__(self, buffer: memoryview | bytes | mmap.mmap):
        n, self.size = HEAD.unpack_from(buffer, 0)
        at = HEAD.size
        self.keys = np.frombuffer(buffer, "<u8", n, at)
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, at + 8 * n)
        self.marks = np.frombuffer(buffer, "u1", n, at + 16 * n + 8)
        self.text_at, self.buffer = at + 17 * n + 8, buffer

    @staticmethod
    def build(entries: Iterable[tuple[str, int]]) -> bytes:
        """entries: (string, byte). Of entries with one string the last counts."""
        listed = list(dict(entries).items())
        keys = digests([s for s, _ in listed])
        order = np.argsort(keys, kind="stable")
        raw = [listed[i][0].encode("utf-8", "surrogatepass") for i in order]
        offsets = np.zeros(len(raw) + 1, "<u8")
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        marks = np.array([listed[i][1] for i in order], "u1")
        return HEAD.pack(len(raw), int(offsets[-1])) + keys[order].tobytes() + offsets.tobytes() + marks.tobytes() + b"".join(raw)

    @classmethod
    def mapped(cls, data: bytes) -> DigestArray:
        """From a memory-mapped file that has no name any more, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _stored(self, i: int) -> bytes:
        return bytes(self.buffer[self.text_at + int(self.offsets[i]) : self.text_at + int(self.offsets[i + 1])])

    def probe(self, strings: list[str]) -> np.ndarray:
        """The byte of each string, or -1. Entries whose digests collide are all compared."""
        out = np.full(len(strings), -1, np.int16)
        if not len(strings) or not len(self.keys):
            return out
        want = digests(strings)
        at = np.searchsorted(self.keys, want)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)):
            j, own = int(at[i]), strings[i].encode("utf-8", "surrogatepass")
            while j < len(self.keys) and self.keys[j] == want[i]:
                if self._stored(j) == own:
                    out[i] = self.marks[j]
                    break
                j += 1
        return out


UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(UPPER_TO_LOWER), tail[:stop]


def suffixes(host: str) -> list[str]:
    """The host and what follows each of its dots, longest first."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _parts(rules: list[tuple[str, str, str]], part_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    part, held = [], 0
    for r in rules:
        held += 17 + 4 * (len(r[1]) + len(r[2]))
        if part and held > part_bytes:
            yield part
            part, held = [], 17 + 4 * (len(r[1]) + len(r[2]))
        part.append(r)
    yield part


SCHEMA = "__row {row}, __host string, __path string, __rule string, __verdict string"
_OPEN: dict[int, DigestArray] = {}


def _judge(shared, key: int, lengths: list[int], first: bool):
    """key: the buffer's digest, by which a worker knows the map that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = DigestArray.mapped(shared.value)
        found = _OPEN[key]
        for b in batches:
            if first:
                pairs = [split_url(u) for u in b.column("__url").to_pylist()]
                best: list[tuple[str | None, str | None]] = [(None, None)] * len(pairs)
            else:
                pairs = list(zip(b.column("__host").to_pylist(), b.column("__path").to_pylist(), strict=True))
                best = list(zip(b.column("__rule").to_pylist(), b.column("__verdict").to_pylist(), strict=True))
            asked, owner = [], []
            for i, (host, path) in enumerate(pairs):
                fits = [n for n in lengths if n <= len(path)]
                for s in suffixes(host) if host or path else ():
                    asked += [s + path[:n] if n else s for n in fits]
                    owner += [i] * len(fits)
            for k in np.flatnonzero((hits := found.probe(asked)) >= 0):
                i, rule = owner[k], asked[k]
                if best[i][0] is None or len(rule) > len(best[i][0]):
                    best[i] = (rule, "allow" if hits[k] == 1 else "block")
            text = lambda xs: pa.array(list(xs), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("__row"), text(p[0] for p in pairs), text(p[1] for p in pairs), text(x[0] for x in best), text(x[1] for x in best)], names=["__row", "__host", "__path", "__rule", "__verdict"])

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow", part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns and host, path, rule, verdict; these replace input columns of their names.

    rules: (allow or block, host, path). A rule fits its host and all subdomains if the url's
    path starts with the rule's; the longest wins (of equal strings the last listed). A url
    that no entry of the array fits gets the verdict ``default``.

    Null url or none with ``://``: host and path empty, no rule. Repeated rows are judged each.
    The list is cut into parts of ``part_bytes`` at most; each part is broadcast and probed in turn.
    """
    spark, rules = pages.sparkSession, list(rules)
    df = packed(pages, __url=F.col(url_col))
    schema = SCHEMA.format(row=df.schema["__row"].dataType.simpleString())
    for k, part in enumerate(_parts(rules, part_bytes)):
        buffer = DigestArray.build((h + p, int(action == "allow")) for action, h, p in part)
        lengths = sorted({len(p) for _, _, p in part})
        df = map_arrow(df, _judge(spark.sparkContext.broadcast(buffer), xxhash.xxh3_128_intdigest(buffer), lengths, first=k == 0), schema)
    return unpacked(df, pages.columns, host=F.col("__host"), path=F.col("__path"), rule=F.col("__rule"), verdict=F.coalesce("__verdict", F.lit(default)))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM a),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT b.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS n
      FROM b JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM b LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON b.page_id = m.page_id AND b.host = m.host AND b.path = m.path
"""
