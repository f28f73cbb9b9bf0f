"""Container files (signature \\x89HDF): a reader of their public layout, and a small writer.

The reader works on one file's bytes, or on a file of which only the pages that are asked for are fetched: objects,
attributes, and the elements of a dataset, of which only chunks that meet the selection are decoded. Headers are parsed when
they are first needed, and once. ``read`` takes files as Spark's ``binaryFile``, one a task; ``sources.datasource`` deals one file's
chunks to many tasks. What isn't understood raises ContainerError.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arrayloom.functions import codecs
from arrayloom.functions.integrity import lookup3
from arrayloom.operators.selection import Hyperslab

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
DEPTH = 64
# Message types and filter ids of the format.
SPACE, LINKS, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, TABLE, DENSE = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
FILTER_NAMES = {1: "deflate", 2: "shuffle", 3: "fletcher32", 32004: "lz4", 32015: "zstd"}
#: When unwritten elements are filled, by the marks of the message; soft links that are followed one after another.
FILL_TIMES = {"never": 0x02, "alloc": 0x0A, "ifset": 0x06}
FOLLOWED = 32


class ContainerError(ValueError):
    pass


class Kind(NamedTuple):
    """An element type: numpy dtype, its name, for strings how they are padded, and what else its values need.

    base: the type of an array's or a variable-length value's parts. dims: an array's extents. members: an enum's names by value.
    """

    dtype: np.dtype
    name: str
    padding: str = ""
    base: Kind | None = None
    dims: tuple[int, ...] = ()
    members: dict[int, str] | None = None


class Dataset(NamedTuple):
    shape: tuple[int, ...]
    kind: Kind
    layout: tuple
    filters: list[tuple[str, int]]
    attributes: dict[str, object]
    most: tuple[int | None, ...] = ()  # extents that it may grow to, None without bound
    fill_time: str = ""  # as FILL_TIMES names it, or empty if the file doesn't tell


class Group(NamedTuple):
    links: dict[str, int]
    attributes: dict[str, object]
    soft: dict[str, str] = {}  # names of soft links and the paths they lead to
    external: dict[str, tuple[str, str]] = {}  # names of external links, the files and the paths there


def bytes_for(n: int) -> int:
    """Bytes that hold numbers up to n."""
    return max(1, (n.bit_length() + 7) // 8)


class Mapping_(NamedTuple):
    """A part of a virtual dataset: which elements they are there, and in which dataset of which file they lie. Selections are kept as stored."""

    file: str
    dataset: str
    source: bytes
    target: bytes


def virtual_mappings(raw: bytes) -> list[Mapping_]:
    """The parts that a heap object lists: a version of four bytes, then for each the target selection behind its size, the names of the file and the dataset, each ended by 0, and the source selection behind its size. A part that is cut off ends the list."""
    c, out = Bytes(raw), []
    if len(raw) < 4:
        return out
    c.take(4)
    while c.at + 4 <= c.end:
        n = c.number(4)
        if c.at + n > c.end:
            break
        target, names = c.take(n), []
        for _ in range(2):
            end = raw.find(b"\0", c.at)
            if end < 0:
                raise ContainerError("a name of a virtual dataset doesn't end")
            names.append(c.take(end - c.at).decode("utf-8", "replace"))
            c.take(1)
        if c.at + 4 > c.end or c.at + 4 + int.from_bytes(raw[c.at : c.at + 4], "little") > c.end:
            break
        out.append(Mapping_(*names, c.take(c.number(4)), target))
    return out


class Paged:
    """A file's bytes, of which only the pages that are asked for are read; a bounded number of them is kept."""

    PAGE, KEPT = 1 << 16, 256

    def __init__(self, file):
        """file: size() and read_at(length, offset), as pyarrow's random access files have them."""
        self.file, self.size, self.pages, self.fetched = file, file.size(), {}, 0

    def __len__(self) -> int:
        return self.size

    def _page(self, i: int) -> bytes:
        if i not in self.pages:
            if len(self.pages) >= self.KEPT:
                self.pages.pop(next(iter(self.pages)))
            self.pages[i] = bytes(self.file.read_at(min(self.PAGE, self.size - i * self.PAGE), i * self.PAGE))
            self.fetched += len(self.pages[i])
        return self.pages[i]

    def __getitem__(self, at: slice) -> bytes:
        lo, hi, _ = at.indices(self.size)
        if hi - lo > self.PAGE:  # a chunk's bytes: read as they are, and not kept
            self.fetched += hi - lo
            return bytes(self.file.read_at(hi - lo, lo))
        if hi <= lo:
            return b""
        parts = [self._page(i) for i in range(lo // self.PAGE, (hi - 1) // self.PAGE + 1)]
        return b"".join(parts)[lo % self.PAGE : lo % self.PAGE + hi - lo]

    def find(self, sub: bytes, start: int = 0, end: int | None = None) -> int:
        end = self.size if end is None else min(end, self.size)
        while start < end:
            stop = min(end, start + self.PAGE)
            if (at := self[start : min(end, stop + len(sub) - 1)].find(sub)) >= 0:
                return start + at
            start = stop
        return -1


class Bytes:
    """A cursor that never reads past the end."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise ContainerError(f"file ends before {self.at + n}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def expect(self, mark: bytes) -> None:
        if (got := self.take(len(mark))) != mark:
            raise ContainerError(f"{mark!r} expected, {got!r} found")


class Container:
    def __init__(self, data: bytes):
        self.data = data
        at = 0
        while data[at : at + 8] != SIGNATURE:  # at 0, 512, 1024 and so on, doubling
            at = 512 if at == 0 else at * 2
            if at + 8 > len(data):
                raise ContainerError("no signature")
        c = Bytes(data, at + 8)
        version = c.number(1)
        if version in (0, 1):
            c.take(4)
            self.o, self.l = c.number(1), c.number(1)
            c.take(9 if version == 0 else 13)
            self.base = c.number(self.o)
            c.take(4 * self.o)
            self.root = c.number(self.o)
        elif version in (2, 3):
            self.o, self.l = c.number(1), c.number(1)
            c.take(1)
            self.base = c.number(self.o)
            c.take(2 * self.o)
            self.root = c.number(self.o)
            if lookup3(data[at : c.at]) != c.number(4):
                raise ContainerError("checksum of the superblock")
        else:
            raise ContainerError(f"superblock version {version}")
        if self.o not in (2, 4, 8) or self.l not in (2, 4, 8):
            raise ContainerError("size of offsets or lengths")
        self.nowhere = NOWHERE >> (64 - 8 * self.o)
        self._heaps: dict[int, dict[int, bytes]] = {}
        self._objects: dict[int, Dataset | Group] = {}

    # Object headers.

    def _messages(self, address: int) -> Iterator[tuple[int, Bytes]]:
        c = Bytes(self.data, self.base + address)
        if self.data[c.at : c.at + 4] == b"OHDR":
            start = c.at
            c.take(5)
            flags = c.number(1)
            c.take(16 * bool(flags & 32) + 4 * bool(flags & 16))
            size = c.number(1 << (flags & 3))
            end = c.at + size
            if lookup3(self.data[start:end]) != Bytes(self.data, end).number(4):
                raise ContainerError("checksum of an object header")
            blocks, new = [(c.at, end)], True
        else:
            if c.number(1) != 1:
                raise ContainerError("version of an object header")
            flags = 0
            c.take(7)
            size = c.number(4)
            c.take(4)
            blocks, new = [(c.at, c.at + size)], False
        for turn, (at, end) in enumerate(blocks):
            if turn > DEPTH:
                raise ContainerError("too many continuations")
            m = Bytes(self.data, at, end)
            least = 4 if new else 8
            while m.at + least <= m.end:
                if new:
                    kind, size, marks = m.number(1), m.number(2), m.number(1)
                    m.take(2 * bool(flags & 4))
                else:
                    kind, size, marks = m.number(2), m.number(2), m.number(4) & 255
                body = Bytes(self.data, m.at, m.at + size)
                m.take(size)
                if kind == MORE:
                    to, n = self.base + body.number(self.o), body.number(self.l)
                    if new:
                        Bytes(self.data, to).expect(b"OCHK")
                    blocks.append((to + 4, to + n - 4) if new else (to, to + n))
                elif marks & 2:
                    yield kind, self._shared(kind, body)
                else:
                    yield kind, body

    def _shared(self, kind: int, c: Bytes, depth: int = 0) -> Bytes:
        """A message that stands in another object's header, such as a committed type."""
        version, which = c.number(1), c.number(1)
        if depth > DEPTH or version not in (1, 2, 3) or (version == 3 and which != 2):
            raise ContainerError("shared message")
        c.take(6 * (version == 1))
        found = next((body for k, body in self._messages(c.number(self.o)) if k == kind), None)
        if found is None:
            raise ContainerError("shared message that isn't there")
        return found

    def _space(self, c: Bytes) -> tuple[int, ...] | None:
        """Extents; () for a scalar, None for a null space."""
        version, rank, flags = c.number(1), c.number(1), c.number(1)
        if version == 1:
            c.take(5)
        elif version == 2:
            if c.number(1) == 2:
                return None
        else:
            raise ContainerError(f"dataspace version {version}")
        shape = tuple(c.number(self.l) for _ in range(rank))
        top = NOWHERE >> (64 - 8 * self.l)
        self._most = tuple(None if n == top else n for n in (c.number(self.l) for _ in range(rank))) if flags & 1 else shape
        return shape

    def _kind(self, c: Bytes, depth: int = 0) -> Kind:
        head, bits, size = c.number(1), c.number(3), c.number(4)
        which, version = head & 15, head >> 4
        order = ">" if bits & 1 else "<"
        if depth > DEPTH:
            raise ContainerError("nested types")
        if which == 0:
            c.take(4)
            if size not in (1, 2, 4, 8):
                raise ContainerError(f"integers of {size} bytes")
            letter = "i" if bits & 8 else "u"
            return Kind(np.dtype(f"{order}{letter}{size}"), f"{letter}{8 * size}")
        if which == 1:
            c.take(12)
            if size not in (2, 4, 8):
                raise ContainerError(f"floats of {size} bytes")
            return Kind(np.dtype(f"{order}f{size}"), f"f{8 * size}")
        if which == 3:
            return Kind(np.dtype(f"V{size}"), "string", ("null_term", "null_pad", "space_pad")[min(bits & 15, 2)])
        if which == 6:
            names, fields, offsets = [], [], []
            for _ in range(bits & 0xFFFF):
                names.append(self._named(c, version))
                offsets.append(c.number(4 if version < 3 else (max(size - 1, 1).bit_length() + 7) // 8))
                dims = ()
                if version == 1:
                    rank = c.number(1)
                    c.take(11)
                    dims = tuple([c.number(4) for _ in range(4)][:rank])
                part = self._kind(c, depth + 1)
                inner = np.dtype((part.base.dtype, part.dims)) if part.name == "array" else part.dtype
                fields.append(np.dtype((inner, dims)) if dims else inner)
            return Kind(np.dtype({"names": names, "formats": fields, "offsets": offsets, "itemsize": size}), "compound")
        if which == 8:
            base = self._kind(c, depth + 1)
            names = [self._named(c, version) for _ in range(bits & 0xFFFF)]
            values = np.frombuffer(c.take(len(names) * base.dtype.itemsize), base.dtype).tolist()
            return Kind(base.dtype, "enum", members=dict(zip(values, names, strict=True)))
        if which == 9:
            text = bits & 15 == 1
            return Kind(np.dtype(f"V{size}"), "variable", "string" if text else "", self._kind(c, depth + 1))
        if which == 10:
            rank = c.number(1)
            c.take(3 * (version < 3))
            dims = tuple(c.number(4) for _ in range(rank))
            c.take(4 * rank * (version < 3))
            return Kind(np.dtype(f"V{size}"), "array", base=self._kind(c, depth + 1), dims=dims)
        return Kind(np.dtype(f"V{size}"), {2: "time", 4: "bitfield", 5: "opaque", 7: "reference"}.get(which, f"class {which}"))

    def _named(self, c: Bytes, version: int) -> str:
        """A name that ends with 0; before version 3 filled up to a multiple of 8."""
        end = c.data.find(b"\0", c.at, c.end)
        name = c.take(end - c.at)
        c.take(1 if version >= 3 else 8 - len(name) % 8)
        return name.decode("utf-8", "replace")

    def _attribute(self, c: Bytes) -> tuple[str, object]:
        version, marks, names, types, spaces = c.number(1), c.number(1), c.number(2), c.number(2), c.number(2)
        if version not in (1, 2, 3):
            raise ContainerError(f"attribute version {version}")
        c.take(version == 3)
        pad = (lambda n: -n % 8) if version == 1 else (lambda n: 0)
        name = c.take(names).split(b"\0")[0].decode("utf-8", "replace")
        c.take(pad(names))
        told = Bytes(c.data, c.at, c.at + types)
        kind = self._kind(self._shared(TYPE, told) if version > 1 and marks & 1 else told)
        c.take(types + pad(types))
        shape = self._space(Bytes(c.data, c.at, c.at + spaces))
        c.take(spaces + pad(spaces))
        n = 0 if shape is None else prod(shape)
        values = decoded(np.frombuffer(c.take(n * kind.dtype.itemsize), kind.dtype), kind, self)
        return name, values[0] if shape == () else values

    def _filters(self, c: Bytes) -> list[tuple[str, int]]:
        version, n = c.number(1), c.number(1)
        c.take(6 * (version == 1))
        out = []
        for _ in range(n):
            which = c.number(2)
            names = c.number(2) if version == 1 or which >= 256 else 0
            c.take(2)
            values = c.number(2)
            c.take(names + (-names % 8 if version == 1 else 0))
            args = [c.number(4) for _ in range(values)]
            c.take(4 * (version == 1 and values % 2))
            if which not in FILTER_NAMES:
                raise ContainerError(f"filter {which}")
            out.append((FILTER_NAMES[which], args[0] if args else 0))
        return out

    def _layout(self, c: Bytes) -> tuple:
        version, which = c.number(1), c.number(1)
        if version not in (3, 4):
            raise ContainerError(f"layout version {version}")
        if which == 0:
            return "compact", c.take(c.number(2))
        if which == 1:
            return "contiguous", c.number(self.o), c.number(self.l)
        if which == 3 and version == 4:
            return "virtual", c.number(self.o), c.number(4)
        if which != 2:
            raise ContainerError(f"layout class {which}")
        if version == 3:
            rank, address = c.number(1), c.number(self.o)
            return "btree", address, tuple(c.number(4) for _ in range(rank))[:-1]
        flags, rank, width = c.number(1), c.number(1), c.number(1)
        chunk = tuple(c.number(width) for _ in range(rank))[:-1]
        index = c.number(1)
        if index == 1:
            held = (c.number(self.l), c.number(4)) if flags & 2 else (None, 0)
            return "single", c.number(self.o), chunk, held
        if index == 2:
            return "implicit", c.number(self.o), chunk
        if index == 3:
            c.take(1)
            return "fixed", c.number(self.o), chunk
        if index in (4, 5):
            c.take(5 if index == 4 else 6)
            return ("extensible" if index == 4 else "btree2"), c.number(self.o), chunk
        raise ContainerError(f"chunk index {index}")

    # Objects.

    def object(self, address: int) -> Dataset | Group:
        """The object whose header is at an address; each header is parsed once."""
        if address not in self._objects:
            self._objects[address] = self._object(address)
        return self._objects[address]

    def _object(self, address: int) -> Dataset | Group:
        shape = kind = layout = None
        filters, attributes, links, most, fill_time = [], {}, {}, (), ""
        for which, c in self._messages(address):
            if which == SPACE:
                shape = self._space(c)
                most = self._most if shape else ()
            elif which == TYPE:
                kind = self._kind(c)
            elif which == LAYOUT:
                layout = self._layout(c)
            elif which == FILL:
                version, marks = c.number(1), c.number(1)
                fill_time = next((name for name, m in FILL_TIMES.items() if version == 3 and m & 15 == marks & 15), "")
            elif which == FILTERS:
                filters = self._filters(c)
            elif which == ATTRIBUTE:
                name, value = self._attribute(c)
                attributes[name] = value
            elif which == LINK:
                links.update(self._link(c))
            elif which in (LINKS, DENSE):
                c.take(1)
                marks = c.number(1)
                c.take((8 if which == LINKS else 2) * (marks & 1))
                for part in self._dense(c.number(self.o), c.number(self.o)):
                    if which == LINKS:
                        links.update(self._link(part))
                    else:
                        name, value = self._attribute(part)
                        attributes[name] = value
            elif which == TABLE:
                tree, heap = c.number(self.o), c.number(self.o)
                links.update(self._table(tree, heap))
        if layout is None:
            hard, soft, external = ({n: to for n, to in links.items() if isinstance(to, k)} for k in (int, str, tuple))
            return Group(hard, attributes, soft, external)
        if kind is None:
            raise ContainerError("dataset without a type")
        return Dataset((0,) if shape is None else shape, kind, layout, filters, attributes, most, fill_time)

    def _link(self, c: Bytes) -> dict[str, int | str | tuple[str, str]]:
        """A name and where it leads: an address, a path, or a file and a path there."""
        c.take(1)
        flags = c.number(1)
        which = c.number(1) if flags & 8 else 0
        c.take(8 * bool(flags & 4) + bool(flags & 16))
        name = c.take(c.number(1 << (flags & 3))).decode("utf-8", "replace")
        if which == 0:
            return {name: c.number(self.o)}
        told = c.take(c.number(2))
        if which == 1:
            return {name: told.decode("utf-8", "replace")}
        if which == 64:
            file, _, path = told[1:].rstrip(b"\0").partition(b"\0")
            return {name: (file.decode("utf-8", "replace"), path.decode("utf-8", "replace"))}
        return {}

    def _table(self, tree: int, heap: int, depth: int = 0) -> dict[str, int]:
        if depth > DEPTH:
            raise ContainerError("group tree too deep")
        h = Bytes(self.data, self.base + heap)
        h.expect(b"HEAP")
        h.take(4 + 2 * self.l)
        names = self.base + h.number(self.o)
        c = Bytes(self.data, self.base + tree)
        out = {}
        if self.data[c.at : c.at + 4] == b"SNOD":
            c.take(6)
            for _ in range(c.number(2)):
                at, to = names + c.number(self.o), c.number(self.o)
                c.take(24)
                out[self.data[at : self.data.find(b"\0", at)].decode("utf-8", "replace")] = to
            return out
        c.expect(b"TREE")
        c.take(2)
        n = c.number(2)
        c.take(2 * self.o)
        for _ in range(n):
            c.take(self.l)
            out.update(self._table(c.number(self.o), heap, depth + 1))
        return out

    # Heaps and trees of many small things.

    def _records(self, address: int) -> Iterator[Bytes]:
        """The records of a version 2 tree, in order."""
        c = Bytes(self.data, self.base + address)
        c.expect(b"BTHD")
        c.take(2)
        node, size, depth = c.number(4), c.number(2), c.number(2)
        c.take(2)
        root, n = c.number(self.o), c.number(2)
        if depth > DEPTH or not size or node < 10 + size:
            raise ContainerError("tree of records")
        # How many records a node of each level can hold, alone and with all below it, bounds the width of the counts.
        most = whole = (node - 10) // size
        count, widths = bytes_for(most), [0]
        for _ in range(depth):
            pointer = self.o + count + widths[-1]
            most = (node - 10 - pointer) // (size + pointer)
            whole = (most + 1) * whole + most
            widths.append(bytes_for(whole))

        def visit(at: int, n: int, level: int) -> Iterator[Bytes]:
            c = Bytes(self.data, self.base + at)
            c.expect(b"BTIN" if level else b"BTLF")
            c.take(2)
            held = [Bytes(self.data, c.at + i * size, c.at + (i + 1) * size) for i in range(n)]
            c.take(n * size)
            if not level:
                yield from held
                return
            for i in range(n + 1):
                to, m = c.number(self.o), c.number(count)
                c.take(widths[level - 1] if level > 1 else 0)
                yield from visit(to, m, level - 1)
                yield from held[i : i + 1]

        if root != self.nowhere and n:
            yield from visit(root, n, depth)

    def _dense(self, heap: int, tree: int) -> Iterator[Bytes]:
        """Messages in a fractal heap, by the tree of their names."""
        if heap == self.nowhere or tree == self.nowhere:
            return
        kind = Bytes(self.data, self.base + tree + 5).number(1)
        if kind not in (5, 8):
            raise ContainerError(f"tree of type {kind}")
        find = self._fractal(heap)
        for r in self._records(tree):
            r.take(4 * (kind == 5))  # links: after the hash of the name
            yield find(r)

    def _fractal(self, address: int) -> Callable[[Bytes], Bytes]:
        """What finds an object of a fractal heap by its id."""
        c = Bytes(self.data, self.base + address)
        c.expect(b"FRHP")
        c.take(3)
        filtered, flags, largest = c.number(2), c.number(1), c.number(4)
        c.take(10 * self.l + 2 * self.o)
        width, start, direct, bits = c.number(2), c.number(self.l), c.number(self.l), c.number(2)
        c.take(2)
        root, rows = c.number(self.o), c.number(2)
        if filtered or not width or not start or direct < start:
            raise ContainerError("filtered or broken heap")
        offsets, lengths = (bits + 7) // 8, min(bytes_for(direct), bytes_for(largest))
        straight = (direct // start).bit_length() + 1  # rows of direct blocks

        def block(at: int, rows: int, inside: int, depth: int = 0) -> tuple[int, int]:
            """Address of the direct block that holds a place, and the place within it."""
            if depth > DEPTH or at == self.nowhere:
                raise ContainerError("heap block")
            if not rows:
                return at, inside
            row, low, size = 0, 0, start
            while inside >= low + width * size:
                low += width * size
                size = start << row
                row += 1
            which, rest = divmod(inside - low, size)
            if row >= rows:
                raise ContainerError("heap id beyond its blocks")
            i = Bytes(self.data, self.base + at)
            i.expect(b"FHIB")
            i.take(1 + self.o + offsets + (row * width + which) * self.o)
            # An indirect block of n rows spans start * width * 2 ** (n - 1).
            return block(i.number(self.o), 0 if row < straight else (size // (start * width)).bit_length(), rest, depth + 1)

        def find(c: Bytes) -> Bytes:
            head = c.number(1)
            if head >> 4 & 3:
                raise ContainerError("huge or tiny heap object")
            place, n = c.number(offsets), c.number(lengths)
            at, rest = block(root, rows, place)
            Bytes(self.data, self.base + at).expect(b"FHDB")
            at = self.base + at + rest
            Bytes(self.data, at).take(n)
            return Bytes(self.data, at, at + n)

        return find

    def shared_value(self, heap: int, index: int) -> bytes:
        """An object of a global heap collection; each collection is parsed once."""
        if heap not in self._heaps:
            c = Bytes(self.data, self.base + heap)
            start = c.at
            c.expect(b"GCOL")
            c.take(4)
            end, held = start + c.number(self.l), {}
            while c.at + 8 + self.l <= end:
                i = c.number(2)
                c.take(6)
                n = c.number(self.l)
                if i == 0:
                    break
                held[i] = c.take(n)
                c.take(min(-n % 8, max(0, c.end - c.at)))
            self._heaps[heap] = held
        if index not in self._heaps[heap]:
            raise ContainerError(f"no object {index} in the heap at {heap}")
        return self._heaps[heap][index]

    def walk(self) -> Iterator[tuple[str, Dataset | Group]]:
        """All objects with their paths, each once; the root's path is empty."""
        seen, todo = set(), [("", self.root)]
        while todo:
            path, address = todo.pop()
            if address in seen:
                continue
            seen.add(address)
            found = self.object(address)
            yield path, found
            if isinstance(found, Group):
                todo += [(f"{path}/{n}".lstrip("/"), a) for n, a in sorted(found.links.items(), reverse=True)]

    def find(self, path: str) -> Dataset | Group:
        """The object at a path; soft links are followed, from their group or from the root."""
        found, above, left, turns = self.object(self.root), [], [p for p in reversed(path.split("/")) if p], 0
        while left:
            name = left.pop()
            if isinstance(found, Group) and name in found.links:
                above.append(found)
                found = self.object(found.links[name])
            elif isinstance(found, Group) and name in found.soft and (turns := turns + 1) <= FOLLOWED:
                to = found.soft[name]
                if to.startswith("/"):
                    found, above = self.object(self.root), []
                left += [p for p in reversed(to.split("/")) if p and p != "."]
            elif name == ".." and above:
                found = above.pop()
            else:
                raise ContainerError(f"no object {path}")
        return found

    def addresses(self) -> dict[str, int]:
        """Where each dataset's elements, or its index, lie in the file."""
        return {p: x.layout[1] if x.layout[0] != "compact" else 0 for p, x in self.walk() if isinstance(x, Dataset)}

    def mappings(self, d: Dataset) -> list[Mapping_]:
        """What a virtual dataset is made of."""
        if d.layout[0] != "virtual":
            raise ContainerError("no virtual dataset")
        return [] if d.layout[1] == self.nowhere else virtual_mappings(self.shared_value(d.layout[1], d.layout[2]))

    # Elements.

    def _chunks(self, d: Dataset) -> Iterator[tuple[tuple[int, ...], int, int | None, int]]:
        """(offsets, address, stored bytes or None for all, filter mask) of the chunks that are there."""
        which, address, chunk = d.layout[:3]
        # Numbers of chunks follow the extents that the array may grow to; an axis without bound counts slowest.
        most = d.most or d.shape
        free = most.index(None) if which == "extensible" and None in most else 0
        axes = [free, *(a for a in range(len(chunk)) if a != free)]
        counts = [-(-(d.shape[a] if most[a] is None else max(most[a], d.shape[a])) // chunk[a]) for a in axes]

        def place(i: int) -> tuple[int, ...]:
            at = [0] * len(chunk)
            for a, n in zip(reversed(axes), reversed(counts), strict=True):
                i, at[a] = (i, 0) if n == 0 else divmod(i, n) if a != axes[0] else (0, i)
            return tuple(x * c for x, c in zip(at, chunk, strict=True))

        size = prod(chunk) * d.kind.dtype.itemsize
        if address == self.nowhere:
            return
        if which == "single":
            yield (0,) * len(chunk), address, d.layout[3][0], d.layout[3][1]
        elif which == "implicit":
            yield from ((place(i), address + i * size, None, 0) for i in range(prod(counts)))
        elif which in ("fixed", "extensible"):
            found = self._fixed(address) if which == "fixed" else self._extensible(address)
            for i, to, stored, mask in found:
                if to != self.nowhere:
                    yield place(i), to, stored, mask
        elif which == "btree2":
            for r in self._records(address):
                to, n = r.number(self.o), r.end - r.at - 8 * len(chunk)
                stored, mask = (r.number(n - 4), r.number(4)) if n else (None, 0)
                yield tuple(r.number(8) * c for c in chunk), to, stored, mask
        else:
            yield from self._leaves(address, len(chunk), 0)

    def _entries(self, c: Bytes, first: int, n: int, entry: int, filtered: int) -> Iterator[tuple[int, int, int | None, int]]:
        """n entries of a chunk array: (number, address, stored bytes, mask)."""
        for i in range(first, first + n):
            to = c.number(self.o)
            stored, mask = (c.number(entry - self.o - 4), c.number(4)) if filtered else (None, 0)
            yield i, to, stored, mask

    def _pages(self, c: Bytes, first: int, n: int, page: int, there: bytes | None, entry: int, filtered: int) -> Iterator[tuple[int, int, int | None, int]]:
        """Entries of a paged block. there: a bit for each page that was written, or None for all."""
        for k in range(-(-n // page)):
            held = min(page, n - k * page)
            if there is None or there[k // 8] & (128 >> k % 8):
                yield from self._entries(c, first + k * page, held, entry, filtered)
                c.take(4)
            else:
                c.take(held * entry + 4)

    def _fixed(self, address: int) -> Iterator[tuple[int, int, int | None, int]]:
        c = Bytes(self.data, self.base + address)
        c.expect(b"FAHD")
        c.take(1)
        filtered, entry, bits, n, block = c.number(1), c.number(1), c.number(1), c.number(self.l), c.number(self.o)
        if block == self.nowhere:
            return
        c = Bytes(self.data, self.base + block)
        c.expect(b"FADB")
        c.take(2 + self.o)
        if n <= 1 << bits:
            yield from self._entries(c, 0, n, entry, filtered)
        else:
            there = c.take((-(-n >> bits) + 7) // 8)
            c.take(4)
            yield from self._pages(c, 0, n, 1 << bits, there, entry, filtered)

    def _extensible(self, address: int) -> Iterator[tuple[int, int, int | None, int]]:
        c = Bytes(self.data, self.base + address)
        c.expect(b"EAHD")
        c.take(1)
        filtered, entry, bits, inline, least, pointers, paged = (c.number(1) for _ in range(7))
        c.take(4 * self.l)
        n = c.number(self.l)
        c.take(self.l)
        index = c.number(self.o)
        if index == self.nowhere:
            return
        if bits > 64 or not least or not pointers:
            raise ContainerError("extensible array")
        wide, page = (bits + 7) // 8, 1 << paged
        c = Bytes(self.data, self.base + index)
        c.expect(b"EAIB")
        c.take(2 + self.o)
        yield from self._entries(c, 0, min(inline, n), entry, filtered)
        c.take((inline - min(inline, n)) * entry)

        def block(to: int, first: int, size: int, there: bytes | None) -> Iterator[tuple[int, int, int | None, int]]:
            held = min(size, n - first)
            if to == self.nowhere or held <= 0:
                return
            b = Bytes(self.data, self.base + to)
            b.expect(b"EADB")
            b.take(2 + self.o + wide)
            if size <= page:
                yield from self._entries(b, first, held, entry, filtered)
            else:
                b.take(4)
                yield from (e for e in self._pages(b, first, size, page, there, entry, filtered) if e[0] < n)

        first = inline
        for level, blocks, size in levels(bits, least):
            if first >= n:
                return
            if level < 2 * (pointers.bit_length() - 1):  # the index block points to the first levels' blocks itself
                for _ in range(blocks):
                    yield from block(c.number(self.o), first, size, None)
                    first += size
            else:
                to = c.number(self.o)
                if to != self.nowhere:
                    b = Bytes(self.data, self.base + to)
                    b.expect(b"EASB")
                    b.take(2 + self.o + wide)
                    marks = (-(-size // page) + 7) // 8 if size > page else 0
                    there = [b.take(marks) for _ in range(blocks)]
                    for k in range(blocks):
                        yield from block(b.number(self.o), first + k * size, size, there[k] if marks else None)
                first += blocks * size

    def _leaves(self, address: int, rank: int, depth: int) -> Iterator[tuple[tuple[int, ...], int, int | None, int]]:
        if depth > DEPTH:
            raise ContainerError("chunk tree too deep")
        c = Bytes(self.data, self.base + address)
        c.expect(b"TREE")
        c.take(1)
        level, n = c.number(1), c.number(2)
        c.take(2 * self.o)
        for _ in range(n):
            stored, mask = c.number(4), c.number(4)
            offsets = tuple(c.number(8) for _ in range(rank + 1))[:-1]
            to = c.number(self.o)
            if level:
                yield from self._leaves(to, rank, depth + 1)
            else:
                yield offsets, to, stored, mask

    def blocks(self, d: Dataset, slab: Hyperslab | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """(offsets, elements) of the parts of a dataset that meet the selection's hull; unwritten parts are left out."""
        item = d.kind.dtype.itemsize
        if d.layout[0] in ("compact", "contiguous"):
            raw = d.layout[1] if d.layout[0] == "compact" else b"" if d.layout[1] == self.nowhere else Bytes(self.data, self.base + d.layout[1]).take(prod(d.shape) * item)
            if len(raw) >= prod(d.shape) * item and raw:
                yield (0,) * len(d.shape), np.frombuffer(raw, d.kind.dtype, prod(d.shape)).reshape(d.shape)
            return
        if d.layout[0] == "virtual":
            raise ContainerError("a virtual dataset's elements lie in other datasets: see its mappings")
        chunk = d.layout[2]
        hull = slab.hull() if slab else [(0, n - 1) for n in d.shape]
        for entry in self._chunks(d):
            if all(o < n and o <= hi and o + c > lo for n, o, c, (lo, hi) in zip(d.shape, entry[0], chunk, hull, strict=True)):
                yield entry[0], self.chunk(d, *entry)

    def chunk(self, d: Dataset, offsets: tuple[int, ...], address: int, stored: int | None, mask: int) -> np.ndarray:
        """The elements of a chunk, without what lies beyond the array."""
        item, size = d.kind.dtype.itemsize, prod(d.layout[2])
        raw = Bytes(self.data, self.base + address).take(size * item if stored is None else stored)
        try:
            raw = codecs.undo(raw, d.filters, mask)
        except Exception as e:
            raise ContainerError(f"chunk {offsets}: {e}") from e
        if len(raw) < size * item:
            raise ContainerError(f"chunk {offsets} is short")
        part = np.frombuffer(raw, d.kind.dtype, size).reshape(d.layout[2])
        return part[tuple(slice(0, n - o) for n, o in zip(d.shape, offsets, strict=True))]

    def array(self, path: str) -> np.ndarray:
        """A whole dataset; unwritten chunks are 0."""
        d = self.find(path)
        if not isinstance(d, Dataset):
            raise ContainerError(f"{path} is a group")
        out = np.zeros(d.shape, d.kind.dtype)
        for offsets, part in self.blocks(d):
            out[tuple(slice(o, o + n) for o, n in zip(offsets, part.shape, strict=True))] = part
        return out


def levels(bits: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(level, data blocks, elements of each) of an extensible array: every second level doubles the blocks, the others their size."""
    for u in range(bits - least.bit_length() + 2):
        yield u, 1 << u // 2, least << (u + 1) // 2


def decoded(values: np.ndarray, kind: Kind, box: Container | None = None) -> list:
    """Python values; strings by their padding, enums by name, other raw bytes as they are. box: the file, for values of variable length."""
    flat = values.ravel()
    if kind.name == "string":
        cut = {"null_term": lambda b: b.split(b"\0")[0], "null_pad": lambda b: b.rstrip(b"\0"), "space_pad": lambda b: b.rstrip(b" ")}[kind.padding]
        return [cut(v.tobytes()).decode("utf-8", "replace") for v in flat]
    if kind.name == "enum":
        return [kind.members.get(v.item(), f"UNKNOWN(0x{v.tobytes().hex()})") for v in flat]
    if kind.name == "array":
        return [np.frombuffer(v.tobytes(), kind.base.dtype).reshape(kind.dims).tolist() for v in flat]
    if kind.name == "variable" and box:
        return [_variable(Bytes(v.tobytes()), kind, box) for v in flat]
    return [v.tobytes() for v in flat] if kind.dtype.kind == "V" and not kind.dtype.names else flat.tolist()


def _variable(c: Bytes, kind: Kind, box: Container) -> str | list:
    """A value of variable length; one that is nowhere is empty."""
    n, heap, index = c.number(4), c.number(box.o), c.number(4)
    raw = b"" if not n or heap in (0, box.nowhere) else box.shared_value(heap, index)
    if kind.padding == "string":
        return raw[:n].split(b"\0")[0].decode("utf-8", "replace")
    return decoded(np.frombuffer(raw[: n * kind.base.dtype.itemsize], kind.base.dtype), kind.base, box)


# Spark.


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, content) of the files at a path, or of a table that has these columns."""
    return (path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)).select("path", "content")


def objects(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, path, kind, dtype, shape, layout, and attributes as strings, of all objects of all files at a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for p, x in Container(content).walk():
                    told = {k: str(v) for k, v in x.attributes.items()}
                    rows.append({"file": file, "path": p, "kind": "dataset", "dtype": x.kind.name, "shape": list(x.shape), "layout": x.layout[0], "attributes": list(told.items())} if isinstance(x, Dataset) else {"file": file, "path": p, "kind": "group", "dtype": None, "shape": None, "layout": None, "attributes": list(told.items())})
                shape = pa.schema([("file", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("layout", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return _files(spark, path).mapInArrow(run, "file string, path string, kind string, dtype string, shape array<bigint>, layout string, attributes map<string,string>")


def read(spark: SparkSession, path: str | DataFrame, dataset: str, rank: int, slab: Hyperslab | None = None, kind: str = "double") -> DataFrame:
    """file, i0.., value of one dataset in all files at a path. kind: double, bigint or string.

    Of chunked data only chunks that meet the selection's hull are decoded; the rows are the selected ones.
    """
    from arrayloom.operators.selection import select

    axes = [f"i{d}" for d in range(rank)]
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                box = Container(content)
                d = box.find(dataset)
                if not isinstance(d, Dataset) or len(d.shape) != rank:
                    raise ContainerError(f"{dataset} is no dataset of {rank} axes")
                for offsets, part in box.blocks(d, slab):
                    places = [i.ravel() + o for i, o in zip(np.indices(part.shape), offsets, strict=True)]
                    values = pa.array(decoded(part, d.kind, box), pa.string()) if kind == "string" else pa.array(part.ravel().astype("f8" if kind == "double" else "i8"), arrow)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * part.size, pa.string()), *(pa.array(p.astype("i8")) for p in places), values], names=["file", *axes, "value"])

    rows = _files(spark, path).mapInArrow(run, f"file string, {', '.join(f'{a} bigint' for a in axes)}, value {kind}")
    return select(rows, axes, slab) if slab else rows


def read_multi(spark: SparkSession, path: str | DataFrame, wanted: Sequence[str]) -> DataFrame:
    """file, pos, dataset, payload (the elements' bytes, as stored by their type) of several datasets of every file, in the order asked (sort by pos).

    In a file they are read in the order in which they lie there. An unknown name is an error.
    """
    names = list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                box = Container(content)
                at = box.addresses()
                for i in sorted(range(len(names)), key=lambda i: at.get(names[i].strip("/"), 0)):  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([i], pa.int32()), pa.array([names[i]], pa.string()), pa.array([box.array(names[i]).tobytes()], pa.binary())], names=["file", "pos", "dataset", "payload"])

    return _files(spark, path).mapInArrow(run, "file string, pos int, dataset string, payload binary")


def read_records(spark: SparkSession, path: str | DataFrame, dataset: str, schema: str) -> DataFrame:
    """file, i0 and the named fields of a dataset of structures with one axis, in all files: only these fields are taken from the elements. schema: as ``"key bigint, price double"``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                box = Container(content)
                d = box.find(dataset)
                if not isinstance(d, Dataset) or d.kind.name != "compound" or len(d.shape) != 1:
                    raise ContainerError(f"{dataset} is no list of structures")
                if missing := [f.name for f in wanted if f.name not in d.kind.dtype.names]:
                    raise ContainerError(f"{dataset} has no field {', '.join(missing)}")
                for (first,), part in box.blocks(d):
                    fields = [pa.array(part[f.name].astype(part[f.name].dtype.newbyteorder("="))).cast(f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array(np.arange(first, first + len(part))), *fields], names=["file", "i0", *wanted.names])

    return _files(spark, path).mapInArrow(run, f"file string, i0 bigint, {schema}")


# Writing.

#: A chunk shape: the whole dataset.
AUTO = "auto"


def chain(shuffle: bool = False, deflate: int | None = None, lz4: bool = False, zstd: int | None = None, fletcher32: bool = False) -> list[tuple[str, int]]:
    """Filters in the order in which they are stored: bytes in their order first, one compression (zstd before lz4 before deflate), the checksum last."""
    packed = [("zstd", zstd)] if zstd is not None else [("lz4", 0)] if lz4 else [("deflate", deflate)] if deflate is not None else []
    return [*([("shuffle", 0)] if shuffle else []), *packed, *([("fletcher32", 0)] if fletcher32 else [])]


def enumeration(base: str, members: Mapping[str, int]) -> np.dtype:
    """An integer type whose values have names."""
    return np.dtype(base, metadata={"enum": dict(members)})


def _type_message(dtype: np.dtype) -> bytes:
    size = dtype.itemsize
    if members := (dtype.metadata or {}).get("enum"):
        names = b"".join(n.encode() + b"\0" for n in members)
        return struct.pack("<BHBI", 0x38, len(members), 0, size) + _type_message(np.dtype(dtype.str)) + names + np.array(list(members.values()), dtype.str).tobytes()
    if dtype.kind in "iu":
        return struct.pack("<B3BIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, size, 0, 8 * size)
    if dtype.kind == "f" and size in (4, 8):
        sign, exponent, mantissa, bias = (31, 8, 23, 127) if size == 4 else (63, 11, 52, 1023)
        return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, sign, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)
    if dtype.kind == "S":
        return struct.pack("<B3BI", 0x13, 1, 0, 0, max(1, size))
    if dtype.subdtype:
        base, dims = dtype.subdtype
        return struct.pack("<B3BIB", 0x3A, 0, 0, 0, size, len(dims)) + struct.pack(f"<{len(dims)}I", *dims) + _type_message(base)
    if dtype.names:
        wide = (max(size - 1, 1).bit_length() + 7) // 8
        parts = b"".join(n.encode() + b"\0" + dtype.fields[n][1].to_bytes(wide, "little") + _type_message(dtype.fields[n][0]) for n in dtype.names)
        return struct.pack("<BHBI", 0x36, len(dtype.names), 0, size) + parts
    if dtype.kind == "O":  # strings of variable length
        return struct.pack("<B3BI", 0x39, 1, 1, 0, 16) + _type_message(np.dtype("u1"))
    raise ContainerError(f"{dtype} can't be written")


def _header(messages: Sequence[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
    raw = b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body
    return raw + struct.pack("<I", lookup3(raw))


def _space_message(shape: Sequence[int], most: Sequence[int | None] | None = None) -> bytes:
    told = [*shape, *(NOWHERE if n is None else n for n in most or ())]
    return struct.pack("<BBBB", 2, len(shape), int(bool(most)), int(bool(shape))) + b"".join(struct.pack("<Q", n) for n in told)


def _attribute_message(name: str, value: object) -> bytes:
    a = np.asarray(value.encode() if isinstance(value, str) else value)
    a = a.astype(a.dtype.newbyteorder("<"))
    n, t, s = name.encode() + b"\0", _type_message(a.dtype), _space_message(a.shape)
    return struct.pack("<BBHHHB", 3, 0, len(n), len(t), len(s), 1) + n + t + s + (a.tobytes() or b"\0")


# The writer's parameters: bits of a page's entries; of extensible arrays bits, entries in the index block, pointers and entries at least; of heaps width, first and largest block.
PAGE_BITS, GROWING, HEAP, COMPACT = 10, (32, 4, 4, 16), (4, 512, 65536), 8


def write(arrays: Mapping[str, np.ndarray], attributes: Mapping[str, Mapping[str, object]] | None = None, chunks: Mapping[str, Sequence[int]] | None = None, filters: Sequence[tuple[str, int]] = (), most: Mapping[str, Sequence[int | None]] | None = None, compact: Sequence[str] = (), align: int = 1, fill_times: Mapping[str, str] | None = None, links: Mapping[str, str | tuple[str, str]] | None = None, arrays_of: Mapping[str, int] | None = None) -> bytes:
    """One file's bytes: datasets by path (groups are made), attributes by path, chunk shapes by path.

    A chunk shape may be AUTO, the whole dataset; filters without any chunk shape make all datasets chunked so.
    arrays_of: by path how many of the last axes are one element, of an array type.

    compact: paths of datasets of less than 64 KB that lie in their headers. align: a contiguous dataset's elements begin at a multiple of it.
    fill_times: never, alloc or ifset, by path. links: soft links, path to path, or external ones, path to (file, path).

    filters hold for chunked datasets. most: the extents that a chunked dataset may grow to, at most one axis None (without bound).
    Edge chunks are filled with 0. An axis without bound: extensible array; else one chunk: single-chunk index; more: a fixed array.
    Objects with more than eight attributes or links keep them in a heap. Types: numbers, S strings, object arrays of str
    (variable length), structured types, and integers whose dtype.metadata names an "enum".
    """
    most, fill_times, links, arrays_of = most or {}, fill_times or {}, links or {}, arrays_of or {}
    if align < 1:
        raise ContainerError("alignment of 1 at least")
    attributes, chunks = attributes or {}, dict(chunks or {})
    if filters and not chunks:
        chunks = {p: AUTO for p, a in arrays.items() if np.ndim(a) and np.size(a) and p not in compact}
    chunks = {p: np.shape(arrays[p]) if c == AUTO else c for p, c in chunks.items()}
    out = bytearray(48)
    ids = {v: k for k, v in FILTER_NAMES.items()}
    put = lambda b: (len(out), out.extend(b))[0]
    tree: dict = {}
    for path in sorted([*arrays, *links]):
        parts = [p for p in path.split("/") if p]
        node = tree
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        if not parts or not isinstance(node, dict) or parts[-1] in node:
            raise ContainerError(f"{path} can't be placed")
        node[parts[-1]] = path

    def summed(raw: bytes) -> int:
        return put(raw + struct.pack("<I", lookup3(raw)))

    def kept(which: int, named: list[tuple[str, bytes]]) -> list[tuple[int, bytes]]:
        """Messages for the header: each one, or for many of them one that points to a heap and a tree."""
        if len(named) <= COMPACT:
            return [(which, m) for _, m in named]
        width, start, direct = HEAP
        head, blocks = len(out), []  # blocks: [place in the heap, size, bytes in use, contents]
        put(bytes(146))
        places, ids = [], []
        for _, m in named:
            while not blocks or blocks[-1][2] + len(m) > blocks[-1][1]:
                size = start << max(0, len(blocks) // width - 1)
                if size > direct:
                    raise ContainerError("too many messages")
                blocks.append([sum(b[1] for b in blocks), size, 5 + 8 + 4, b""])
            b = blocks[-1]
            ids.append(struct.pack("<BIH", 0, b[0] + b[2], len(m)))
            b[2] += len(m)
            b[3] += m
        for place, size, used, raw in blocks:
            places.append(put((b"FHDB" + struct.pack("<BQI", 0, head, place) + raw).ljust(size, b"\0")) if used > 17 else NOWHERE)
        rows = 0 if len(blocks) == 1 else -(-len(blocks) // width)
        root = places[0]
        if rows:
            root = summed(b"FHIB" + struct.pack("<BQI", 0, head, 0) + b"".join(struct.pack("<Q", p) for p in [*places, *[NOWHERE] * (rows * width - len(places))]))
        total = sum(b[1] for b in blocks)
        told = b"FRHP" + struct.pack("<BHHBI", 0, 8, 0, 0, 4096) + struct.pack("<QQQQ", 0, NOWHERE, 0, NOWHERE) + struct.pack("<8Q", total, total, total, len(named), 0, 0, 0, 0) + struct.pack("<HQQHHQH", width, start, direct, 32, 1, root, rows)
        told += struct.pack("<I", lookup3(told))
        out[head : head + len(told)] = told
        entries = sorted((lookup3(n.encode()), i) for (n, _), i in zip(named, ids, strict=True))
        if which == LINK:
            records = [struct.pack("<I", h) + i for h, i in entries]
        else:
            records = [i + b"\0" + struct.pack("<BII", 0, 0, h) for h, i in entries]
        kind, size = (5, 11) if which == LINK else (8, 17)
        node = max(512, 10 + size * len(records))
        leaf = put((lambda raw: raw + struct.pack("<I", lookup3(raw)))(b"BTLF" + struct.pack("<BB", 0, kind) + b"".join(records)).ljust(node, b"\0"))
        tree = summed(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, node, size, 0, 100, 40, leaf, len(records), len(records)))
        return [(LINKS if which == LINK else DENSE, struct.pack("<BBQQ", 0, 0, head, tree))]

    def attrs(path: str) -> list[tuple[int, bytes]]:
        return kept(ATTRIBUTE, [(k, _attribute_message(k, v)) for k, v in sorted(attributes.get(path, {}).items())])

    def in_heaps(values: np.ndarray) -> np.ndarray:
        """Strings of variable length: their bytes go to global heaps, what stays points to them."""
        made, raws = np.zeros(values.size, [("n", "<u4"), ("heap", "<u8"), ("i", "<u4")]), [str(v).encode() for v in values.ravel()]
        for lo in range(0, len(raws), 60000):
            part = raws[lo : lo + 60000]
            held = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, len(r)) + r + bytes(-len(r) % 8) for i, r in enumerate(part))
            size = max(4096, len(held) + 16)
            at = put((b"GCOL" + struct.pack("<B3xQ", 1, size) + held + struct.pack("<HHIQ", 0, 0, 0, size - 16 - len(held)))[:size].ljust(size, b"\0"))
            for i, r in enumerate(part):
                made[lo + i] = (len(r), at, i + 1) if r else (0, 0, 0)
        return made.reshape(values.shape)

    def dataset(path: str) -> int:
        a = np.ascontiguousarray(arrays[path])
        grows, inner = most.get(path), arrays_of.get(path, 0)
        if inner:
            if path in chunks or path in compact or inner > a.ndim:
                raise ContainerError(f"{path}: elements that are arrays lie in one piece")
            outer, kind = a.shape[: a.ndim - inner], np.dtype((a.dtype.newbyteorder("<"), a.shape[a.ndim - inner :]))
            at = put(a.astype(a.dtype.newbyteorder("<")).tobytes()) if a.size else NOWHERE
            return put(_header([(SPACE, _space_message(outer)), (TYPE, _type_message(kind)), (LAYOUT, struct.pack("<BBQQ", 3, 1, at, a.nbytes)), *attrs(path)]))
        head = [(SPACE, _space_message(a.shape, grows)), (TYPE, _type_message(a.dtype))]
        if path in fill_times:
            head.append((FILL, bytes([3, FILL_TIMES[fill_times[path]]])))
        a = in_heaps(a) if a.dtype.kind == "O" else a.astype(a.dtype.newbyteorder("<"))
        if grows and (path not in chunks or sum(n is None for n in grows) > 1 or any(n is not None and n < have for n, have in zip(grows, a.shape, strict=True))):
            raise ContainerError(f"{path} can't grow to {grows}")
        if path in compact:
            if path in chunks or a.nbytes > 65535:
                raise ContainerError(f"{path} can't be compact")
            return put(_header([*head, (LAYOUT, struct.pack("<BBH", 3, 0, a.nbytes) + a.tobytes()), *attrs(path)]))
        if path not in chunks:
            if a.size:
                out.extend(bytes(-len(out) % align))
            at = put(a.tobytes()) if a.size else NOWHERE
            return put(_header([*head, (LAYOUT, struct.pack("<BBQQ", 3, 1, at, a.nbytes)), *attrs(path)]))
        free = list(grows).index(None) if grows and None in grows else None
        top = [have if n is None else n for n, have in zip(grows or a.shape, a.shape, strict=True)]
        chunk = [c if d == free else min(c, max(n, 1)) for d, (c, n) in enumerate(zip(chunks[path], top, strict=True))]
        steps = [(n, a.itemsize if n == "shuffle" else v) for n, v in filters]
        axes = sorted(range(a.ndim), key=lambda d: d != free)  # the axis without bound counts slowest
        counts = [-(-top[d] // chunk[d]) for d in axes]
        held = []
        for i in range(prod(counts)):
            at = dict(zip(axes, np.unravel_index(i, counts), strict=True))
            offsets = [int(at[d]) * chunk[d] for d in range(a.ndim)]
            if any(o >= n for o, n in zip(offsets, a.shape, strict=True)):
                held.append((NOWHERE, 0))
                continue
            part = a[tuple(slice(o, o + c) for o, c in zip(offsets, chunk, strict=True))]
            full = np.zeros(chunk, a.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            raw = codecs.apply(full.tobytes(), steps)
            held.append((put(raw), len(raw)))
        single = len(held) == 1 and free is None
        layout = struct.pack("<BBBBB", 4, 2, 2 * (single and bool(steps)), len(chunk) + 1, 8) + b"".join(struct.pack("<Q", c) for c in (*chunk, a.itemsize))
        entries = [struct.pack("<QQI", at, n, 0) if steps else struct.pack("<Q", at) for at, n in held]
        size, mark = 20 if steps else 8, bytes([0, bool(steps)])
        if single:
            layout += b"\x01" + (struct.pack("<QI", held[0][1], 0) if steps else b"") + struct.pack("<Q", held[0][0])
        elif free is None:
            at = len(out)
            summed(b"FAHD" + mark + struct.pack("<BBQQ", size, PAGE_BITS, len(held), at + 28))
            fadb = b"FADB" + mark + struct.pack("<Q", at)
            if len(held) <= 1 << PAGE_BITS:
                summed(fadb + b"".join(entries))
            else:
                pages = -(-len(held) >> PAGE_BITS)
                there = sum(128 >> k % 8 << 8 * (k // 8) for k in range(pages))
                summed(fadb + there.to_bytes((pages + 7) // 8, "little"))
                for k in range(pages):
                    summed(b"".join(entries[k << PAGE_BITS : k + 1 << PAGE_BITS]))
            layout += b"\x03" + bytes([PAGE_BITS]) + struct.pack("<Q", at)
        else:
            layout += b"\x04" + bytes([GROWING[0], GROWING[1], GROWING[2], GROWING[3], PAGE_BITS]) + struct.pack("<Q", growing(entries, mark, size))
        if steps:
            listed = b"".join(struct.pack("<H", ids[n]) + (struct.pack("<H", 0) if ids[n] >= 256 else b"") + struct.pack("<HHI", 0, 1, v) for n, v in steps)
            head.append((FILTERS, struct.pack("<BB", 2, len(steps)) + listed))
        return put(_header([*head, (LAYOUT, layout), *attrs(path)]))

    def growing(entries: list[bytes], mark: bytes, size: int) -> int:
        """An extensible array of these entries; its header's place."""
        bits, inline, pointers, least = GROWING
        none = struct.pack("<QQI", NOWHERE, 0, 0) if size == 20 else struct.pack("<Q", NOWHERE)
        filled = lambda lo, n: b"".join(entries[lo : lo + n]) + none * (n - len(entries[lo : lo + n]))
        head, place = put(bytes(72)), (bits + 7) // 8

        def block(lo: int, n: int) -> int:
            start = b"EADB" + mark + struct.pack("<Q", head) + (lo - inline).to_bytes(place, "little")
            if n <= 1 << PAGE_BITS:
                return summed(start + filled(lo, n))
            at = summed(start)
            for k in range(lo, lo + n, 1 << PAGE_BITS):
                summed(filled(k, 1 << PAGE_BITS))
            return at

        index, first, n_blocks, n_super = [], inline, 0, 0
        for level, blocks, n in levels(bits, least):
            direct = level < 2 * (pointers.bit_length() - 1)
            at = [block(lo, n) if lo < len(entries) else NOWHERE for lo in range(first, first + blocks * n, n)] if direct or first < len(entries) else []
            n_blocks += sum(x != NOWHERE for x in at)
            if direct:
                index += at
            elif not at:
                index.append(NOWHERE)
            else:
                marks = (-(-n >> PAGE_BITS) + 7) // 8 if n > 1 << PAGE_BITS else 0
                index.append(summed(b"EASB" + mark + struct.pack("<Q", head) + (first - inline).to_bytes(place, "little") + b"\xff" * (marks * blocks) + struct.pack(f"<{blocks}Q", *at)))
                n_super += 1
            first += blocks * n
        to = summed(b"EAIB" + mark + struct.pack("<Q", head) + filled(0, inline) + struct.pack(f"<{len(index)}Q", *index))
        told = b"EAHD" + mark + bytes([size, bits, inline, least, pointers, PAGE_BITS]) + struct.pack("<7Q", n_super, 0, n_blocks, 0, len(entries), len(entries), to)
        out[head : head + 72] = told + struct.pack("<I", lookup3(told))
        return head

    def group(node: dict, path: str) -> int:
        listed = []
        for name, x in sorted(node.items()):
            if isinstance(x, str) and x in links:
                raw, to = name.encode(), links[x]
                told = to.encode() if isinstance(to, str) else b"\0" + to[0].encode() + b"\0" + to[1].encode() + b"\0"
                listed.append((name, struct.pack("<BBBH", 1, 9, 1 if isinstance(to, str) else 64, len(raw)) + raw + struct.pack("<H", len(told)) + told))
                continue
            to = group(x, f"{path}/{name}".lstrip("/")) if isinstance(x, dict) else dataset(x)
            raw = name.encode()
            listed.append((name, struct.pack("<BBH", 1, 1, len(raw)) + raw + struct.pack("<Q", to)))
        return put(_header([*kept(LINK, listed), *attrs(path)]))

    root = group(tree, "")
    head = SIGNATURE + struct.pack("<BBBBQQQQ", 3, 8, 8, 0, 0, NOWHERE, len(out), root)
    out[:48] = head + struct.pack("<I", lookup3(head))
    return bytes(out)


def merged(parts: Sequence[Mapping[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The datasets that several creators have made, by name; a name that two of them made is an error."""
    out: dict[str, np.ndarray] = {}
    for part in parts:
        if twice := sorted(set(out) & set(part)):
            raise ContainerError(f"made twice: {', '.join(twice)}")
        out.update(part)
    return dict(sorted(out.items()))


def build(rows: DataFrame, chunk: Sequence[int] | None = None, filters: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """(path, content): a file for each value of file. rows: file, dataset, shape (array of bigint) and payload (array of double, the last axis fastest), a row a dataset.

    Files are built side by side, each in one task; a dataset that stands twice in a file is an error.
    """
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = merged([{d: np.asarray(v, "f8").reshape([int(n) for n in s])} for d, s, v in zip(part["dataset"], part["shape"], part["payload"], strict=True)])
        chunks = {d: [min(c, max(1, n)) for c, n in zip(chunk, a.shape, strict=True)] for d, a in made.items() if chunk and len(chunk) == a.ndim}
        return pd.DataFrame({"path": [part["file"].iloc[0]], "content": [write(made, chunks=chunks, filters=filters if chunks else ())]})

    return rows.select("file", "dataset", "shape", "payload").groupBy("file").applyInPandas(run, "path string, content binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """(path, length) of files (path, content) that tasks write to a folder that all of them share."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(at, recursive=True)
        for b in batches:
            names = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # Written aside and then moved, so that a task that runs again leaves no half of a file.
                with store.open_output_stream(f"{at}/.{name}.part") as f:
                    f.write(content)
                store.move(f"{at}/.{name}.part", f"{at}/{name}")
                names.append(f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c) for c in b.column(1).to_pylist()], pa.int64())], names=["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, length long")
