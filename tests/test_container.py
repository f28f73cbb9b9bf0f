"""Container files: round trips through Spark, hand-built old structures, and broken files."""

import struct

import numpy as np
import pytest

from arrayloom.operators.selection import Hyperslab
from arrayloom.sources import container as c

GRID = np.arange(60, dtype="f8").reshape(6, 10)


@pytest.fixture(scope="module")
def file():
    return c.write(
        {"root_data": np.array([3.25, 7.5, -1.0]), "trees/heights": np.array([7, 81, 902], "i4"), "a/b/c/deep": np.array([6.5]), "grid": GRID, "one": GRID, "plain": GRID, "names": np.array([b"Juniper", b"Elm"], "S8"), "empty": np.zeros(0)},
        {"": {"place": "shore", "edition": 12}, "grid": {"scale": 0.5}}, {"grid": (4, 4), "one": (6, 10)}, [("shuffle", 0), ("deflate", 6), ("fletcher32", 0)],
    )


def test_round_trip(file):
    box = c.Container(file)
    assert box.array("root_data").tolist() == [3.25, 7.5, -1.0] and box.array("/a/b/c/deep").tolist() == [6.5]
    for name in ("grid", "one", "plain"):
        assert (box.array(name) == GRID).all()
    assert c.decoded(box.array("names"), box.find("names").kind) == ["Juniper", "Elm"] and box.array("empty").size == 0
    assert box.find("").attributes == {"place": "shore", "edition": 12} and box.find("grid").attributes == {"scale": 0.5}
    assert {p for p, _ in box.walk()} == {"", "root_data", "trees", "trees/heights", "a", "a/b", "a/b/c", "a/b/c/deep", "grid", "one", "plain", "names", "empty"}


def test_only_chunks_of_the_selection_are_decoded(file):
    box = c.Container(file)
    assert [o for o, _ in box.blocks(box.find("grid"), Hyperslab.slice((0, 2), (5, 6)))] == [(0, 4)]


def test_through_spark(spark, tmp_path, file):
    for n in range(3):
        (tmp_path / f"{n}.h5").write_bytes(file)
    got = c.read(spark, str(tmp_path), "grid", 2, Hyperslab([1, 0], [2, 3], [2, 4], [1, 1])).collect()
    want = sorted(GRID[np.ix_([1, 3], [0, 3, 6, 9])].ravel().tolist() * 3)
    assert sorted(r.value for r in got) == want
    rows = c.objects(spark, str(tmp_path)).where("path = 'grid'").collect()
    assert len(rows) == 3 and rows[0].shape == [6, 10] and rows[0].dtype == "f64" and rows[0].attributes == {"scale": "0.5"}
    assert sorted({r.value for r in c.read(spark, str(tmp_path), "names", 1, kind="string").collect()}) == ["Elm", "Juniper"]


def test_old_structures():
    """A version 0 superblock, a symbol table group and a version 1 header with a chunk tree, built by hand."""
    out = bytearray(2048)

    def at(place, data):
        out[place : place + len(data)] = data

    at(0, c.SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, c.NOWHERE, 2048, c.NOWHERE) + struct.pack("<QQII16x", 0, 96, 0, 0))
    message = lambda kind, body: struct.pack("<HHB3x", kind, len(body), 0) + body
    table = message(17, struct.pack("<QQ", 160, 224))
    at(96, struct.pack("<BBHII4x", 1, 0, 1, 1, len(table)) + table)
    at(160, b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, c.NOWHERE, c.NOWHERE, 0, 320, 8))
    at(224, b"HEAP" + struct.pack("<B3xQQQ", 0, 16, c.NOWHERE, 280))
    at(280, b"\0" * 8 + b"values\0\0")
    at(320, b"SNOD" + struct.pack("<BBH", 1, 0, 1) + struct.pack("<QQII16x", 8, 400, 0, 0))
    body = message(1, struct.pack("<BBB5xQ", 1, 1, 0, 5)) + message(3, c._type_message(np.dtype("<i4")) + b"\0" * 4) + message(8, struct.pack("<BBBQII", 3, 2, 2, 600, 3, 4) + b"\0" * 5)
    at(400, struct.pack("<BBHII4x", 1, 0, 3, 1, len(body)) + body)
    at(600, b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, c.NOWHERE, c.NOWHERE) + struct.pack("<IIQQQ", 12, 0, 0, 0, 800) + struct.pack("<IIQQQ", 12, 0, 3, 0, 820))
    at(800, np.array([10, 20, 30], "<i4").tobytes())
    at(820, np.array([40, 50, 0], "<i4").tobytes())
    assert c.Container(bytes(out)).array("values").tolist() == [10, 20, 30, 40, 50]


def test_broken_files(file):
    for data in (b"", b"short", b"\0" * 5000):
        with pytest.raises(c.ContainerError):
            c.Container(data)
    rng = np.random.default_rng(0)
    for n in [*range(0, 200, 7), *rng.integers(200, len(file), 60).tolist()]:
        try:
            box = c.Container(file[:n])
            for path, x in box.walk():
                if isinstance(x, c.Dataset):
                    box.array(path)
        except c.ContainerError:
            pass
    bad = bytearray(file)
    bad[40] ^= 1
    with pytest.raises(c.ContainerError, match="checksum"):
        c.Container(bytes(bad))
    with pytest.raises(c.ContainerError, match="no object"):
        c.Container(file).find("nothing")
    with pytest.raises(c.ContainerError, match="placed"):
        c.write({"a": np.zeros(1), "a/b": np.zeros(1)})


def test_types():
    rec = np.array([(1.0, 2.0, 10, [1, 2]), (3.0, 4.0, 20, [3, 4])], [("x", "<f8"), ("y", "<f8"), ("id", "<i4"), ("pair", "<i4", (2,))])
    colours = np.array([0, 1, 7], np.dtype("<i4", metadata={"enum": {"RED": 0, "GREEN": 1}}))
    names = np.array(["Alice", "", "Zoë", "Bob" * 5000], object)
    box = c.Container(c.write({"rec": rec, "colours": colours, "names": names}))
    got = box.array("rec")
    assert got["x"].tolist() == [1.0, 3.0] and got["id"].tolist() == [10, 20] and got["pair"].tolist() == [[1, 2], [3, 4]]
    assert c.decoded(box.array("colours"), box.find("colours").kind) == ["RED", "GREEN", "UNKNOWN(0x07000000)"]
    assert c.decoded(box.array("names"), box.find("names").kind, box) == names.tolist()


def test_strings_of_variable_length_through_spark(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(c.write({"names": np.array(["Alice", "Bob", "Charlie"], object)}, chunks={"names": (2,)}, filters=[("deflate", 6)]))
    assert {(r.i0, r.value) for r in c.read(spark, str(tmp_path), "names", 1, kind="string").collect()} == {(0, "Alice"), (1, "Bob"), (2, "Charlie")}


@pytest.mark.parametrize("n", [1, 4, 5, 36, 68, 500, 5000, 40000])
@pytest.mark.parametrize("filters", [(), [("deflate", 1)]])
def test_extensible_arrays(n, filters):
    a = np.arange(n, dtype="i4")
    box = c.Container(c.write({"a": a}, chunks={"a": (1 if n < 40000 else 3,)}, filters=filters, most={"a": (None,)}))
    d = box.find("a")
    assert d.layout[0] == "extensible" and d.most == (None,) and (box.array("a") == a).all()


def test_growing_axes_count_slowest():
    a = np.arange(7 * 9, dtype="f8").reshape(7, 9)
    for most in ((7, None), (None, 9), (10, 20), (7, 9)):
        box = c.Container(c.write({"a": a}, chunks={"a": (2, 2)}, most={"a": most}))
        assert box.find("a").most == most and (box.array("a") == a).all(), most
        assert {o for o, _ in box.blocks(box.find("a"), Hyperslab.slice((6, 40), (0, 2)))} == {(6, 0)}
    with pytest.raises(c.ContainerError, match="grow"):
        c.write({"a": a}, chunks={"a": (2, 2)}, most={"a": (None, None)})


def test_paged_fixed_arrays():
    a = np.arange(20000, dtype="i8")
    for filters in ((), [("deflate", 1)]):
        assert (c.Container(c.write({"a": a}, chunks={"a": (2,)}, filters=filters)).array("a") == a).all()


@pytest.mark.parametrize("n", [9, 50, 2000])
def test_many_links_and_attributes(n):
    box = c.Container(c.write({f"g/d{i}": np.array([i]) for i in range(n)}, {"g": {f"a{i}": "x" * (i % 300) for i in range(n)}, "g/d0": {"units": "K"}}))
    g = box.find("g")
    assert g.attributes == {f"a{i}": "x" * (i % 300) for i in range(n)} and len(g.links) == n
    assert box.array(f"g/d{n - 1}").tolist() == [n - 1] and box.find("g/d0").attributes == {"units": "K"}


def test_record_trees_of_two_levels_and_committed_types():
    """A version 2 tree of depth 1 as a chunk index, and a type that stands in another header, built by hand."""
    size, node = 8 + 8, 64  # leaves of at most 3 records
    out = bytearray(48)
    put = lambda b: (len(out), out.extend(b))[0]
    at = [put(np.array([2 * i, 2 * i + 1], "<i4").tobytes()) for i in range(5)]
    rec = [struct.pack("<QQ", at[i], i) for i in range(5)]
    leaves = [put((b"BTLF\0\x0a" + b"".join(rec[a:b])).ljust(node, b"\0")) for a, b in ((0, 2), (3, 5))]
    root = put((b"BTIN\0\x0a" + rec[2] + b"".join(struct.pack("<QB", x, 2) for x in leaves)).ljust(node, b"\0"))
    tree = put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 10, node, size, 1, 100, 40, root, 1, 5) + b"\0" * 4)
    committed = put(c._header([(c.TYPE, c._type_message(np.dtype("<i4")))]))
    layout = struct.pack("<BBBBBQQBIBBQ", 4, 2, 0, 2, 8, 2, 4, 5, node, 100, 40, tree)
    body = b"".join(struct.pack("<BHB", k, len(m), f) + m for k, m, f in [(c.SPACE, c._space_message((10,), (None,)), 0), (c.TYPE, struct.pack("<BBQ", 3, 2, committed), 2), (c.LAYOUT, layout, 0)])
    raw = b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body
    data = put(raw + struct.pack("<I", c.lookup3(raw)))
    top = put(c._header([(c.LINK, struct.pack("<BBH", 1, 1, 1) + b"a" + struct.pack("<Q", data))]))
    head = c.SIGNATURE + struct.pack("<BBBBQQQQ", 3, 8, 8, 0, 0, c.NOWHERE, len(out), top)
    out[:48] = head + struct.pack("<I", c.lookup3(head))
    assert c.Container(bytes(out)).array("a").tolist() == list(range(10))


def test_altered_bytes_raise_only_container_errors():
    data = c.write(
        {"names": np.array(["Juniper", "Elm"], object), "grows": np.arange(300.0), **{f"m/d{i}": np.array([i]) for i in range(12)}},
        {"": {f"a{i}": i for i in range(20)}}, {"grows": (2,)}, [("deflate", 1)], {"grows": (None,)},
    )
    rng = np.random.default_rng(1)
    altered = [data[:n] for n in range(0, len(data), 211)]
    for _ in range(400):
        d = bytearray(data)
        d[rng.integers(len(d))] = rng.integers(256)
        altered.append(bytes(d))
    for d in altered:
        try:
            box = c.Container(d)
            for path, x in box.walk():
                if isinstance(x, c.Dataset):
                    c.decoded(box.array(path), x.kind, box)
        except c.ContainerError:
            pass
