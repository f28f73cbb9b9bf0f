"""Files: links, virtual datasets, ranged reads, the data source, objects of Python, climate conventions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import catalog, cut
from arrayloom.functions import codecs, convert, vector
from arrayloom.functions.records import Record
from arrayloom.operators import access, ann, encode
from arrayloom.sources import climate, container
from arrayloom.sources.datasource import ContainerSource, listed, opened
from arrayloom.sources.facade import File, Writer, attribute
from arrayloom.streaming import append


def test_links_lead_on():
    raw = container.write({"a/x": np.arange(3.0)}, links={"b": "/a/x", "a/up": "../b", "gone": "nowhere", "round": "round", "far": ("other.h5", "/y")})
    box = container.Container(raw)
    assert box.array("b").tolist() == box.array("a/up").tolist() == [0.0, 1.0, 2.0]
    root = box.object(box.root)
    assert root.external == {"far": ("other.h5", "/y")} and set(root.soft) == {"b", "gone", "round"}
    for path in ("gone", "round", "far", "a/none"):
        with pytest.raises(container.ContainerError):
            box.find(path)
    assert box.object(box.root) is root  # each header is parsed once


def test_virtual_mappings():
    part = lambda t, f, d, s: len(t).to_bytes(4, "little") + t + f + b"\0" + d + b"\0" + len(s).to_bytes(4, "little") + s
    raw = bytes(4) + part(b"TT", b"one.h5", b"/d", b"SSS") + part(b"", b".", b"/e", b"")
    got = container.virtual_mappings(raw)
    assert [tuple(m) for m in got] == [("one.h5", "/d", b"SSS", b"TT"), (".", "/e", b"", b"")]
    assert container.virtual_mappings(b"") == [] and len(container.virtual_mappings(raw[:-2])) == 1
    with pytest.raises(container.ContainerError):
        container.virtual_mappings(bytes(4) + bytes(4) + b"never ends")


def test_storage_of_datasets():
    made = {"small": np.arange(5, dtype="i4"), "plain": np.arange(7.0), "grid": np.arange(64.0).reshape(8, 8)}
    raw = container.write(made, chunks={"grid": (4, 4)}, filters=[("lz4", 0)], compact=["small"], align=512, fill_times={"plain": "ifset", "grid": "never"})
    box = container.Container(raw)
    assert box.find("small").layout[0] == "compact" and box.find("plain").layout[1] % 512 == 0
    assert box.find("plain").fill_time == "ifset" and box.find("grid").fill_time == "never" and box.find("small").fill_time == ""
    assert all((box.array(k) == v).all() for k, v in made.items())
    with pytest.raises(container.ContainerError):
        container.write({"x": np.zeros(20_000)}, compact=["x"])
    implied = container.Container(container.write(made, filters=container.chain(shuffle=True, lz4=True, deflate=3)))
    assert {implied.find(k).layout[0] for k in made} == {"single"} and implied.find("plain").filters == [("shuffle", 8), ("lz4", 0)]
    pairs = container.Container(container.write({"p": np.arange(12, dtype="i4").reshape(3, 2, 2)}, arrays_of={"p": 2}))
    d = pairs.find("p")
    assert d.shape == (3,) and container.decoded(pairs.array("p"), d.kind)[1] == [[4, 5], [6, 7]]
    assert list(container.merged([{"b": 1}, {"a": 2}])) == ["a", "b"]
    with pytest.raises(container.ContainerError, match="twice"):
        container.merged([{"a": 1}, {"a": 2}])


def test_only_what_is_asked_for_is_read(tmp_path):
    grid = np.random.default_rng(1).random((600, 500))
    (tmp_path / "x.h5").write_bytes(container.write({"grid": grid, **{f"d{i}": np.zeros(9000) for i in range(30)}}, chunks={"grid": (100, 100)}))
    box = opened(str(tmp_path / "x.h5"))
    d = box.find("grid")
    part = next(x for o, x in box.blocks(d, container.Hyperslab.slice((150, 160), (210, 220))) if o == (100, 200))
    assert (part == grid[100:200, 200:300]).all() and box.data.fetched < len(box.data) / 10


def test_data_source(spark, tmp_path, monkeypatch):
    spark.dataSource.register(ContainerSource)
    grids = [np.arange(60.0).reshape(6, 10) + 100 * k for k in range(2)]
    for k, g in enumerate(grids):
        (tmp_path / f"f{k}.h5").write_bytes(container.write({"chunked": g, "plain": g, "names": np.array([b"a", b"bc"])}, chunks={"chunked": (2, 5)}, filters=[("deflate", 3)]))
    (tmp_path / "_part").write_bytes(b"unfinished")
    assert len(listed(str(tmp_path))) == 2
    load = lambda **o: spark.read.format("container").options(path=str(tmp_path), **o).load()
    for name in ("chunked", "plain"):
        rows = load(dataset=name).collect()
        assert sorted((r.file[-5:], r.i0, r.i1, r.value) for r in rows) == sorted((f"f{k}.h5", i, j, grids[k][i, j]) for k in range(2) for i in range(6) for j in range(10))
        some = load(dataset=name, slab=json.dumps([[1, 0], [2, 3], [2, 4], [1, 2]])).collect()
        assert sorted((r.i0, r.i1) for r in some if r.file.endswith("f0.h5")) == [(i, j) for i in (1, 3) for j in (0, 1, 3, 4, 6, 7, 9)]
    assert sorted(r.value for r in load(dataset="names", kind="string").collect()) == ["a", "a", "bc", "bc"]
    assert load(dataset="chunked").rdd.getNumPartitions() >= 2
    with pytest.raises(Exception, match="no object"):
        load(dataset="missing").collect()


def test_objects_of_python(tmp_path):
    w = Writer().create_dataset("g/x", np.arange(6, dtype="i4").reshape(2, 3)).create_dataset("s", np.array(["one", "two"], object)).create_dataset("odd", np.zeros(2, "i1"))
    w.set_attribute("g", "unit", "m").set_attribute("g/x", "n", 3).link("l", "/g/x")
    w.save(str(tmp_path / "y.h5"))
    f = File(str(tmp_path / "y.h5"))
    assert f.keys() == ["g", "l", "odd", "s"] and "g/x" in f and "g/y" not in f and len(f) == 4 and f.groups() == ["g"]
    assert f["g"]["x"][1].tolist() == [3, 4, 5] and f["l"][0, 1] == 1 and len(f["g/x"]) == 2 and list(f["s"][:]) == ["one", "two"]
    assert f["g"].attrs == {"unit": "m"} and attribute(f["g/x"].attrs, "n", int) == 3 and attribute(f["g"].attrs, "unit", list) == ["m"]
    with pytest.raises(TypeError):
        f["odd"][:]
    with pytest.raises(KeyError):
        f["g"]["none"]
    with pytest.raises(TypeError):
        attribute(f["g"].attrs, "unit", float)
    with pytest.raises(container.ContainerError):
        w.create_dataset("s", [1])


def test_climate_attributes():
    told = climate.attributes_of({"units": 3, "_FillValue": [1, 2], "valid_min": 0, "scale_factor": [2.0], "axis": "T"})
    assert told["units"] is None and told["fill_value"] == 1.0 and told["valid_min"] is None and told["scale_factor"] is None and told["axis"] == "T"
    none = {"scale_factor": None, "add_offset": None, "fill_value": 1.0, "missing_value": None}
    assert climate.unpacked(np.array([1, 2]), none).tolist() == [1.0, 2.0]
    got = climate.unpacked(np.array([1.0, np.nan, 3.0]), {"scale_factor": 2.0, "add_offset": None, "fill_value": 1.0, "missing_value": float("nan")})
    assert np.isnan(got[:2]).all() and got[2] == 6.0


def test_records(spark):
    r = Record({"a": "i16", "b": "f64", "c": ("u8", 3), "d": "bool", "e": "u64"})
    assert r.size == 2 + 8 + 3 + 1 + 8
    from decimal import Decimal

    rows = [(1, (-2, 1.5, [1, 2, 255], True, Decimal(2**64 - 1))), (2, None), (3, (None, 1.0, [0, 0, 0], False, Decimal(0)))]
    df = spark.createDataFrame(rows, f"id long, s {r.schema.simpleString()}").select("id", r.to_bytes(F.col("s")).alias("raw"))
    got = {x.id: (x.raw, x.back) for x in df.select("id", "raw", r.from_bytes(F.col("raw")).alias("back")).collect()}
    assert bytes(got[1][0]) == np.array([(-2, 1.5, [1, 2, 255], 1, 2**64 - 1)], r.dtype).tobytes()
    assert tuple(got[1][1]) == (-2, 1.5, [1, 2, 255], True, Decimal(2**64 - 1)) and got[2] == (None, None) and got[3] == (None, None)
    with pytest.raises(ValueError, match="can't be"):
        Record({"a": "text"})
    import dataclasses

    @dataclasses.dataclass
    class Point:
        x: "f64"  # noqa: F821
        y: "i32[2]"  # noqa: F722

    assert Record.of(Point).fields == {"x": "f64", "y": ("i32", 2)}


def test_small_conversions(spark):
    with pytest.raises(ValueError, match="f64"):
        convert.as_i64(F.lit(1.0), "f64")
    df = spark.createDataFrame([(1, b"abcdef"), (2, b""), (3, None)], "id long, raw binary")
    got = {r.id: r.refs for r in df.select("id", convert.region_reference(F.col("raw"), 3).alias("refs")).collect()}
    assert [bytes(x) for x in got[1]] == [b"abc", b"def"] and got[2] == [] and got[3] is None
    with pytest.raises(Exception, match="multiple"):
        df.select(convert.region_reference(F.col("raw"), 4)).collect()
    for data in (b"", b"a", b"abc" * 1000):
        assert codecs.undo(codecs.apply(data, [("lz4", 0)]), [("lz4", 0)]) == data
    with pytest.raises(ValueError, match="size"):
        codecs.undo(b"ab", [("lz4", 0)])


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit("v").alias("y"))
    rows = cut.numbered(df, "x", parts=7).collect()
    assert all(r.n == r.x for r in rows)
    lanes = encode.even_lanes(df, "x", 7).groupBy("lane").count().collect()
    assert sorted(r["count"] for r in lanes) == [142] * 1 + [143] * 6
    stats = encode.lane_statistics(spark.createDataFrame([(0, 5, 9), (0, 1, 2), (2, 4, 8)], "lane int, s long, w long"), "s", "w", 4).orderBy("lane").collect()
    assert [(r.chunks, r.stored_bytes, r.whole_bytes, r.most, r.least) for r in stats] == [(2, 6, 11, 2, 0), (0, 0, 0, 2, 0), (1, 4, 8, 2, 0), (0, 0, 0, 2, 0)]


def test_caches_are_replayed(spark):
    asked = [("s", i, k, n) for i, (k, n) in enumerate([("a", 40), ("b", 40), ("a", 40), ("c", 40), ("b", 40), ("big", 500), ("a", 40)])]
    df = spark.createDataFrame(asked, "s string, t long, k string, n long")
    r = access.replay(df, ["s"], "t", ["k"], "n", 100).collect()[0]
    # b goes for c, a for b, c for a; what is larger than the cache is never in it.
    assert (r.hits, r.misses, r.evictions, r.bytes_hit) == (1, 6, 3, 40) and abs(r.hit_rate - 1 / 7) < 1e-12
    assert access.replay(df, ["s"], "t", ["k"], "n", 1000, 1).collect()[0].evictions == 6
    assert access.replay(df.limit(0), ["s"], "t", ["k"], "n").count() == 0
    p = access.profile(spark.createDataFrame([], "a long, b long, h boolean"), "a", "b", "h").collect()[0]
    assert (p.reads, p.compression_ratio, p.hit_rate) == (0, 0.0, 0.0)


def test_sliding_detector(spark):
    walk = [("s", t, t // 5, t % 5) for t in range(20)]
    df = spark.createDataFrame(walk, "s string, t long, i0 long, i1 long")
    rows = access.sliding(df, ["s"], "t", ["i0", "i1"]).orderBy("t").collect()
    assert [r.pattern for r in rows[:3]] == ["Random", "Random", "RowMajor"] and rows[2].next == [3, 4, 5, 6]
    down = spark.createDataFrame([("s", t, 9 - t, 0) for t in range(9)], "s string, t long, i0 long, i1 long")
    last = access.sliding(down, ["s"], "t", ["i0", "i1"]).orderBy(F.desc("t")).first()
    assert last.pattern == "ColumnMajor" and last.next == [0]


def test_trees_with_cycles_and_soft_links(spark):
    rows = [(0, "a", 1, "group", "hard", None), (1, "b", 2, "group", "hard", None), (1, "s", None, None, "soft", "b"), (0, "t", None, None, "soft", "/a/b"), (0, "u", None, None, "soft", "gone")]
    links = spark.createDataFrame(rows, "parent long, name string, child long, kind string, link string, target string")
    got = {(r.path, r.address, r.depth) for r in catalog.objects(links).collect()}
    assert got == {("a", 1, 1), ("a/b", 2, 2), ("a/s", 2, 2), ("t", 2, 1)}
    back = links.union(spark.createDataFrame([(2, "back", 1, "group", "hard", None)], links.schema))
    with pytest.raises(ValueError, match="back"):
        catalog.objects(back)
    deep = spark.createDataFrame([(i, "x", i + 1, "group", "hard") for i in range(40)], "parent long, name string, child long, kind string, link string")
    assert catalog.objects(deep).agg(F.max("depth")).collect()[0][0] == 40


def test_recall_over_shards(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    asked = df.where("id % 100 = 0")
    for metric in ("l2", "cosine"):
        index = ann.Index.build(df, metric=metric, shard=400)
        index.save(str(tmp_path / metric))
        again = ann.Index.load(spark, str(tmp_path / metric))
        assert again.nodes.count() == 1200 and again.metric == metric
        rows = again.search(asked, 10).collect()
        hits = 0
        for q in range(0, 1200, 100):
            far = np.sqrt(((v - v[q]) ** 2).sum(axis=1)) if metric == "l2" else 1 - v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
            want = set(np.argsort(far, kind="stable")[:10].tolist())
            hits += len(want & {r.vec_id for r in rows if r.query_id == q})
        assert hits >= 0.9 * 120
        assert again.edges().count() > 1200
    with pytest.raises(ValueError, match="metric"):
        ann.Index.build(df, metric="other")


def test_queries_are_searched_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, vec array<double>")
    one, many = (sorted(map(tuple, vector.against(df.where("id < 20"), df, block).select("query_id", "vec_id").collect())) for block in (100, 6))
    assert one == many and len(one) == 600
    with pytest.raises(ValueError, match="components"):
        vector.against(spark.createDataFrame([(0, [1.0])], "id long, vec array<double>"), df)
    with pytest.raises(ValueError, match="components"):
        vector.dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vec array<double>"))


def test_new_files_are_seen(spark, tmp_path):
    path = str(tmp_path / "grows")
    df = spark.range(5)
    df.coalesce(1).write.parquet(path)
    rows, files = append.refreshed(spark, path, df.schema)
    assert rows.count() == 5
    files = spark.createDataFrame(files.collect(), files.schema)
    df.coalesce(1).write.mode("append").parquet(path)
    rows, now = append.refreshed(spark, path, df.schema, files)
    assert rows.count() == 5 and now.count() == 2
    assert append.refreshed(spark, path, df.schema, now)[0].count() == 0
