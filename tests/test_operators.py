"""Literal expectations for the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import catalog, model
from arrayloom.functions import codecs, convert, integrity, vector
from arrayloom.operators import access, ann, cf, encode
from arrayloom.operators.selection import Hyperslab, select
from arrayloom.streaming import append


def test_slice_of_two_axes(spark):
    df = spark.range(10_000).select(model.chunk_of(F.col("id"), 100).alias("i0"), (F.col("id") % 100).alias("i1"))
    slab = Hyperslab.slice((20, 30), (40, 60))
    assert slab.size == 200 and slab.shape == [10, 20]
    assert select(df, ["i0", "i1"], slab).count() == 200


def test_selection_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    plan = select(df, ["o_orderkey"], Hyperslab([10], [5], [20], [2]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_empty_hyperslab(spark):
    df = spark.range(10).select(F.col("id").alias("i0"))
    assert select(df, ["i0"], Hyperslab.slice((5, 5))).count() == 0


def test_strides_and_implicit_chunks(spark):
    assert model.strides([2, 3, 4]) == [12, 4, 1]
    rows = model.implicit_chunks(spark, 1000, [5], [2], 8).orderBy("c0").collect()
    assert [(r.offset0, r.address) for r in rows] == [(0, 1000), (2, 1016), (4, 1032)]


def test_edge_chunks_are_filled(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "i0 long, v double")
    rows = model.split_chunks(df, ["i0"], "v", [3]).orderBy("c0").collect()
    assert [r.payload for r in rows] == [[0.0, 1.0, 2.0], [3.0, 4.0, 0.0]] and [r.n for r in rows] == [3, 2]


def test_cf_unpack(spark):
    df = spark.createDataFrame([(8.0,), (-12.0,), (-77.0,), (40.0,), (6.0,)], "v double")
    got = [r[0] for r in df.select(cf.unpack(F.col("v"), 0.25, 3.0, -77)).collect()]
    assert math.isnan(got[2])
    assert np.allclose([got[i] for i in (0, 1, 3, 4)], [5.0, 0.0, 13.0, 4.5])
    raw = [r[0] for r in df.select(cf.unpack(F.col("v"), fill=-77)).collect()]
    assert raw[2] == -77
    assert math.isnan(df.select(cf.unpack(F.col("v"), fill=-77, mask_always=True)).collect()[2][0])


def test_dimension_matching():
    known = [("lat", 3), ("lon", 4), ("lat2", 3)]
    assert cf.match_dimensions([3, 4, 3, 9], known) == ["lat", "lon", "lat2", "dim_9"]
    assert cf.is_coordinate("lat", ["lat"]) and not cf.is_coordinate("t", ["lat", "lon"])


def test_dictionary(spark):
    words = ["oak", "fir", "oak", "yew", "fir", "oak"]
    df = spark.createDataFrame(list(enumerate(words)), "p int, w string")
    assert [r.code for r in encode.encode(df, "w", "p").orderBy("p").collect()] == [0, 1, 0, 2, 1, 0]
    assert encode.ratio(df.limit(0), "w").collect()[0].ratio == 1.0


def test_even_lanes(spark):
    df = spark.range(103)
    n = [r["count"] for r in encode.even_lanes(df, "id", 4, 3).groupBy("lane").count().collect()]
    assert sum(n) == 103 and max(n) - min(n) <= 1


@pytest.mark.parametrize(("points", "pattern"), [([(0, 0), (0, 10), (0, 20), (0, 30)], "RowMajor"), ([(0, 0), (10, 0), (20, 0), (30, 0)], "ColumnMajor"), ([(0, 0), (0, 1)], None)])
def test_sweeps(spark, points, pattern):
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(points)], "g int, t int, i0 long, i1 long")
    assert access.sweep(df, ["g"], "t", ["i0", "i1"]).collect()[0].pattern == pattern


def test_prediction_stops_below_zero(spark):
    df = spark.createDataFrame([(1, i, 6 - 2 * i) for i in range(3)], "g int, t int, i0 long")
    assert [r.next for r in access.predict(df, ["g"], "t", "i0", 3).orderBy("k").collect()] == [0]


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert df.select(vector.l2(a, b), vector.l2_sq(a, b), vector.norm(b)).collect()[0][:] == (5.0, 25.0, 5.0)
    assert df.select(vector.cosine(vector.dot(a, b), vector.norm(a), vector.norm(b))).collect()[0][0] == 0.0
    assert df.select(vector.cosine_distance(vector.dot(a, b), vector.norm(a), vector.norm(b))).collect()[0][0] == 1.0


def test_graph_recall():
    rng = np.random.default_rng(3)
    v = rng.random((400, 8)) - 0.5
    g, hits = ann.Graph(v), 0
    for q in v[:20]:
        want = set(np.argsort(((v - q) ** 2).sum(axis=1))[:10].tolist())
        hits += len(want & {n for _, n in g.search(q, 10)})
    assert hits >= 0.9 * 200
    assert len(list(g.edges())) > 400


def test_search_over_shards(spark):
    rng = np.random.default_rng(4)
    v = rng.random((300, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    rows = ann.search(df.where("id < 3"), df, 5, shard=100).collect()
    assert len(rows) == 15 and all(r.distance < 1e-9 and r.vec_id == r.query_id for r in rows if r.rank == 1)


def test_filters():
    data = bytes(range(8))
    assert codecs.shuffle(bytes([0x11, 0x22, 0x33, 0x44, 0x15, 0x26, 0x37, 0x48]), 4) == bytes([0x11, 0x15, 0x22, 0x26, 0x33, 0x37, 0x44, 0x48])
    for steps in ([("shuffle", 4), ("deflate", 6)], [("zstd", 3), ("fletcher32", 0)], []):
        assert codecs.undo(codecs.apply(data, steps), steps) == data
    stored = bytearray(codecs.apply(data, [("fletcher32", 0)]))
    stored[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        codecs.undo(bytes(stored), [("fletcher32", 0)])
    with pytest.raises(ValueError, match="unknown"):
        codecs.apply(data, [("szip", 0)])
    assert codecs.undo(b"raw", [("deflate", 6)], mask=1) == b"raw"


def test_checksums():
    def slow(data, seed):
        a = b = seed
        for i in range(0, len(data), 2):
            a = (a + (data[i] << 8) + (data[i + 1] if i + 1 < len(data) else 0)) % 65535
            b = (b + a) % 65535
        return b << 16 | a

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 200_001):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert integrity.fletcher32(data) == slow(data, 0) and integrity.fletcher32(data, 0xFFFF) == slow(data, 0xFFFF)
    assert integrity.lookup3(b"") == 0xDEADBEEF
    assert integrity.lookup3(b"Four score and seven years ago") == 0x17770551


def test_half_precision():
    assert codecs.half_to_float(np.array([0x0001, 0x3C00, 0x7C00], "<u2")).tolist() == [2.0**-24, 1.0, math.inf]
    assert codecs.float_to_half(np.array([1.0, 65520.0, -2.0, 1.0009765, 1e-40], "f4")).tolist() == [0x3C00, 0x7BFF, 0xC000, 0x3C00, 0]


def test_wrapping(spark):
    df = spark.createDataFrame([(2**31,), (-1,), (5,)], "x long")
    assert [r[0] for r in df.select(convert.wrap_signed(F.col("x"))).collect()] == [-(2**31), -1, 5]
    assert [int(r[0]) for r in df.select(convert.zero_extend(F.col("x"), 8)).collect()] == [2**31, 2**64 - 1, 5]


def test_catalog(spark):
    links = spark.createDataFrame([(0, "a", 1, "group", "hard"), (1, "b", 2, "group", "hard"), (2, "deep", 3, "dataset", "hard"), (0, "s", 4, "dataset", "soft")], "parent long, name string, child long, kind string, link string")
    tree = catalog.objects(links)
    assert {r.path for r in tree.collect()} == {"a", "a/b", "a/b/deep"}
    assert catalog.resolve(tree, "/a/b/deep/").collect()[0].address == 3
    assert [r.path for r in catalog.children(tree, "a").collect()] == ["a/b"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    for more in (False, True):
        if more:
            spark.range(5, 8).write.mode("append").parquet(src)
        append.append(append.tail(spark, src, spark.range(1).schema), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
