"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from arrayloom import catalog, model
from arrayloom.functions import codecs, convert, integrity, vector
from arrayloom.functions.records import Record
from arrayloom.operators import access, ann, cf, encode, selection
from arrayloom.operators.selection import Hyperslab
from arrayloom.sources import climate, container

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors are all of unit length: they are scaled by 1 + vec_id % 5, and every 97th is made zero, so that metrics differ.
SCALED = "(CASE WHEN vec_id % 97 = 0 THEN 0.0 ELSE 1.0 + vec_id % 5 END)"
SQL_VECTORS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (CASE WHEN vec_id % 97 = 0 THEN 0 ELSE 1 + vec_id % 5 END)) AS e FROM embeddings)"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("vec_id") % 97 == 0, F.lit(0.0)).otherwise(1.0 + F.col("vec_id") % 5)
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(vector.doubles(F.col("embedding")), lambda x: x * factor).alias("vec"))


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated queries of the search queries: every row whose id is divisible by 100, against all rows."""
    return vectors.where(F.col("id") % 100 == 0)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.vectors_to_long(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")


SQL_LONG = "a AS (SELECT vec_id AS i0, unnest(range(0, len(embedding)))::BIGINT AS i1, unnest(embedding) AS value FROM embeddings)"

# Selections and layouts.


@query(f"WITH {SQL_LONG} SELECT * FROM a WHERE i0 BETWEEN 10 AND 204 AND (i0 - 10) % 20 < 3 AND i1 BETWEEN 4 AND 61 AND (i1 - 4) % 8 < 2")
def hyperslab_strided(spark, sf_dir):
    return selection.select(_long(spark, sf_dir), ["i0", "i1"], Hyperslab([10, 4], [20, 8], [10, 8], [3, 2]))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 299")
def hyperslab_slice(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return selection.select(rows, ["l_orderkey"], Hyperslab.slice((100, 300)))


@query(f"WITH {SQL_LONG}, b(b) AS (SELECT unnest(range(0, 5))) SELECT i0, i1, value FROM a, b WHERE i0 BETWEEN 3 + b * 2 AND 3 + b * 2 + 3 AND i1 BETWEEN 0 AND 2")
def hyperslab_overlapping(spark, sf_dir):
    return selection.select(_long(spark, sf_dir), ["i0", "i1"], Hyperslab([3, 0], [2, 1], [5, 3], [4, 1]))


@query(f"WITH {SQL_LONG}, p(pos, x, y) AS (VALUES (0, 3, 5), (1, 10, 63), (2, 3, 5), (3, 7, 64), (4, 1000000, 0)) SELECT pos, x::BIGINT AS i0, y::BIGINT AS i1, value FROM p LEFT JOIN a ON x = i0 AND y = i1")
def selection_points(spark, sf_dir):
    return selection.points(_long(spark, sf_dir), ["i0", "i1"], [(3, 5), (10, 63), (3, 5), (7, 64), (1_000_000, 0)])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def selection_all(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE false")
def selection_none(spark, sf_dir):
    return selection.none(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@query("SELECT 2::BIGINT AS rank, 480::BIGINT AS n, 30::BIGINT AS rows_selected, 16::BIGINT AS columns_selected, count(*)::BIGINT AS n_vectors FROM embeddings")
def selection_shape(spark, sf_dir):
    slab = Hyperslab([10, 4], [20, 8], [10, 8], [3, 2])
    n, lit = _t(spark, sf_dir, "embeddings"), lambda x: F.lit(x).cast("long")
    return n.agg(F.count("*").alias("n_vectors")).select(lit(len(slab.shape)).alias("rank"), lit(slab.size).alias("n"), lit(slab.shape[0]).alias("rows_selected"), lit(slab.shape[1]).alias("columns_selected"), "n_vectors")


@query("SELECT o_orderkey // 1000 AS chunk, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 500 AND 2499 GROUP BY 1")
def chunk_prune(spark, sf_dir):
    slab = Hyperslab.slice((500, 2500))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", model.chunk_of(F.col("o_orderkey"), 1000).alias("chunk"))
    near = rows.where(selection.intersects_chunk([F.col("chunk") * 1000], [1000], slab))
    return selection.select(near, ["o_orderkey"], slab).groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c AS chunk, greatest(500, c * 1000) - c * 1000 AS lo, least(2500, c * 1000 + 1000) - c * 1000 AS hi FROM (SELECT DISTINCT o_orderkey // 1000 AS c FROM orders) WHERE c * 1000 <= 2499 AND c * 1000 + 1000 > 500")
def chunk_local_ranges(spark, sf_dir):
    slab = Hyperslab.slice((500, 2500))
    chunks = _t(spark, sf_dir, "orders").select(model.chunk_of(F.col("o_orderkey"), 1000).alias("chunk")).distinct()
    chunks = chunks.where(selection.intersects_chunk([F.col("chunk") * 1000], [1000], slab))
    lo, hi = selection.local_range(F.col("chunk") * 1000, 1000, *slab.hull()[0])
    return chunks.select("chunk", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@query("SELECT o_orderkey // 1000 AS c0, count(*)::BIGINT AS n, 1000 AS size, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def chunk_split(spark, sf_dir):
    c = model.split_chunks(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", [1000])
    return c.select("c0", "n", F.size("payload").alias("size"), F.round(F.aggregate("payload", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query(f"WITH {SQL_LONG} SELECT * FROM a")
def chunk_assemble(spark, sf_dir):
    rows = _long(spark, sf_dir)
    return model.assemble_chunks(model.split_chunks(rows, ["i0", "i1"], "value", [7, 48]), [7, 48], [_t(spark, sf_dir, "embeddings").count(), 64])


@query("SELECT (r // 4)::BIGINT AS c0, (r % 4)::BIGINT AS c1, (r // 4 * 10)::BIGINT AS offset0, (r % 4 * 25)::BIGINT AS offset1, (4096 + r * 2000)::BIGINT AS address FROM range(0, 28) t(r)")
def implicit_chunk_index(spark, sf_dir):
    return model.implicit_chunks(spark, 4096, [65, 100], [10, 25], 8)


@query("SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 10 AND 19 AND o_orderkey % 2 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def selection_write(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = spark.range(10, 20, 2).select(F.col("id").alias("o_orderkey"), F.lit(-1.0).alias("o_totalprice"))
    return selection.write(rows, ["o_orderkey"], "o_totalprice", new)


@query("SELECT vec_id AS i0, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)), 6) AS weighed, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding)::INT AS n FROM embeddings")
def layout_round_trip(spark, sf_dir):
    back = model.long_to_vectors(_long(spark, sf_dir))
    weighed = F.aggregate(F.transform("values", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return back.select("i0", F.round(weighed, 6).alias("weighed"), F.get("values", F.lit(0)).cast("double").alias("first"), F.element_at("values", -1).cast("double").alias("last"), F.size("values").alias("n"))


# Compounds, catalog and references.


@query("SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer")
def compound_project(spark, sf_dir):
    rec = _t(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal")).alias("rec"))
    return rec.select("rec.custkey", "rec.acctbal")


def _links(spark, sf_dir):
    """region and nation as a tree: groups under the root, nations as datasets in their regions."""
    r = _t(spark, sf_dir, "region").select(F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).cast("long").alias("child"), F.lit("group").alias("kind"), F.lit("hard").alias("link"))
    n = _t(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("child"), F.lit("dataset").alias("kind"), F.when(F.col("n_nationkey") % 9 == 8, F.lit("soft")).otherwise(F.lit("hard")).alias("link"))
    return r.union(n)


SQL_TREE = """o AS (SELECT r_name AS path, r_regionkey + 1 AS address, 'group' AS kind, 1 AS depth FROM region UNION ALL
  SELECT r_name || '/' || n_name, n_nationkey + 100, 'dataset', 2 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 9 <> 8)"""


@query(f"WITH {SQL_TREE} SELECT path, address::BIGINT AS address, kind, depth FROM o")
def link_resolve(spark, sf_dir):
    return catalog.objects(_links(spark, sf_dir))


@query(f"WITH {SQL_TREE}, s AS (SELECT r_name || '/' || n_name AS path, (SELECT min(r_name) FROM region) AS target FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 9 = 8) SELECT path, address::BIGINT AS address, kind, depth FROM o UNION ALL SELECT s.path, o.address, o.kind, 2 FROM s JOIN o ON s.target = o.path")
def soft_links(spark, sf_dir):
    """Soft links lead to the first region."""
    links = _links(spark, sf_dir)
    first = _t(spark, sf_dir, "region").agg(F.concat(F.lit("/"), F.min("r_name")).alias("first"))
    return catalog.objects(links.join(F.broadcast(first)).withColumn("target", F.when(F.col("link") == "soft", F.col("first"))).drop("first"))


@query(f"WITH {SQL_TREE} SELECT path FROM o WHERE path LIKE 'ASIA/%' AND kind = 'dataset'")
def catalog_group_children(spark, sf_dir):
    return catalog.children(catalog.objects(_links(spark, sf_dir)), "/ASIA/", "dataset").select("path")


@query(f"WITH {SQL_TREE} SELECT split_part(path, '/', 1) AS group_name, count(*)::BIGINT AS n FROM o WHERE kind = 'dataset' GROUP BY 1")
def catalog_children(spark, sf_dir):
    tree = catalog.objects(_links(spark, sf_dir))
    return tree.where(F.col("kind") == "dataset").groupBy(F.substring_index("path", "/", 1).alias("group_name")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_TREE}, w(pos, p) AS (SELECT row_number() OVER (ORDER BY r_regionkey DESC) - 1, r_name FROM region UNION ALL SELECT 5, 'nothing') SELECT pos::INT AS pos, path, address::BIGINT AS address FROM w LEFT JOIN o ON p = path")
def read_multi_order(spark, sf_dir):
    wanted = [r.r_name for r in _t(spark, sf_dir, "region").orderBy(F.col("r_regionkey").desc()).collect()]
    return catalog.read_multi(catalog.objects(_links(spark, sf_dir)), [*wanted, "nothing"]).select("pos", "path", "address")


@query("SELECT p_partkey, p_brand AS brand, p_size::VARCHAR AS size, 2 AS n FROM part")
def attribute_map(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.explode(F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v")))).alias("a"))
    m = rows.groupBy("p_partkey").agg(catalog.attribute_map(F.col("a.k"), F.col("a.v")).alias("m"))
    return m.select("p_partkey", F.element_at("m", "brand").alias("brand"), F.element_at("m", "size").alias("size"), F.size("m").alias("n"))


@query("SELECT p_brand, count(*)::BIGINT AS count FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return catalog.duplicates(_t(spark, sf_dir, "part"), "p_brand")


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey END = r_regionkey")
def object_ref_deref(spark, sf_dir):
    ref = F.when(F.col("n_nationkey") % 7 == 0, F.lit(-1)).otherwise(F.col("n_regionkey")).cast("long")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", convert.null_reference(ref).alias("ref"))
    r = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("address"), "r_name")
    return n.join(r, F.col("ref") == F.col("address"), "left").select("n_nationkey", "r_name")


# Conversions.


@query("SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey * 1000003 + 2147483648) % 4294967296) - 2147483648 AS wrapped FROM lineitem")
def convert_wrap_i32(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", convert.wrap_signed(F.col("l_partkey") * 1000003).alias("wrapped"))


@query("SELECT c_custkey, ((-c_custkey) % 4294967296 + 4294967296) % 4294967296 AS u32 FROM customer")
def convert_u32_zero_extend(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", convert.zero_extend(-F.col("c_custkey"), 4).alias("u32"))


@query("SELECT c_custkey, (CASE WHEN c_custkey > 0 THEN 18446744073709551616 - c_custkey ELSE 0 END)::DECIMAL(20,0) AS u64 FROM customer")
def convert_u64_zero_extend(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", convert.zero_extend(-F.col("c_custkey"), 8).alias("u64"))


@query("SELECT p_partkey, p_retailprice::FLOAT AS price, p_size::DOUBLE AS size FROM part")
def convert_f32(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", convert.as_f32(F.col("p_retailprice")).alias("price"), convert.as_f64(F.col("p_size")).alias("size"))


@query("SELECT c_custkey, c_name AS null_term, rtrim(c_name || '   ', ' ') AS space_pad, c_name AS null_pad FROM customer")
def string_padding(spark, sf_dir):
    c, zero = F.col("c_name"), F.lit("\0")
    return _t(spark, sf_dir, "customer").select("c_custkey", convert.fixed_string(F.concat(c, zero, F.lit("rest")), "null_term").alias("null_term"), convert.fixed_string(F.concat(c, F.lit("   ")), "space_pad").alias("space_pad"), convert.fixed_string(F.concat(c, zero, zero), "null_pad").alias("null_pad"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'UNKNOWN(0x' || lower(hex(o_orderstatus)) || ')' END AS status FROM orders")
def enum_decode(spark, sf_dir):
    s = F.col("o_orderstatus")
    return _t(spark, sf_dir, "orders").select("o_orderkey", convert.enum_name(s, {"F": "finished", "O": "open"}, F.hex(s)).alias("status"))


@query(f"WITH {SQL_LONG} SELECT * FROM a")
def array_flatten(spark, sf_dir):
    return _long(spark, sf_dir)


@query("SELECT * FROM (VALUES ('f64','f64','None'),('f32','f64','Widening'),('i32','i64','Widening'),('u8','u64','Widening'),('i32','f64','Widening'),('i64','f64','Narrowing'),('f64','f32','Narrowing'),('i64','i32','Narrowing'),('u64','u8','Narrowing'),('f32','i32','Lossy')) t(source, target, cost)")
def conversion_cost(spark, sf_dir):
    pairs = [("f64", "f64"), ("f32", "f64"), ("i32", "i64"), ("u8", "u64"), ("i32", "f64"), ("i64", "f64"), ("f64", "f32"), ("i64", "i32"), ("u64", "u8"), ("f32", "i32")]
    return spark.createDataFrame([(a, b, convert.conversion_cost(a, b)) for a, b in pairs], "source string, target string, cost string")


@query("SELECT p_partkey, (CASE WHEN p_size % 256 >= 128 THEN p_size % 256 - 256 ELSE p_size % 256 END)::BIGINT AS u8, (CASE WHEN p_partkey * 37 % 65536 >= 32768 THEN p_partkey * 37 % 65536 - 65536 ELSE p_partkey * 37 % 65536 END)::BIGINT AS u16, (-p_partkey)::BIGINT AS u64, p_size::BIGINT AS i32 FROM part")
def convert_i64_by_width(spark, sf_dir):
    """Integers read as signed by their width, whatever their own sign."""
    huge = (F.lit(Decimal(18446744073709551615)).cast("decimal(20,0)") - F.col("p_partkey") + 1).cast("decimal(20,0)")
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 256).alias("a"), (F.col("p_partkey") * 37 % 65536).alias("b"), huge.alias("c"), F.col("p_size").alias("d"))
    return p.select("p_partkey", convert.as_i64(F.col("a"), "u8").alias("u8"), convert.as_i64(F.col("b"), "u16").alias("u16"), convert.as_i64(F.col("c"), "u64").alias("u64"), convert.as_i64(F.col("d"), "i32").alias("i32"))


@query("SELECT c_custkey, (i - 1)::INT AS pos, substr(c_name, (3 * (i - 1) + 1)::INT, 3) AS part FROM customer, range(1, 7) t(i)")
def region_references(spark, sf_dir):
    """Eighteen bytes as six opaque references of three bytes."""
    raw = _t(spark, sf_dir, "customer").select("c_custkey", convert.region_reference(F.col("c_name").cast("binary"), 3).alias("refs"))
    return raw.select("c_custkey", F.posexplode("refs").alias("pos", "part")).withColumn("part", F.decode("part", "utf-8"))


RECORD = Record({"key": "i64", "nation": "i32", "small": ("u8", 2), "on": "bool"})
SQL_BYTES = " || ".join([*(f"printf('%02X', ((c_custkey >> {8 * i}) & 255)::INT)" for i in range(8)), *(f"printf('%02X', ((c_nationkey::BIGINT >> {8 * i}) & 255)::INT)" for i in range(4)), "printf('%02X', (c_custkey % 7)::INT)", "printf('%02X', (c_custkey % 11)::INT)", "printf('%02X', (c_custkey % 2)::INT)"])


def _records(spark, sf_dir):
    small = F.array((F.col("c_custkey") % 7).cast("short"), (F.col("c_custkey") % 11).cast("short"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("int").alias("nation"), small.alias("small"), (F.col("c_custkey") % 2 == 1).alias("on")).alias("record"))


@query(f"SELECT c_custkey, {SQL_BYTES} AS packed FROM customer")
def record_bytes(spark, sf_dir):
    return _records(spark, sf_dir).select("c_custkey", F.hex(RECORD.to_bytes(F.col("record"))).alias("packed"))


@query("SELECT c_custkey, c_custkey AS key, c_nationkey::INT AS nation, (c_custkey % 11)::SMALLINT AS second, c_custkey % 2 = 1 AS 'on' FROM customer")
def record_round_trip(spark, sf_dir):
    back = _records(spark, sf_dir).select("c_custkey", RECORD.to_bytes(F.col("record")).alias("raw")).select("c_custkey", RECORD.from_bytes(F.col("raw")).alias("r"))
    return back.select("c_custkey", "r.key", "r.nation", F.get("r.small", F.lit(1)).alias("second"), "r.on")


@query()
def half_precision(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            bits = codecs.float_to_half(b.column(1).to_numpy(zero_copy_only=False).astype("f4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.astype("i4")), pa.array(codecs.half_to_float(bits))], names=["event_id", "bits", "value"])

    return _t(spark, sf_dir, "events").select("event_id", "value").mapInArrow(run, "event_id long, bits int, value float")


# Integrity and filters.


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def provenance_sha256(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", integrity.sha256(F.col("text")).alias("sha256"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'NoHash' WHEN doc_id % 7 = 0 THEN 'Mismatch' ELSE 'Ok' END AS result FROM documents")
def provenance_verify(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 11 != 0, integrity.sha256(F.col("text")))
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", integrity.verify(stored, integrity.sha256(now)).alias("result"))


@query()
def fletcher32(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", integrity.fletcher32_column(raw, 0).alias("storage"), integrity.fletcher32_column(raw, 0xFFFF).alias("kernel"))


@query("SELECT doc_id, strlen(text) AS n, sha256(text) AS back FROM documents")
def filter_pipeline(spark, sf_dir):
    steps = [("shuffle", 4), ("deflate", 6), ("fletcher32", 0)]
    raw = F.col("text").cast("binary")
    rows = _t(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), codecs.column(raw, steps).alias("stored"))
    back = codecs.column(F.col("stored"), steps, back=True)
    return rows.select("doc_id", F.octet_length("raw").cast("long").alias("n"), F.sha2(back, 256).alias("back"))


@query("SELECT doc_id, strlen(text) AS size, sha256(text) AS back FROM documents")
def lz4_blocks(spark, sf_dir):
    steps, raw = [("lz4", 0)], F.col("text").cast("binary")
    rows = _t(spark, sf_dir, "documents").select("doc_id", codecs.column(raw, steps).alias("stored"))
    # The size stands in front of the block, lowest byte first.
    byte = lambda i: F.conv(F.hex(F.substr(F.col("stored"), F.lit(i), F.lit(1))), 16, 10).cast("long")
    size = byte(1) + 256 * byte(2) + 65536 * byte(3) + 16777216 * byte(4)
    return rows.select("doc_id", size.alias("size"), F.sha2(codecs.column(F.col("stored"), steps, back=True), 256).alias("back"))


@query("SELECT i AS id, (CASE i WHEN 0 THEN 3421780262 WHEN 1 THEN 0 WHEN 2 THEN 3904355907 ELSE 4265440379 END)::BIGINT AS crc FROM range(0, 3) t(i)")
def crc32_published(spark, sf_dir):
    """Published values of the checksum: of "123456789", of nothing and of "a"."""
    rows = spark.createDataFrame([(0, "123456789"), (1, ""), (2, "a")], "id long, s string")
    return rows.select("id", integrity.crc32(F.col("s").cast("binary")).alias("crc"))


@query()
def crc32_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", integrity.crc32(F.col("text").cast("binary")).alias("crc"))


@query("""SELECT doc_id, sha256(text) AS sha256, 'a maker' AS creator, '2020-01-02T03:04:05Z' AS timestamp, source, 4 AS n FROM documents""")
def provenance_attributes(spark, sf_dir):
    told = integrity.provenance(F.col("text"), "a maker", "2020-01-02T03:04:05Z", "documents")
    at = lambda k: F.element_at("told", f"_provenance_{k}").alias(k)
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("from"), told.alias("told"))
    return rows.select("doc_id", at("sha256"), at("creator"), at("timestamp"), F.when(at("source") == "documents", F.col("from")).alias("source"), F.size("told").alias("n"))


# Climate conventions.

SQL_PACKED = "e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN -9999 ELSE value END AS v FROM events)"


def _packed(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(-9999.0)).otherwise(F.col("value")).alias("v"))


@query(f"WITH {SQL_PACKED} SELECT event_id, CASE WHEN v = -9999 THEN 'nan'::DOUBLE ELSE round(v * 0.01 + 273.15, 6) END AS value FROM e")
def cf_unpack(spark, sf_dir):
    return _packed(spark, sf_dir).select("event_id", F.round(cf.unpack(F.col("v"), 0.01, 273.15, fill=-9999), 6).alias("value"))


@query(f"WITH {SQL_PACKED} SELECT event_id, v AS value FROM e")
def cf_raw_sentinel(spark, sf_dir):
    return _packed(spark, sf_dir).select("event_id", cf.unpack(F.col("v"), fill=-9999).alias("value"))


@query(f"WITH {SQL_PACKED} SELECT event_id, v FROM e WHERE v BETWEEN 0 AND 50")
def cf_valid_range(spark, sf_dir):
    return _packed(spark, sf_dir).where(cf.in_range(F.col("v"), 0, 50))


@query("SELECT * FROM (VALUES ('lat', 3, 0), ('lon', 4, 1), ('time', 5, NULL)) t(name, size, dimid)")
def cf_dimensions(spark, sf_dir):
    return cf.dimensions(spark.createDataFrame([("time", 5, None), ("lon", 4, 1), ("lat", 3, 0)], "name string, size int, dimid int"))


@query("SELECT event_id, event_id // 100 AS i0, event_id % 100 AS i1, ((event_id // 100) * 0.5::DOUBLE - 10)::DOUBLE AS lat FROM events")
def coordinate_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", model.chunk_of(F.col("event_id"), 100).alias("i0"), (F.col("event_id") % 100).alias("i1"))
    lat = e.select("i0").distinct().select("i0", (F.col("i0") * F.lit(0.5) - 10).cast("double").alias("value"))
    return cf.with_coordinates(e, "i0", lat, "lat")


# Encoding and layout.


@query("WITH d AS (SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS code FROM events GROUP BY 1) SELECT event_id, code FROM events JOIN d USING (event_type)")
def dict_encode(spark, sf_dir):
    return encode.encode(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "code")


@query("SELECT event_id, event_type AS value FROM events")
def dict_decode(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type")
    d = encode.dictionary(rows, "event_type", "event_id")
    return encode.decode(encode.encode(rows, "event_type", "event_id").select("event_id", "code"), d).select("event_id", "value")


def _ratio_sql(table: str, column: str) -> str:
    return f"""SELECT n::BIGINT AS n, d::BIGINT AS distinct_values, r::BIGINT AS raw_bytes, e::BIGINT AS encoded_bytes, r / e AS ratio, n >= 4 AND d / n <= 0.75 AND r / e > 1 AS beneficial
FROM (SELECT count(*) AS n, count(DISTINCT {column}) AS d, sum(strlen({column})) AS r,
  (SELECT sum(strlen(x)) FROM (SELECT DISTINCT {column} AS x FROM {table})) + 4 * count(*) AS e FROM {table})"""


@query(_ratio_sql("events", "event_type"))
def dict_ratio(spark, sf_dir):
    return encode.ratio(_t(spark, sf_dir, "events"), "event_type")


@query(_ratio_sql("part", "p_name"))
def dict_beneficial(spark, sf_dir):
    return encode.ratio(_t(spark, sf_dir, "part"), "p_name")


@query("SELECT lane::INT AS lane, n // 8 + (CASE WHEN lane < n % 8 THEN 1 ELSE 0 END) - (n // 8 + (CASE WHEN lane < n % 8 THEN 1 ELSE 0 END)) AS off, d AS items FROM range(0, 8) t(lane), (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders)")
def lane_partition(spark, sf_dir):
    """How far each of eight lanes is from the size that even lanes have (0 or 1 more for some), and that no item is lost or comes twice."""
    rows = encode.even_lanes(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8, seed=7)
    one = rows.agg(F.count("*").alias("all"), F.countDistinct("o_orderkey").alias("items"))
    lanes = rows.groupBy("lane").agg(F.count("*").alias("n")).join(F.broadcast(one))
    least = F.call_function("div", F.col("all"), F.lit(8))
    off = F.when(F.col("n").between(least, least + F.when(F.col("all") % 8 > 0, 1).otherwise(0)), F.lit(0)).otherwise(F.col("n") - least)
    return lanes.select("lane", off.cast("long").alias("off"), "items")


SQL_LANES = "l AS (SELECT lane, count(*) AS chunks, sum(s)::BIGINT AS stored_bytes, sum(w)::BIGINT AS whole_bytes FROM (SELECT (l_orderkey % 5)::INT AS lane, l_quantity::BIGINT AS s, l_linenumber * 100 AS w FROM lineitem) GROUP BY 1), e AS (SELECT i::INT AS lane, coalesce(chunks, 0) AS chunks, coalesce(stored_bytes, 0) AS stored_bytes, coalesce(whole_bytes, 0) AS whole_bytes FROM range(0, 7) t(i) LEFT JOIN l ON i = lane)"


@query(f"WITH {SQL_LANES} SELECT *, (SELECT max(chunks) FROM e) AS most, (SELECT min(chunks) FROM e) AS least FROM e")
def lane_statistics(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("lane"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_linenumber") * 100).alias("w"))
    return encode.lane_statistics(rows, "s", "w", 7)


@query("SELECT doc_id, ((doc_id * 4096 + n_chars) // 65536 % 3)::INT AS subfile, ((doc_id * 4096 + n_chars) // 65536 // 3 * 65536 + (doc_id * 4096 + n_chars) % 65536)::BIGINT AS local_offset, (ceil((doc_id * 4096 + n_chars) / 64) * 64)::BIGINT AS aligned FROM documents")
def subfile_map(spark, sf_dir):
    offset = F.col("doc_id") * 4096 + F.col("n_chars")
    file, local = encode.subfile(offset, 65536, 3)
    return _t(spark, sf_dir, "documents").select("doc_id", file.alias("subfile"), local.alias("local_offset"), encode.aligned(offset).alias("aligned"))


@query("SELECT doc_id, unnest(range(doc_id * 4096 // 65536, (doc_id * 4096 + greatest(n_chars, 1) - 1) // 65536 + 1)) AS stripe FROM documents")
def subfile_ranges(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(encode.subfile_range(F.col("doc_id") * 4096, F.col("n_chars"), 65536)).alias("stripe"))


# Access patterns.

SQL_ACCESS = """s AS (SELECT user_id, event_id, event_id // 100 AS i0, event_id % 100 AS i1, event_id // 100 - lag(event_id // 100) OVER w AS s0, event_id % 100 - lag(event_id % 100) OVER w AS s1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _accesses(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id", "event_id", model.chunk_of(F.col("event_id"), 100).alias("i0"), (F.col("event_id") % 100).alias("i1"))


@query(f"""WITH {SQL_ACCESS}, g AS (SELECT user_id, count(*) AS n, sum(coalesce((s0 <> 0)::INT, 0)) AS c0, sum(coalesce((s1 <> 0)::INT, 0)) AS c1 FROM s GROUP BY 1)
SELECT user_id, CASE WHEN n < 3 THEN NULL WHEN c1 >= c0 AND c1 > 0 AND 2 * c1 >= n AND c1 >= 2 * c0 THEN 'RowMajor' WHEN c0 > c1 AND 2 * c0 >= n AND c0 >= 2 * c1 THEN 'ColumnMajor' ELSE 'Random' END AS pattern FROM g""")
def sweep_detect(spark, sf_dir):
    return access.sweep(_accesses(spark, sf_dir), ["user_id"], "event_id", ["i0", "i1"])


@query(f"""WITH {SQL_ACCESS}, g AS (SELECT user_id, max(i0) AS last, coalesce(trunc(avg(CASE WHEN s0 <> 0 THEN s0 END)), 0)::BIGINT AS step_by FROM s GROUP BY 1)
SELECT user_id, k::INT AS k, last + k * step_by AS next FROM g, range(1, 5) t(k) WHERE last + k * step_by >= 0""")
def sweep_predict(spark, sf_dir):
    return access.predict(_accesses(spark, sf_dir), ["user_id"], "event_id", "i0", 4)


@query(f"WITH {SQL_ACCESS} SELECT count(*) FILTER (abs(s0) + abs(s1) <= 1) AS sequential, count(*) FILTER (coalesce(abs(s0) + abs(s1) > 1, true)) AS random FROM s")
def cache_sequential_stats(spark, sf_dir):
    return access.sequential(_accesses(spark, sf_dir), ["user_id"], "event_id", ["i0", "i1"])


SQL_SLIDING = f"""{SQL_ACCESS}, g AS (SELECT *, count(*) OVER v AS n, count(CASE WHEN s0 <> 0 THEN 1 END) OVER u AS c0, count(CASE WHEN s1 <> 0 THEN 1 END) OVER u AS c1, avg(CASE WHEN s0 <> 0 THEN s0 END) OVER u AS m0, avg(CASE WHEN s1 <> 0 THEN s1 END) OVER u AS m1
  FROM s WINDOW v AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN n < 3 THEN 'Random' WHEN c1 >= c0 AND c1 > 0 AND 2 * c1 >= n AND c1 >= 2 * c0 THEN 'RowMajor' WHEN c0 > c1 AND 2 * c0 >= n AND c0 >= 2 * c1 THEN 'ColumnMajor' ELSE 'Random' END AS pattern FROM g)"""


@query(f"""WITH {SQL_SLIDING} SELECT event_id, pattern, CASE pattern WHEN 'Random' THEN NULL WHEN 'RowMajor' THEN CASE WHEN i1 + trunc(m1)::BIGINT >= 0 THEN i1 + trunc(m1)::BIGINT END
  ELSE CASE WHEN i0 + trunc(m0)::BIGINT >= 0 THEN i0 + trunc(m0)::BIGINT END END AS following FROM p""")
def sliding_detector(spark, sf_dir):
    """The pattern of each user's last twelve accesses, and the first chunk to fetch ahead unless it lies below 0."""
    rows = access.sliding(_accesses(spark, sf_dir), ["user_id"], "event_id", ["i0", "i1"])
    by = F.when(F.col("pattern") == "RowMajor", F.col("i1")).otherwise(F.col("i0"))
    # Four are named ahead: the first of them, if the last isn't below 0 or the way leads up.
    first = F.when(F.size("next") == 4, F.get("next", F.lit(0))).when((F.size("next") > 0) & (F.get("next", F.lit(0)) < by), F.get("next", F.lit(0)))
    return rows.select("event_id", "pattern", first.alias("following"))


@query("""WITH a AS (SELECT user_id, event_id, event_id % 7 AS k, lag(event_id) OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS before FROM events),
d AS (SELECT a.user_id, a.event_id, a.before, (SELECT count(DISTINCT b.event_id % 7) FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.before AND b.event_id < a.event_id) AS between_ FROM a)
SELECT user_id, count(*) FILTER (before IS NOT NULL AND between_ < 3) AS hits, count(*) FILTER (before IS NULL OR between_ >= 3) AS misses FROM d GROUP BY 1""")
def cache_replay(spark, sf_dir):
    """A cache of three chunks of each user: an access hits if fewer than three other chunks were used since its chunk's last access."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("k"), F.lit(10).alias("size"))
    return access.replay(rows, ["user_id"], "event_id", ["k"], "size", 30, 3).select("user_id", "hits", "misses")


@query("""WITH f AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id % 7) AS d FROM events GROUP BY 1)
SELECT user_id, n - d AS hits, d AS misses, 0::BIGINT AS evictions, (n - d) * 100 AS bytes_hit, (n - d) / n AS hit_rate FROM f""")
def metadata_cache_replay(spark, sf_dir):
    """A cache large enough for all headers misses each of them once."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("k"), F.lit(100).alias("size"))
    return access.replay(rows, ["user_id"], "event_id", ["k"], "size", access.METADATA_BYTES, None, access.ENTRY_BYTES)


@query("""SELECT count(*) FILTER (l_linenumber > 1) AS reads, (sum(l_suppkey) FILTER (l_linenumber > 1))::BIGINT AS bytes_read, (sum(l_partkey) FILTER (l_linenumber > 1))::BIGINT AS bytes_decompressed, count(*) FILTER (l_linenumber = 1) AS hits, count(*) FILTER (l_linenumber > 1) AS misses,
(sum(l_partkey) FILTER (l_linenumber > 1)) / (sum(l_suppkey) FILTER (l_linenumber > 1)) AS compression_ratio, count(*) FILTER (l_linenumber = 1) / count(*) AS hit_rate FROM lineitem""")
def io_profile(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_linenumber") == 1).alias("hit"))
    return access.profile(rows, "l_suppkey", "l_partkey", "hit")


# Vectors.


@query(f"WITH {SQL_VECTORS} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM v")
def vector_norm(spark, sf_dir):
    return _scaled(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(vector.norm(F.col("vec")), 6).alias("norm"))


@query(f"WITH {SQL_VECTORS} SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) + 0 AS dot FROM v q, v WHERE q.vec_id % 100 = 0")
def dot_batch(spark, sf_dir):
    v = _scaled(spark, sf_dir)
    return vector.against(_asked(v), v).select("query_id", "vec_id", (F.round(vector.dot(F.col("q"), F.col("v")), 6) + F.lit(0.0)).alias("dot"))


def _knn_sql(score: str, order: str) -> str:
    return f"""WITH {SQL_VECTORS}, n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS m FROM v),
s AS (SELECT q.vec_id AS query_id, v.vec_id, {score} AS score FROM n q, n v WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) + 0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _knn(spark, sf_dir, score, descending):
    v = _scaled(spark, sf_dir)
    scored = vector.against(_asked(v), v).select("query_id", "vec_id", F.round(score(), 9).alias("score"))
    return vector.top_k(scored, 10, descending).select("query_id", "rank", "vec_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query(_knn_sql("CASE WHEN q.m * v.m = 0 THEN 0 ELSE list_inner_product(q.e, v.e) / (q.m * v.m) END", "DESC"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, lambda: vector.cosine(vector.dot(F.col("q"), F.col("v")), F.col("qn"), F.col("vn")), True)


@query(_knn_sql("CASE WHEN q.m * v.m < 1.1920928955078125e-07 THEN 1 ELSE 1 - list_inner_product(q.e, v.e) / (q.m * v.m) END", "ASC"))
def knn_cosine_distance(spark, sf_dir):
    return _knn(spark, sf_dir, lambda: vector.cosine_distance(vector.dot(F.col("q"), F.col("v")), F.col("qn"), F.col("vn")), False)


@query(_knn_sql("list_distance(q.e, v.e)", "ASC"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, lambda: vector.l2(F.col("q"), F.col("v")), False)


@query(_knn_sql("pow(list_distance(q.e, v.e), 2)", "ASC"))
def knn_l2_sq(spark, sf_dir):
    return _knn(spark, sf_dir, lambda: vector.l2_sq(F.col("q"), F.col("v")), False)


@query(f"WITH {SQL_VECTORS} SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))), 6) AS distance FROM v q, v WHERE q.vec_id % 100 = 0")
def distance_matrix(spark, sf_dir):
    v = _scaled(spark, sf_dir)
    return vector.against(_asked(v), v).select("query_id", "vec_id", F.round(vector.l2_sq(F.col("q"), F.col("v")), 6).alias("distance"))


@query()
def ann_hnsw_search(spark, sf_dir):
    v = _scaled(spark, sf_dir)
    return ann.search(_asked(v), v, 10)


@query()
def ann_hnsw_cosine(spark, sf_dir):
    v = _scaled(spark, sf_dir)
    return ann.search(_asked(v), v, 10, metric="cosine")


@query()
def ann_recall(spark, sf_dir):
    """How many of each query's ten exact nearest the graphs of several shards find, after they were saved and loaded."""
    import uuid

    from arrayloom.cut import shared_folder

    v = _scaled(spark, sf_dir)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    ann.Index.build(v, shard=500).save(path)
    found = ann.Index.load(spark, path).search(_asked(v), 10)
    exact = _knn(spark, sf_dir, lambda: vector.l2(F.col("q"), F.col("v")), False).select(F.col("query_id").alias("x"), F.col("vec_id").alias("y"))
    hits = exact.join(found, (F.col("x") == F.col("query_id")) & (F.col("y") == F.col("vec_id")), "left")
    return hits.groupBy(F.col("x").alias("query_id")).agg(F.count("*").alias("wanted"), F.count("vec_id").alias("found"))


# Container files.


def _written(spark, sf_dir):
    """Two files: vectors with even and with odd ids, each as a chunked and compressed grid."""
    e = _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("file"), (F.col("vec_id") % 2).cast("string")).alias("file"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("s"))
    rows = rows.select("file", F.lit("g/vectors").alias("dataset"), F.array(F.size("s").cast("long"), F.lit(64).cast("long")).alias("shape"), F.flatten(F.transform("s", lambda x: x["v"])).alias("payload"))
    ids = e.groupBy("file").agg(F.array_sort(F.collect_list(F.col("vec_id").cast("double"))).alias("payload"))
    ids = ids.select("file", F.lit("ids").alias("dataset"), F.array(F.size("payload").cast("long")).alias("shape"), "payload")
    return container.build(rows.union(ids), (16, 32), [("shuffle", 0), ("deflate", 6)])


SQL_FILES = "f AS (SELECT 'file' || vec_id % 2 AS file, vec_id // 2 AS i0, unnest(range(0, 64)) AS i1, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {SQL_FILES} SELECT * FROM f WHERE i0 BETWEEN 5 AND 44 AND i1 BETWEEN 20 AND 51")
def container_selection(spark, sf_dir):
    return container.read(spark, _written(spark, sf_dir), "g/vectors", 2, Hyperslab.slice((5, 45), (20, 52)))


@query("SELECT 'file' || k AS file, path, kind, dtype, layout, CASE WHEN kind = 'dataset' THEN (SELECT count(*) FROM embeddings WHERE vec_id % 2 = k) END AS rows FROM (VALUES ('', 'group', NULL, NULL), ('g', 'group', NULL, NULL), ('g/vectors', 'dataset', 'f64', 'fixed'), ('ids', 'dataset', 'f64', 'contiguous')) t(path, kind, dtype, layout), range(0, 2) b(k)")
def container_objects(spark, sf_dir):
    return container.objects(spark, _written(spark, sf_dir)).select("file", "path", "kind", "dtype", "layout", F.get("shape", F.lit(0)).alias("rows"))


@query(f"WITH {SQL_FILES} SELECT * FROM f WHERE i0 >= 3 AND i0 <= 62 AND (i0 - 3) % 7 < 2 AND i1 BETWEEN 10 AND 40")
def container_source(spark, sf_dir):
    """The files on disk, their chunks dealt to tasks that read the bytes of their own."""
    import json
    import uuid

    from arrayloom.cut import shared_folder
    from arrayloom.sources.datasource import ContainerSource

    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    container.save(_written(spark, sf_dir), folder).count()
    spark.dataSource.register(ContainerSource)
    rows = spark.read.format("container").option("path", folder).option("dataset", "g/vectors").option("slab", json.dumps([[3, 10], [7, 1], [9, 31], [2, 1]])).load()
    return rows.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("SELECT 'file' || k AS file, pos::INT AS pos, dataset, CASE dataset WHEN 'ids' THEN n ELSE 64 * n END * 8 AS size, first::DOUBLE AS first FROM (SELECT vec_id % 2 AS k, count(*) AS n, min(vec_id) AS least, arg_min(embedding[1], vec_id) AS one FROM embeddings GROUP BY 1), (VALUES (0, 'ids'), (1, 'g/vectors'), (2, 'ids')) t(pos, dataset), LATERAL (SELECT CASE dataset WHEN 'ids' THEN least ELSE one END AS first)")
def read_multi_data(spark, sf_dir):
    from arrayloom.functions.records import Record

    rows = container.read_multi(spark, _written(spark, sf_dir), ["ids", "g/vectors", "ids"])
    first = Record({"x": "f64"}).from_bytes(F.substr("payload", F.lit(1), F.lit(8)))
    return rows.select("file", "pos", "dataset", F.octet_length("payload").cast("long").alias("size"), first.alias("r")).select("file", "pos", "dataset", "size", F.col("r.x").alias("first"))


def _climate(spark, sf_dir):
    """Three files of packed events, with a time axis, conventions' attributes, and groups in groups."""
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("event_id")
        ids = part["event_id"].to_numpy("i8")
        packed = np.where(ids % 50 == 0, -9999, ids * 7 % 1000).astype("i4")
        made = {"time": ids, "temp": packed, "deep/depth": np.arange(4, dtype="f4"), "deep/inner/salt": np.arange(4, dtype="i2")}
        scale = {"CLASS": "DIMENSION_SCALE", "_Netcdf4Dimid": 0}
        told = {"": {"_NCProperties": "version=2", "title": "events"}, "time": {**scale, "units": "1"}, "temp": {"units": "K", "long_name": "a temperature", "scale_factor": 0.01, "add_offset": 273.15, "_FillValue": np.array([-9999], "i4"), "valid_min": 0, "valid_max": 900}, "deep/depth": {**scale, "axis": "Z", "valid_range": np.array([0.0, 5.0])}}
        return pd.DataFrame({"path": [f"file{ids[0] % 3}"], "content": [container.write(made, told)]})

    rows = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("k"))
    return rows.groupBy("k").applyInPandas(run, "path string, content binary")


SQL_CLIMATE = "c AS (SELECT event_id % 3 AS k, count(*) AS n FROM events GROUP BY 1)"


@query(f"""WITH {SQL_CLIMATE}, v(grp, name, type, fixed, dim, coordinate, units, long_name, axis, fill_value, scale_factor, add_offset, valid_min, valid_max) AS (VALUES
 ('', 'temp', 'NC_INT', NULL, 'time', false, 'K', 'a temperature', NULL, -9999.0::DOUBLE, 0.01::DOUBLE, 273.15::DOUBLE, 0.0::DOUBLE, 900.0::DOUBLE), ('', 'time', 'NC_INT64', NULL, 'time', true, '1', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 ('deep', 'depth', 'NC_FLOAT', 4, 'depth', true, NULL, NULL, 'Z', NULL, NULL, NULL, 0.0, 5.0), ('deep/inner', 'salt', 'NC_SHORT', 4, 'dim_4', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL))
SELECT 'file' || k AS file, grp AS 'group', name, type, coalesce(fixed, n)::BIGINT AS size, dim, coordinate, units, long_name, axis, fill_value, scale_factor, add_offset, valid_min, valid_max FROM c, v""")
def cf_variables(spark, sf_dir):
    rows = climate.variables(spark, _climate(spark, sf_dir))
    return rows.select("file", "group", "name", "type", F.get("shape", F.lit(0)).alias("size"), F.get("dimensions", F.lit(0)).alias("dim"), "coordinate", "units", "long_name", "axis", "fill_value", "scale_factor", "add_offset", "valid_min", "valid_max")


@query(f"WITH {SQL_CLIMATE} SELECT 'file' || k AS file, g AS 'group', 0 AS place, name, coalesce(s, n)::BIGINT AS size, false AS unlimited FROM c, (VALUES ('', 'time', NULL), ('deep', 'depth', 4)) t(g, name, s)")
def cf_file_dimensions(spark, sf_dir):
    return climate.dimensions(spark, _climate(spark, sf_dir))


@query(f"WITH {SQL_CLIMATE} SELECT 'file' || k AS file, p AS path, parent, depth::INT AS depth FROM c, (VALUES ('deep', '', 1), ('deep/inner', 'deep', 2)) t(p, parent, depth)")
def cf_groups(spark, sf_dir):
    return climate.groups(spark, _climate(spark, sf_dir))


@query(f"WITH {SQL_CLIMATE} SELECT 'file' || k AS file, name, v AS value FROM c, (VALUES ('_NCProperties', 'version=2'), ('title', 'events')) t(name, v)")
def cf_global_attributes(spark, sf_dir):
    return climate.attributes(spark, _climate(spark, sf_dir))


@query("SELECT 'file' || event_id % 3 AS file, event_id, CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE round((event_id * 7 % 1000) * 0.01::DOUBLE + 273.15::DOUBLE, 6) END AS value, CASE WHEN event_id % 50 = 0 THEN -9999 ELSE event_id * 7 % 1000 END::DOUBLE AS stored FROM events")
def cf_read(spark, sf_dir):
    """Values unpacked by the files' own attributes beside those stored, on the files' time axis."""
    files = _climate(spark, sf_dir)
    of = lambda name, raw, column: climate.read(spark, files, name, 1, raw).withColumnRenamed("value", column)
    rows = of("temp", False, "value").join(of("temp", True, "stored"), ["file", "i0"]).join(of("time", True, "event_id"), ["file", "i0"])
    return rows.select("file", F.col("event_id").cast("long").alias("event_id"), F.round("value", 6).alias("value"), "stored")


def _packed_files(spark, sf_dir, table, columns, make):
    """(path, content) of one file, made by a task of some columns of a table, in the order of the first."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": ["file"], "content": [make(part.sort_values(columns[0]).reset_index(drop=True))]})

    rows = _t(spark, sf_dir, table).select(F.lit(0).alias("one"), *columns)
    return rows.groupBy("one").applyInPandas(lambda part: run(part), "path string, content binary")


@query("SELECT layout, row_number() OVER (PARTITION BY layout ORDER BY s_suppkey) - 1 AS i0, s_acctbal AS value FROM supplier, (VALUES ('compact'), ('contiguous'), ('single'), ('fixed'), ('extensible'), ('implied')) t(layout) WHERE layout <> 'compact' OR s_suppkey <= 50")
def container_layouts(spark, sf_dir):
    """The same numbers in every layout that a file may have, shuffled, compressed and summed where they are chunked."""
    def make(part):
        a = part["s_acctbal"].to_numpy("f8")
        made = {"compact": a[part["s_suppkey"] <= 50], "contiguous": a, "single": a, "fixed": a, "extensible": a}
        return container.write(made, chunks={"single": container.AUTO, "fixed": (7,), "extensible": (16,)}, filters=container.chain(shuffle=True, deflate=6, fletcher32=True), most={"extensible": (None,)}, compact=["compact"], align=64)

    def implied(part):
        return container.write({"implied": part["s_acctbal"].to_numpy("f8")}, filters=container.chain(lz4=True))

    columns = ["s_suppkey", "s_acctbal"]
    files, other = _packed_files(spark, sf_dir, "supplier", columns, make), _packed_files(spark, sf_dir, "supplier", columns, implied)
    read = lambda f, name: container.read(spark, f, name, 1).select(F.lit(name).alias("layout"), "i0", "value")
    out = read(other, "implied")
    for name in ("compact", "contiguous", "single", "fixed", "extensible"):
        out = out.union(read(files, name))
    return out


@query("SELECT name, row_number() OVER (PARTITION BY name ORDER BY s_suppkey) - 1 AS i0, CASE name WHEN 'kind' THEN CASE s_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'UNKNOWN(0x02000000)' END ELSE s_name END AS value FROM supplier, (VALUES ('variable'), ('fixed'), ('kind')) t(name)")
def container_strings(spark, sf_dir):
    """Strings of variable and of fixed length, and enumerated values."""
    def make(part):
        import numpy as np

        names = part["s_name"].to_numpy(object)
        kind = (part["s_nationkey"].to_numpy() % 3).astype(container.enumeration("<i4", {"low": 0, "mid": 1}))
        return container.write({"variable": names, "fixed": np.array([n.encode() for n in names]), "kind": kind})

    files = _packed_files(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"], make)
    read = lambda name: container.read(spark, files, name, 1, kind="string").select(F.lit(name).alias("name"), "i0", "value")
    return read("variable").union(read("fixed")).union(read("kind"))


@query("SELECT 'file' AS file, row_number() OVER (ORDER BY s_suppkey) - 1 AS i0, s_suppkey AS key, s_acctbal AS balance FROM supplier")
def container_records(spark, sf_dir):
    """Two fields of structures of three."""
    def make(part):
        import numpy as np

        a = np.zeros(len(part), [("key", "<i8"), ("nation", "<i4"), ("balance", "<f8")])
        a["key"], a["nation"], a["balance"] = part["s_suppkey"], part["s_nationkey"], part["s_acctbal"]
        return container.write({"rows": a}, chunks={"rows": (13,)}, filters=container.chain(zstd=3))

    files = _packed_files(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], make)
    return container.read_records(spark, files, "rows", "key bigint, balance double")


@query("SELECT 'file' AS file, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE 'text ' || n_nationkey END AS value FROM nation")
def container_attributes(spark, sf_dir):
    """Numbers and texts of an object with so many attributes that a heap and a tree of names hold them."""
    def make(part):
        import numpy as np

        told = {n: int(k) if k % 2 == 0 else f"text {k}" for k, n in zip(part["n_nationkey"], part["n_name"], strict=True)}
        return container.write({"g/x": np.zeros(1)}, {"": told})

    return climate.attributes(spark, _packed_files(spark, sf_dir, "nation", ["n_nationkey", "n_name"], make))


@query("SELECT p_partkey, printf('%016X', p_partkey) AS swapped FROM part")
def byte_order(spark, sf_dir):
    """Eight bytes, lowest first, turned to highest first."""
    raw = Record({"key": "i64"}).to_bytes(F.struct(F.col("p_partkey").alias("key")))
    return _t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.hex(convert.byte_swap(F.col("raw"), 8)).alias("swapped"))


@query("SELECT * FROM (VALUES (0, 3735928559::BIGINT), (1, 393676113::BIGINT)) t(id, hash)")
def lookup3_published(spark, sf_dir):
    """Published values of the hash: of nothing, and of a sentence."""
    rows = spark.createDataFrame([(0, ""), (1, "Four score and seven years ago")], "id int, s string")
    return rows.select("id", integrity.lookup3_column(F.col("s").cast("binary")).alias("hash"))


SQL_STRIPES = "p AS (SELECT p_partkey, p_partkey * 21 AS o, p_name, strlen(p_name) AS n FROM part), s AS (SELECT *, unnest(range(o // 8, (o + n - 1) // 8 + 1)) AS b FROM p)"


@query(f"WITH {SQL_STRIPES} SELECT p_partkey, (b % 3)::INT AS subfile, (b // 3 * 8 + greatest(o, b * 8) % 8)::BIGINT AS local_offset, substr(p_name, (greatest(o, b * 8) - o + 1)::INT, (least(o + n, b * 8 + 8) - greatest(o, b * 8))::INT) AS piece FROM s")
def subfile_pieces(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.explode(encode.pieces(F.col("p_partkey") * 21, F.col("p_name").cast("binary"), 8, 3)).alias("x"))
    return p.select("p_partkey", "x.subfile", "x.local_offset", F.decode("x.piece", "utf-8").alias("piece"))


@query("SELECT p_partkey, p_name FROM part")
def subfile_read_back(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(encode.pieces(F.col("p_partkey") * 21, F.col("p_name").cast("binary"), 8, 3)).alias("part", "x"))
    return encode.read_back(p.select("p_partkey", "part", "x.piece"), "p_partkey").select("p_partkey", F.decode("data", "utf-8").alias("p_name"))


# Extensions over long-form arrays.


@query(f"WITH {SQL_LONG} SELECT i1, round(avg(value::DOUBLE), 6) + 0 AS mean, count(*) AS n FROM a GROUP BY i1")
def array_axis_agg(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("i1").agg((F.round(F.avg(F.col("value").cast("double")), 6) + F.lit(0.0)).alias("mean"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_dims(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) + 0 AS mean FROM events")
def rolling_window(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-11, 0)
    return _t(spark, sf_dir, "events").select("event_id", (F.round(F.avg("value").over(w), 6) + F.lit(0.0)).alias("mean"))


@query("(SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT s_suppkey FROM supplier")
def set_ops(spark, sf_dir):
    keys = lambda t, c: _t(spark, sf_dir, t).select(F.col(c).alias("key"))
    return keys("orders", "o_custkey").intersect(keys("customer", "c_custkey")).subtract(keys("supplier", "s_suppkey"))


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from arrayloom.streaming import append

    return append.windowed(_t(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL (5 * k) MINUTES AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(0, 2) t(k) GROUP BY 1, 2")
def sliding_events(spark, sf_dir):
    from arrayloom.streaming import append

    return append.sliding(_t(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("""WITH a AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS 'end', user_id, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, s""")
def session_events(spark, sf_dir):
    from arrayloom.streaming import append

    return append.sessions(_t(spark, sf_dir, "events"), "ts", "user_id", "value", "30 minutes").withColumn("total", F.round("total", 6))


__all__ = ["ORACLES", "QUERIES"]
