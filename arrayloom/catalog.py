"""Object trees: links, objects and attributes as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.cut import cut


def objects(links: DataFrame, root: int = 0) -> DataFrame:
    """path, address, kind, depth of all objects that links reach from the root.

    links: parent, name, child, kind (of the child), link: 'hard', or 'soft' with a path in the column target. Each
    round joins one level to the one before, which is kept, and ends at the first empty level. A hard link to a group above itself is an error.
    Soft links are resolved on the tree of hard links, relative to their group or from the root; one that leads nowhere is left out, and what lies under its target isn't listed again.
    """
    hard = links.where(F.col("link") == "hard").select("parent", "name", "child", "kind")
    level = hard.where(F.col("parent") == root).select(F.col("name").alias("path"), F.col("child").alias("address"), "kind", F.lit(1).alias("depth"), F.array("parent").alias("trail"))
    out = None
    while True:
        level = cut(level)
        if level.where(F.array_contains("trail", F.col("address"))).limit(1).count():
            raise ValueError("a link leads back to a group above it")
        out = level if out is None else out.union(level)
        up = level.where(F.col("kind") == "group").select(F.col("path").alias("above"), F.col("address").alias("at"), "depth", "trail")
        if not up.limit(1).count():
            break
        level = hard.join(up, F.col("parent") == F.col("at")).select(F.concat_ws("/", "above", "name").alias("path"), F.col("child").alias("address"), "kind", (F.col("depth") + 1).alias("depth"), F.concat("trail", F.array("at")).alias("trail"))
    tree = out.drop("trail")
    if "target" not in links.columns:
        return tree
    groups = tree.where(F.col("kind") == "group").select(F.col("path").alias("above"), F.col("address").alias("at")).union(links.sparkSession.createDataFrame([("", root)], "above string, at long"))
    soft = links.where(F.col("link") == "soft").join(groups, F.col("parent") == F.col("at"))
    under = lambda c: F.when(F.col("above") == "", c).otherwise(F.concat(F.col("above"), F.lit("/"), c))
    to = F.when(F.col("target").startswith("/"), F.ltrim(F.col("target"), F.lit("/"))).otherwise(under(F.col("target")))
    soft = soft.select(under(F.col("name")).alias("__path"), to.alias("__to"))
    found = soft.join(tree, F.col("__to") == F.col("path")).select(F.col("__path").alias("path"), "address", "kind", (F.size(F.split("__path", "/"))).alias("depth"))
    return tree.union(found)


def resolve(tree: DataFrame, path: str) -> DataFrame:
    """The object at a path; slashes at the ends don't count."""
    return tree.where(F.col("path") == path.strip("/"))


def children(tree: DataFrame, path: str = "", kind: str | None = None) -> DataFrame:
    inside = path.strip("/")
    level = inside.count("/") + 2 if inside else 1
    out = tree.where((F.col("depth") == level) & (F.col("path").startswith(inside + "/") if inside else F.lit(True)))
    return out.where(F.col("kind") == kind) if kind else out


def attribute_map(name: Column, value: Column) -> Column:
    """Aggregate: one map of an object's attributes (sorted by name, the last of equal names is an error in Spark)."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), value.alias("v")))))


def duplicates(names: DataFrame, *key: str) -> DataFrame:
    return names.groupBy(*key).count().where("count > 1")


def read_multi(tree: DataFrame, wanted: list[str]) -> DataFrame:
    """pos and the objects asked for, in the order asked (sort by pos); unknown paths give nulls."""
    asked = tree.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, __p string")
    found = tree.join(F.broadcast(asked.select(F.col("__p").alias("__w")).distinct()), F.col("path") == F.col("__w")).drop("__w")
    return asked.join(found, F.col("__p") == F.col("path"), "left").drop("__p")
