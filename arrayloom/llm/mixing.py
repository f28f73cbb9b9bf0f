"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words. Its documents share it by their preference: a document is expected to be taken
``min(most, level * preference)`` times, with the level that makes the expected words the target. The whole copies in that
number are certain; the fraction that is left is the document's own inclusion probability p. Documents are ranked by their
random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first of the rank order
are taken until the words that the certain copies leave are spent. The cut in that order is found by sums
over ever finer bins of the quotient, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import checkpointed, packed, replaced, unpacked

#: Random numbers are so many hexadecimal digits; each of two rounds parts the quotients in so many bins.
DIGITS, BINS = 13, 4096
#: Rows (source and preference) that are broadcast at most; a longer table meets the documents by a shuffle, in so many parts a key.
FEW, PARTS = 200_000, 16


def by_length(size: Column) -> Column:
    """The preference of the registered query: 4 and the number of binary digits of the size, so that longer documents are taken more often, but never much."""
    return F.length(F.bin(size)) + 4


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(id_col: Column, text: Column) -> Column:
    """The row's random number, from its id and its text alone, so that reruns agree."""
    own = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("null"))))
    return F.substring(F.md5(own), 1, DIGITS)


def unit(hexed: Column) -> Column:
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """__source, __total, __target from one row a source (__source, __total).

    With L the level at which sum(min(most * total, L * weight)) is the budget, a target is that
    minimum. In the order of most * total / weight the capped sources come first; the level found
    if exactly the earlier ones were capped rises up to the true level and falls behind it.
    This table has one row a source; its windows run in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last()))
    listed = F.array(*(F.lit(float(w)) for w in weights))
    t = sizes.withColumn("__weight", F.element_at(listed, F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy((F.lit(most) * F.col("__total") / F.col("__weight")).asc(), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__budget", F.lit(share) * F.sum("__total").over(every)).withColumn("__all", F.sum("__weight").over(every))
    level = (F.col("__budget") - F.coalesce(F.sum(F.lit(most) * F.col("__total")).over(before), F.lit(0.0))) / (F.col("__all") - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    t = t.withColumn("__level", level).withColumn("__level", F.max("__level").over(every))
    return t.select("__source", "__total", F.least(F.lit(most) * F.col("__total"), F.col("__level") * F.col("__weight")).alias("__target"))


def _met(rows: DataFrame, few: DataFrame, on: list[Column], salt: Column) -> DataFrame:
    """rows with their row of few, by on; a large source never meets in one task. few: checkpointed."""
    if few.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(few), on)
    few = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("__own", F.pmod(F.xxhash64(salt), F.lit(PARTS)).cast("int")).join(few, [*on, F.col("__own") == F.col("__part")]).drop("__own", "__part")


def shares(narrow: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """__s, __g (source and preference), __total, __target, __whole (certain copies), __p (of one copy more) and __need (words of the source that the certain copies leave).

    narrow: __source, __size, __g. A source's documents of one preference are one row, so the windows here are
    short. Those with the largest preferences reach ``most`` first; the level found if exactly those before were at it rises up to
    the true level and falls behind it.
    """
    goal = targets(narrow.groupBy("__source").agg(F.sum("__size").alias("__total")), weights, share, most)
    classes = narrow.where(F.col("__size") > 0).groupBy(F.col("__source").alias("__s"), F.col("__g")).agg(F.sum("__size").alias("__words"))
    rows = goal.join(classes, F.col("__source").eqNullSafe(F.col("__s")), "left").select(F.col("__source").alias("__s"), "__g", "__total", "__target", F.coalesce("__words", F.lit(0)).alias("__words"))
    own = Window.partitionBy("__s")
    before = own.orderBy(F.col("__g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("__words") * F.col("__g")
    level = (F.col("__target") - F.lit(most) * F.coalesce(F.sum("__words").over(before), F.lit(0))) / (F.sum(moved).over(own) - F.coalesce(F.sum(moved).over(before), F.lit(0)))
    rows = rows.withColumn("__level", F.when(F.col("__total") > 0, level)).withColumn("__level", F.max("__level").over(own))
    times = F.when(F.col("__total") == 0, F.lit(0.0)).when(F.col("__target") >= F.lit(most) * F.col("__total"), F.lit(most)).otherwise(F.least(F.lit(most), F.col("__level") * F.col("__g")))
    rows = rows.withColumn("__times", times).withColumn("__whole", F.floor("__times").cast("long")).withColumn("__p", F.col("__times") - F.floor("__times"))
    need = F.col("__target") - F.sum(F.col("__whole") * F.col("__words")).over(own)
    return rows.select("__s", "__g", "__total", "__target", "__whole", "__p", need.alias("__need"))


def _quotient(draw: Column, p: Column) -> Column:
    return (unit(draw) / (1 - unit(draw))) / (p / (1 - p))


def _bin(q: Column, level: int) -> Column:
    """A number of the quotient's bin, in the quotients' order: parts of q / (1 + q), which lies between 0 and 1."""
    return F.floor(q / (1 + q) * F.lit(float(BINS**level))).cast("long")


def _boundary(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the bin that the cut falls in, and (__cs, __cb, __base): that bin and the words before it, by source.

    rows: __source, __draw, __q, __size, __need, __base (words of the bins before these rows).
    """
    bins = rows.groupBy("__source", _bin(F.col("__q"), level).alias("__bin")).agg(F.sum("__size").alias("__sum"), F.first("__need").alias("__need"), F.first("__base").alias("__base"))
    bins = bins.withColumn("__upto", F.col("__base") + F.sum("__sum").over(Window.partitionBy("__source").orderBy("__bin")))
    cut = bins.where((F.col("__upto") > F.col("__need")) & (F.col("__upto") - F.col("__sum") <= F.col("__need")))
    cut = checkpointed(cut.select(F.col("__source").alias("__cs"), F.col("__bin").alias("__cb"), (F.col("__upto") - F.col("__sum")).alias("__new")))
    same = [F.col("__source").eqNullSafe(F.col("__cs")), _bin(F.col("__q"), level) == F.col("__cb")]
    return _met(rows, cut, same, F.col("__draw")).select("__source", "__draw", "__q", "__size", "__need", F.col("__new").alias("__base")), cut.select("__cs", "__cb")


def cuts(narrow: DataFrame, share: DataFrame) -> DataFrame:
    """Of each source: __cs, __bin (all documents of earlier bins are taken; null: all documents) and __last (the last (quotient, draw) taken of that bin, or null)."""
    on = [F.col("__source").eqNullSafe(F.col("__s")), F.col("__pref") == F.col("__g")]
    ranked = _met(narrow.withColumnRenamed("__g", "__pref"), checkpointed(share.where(F.col("__p") > 0).select("__s", "__g", "__p", "__need")), on, F.col("__draw"))
    ranked = ranked.select("__source", "__draw", _quotient(F.col("__draw"), F.col("__p")).alias("__q"), "__size", "__need", F.lit(0.0).alias("__base"))
    first, _ = _boundary(ranked, 1)
    second, cut = _boundary(first, 2)
    # What is left of a source is a 16 777 216th of its rows.
    left = second.groupBy("__source", "__q", "__draw").agg(F.sum("__size").alias("__sum"), F.first("__need").alias("__need"), F.first("__base").alias("__base"))
    left = left.withColumn("__upto", F.col("__base") + F.sum("__sum").over(Window.partitionBy("__source").orderBy("__q", "__draw")))
    last = left.where(F.col("__upto") - F.col("__sum") / 2 <= F.col("__need")).groupBy(F.col("__source").alias("__ls")).agg(F.max(F.struct("__q", "__draw")).alias("__last"))
    return cut.join(last, F.col("__cs").eqNullSafe(F.col("__ls")), "left").select("__cs", F.col("__cb").alias("__bin"), "__last")


def _decided(rows: DataFrame, narrow: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """rows (with __source, __size, __draw, __pref) and __total, __target, __copies."""
    parts = checkpointed(shares(narrow, weights, share, most))
    edge = cuts(narrow, parts)
    whole = parts.join(edge, F.col("__s").eqNullSafe(F.col("__cs")), "left")
    # A document of no word shares no class: it meets its source's row without one.
    whole = checkpointed(whole.select("__s", "__g", "__total", "__target", "__whole", "__p", "__bin", "__last").union(
        parts.groupBy("__s", "__total", "__target").count().select("__s", F.lit(-1).cast("int"), "__total", "__target", F.lit(0).cast("long"), F.lit(0.0), F.lit(None).cast("long"), F.lit(None).cast("struct<__q:double,__draw:string>"))).where(F.col("__g").isNotNull()))
    rows = rows.withColumn("__class", F.when(F.col("__size") > 0, F.col("__pref")).otherwise(F.lit(-1)))
    rows = _met(rows, whole, [F.col("__source").eqNullSafe(F.col("__s")), F.col("__class") == F.col("__g")], F.col("__draw"))
    q = _quotient(F.col("__draw"), F.col("__p"))
    inside = F.col("__bin").isNull() | (_bin(q, 2) < F.col("__bin")) | ((_bin(q, 2) == F.col("__bin")) & F.coalesce(F.struct(q.alias("__q"), F.col("__draw").alias("__draw")) <= F.col("__last"), F.lit(False)))
    return rows.withColumn("__copies", F.col("__whole") + F.when(F.col("__p") > 0, inside.cast("long")).otherwise(F.lit(0)))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, preference: Callable[[Column], Column], **more: Column) -> DataFrame:
    """The working columns: __source, __draw, __size, __pref, and others."""
    named = {"__source": F.col(source_col), "__draw": _draw(F.col(id_col), F.col(text_col)), "__size": words(F.col(text_col)), **more}
    return docs.select(*(c.alias(k) for k, c in named.items())).withColumn("__pref", preference(F.col("__size")).cast("int"))


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, preference: Callable[[Column], Column]) -> DataFrame:
    _checked(most)
    narrow = checkpointed(_narrow(docs, id_col, text_col, source_col, preference))
    rows = _narrow(docs, id_col, text_col, source_col, preference, __row=F.struct("*"))
    return _decided(rows, narrow.withColumnRenamed("__pref", "__g"), weights, share, most)


def _checked(most: float) -> None:
    if most < 1 or most != int(most):
        raise ValueError("most is a whole number of copies")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, preference: Callable[[Column], Column] = by_length) -> DataFrame:
    """The id column and size, source_size, target, copies, taken of each document, as :func:`mix` gives them; texts are read once."""
    _checked(most)
    narrow = checkpointed(_narrow(docs, id_col, text_col, source_col, preference, __id=F.col(id_col)))
    out = _decided(narrow, narrow.withColumnRenamed("__pref", "__g"), weights, share, most)
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, preference: Callable[[Column], Column] = by_length) -> DataFrame:
    """All columns and size, source_size, target, copies, taken for each document; these replace input columns of the same names.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` times
    all words. A target stops at ``most`` (a whole number) times its source's words; the excess is reshared by
    weight. No document has more than ``most`` copies. A source's taken words differ from its target by half of one document at most.
    preference: a document's, from its size, a whole number over 0 of some hundred different ones at most.

    Null text: size 0. Documents of size 0 are never taken. A null source is a source of its own.
    Rows that repeat id and text have one draw and are taken together. Empty table: empty result.
    """
    return unpacked(
        _counted(docs, id_col, text_col, source_col, weights, share, most, preference), docs.columns,
        size=F.col("__size"), source_size=F.col("__total"), target=F.col("__target"),
        copies=F.col("__copies"), taken=F.col("__copies") * F.col("__size"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, preference: Callable[[Column], Column] = by_length) -> DataFrame:
    """The mix itself: the same columns, each document as often as it is taken."""
    rows = _counted(docs, id_col, text_col, source_col, weights, share, most, preference).where(F.col("__copies") > 0)
    rows = rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__n"))
    return replaced(rows, docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, 'null'))), 1, 13) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
b AS (SELECT *, 1.5::DOUBLE * sum(total) OVER () AS budget, sum(weight) OVER () AS allw,
        sum(2.0::DOUBLE * total) OVER (ORDER BY 2.0::DOUBLE * total / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capb,
        sum(weight) OVER (ORDER BY 2.0::DOUBLE * total / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wb FROM w),
l AS (SELECT *, max((budget - coalesce(capb, 0)) / (allw - coalesce(wb, 0))) OVER () AS lev FROM b),
t AS (SELECT source, total, least(2.0::DOUBLE * total, lev * weight) AS target FROM l),
c AS (SELECT d.source, g, sum(size)::BIGINT AS words FROM (SELECT *, length(bin(size)) + 4 AS g FROM d WHERE size > 0) d GROUP BY ALL),
x AS (SELECT c.source, g, words, total, target, (target - 2.0::DOUBLE * coalesce(sum(words) OVER before, 0)) / (sum(words * g) OVER (PARTITION BY c.source) - coalesce(sum(words * g) OVER before, 0)) AS lev
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW before AS (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CASE WHEN target >= 2.0::DOUBLE * total THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, max(lev) OVER (PARTITION BY source) * g) END AS times FROM x),
z AS (SELECT *, floor(times)::BIGINT AS whole, times - floor(times) AS p, target - sum(floor(times)::BIGINT * words) OVER (PARTITION BY source) AS need FROM y),
u AS (SELECT d.*, z.whole, z.p, z.need, (('0x' || draw)::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS un
      FROM d LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.size > 0 AND length(bin(d.size)) + 4 = z.g),
q AS (SELECT *, (un / (1 - un)) / (p / (1 - p)) AS rank_key FROM u WHERE p > 0),
k AS (SELECT doc_id, draw, sum(size) OVER (PARTITION BY source ORDER BY rank_key, draw) - sum(size) OVER (PARTITION BY source, rank_key, draw) / 2.0::DOUBLE <= need AS more FROM q)
SELECT u.doc_id, u.size, t.total AS source_size, t.target, (u.size * (coalesce(u.whole, 0) + coalesce(k.more, false)::INT))::BIGINT AS taken
FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN (SELECT DISTINCT * FROM k) k ON u.p > 0 AND u.doc_id IS NOT DISTINCT FROM k.doc_id AND u.draw = k.draw
"""
