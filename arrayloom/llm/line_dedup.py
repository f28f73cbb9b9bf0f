"""Line deduplication with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed to 128 bits; documents
are counted per hash, hashes in too many documents are joined back to the positions
they occupy, and each text is reassembled from the runs of lines between dropped
positions. Only hashes and positions are shuffled for the counting; the texts move
once, when they meet their dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import SPACE, checkpointed, packed, replaced, sized, unpacked

#: Occurrences of one line that are looked up in one task, at least.
HOT_DOCS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased (no other letters)."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _marked(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """__row, __text and __drop (sorted positions of the lines to drop, or null) for each row."""
    rows = packed(docs, __id=F.col(id_col), __text=F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("__mark", F.xxhash64("__text"))
    lines = (
        rows.select("__id", "__mark", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
        .select("__id", "__mark", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__mark", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))
    )
    # One row for each hash and document first: a line of a third of all documents is then counted by partial sums.
    heavy = (
        lines.groupBy("__h1", "__h2", "__id").agg(F.count("*").alias("__lines"))
        .groupBy("__h1", "__h2").agg(F.count("__id").alias("__docs"), F.sum("__lines").alias("__rows"), F.max("__id").alias("__keep"))
        .where(F.col("__docs") >= min_docs)
    )
    # A line that occurs more often than a thousandth of all documents is looked up in parts of about that size. There are at
    # most a thousand times as many such lines as an average document has, and they are counted before they are sent.
    heavy, part = checkpointed(heavy), max(HOT_DOCS, docs.count() // 1000)
    parts = F.ceil(F.col("__rows") / part).cast("int")
    hot = heavy.where(F.col("__rows") > part).select("__h1", "__h2", parts.alias("__parts"))
    salt = F.pmod(F.xxhash64("__id", "__mark", "__pos"), F.col("__parts")).cast("int")
    lines = lines.join(sized(hot), ["__h1", "__h2"], "left").withColumn("__salt", F.coalesce(salt, F.lit(0)))
    heavy = heavy.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__rows") > part, parts - 1).otherwise(0))))
    drops = (
        lines.join(heavy.select("__h1", "__h2", "__salt", "__keep"), ["__h1", "__h2", "__salt"])
        .where(F.col("__id").isNull() | (F.col("__id") < F.col("__keep")))
        .groupBy(F.col("__id").alias("__did"), F.col("__mark").alias("__dmark"))
        .agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))
    )
    same = F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__mark") == F.col("__dmark"))
    return rows.join(drops, same, "left").select("__row", "__text", "__drop", F.split("__text", "\n").alias("__lines"))


def _kept() -> Column:
    """The lines outside __drop: slices between neighbouring dropped positions, in one pass over the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform("__drop", lambda p: p + 1))
    ends = F.concat(F.col("__drop"), F.array(F.size("__lines")))
    runs = F.zip_with(starts, ends, lambda s, e: F.slice(F.col("__lines"), s + 1, e - s))
    return F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(runs), "\n"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that many documents hold, except in the document of the largest id.

    Texts are split at newline. A line's key is the line without ASCII white space at both
    ends, A-Z lower-cased. Keys of at least ``min_chars`` code points held by at least
    ``min_docs`` documents lose all their lines except those in the largest id. Returns
    all columns and ``kept_text``, ``n_lines`` (before), ``n_dropped``; these replace input
    columns of the same names.

    Null or empty text: one empty line, kept. Rows of one id are one document and their
    lines share its fate. A row without an id counts as no document, and loses the lines that enough documents hold.
    An empty table gives an empty table.
    """
    marked = _marked(docs, id_col, text_col, min_chars, min_docs)
    return unpacked(
        marked, docs.columns,
        kept_text=_kept(),
        n_lines=F.size("__lines").cast("long"),
        n_dropped=F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
    )


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **how: int) -> DataFrame:
    """The same columns with the text replaced by its kept lines, and its length by that of these.

    A null text stays null. A text all of whose lines go becomes empty; its row stays.
    """
    marked = _marked(docs, id_col, text_col, how.get("min_chars", 20), how.get("min_docs", 3))
    marked = marked.withColumn("__new", F.when(F.col("__row").getField(text_col).isNotNull(), _kept()))
    new = {text_col: F.col("__new")}
    if size_col.lower() in {c.lower() for c in docs.columns}:
        new[size_col] = F.when(F.col("__drop").isNull(), F.col("__row").getField(size_col)).otherwise(F.char_length("__new").cast("long"))
    return replaced(marked, docs.columns, **new)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND coalesce(k.doc_id < h.keep, true)) AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
