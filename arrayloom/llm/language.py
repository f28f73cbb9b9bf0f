"""Language identification by compression.

For each language a bounded sample of labelled texts makes a raw-content dictionary of
zstandard. A text is compressed with every dictionary; the language whose dictionary makes
it smallest is the prediction. Texts are compressed in blocks, so that a long text meets
the dictionary all the way and not only at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import below, bounded_batches, packed, unpacked

#: Bounds of the labelled sample that the dictionaries are cut from: texts a language, characters a text, bytes a dictionary, languages.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES, LANGUAGES = 400, 2000, 400 << 10, 500
BLOCK_BYTES, LEVEL = 4096, 9
#: A text is rejected if the second smallest size is less than this share above the smallest. Sizes are whole bytes: where the share is less than one byte it tells nothing, and the text stays.
MARGIN = 0.003
NONE = "und"


def held_out(id_col: Column) -> Column:
    """crc32 of the id's text modulo 3 is 1; null: false."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from the first ``texts`` labelled texts in the order of their hashes.

    Of more than LANGUAGES labels the commonest are learned.
    Of each sampled text one stretch of ``chars`` characters is used, from a place that its hash
    names. Rows with null text or language, without an id or held out are not used.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t"))
    # Languages are counted first, so that of each only about twice the wanted texts are ever moved.
    counts = rows.groupBy("l").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "l").limit(LANGUAGES)
    rows = rows.join(F.broadcast(counts), "l").where(below(F.col("h"), 2 * texts, F.col("c")))
    start = F.pmod(F.col("h"), F.greatest(F.char_length("t") - chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("l", "h", F.substring(F.col("t"), start, F.lit(chars)).alias("t"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    sample = rows.withColumn("n", nth).where(F.col("n") <= texts).orderBy("l", "n").limit(texts * LANGUAGES).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sample:
        parts.setdefault(r.l, []).append(r.t.lower().encode("utf-8", "replace"))
    return {k: b"\n".join(v)[-size:] for k, v in sorted(parts.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        self.coders = []
        for d in dictionaries.values():
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether it is rejected."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return NONE, 0.0, True
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        gap = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.names[order[0]], gap, gap < margin and sizes[order[1]] * margin >= 1


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All columns and lang_pred, score, rejected; these replace input columns of their names.

    lang_pred is a learned language, or ``und`` if the text is null or has no letter. The score is the
    share by which the best size lies under the second. rejected: ``und``, or a score under ``margin`` in a text long enough to tell.
    Ties go to the first name. Equal texts get equal results. Empty table: empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(dictionaries)
        for texts in batches:
            got = [model.predict(t, margin) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["p", "s", "r"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    guess = F.arrow_udf(run, "struct<p:string,s:double,r:boolean>")
    df = packed(docs, __text=F.col(text_col)).withColumn("__g", guess("__text"))
    return unpacked(df, docs.columns, lang_pred=F.col("__g.p"), score=F.col("__g.s"), rejected=F.col("__g.r"))
