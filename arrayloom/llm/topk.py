"""Exact top-k search by block-at-a-time pruning.

Vectors are quantised to integers; a component is a term. Candidates lie in blocks of
documents that each keep the maximum and the minimum of every term and a forward index
(the block's rows). For a query, a block's bound is the sum over its terms of weight times
maximum (minimum where the weight is negative). Blocks are visited from the highest
bound down and scored until a bound falls below the query's k-th score so far.

The work is dealt as a grid: a bounded number of queries meets a bounded number of
candidates in each cell, the partial results are merged by a grouped rank limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import checkpointed, map_arrow

SCALE = 256
#: Rows of a block, of a cell's candidates and of a cell's queries.
BLOCK, CELL, ASKED = 128, 4096, 1024


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), x as double; exact beyond 64 bits by Python's integers."""
    x = x.astype(np.float64)
    if not len(x) or np.abs(x).max() < 2**54:
        return np.floor(SCALE * x).astype(np.int64)
    # A double of 2**54 or more is whole, and 256 times it may be beyond all doubles.
    return np.array([int(v) * SCALE if abs(v) >= 2**54 else int(np.floor(SCALE * v)) for v in x.tolist()], object)


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(ids, rows) of up to so many neighbouring rows each, as bytes and offsets."""
    ids, vecs = [], []

    def out() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, vecs)]).astype("<i8")
        flat = np.concatenate(vecs).astype("<f8") if vecs else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()]), pa.array([ends.tobytes()]), pa.array([flat.tobytes()])], names=["ids", "ends", "flat"])

    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), _numbers(b.column(1)), strict=True):
            ids.append(i)
            vecs.append(v)
            if len(ids) == rows:
                yield out()
                ids, vecs = [], []
    if ids:
        yield out()


def _matrix(ids: bytes, ends: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised rows, shorter rows filled with 0."""
    e, f = np.frombuffer(ends, "<i8"), quantise(np.frombuffer(flat, "<f8"))
    width = int(np.diff(e).max()) if len(e) > 1 else 0
    m = np.zeros((len(e) - 1, width), f.dtype)
    for i in range(len(e) - 1):
        m[i, : e[i + 1] - e[i]] = f[e[i] : e[i + 1]]
    return np.frombuffer(ids, "<i8"), m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: by doubles while every sum is under 2**53, else by integers without a limit."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n
        if most < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        if most < 2**62:
            return a @ b.T
    return a.astype(object) @ b.astype(object).T


class Blocks:
    """Candidates in blocks of neighbouring documents, with each term's maximum and minimum by block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        order = np.lexsort((ids, *_signs(rows)))  # alike vectors share a block, so its bounds are near its scores
        self.ids, self.rows, self.block, self.scored = ids[order], rows[order], block, 0
        starts = np.arange(0, len(ids), block)
        self.high = np.maximum.reduceat(self.rows, starts, axis=0) if len(ids) else rows
        self.low = np.minimum.reduceat(self.rows, starts, axis=0) if len(ids) else rows

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return _product(np.maximum(queries, zero), self.high) + _product(np.minimum(queries, zero), self.low)

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each query, ties to the smaller id.

        In round j every query that is still open meets the block of its j-th highest bound; queries that meet the same block
        are scored in one product. A query is done when its next bound is below its k-th score: a block whose bound equals that score may still hold a smaller id.
        """
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        least: list = [None] * len(own)  # the k-th score, once there are k
        left = np.arange(len(own))
        for j in range(bounds.shape[1]):
            left = np.array([i for i in left if least[i] is None or bounds[i, order[i, j]] >= least[i]], np.int64)
            if not len(left):
                break
            blocks = order[left, j]
            for block in np.unique(blocks):
                asked = left[blocks == block]
                rows = slice(block * self.block, (block + 1) * self.block)
                ids, scores = self.ids[rows], _product(queries[asked], self.rows[rows])
                self.scored += scores.size
                for i, of in zip(asked, scores, strict=True):
                    may = np.flatnonzero((ids != own[i]) & (True if least[i] is None else of >= least[i]))
                    if len(may) > 4 * k:
                        may = may[np.lexsort((ids[may], -of[may]))[:k]]
                    if len(may):
                        best[i] = sorted([*best[i], *((int(of[m]), int(ids[m])) for m in may)], key=lambda x: (-x[0], x[1]))[:k]
                        least[i] = best[i][-1][0] if len(best[i]) == k else None
        return best


def _signs(rows: np.ndarray) -> list[np.ndarray]:
    """Sort keys: the signs of the terms that vary most."""
    if not rows.size:
        return []
    spread = np.argsort(-rows.astype(np.float64).var(axis=0), kind="stable")[:8]
    return [np.asarray(rows[:, t] > 0) for t in spread]


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            at = {n: b.column(n)[i].as_py() for n in b.schema.names}
            mine, queries = _matrix(at["q_ids"], at["q_ends"], at["q_flat"])
            blocks = Blocks(*_matrix(at["ids"], at["ends"], at["flat"]))
            q, v, s, m = [], [], [], []
            for j, (own, best) in enumerate(zip(mine, blocks.top(mine, queries, k), strict=True)):
                for score, vec in best:
                    q.append(int(own))
                    v.append(vec)
                    s.append(score)
                    m.append(int(at["q_marks"][8 * j : 8 * j + 8].hex(), 16) - 2**63)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(m, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "mark", "vec_id", "score"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query shards with a mark of each query's vector, so that different vectors of one id stay different queries."""
    import xxhash

    for b in batches:
        for i in range(b.num_rows):
            ends, flat = (np.frombuffer(b.column(n)[i].as_py(), t) for n, t in (("ends", "<i8"), ("flat", "<f8")))
            marks = b"".join(xxhash.xxh3_64_digest(flat[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:], strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, 1) for n in ("ids", "ends", "flat")), pa.array([marks])], names=["q_ids", "q_ends", "q_flat", "q_marks"])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(__id, __vec as array of double) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("__id"), v.alias("__vec"))


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates that don't have its id.

    The score is the inner product of the quantised vectors; a shorter vector counts as filled
    with 0. Ties go to the smaller id. Null vectors, vectors with null or non-finite components
    and null ids take no part. Equal query rows are one query; different vectors of one id are
    separate queries of that id. Repeated candidates are ranked each. Fewer candidates than k:
    all of them. Empty tables: empty result. A score that doesn't fit a long is an error.
    """
    asked = usable(queries, id_col, vec_col).distinct()
    shape = "ids binary, ends binary, flat binary"
    q = map_arrow(map_arrow(asked, lambda b: _shards(b, ASKED), shape), _marked, "q_ids binary, q_ends binary, q_flat binary, q_marks binary")
    c = map_arrow(usable(candidates, id_col, vec_col), lambda b: _shards(b, CELL), shape)
    # Both sides are cut once, so that a lost executor can't change the shards.
    q, c = checkpointed(q), checkpointed(c.withColumn("__n", F.monotonically_increasing_id()))
    cells = max(1, c.count())
    c = c.select("ids", "ends", "flat", F.pmod(F.xxhash64("__n"), F.lit(cells)).alias("cell"))
    # Every query shard goes to every cell, by an equality join on the cell's number.
    grid = q.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    met = grid.join(c.hint("merge"), "cell")
    part = map_arrow(met, lambda b: _cells(b, k), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
