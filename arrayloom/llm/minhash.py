"""Near-duplicate detection by DartMinHash.

A text is a bag of five-word shingles, in which a shingle weighs its count (or a set, if asked for). Darts are
thrown at regions of (weight, rank) that belong to a shingle: the darts of a region are a Poisson
process whose gaps, weights and coordinates are hashes of the shingle, so that two texts share
the darts of the part of the region that they share. Of the darts under the text's weight and
under a rank bound that makes about k ln k + 2k of them, the earliest on each of the k coordinates
stays. Coordinates agree with the probability of the weighted Jaccard similarity.

Bands of coordinates are joined to buckets. Texts that are equal are one node from the start. Every bucket has a leader. A node is first held
against one leader of its buckets, by the exact similarity of both texts, and then against those of its other buckets that it isn't joined to. Verified links join nodes to
components, and leaders leave their buckets. No bucket
is ever expanded into its pairs: the nodes of all buckets that still hold several components
are joined by their rarest shingles, which finds every similar pair among them. So each similar pair that
shares a bucket is found, or is in one component without its own test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import below, checkpointed, map_arrow, packed, sized, unpacked
from arrayloom.llm.wordhash import U, mix, portions, shingles

COORDINATES, ROWS = 252, 7
#: Leaders of a bucket in each round. In the first a node meets one leader of all its buckets' alone, in the second the same leaders of all of them.
#: What is left after the last round goes to the join by rare shingles.
LEADERS = (1, 1, 3)
#: Texts of one shingle that the join by rare shingles holds against all others in one part, and pairs of a leader that are tested in one part.
PART, PAIRS = 1000, 100
#: First bits of a shingle's number that tell its cell, whose frequency places it in the join by rare shingles.
CELL_BITS = 20
#: Cells' frequencies are told from one text in SHARE, or from SAMPLE texts if that is more. They only order shingles: all texts are joined, whatever the order.
SAMPLE, SHARE = 500, 8
SIMILARITY, SHINGLE = 0.8, 5
EMPTY = np.iinfo(np.uint64).max


def _throw(best: np.ndarray, doc: np.ndarray, x: np.ndarray, w: np.ndarray, bound: np.ndarray, k: int) -> None:
    """Keep in best[doc, coordinate] the earliest dart under bound[doc]: 40 bits of its rank, 24 of its own."""
    cell, low = 0, 0.0
    while len(x):
        width = 1.0 if cell == 0 else float(1 << (cell - 1))
        rank, d, e, weight = np.zeros(len(x)), doc, x, w
        step = 0
        while len(e):
            # Of few shingles many darts are thrown at once: a text of one shingle throws them all at it.
            many = max(1, min(64, 4096 // len(e)))
            turns = np.array([cell * 0x9E3779B9 + (step + i) * 0xD1B54A32D192ED03 & int(EMPTY) for i in range(many)], U)
            seed = mix(e[:, None] + turns)
            ranks = -np.log(((seed >> U(11)).astype(np.float64) + 0.5) / 2**53) / width
            ranks[:, 0] += rank
            ranks = np.cumsum(ranks, axis=1)
            on = ranks < bound[d][:, None]
            of, nth = np.nonzero(on)
            dart = mix(seed[of, nth] + U(0x632BE59BD9B4E019))
            at = ((dart >> U(32)) * U(k)) >> U(32)
            key = (ranks[of, nth].view(U) >> U(23) << U(24)) | (dart & U(0xFFFFFF))
            flat = d[of] * k + at.astype(np.int64)
            if low + width > 1.0:  # above the first cell a dart may lie over the weight
                own = (mix(dart + U(1)) >> U(11)).astype(np.float64) / 2**53
                under = low + width * own < weight[of]
                flat, key = flat[under], key[under]
            np.minimum.at(best, flat, key)
            more = on[:, -1]
            rank, d, e, weight = ranks[more, -1], d[more], e[more], weight[more]
            step += many
        low += width
        more = w > low
        doc, x, w, cell = doc[more], x[more], w[more], cell + 1


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES, weighted: bool = False) -> np.ndarray:
    """One row of k numbers for each set; a row of EMPTY for an empty one."""
    best = np.full((len(sets), k), EMPTY, U)
    todo = np.array([i for i, s in enumerate(sets) if len(s[0])], np.int64)
    times = (k * math.log(k) + 2 * k) if k > 1 else 4.0
    while len(todo):
        x = np.concatenate([sets[i][0] for i in todo])
        w = np.concatenate([sets[i][1] for i in todo]).astype(np.float64) if weighted else np.ones(len(x))
        doc = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        bound = times / np.bincount(doc, w, len(todo))
        part = np.full(len(todo) * k, EMPTY, U)
        _throw(part, doc, x, w, bound, k)
        best[todo] = part.reshape(-1, k)
        todo = todo[(best[todo] == EMPTY).any(axis=1)]  # a coordinate without a dart: all of the text's darts again, up to twice the rank
        times *= 2
    return best


def bands(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES, rows: int = ROWS, weighted: bool = False) -> list[np.ndarray | None]:
    """The k // rows band hashes of each set, or None for an empty one."""
    s = signatures(sets, k, weighted)[:, : k // rows * rows].reshape(len(sets), k // rows, rows)
    h = np.broadcast_to(np.arange(1, k // rows + 1, dtype=U) * U(0xA0761D6478BD642F), s.shape[:2])
    for j in range(rows):
        h = mix(h + s[:, :, j])
    return [h[i].view(np.int64) if len(sets[i][0]) else None for i in range(len(sets))]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool = False) -> float:
    """Jaccard similarity of two sets, or of two bags; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _sketch(batches: Iterator[pa.RecordBatch], size: int, k: int, rows: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in portions(texts):
            made = bands(shingles(texts[lo:hi], size), k, rows, weighted)
            yield pa.RecordBatch.from_arrays([b.column("digest").slice(lo, hi - lo), b.column("id").slice(lo, hi - lo), pa.array(made, pa.list_(pa.int64()))], names=["digest", "id", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], size: int, least: float, weighted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose text is similar to that of the row without b that comes before them."""
    own = None
    for b in batches:
        texts, heads = b.column("text").to_pylist(), b.column("b").is_null().to_pylist()
        good = []
        for lo, hi in portions(texts):
            for made, head in zip(shingles(texts[lo:hi], size), heads[lo:hi], strict=True):
                if head:
                    own = made
                good.append(not head and similarity(own, made, weighted) >= least)
        yield b.select(["a", "b", "la", "lb"]).filter(pa.array(good, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component. links: a, b (long).

    Each round takes the smallest label among a node's neighbours, then the label of that label,
    until none changes. The tables that are joined are written first, so that each join shuffles both of them for itself alone:
    adaptive execution can then split a node of many links or a label of many nodes.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        told = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        old = labels.select("node", "label", F.col("label").alias("was")).union(told.select("node", "label", F.lit(None).cast("long")))
        near = checkpointed(old.groupBy("node").agg(F.min("label").alias("near"), F.max("was").alias("was")))
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = checkpointed(near.join(far, F.col("near") == F.col("to"), "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "was"))
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE, k: int = COORDINATES, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """All columns and class_id (the smallest id of the row's class) and class_size (rows); they replace columns of their names.

    A class joins equal texts and all texts that verified links connect. The similarity of two texts is that of their bags of
    shingles (weighted: a shingle weighs its count) or of their sets. Two texts of similarity s
    share a band with probability 1 - (1 - s**rows)**(k // rows): 0.9998 at 0.8. A text without words
    is in a class with equal texts only; a row with null text is a class of its own. A null id
    takes no part in the choice of the smallest; a class without ids has a null class_id. Rows that repeat are copies. Empty table: empty result.
    """
    df = _classed(docs, id_col, text_col, least, size, k, rows, weighted)
    return unpacked(df, docs.columns, class_id=F.col("__class"), class_size=F.col("__n").cast("long"))


def _classed(docs: DataFrame, id_col: str, text_col: str, least: float, size: int, k: int, rows: int, weighted: bool) -> DataFrame:
    """__row, __id, __label (a number of the class; null for a null text), __class and __n."""
    known = docs.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(text_col)).alias("digest"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sketched = map_arrow(known, lambda b: _sketch(b, size, k, rows, weighted), f"digest binary, id {id_type}, bands array<bigint>")
    nodes = sketched.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    held = nodes.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("bucket"))
    # Written tables meet, here and below, so that adaptive execution can split the rows of a frequent key.
    shared = checkpointed(held.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket"))
    met = checkpointed(held.join(shared, "bucket"))
    labels = None
    if met.limit(1).count():
        texts = known.groupBy("digest").agg(F.first("text").alias("text"))
        asked = met.select("node").distinct().join(nodes.select("node", "digest"), "node")
        texts = checkpointed(texts.join(asked, "digest").select("node", "text"))
        labels = _linked(met, texts, least, size, weighted)
    out = nodes.select("digest", "node", "rep", "copies")
    if labels is None:
        out = out.select("digest", F.col("node").alias("label"), F.col("rep").alias("class_id"), F.col("copies").alias("class_size"))
    else:
        out = checkpointed(out.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        whole = checkpointed(out.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")))
        out = checkpointed(out.select("digest", "label").join(whole, "label"))
    out = out.select(F.col("digest").alias("__digest"), F.col("label").alias("__label"), F.col("class_id").alias("__class"), F.col("class_size").alias("__size"))
    df = packed(docs, __id=F.col(id_col), __digest=F.unhex(F.md5(text_col))).join(out, "__digest", "left")
    alone = F.col("__digest").isNull()
    return df.select("__row", "__id", "__label", F.when(alone, F.col("__id")).otherwise(F.col("__class")).alias("__class"), F.when(alone, F.lit(1)).otherwise(F.col("__size")).alias("__n"))


def _tested(pairs: DataFrame, texts: DataFrame, least: float, size: int, weighted: bool) -> DataFrame:
    """The similar ones of pairs (a, b, la, lb), by the texts themselves.

    In every pair the text of a is a leader's, which many pairs share: it is sent once to each part of its pairs and
    meets them in a stream. pairs: checkpointed.
    """
    hot = sized(checkpointed(pairs.groupBy(F.col("a").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > PAIRS).select("hot", F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"))))
    dealt = pairs.withColumn("part", F.lit(0))
    if hot.limit(1).count():
        dealt = checkpointed(pairs.join(hot, F.col("a") == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("hot", "parts"))
    heads = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
    none = F.lit(None).cast("long")
    rows = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "la", "lb", "text")
    rows = rows.union(heads.select("a", "part", none, none, none, "text")).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return checkpointed(map_arrow(rows.drop("part"), lambda b: _verify(b, size, least, weighted), "a bigint, b bigint, la bigint, lb bigint"))


def _relabelled(labels: DataFrame | None, moved: DataFrame) -> DataFrame:
    """(node, label) after components were joined. moved: (node, label) of labels that were joined to smaller ones, or stay."""
    if labels is None:
        return moved
    to = moved.select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(to, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return checkpointed(known.union(moved.join(labels.select("node"), "node", "left_anti").select("node", "label")))


def _linked(met: DataFrame, texts: DataFrame, least: float, size: int, weighted: bool) -> DataFrame | None:
    """(node, label) of all nodes that verified links join, or None. met: (node, bucket) of buckets with several nodes."""
    state = met.select("bucket", "node", F.col("node").alias("label"))
    labels = tested = None
    for turn, number in enumerate(LEADERS, 1):
        # The leaders of a bucket are its least nodes under a hash of the turn (the first two have the same), of different remainders so that they are different nodes.
        # Buckets that hold the same nodes have the same leaders, so that a pair that shares many buckets is one test.
        draw = max(1, turn - 1)
        key = F.xxhash64("node", F.lit(draw))
        keys = [F.when(F.pmod(key, F.lit(number)) == j, key) for j in range(number)]
        chosen = [c.alias(f"{n}{j}") for j, key in enumerate(keys) for n, c in (("n", F.min_by("node", key)), ("m", F.min_by("label", key)))]
        lead = checkpointed(state.groupBy("bucket").agg(*chosen, F.min("label").alias("l0"), F.max("label").alias("l1")).where(F.col("l0") != F.col("l1")))
        leads = F.array(*(F.struct(F.col(f"n{j}").alias("node"), F.col(f"m{j}").alias("label")) for j in range(number)))
        led = lead.select("bucket", F.filter(leads, lambda x: x["node"].isNotNull()).alias("leads"))
        live = checkpointed(state.join(led, "bucket").select("bucket", "node", "label", "leads"))
        # Of each node the different leaders of all its buckets: those of its own component need no test, and no pair is tested twice.
        met_by = live.groupBy("node").agg(F.first("label").alias("label"), F.array_distinct(F.flatten(F.collect_list("leads"))).alias("leads"))
        others = F.filter("leads", lambda x: x["label"] != F.col("label"))
        if turn == 1:
            # At first a node meets one leader alone, the least of all of them, so that a large group of copies has about a link a node.
            # No leader has met all of its bucket by that, and none leaves it.
            least_of_all = F.array_min(F.transform("leads", lambda x: F.struct(F.xxhash64(x["node"], F.lit(draw)).alias("h"), x["node"].alias("node"), x["label"].alias("label"))))
            apart = met_by.withColumn("lead", least_of_all).where(F.col("lead.node") != F.col("node"))
        else:
            apart = met_by.select("node", "label", F.explode(others).alias("lead"))
        pairs = apart.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.label").alias("la"), F.col("label").alias("lb"))
        pairs = checkpointed(pairs if tested is None else pairs.join(_either_way(tested), ["a", "b"], "left_anti"))
        some = pairs.limit(1).count()
        if some:
            tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
            found = _tested(pairs, texts, least, size, weighted)
            some = found.limit(1).count()
        live = live.select("bucket", "node", "label") if turn == 1 else live.where(~F.array_contains("leads.node", F.col("node"))).select("bucket", "node", "label")
        if some:
            moved = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            labels = _relabelled(labels, moved)
            state = live.join(moved.select(F.col("node").alias("old"), F.col("label").alias("new")), F.col("label") == F.col("old"), "left").select("bucket", "node", F.coalesce("new", "label").alias("label"))
        else:
            state = live
    found = _by_rare_shingles(state.select("bucket", "node"), labels, tested, texts, least, size, weighted)
    return labels if found is None else _relabelled(labels, components(found))


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _elements(texts: list[str], size: int, weighted: bool) -> list[np.ndarray]:
    """Of each text a number for each of its shingles (of a bag: for each copy of it)."""
    held = shingles(texts, size)
    if not weighted:
        return [x for x, _ in held]
    nth = lambda n: (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(U)
    return [mix(np.repeat(x, n) + nth(n) * U(0x9E3779B97F4A7C15)) for x, n in held]


def _all_elements(batches: Iterator[pa.RecordBatch], size: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    """label and element, a row for each element of each text."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in portions(texts):
            held = _elements(texts[lo:hi], size, weighted)
            label = np.repeat(b.column("label").slice(lo, hi - lo).to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(np.concatenate(held).view(np.int64))], names=["label", "element"])


def _levels(shared: DataFrame) -> np.ndarray:
    """For each cell (the first bits of an element) how frequent its elements in shared (element, df) are together; 0: it holds none. Of one size whatever the table's."""
    often = F.least(F.ceil(8 * F.log2(F.sum("df") + 1.0)), F.lit(255)).cast("smallint")
    got = shared.groupBy(F.shiftrightunsigned("element", 64 - CELL_BITS).cast("int").alias("cell")).agg(often.alias("level")).toArrow()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[got["cell"].to_numpy()] = got["level"].to_numpy()
    return levels


def _shared(held: DataFrame) -> DataFrame:
    """(element, df) of the elements that several labels of held (label, element) have; df: rows."""
    seen = held.groupBy("element").agg(F.count("*").alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    return seen.where(F.col("l0") != F.col("l1")).select("element", "df")


def _first_elements(batches: Iterator[pa.RecordBatch], levels: np.ndarray, size: int, least: float, weighted: bool) -> Iterator[pa.RecordBatch]:
    """Of each text of n elements, ordered by their cells' levels, the first n - least * n + 1 with their places from 1."""
    shift = U(65 - len(levels).bit_length())
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in portions(texts):
            rows = []
            for x in _elements(texts[lo:hi], size, weighted):
                level = levels[(x >> shift).astype(np.int64)]
                first = np.lexsort((x, level))[: len(x) - math.ceil(least * len(x) - 1e-9) + 1]
                rows.append((len(x), np.arange(1, len(first) + 1), x[first]))
            sizes = [len(place) for _, place, _ in rows]
            spread = lambda c: np.repeat(c.slice(lo, hi - lo).to_numpy(), sizes)  # noqa: E731, B023
            columns = [spread(b.column("node")), spread(b.column("label")), np.repeat(np.array([n for n, _, _ in rows], np.int64), sizes), np.concatenate([p for _, p, _ in rows]).astype(np.int64), np.concatenate([x for _, _, x in rows]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "label", "n", "place", "element"])


def _by_rare_shingles(rest: DataFrame, labels: DataFrame | None, tested: DataFrame | None, texts: DataFrame, least: float, size: int, weighted: bool) -> DataFrame | None:
    """All links between components among the nodes of rest (bucket, node), as pairs of labels (a, b), or None.

    With the shingles of each text from rare to common, the first that two similar texts share stands so
    early in both that enough can follow: in the first n - least * n + 1 of either, and of the
    smaller in the first n - 2 * least / (1 + least) * n + 1. Only those are joined.
    """
    label = F.col("node")
    if labels is not None:
        known = labels.select(F.col("node").alias("to"), F.col("label").alias("of"))
        rest, label = rest.join(known, F.col("node") == F.col("to"), "left"), F.coalesce("of", "node")
    rest = checkpointed(rest.select("bucket", "node", label.alias("label")))
    several = checkpointed(rest.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where(F.col("l0") != F.col("l1")).select("bucket"))
    nodes = checkpointed(rest.join(several, "bucket").select("node", "label").distinct())
    total = nodes.count()
    if not total:
        return None
    asked = texts.join(nodes, "node").select("node", "label", "text")
    # Any order that all texts have in common misses no pair, so that a sample may tell which shingles are frequent. The order is known
    # without a join, and of all other texts only the first shingles become rows.
    some = asked.where(below(F.xxhash64("node"), max(SAMPLE, total // SHARE), total))
    levels = _levels(_shared(map_arrow(some, lambda b: _all_elements(b, size, weighted), "label bigint, element bigint")))
    sent = texts.sparkSession.sparkContext.broadcast(levels)
    firsts = checkpointed(map_arrow(asked, lambda b: _first_elements(b, sent.value, size, least, weighted), "node bigint, label bigint, n bigint, place bigint, element bigint"))
    # First shingles that no two components share are only counted, and never joined.
    shared = checkpointed(_shared(firsts))
    up = lambda share, n: F.ceil(F.lit(share) * n - 1e-9)
    ranked = firsts.join(shared, "element").withColumn("parts", F.ceil(F.col("df") / PART).cast("int"))
    ranked = checkpointed(ranked.select("element", "node", "label", "n", "place", "parts"))
    small = ranked.where(F.col("place") <= F.col("n") - up(2 * least / (1 + least), F.col("n")) + 1).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    large = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = small.alias("x"), large.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    fits = (F.col("x.label") != F.col("y.label")) & ((nx < ny) | ((nx == ny) & (F.col("x.node") < F.col("y.node")))) & (nx >= up(least, ny))
    fits = fits & (1 + F.least(nx - F.col("x.place"), ny - F.col("y.place")) >= up(least / (1 + least), nx + ny))
    met = x.join(y, (F.col("x.element") == F.col("y.element")) & (F.col("x.part") == F.col("y.part")) & fits)
    swap = F.col("x.node") < F.col("y.node")
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.when(swap, F.col("x.label")).otherwise(F.col("y.label")).alias("la"), F.when(swap, F.col("y.label")).otherwise(F.col("x.label")).alias("lb")).distinct()
    pairs = checkpointed(pairs if tested is None else pairs.join(_either_way(tested), ["a", "b"], "left_anti"))
    found = _tested(pairs, texts, least, size, weighted).select(F.col("la").alias("a"), F.col("lb").alias("b")) if pairs.limit(1).count() else None
    return found if found is not None and found.limit(1).count() else None


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE, k: int = COORDINATES, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """The rows of docs that stay: of each class one row with its smallest id (a row without id only if none has one). Rows with null text stay.

    Of several such rows of a class that one stays whose contents have the smallest hash.
    """
    marked = _classed(docs, id_col, text_col, least, size, k, rows, weighted)
    null, kept = marked.where(F.col("__label").isNull()), marked.where(F.col("__label").isNotNull() & F.col("__id").eqNullSafe(F.col("__class")))
    # Only classes with an id in several rows, or without ids, hold several: only then the rows are grouped.
    if kept.groupBy("__label").count().where("count > 1").limit(1).count():
        kept = kept.groupBy("__label").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    return kept.select("__row").union(null.select("__row")).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
