"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the tokens of a window on both its sides; the
token itself is masked. A document's score is the sum of the log-probabilities of its tokens.

Tokens are words (see ``wordhash``). Each has a leaf: the commonest words of the whole
corpus have one each, the others share leaves by their hash. Leaves are parted in classes, by the words that stand beside them in all texts.
The network gives P(class | window); a leaf has its class's probability times its share in the class, by counts over all documents;
a word of a shared leaf has that of its leaf times its share in the leaf, by its count in all *other* documents:
so a word that one document alone holds is as improbable as one never seen, and one that comes again elsewhere is not. The
table of counts grows with the corpus: it stays a table, and texts meet it by a join.

Training visits all positions of all documents. Documents are dealt to shards by a hash, the number of shards follows the
number of words, and a shard's documents come in the order of their digests; so neither files nor tasks have
a part in the result. From a start that knows only how often each class occurs, every shard trains over its own positions, and
the parameters are averaged by positions, in groups of neighbouring shards, so that the driver meets a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import checkpointed, discard, map_arrow, unpacked
from arrayloom.llm.wordhash import U, mix, portions, words

#: Leaves, those of them that words share, classes; tokens seen to each side, hidden units.
LEAVES, SHARED, CLASSES, SIDE, HIDDEN = 8192, 256, 64, 2, 16
COMMON = LEAVES - SHARED
#: Positions of one step, rates of classes and of embeddings; tokens that are trained on at a time; tokens of a shard, about; tables added up in one group.
STEP, RATE, EMBEDDING_RATE, CHUNK, SHARD_TOKENS, GROUP = 4096, 0.02, 0.2, 1 << 16, 4_000_000, 8
#: What a word that no other document holds counts.
ALONE = 0.1
#: The commonest words by which neighbours are told apart when classes are made, and rounds of that.
BESIDE, ROUNDS = 16, 15
#: Tokens whose words are counted before they are handed on.
COUNTED = 1 << 20
OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


class Net(NamedTuple):
    """Embeddings by place in the window (2 * SIDE, 1 + LEAVES, HIDDEN), their bias, weights and biases of the classes."""

    inner: np.ndarray
    bias: np.ndarray
    upper: np.ndarray
    level: np.ndarray

    @staticmethod
    def start(mass: np.ndarray) -> Net:
        """Every class as probable as it is frequent, whatever the window. mass: the classes' tokens."""
        inner = np.random.default_rng(7).normal(0, 0.3, (2 * SIDE, 1 + LEAVES, HIDDEN)).astype(np.float32)
        level = np.clip(np.log((mass + 0.5) / (mass + 0.5).sum()), -12, 12)
        return Net(inner, np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, len(mass)), np.float32), level.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self])

    def like(self, flat: np.ndarray) -> Net:
        ends = np.cumsum([p.size for p in self])
        return Net(*(f.reshape(p.shape).astype(np.float32) for f, p in zip(np.split(flat, ends[:-1]), self, strict=True)))


class Vocabulary(NamedTuple):
    """The common words' hashes, sorted, and their ranks; how many tokens each leaf has; the first shared leaf; the leaves' classes; counts: (h, n), the words of shared leaves that occur more than once.

    Number 0 is the border of a text; number 1 + r is leaf r. The leaves of common words come first, by frequency.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    totals: np.ndarray
    common: int
    classes: np.ndarray
    counts: DataFrame | None = None

    def number(self, h: np.ndarray) -> np.ndarray:
        out = (1 + self.common + (mix(h) % U(SHARED)).astype(np.int64)).astype(np.int16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.ranks[at] + np.int16(1), out)
        return out

    @property
    def mass(self) -> np.ndarray:
        """The tokens of each class."""
        return np.bincount(self.classes, self.totals, CLASSES)

    @property
    def shares(self) -> np.ndarray:
        """The logarithm of each leaf's share in its class; a leaf that no token had counts half a one."""
        own = self.totals + 0.5
        return np.log(own / np.bincount(self.classes, own, CLASSES)[self.classes])


def numbered(texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    h, first = words(texts)
    n = vocabulary.number(h)
    return [n[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(line, places): all documents' numbers with borders between them, and where in the line each token is."""
    gap = np.zeros(SIDE, np.int16)
    line = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    size = np.array([len(d) for d in docs], np.int64)
    start = SIDE + np.concatenate([[0], np.cumsum(size + SIDE)])[:-1]
    return line, np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())


def _hidden(inner: np.ndarray, bias: np.ndarray, near: np.ndarray) -> np.ndarray:
    total = bias + inner[0][near[:, 0]]
    for c in range(1, near.shape[1]):
        total += inner[c][near[:, c]]
    return np.tanh(total, out=total)


def log_probabilities(net: Net, known: Vocabulary, line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of the leaf at each place, given its window."""
    out, shares = np.empty(len(places)), known.shares
    for i in range(0, len(places), STEP):
        at = places[i : i + STEP]
        leaf = line[at].astype(np.int64) - 1
        z = _hidden(net.inner, net.bias, line[at[:, None] + OFFSETS]) @ net.upper
        z += net.level
        own = z[np.arange(len(at)), known.classes[leaf]].astype(np.float64)
        # Weights and biases are bounded, so that no exponential is beyond single precision.
        out[i : i + STEP] = own - np.log(np.exp(z, out=z).sum(axis=1, dtype=np.float64)) + shares[leaf]
    return out


def train(net: Net, classes: np.ndarray, line: np.ndarray, places: np.ndarray) -> Net:
    """Gradient descent over the places in their order, a step of them at a time. A parameter's gradient is the sum over its places divided by the root of their number."""
    inner, bias, upper, level = (p.copy() for p in net)
    for i in range(0, len(places), STEP):
        at = places[i : i + STEP]
        near = line[at[:, None] + OFFSETS]
        h = _hidden(inner, bias, near)
        rate = np.float32(RATE / np.sqrt(len(at)))
        z = h @ upper
        z += level
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(at)), classes[line[at].astype(np.int64) - 1]] -= 1
        back = z @ upper.T
        upper -= rate * (h.T @ z)
        level -= rate * z.sum(axis=0)
        np.multiply(h, h, out=h)
        back *= np.subtract(1, h, out=h)
        bias -= rate * back.sum(axis=0)
        for c in range(2 * SIDE):
            rows = np.argsort(near[:, c], kind="stable")
            of = near[rows, c]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            many = np.diff(np.append(first, len(of)))
            inner[c][of[first]] -= np.add.reduceat(back[rows], first, axis=0) * (EMBEDDING_RATE / np.sqrt(many)).astype(np.float32)[:, None]
        np.clip(upper, -4, 4, out=upper)
        np.clip(level, -12, 12, out=level)
    return Net(inner, bias, upper, level)


def classed(beside: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The class of each leaf: those whose neighbours are alike. beside: (LEAVES, 2 * BESIDE) counts of common words before and after each leaf.

    Leaves are points, by the roots of their neighbours' shares; classes are centres that move to the means of their leaves, weighed by tokens. No draw is made.
    """
    every = beside.sum(axis=0) + 1.0
    points = np.sqrt((beside + every / every.sum()) / (beside.sum(axis=1) + 1.0)[:, None])
    centres = points[np.linspace(0, min(len(points), 2000) - 1, CLASSES).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        nearest = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        mass = np.bincount(nearest, totals, CLASSES)
        sums = np.stack([np.bincount(nearest, totals * points[:, j], CLASSES) for j in range(points.shape[1])], axis=1)
        centres[mass > 0] = sums[mass > 0] / mass[mass > 0, None]
    return nearest


def vocabulary(texts: DataFrame, common: int = COMMON) -> Vocabulary:
    """The commonest words of all texts (column text), ties to the smaller hash; all leaves in one class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((mix(h) % U(SHARED)).astype(np.int64)), pa.array(n, pa.int64())], names=["h", "c", "n"])

        for b in batches:
            listed = b.column("text").to_pylist()
            for lo, hi in portions(listed):
                held.append(words(listed[lo:hi])[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = checkpointed(map_arrow(texts, count, "h bigint, c bigint, n bigint").groupBy("h", "c").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.col("n").desc(), "h").limit(common).collect()
    totals = np.zeros(LEAVES)
    totals[: len(top)] = [r.n for r in top]
    # Below the last common word in the order of frequency, no word has a leaf of its own.
    others = counts.where((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("h") > top[-1].h))) if top else counts
    for r in others.groupBy("c").agg(F.sum("n").alias("n")).collect():
        totals[common + r.c] = r.n
    hashes = np.array([r.h for r in top], np.int64).view(U)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order.astype(np.int16), totals, common, np.zeros(LEAVES, np.int64), others.where("n > 1").select("h", "n"))


def _chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, documents) of about CHUNK tokens, by the order of the shard's documents alone."""
    shard, held, size = None, [], 0
    for s, raw in rows:
        if held and (s != shard or size >= CHUNK):
            yield shard, held
            held, size = [], 0
        shard = s
        held.append(np.frombuffer(raw, "<i2"))
        size += len(held[-1])
    if held:
        yield shard, held


def _sum_row(part: int, n: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([sums.tobytes()])], names=["part", "n", "sums"])


SUMS = "part bigint, n bigint, sums binary"


def _added(batches: Iterator[pa.RecordBatch], kind: str, group: int) -> Iterator[pa.RecordBatch]:
    """Sums of the tables of each group of neighbouring parts, in the order of parts; of models, their means by n."""
    weighed = kind == "<f4"
    close = lambda: _sum_row(own, n, (total / n if weighed else total).astype(kind))
    own, n, total = None, 0, None
    for b in batches:
        for s, k, raw in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("sums"), strict=True):
            if s // group != own:
                if total is not None:
                    yield close()
                own, n, total = s // group, 0, 0
            n, total = n + k, total + np.frombuffer(raw.as_buffer(), kind) * (float(k) if weighed else 1)
    if total is not None:
        yield close()


def _summed(tables: DataFrame, kind: str) -> tuple[int, np.ndarray | int]:
    """(n, sums, or means of models) of all rows of SUMS, added up in groups of neighbouring parts until few are left."""
    tables = checkpointed(tables)
    while tables.count() > GROUP:
        grouped = tables.withColumn("group", F.floor(F.col("part") / GROUP)).repartition("group").sortWithinPartitions("part", "n", "sums").drop("group")
        more = checkpointed(map_arrow(grouped, lambda b: _added(b, kind, GROUP), SUMS))
        discard(tables)
        tables = more
    rows = sorted(tables.collect(), key=lambda r: (r.part, r.n, bytes(r.sums)))
    discard(tables)
    n, weighed = sum(r.n for r in rows), kind == "<f4"
    return n, sum((np.frombuffer(r.sums, kind) * (r.n / n if weighed else 1) for r in rows), 0)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each of the commonest words, or any other (0), stands before and after each leaf."""
    total, part = np.zeros(LEAVES * 2 * BESIDE, np.int64), 0
    for b in batches:
        docs = [np.frombuffer(r.as_buffer(), "<i2") for r in b.column("numbers")]
        part = part or int(b.column("shard")[0].as_py())
        line, places = windows(docs)
        for i in range(0, len(places), CHUNK * 8):
            at = places[i : i + CHUNK * 8]
            leaf = (line[at].astype(np.int64) - 1) * 2 * BESIDE
            for j, near in enumerate((line[at - 1], line[at + 1])):
                total += np.bincount(leaf + j * BESIDE + np.where(near < BESIDE, near, 0), minlength=len(total))
    if total.any():
        yield _sum_row(part, 0, total)


def fit(docs: DataFrame, text_col: str = "text", id_col: str | None = "doc_id", common: int = COMMON, shard_tokens: int = SHARD_TOKENS) -> tuple[Vocabulary, Net]:
    """The vocabulary and network of all non-null texts. The id only deals copies of one text to different shards."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("digest"), (F.col(id_col) if id_col else F.lit(0)).alias("id"), F.col(text_col).alias("text"))
    spark, known = docs.sparkSession, vocabulary(texts.select("text"), common)
    words_of = spark.sparkContext.broadcast(known._replace(counts=None))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("text").to_pylist()
            for lo, hi in portions(listed):
                made = pa.array([n.astype("<i2").tobytes() for n in numbered(listed[lo:hi], words_of.value)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("shard").slice(lo, hi - lo), b.column("digest").slice(lo, hi - lo), made], names=["shard", "digest", "numbers"])

    number = max(1, -(-int(known.totals.sum()) // shard_tokens))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("digest", "id"), F.lit(number)).cast("long"))
    dealt = checkpointed(map_arrow(dealt.select("shard", "digest", "text"), spelled, "shard bigint, digest string, numbers binary"))
    _, beside = _summed(map_arrow(dealt.select("shard", "numbers"), _beside, SUMS), "<i8")
    if not isinstance(beside, np.ndarray):
        discard(dealt)
        return known, Net.start(known.mass)
    known = known._replace(classes=classed(beside.reshape(LEAVES, 2 * BESIDE).astype(np.float64), known.totals))
    shared = spark.sparkContext.broadcast((known.classes, Net.start(known.mass)))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, seen = None, None, 0
        rows = ((s, r.as_buffer()) for b in batches for s, r in zip(b.column("shard").to_pylist(), b.column("numbers"), strict=True))
        for s, held in _chunks(rows):
            if s != shard:
                if seen:
                    yield _sum_row(shard, seen, own.flat())
                shard, own, seen = s, shared.value[1], 0
            line, places = windows(held)
            own, seen = train(own, shared.value[0], line, places), seen + len(places)
        if seen:
            yield _sum_row(shard, seen, own.flat())

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "digest").select("shard", "numbers")
    _, mean = _summed(map_arrow(ordered, learned, SUMS), "<f4")
    discard(dealt)
    return known, shared.value[1].like(mean)


def score_texts(texts: list[str], words_of: Vocabulary, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, summed log-probabilities of the tokens' leaves) of each text."""
    docs = numbered(texts, words_of)
    size = np.array([len(d) for d in docs], np.int64)
    out = np.zeros(len(docs))
    told = log_probabilities(net, words_of, *windows(docs))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(told, (np.cumsum(size) - size)[some])
    return size, out


def _shared_words(texts: list[str], words_of: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts' places, hashes, counts) of the words of shared leaves, and by text their tokens and the logarithms of their shares if no other text had them."""
    h, first = words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    number = words_of.number(h).astype(np.int64) - 1
    rare = number >= words_of.common
    doc, h, number = doc[rare], h[rare], number[rare]
    tokens, alone = np.bincount(doc, minlength=len(texts)), np.bincount(doc, np.log(ALONE / (words_of.totals[number] + 1.0)), len(texts))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)])
    return doc[new], h[new].view(np.int64), np.diff(np.append(new, len(h))), tokens, alone


def score(docs: DataFrame, model: tuple[Vocabulary, Net], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (None: all) and n_tokens, log_prob (the sum), mean_log_prob, n_alone; these replace input columns of their names.

    n_alone: the tokens whose words stand in no other document, of those words that share leaves.
    Null text or text without words: 0 tokens, log_prob 0, null mean. Empty table: empty result.
    Equal texts get equal scores up to the rounding of sums. Whole texts are scored. The model's counts are taken as those of a
    corpus that holds each text as often as docs does: a text's own words are taken off once.
    """
    words_of, net = model
    columns = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((words_of._replace(counts=None), net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        place = TaskContext.get().partitionId() << 40  # rows are numbered by task; they are kept before anything reads them
        for b in batches:
            listed = [t or "" for t in b.column("__text").to_pylist()]
            for lo, hi in portions(listed):
                n, s = score_texts(listed[lo:hi], known, own)
                doc, h, k, rare, alone = _shared_words(listed[lo:hi], known)
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                ids = pa.array(place + np.arange(hi - lo))
                place += hi - lo
                lists = [pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(k, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("__row").slice(lo, hi - lo), ids, pa.array(n), pa.array(s + alone), pa.array(rare), *lists], names=["__row", "__id", "__n", "__s", "__rare", "__h", "__k"])

    df = docs.select(F.struct(*(F.col(c) for c in columns)).alias("__row"), F.col(text_col).alias("__text"))
    shape = f"__row {df.schema['__row'].dataType.simpleString()}, __id bigint, __n bigint, __s double, __rare bigint, __h array<bigint>, __k array<int>"
    df = checkpointed(map_arrow(df, run, shape))
    # What the words' counts in other texts add to their shares. The join is one of sorted rows at any size: the table of counts grows with the corpus.
    met = df.select("__id", F.explode(F.arrays_zip(F.col("__h").alias("h"), F.col("__k").alias("k"))).alias("w")).select("__id", "w.h", "w.k")
    met = met.join(words_of.counts.hint("merge"), "h")
    others = F.greatest(F.col("n") - F.col("k"), F.lit(0))
    own = met.groupBy("__id").agg(F.sum(F.col("k") * (F.log(others + ALONE) - F.log(F.lit(ALONE)))).alias("own"), F.sum(F.when(others > 0, F.col("k"))).alias("met"))
    df = df.select("__row", "__id", "__n", "__s", "__rare").join(own, "__id", "left").withColumn("__s", F.round(F.col("__s") + F.coalesce("own", F.lit(0.0)), 4))
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    return unpacked(df, columns, n_tokens=F.col("__n"), log_prob=F.col("__s"), mean_log_prob=mean, n_alone=F.col("__rare") - F.coalesce("met", F.lit(0)))
