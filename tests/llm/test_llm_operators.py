"""Brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import os
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import audio, language, licences, line_dedup, lm, minhash, mixing, pieces, topk, url_filter
from arrayloom.llm.wordhash import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns that clash with working and result columns."""
    line = "This line stands in many of the documents."
    rows = [
        (1, f"{line}\nown one", "en", "a", 10), (2, f" {line.upper()}\t\nown two", "en", "a", 10), (3, line, "en", None, 10), (4, f"{line}\n{line}\n", "en", "b", 10),
        (5, None, "en", "b", None), (None, f"x\n{line}", None, "b", 5), (6, "", "de", "b", 0), (7, "lang " * 40_000, "en", "c", 200_000), (7, "lang " * 40_000, "en", "c", 200_000), (8, "1234 !!", None, "c", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("__row", F.lit(1)).withColumn("size", F.lit("x")).withColumn("score", F.lit("y")).withColumn("rank", F.lit(0)).withColumn("N_LINES", F.lit("z")).withColumn("bucket", F.lit(2)).withColumn("row", F.lit(3)).withColumn("text2", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_line_dedup(odd, none):
    rows = {(r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(odd).select("doc_id", "n_dropped", F.substring("kept_text", 1, 60).alias("kept_text")).collect()}
    assert (1, 1, "own one") in rows and (2, 1, "own two") in rows and (3, 1, "") in rows and (None, 1, "x") in rows
    assert any(r[0] == 4 and r[1] == 0 for r in rows) and (5, 0, "") in rows and (6, 0, "") in rows
    assert line_dedup.line_dedup(none).count() == 0
    kept = line_dedup.dedup_texts(odd)
    assert kept.columns == odd.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in kept.where("doc_id in (1, 5, 6)").collect()} == {(1, "own one", 7), (5, None, None), (6, "", 0)}


def test_line_dedup_of_rows_without_ids(spark, duck):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, f"{line}\nx"), (1, line), (2, f"y\n{line}"), (None, "another line that two documents hold"), (3, "another line that two documents hold"), (4, "another line that two documents hold")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_dedup(df).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_dedup(df.union(spark.createDataFrame([(5, line)], df.schema))).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 0.3, (600, 6)), 1)  # rounded: many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (None, [1.0] * 6), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.search(df.where("vec_id % 50 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * v).astype(int)
    ids = [*range(600), 3]
    for i in range(0, 600, 50):
        want = sorted(((-int(q[i] @ q[j]), j) for j in ids if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert set(got) == set(range(0, 600, 50))
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df.where("vec_id = 50"), df.limit(0)).count() == 0
    few = topk.search(df.where("vec_id = 0"), df.where("vec_id < 3")).collect()
    assert len(few) == 2


def test_bounds_leave_blocks_out():
    rng = np.random.default_rng(6)
    centre = np.repeat(rng.normal(0, 400, (40, 16)), 128, axis=0)
    rows = np.floor(centre + rng.normal(0, 5, centre.shape)).astype(np.int64)
    blocks = topk.Blocks(np.arange(len(rows)), rows)
    got = blocks.top(np.array([0, 700]), rows[[0, 700]], 5)
    for own, best in zip((0, 700), got, strict=True):
        want = sorted((-int(rows[own] @ rows[j]), j) for j in range(len(rows)) if j != own)[:5]
        assert [(-s, j) for s, j in best] == want
    assert blocks.scored < 2 * len(rows) / 4


def test_topk_of_odd_vectors(spark):
    assert topk.quantise(np.array([1e307, -1e307, 0.5])).tolist() == [int(1e307) * 256, -int(1e307) * 256, 128]
    rows = [(0, [1.0, 0.5]), (50, [0.25]), (2, []), (3, [float("inf"), 0.0]), (4, [2.0, -1.0, 7.0]), (5, [float("-inf")]), (6, [1e6, 1e6]), (6, [1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df.where("vec_id % 50 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    big = 256 * 1_000_000
    assert sorted(got[0]) == [(1, 6, 256 * big + 128 * big), (2, 6, 256 * big + 128 * big), (3, 4, 256 * 512 - 128 * 256), (4, 50, 64 * 256), (5, 2, 0)]
    assert sorted(got[50]) == [(1, 6, 64 * big), (2, 6, 64 * big), (3, 4, 64 * 512), (4, 0, 64 * 256), (5, 2, 0)]


def _brute_classes(texts, weighted=True):
    sets = shingles([t or "" for t in texts])
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or minhash.similarity(sets[i], sets[j], weighted) >= 0.8):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(1000))
            texts.append(" ".join(copy))
    texts += ["", "", None, None, "!!", "?!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class_id", F.lit("x")).withColumn("digest", F.lit(0)).repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_classes(texts)
    stay = minhash.one_of_each(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(got.values()))


def test_near_duplicates_in_a_bucket_of_texts_just_under_the_bound(spark):
    texts = []
    for i in range(160):
        # All hold the same 222 words, and each 33 of its own: any two are at 0.74 to 0.8. The first two of every twenty are near copies.
        own = i - 1 if i % 20 == 1 else i
        texts.append(" ".join([*(f"t{j}" for j in range(222)), *(f"own{own}x{j}" for j in range(33))]) + (" last" if i != own else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert len(set(_brute_classes(texts))) == 152
    for weighted in (False, True):
        want = _brute_classes(texts, weighted)
        got = {r.doc_id: r.class_id for r in minhash.classes(df, k=2, rows=1, weighted=weighted).collect()}  # two large buckets: few leaders
        assert [got[i] for i in range(len(texts))] == want


def test_join_by_rare_shingles_gets_the_first_of_each_text_alone(spark, monkeypatch):
    texts = []
    for i in range(60):
        own = i - 1 if i % 20 == 1 else i
        texts.append(" ".join([*(f"t{j}" for j in range(222)), *(f"own{own}x{j}" for j in range(33))]) + (" last" if i != own else ""))
    sets = shingles(texts)
    want = {(i, j) for j in range(60) for i in range(j) if minhash.similarity(sets[i], sets[j], True) >= 0.8}
    rows, original = [], minhash.checkpointed

    def counted(table):
        out = original(table)
        if {"element", "node"} <= set(out.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(minhash, "checkpointed", counted)
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for bits in (20, 1):  # one bit: all shingles lie in two cells, and the order says next to nothing
        monkeypatch.setattr(minhash, "CELL_BITS", bits, raising=False)
        found = minhash._by_rare_shingles(held.select(F.lit(1).alias("bucket"), "node"), None, None, held, 0.8, 5, True)
        assert {(r.a, r.b) for r in found.collect()} == want and len(want) == 3
    assert rows and max(rows) < 0.22 * sum(int(n.sum()) for _, n in sets)


def test_join_by_rare_shingles_makes_rows_of_few_shingles_and_misses_no_pair(spark, monkeypatch):
    texts = []
    for i in range(200):
        own = i - 1 if i % 20 == 1 else i
        texts.append(" ".join([*(f"t{j}" for j in range(222)), *(f"own{own}x{j}" for j in range(33))]) + (" last" if i != own else ""))
    sets = shingles(texts)
    want = {(i, j) for j in range(200) for i in range(j) if minhash.similarity(sets[i], sets[j], True) >= 0.8}
    made, original = [], minhash.map_arrow

    def counted(table, function, schema):
        out = original(table, function, schema)
        if "element" in schema:
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "map_arrow", counted)
    monkeypatch.setattr(minhash, "SAMPLE", 0, raising=False)
    held = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for share in (8, 1000):  # of 200 texts a sample of 1 in 1000 is none, and the order says nothing
        monkeypatch.setattr(minhash, "SHARE", share, raising=False)
        made.clear()
        found = minhash._by_rare_shingles(held.select(F.lit(1).alias("bucket"), "node"), None, None, held, 0.8, 5, True)
        assert {(r.a, r.b) for r in found.collect()} == want and len(want) == 10
        assert sum(made) < 0.5 * sum(int(n.sum()) for _, n in sets)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = {(r.doc_id, r.class_id, r.class_size) for r in minhash.classes(odd).collect()}
    assert (7, 7, 2) in rows and (5, 5, 1) in rows and (None, 3, 2) in rows  # "x" and the line: 4 of 5 shingles
    assert minhash.one_of_each(odd).where("doc_id = 7").count() == 1
    assert minhash.classes(none).count() == 0 and minhash.one_of_each(none).count() == 0


def test_near_duplicates_keep_rows_without_ids_and_all_but_one_of_a_class(spark):
    texts = {"one": " ".join(f"a{i}" for i in range(40)), "two": " ".join(f"b{i}" for i in range(40)), "near": " ".join([*(f"b{i}" for i in range(40)), "more"]), "three": "short"}
    rows = [(None, texts["one"], 1), (None, texts["two"], 2), (None, texts["near"], 3), (None, texts["three"], 4), (5, texts["three"], 5), (5, texts["three"], 6), (None, None, 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    first = {r.n for r in minhash.one_of_each(df).collect()}
    assert {1, 7, 8} <= first and len(first & {2, 3}) == 1 and len(first & {5, 6}) == 1 and 4 not in first
    assert {r.n for r in minhash.one_of_each(df.repartition(3)).collect()} == first
    got = {r.n: (r.class_id, r.class_size) for r in minhash.classes(df).collect()}
    assert got[1] == (None, 1) and got[2] == got[3] == (None, 2) and got[4] == got[5] == (5, 3) and got[7] == (None, 1)


def test_links_of_a_large_group_are_few_and_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 30)
    monkeypatch.setattr(minhash, "PART", 50)
    tested = []
    original = minhash._tested
    monkeypatch.setattr(minhash, "_tested", lambda pairs, *a: tested.append(pairs.count()) or original(pairs, *a))
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"own{i}"]) for i in range(400)] + [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(300)], "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.classes(df).collect()}
    assert all(got[i] == (0, 700) for i in [*range(400), *range(1000, 1300)]) and all(got[i] == (i, 1) for i in range(400, 460))
    assert tested[0] < 460 and sum(tested) < 2 * 460


def test_repeated_shingles_weigh(spark):
    lines = " ".join(f"r{i}" for i in range(20))
    texts = [" ".join([lines] * 9), " ".join([lines] * 10), lines, " ".join([lines] * 9 + ["other words of its own that are few"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == dict(enumerate(_brute_classes(texts))) == {0: 0, 1: 0, 2: 2, 3: 0}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = minhash.signatures([(keys, a), (keys, b)], 2000, weighted=True)
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    plain = minhash.signatures([(keys[:300], a[:300]), (keys[100:], b[100:])], 2000)
    assert abs((plain[0] == plain[1]).mean() - 0.5) < 0.04
    assert (s != minhash.EMPTY).all()


def test_languages_of_held_out_texts(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = language.identify(docs, language.learn(docs)).where(language.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)


def test_languages_of_odd_rows(odd, none):
    made = language.learn(odd)
    assert set(made) <= {"en", "de"}
    rows = language.identify(odd, made).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" and r.rejected for r in rows if r.doc_id in (5, 6, 8))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(none, made).count() == 0 and language.learn(none) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


def test_short_clean_texts_are_not_rejected(spark):
    made = {"de": b"der die das und ist nicht ein eine " * 50, "en": b"the of and to in is that it was for " * 50}
    model = language.Classifier(made)
    for text in ("The.", "Das", "and", "x"):
        name, score, rejected = model.predict(text)
        assert name in made and 0 <= score <= 1 and not rejected
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(3000))
    assert model.predict(noise)[2] and not model.predict("the of and to in is that it was for " * 400)[2] and model.predict("12 !!") == ("und", 0.0, True)


def test_languages_by_a_slow_classifier(spark, sf):
    """The columns of the query, text by text."""
    from arrayloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.Classifier(language.learn(docs))
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        sizes = {}
        for name, coder in zip(model.names, model.coders, strict=True):
            raw = r.text.lower().encode()
            sizes[name] = sum(len(coder.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES))
        best, second = sorted(sizes.values())[:2]
        got = rows[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if any(map(str.isalpha, r.text)):
            assert got.lang_pred == min(n for n, s in sizes.items() if s == best) and abs(got.score - (second - best) / second) < 1e-12
        else:
            assert (got.lang_pred, got.score) == ("und", 0.0)


def test_held_out_is_the_checksum_rule(spark):
    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_audio_tables_and_blocks():
    # Fixed values of G.711.
    assert audio.TABLES["mulaw"][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]

    def slow(block):
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + int(audio.CHANGES[nibble & 7])))
                out.append(value)
        return out

    data = np.random.default_rng(8).integers(0, 256, 64 * 50, np.uint8).tobytes()
    assert audio.adpcm_decode(data).tolist() == [x for i in range(0, len(data), 64) for x in slow(data[i : i + 64])]
    for codec in audio.TAGS:
        sound = audio.parse(audio.wav(codec, data))
        assert (sound.codec, sound.data) == (codec, data)
    with pytest.raises(ValueError, match="WAV"):
        audio.parse(b"RIFFxxxx")
    flat = audio.doubled(np.full(50, 1000, np.int16))
    assert len(flat) == 100 and np.abs(flat - 1000).max() <= 2


def test_audio_of_odd_rows(odd, none):
    rows = audio.store(odd).select("doc_id", "n_bytes", "media", "payload", "feature", F.length("pcm").alias("p")).collect()
    for r in rows:
        assert len(r.payload) % 64 == 0 and r.payload and bytes(r.payload) == audio.parse(bytes(r.media)).data
    by = {r.doc_id: r for r in rows}
    assert by[5].n_bytes == by[6].n_bytes == 0 and by[5].feature == by[6].feature and bytes(by[5].payload) == b"\0" * 64
    assert by[7].n_bytes == 200_000 and audio.described(none).count() == 0


def test_audio_columns_by_brute_force(spark, monkeypatch):
    import hashlib

    texts = ["", None, "short", "é" * 500, "long text " * 3000] + [f"text number {i} " * (i + 1) for i in range(20)]
    rows = {r.doc_id: r for r in audio.described(_table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        codec = ["mulaw", "alaw", "adpcm"][zlib.crc32(payload) % 3]
        media = audio.wav(codec, payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = audio.decode(audio.parse(media)).astype(int).tolist()
        at = lambda j, x=x: x[min(max(j, 0), len(x) - 1)]
        pcm = []
        for j in range(len(x)):
            total = sum((at(j - k) + at(j + 1 + k)) * (w >> 2) for k, w in enumerate(audio.HALF_BAND.tolist()))
            pcm += [x[j], max(-32768, min(32767, (total + 4096) >> 13))]
        signs = [v < 0 for v in pcm]
        crc = zlib.crc32(np.array(pcm, "<i2").tobytes())
        assert r.feature == f"{codec}:{len(pcm)}:{int((sum(v * v for v in pcm) // len(pcm)) ** 0.5)}:{max(map(abs, pcm))}:{sum(a != b for a, b in zip(signs, signs[1:]))}:{crc}"
    sound = np.random.default_rng(1).integers(-32768, 32768, 5000).astype(np.int16)
    want = audio.doubled(sound), audio.features(sound)
    monkeypatch.setattr(audio, "BLOCK", 33)
    assert (audio.doubled(sound) == want[0]).all() and audio.features(sound) == want[1]


def test_mixing(odd, none, spark, sf):
    out = mixing.mix(odd).collect()
    assert all(r.taken <= 2 * r.size for r in out) and {r.taken for r in out if r.doc_id in (5, 6)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    by = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("own"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1 and r.target <= 2 * r.own + 1e-6 for r in by)
    assert abs(sum(r.target for r in by) - 1.5 * sum(r.own for r in by)) < 1e-3
    assert mixing.mixed(docs).count() == mixing.mix(docs).agg(F.sum("copies")).collect()[0][0]


def test_mixing_takes_documents_by_their_own_probabilities(spark, monkeypatch):
    # One source of six sizes; with half as many words as there are, the expected copies rise with the preference.
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.concat_ws(" ", F.array_repeat(F.lit("w"), F.pow(F.lit(4), F.col("id") % 6).cast("int"))).alias("text"))
    for share in (0.5, 1.3):
        rows = mixing.decide(df, share=share).collect()
        by = {}
        for r in rows:
            by.setdefault(r.size, []).append(r.copies)
        grades = {size: 4 + len(bin(size)) - 2 for size in by}
        total = sum(size * len(c) for size, c in by.items())
        low, high = 0.0, 1.0
        for _ in range(80):
            level = (low + high) / 2
            low, high = (level, high) if sum(size * len(c) * min(2, level * grades[size]) for size, c in by.items()) < share * total else (low, level)
        assert abs(sum(r.taken for r in rows) - share * total) <= max(by) / 2 + 1e-6
        for size, c in by.items():
            want = min(2.0, low * grades[size])
            assert set(c) <= {int(want), min(2, int(want) + 1)} and abs(sum(c) / len(c) - want) < 0.06
    # A table of sources too long to be broadcast gives the same.
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted((r.doc_id, r.taken) for r in mixing.decide(df, share=1.3).collect()) == sorted((r.doc_id, r.taken) for r in rows)
    with pytest.raises(ValueError, match="whole number"):
        mixing.mix(df, most=1.5)


def test_mixing_gives_one_row_a_document_whatever_is_null(odd, spark):
    narrow = mixing.decide(odd).collect()
    assert len(narrow) == odd.count() and {r.taken for r in narrow if r.doc_id in (5, 6)} == {0}
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "x", None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.source_size, r.taken) for r in mixing.decide(empty).collect()}
    assert got[1] == (0, 0, 0) and got[2] == (0, 0, 0) and got[None][:2] == (2, 3) and got[3][:2] == (1, 3)


def _table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _brute_log_probability(text, known, net, counts):
    """Summed over the words, one by one. counts: of words in all other texts."""
    ids, total = lm.numbered([text], known)[0].astype(int), 0.0
    for i, (word, t) in enumerate(zip(text.lower().split(), ids, strict=True)):
        near = [ids[i + o] if 0 <= i + o < len(ids) else 0 for o in (-2, -1, 1, 2)]
        h = np.tanh(net.bias + sum(net.inner[c][x] for c, x in enumerate(near))).astype(np.float64)
        z, own = h @ net.upper + net.level, known.classes[t - 1]
        total += z[own] - np.log(np.exp(z).sum())
        total += np.log((known.totals[t - 1] + 0.5) / sum(n + 0.5 for n, k in zip(known.totals, known.classes, strict=True) if k == own))
        if t > known.common:
            total += np.log((counts.get(word, 0) + lm.ALONE) / (known.totals[t - 1] + 1))
    return total


def test_pseudo_likelihood_by_brute_force(spark, odd, none):
    texts = ["the cat sat on the mat and the dog sat too", "one", "", "a b c d e f g a b c", "the cat sat on rare rarer words", "rare words of the mat", "one"]
    df = _table(spark, texts)
    known, net = lm.fit(df, common=6)
    rows = {r.doc_id: r for r in lm.score(df, (known, net)).collect()}
    for i, text in enumerate(texts):
        counts = {}
        for w in " ".join(texts[:i] + texts[i + 1 :]).split():
            counts[w] = counts.get(w, 0) + 1
        want = _brute_log_probability(text, known, net, counts)
        assert rows[i].n_tokens == len(text.split()) and abs(rows[i].log_prob - want) < 2e-3
    rows = {r.doc_id: r for r in lm.score(odd, lm.fit(odd)).collect()}
    assert rows[5].n_tokens == rows[6].n_tokens == 0 and rows[5].mean_log_prob is None and rows[7].n_tokens == 40_000 and rows[7].log_prob < 0
    assert lm.score(none, lm.fit(none)).count() == 0


def test_scores_do_not_depend_on_how_files_are_split(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 7):
        own = docs.repartition(n, "doc_id")
        model = lm.fit(own, shard_tokens=5_000)
        got.append([tuple(r) for r in lm.score(own, model).select("doc_id", "n_tokens", "log_prob").orderBy("doc_id").collect()])
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(*got, strict=True))


def test_network_beats_word_counts_on_texts_it_has_not_seen(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    known, net = lm.fit(docs.where("doc_id % 5 <> 0"))
    texts = [r.text for r in docs.where("doc_id % 5 = 0").collect()]
    place = lm.windows(lm.numbered(texts, known))
    leaves = known.totals + 0.5
    alone = np.log(leaves / leaves.sum())[place[0][place[1]] - 1].mean()  # what counts of words say without a window
    assert abs(lm.log_probabilities(lm.Net.start(known.mass), known, *place).mean() - alone) < 0.01
    assert lm.log_probabilities(net, known, *place).mean() > alone + 0.1


def test_texts_that_come_twice_are_told_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    own = [" ".join("".join(rng.choice("bcdfgaeiou") for _ in range(8)) for _ in range(40)) for _ in range(40)]
    made = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(own)] + [(20_000 + i, t) for i, t in enumerate(own[:20])], "doc_id long, text string")
    every = docs.union(made)
    rows = lm.score(every, lm.fit(every, common=500)).where("doc_id >= 10000").collect()
    once = [r for r in rows if 10_020 <= r.doc_id < 20_000]
    twice = [r for r in rows if not 10_020 <= r.doc_id < 20_000]
    assert len(once) == 20 and len(twice) == 40 and min(r.mean_log_prob for r in twice) > max(r.mean_log_prob for r in once) + 1
    assert all(r.n_alone == 40 for r in once) and all(r.n_alone == 0 for r in twice)


def test_training_takes_every_position_of_whole_texts(spark):
    import hashlib

    texts = ["one two three four five six seven " * 5 + f"tail{i}" for i in range(6)] + ["long words " * 2500 + "the end of a long text"]
    known, net = lm.fit(_table(spark, texts))
    ordered = sorted(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = lm.train(lm.Net.start(known.mass), known.classes, *lm.windows(lm.numbered(ordered, known)))
    for got, part in zip(net, want, strict=True):
        assert np.allclose(got, part, atol=1e-5)


def test_training_lowers_the_loss():
    ids = np.tile(np.arange(1, 9, dtype=np.int16), 4000)
    place = lm.windows([ids])
    totals = np.bincount(ids - 1, minlength=lm.LEAVES).astype(float)
    known = lm.Vocabulary(np.zeros(0, lm.U), np.zeros(0, np.int16), totals, 0, np.arange(lm.LEAVES) % lm.CLASSES)
    fresh = lm.Net.start(known.mass)
    after = lm.train(fresh, known.classes, *place)
    assert lm.log_probabilities(after, known, *place).mean() > lm.log_probabilities(fresh, known, *place).mean() + 0.5


def test_classes_hold_leaves_of_like_neighbours():
    beside = np.zeros((lm.LEAVES, 2 * lm.BESIDE))
    beside[np.arange(lm.LEAVES), np.arange(lm.LEAVES) % 7] = 50
    made = lm.classed(beside, np.ones(lm.LEAVES))
    assert all(len(set(made[i::7])) == 1 for i in range(7)) and len(set(made)) == 7


def test_licences(odd, none, spark):
    known = {}
    for name, text in licences.KNOWN:
        known.setdefault(name, text)
    mit, bsd = known["MIT"], known["BSD-3-Clause"]
    wrapped = "\n".join("# " + line for line in textwrap.fill(mit, 60).split("\n"))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE")), (2, "text\nReleased under the  MIT licence\nmore"), (3, mit + " and more"), (4, None),
        (5, "Copyright 1999 The Owners. All rights reserved.\n" + bsd.replace("the copyright holder nor", "the University nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "REGENTS OR").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        (6, f"a file\n\n{wrapped}\n\ncode 1\n{bsd}\nmore code"), (7, "This project is distributed under CC BY-SA 4.0\nApache"), (8, mit.replace("any person", "some persons")), (9, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(0)).withColumn("licence", F.lit(0))
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(df).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: (None, "MIT"), 4: (None, None), 5: ("BSD-3-Clause", "BSD-3-Clause"), 6: (None, "BSD-3-Clause,MIT"), 7: (None, "CC-BY-SA-4.0"), 8: (None, None), 9: (None, None)}
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0
    own = licences.known_digests(spark, [("own", "No word here is a usual one"), ("empty", "...")])
    mine = spark.createDataFrame([(1, "x\nno word HERE is a\nusual one\ny"), (2, "!!")], "doc_id long, text string")
    assert {r.doc_id: (r.licence, r.notices) for r in licences.scan(mine, own).collect()} == {1: (None, "own"), 2: ("empty", None)}
    plan = licences.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_licences_are_found(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.exists(f"{folder}/GPL-3"):
        pytest.skip("no licence files on this machine")
    read = lambda name: open(f"{folder}/{name}", encoding="utf-8").read()  # noqa: E731, SIM115
    rows = [(0, read("GPL-3")), (1, "about\n\n" + read("Apache-2.0").upper() + "\n\nmore"), (2, read("MPL-2.0").replace("\n", " \n  ")), (3, read("GPL-2")[:5000])]
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0][0] == "GPL-3.0" and got[1][0] is None and "Apache-2.0" in got[1][1].split(",") and got[2][0] == "MPL-2.0" and got[3][0] is None


def test_pieces_like_the_library():
    import sentencepiece

    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    rng = random.Random(4)
    parts = ["a", "b", " ", "   ", "aaaa", " the", "\n", "é", "😀", "\t", "漢", "====", "1", "http", "//", "ing", "er", "s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(3000)]
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    for text, ids, (got, back) in zip(texts, want, pieces.round_trip(texts, model), strict=True):
        assert got == ids and back == text


def _small_model(kind, entries, dummy=True, strip=False, table=b"", fallback=False):
    """A model of so many (piece, score), with bytes as pieces if asked for."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256 if fallback else 0)), *((p, s, 1) for p, s in entries)]
    for piece, score, kind_ in own:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind_
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = kind, fallback, len(own)
    n = m.normalizer_spec
    n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, n.precompiled_charsmap = dummy, strip, True, table
    return m.SerializeToString()


def test_shortest_path_by_trying_all_paths():
    rng = random.Random(11)
    for _ in range(30):
        entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.randrange(100, 1000) / 64 for _ in range(8)}
        machine = pieces.Transducer(_small_model(1, entries.items(), dummy=False, fallback=True))

        def paths(text):
            if not text:
                yield 0.0, []
            for n in range(1, len(text) + 1):
                cost = machine.cost.get(text[:n], machine.worst if n == 1 else None)
                if cost is not None:
                    yield from ((cost + c, [text[:n], *rest]) for c, rest in paths(text[n:]))

        for _ in range(10):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8)))
            got = [machine.names[p] for p in next(machine.shortest([text]))]
            assert "".join(got) == text
            want = sum(machine.cost.get(p, machine.worst) for p in got)
            assert abs(want - min(c for c, _ in paths(text))) < 1e-9


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("strip", [False, True])
def test_small_models_like_the_library(kind, fallback, strip):
    import sentencepiece

    table = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(table.serialized_model_proto())
    entries = [("▁", -3.0), ("a", -2.25), ("b", -2.5), ("ab", -3.125), ("▁a", -4.0), ("▁ab", -4.75), ("abb", -6.5), ("ba", -4.25), ("f", -5.0), ("i", -5.5), ("fi", -7.0), ("1", -6.0), ("/", -6.25), ("2", -6.75)]
    rng = random.Random(kind)
    for chars in (b"", spec.normalizer_spec.precompiled_charsmap):
        model = _small_model(kind, entries, strip=strip, table=chars, fallback=fallback)
        parts = ["a", "b", "ab", " ", "  ", "ﬁ", "½", "Ａ", "é", "é", "\t", "　", "x", "漢", "가"]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
        want = sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)
        got = [np.frombuffer(e, "<i4").tolist() for e in pieces.Transducer(model).encode(texts)]
        assert got == want


def test_pieces_through_spark_like_the_library(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.decode(pieces.encode(docs)).select("text", "tokens", "n_tokens", "decoded").collect()
    assert [r.tokens for r in rows] == library.encode([r.text for r in rows])
    assert all(r.decoded == r.text and r.n_tokens == len(r.tokens) for r in rows)


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        machine = pieces.Transducer(f.read())
    texts = [f"word{i} {'long' * 50}{i}" for i in range(500)]
    want = machine.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 5000)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 20)
    machine.known.clear(), machine.borders.clear()
    assert machine.encode(texts) == want and len(machine.borders) <= 20


def test_pieces_of_odd_rows(odd, none):
    out = pieces.decode(pieces.encode(odd))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[5].tokens is None and rows[5].n_tokens == 0 and rows[6].tokens == [] and rows[7].n_tokens > 30_000
    assert out.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and pieces.encode(none).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.ORG/es/x", "http://a.example.org/en/12?q=/fr/", "http://example.org", "http://example.org#x/", "https://x.com/fr/1", "https://x.com/de/1#a", "https://xcom/fr/", "http://b.net/de/", "http://org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5] == ("example.org", "", None, "allow") and got[6][1] == "" and got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block")
    assert got[9][2] is None and got[10][2] is None and got[11][2:] == ("org/", "allow")
    parts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, part_bytes=30).collect()}
    assert parts == got and url_filter.judge(df.limit(0)).count() == 0


def test_urls_of_repeated_and_long_rows(spark):
    long = "http://" + "a." * 500 + "example.org/es/" + "x" * 100_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://com/de/"), (2, "http://com/de/")], "page_id long, url string")
    rows = url_filter.judge(df).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in rows) == [(1, "example.org/es/", "block")] * 2 + [(2, "com/de/", "block")] * 2
    other = url_filter.judge(df, rules=[("allow", "com", "/de/")]).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in other) == [(1, None, "allow")] * 2 + [(2, "com/de/", "allow")] * 2


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda strings: np.array([len(s) for s in strings], "<u8"))
    found = url_filter.DigestArray.mapped(url_filter.DigestArray.build([("aa", 1), ("bb", 0), ("cc", 1)]))
    assert found.probe(["bb", "cc", "dd", "a"]).tolist() == [0, 1, -1, -1]


def test_pipeline(spark, sf, odd):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in p.STAGES[:-1]:
        before, out = out, stage(spark, out, sf)
        assert out.columns == docs.columns, name
        if name == "language ID":
            assert out.count() >= 0.98 * before.count()
    last = p.run(spark, sf)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "tokens"] and last.count() == out.count()
    narrow = odd.select(*docs.columns)
    for _, stage in p.STAGES:
        narrow = stage(spark, narrow, sf)
    assert narrow.count() > 0


def _brute_lines(rows):
    """{id: (number of lines, number dropped, kept text)}, line by line."""
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = {}
    for i, text in rows:
        for line in text.split("\n"):
            if len(key := line.strip(strip).translate(low)) >= 20:
                held.setdefault(key, set()).add(i)
    out = {}
    for i, text in rows:
        lines = text.split("\n")
        keep = [x for x in lines if not (len(ids := held.get(x.strip(strip).translate(low), ())) >= 3 and i < max(ids))]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def _brute_copies(rows):
    """{id: copies} of (id, text, source), by sorting every source whole."""
    import hashlib
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    totals = {}
    for i, _, s in rows:
        totals[s] = totals.get(s, 0) + size[i]
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(totals))}
    targets, left, budget = {}, set(totals), 1.5 * sum(totals.values())
    while left:
        level = (budget - sum(targets.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] >= 2 * totals[s]]
        targets.update({s: 2.0 * totals[s] for s in over} if over else {s: level * weights[s] for s in left})
        left -= set(over) if over else set(left)
    copies = {}
    for s, target in targets.items():
        own = [(i, t) for i, t, of in rows if of == s]
        grade = {i: 4 + size[i].bit_length() for i, _ in own}
        low, high = 0.0, 1.0 if target < 2 * totals[s] else 2.0
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(size[i] * min(2, level * grade[i]) for i, _ in own if size[i]) < target else (low, level)
        times = {i: min(2.0, high * grade[i]) if size[i] else 0.0 for i, _ in own}
        copies.update({i: int(x) for i, x in times.items()})
        need, ranked = target - sum(size[i] * int(x) for i, x in times.items()), []
        for i, t in own:
            p = times[i] - int(times[i])
            if p > 1e-12:
                u = (int(hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
                ranked.append(((u / (1 - u)) / (p / (1 - p)), i))
        spent = 0
        for _, i in sorted(ranked):
            if spent + size[i] / 2 <= need:
                copies[i] += 1
            spent += size[i]
    return copies


def test_pipeline_by_brute_force(spark, sf):
    import corpus_pipeline as p
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = language.Classifier(language.learn(docs))
    rows = [r for r in rows if not model.predict(r[1])[2]]
    lines = _brute_lines([(i, t) for i, t, _ in rows])
    rows = sorted((i, lines[i][2], s) for i, _, s in rows)
    roots = _brute_classes([t for _, t, _ in rows])
    rows = [r for n, r in enumerate(rows) if roots[n] == n]
    copies = _brute_copies(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((i, s, library.encode(t)) for i, t, s in rows for _ in range(copies[i]))
    got = sorted((r.doc_id, r.source, list(r.tokens)) for r in p.run(spark, sf).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want


def test_hot_lines_are_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 10)
    line = "the same line in every one of the documents"
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\nown line of document number "), F.col("id").cast("string")).alias("text"))
    rows = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(df).collect()}
    assert rows == {i: (int(i < 99), (line + "\n" if i == 99 else "") + f"own line of document number {i}") for i in range(100)}
