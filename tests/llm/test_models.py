"""Nearest neighbours, token files, packing, language ID, SentencePiece and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from geoweave.llm import codec, hnsw, language, packing, pii, quality, queries, sentencepiece, sentences, simhash, token_files, tokens
from tests.llm.conftest import ODD
from tests.llm.test_texts import slow_dedup, texts

# -- Nearest neighbours.


def exact(ids, vectors, query, k):
    scores = vectors.astype(float) @ vectors[query].astype(float)
    scores[ids == ids[query]] = -np.inf
    return ids[np.lexsort((ids, -scores))[:k]]


def test_search_query_recall_and_scores(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    place = {v: i for i, v in enumerate(ids.tolist())}
    got = {}
    for r in queries.op1_hnsw(spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    asked = [v for v in ids.tolist() if v % 20 == 0]
    assert sorted(got) == asked
    hits = total = 0
    for q in asked:
        found = got[q]
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and q not in [r.vec_id for r in found]
        for r in found:
            assert r.score == pytest.approx(vectors[place[r.vec_id]] @ vectors[place[q]], rel=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        want = exact(ids, vectors, place[q], 20)
        hits += len(set(want.tolist()) & {r.vec_id for r in found})
        total += len(want)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("scaled", [False, True])
def test_shards_find_clusters_and_lengths(spark, scaled):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 24))
    x = np.concatenate([centres[rng.integers(0, 6, 700)] + 0.05 * rng.normal(size=(700, 24)), rng.normal(size=(800, 24))]).astype(np.float32)
    if scaled:
        x *= rng.uniform(0.2, 3, (len(x), 1)).astype(np.float32)
    x[100:140] = x[100]  # one very common vector
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    rows = hnsw.nearest(df, df.where("vec_id % 30 = 0"), 10, shard=400).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(round(r.score, 9))
    good = total = 0
    for q in range(0, len(x), 30):
        scores = np.sort(np.delete(x.astype(float) @ x[q].astype(float), q))[::-1][:10]
        good += sum(round(s, 9) in got[q] or s >= min(got[q]) for s in scores)
        total += 10
    assert good >= 0.9 * total and len(rows) == 10 * len(range(0, len(x), 30))


def test_recall_over_many_shards_with_a_small_beam(spark):
    """Twelve shards of about 500 points, a beam of 32, and a third of the rows copies of one vector."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    x[::3] = x[0]
    ids = rng.permutation(100_000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    asked = np.arange(1, len(x), 45)
    index = hnsw.build(df, shard=500)
    assert index.count() >= 12
    rows = hnsw.search(index, df.where(F.col("vec_id").isin(ids[asked].tolist())), 20, beam=32).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in asked:
        scores = np.einsum("nd,d->n", x.astype(np.float64), x[q].astype(np.float64))
        scores[q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        hits += len(set(want.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(asked)


def test_copies_come_by_id_and_scores_are_doubles(spark):
    rows = [(i, [0.1, 0.2 + 1e-12]) for i in range(300, 0, -1)] + [(1000, [0.3, 1 / 3]), (1001, [1e-60, 1e-60]), (1002, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, df.where("vec_id IN (7, 1000)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got[:20]] == [1002, 1000, *range(1, 7), *range(8, 20)]
    assert [r.vec_id for r in got[20:]] == [1002, *range(1, 20)]
    assert got[21].score == 0.3 * 0.1 + (1 / 3) * (0.2 + 1e-12)


def test_insertion_costs_less_than_all_pairs():
    """Points compared with each other while a graph is built: a small part of all pairs, and ever less of them."""
    rng = np.random.default_rng(3)
    shares = []
    for n in (2000, 8000):
        x = rng.normal(size=(n, 8))
        graph = hnsw.Graph.build(np.arange(n), np.ones(n, np.int64), x)
        assert all((m >= 0).any(axis=1).all() for m in graph.neighbours if len(m) > 1) and len(graph.members[0]) == n
        compared = 0
        walk = hnsw._walk

        def counted(vectors, q, entry, row_of, near, beam):
            nonlocal compared
            found = walk(vectors, q, entry, row_of, near, beam)
            compared += found.size * near.shape[1]
            return found

        hnsw._walk, before = counted, walk
        try:
            graph.search(x[:50], 64)
        finally:
            hnsw._walk = before
        shares.append(compared / 50 / n)
    assert shares[1] < 0.6 * shares[0]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 2.0, 3.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, shard string, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(df, df.where("vec_id IN (2, 3, 10, 20)")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 8, 1.0), (20, 3, 9, 1.0)]
    none = df.where("vec_id = 77")
    assert hnsw.nearest(none, none).count() == 0 and hnsw.nearest(df, none).count() == 0


# -- Tokens and files.


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_words_encode_as_whole_texts(spark, data):
    t, w = tokenizer(), tokens.WordTokenizer(tokens.tokenizer_path(), 500)
    rng = random.Random(3)
    alphabet = ["the", "The", " ", "  ", "\n", ",", ".", "'s", "don't", "é", "É", "ß", "İ", "Å", "1", "23", "%", "<|endoftext|>", "<|", "漢", "x́", "H̱", " ", "\x1c", "ª", "µ", "K"]
    sample = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [t or "" for _, t, *_ in ODD if len(t or "") < 1000] + list(texts(spark, data).values())[:60]
    got = w.encode([s.encode() for s in sample])
    for s, ids in zip(sample, got):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000, 40000):
        docs = [rng.zipf(1.4, size=k).clip(0, 2**32 - 1).astype("<u4").tobytes() for k in rng.multinomial(n, [0.2] * 5)]
        ids = [3, None, -1, 2**60, 0]
        frame = codec.encode_frame(ids, docs, 512)
        assert codec.decode_frame(frame) == (ids, docs)
    same = [np.zeros(50000, "<u4").tobytes(), np.tile(np.array([5, 6, 7], "<u4"), 9000).tobytes()]
    frame = codec.encode_frame([1, 2], same)
    assert codec.decode_frame(frame) == ([1, 2], same) and len(frame) < 0.02 * sum(map(len, same))
    for at in (2, 10, 30, 60, len(frame) - 3):
        with pytest.raises(ValueError):
            codec.decode_frame(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])


def test_blocks_of_odd_ids_round_trip():
    rng = np.random.default_rng(1)
    cases = [
        ([np.full(5000, 2**32 - 1)], {}),
        ([rng.integers(0, 2**32, 5000)], {}),
        ([rng.integers(0, 49408, 60000)], {}),
        ([rng.zipf(1.2, 90000) % 3000000], {}),
        ([np.arange(70000)], {}),
        ([np.r_[np.zeros(50000, int), np.arange(50000)]], {}),
        ([rng.integers(0, 10, 3000)], {"block": 7}),
        ([np.zeros(300, int)], {"block": 1}),
        ([rng.integers(0, 300, 40000)], {"classes": 200}),
        ([rng.integers(0, 300, 40000)], {"classes": 1, "slots": 1}),
    ]
    for docs, options in cases:
        docs = [np.asarray(d, "<u4").tobytes() for d in docs]
        assert codec.decode_frame(codec.encode_frame([1], docs, **options)) == ([1], docs)


def test_blocks_mix_three_orders(data):
    """Bits an id on the real ids of a scale ten times the other tests', tables and all, against the entropy of order 0 (8.4)
    and zstandard's highest ordinary level on the same ids as 16-bit numbers."""
    import pyarrow.parquet as pq

    folder = data.replace("sf0.001", "sf0.01")
    words = tokens.word_tokenizer(tokens.tokenizer_path())
    docs = [c + b"\1\0\0\0" for c in words.encode(pq.read_table(f"{folder}/documents.parquet").sort_by("doc_id").column("text").combine_chunks())]
    ids = np.frombuffer(b"".join(docs), "<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum()

    def bits(**options):
        frame = codec.encode_frame(range(len(docs)), docs, **options)
        assert codec.decode_frame(frame)[1] == docs
        return 8 * len(frame) / len(ids)

    mixed = bits()
    if len(ids) > 500_000:  # a frame of some size: its tables pay
        assert mixed < entropy - 1.2
        assert bits(slots=1) > mixed + 0.1 and bits(classes=1) > mixed + 1
        ids_alone = codec.encode_frame([0], [b"".join(docs)])
        assert len(ids_alone) < len(zstandard.ZstdCompressor(level=19).compress(ids.astype("<u2").tobytes()))


def test_an_id_has_the_sum_of_what_the_orders_give():
    """Every rank's interval in the mixture, on the way through a block: none overlap, they fill the total, and each is
    as long as the shares times the orders' own frequencies; the decoder's bisection finds each from both its ends."""
    rng = np.random.default_rng(5)
    ranks = rng.zipf(1.5, 4000).clip(1, 40).astype(np.uint32) - 1
    values = np.unique(ranks, return_inverse=True)[1].astype(np.uint32)
    tables = codec.Tables.of(values, 1000, int(values.max()) + 1, 4)
    n = len(tables.counts)
    whole = 1 << tables.bits
    zero = np.diff(tables.zero[: n + 1])
    assert zero.sum() == whole and zero.min() >= 1
    model = codec._Model(1, tables, 64)
    for step in range(300):
        model.predict()
        one = np.diff(tables.one[int(model.behind[0]) : int(model.behind[0]) + n + 1])
        at = 0
        for r in range(n):
            start, size = model.interval(np.array([r]))
            assert (start[0], size[0]) == (at, model.one[0] * one[r] + model.zero[0] * zero[r] + model.two[0] * (model.guess[0] == r))
            assert model.find(start)[0] == r == model.find(start + size - 1)[0]
            at += int(size[0])
        assert at == 1 << codec._TOTAL
        rank = values[step : step + 1].astype(np.int64)
        model.interval(rank)
        model.learn(rank)


def test_models_pass_over_narrow_numbers_and_rare_ids_round_trip():
    """Most of a frame's time is passes over its blocks, so intervals have 32 bits and shares single precision; ids that
    no order expects take more than one word at a step, on some blocks only."""
    ids = np.zeros(400_000, np.uint32)
    ids[777::40_009] = np.arange(10) + 1
    frame = codec.encode_frame([1], [ids.astype("<u4").tobytes()])
    assert codec.decode_frame(frame) == ([1], [ids.astype("<u4").tobytes()]) and len(frame) < 3000
    model = codec._Model(4, codec.Tables.of(ids[:4096], 1024, 11, 1), 64)
    model.predict()
    rank = np.arange(4)
    start, size = model.interval(rank)
    model.learn(rank)
    assert start.dtype == size.dtype == np.int32 and model.pooled.dtype == model.of_one.dtype == np.float32 and model.states.itemsize == 4


def whole_ids(docs, end):
    t = tokenizer()
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, end] for d, x in docs.items()}


def test_token_file_query(spark, data):
    ids = whole_ids(texts(spark, data), 1)
    start = 0
    rows = queries.op3_token_files(spark, data).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(ids)
    for r in rows:
        v = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(v), zlib.crc32(np.array(v, "<u4").tobytes()))
        start += len(v)


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(odd, path, frame_ids=4000, block=256)
    rows = token_files.decode(token_files.read(spark, path)).collect()
    t = tokenizer()
    want = sorted(((d is not None, d or 0, x or "") for d, x, *_ in ODD))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    by = {}
    for a, b, ids in got:
        by.setdefault((a, b), []).append(np.frombuffer(ids, "<u4").tolist())
    for a, b, x in want:
        if len(x) < 1000:
            assert [*t.encode(x, add_special_tokens=False).ids, 1] in by[(a, b)]
    summary = token_files.round_trip(odd, frame_ids=4000).collect()
    assert len(summary) == len(ODD) and sorted(r.start for r in summary) == [0, *np.cumsum([r.n_tokens for r in sorted(summary, key=lambda r: r.start)])[:-1].tolist()]
    assert token_files.round_trip(empty).count() == 0


# -- Packing.


def check_packing(rows, ids, capacity=2048):
    total = 0
    bins = {}
    for r in rows:
        v = ids[r.doc_id][r.start : r.start + capacity]
        assert (r.length, r.start, r.ids_crc32) == (len(v), capacity * r.piece, zlib.crc32(np.array(v, "<u4").tobytes()))
        total += len(v)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        at = 0
        for offset, length in b:
            assert offset == at
            at += length
        assert at <= capacity
    return total, len(bins)


def test_packing_query(spark, data):
    ids = whole_ids(texts(spark, data), 0)
    total, bins = check_packing(queries.op4_packing(spark, data).collect(), ids)
    assert total == sum(map(len, ids.values())) and bins <= 1.02 * total / 2048 + 1


def open_lots(n, count):
    """Lots that fill whole bins exactly, cut at random: best-fit needs a bin more in most."""
    for seed in range(count):
        rng = random.Random(seed)
        sizes = []
        for _ in range(n):
            a, b = sorted(rng.sample(range(1, 2048), 2))
            sizes += [a, b - a, 2048 - b]
        rng.shuffle(sizes)
        sizes[-1] = max(1, sizes[-1] - 300)  # some room, or only a perfect packing would do
        yield sizes


def test_genetic_search_beats_best_fit():
    """With the defaults that ship."""
    saved = 0
    for sizes in open_lots(40, 5):
        first = packing.best_fit(packing.falling(range(len(sizes)), sizes), sizes, 2048)
        best, made = packing.search(sizes, 2048)
        assert sorted(p for b in best for p in b) == list(range(len(sizes))) and all(sum(sizes[p] for p in b) <= 2048 for b in best)
        assert len(best) <= len(first) and (made > 0) == (len(first) > packing.lower_bound(sizes, 2048))
        saved += len(first) - len(best)
    assert saved >= 3


def test_the_query_path_saves_bins(spark):
    """The tables' path, with the defaults that ship: all lots at once, bins saved and crossovers reported."""
    lots = list(open_lots(40, 6))
    rows = [(lot, lot * 1000 + k, n) for lot, sizes in enumerate(lots) for k, n in enumerate(sizes)]
    placed, report = packing._solve(spark.createDataFrame(rows, "lot long, key long, length long"), 2048, "test", packing.EPOCHS, packing.ISLANDS)
    used = {(r.lot, r.bin) for r in placed.collect()}
    first = sum(len(packing.best_fit(packing.falling(range(len(s)), s), s, 2048)) for s in lots)
    made = report.collect()
    assert made and all(r.crossovers > 0 and r.bins <= r.start_bins for r in made)
    assert first - len(used) == sum(r.start_bins - r.bins for r in made) >= 3


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300).tolist()
    a, b = packing.best_fit(range(300), sizes, 128), packing.best_fit(range(299, -1, -1), sizes, 128)
    for _ in range(20):
        c = packing.crossover(a, b, sizes, 128, rng)
        assert sorted(p for x in c for p in x) == list(range(300)) and all(sum(sizes[p] for p in x) <= 128 for x in c)
        a = c


def test_packing_of_odd_rows_and_many_lots(spark, odd, empty):
    rows = packing.best_fit_packing(odd).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD) and packing.best_fit_packing(empty).count() == 0
    made = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 7919 % 90 + 10).alias("length"))
    packed = packing.pack(made, 128, lot=500).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(packed) == 3000 and all(sum(n for _, n in b) <= 128 for b in bins.values())
    assert len(bins) <= 1.05 * sum(r.length for r in packed) / 128


# -- Language.


def test_language_query_on_held_out_documents(spark, data):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_language(spark, data).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_held_out_labels_have_no_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language._held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(wrong).collect()}
    assert a == b


def test_grams_do_not_depend_on_parts(monkeypatch):
    text = "Ünd so weiter, 123 und so  fort.\n" * 20
    whole = np.concatenate(list(language.grams(text)))
    monkeypatch.setattr(language, "_STEP", 37)
    parts = np.concatenate(list(language.grams(text)))
    assert sorted(whole.tolist()) == sorted(parts.tolist())
    assert not list(language.grams("12 34 --")) and not list(language.grams(None))


def test_languages_of_odd_rows(odd, empty):
    rows = language.languages(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.languages(empty).count() == 0
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.languages(nothing).collect()} == {"und"}


def plain_grams(text):
    """Hashed n-grams by a loop over characters."""
    m = 0xFFFFFFFF
    codes = [32]
    for ch in text.lower():
        code = ord(ch) if ch.isalpha() else 32
        if code != 32 or codes[-1] != 32:
            codes.append(code)
    if codes[-1] != 32:
        codes.append(32)
    out = []
    if len(codes) > 1:
        first = [c * 0x9E3779B1 & m for c in codes]
        second = [first[i] ^ (codes[i - 1] * 0x85EBCA77 + 1 & m) for i in range(1, len(codes))]
        third = [second[i] ^ (codes[i - 1] * 0xC2B2AE3D + 2 & m) for i in range(1, len(second))]
        out = [((x ^ x >> 15) * 0x2C1B3C6D & m) >> 16 for x in [*first[1:], *second, *third]]
    return sorted(out)


def test_grams_equal_a_plain_loop():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abÉß漢 .1\n") for _ in range(rng.randint(0, 30)))
        got = sorted(np.concatenate([*language.grams(text), np.empty(0, np.uint32)]).astype(int).tolist())
        assert got == plain_grams(text), repr(text)


def test_a_learning_step_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    model = language.Ftrl(6, 3, alpha=0.4, beta=0.7, l1=0.05, l2=0.2)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    for _ in range(60):
        at, values, label = rng.choice(6, 3, replace=False), rng.normal(size=3), int(rng.integers(3))
        model.step(at, values, label)
        w = {i: [0.0 if abs(z[i][k]) <= 0.05 else -(z[i][k] - math.copysign(0.05, z[i][k])) / ((0.7 + math.sqrt(n[i][k])) / 0.4 + 0.2) for k in range(3)] for i in at}
        score = [sum(v * w[i][k] for i, v in zip(at, values)) for k in range(3)]
        p = [math.exp(s - max(score)) for s in score]
        for k in range(3):
            error = p[k] / sum(p) - (k == label)
            for i, v in zip(at, values):
                g = v * error
                sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / 0.4
                z[i][k] += g - sigma * w[i][k]
                n[i][k] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    model = language.Ftrl(50, 2, alpha=0.5, l1=0.5)
    for _ in range(400):
        label = int(rng.integers(2))
        at = np.array([label, *rng.choice(np.arange(2, 50), 3, replace=False)])
        model.step(at, np.ones(4), label)
    w = model.weights()
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[2:] == 0).mean() > 0.3


# -- SentencePiece.


def test_pieces_equal_the_library(spark, data):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    pieces = sentencepiece.Pieces(sentencepiece.model_path(), 300)
    rng = random.Random(5)
    sample = ["".join(rng.choice("aabbcdeE  \n\t.,éß漢😀<s>0x▁") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + list(texts(spark, data).values())[:80] + [t or "" for _, t, *_ in ODD if len(t or "") < 1000]
    for text, ids in zip(sample, pieces.encode(sample)):
        assert memoryview(ids).cast("I").tolist() == model.encode(text), text
        assert pieces.decode(ids) == text.replace("▁", " ")


def test_unigram_paths_have_the_greatest_score():
    """The same pass over a unigram model's scores, against all paths of a word by plain dynamic programming."""
    pieces = sentencepiece.Pieces(sentencepiece.model_path(), kind="unigram")
    rng = random.Random(8)
    words = {"▁" + "".join(rng.choice("aeinrst漢é") for _ in range(rng.randint(1, 12))) for _ in range(400)}
    for word in words:
        best = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                if part in pieces.scores or end - start == 1:
                    best[end] = max(best[end], best[start] + pieces.scores.get(part, pieces._unknown))
        table, forward = [""], [0.0]
        assert pieces._extend(word, table, forward)
        assert "".join(pieces._traced(table, len(word))) == word and forward[-1] == pytest.approx(best[-1])
    pieces.learn(words)  # prefixes shared
    for word in words:
        table, forward = [""], [0.0]
        pieces._extend(word, table, forward)
        assert pieces._memo[word] == pieces._ids_of(pieces._traced(table, len(word)))


def test_sentencepiece_query_and_odd_rows(spark, data, odd, empty):
    rows = queries.op10_sentencepiece(spark, data).collect()
    assert len(rows) == len(texts(spark, data)) and all(r.round_trip for r in rows)
    coded = sentencepiece.encode(odd)
    assert coded.count() == len(ODD) and coded.where("NOT round_trip").count() == 0
    back = sorted((r.doc_id or 0, r.text) for r in sentencepiece.decode(coded).collect())
    assert back == sorted((d or 0, (t or "").replace("▁", " ")) for d, t, *_ in ODD)
    assert sentencepiece.encode(empty).count() == 0


# -- The pipeline.


def test_pipeline_against_its_steps_by_hand(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    from tests.llm.test_texts import slow_bands, slow_limits

    limits_of = slow_limits([r.text for r in docs.values()])
    kept = {d: r.text for d, r in docs.items() if not quality.judge((r.text or "").encode())[5] and slow_bands(r.text, limits_of)}
    prints = {d: simhash.fingerprint(t.encode()) & (1 << 64) - 1 for d, t in kept.items()}
    from tests.llm.test_texts import slow_components

    roots, least = slow_components(set(prints.values())), {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    unique = {d: t for d, t in kept.items() if least[roots[prints[d]]] == d}
    cleaned = {d: t for d, (t, _) in slow_dedup(unique.items()).items()}
    rows = [(d, t) for d, t in cleaned.items()]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    final = {d: pii.redacted(t, pii.find(t, model)[1]) for d, t in rows}
    ids = whole_ids(final, 0)
    total, bins = check_packing(corpus_pipeline.run(spark, data).collect(), ids)
    assert total == sum(map(len, ids.values())) and bins <= 1.02 * total / 2048 + 1


def test_stages_keep_columns(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns and stage(spark, empty, "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert sentences.RUN == 3
