"""The divergence audit, sharding and hard negatives against plain programs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoweave.llm import divergence, negatives, shards


def plain_divergence(rows, least=10, ranks=10):
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", pattern.findall((text or "").translate(lower))
        groups[lang].add(source)
        counts[lang, source].update(found)
        having[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= least]
        v = len(kept)

        def p(of, t, kept=kept, v=v):
            return 1 + 1000000000 * (of[t] + 2) // (sum(of[x] for x in kept) + 2 * v)

        whole = sum((counts[lang, s] for s in sources), Counter())
        q = {t: p(whole, t) for t in kept}
        of = {s: {t: p(counts[lang, s], t) for t in kept} for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(f(of[s][t], q[t]), t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_divergence_of_odd_rows(spark, odd, twins, empty):
    want = plain_divergence([(r.text, r.lang, r.source) for r in odd.collect()], least=1)
    assert want and rows_of(divergence.divergence(odd, least_documents=1)) == want
    assert rows_of(divergence.divergence(twins, least_documents=1)) == want
    assert divergence.divergence(empty).count() == 0
    # Nothing kept: all pairs are 0 and there are no terms.
    none = divergence.divergence(odd).collect()
    assert {r.part for r in none} == {"pair"} and {r.value for r in none} == {0}


def test_divergence_in_small_tries_blocks_and_tiles(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    want = plain_divergence([(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()])
    for name, value in (("COUNTERS", 500), ("BLOCK", 7), ("LOT", 50), ("TILE", 20)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.divergence(docs)) == want


def test_tries_split_edges_merge_and_keep_the_order_of_bytes():
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"ab\xc3\xa9"), rng.integers(0, 6))) for _ in range(400)]
    one, two, plain = divergence.Trie(), divergence.Trie(), defaultdict(Counter)
    for i, w in enumerate(words):
        (one if i % 2 else two).add(w, 1, [(f"s{i % 3}", i)])
        plain[w][f"s{i % 3}"] += i
    got = list(one.merge(two).leaves())
    assert [w for w, _, _ in got] == sorted(plain)
    assert {w: dict(c) for w, _, c in got} == {w: dict(c) for w, c in plain.items()}
    assert {w: d for w, d, _ in got} == dict(Counter(words))


def test_shares_of_great_counts_are_exact():
    counts, wholes = [0, 1, 10**9, 4 * 10**15], [3, 10**12 + 7, 9 * 10**15]
    for n in wholes:
        for c in counts:
            if c + 2 <= n:
                assert int(divergence.share(np.array([c]), n)[0]) == 1 + 10**9 * (c + 2) // n


def check_shards(got, rows, count=shards.SHARDS):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, __import__("zlib").crc32((r.text or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(count)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(count))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def spread(got):
    groups = defaultdict(Counter)
    for r in got:
        groups[r.text_crc32, r.size][r.shard] += 1
    return [c for c in groups.values() if sum(c.values()) > 1]


def test_shards_of_odd_rows_and_of_the_tables(spark, data, odd, twins, empty):
    for docs in (odd, twins):
        got = shards.shard_documents(docs).collect()
        check_shards(got, odd.select("doc_id", "text").collect())
    assert shards.shard_documents(empty).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = shards.shard_documents(docs).collect()
    check_shards(got, docs.collect())
    assert all(len(c) == 1 for c in spread(got))


def test_a_group_larger_than_a_shard_takes_as_few_as_it_needs(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i % 40 if i % 5 == 0 else i}") for i in range(1200)], "doc_id long, text string")
    got = shards.shard_documents(docs).collect()
    check_shards(got, docs.collect())
    groups = sorted(spread(got), key=lambda c: -sum(c.values()))
    assert sum(groups[0].values()) == 400 and len(groups[0]) <= 7  # 75 rows a shard
    assert all(len(c) == 1 for c in groups[1:])


def test_propagation_without_room_only_exchanges(spark):
    """All rows are linked, so no shard has room, and two of three cut links go all the same."""
    docs = spark.createDataFrame([(i, f"t{i // 7}") for i in range(700)], "doc_id long, text string")
    rows = shards.document_rows(docs)
    members = shards.equal_texts(rows)
    before = shards.cut_links(members, shards.propagate(members, 700, rounds=0))
    labels = shards.propagate(members, 700)
    assert shards.cut_links(members, labels) < before / 2
    sizes = [r["count"] for r in labels.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


def test_rows_may_be_in_several_groups(spark):
    """A chain of overlapping groups: propagation brings neighbours together, up to the borders where two labels meet."""
    members = spark.createDataFrame([(i, i // 4) for i in range(256)] + [(i, 1000 + (i + 2) // 4) for i in range(256)], "node long, group long")
    before = shards.cut_links(members, shards.propagate(members, 2000, rounds=0))
    after = shards.propagate(members, 2000)
    assert after.count() == 256 and shards.cut_links(members, after) < 0.6 * before


def test_quotas_never_fill_a_shard_beyond_its_room():
    rng = np.random.default_rng(3)
    for _ in range(200):
        wishes = {(s, t): int(rng.integers(1, 20)) for s in range(5) for t in range(5) if s != t and rng.random() < 0.7}
        room = [int(x) for x in rng.integers(0, 15, 5)]
        got = shards.quotas(wishes, room)
        assert all(0 <= got[st] <= wishes[st] for st in wishes)
        for t in range(5):
            assert sum(n for st, n in got.items() if st[1] == t) - sum(n for st, n in got.items() if st[0] == t) <= room[t]


def plain_negatives(rows, every=50):
    taken = []
    for node, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        taken.append((i, node, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(x))) for x in v]))
    out = []
    for i, node, label, v in taken:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other, of) for j, other, of, w in taken if other != node and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[3] == label][:5]:
            window = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(window[:3], 1)]
    return sorted(out)


def vectors(rng, n, dims=24, labels=3):
    centres = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.4 * rng.normal(size=dims)], int(rng.integers(labels))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_negatives_with_copies_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 400)
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 4) for i in range(150)]  # ties, among them anchors
    rows += [rows[50], rows[100], (7, None, 1), (8, [1.0] * 24, None), (None, [1.0] * 24, 1), (9, [None] + [1.0] * 23, 1), (10, [float("nan")] + [1.0] * 23, 1), (11, [float("inf")] * 24, 1)]
    rows += [(50, [0.5, 0.25], 1), (51, [0.5, 0.5], 1), (53, [0.3, 0.2], 2), (100, [], 1), (101, [], 1), (102, [], 2), (150, [-1.0, 0.0], 1), (151, [1.0, 0.0], 1)]
    want = plain_negatives(rows)
    assert len(want) > 100
    for sizes in ({}, {"BLOCK_ROWS": 64, "GROUP_ROWS": 7, "PAIRS": 300, "SAMPLE": 40, "CENTROIDS": 5}):
        for name, value in sizes.items():
            monkeypatch.setattr(negatives, name, value)
        got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as block", "3 as LABEL_"))
        assert rows_of(got) == want
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intervals_hold_the_scores_and_narrow_the_rows():
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.array([v for _, v, _ in vectors(rng, 3000, 64)])).astype(np.int64)
    book = negatives.fit(x[:1000], negatives.SUBSPACES, negatives.CENTROIDS)
    codes, norms = negatives.encode(x, book)
    pack = negatives._Pack.__new__(negatives._Pack)
    pack.ids, pack.codes, pack.norms = np.arange(len(x)), codes, norms
    low, high = negatives._intervals(x[:20], pack, book)
    true = x[:20] @ x.T
    assert (low <= true).all() and (true <= high).all()
    fifth = np.sort(low, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.5


@pytest.mark.parametrize("score", [-41, -20, -1, 0, 1, 19, 20, 21, 399, 10**15 + 7])
def test_windows(score):
    lo, hi = (int(x[0]) for x in negatives.window(np.array([score])))
    assert 50 * score <= 100 * lo and 50 * score > 100 * (lo - 1)
    assert 100 * hi <= 95 * score and 100 * (hi + 1) > 95 * score
