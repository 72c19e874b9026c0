"""What operators send through a shuffle, and what they do for each row."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from geoweave.llm import divergence, simhash


def near_prints(n, seed):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(n)}
    for p in list(prints)[: n // 2]:
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            p ^= 1 << bit
        prints.add(p)
    return [simhash._signed(p) for p in sorted(prints)]


def test_fingerprints_go_to_few_slices_and_meet_there(spark, monkeypatch):
    prints = near_prints(120, 9)
    want = {(min(a, b), max(a, b)) for a, b in combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(want) >= 60
    for bits in (0, 1, 7, 11):
        rows = simhash.dealt(spark.createDataFrame([(p,) for p in prints], "fp long"), bits).collect()
        # Not a row for each of up to 1,057 variants.
        assert len(rows) <= len(prints) * (1 + bits * (bits + 1) // 2)
        rows.sort(key=lambda r: r.slice)
        batches = [pa.RecordBatch.from_arrays([pa.array([r.slice for r in rows[i : i + 50]], pa.int32()), pa.array([r.fp for r in rows[i : i + 50]], pa.int64())], names=["slice", "fp"]) for i in range(0, len(rows), 50)]
        for most in (1 << 22, 500):  # all variants of a slice at once, and in passes
            monkeypatch.setattr(simhash, "SLICE_MOST", most)
            found = {tuple(sorted(x)) for b in simhash._links(iter(batches), bits) for x in zip(*(c.to_pylist() for c in b.columns))}
            assert found == want  # no three of these are near each other, so every pair has its row
    assert sum(1 for b in simhash._links(iter([]), 3)) == 0


def test_every_variant_lies_in_the_slice_that_its_print_goes_to():
    for bits in (1, 5, 13, 20):
        masks, flips = [m & (1 << 64) - 1 for m in simhash._slice_masks(bits)], simhash._flips(bits)
        assert sorted(m for both in flips.values() for m in both[1]) == sorted([*simhash.NEAR, *simhash.FAR])
        for moved, both in flips.items():
            for mask in both[0] + both[1]:
                assert sum(((mask & m) & (1 << 64) - 1).bit_count() % 2 << k for k, m in enumerate(masks)) == moved


def test_tries_are_built_in_the_order_of_their_terms():
    """One pass over sorted terms gives the leaves of single insertions, and looks for no term from the root."""
    rng = np.random.default_rng(12)
    terms = {bytes(rng.integers(97, 100, rng.integers(0, 9)).tolist()) for _ in range(3000)} | {b"", "é".encode(), "éa".encode()}
    assert divergence.shared([b"", b"ab", b"abc", b"abd", b"b", b"b\xc3"]) == [0, 0, 2, 2, 0, 1]
    found = {t: {"s": len(t), "u": 1} if t else {"s": 0} for t in terms}
    docs = {t: len(t) + 1 for t in terms if t}
    plain = divergence.Trie()
    for t, counts in found.items():
        plain.add(t, docs.get(t, 0), counts.items())
    assert list(divergence.Trie.of(found, docs).leaves()) == list(plain.leaves()) == [(t, docs.get(t, 0), found[t]) for t in sorted(terms)]
    assert list(divergence.Trie.of({}, {}).leaves()) == []
