"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less have a point between them: one within 1 bit of one
and within 2 bits of the other. Every fingerprint therefore has the variants around it,
and fingerprints that meet at a variant are verified and linked.

Two observations shorten the balls and lose no link:

* Distance 1 or 3 means different bit parity, so only odd fingerprints need the variants
  at 2 bits; distance 2 is met by the variants at 1 bit of both sides.
* Of three differing bits, two lie in the same 32-bit half. The odd side flips those two
  and the even side the third, so pairs of flips across halves are not needed.

An even fingerprint has 65 variants and an odd one 1,057. They are not shuffled one by one:
the space of variants is cut into slices by parities of bits, so that a ball lies in few of
them; a fingerprint goes to these, and all variants of a slice are made and met there. Equal fingerprints are one
row before anything is emitted, so the members of a variant are at most the fingerprints
of its ball (2,081): copies make no group larger. Members within 1 bit of the variant are
within 3 bits of every other member, so linking all members to the least of those yields
all connections of the group without its pairs; members only at 2 bits prove nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import numbered, per_document, place, stored
from geoweave.llm.components import components

SEED = 42
WIDTH = 3
RADIUS = 3
_STEP = 1 << 16
#: Variants that a task meets, those of a slice on average, and those that are held at once.
TASK_VARIANTS = 1 << 21
SLICE_VARIANTS = 1 << 17
SLICE_MOST = 1 << 22
#: Bits of a slice's number at most: 211 slices for a ball.
MOST_BITS = 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NEAR = [0, *(_signed(1 << i) for i in range(64))]
FAR = [_signed(1 << i | 1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]


def fingerprint(data: bytes | None) -> int:
    """SimHash of UTF-8 text as a signed 64-bit integer; 0 for a null text or one without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: A-Z and \\x20, \\x09-\\x0D."""
    from xxhash import xxh64_intdigest

    words = (data or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else [b" ".join(words)]
    count = max(1, len(words) - WIDTH + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, _STEP):
        part = hashes[i : i + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document, whole texts, one pass."""
    return per_document(docs, lambda i, t: (i, fingerprint(t)), "doc_id long, fp long", raw=True)


def _meet(variant: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (member, hub) of whole variant groups, sorted by variant."""
    if not len(variant):
        return np.empty((0, 2), np.int64)
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    sizes = np.diff(np.r_[starts, len(variant)])
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return np.empty((0, 2), np.int64)
    variant, fp, sizes = variant[shared], fp[shared], sizes[sizes > 1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    near = np.bitwise_count((variant ^ fp).view(np.uint64)) <= 1
    none = np.iinfo(np.int64).max
    hubs = np.repeat(np.minimum.reduceat(np.where(near, fp, none), starts), sizes)
    has = np.repeat(np.logical_or.reduceat(near, starts), sizes)
    linked = has & (fp != hubs) & (np.bitwise_count((fp ^ hubs).view(np.uint64)) <= RADIUS)
    return np.unique(np.stack([fp[linked], hubs[linked]], axis=1), axis=0)


def _flips(bits: int) -> dict[int, list[list[int]]]:
    """For every way in which flips move a fingerprint between slices: the masks of near balls and of far ones that do so."""
    by: dict[int, list[list[int]]] = {}
    for far, masks in enumerate((NEAR, [*NEAR, *FAR])):
        for mask in masks:
            moved = 0
            for i in range(64):
                if bits and mask >> i & 1:
                    moved ^= 1 << i % bits
            by.setdefault(moved, [[], []])[far].append(mask)
    return by


def _slice_masks(bits: int) -> list[int]:
    """The bits of a fingerprint whose parity is each bit of its slice's number."""
    return [_signed(sum(1 << i for i in range(k, 64, bits))) for k in range(bits)]


def _slice_links(fp: np.ndarray, number: int, bits: int, flips: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Links (member, hub) of all variant groups of a slice, from the fingerprints that have a variant in it.

    A slice with very many variants is met in several passes, each with the variants of one remainder."""
    own = np.zeros(len(fp), np.int64)
    for k, mask in enumerate(_slice_masks(bits)):
        own |= np.bitwise_count((fp & np.int64(mask)).view(np.uint64)).astype(np.int64) % 2 << k
    moved, far = own ^ number, np.bitwise_count(fp.view(np.uint64)) % 2
    order = np.lexsort((far, moved))
    fp, code = fp[order], moved[order] * 2 + far[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    lots = [(fp[lo:hi], flips[int(code[lo]) >> 1][int(code[lo]) & 1]) for lo, hi in zip(starts, [*starts[1:], len(fp)])]
    passes = sum(len(f) * len(m) for f, m in lots) // SLICE_MOST + 1
    found = []
    for turn in range(passes):
        variants, members = [], []
        for f, m in lots:
            step = max(1, SLICE_MOST // max(1, len(m)))
            for lo in range(0, len(f), step):
                part = f[lo : lo + step]
                variant, member = (part[:, None] ^ m).ravel(), np.repeat(part, len(m))
                if passes > 1:
                    here = (variant.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == turn
                    variant, member = variant[here], member[here]
                variants.append(variant)
                members.append(member)
        variant, member = np.concatenate(variants), np.concatenate(members)
        order = np.argsort(variant, kind="stable")
        found.append(_meet(variant[order], member[order]))
    return np.concatenate(found)


def _links(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition whose rows (slice, fp) are sorted by slice; variants are made slice by slice."""
    flips = {k: tuple(np.array(m, np.int64) for m in both) for k, both in _flips(bits).items()}
    number, held = None, []
    found: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        slices, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(slices) else []
        for lo, hi in zip(starts, [*starts[1:], len(slices)]):
            if number is not None and slices[lo] != number:
                found.append(_slice_links(np.concatenate(held), number, bits, flips))
                held = []
                if sum(map(len, found)) > _STEP:
                    yield out()
            number = int(slices[lo])
            held.append(fps[lo:hi])
    if held:
        found.append(_slice_links(np.concatenate(held), number, bits, flips))
    if found:
        yield out()


def dealt(distinct: DataFrame, bits: int) -> DataFrame:
    """(slice, fp): every fingerprint of ``distinct`` (fp) in each of the 2 ** ``bits`` slices of the space that hold a variant of it.

    A bit of a slice's number is the parity of the variant's bits whose place leaves the same remainder, so a flip changes one bit of it, and a
    ball of 1,057 variants lies in 1 + bits * (bits + 1) / 2 slices at most."""
    own = F.lit(0)
    for k, mask in enumerate(_slice_masks(bits)):
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(mask))) % 2, k))
    near, far = (F.array(*(F.lit(k) for k, both in sorted(_flips(bits).items()) if both[i])) for i in (0, 1))
    moves = F.when(F.bit_count("fp") % 2 == 0, near).otherwise(far)
    return distinct.select("fp", own.alias("own"), F.explode(moves).alias("move")).select(F.col("own").bitwiseXOR(F.col("move")).alias("slice"), "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between different fingerprints of ``distinct`` (fp) at 3 bits or less.

    Connected exactly as all such pairs are; not every pair of a group has a row."""
    # As many slices and tasks as the variants need, which are 561 for each fingerprint on average.
    variants = distinct.count() * (len(NEAR) + len(FAR) // 2)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), variants // TASK_VARIANTS + 1)
    bits = min(MOST_BITS, (variants // SLICE_VARIANTS).bit_length())
    # Few bytes of fingerprints become more of slices: spread them over all tasks first (by another key than theirs, by which few tasks may hold them).
    balls = dealt(distinct.select("fp").repartition(parts, F.hash("fp")), bits)
    met = balls.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(lambda batches: _links(batches, bits), "u long, v long")
    return met.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``component_id`` is the least doc_id that links of 3 or fewer differing bits reach.
    Null and empty texts have fingerprint zero and link like any other; a null doc_id is
    never a component's id unless the component has no other; repeated rows stay repeated;
    an empty table gives no rows."""
    docs_fp = stored(fingerprints(docs), "simhash")
    one = stored(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(one.select("fp")), "simhash-links")
    of = one.join(roots, one.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return docs_fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without near-duplicates: of each group the one with the least doc_id stays.

    Rows that agree in doc_id and text are one document and leave one row (any, where they differ in
    other columns, which may have any name and type). Rows of one doc_id with other texts are kept or
    dropped together, as the id is all that a group names. Rows without a doc_id can't be named by a
    group and stay. Null, empty and blank texts have fingerprint zero and are one group. An empty table
    stays empty. The join and the removal of rows that agree share one shuffle by doc_id."""
    held, id_, text = numbered(docs), f"_{place(docs, 'doc_id')}", f"_{place(docs, 'text')}"
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias(id_)).distinct()
    named = held.join(kept, id_, "left_semi").dropDuplicates([id_, text])
    return named.union(held.where(F.col(id_).isNull())).toDF(*docs.columns)
