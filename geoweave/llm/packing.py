"""Packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids; only longer documents are cut. Full
pieces are sequences of their own. The others are dealt by a hash into lots of bounded
size, each a bin packing problem of its own. Best-fit in falling order of size gives a first
grouping. A lot that needs as many bins as its lower bound (the sum of its sizes over the
capacity) is solved, as nothing can be better. What best-fit leaves open in the others (its bins
that are not exactly full, and as many of the full ones, drawn at random, to exchange pieces
with) is searched on several islands:

* an individual is a grouping of these pieces into bins; the first ones are that of best-fit
  and best-fit groupings of disturbed orders;
* crossover injects whole well-filled bins of one parent into the other, drops the bins of
  the other that hold a piece twice, lets displaced pieces change places with one or two
  pieces of a bin that they fill better, and puts the rest back by best-fit;
* fitness is the number of bins, then the mean squared filling (fuller bins are kept whole);
* between epochs every island sends its best individual to the next one.

A search stops at the lower bound. At the end the bins of many lots that are filled under
``POOR`` are packed together once more, by the same islands and epochs; better filled ones stay
in their lots, so a lot can cost a part of a bin more than all lots together would.
Ids are made in one pass and never shuffled: lots hold keys and lengths.

Defined results: a null text is empty and still has its end id; repeated rows are pieces of
their own, whatever their ids; a null doc_id stays null; a very long text costs its length; other
columns may have any name and type; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import picked, prepare, stored
from geoweave.llm.tokens import lots, tokenizer_path, word_tokenizer

CAPACITY = 2048
END_ID = 0
#: Pieces in a lot, on average; hashing keeps lots within a few per cent of it.
LOT = 8192
ISLANDS = 3
EPOCHS = 3
POPULATION = 6
GENERATIONS = 30
#: Share of the capacity under which a bin takes part in the last packing.
POOR = 0.9
#: Lots whose poor bins are packed together.
MERGED = 64

Bins = list[list[int]]


class _Open:
    """Bins by free room: the one with least sufficient room in constant time."""

    def __init__(self, capacity: int):
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def add(self, room: int, bin_: int) -> None:
        self.stacks[room].append(bin_)
        self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fit = self.rooms >> size
        if not fit:
            return None
        room = (fit & -fit).bit_length() - 1 + size
        bin_ = self.stacks[room].pop()
        if not self.stacks[room]:
            self.rooms ^= 1 << room
        return bin_, room


def best_fit(order: Iterable[int], sizes: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Put the pieces in the given order where they leave the least room, or in new bins."""
    bins = [] if bins is None else bins
    rooms = _Open(capacity)
    for i, b in enumerate(bins):
        rooms.add(capacity - sum(sizes[p] for p in b), i)
    for p in order:
        size = sizes[p]
        if got := rooms.take(size):
            i, room = got
            bins[i].append(p)
            rooms.add(room - size, i)
        else:
            bins.append([p])
            rooms.add(capacity - size, len(bins) - 1)
    return bins


def falling(pieces: Iterable[int], sizes: list[int]) -> list[int]:
    return sorted(pieces, key=lambda p: (-sizes[p], p))


def lower_bound(sizes: Iterable[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Smaller is better."""
    return len(bins), -sum((sum(sizes[p] for p in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins: Bins, displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Put a displaced piece for one or two smaller ones of a bin where that fills it best, bin by bin; gives the pieces left over."""
    spare = sorted((sizes[p], p) for p in displaced)
    for b in bins:
        room = capacity - sum(sizes[p] for p in b)
        if not room or not spare:
            continue
        best = (0, (), 0)
        for c in chain(combinations(range(len(b)), 1), combinations(range(len(b)), 2) if 2 < len(b) <= 12 else ()):
            taken = sum(sizes[b[i]] for i in c)
            j = bisect_right(spare, (taken + room, len(sizes))) - 1
            if j >= 0 and spare[j][0] - taken > best[0]:
                best = (spare[j][0] - taken, c, j)
        if best[0]:
            new = spare.pop(best[2])[1]
            for i in best[1]:
                insort(spare, (sizes[b[i]], b[i]))
            b[:] = [p for i, p in enumerate(b) if i not in best[1]] + [new]
    return [p for _, p in spare]


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; what they displace is exchanged and best-fitted again."""
    filled = sorted(range(len(b)), key=lambda i: -sum(sizes[p] for p in b[i]))
    well = filled[: max(1, len(filled) // 2)]
    chosen = [b[i] for i in rng.choice(well, size=max(1, len(well) // 4), replace=False)]
    injected = {p for x in chosen for p in x}
    kept, displaced = [list(x) for x in chosen], []
    for x in a:
        if injected.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [p for p in x if p not in injected]
    # The emptiest kept bins are opened too, else the displaced pieces could only fill gaps.
    kept.sort(key=lambda x: -sum(sizes[p] for p in x))
    for x in kept[len(kept) - max(1, len(kept) // 50) :]:
        displaced += x
    del kept[len(kept) - max(1, len(kept) // 50) :]
    kept = [kept[i] for i in rng.permutation(len(kept))]
    displaced = exchange(kept, displaced, sizes, capacity)
    return best_fit(falling(displaced, sizes), sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, population: list[Bins], seed: int, generations: int = GENERATIONS, size: int = POPULATION) -> tuple[list[Bins], int]:
    """One epoch of an island: (its population, best first; crossovers made). Stops at the lower bound."""
    bound = lower_bound(sizes, capacity)
    rng = np.random.default_rng(seed)
    ranked = [(fitness(x, sizes, capacity), x) for x in population]
    order = falling(range(len(sizes)), sizes)
    while len(ranked) < size and not any(r[0][0] <= bound for r in ranked):
        disturbed = order if not ranked else [order[i] for i in np.argsort(np.arange(len(order)) + rng.normal(0, 1 + 0.01 * len(order) * rng.random(), len(order)), kind="stable")]
        x = best_fit(disturbed, sizes, capacity)
        ranked.append((fitness(x, sizes, capacity), x))
    ranked.sort(key=lambda r: r[0])
    made = 0
    for _ in range(generations):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        for _ in range(size // 2):
            i, j = sorted(rng.choice(len(ranked), size=2, replace=False))
            x = crossover(ranked[i][1], ranked[j][1], sizes, capacity, rng)
            ranked.append((fitness(x, sizes, capacity), x))
            made += 1
        ranked = sorted(ranked, key=lambda r: r[0])[:size]
    return [x for _, x in ranked[:size]], made


def open_part(bins: Bins, sizes: list[int], capacity: int, seed: int) -> list[int]:
    """Which bins take part in the search: those not exactly full, and as many full ones; none if no bin can be saved."""
    if len(bins) <= lower_bound(sizes, capacity):
        return []
    left = [i for i, b in enumerate(bins) if sum(sizes[p] for p in b) < capacity]
    full = sorted(set(range(len(bins))).difference(left))
    drawn = np.random.default_rng(seed).permutation(len(full))[: len(left)]
    return left + [full[i] for i in sorted(drawn.tolist())]


def migrated(populations: list[list[Bins]]) -> list[list[Bins]]:
    """Every island with the best individual of the one before."""
    return [p + [populations[i - 1][0]] for i, p in enumerate(populations)]


def _seed(lot: int, epoch: int, island: int) -> int:
    return (lot * 1024 + epoch) * 64 + island


def search(sizes: list[int], capacity: int, seed: int = 0, islands: int = ISLANDS, epochs: int = EPOCHS) -> tuple[Bins, int]:
    """(bins, crossovers) of one lot in one process: what the query does with all lots and islands at once."""
    first = best_fit(falling(range(len(sizes)), sizes), sizes, capacity)
    part = open_part(first, sizes, capacity, seed)
    if not part:
        return first, 0
    inside = [p for i in part for p in first[i]]
    at = {p: k for k, p in enumerate(inside)}
    some = [sizes[p] for p in inside]
    populations: list[list[Bins]] = [[[[at[p] for p in first[i]] for i in part]] for _ in range(islands)]
    made = 0
    for epoch in range(epochs):
        populations = migrated(populations) if epoch else populations
        found = [evolve(some, capacity, p, _seed(seed, epoch, k)) for k, p in enumerate(populations)]
        populations, made = [p for p, _ in found], made + sum(n for _, n in found)
    best = min((p[0] for p in populations), key=len)
    chosen = set(part)
    return [b for i, b in enumerate(first) if i not in chosen] + [[inside[k] for k in b] for b in best], made


def _labels(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out


def _bins(labels: np.ndarray) -> Bins:
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32) of every piece; with ``with_ids`` its ids too.

    ``key`` is unique. One pass, no shuffle."""
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    end, width = end_id.to_bytes(4, "little"), 4 * capacity
    kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        words = word_tokenizer(path)
        for doc_ids, texts in lots(batches):
            rows = []
            for doc_id, coded in zip(doc_ids.to_pylist(), words.encode(texts)):
                coded += end
                for i, a in enumerate(range(0, len(coded), width)):
                    ids = coded[a : a + width]
                    rows.append((key, doc_id, i, a // 4, len(ids) // 4, zlib.crc32(ids), ids)[: len(kinds)])
                    key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[n for n, _ in kinds])

    schema = "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return picked(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Evolve the populations: (lot, island, sizes, populations) with the number of bins and of crossovers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                found, made = evolve(sizes, capacity, [_bins(np.frombuffer(x, np.int32)) for x in row["populations"]], _seed(row["lot"], epoch, row["island"]))
                yield pa.RecordBatch.from_pylist([{"lot": row["lot"], "island": row["island"], "bins": len(found[0]), "crossovers": row["crossovers"] + made, "sizes": sizes, "populations": [_labels(x, len(sizes)).tobytes() for x in found]}], schema=schema)

    schema = pa.schema([("lot", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("crossovers", pa.int64()), ("sizes", pa.list_(pa.int32())), ("populations", pa.list_(pa.binary()))])
    return islands.mapInArrow(run, "lot long, island int, bins int, crossovers long, sizes array<int>, populations array<binary>")


def _solve(items: DataFrame, capacity: int, name: str, epochs: int, islands: int) -> tuple[DataFrame, DataFrame]:
    """((key, lot, bin, offset, room) for items (lot, key, length), lots of bounded size; what the search did to the open lots)."""
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best-fit of each lot, and the part of it that is searched: its pieces and their bins."""
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                bins = best_fit(falling(range(len(sizes)), sizes), sizes, capacity)
                part = open_part(bins, sizes, capacity, row["lot"])
                inside = [p for i in part for p in bins[i]]
                start = np.repeat(np.arange(len(part), dtype=np.int32), [len(bins[i]) for i in part]).tobytes()
                yield pa.RecordBatch.from_pylist([{"lot": row["lot"], "keys": row["keys"], "sizes": sizes, "labels": _labels(bins, len(sizes)).tobytes(), "inside": inside, "start": start, "start_bins": len(part)}], schema=schema)

    schema = pa.schema([("lot", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("labels", pa.binary()), ("inside", pa.list_(pa.int32())), ("start", pa.binary()), ("start_bins", pa.int32())])
    lots = items.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("members"))
    lots = lots.select("lot", F.col("members.key").alias("keys"), F.col("members.length").cast("array<int>").alias("sizes"))
    lots = stored(lots.mapInArrow(fit, "lot long, keys array<long>, sizes array<int>, labels binary, inside array<int>, start binary, start_bins int"), f"{name}-lots")
    some = F.transform("inside", lambda i: F.get(F.col("sizes"), i))
    state = lots.where(F.size("inside") > 0).select("lot", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), some.alias("sizes"), F.array("start").alias("populations"), F.lit(0).cast("long").alias("crossovers"))
    for epoch in range(epochs):
        if epoch:  # the best individual of the island before joins each population
            ring = Window.partitionBy("lot").orderBy("island")
            last = F.last(F.col("populations")[0]).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            newcomer = F.coalesce(F.lag(F.col("populations")[0]).over(ring), last)
            state = state.select("lot", "island", "sizes", F.concat("populations", F.array(newcomer)).alias("populations"), "crossovers")
        state = stored(_epoch(state.repartition(parts, "lot", "island").select("lot", "island", "sizes", "populations", "crossovers"), capacity, epoch), f"{name}-epoch{epoch}")
    best = state.groupBy("lot").agg(F.min_by(F.col("populations")[0], F.struct("bins", "island")).alias("found"))
    report = state.groupBy("lot").agg(F.min("bins").alias("bins"), F.sum("crossovers").alias("crossovers")).join(lots.select("lot", "start_bins"), "lot")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels, sizes = np.frombuffer(row["labels"], np.int32).copy(), np.array(row["sizes"], np.int64)
                if row["found"] is not None:  # the searched pieces' bins take numbers of their own
                    labels[row["inside"]] = len(sizes) + np.frombuffer(row["found"], np.int32)
                    labels = np.unique(labels, return_inverse=True)[1].astype(np.int32)
                order = np.argsort(labels, kind="stable")
                ends = np.cumsum(sizes[order])
                sums = np.bincount(labels, weights=sizes).astype(np.int64)
                offsets = np.empty(len(sizes), np.int64)
                offsets[order] = ends - sizes[order] - np.r_[0, np.cumsum(sums)[:-1]][labels[order]]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(np.full(len(sizes), row["lot"])), pa.array(labels), pa.array(offsets), pa.array(capacity - sums[labels])], names=["key", "lot", "bin", "offset", "room"])

    placed = lots.select("lot", "keys", "sizes", "labels", "inside").join(best, "lot", "left").mapInArrow(place, "key long, lot long, bin int, offset long, room long")
    return placed, report


def pack(made: DataFrame, capacity: int = CAPACITY, lot: int = LOT, epochs: int = EPOCHS, islands: int = ISLANDS) -> DataFrame:
    """``made`` (key, length, ...) with sequence_id and offset."""
    made = stored(made, "pieces")
    full = made.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    rest = made.where(F.col("length") < capacity)
    lots = max(1, -(-rest.count() // lot))
    dealt = rest.select(F.pmod(F.xxhash64("key"), F.lit(lots)).alias("lot"), "key", "length")
    first = stored(_solve(dealt, capacity, "packing", epochs, islands)[0], "packed")
    whole = first.where(F.col("room") <= int(capacity * (1 - POOR))).select("key", (F.col("lot") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")
    poor = first.where(F.col("room") > int(capacity * (1 - POOR))).select((F.col("lot") / MERGED).cast("long").alias("lot"), "key").join(rest.select("key", "length"), "key")
    again = _solve(poor.select("lot", "key", "length"), capacity, "repacking", epochs, islands)[0]
    again = again.select("key", ((F.col("lot") + lots) * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")
    return rest.join(whole.union(again), "key").unionByName(full)


def best_fit_packing(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of the documents."""
    return pack(pieces(docs, **options)).drop("key")
