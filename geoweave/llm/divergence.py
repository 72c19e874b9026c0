"""Source divergence audit: which sources of a language differ, and by which terms.

Every task counts the terms of its documents in byte tries, one for each language, whose
leaves count by source. The leaves leave a trie in byte order, are shuffled by ranges of
prefixes, and the tries that meet in a range are merged: equal leaves are adjacent there, so
a range is merged as a stream. Terms that enough documents of their language have are kept, in
blocks of adjacent leaves. With the totals of languages and sources known, the blocks are
traversed once more, in the order of UTF-8, and give the divergence of every pair of sources
and, for every source, the terms that set it apart, ties in the order of the terms.

All arithmetic is on integers and exact: p = 1 + floor(10^9 (count + 2) / (N + 2 V)).
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import as_bytes, picked, prepare, stored

#: Documents of its language that a kept term is in.
LEAST_DOCUMENTS = 10
#: Ranks of terms that a group reports.
RANKS = 10
#: Counters (term and source) that a task holds before its tries are sent on.
COUNTERS = 1 << 19
#: Leaves in a block of a merged trie, and leaves that are merged at once.
BLOCK = 1024
LOT = 1 << 16
#: Numbers in one tile of sources by terms, and in a matrix of pairs that a task keeps.
TILE = 1 << 20

_LETTER = [65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)]
#: Bytes of terms, A-Z lower-cased; all others end a term. Bytes above 0x7F belong to characters above U+007F, all of which are in terms.
TERM_BYTES = bytes((c | 32 if c < 128 else c) if _LETTER[c] else 32 for c in range(256))

_LEAVES = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_BLOCKS = "lang string, terms array<binary>, names array<string>, sums array<long>, leaf array<int>, name array<int>, count array<long>"
_FOUND = "lang string, source string, part string, item binary, value long"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order: runs of letters A-Z, lower-cased, and of characters above U+007F."""
    return (text or b"").translate(TERM_BYTES).split()


def shared(terms: list[bytes]) -> list[int]:
    """How many first bytes each term has in common with the one before it."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    data, start = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size) - size
    out = np.zeros(len(terms), np.int64)
    live, least, k = np.arange(1, len(terms)), np.minimum(size[1:], size[:-1]), 0
    while len(live):
        longer = least > k
        live, least = live[longer], least[longer]
        same = data[start[live] + k] == data[start[live - 1] + k]
        live, least, k = live[same], least[same], k + 1
        out[live] = k
    return out.tolist()


class Trie:
    """A radix trie over bytes. Edges hold several bytes; a leaf holds how many documents have its term and a count for each source."""

    __slots__ = ("label", "children", "docs", "counts")

    def __init__(self, label: bytes = b"") -> None:
        self.label, self.children, self.docs, self.counts = label, None, 0, None

    def at(self, term: bytes) -> Trie:
        """The node of ``term``, made where it is not there."""
        node, i = self, 0
        while i < len(term):
            below = node.children
            if below is None:
                below = node.children = {}
            child = below.get(term[i])
            if child is None:
                child = below[term[i]] = Trie(term[i:])
                return child
            label = child.label
            if term.startswith(label, i):
                node, i = child, i + len(label)
                continue
            k = next(k for k in range(1, len(label)) if i + k == len(term) or label[k] != term[i + k])
            fork = Trie(label[:k])
            child.label, fork.children = label[k:], {label[k]: child}
            below[term[i]] = fork
            node, i = fork, i + k
        return node

    def add(self, term: bytes, docs: int, counts: Iterable[tuple[str, int]]) -> None:
        leaf = self.at(term)
        leaf.docs += docs
        if leaf.counts is None:
            leaf.counts = dict(counts)
            return
        for source, n in counts:
            leaf.counts[source] = leaf.counts.get(source, 0) + n

    @classmethod
    def of(cls, found: dict[bytes, dict[str, int]], docs: Mapping[bytes, int]) -> Trie:
        """The trie of terms with their counts by source, built in the order of bytes: only the path to the last term is open, so no term is looked for from the root."""
        terms = sorted(found)
        root = cls()
        path, depths = [root], [0]
        for term, common in zip(terms, shared(terms)):
            node = path[-1]
            if depths[-1] > common:
                while depths[-1] > common:
                    child = path.pop()
                    depths.pop()
                node, at = path[-1], depths[-1]
                if at < common:  # between two nodes: the edge to the child is cut
                    label, k = child.label, common - at
                    fork = cls(label[:k])
                    child.label, fork.children = label[k:], {label[k]: child}
                    node.children[label[0]] = fork
                    path.append(fork)
                    depths.append(common)
                    node = fork
            if len(term) > common:
                leaf = cls(term[common:])
                if node.children is None:
                    node.children = {}
                node.children[term[common]] = leaf
                path.append(leaf)
                depths.append(len(term))
                node = leaf
            node.docs, node.counts = docs.get(term, 0), found[term]
        return root

    def merge(self, other: Trie) -> Trie:
        for term, docs, counts in other.leaves():
            self.add(term, docs, counts.items())
        return self

    def leaves(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """(term, docs, counts) in the order of bytes."""
        todo = [(self, b"")]
        while todo:
            node, before = todo.pop()
            term = before + node.label
            if node.counts is not None:
                yield term, node.docs, node.counts
            if node.children:
                todo.extend((node.children[k], term) for k in sorted(node.children, reverse=True))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of the tries of a partition's documents. The root of a trie counts the documents of each source."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    having: dict[str, Counter] = defaultdict(Counter)

    def rows(leaves: list[tuple[bytes, int, dict[str, int]]], lang: str) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(len(c) for _, _, c in leaves)]), pa.int32())
        names, numbers = (pa.array(list(chain.from_iterable(x)), t) for x, t in (((c for _, _, c in leaves), pa.string()), ((c.values() for _, _, c in leaves), pa.int64())))
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(leaves)), pa.array([t for t, _, _ in leaves], pa.binary()), pa.array([d for _, d, _ in leaves], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, numbers)], schema=schema)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, by in held.items():
            found: dict[bytes, dict[str, int]] = defaultdict(dict)
            found[b""] = dict.fromkeys(by, 0)
            for source, counter in by.items():
                for term, n in counter.items():
                    found[term][source] = n
            leaves = Trie.of(found, having[lang]).leaves()
            found.clear()
            while part := list(islice(leaves, 1 << 14)):
                yield rows(part, lang)
        held.clear()
        having.clear()

    size, collects = 0, gc.isenabled()
    gc.disable()  # counters and tries have no cycles, and looking for some takes a tenth of the time
    try:
        for batch in batches:
            for text, lang, source in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, counter = terms(text), held[lang][source]
                before = len(counter)
                counter.update(words)
                having[lang].update(set(words))
                size += len(counter) - before
                if size >= COUNTERS:
                    yield from out()
                    size = 0
        yield from out()
    finally:
        if collects:
            gc.enable()


def _merge(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blocks of kept leaves of a range, whose leaves come in the order of (lang, term). A block without terms tells which sources there are.

    Leaves are taken in lots; those of a lot's last term go on to the next lot as one leaf, so a term that comes from every task takes no more room."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOT:
            last, blocks = _merged(pa.Table.from_batches(held), least, False)
            yield from blocks
            held, size = [last], 1
    if size:
        yield from _merged(pa.Table.from_batches(held), least, True)[1]


def _merged(leaves: pa.Table, least: int, whole: bool) -> tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]:
    """The last term's leaves as one, and the blocks of all terms (without the last one, unless the table is ``whole``)."""
    lang, term, docs, sources, counts = (leaves.column(i).combine_chunks() for i in range(5))
    n = len(lang)
    same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, ~same])
    group = np.cumsum(np.r_[True, ~same]) - 1
    in_docs = np.add.reduceat(docs.to_numpy(), starts)
    # Counters by (term, source), added up.
    coded = sources.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    of = np.repeat(group, np.diff(np.asarray(sources.offsets)))
    key = of * max(1, len(names)) + codes
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    number = np.add.reduceat(counts.flatten().to_numpy()[order], first)
    of, codes = of[order][first], codes[order][first]
    ends = np.searchsorted(of, np.arange(len(starts) + 1))
    lo = int(ends[-2])
    last = pa.RecordBatch.from_arrays(
        [lang.slice(n - 1), term.slice(n - 1), pa.array(in_docs[-1:]), pa.ListArray.from_arrays([0, len(of) - lo], names.take(pa.array(codes[lo:]))), pa.ListArray.from_arrays([0, len(of) - lo], pa.array(number[lo:]))], schema=leaves.schema
    )
    at = starts if whole else starts[:-1]
    root = pc.binary_length(term.take(pa.array(at))).to_numpy(zero_copy_only=False) == 0
    kept = np.flatnonzero((in_docs[: len(at)] >= least) | root)
    new_lang = np.r_[True, ~pc.equal(lang.slice(1), lang.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
    language = np.cumsum(new_lang)[at]

    def blocks() -> Iterator[pa.RecordBatch]:
        i = 0
        while i < len(kept):
            j = i + 1
            if not root[kept[i]]:
                j = i + min(BLOCK, int(np.searchsorted(language[kept[i:]], language[kept[i]], "right")))
            groups = kept[i:j]
            entries = np.concatenate([np.arange(ends[g], ends[g + 1]) for g in groups])
            used, name = np.unique(codes[entries], return_inverse=True)
            leaf, many = np.repeat(np.arange(len(groups)), ends[groups + 1] - ends[groups]), number[entries]
            sums = _exact_sums(name, many, len(used))
            texts = term.take(pa.array(starts[groups])) if not root[kept[i]] else term.slice(0, 0)
            lists = [texts, names.take(pa.array(used)), pa.array(sums), pa.array(leaf.astype(np.int32)), pa.array(name.astype(np.int32)), pa.array(many)]
            columns = [lang.slice(int(starts[groups[0]]), 1), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "terms", "names", "sums", "leaf", "name", "count"])
            i = j

    return last, blocks()


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), digits of a long division by thousands: exact up to whole = 9 * 10^15."""
    rest = count + 2
    out = rest // whole
    rest = rest - out * whole
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        out, rest = out * 1000 + digit, rest - digit * whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


class _Language:
    """What a task has seen of one language: sums for pairs of sources, and the best terms of each source."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], kept: int) -> None:
        self.lang, self.sources, self.kept = lang, sources, kept
        self.place = {s: i for i, s in enumerate(sources)}
        self.whole = np.array(totals, np.int64) + 2 * kept
        self.all = int(sum(totals)) + 2 * kept
        self.pairs: np.ndarray | None = np.zeros((len(sources), len(sources)), np.int64) if len(sources) ** 2 <= TILE else None
        self.best: dict[int, list[tuple[int, bytes]]] = {}

    def see(self, terms: list[bytes], source: np.ndarray, leaf: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
        """Take in a block, by tiles of sources, so that no matrix is larger than TILE; sums of pairs that can't be kept are given at once."""
        n, many = len(terms), len(self.sources)
        if not n:
            return
        step = max(1, TILE // n)
        q = share(np.bincount(leaf, count, n).astype(np.int64) if count.sum() < 1 << 53 else _exact_sums(leaf, count, n), self.all)

        def tile(lo: int) -> tuple[np.ndarray, np.ndarray]:
            hi = min(lo + step, many)
            counts = np.zeros((hi - lo, n), np.int64)
            own = (source >= lo) & (source < hi)
            counts[source[own] - lo, leaf[own]] = count[own]
            return counts, share(counts, self.whole[lo:hi, None])

        for lo in range(0, many, step):
            counts, p = tile(lo)
            value = np.where((counts > 0) & (p > q), apart(p, q), -1)
            for k, row in enumerate(value):
                top = np.argsort(-row, kind="stable")[:RANKS]
                found = [(int(row[i]), terms[i]) for i in top if row[i] >= 0]
                if found:
                    old = self.best.get(lo + k, [])
                    self.best[lo + k] = sorted(old + found, key=lambda x: (-x[0], x[1]))[:RANKS]
            for other in range(lo, many, step):
                r = p if other == lo else tile(other)[1]
                for k in range(len(p)):
                    sums = apart(p[k], r).sum(axis=1)
                    if self.pairs is not None:
                        self.pairs[lo + k, other : other + len(r)] += sums
                    else:
                        yield from self._rows(lo + k, other, sums)

    def _rows(self, a: int, other: int, sums: np.ndarray) -> Iterator[tuple]:
        for j, value in enumerate(sums.tolist(), other):
            if j > a:
                for x, y in ((a, j), (j, a)):
                    yield self.lang, self.sources[x], "pair", self.sources[y].encode(), value

    def rest(self) -> Iterator[tuple]:
        if self.pairs is not None:
            for a in range(len(self.sources)):
                yield from self._rows(a, 0, self.pairs[a])
        for k, found in self.best.items():
            for value, term in found:
                yield self.lang, self.sources[k], "term", term, value


def _exact_sums(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, count)
    return out


def _traverse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
    now: _Language | None = None
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return made

    def gather(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        for row in found:
            rows.append(row)
            if len(rows) == 1 << 14:
                yield out()

    for batch in batches:
        for k in range(batch.num_rows):
            lang, terms, names, leaf, name, count, kept, sources, totals = (batch.column(i)[k] for i in range(9))
            if now is None or now.lang != lang.as_py():
                if now is not None:
                    yield from gather(now.rest())
                now = _Language(lang.as_py(), sources.as_py(), totals.as_py(), kept.as_py())
            places = np.array([now.place[s] for s in names.as_py()], np.int64)
            one = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (leaf, name, count)]
            yield from gather(now.see(terms.as_py(), places[one[1]], one[0], one[2]))
    if now is not None:
        yield from gather(now.rest())
    if rows:
        yield out()


def divergence(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart.

    Part ``pair``: every other source of the language, with the divergence summed over all kept terms
    (0 where none is kept). Part ``term``: the first ``ranks`` terms of the source that are more frequent
    in it than in its language (at most 10). Ranks count from 1 by descending value, ties by the bytes of the item.

    Null text, lang and source count as empty; an empty text has no terms but its group occurs; repeated
    rows count each; very long texts are counted whole; other columns are harmless; an empty table gives no rows.
    The work on pairs grows with the square of the number of a language's sources, as the result does."""
    if ranks > RANKS:
        raise ValueError(f"at most {RANKS} ranks")
    prepare(docs.sparkSession)
    texts = picked(docs, "text", "lang", "source").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    leaves = stored(texts.mapInArrow(_count, _LEAVES), "divergence-leaves")
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    blocks = stored(ranged.mapInArrow(lambda batches: _merge(batches, least_documents), _BLOCKS), "divergence-blocks")
    sums = blocks.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.sums").alias("n"))
    by_lang = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("x"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("kept"))
    totals = stored(by_lang.join(kept, "lang").select("lang", "kept", F.col("x.source").alias("sources"), F.col("x.n").alias("totals")), "divergence-totals")
    joined = blocks.join(totals, "lang").select("lang", "terms", "names", "leaf", "name", "count", "kept", "sources", "totals")
    found = joined.mapInArrow(_traverse, _FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("item", F.col("item").cast("string")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
