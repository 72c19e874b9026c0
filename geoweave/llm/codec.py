"""Token-id files: an adaptive context-mixing range coder.

**Predictions.** Three orders predict the next id:

* *order 2*: the id that followed the last two ids when they last stood in the block; where none
  has held yet, the id that followed the last one alone;
* *order 1*: the frequencies of the ids behind the class of the last id;
* *order 0*: the frequencies of the ids.

An id's probability is the sum of what the three give it, by shares that are learnt in the block:
after every id each order's share moves towards its part in the probability that the id had. The
share of order 2 mixes two estimates, one for the confidence of the prediction (0 to 3, growing
with every success), its source and the last two outcomes, one for all together; the evidence behind the first
decides how much it counts. The rest is divided between orders 1 and 0. The mixture's cumulative
frequency at an id is the same sum of the orders' own, so an id is one interval of the coder, and
the decoder finds it by bisection.

**Blocks.** Ids are cut into blocks of a fixed length. Every block starts from empty tables,
even shares and a new coder, and carries the CRC-32 of its ids. What all blocks start with is
in the head of the frame: the ids by falling frequency, the classes (ids with like successors,
found by k-means), and the frequencies behind each class. As blocks are independent, many are
coded in lockstep: each step handles one id of every block with array operations.

**Frame** (one row of the container, whole documents): little-endian

    magic 8s | documents u64 | ids u64 | block length u32 | slots of order 2 u32 | blocks u32 | ranks u32 | classes u32 | pairs u32 | bytes of the tables u32 | crc32 of all else u32
    doc ids i64[documents] | null flags u8[documents] | lengths u64[documents]
    ids by falling frequency u32[ranks] | words of each block u32[blocks] | crc32 of each block u32[blocks]
    tables (zstandard): weights of the ranks u8[ranks] | class of each rank u8[ranks] | pairs of each class u32[classes]
        | ranks of a class as differences u32[pairs], by byte planes | their weights u8[pairs]
    words of the blocks u16[...]

Weights are quarter octaves of counts. Coder: the low end and the width of the interval, the
width kept from 2**32 to 2**48, so that divisions are exact in double precision; frequencies have a
total of 2**30, shares included; 16-bit words leave at the top, and carries are added to the earlier words at the end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

MAGIC = b"GWTOKEN4"
_HEAD = struct.Struct("<8sQQIIIIIIII")
BLOCK = 2048
#: Slots of a block's order-2 table, a power of two; one slot means no order 2.
SLOTS = 2048
#: Bits of the mixture's total, and least bits in it for the total of one order; the shares have the rest.
_TOTAL = 30
_ORDER = 18
_WEIGHTS = 128
#: Entries of order 1's cumulative frequencies in memory; many ids leave room for fewer classes.
_DENSE = 1 << 23
#: Greatest number of classes, ids for each of them, and pairs of a class with a weight of their own.
CLASSES = 128
IDS_PER_CLASS = 1 << 13
LISTED = 1 << 12
#: Blocks coded in lockstep.
LANES = 4096
_CHANCE = 1 / 64  # where shares of order 2 start
_ASKED = np.int32(63)  # the bits of a state that count how often it was asked
_KEEP = 1 << 32
_WHOLE = 1 << 48


def _bucket(rank: np.ndarray) -> np.ndarray:
    """Bucket of a rank: ranks 0-3 alone, then four buckets for each doubling."""
    x = rank.astype(np.int64) + 4
    e = np.frexp(x.astype(np.float64))[1] - 1
    return (e - 2) * 4 + (x >> (e - 2)) - 4


_B = np.arange(_WEIGHTS)
_FIRST = ((4 + _B % 4).astype(np.int64) << np.minimum(_B // 4, 40)) - 4  # least rank, or count less one, of a bucket


def _frequencies(weights: np.ndarray, total: int) -> np.ndarray:
    """Integers from 1 with the given sum, in proportion to the counts that weights stand for."""
    n = _FIRST[weights] + 1
    whole = int(n.sum())
    room = total - len(n)
    freq = 1 + (n.astype(object) * room // whole if whole > 1 << 32 else n * room // whole).astype(np.int64)
    freq[np.argmax(freq)] += total - int(freq.sum())
    return freq


class Tables:
    """What all blocks of a frame start with: order 0 and order 1 by class."""

    def __init__(self, counts: np.ndarray, class_of: np.ndarray, listed: np.ndarray, symbols: np.ndarray, weights: np.ndarray):
        self.counts, self.class_of, self.listed, self.symbols, self.weights = counts, class_of, listed, symbols, weights
        n, classes = len(counts), len(listed)
        self.bits = max(_ORDER, n.bit_length() + 1)
        if self.bits > _TOTAL - 4:
            raise ValueError("too many different ids for one frame")
        self.levels = max(1, (n - 1).bit_length())
        #: Cumulative frequencies at every rank, the whole beyond the last; of all ids, and behind each class, row by row.
        self.row = (1 << self.levels) + 1
        self.zero = np.full(self.row, 1 << self.bits, np.int32)
        self.zero[:n] = np.cumsum(freq := _frequencies(counts, 1 << self.bits)) - freq
        self.one = np.empty(classes * self.row, np.int32)
        ends = np.cumsum(listed)
        for c, (e, k) in enumerate(zip(ends.tolist(), listed.tolist())):
            held = np.zeros(self.row, np.int32)
            if k:
                held[symbols[e - k : e] + 1] = _frequencies(weights[e - k : e], 1 << self.bits)
            self.one[c * self.row : (c + 1) * self.row] = np.cumsum(held) if k else self.zero
        self.row_of = class_of.astype(np.int64) * self.row

    @classmethod
    def of(cls, ranks: np.ndarray, block: int, n_ranks: int, classes: int, counts: np.ndarray | None = None) -> Tables:
        if counts is None:
            counts = np.bincount(ranks, minlength=n_ranks)
        before = np.concatenate([np.zeros(1, ranks.dtype), ranks[:-1]])
        before[::block] = 0  # a block doesn't know the id before it
        class_of = _classes(before, ranks, counts, min(classes, _DENSE // n_ranks))
        classes = int(class_of.max()) + 1 if len(class_of) else 1
        key = class_of[before].astype(np.int32 if classes * n_ranks < 1 << 31 else np.int64) * n_ranks + ranks.astype(np.int32 if n_ranks < 1 << 31 else np.int64)
        n = np.bincount(key, minlength=classes * n_ranks)
        pairs = np.flatnonzero(n > 1)
        n = n[pairs]
        of, symbol = pairs // n_ranks, pairs % n_ranks
        if n_ranks > LISTED:  # else no class has more pairs
            order = np.lexsort((symbol, -n, of))
            starts = np.searchsorted(of, np.arange(classes))
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of)) - starts[of[order]]
            chosen = place < LISTED
            of, symbol, n = of[chosen], symbol[chosen], n[chosen]
        weights = _bucket(np.maximum(counts, 1) - 1).astype(np.uint8)
        return cls(weights, class_of, np.bincount(of, minlength=classes), symbol, _bucket(n - 1).astype(np.uint8))

    def to_bytes(self) -> bytes:
        import zstandard

        ends = np.cumsum(self.listed)
        steps = np.diff(self.symbols, prepend=0)
        first = (ends - self.listed)[self.listed > 0]
        steps[first] = self.symbols[first]
        parts = [self.counts.astype("u1"), self.class_of.astype("u1"), self.listed.astype("<u4"), steps.astype("<u4").view(np.uint8).reshape(-1, 4).T, self.weights.astype("u1")]
        return zstandard.ZstdCompressor(level=9).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def from_bytes(cls, data: bytes, ranks: int, classes: int, pairs: int) -> Tables:
        import zstandard

        size = 2 * ranks + 4 * classes + 5 * pairs
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        if len(raw) != size:
            raise ValueError("the tables of the frame are damaged")
        counts, class_of = np.frombuffer(raw, "u1", ranks), np.frombuffer(raw, "u1", ranks, ranks)
        at = 2 * ranks
        listed = np.frombuffer(raw, "<u4", classes, at).astype(np.int64)
        steps = np.frombuffer(raw, "u1", 4 * pairs, at + 4 * classes).reshape(4, pairs).T.copy().view("<u4").reshape(-1).astype(np.int64)
        weights = np.frombuffer(raw, "u1", pairs, at + 4 * classes + 4 * pairs)
        if listed.sum() != pairs or len(class_of) and class_of.max() >= classes:
            raise ValueError("the tables of the frame are damaged")
        symbols = np.cumsum(steps)
        first = np.cumsum(listed) - listed
        base = np.where(listed > 0, symbols[np.minimum(first, max(0, pairs - 1))] - steps[np.minimum(first, max(0, pairs - 1))], 0) if pairs else np.zeros(classes, np.int64)
        return cls(counts.astype(np.int64), class_of, listed, symbols - np.repeat(base, listed), weights.astype(np.int64))


def _classes(before: np.ndarray, ranks: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """A class for each rank: ranks with like successors, by k-means from the most frequent ones. Rare ranks are in class 0."""
    n = len(counts)
    out = np.zeros(n, np.uint8)
    rows = min(n, LISTED, int(np.count_nonzero(counts >= 16)))
    classes = min(classes, rows)
    if classes < 2:
        return out
    column = np.arange(n)
    column[96:] = 96 + column[96:] % 32
    key = np.minimum(before, rows).astype(np.int64)
    key <<= 7
    key += column[ranks]
    x = np.bincount(key, minlength=(rows + 1) * 128)[: rows * 128].reshape(rows, 128).astype(np.float32)
    del key
    x = np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))
    weight = counts[:rows].astype(np.float32)
    centres = x[:classes].copy()
    for _ in range(8):
        label = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        member = np.zeros((classes, rows), np.float32)
        member[label, np.arange(rows)] = weight
        held = member.sum(axis=1)
        centres[held > 0] = (member @ x)[held > 0] / held[held > 0, None]
    out[:rows] = np.unique(label, return_inverse=True)[1]
    return out


class _Model:
    """What many blocks learn, all at once; the same steps in both directions.

    Numbers are no wider than they must be, as most of the time goes into passes over the lanes. Shares are
    single-precision: both directions take the same operations, each rounded alike on every machine."""

    def __init__(self, lanes: int, tables: Tables, slots: int):
        ranks = len(tables.counts)
        self.tables, self.shares = tables, 1 << _TOTAL - tables.bits
        self.kind = np.uint16 if ranks <= 1 << 14 else np.uint32
        lane = np.arange(lanes, dtype=np.int64)
        #: Behind two ids, and behind the last one alone: an id and its confidence in the last 2 bits.
        self.table, self.row, self.shift = np.zeros(2 * lanes * slots, self.kind), np.arange(2 * lanes, dtype=np.int64) * slots, np.uint32(33 - slots.bit_length())
        self.hashes, self.held = np.zeros((2, lanes), np.uint32), slots > 1
        #: Share of order 2, with how often it was asked in its last 6 bits; by source, confidence and last two outcomes.
        self.states, self.state_row = np.full(lanes * 32, _CHANCE, np.float32).view(np.int32) & ~_ASKED, lane * 32
        self.pooled = np.full(lanes, _CHANCE, np.float32)
        self.of_one = np.full(lanes, 0.75, np.float32)  # order 1's part of the rest
        self.last = np.zeros(lanes, np.uint8)
        self.b = np.zeros(lanes, np.uint32)
        self.behind = tables.row_of[self.b]

    def predict(self) -> None:
        """Order 2's id and the shares of the orders; that of order 2 times its whole frequency."""
        of_two, of_last = self.hashes
        np.bitwise_xor(of_last, self.b * np.uint32(2246822519), out=of_two)  # until here, that of the id before the last
        np.multiply(self.b, np.uint32(2654435761), out=of_last)
        self.at = (self.hashes >> self.shift).reshape(-1).astype(np.int64)
        self.at += self.row
        self.values = self.table.take(self.at).reshape(2, -1)
        alone = self.values[0] & 3 == 0
        value = self.values[0].copy()
        np.putmask(value, alone, self.values[1])
        self.guess = value >> 2
        state = (value & 3).astype(np.uint8)
        state += state  # numpy adds bytes faster than it shifts them
        state += state
        state |= np.negative(alone.view(np.uint8)) & 16
        state |= self.last
        self.state_at = state.astype(np.int64)
        self.state_at += self.state_row
        held = self.states.take(self.state_at)
        self.chance, self.seen = held.view(np.float32), held & _ASKED
        self.asked = self.seen.astype(np.float32)
        mixed = self.chance - self.pooled
        mixed *= self.asked / (self.asked + np.float32(3))  # what the context has seen against all contexts
        mixed += self.pooled
        mixed *= np.float32(self.shares - 3)
        two = mixed.astype(np.int32)
        two += 1
        rest = self.shares - two
        self.one = ((rest - 2).astype(np.float32) * self.of_one).astype(np.int32)
        self.one += 1
        self.zero = rest - self.one
        self.two = two << self.tables.bits

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's rank in the mixture."""
        t = self.tables
        at = self.behind + rank
        begin1, begin0 = t.one.take(at), t.zero.take(rank)
        self.from_one = t.one[1:].take(at)
        self.from_one -= begin1
        self.from_one *= self.one
        size0 = t.zero[1:].take(rank)
        size0 -= begin0
        size0 *= self.zero
        self.rest = self.from_one + size0
        self.kept = rank.astype(self.kind)
        self.hit = self.guess == self.kept
        self.given = self.two * self.hit
        begin1 *= self.one
        begin0 *= self.zero
        begin1 += begin0
        begin1 += self.two * (self.guess < self.kept)
        self.size = self.rest + self.given
        return begin1, self.size

    def find(self, target: np.ndarray) -> np.ndarray:
        """The rank whose interval holds the target, on each lane."""
        t = self.tables
        guess = self.guess.astype(np.int64)
        at = self.behind + guess
        low = self.one * t.one.take(at) + self.zero * t.zero.take(guess)
        high = self.one * t.one[1:].take(at) + self.zero * t.zero[1:].take(guess) + self.two
        above = target >= high
        other = (target < low) | above
        target = (target - self.two * above).astype(np.int32)
        if 2 * np.count_nonzero(other) > len(other):
            return np.where(other, self._bisect(target, self.one, self.zero, self.behind), guess)
        other = np.flatnonzero(other)
        guess[other] = self._bisect(target[other], self.one[other], self.zero[other], self.behind[other])
        return guess

    def _bisect(self, target: np.ndarray, one: np.ndarray, zero: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The last rank that orders 1 and 0 begin at the target or before it."""
        t = self.tables
        found, at = np.zeros(len(target), np.int64), behind.copy()
        for level in range(t.levels - 1, -1, -1):
            begin = t.one[1 << level :].take(at)
            begin *= one
            begin0 = t.zero[1 << level :].take(found)
            begin0 *= zero
            begin += begin0
            step = (begin <= target).astype(np.int64)
            step <<= level
            found += step
            at += step
        return found

    def learn(self, rank: np.ndarray) -> None:
        """Shares move by what each order gave the rank of the last :meth:`interval`."""
        hit = self.hit
        if self.held:
            fresh = self.kept << 2
            same = self.values | 3
            right = same == fresh | 3
            self.values += 1
            np.minimum(same, self.values, out=same)  # confidence grows to 3
            same &= 3
            same *= right.view(np.uint8)
            same |= fresh
            self.table[self.at] = same.reshape(-1)
        target = self.given.astype(np.float32)
        target /= self.size.astype(np.float32)
        move = target - self.chance
        move /= self.asked + np.float32(1.5)
        move += self.chance
        state = move.view(np.int32)
        state &= ~_ASKED
        state |= np.minimum(self.seen + np.int32(1), np.int32(62))
        self.states[self.state_at] = state
        self.pooled += (target - self.pooled) * np.float32(1 / 32)
        share = self.from_one.astype(np.float32)
        share /= self.rest.astype(np.float32)
        share -= self.of_one
        np.subtract(np.float32(1), target, out=target)
        share *= target
        share *= np.float32(1 / 32)
        self.of_one += share
        self.last += self.last
        self.last &= 2
        self.last |= hit.view(np.uint8)
        self.b = rank.astype(np.uint32)
        self.behind = self.tables.row_of.take(rank)


def _encode_lanes(grid: np.ndarray, tables: Tables, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each column of ``grid`` (step, lane) of ranks: (words end to end, words of each)."""
    steps, lanes = grid.shape
    model = _Model(lanes, tables, slots)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, _WHOLE, np.int64)
    out = np.zeros((2 * steps + 8) * lanes, np.uint32)  # an id narrows the width by 31 bits at most
    at = np.arange(lanes)
    for step in range(steps):
        model.predict()
        rank = grid[step].astype(np.int64)
        start, size = model.interval(rank)
        width >>= _TOTAL
        low += width * start.astype(np.int64)
        width *= size.astype(np.int64)
        model.learn(rank)
        # Every lane puts down its word, with the carry into the word before; those that are not short do it again.
        out[at] = low >> 32
        short = (width < _KEEP).astype(np.int64)
        low &= _KEEP - 1 | short - 1
        at += short * lanes
        short <<= 4
        low <<= short
        width <<= short
        while len(short := np.flatnonzero(width < _KEEP)):  # few: of rare ids
            i, held = at[short], low[short]
            out[i] = held >> 32
            at[short] = i + lanes
            low[short] = (held & (_KEEP - 1)) << 16
            width[short] <<= 16
    # One more word lies inside the last interval, whatever is read after it.
    low += _KEEP - 1
    out[at] = low >> 32
    sizes = at // lanes + 1
    most = int(sizes.max())
    words = out[: most * lanes].reshape(most, lanes).T[np.arange(most) < sizes[:, None]]
    del out
    while (over := np.flatnonzero(words >> np.uint32(16))).size:  # a block's first word has no carry
        words[over] &= np.uint32(0xFFFF)
        words[over - 1] += np.uint32(1)
    return words.astype("<u2"), sizes.astype("<u4")


def _decode_lanes(words: np.ndarray, sizes: np.ndarray, steps: int, tables: Tables, slots: int) -> np.ndarray:
    """The grid (step, lane) of ranks that ``_encode_lanes`` got. Past its end a block's words are zero."""
    lanes = len(sizes)
    model = _Model(lanes, tables, slots)
    most = int(sizes.max()) + 4
    spread = np.zeros((lanes, most), np.uint16)
    spread[np.arange(most) < sizes[:, None]] = words
    spread = np.append(np.ascontiguousarray(spread.T).reshape(-1), np.uint16(0))
    end = most * lanes  # behind all words: zero
    at = np.arange(lanes)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | spread[at]
        at += lanes
    width = np.full(lanes, _WHOLE, np.int64)
    grid = np.empty((steps, lanes), model.kind)
    for step in range(steps):
        model.predict()
        width >>= _TOTAL
        # below 2**31: the code is below the width, of which the shift cost a fifth at most
        rank = model.find(np.minimum((code / width).astype(np.int32), np.int32((1 << _TOTAL) - 1)))
        start, size = model.interval(rank)
        code -= width * start.astype(np.int64)
        width *= size.astype(np.int64)
        grid[step] = rank
        model.learn(rank)
        word = spread.take(at, mode="clip").astype(np.int64)
        short = (width < _KEEP).astype(np.int64)
        word &= -short
        at += short * lanes
        short <<= 4
        code <<= short
        code |= word
        width <<= short
        while len(short := np.flatnonzero(width < _KEEP)):  # few: of rare ids
            code[short] = code[short] << 16 | spread.take(at[short], mode="clip")
            at[short] += lanes
            width[short] <<= 16
    return grid


def encode_frame(doc_ids: Sequence[int | None], documents: Sequence[bytes], block: int = BLOCK, classes: int | None = None, slots: int = SLOTS) -> bytes:
    """A frame of whole documents; each has its ids as little-endian unsigned 32-bit integers.

    One of ``classes`` leaves order 1 without a context, one of ``slots`` leaves out order 2."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    lengths = np.array([len(d) // 4 for d in documents], "<u8")
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
        rank_of = np.zeros(len(counts), np.uint32)
        rank_of[order] = np.arange(len(order))
        ranks = rank_of[ids]
        counts = counts[order]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        by = np.argsort(-counts, kind="stable")
        order = values[by].astype("<u4")
        ranks = np.argsort(by).astype(np.uint32)[inverse]
        counts = counts[by]
    block = max(1, min(block, len(ids)))
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[: len(ids)] = ranks
    if classes is None:
        classes = min(CLASSES, len(ids) // IDS_PER_CLASS)
    if len(ids):
        counts[0] += len(padded) - len(ids)
    tables = Tables.of(padded, block, max(1, len(order)), classes, counts if len(ids) else None)
    rows = padded.astype(np.uint16 if len(tables.counts) <= 1 << 14 else np.uint32).reshape(blocks, block)
    coded = [_encode_lanes(np.ascontiguousarray(rows[i : i + LANES].T), tables, slots) for i in range(0, blocks, LANES)]
    sums = np.array([zlib.crc32(ids[i : i + block].tobytes()) for i in range(0, len(ids), block)], "<u4")
    packed = tables.to_bytes()
    rest = b"".join(
        [
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], "u1").tobytes(),
            lengths.tobytes(),
            order.tobytes(),
            b"".join(s.tobytes() for _, s in coded),
            sums.tobytes(),
            packed,
            b"".join(w.tobytes() for w, _ in coded),
        ]
    )
    head = _HEAD.pack(MAGIC, len(documents), len(ids), block, slots, blocks, len(order), len(tables.listed), len(tables.symbols), len(packed), 0)[:-4]
    return head + zlib.crc32(rest, zlib.crc32(head)).to_bytes(4, "little") + rest


def decode_frame(data: bytes) -> tuple[list[int | None], list[bytes]]:
    """The documents of a frame; raises ValueError if a checksum does not hold."""
    if len(data) < _HEAD.size:
        raise ValueError("not a token frame, or a damaged one")
    magic, n_docs, n_ids, block, slots, blocks, ranks, classes, pairs, packed, crc = _HEAD.unpack_from(data)
    rest = memoryview(data)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(rest, zlib.crc32(data[: _HEAD.size - 4])) != crc:
        raise ValueError("not a token frame, or a damaged one")
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(rest, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
    order, sizes, sums = take("<u4", ranks), take("<u4", blocks), take("<u4", blocks)
    tables = Tables.from_bytes(take("u1", packed).tobytes(), max(1, ranks), classes, pairs)
    words = take("<u2", int(sizes.sum()))
    begins = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    parts = [_decode_lanes(words[begins[i] : begins[min(i + LANES, blocks)]], sizes[i : i + LANES].astype(np.int64), block, tables, slots).T for i in range(0, blocks, LANES)]
    grid = np.concatenate(parts).reshape(-1)[:n_ids] if parts else np.empty(0, np.uint32)
    if len(grid) and grid.max() >= ranks:
        raise ValueError("a block of the frame is damaged")
    ids = order[grid]
    for k in range(blocks):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != sums[k]:
            raise ValueError(f"block {k} of the frame is damaged")
    ends = np.cumsum(lengths) * 4
    whole = ids.tobytes()
    return [None if null else int(i) for i, null in zip(doc_ids, nulls)], [whole[e - 4 * n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
