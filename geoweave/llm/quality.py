"""Quality rules: compression bands.

A document is rejected where its zstandard ratio (bytes in over bytes out), taken over
the whole text or over any fixed chunk of it, leaves the band for its length. Repetitive
text compresses too well, noise and key dumps too badly; how well ordinary text
compresses depends on its length and on the corpus, so every length class has its own limits,
and they are taken from the corpus at hand: all different texts that pass the base rules are
counted by length class and logarithm of the ratio, and a limit lies ``WIDTH`` robust deviations
from the median. Half of the texts may be odd before the quartiles follow them.

Defined results: a null or empty text has no words, fails the base rule and is not kept;
repeated rows give equal rows; ``doc_id`` may be null; an empty table gives no rows. Corpora of a few
texts have the wide limits of ``UNFITTED``. Two passes, one shuffle of short rows; memory is that of one document.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import as_bytes, passed_through, per_document, picked, prepare

LEVEL = 3
#: Bytes of a chunk; a shorter last chunk is judged by the band of its own length.
CHUNK = 4096
#: Limits lie so many deviations (quartile distance over 1.349, at least ``SPREAD``, of the ratio's logarithm) from the median.
WIDTH, SPREAD = 5.0, 0.025
#: Texts that a length class needs for limits of its own; classes with fewer take their neighbours in, up to three on either side.
LEAST_TEXTS = 200
#: Upper ends, in bytes, of the length classes: half octaves.
CLASSES = tuple(2 ** (k / 2) for k in range(1, 81))
#: Steps of the logarithm of the ratio in which texts are counted.
STEP = 0.002
#: Limits that hold in any corpus, and alone for classes that even their neighbours don't fill. Base64 in words has at most 1.25 at 700 bytes
#: and 1.38 at any length, below what text in letters has.
UNFITTED = ((256, 1.10, 6.0), (724, 1.25, 6.0), (float("inf"), 1.39, 6.0))
#: (bytes below which the band holds, least ratio, greatest ratio), by half octaves: narrow limits for one text alone, without a corpus.
#: They lie outside the extremes of the 20,149 synthetic documents labelled good (scale 0.1 and the check tool's smaller set) that pass
#: the base rules, whole and in chunks, and reject many other texts; corpora are judged by :func:`fit_bands`.
BANDS: tuple[tuple[float, float, float], ...] = (
    (256, 1.10, 2.60),
    (362, 1.28, 1.78),
    (512, 1.32, 1.93),
    (724, 1.38, 1.96),
    (1024, 1.48, 2.06),
    (1448, 1.60, 2.11),
    (2048, 1.70, 2.19),
    (2896, 1.78, 2.23),
    (4096, 1.90, 2.26),
    (5793, 1.92, 2.33),
    (8192, 2.02, 2.39),
    (11585, 2.08, 2.43),
    (16384, 2.12, 2.48),
    (23170, 2.22, 2.54),
    (32768, 2.22, 2.60),
    (65536, 2.24, 2.80),
    (float("inf"), 2.24, 4.0),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"


def band(size: int, bands: Sequence[tuple[float, float, float]] = BANDS) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if size < below)


def compression_ratio(data: bytes, level: int = LEVEL) -> float:
    import zstandard

    return len(data) / len(zstandard.ZstdCompressor(level=level).compress(data)) if data else 0.0


def within_bands(data: bytes, chunk: int = CHUNK, bands: Sequence[tuple[float, float, float]] = BANDS, level: int = LEVEL) -> tuple[bool, float, float, float]:
    """(accepted, ratio of the whole, least and greatest ratio of a chunk).

    A last chunk under a quarter of ``chunk`` bytes is joined to the one before it."""
    if not data:
        return False, 0.0, 0.0, 0.0
    whole = compression_ratio(data, level)
    low, high = band(len(data), bands)
    good = low <= whole <= high
    if len(data) <= chunk:
        return good, whole, whole, whole
    ratios = []
    for piece in pieces(data, chunk)[1:]:
        ratios.append(r := compression_ratio(piece, level))
        low, high = band(len(piece), bands)
        good = good and low <= r <= high
    return good, whole, min(ratios), max(ratios)


def pieces(data: bytes, chunk: int = CHUNK) -> list[bytes]:
    """What is judged of a text: the whole, and its chunks where it is longer than one."""
    if len(data) <= chunk:
        return [data]
    edges = [*range(0, len(data), chunk), len(data)]
    if edges[-1] - edges[-2] < chunk // 4:
        del edges[-2]
    return [data, *(data[a:b] for a, b in zip(edges, edges[1:]))]


def limits(counts: dict[int, dict[int, int]]) -> tuple[tuple[float, float, float], ...]:
    """Bands from counts of texts by length class and step of the ratio's logarithm."""
    out: list[tuple[float, float, float]] = []
    for k in range(max(counts, default=-1) + 1):
        floor, ceiling = next((low, high) for below, low, high in UNFITTED if CLASSES[k] <= below * 1.001)
        for reach in range(4):
            pool: Counter = Counter()
            for j in range(k - reach, k + reach + 1):
                pool.update(counts.get(j, {}))
            n = sum(pool.values())
            if n >= LEAST_TEXTS:
                at: list[float] = []
                upto = 0
                for step in sorted(pool):
                    upto += pool[step]
                    while len(at) < 3 and upto >= (len(at) + 1) / 4 * n:
                        at.append((step + 0.5) * STEP)
                spread = max((at[2] - at[0]) / 1.349, SPREAD)
                floor, ceiling = max(floor, math.exp(at[1] - WIDTH * spread)), min(ceiling, math.exp(at[1] + WIDTH * spread))
                break
        out.append((CLASSES[k], floor, ceiling))
    last = out[-1][0] if out else 0.0
    return (*out, *(u for u in UNFITTED if u[0] > last))


def fit_bands(docs: DataFrame, chunk: int = CHUNK) -> tuple[tuple[float, float, float], ...]:
    """The bands of a corpus: all texts that pass the base rules, equal ones once, and their chunks.

    Texts are counted where they lie; what comes to the driver is a table of length classes and steps, whose size doesn't follow the corpus."""
    from xxhash import xxh64_intdigest

    prepare(docs.sparkSession)
    schema = pa.schema([("class", pa.int32()), ("step", pa.int32()), ("text", pa.int64()), ("part", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(0)):
                if data and not base_failed(statistics(data)):
                    key = xxh64_intdigest(data) - (1 << 63)
                    for i, piece in enumerate(pieces(data, chunk)):
                        rows.append((bisect_right(CLASSES, len(piece)), math.floor(math.log(compression_ratio(piece)) / STEP), key, i))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    found = picked(docs, "text").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "class int, step int, text long, part int")
    table = found.distinct().groupBy("class", "step").agg(F.count("*").alias("n")).collect()
    counts: dict[int, dict[int, int]] = {}
    for r in table:
        counts.setdefault(r["class"], {})[r.step] = r.n
    return limits(counts)


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def statistics(data: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 text."""
    data = data or b""
    words = data.split()
    packed = b"".join(words)
    chars = len(packed.decode("utf-8")) if not packed.isascii() else len(packed)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(words)


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


def judge(data: bytes | None, chunk: int = CHUNK, bands: Sequence[tuple[float, float, float]] = BANDS) -> tuple:
    n_words, chars, symbols, dup_lines, repeats = counts = statistics(data)
    failed = base_failed(counts)
    accepted, whole, least, most = within_bands(data or b"", chunk, bands)
    return n_words, chars, symbols, dup_lines, repeats, failed, not failed and accepted, whole, least, most


def quality(docs: DataFrame, chunk: int = CHUNK, bands: Sequence[tuple[float, float, float]] | None = None) -> DataFrame:
    """One row for each document: the base counts, the verdict and the ratios behind it. Without ``bands`` those of these documents hold."""
    bands = tuple(tuple(b) for b in (fit_bands(docs, chunk) if bands is None else bands))
    return per_document(
        docs,
        lambda i, t: (i, *judge(t, chunk, bands)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, least_chunk_ratio double, greatest_chunk_ratio double",
        raw=True,
    )


def keep_good(docs: DataFrame, chunk: int = CHUNK, bands: Sequence[tuple[float, float, float]] | None = None) -> DataFrame:
    """The documents that :func:`quality` keeps, all columns as they were.

    Null, empty and blank texts go with the base rule; rows that agree are judged alike, so all or
    none of them stay; a null ``doc_id`` or other columns, of any name and type, have no say; an empty
    table stays empty."""
    bands = tuple(tuple(b) for b in (fit_bands(docs, chunk) if bands is None else bands))

    def run(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t, chunk, bands)[6] for t in as_bytes(batch.column(at))], pa.bool_()))

    return passed_through(docs, run, "text")
