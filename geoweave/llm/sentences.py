"""Substring deduplication with sliding sentence spans.

A text is cut into sentences: behind . ! ? … and their closing quotes where white space
follows, and at line ends. Where ``WINDOW`` words hold no such end, the text is also cut
behind the word of the least CRC-32 among them (winnowing). Every cut follows from at most
``WINDOW`` - 1 words on either side of it, and no two are farther apart than ``WINDOW``
words, so a passage is cut alike wherever it begins, and 50 words of it hold a whole span.
A span starts at every sentence and
holds the next ``RUN`` sentences, and more until it has ``MIN_WORDS`` words; its words, with
ASCII letters in lower case, are hashed. Equal hashes anywhere in the corpus are one
repeated span. The first occurrence, by doc_id and place, stays; a sentence that any later
occurrence covers is removed with the white space behind it.

Hashes of a run are 96 bits wide (two functions), so that even 10**13 spans are expected to hold
less than one false repeat, and pre-aggregated before they are shuffled; the runs are
joined to the repeated hashes only, so no group of occurrences is ever gathered, and a run
that a third of the documents share is a skewed join key that Spark splits.

White space is Unicode's everywhere. Removal is by these pieces of sentences, not by whole
sentences only, where a passage begins or ends inside a sentence without an end of its own.

Defined results: a null text stays null and an empty or blank one as it is; rows that agree in
doc_id and text count as one document and are treated alike; documents without doc_id come
before those with ids from 0 on; of spans that overlap in one document, the later occurrences go; a very long text costs
its length; other columns may have any name and type; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import numbered, place, prepare, size_column, stored, with_texts

RUN = 3
#: More than one common sentence or licence line has.
MIN_WORDS = 20
#: Words of which one at least is followed by a cut. In a passage of 50 words, cuts behind the words 8 to 43
#: don't depend on its surroundings, the first of them stands behind word 15 at the latest, and a span from
#: there ends within MIN_WORDS + WINDOW - 1 (or RUN * WINDOW) words, which is by word 42.
WINDOW = 8

_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[^\S\n]*\n\s*")
_GAP = re.compile(r"\s+")


def _least(keys: list[int], window: int) -> np.ndarray:
    """Places of the least key of every window, the last one among equals."""
    n = len(keys)
    if n < window:
        return np.empty(0, np.int64)
    low = (np.array(keys, np.int64) << 31) + np.arange(n, 0, -1)
    width = 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return np.unique(n - (low & (1 << 31) - 1))


def sentences(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the sentences, white space behind each included; together they are the text."""
    cuts = {m.end() for m in _END.finditer(text)}
    words = text.lower().split()
    ends = [m.end() for m in _GAP.finditer(text)]
    if ends and text[0].isspace():
        del ends[0]
    if len(ends) < len(words):
        ends.append(len(text))
    keys = [0 if e in cuts else (zlib.crc32(w.encode("utf-8")) >> 1) + 1 for w, e in zip(words, ends)]
    cuts.update(ends[i] for i in _least(keys, window).tolist())
    cuts.add(len(text))
    cuts.discard(0)
    edges = sorted(cuts)
    return list(zip([0, *edges], edges))


def _runs(counts: list[int], run: int, min_words: int) -> list[int | None]:
    """Behind which sentence the span that starts at each one ends; None where the text ends before."""
    out: list[int | None] = []
    end = held = 0
    for i, n in enumerate(counts):
        while end < len(counts) and (end - i < run or held < min_words):
            held += counts[end]
            end += 1
        out.append(end if end - i >= run and held >= min_words else None)
        held -= n
    return out


def _cut(text: str, window: int) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """The sentences and the words of each."""
    parts = sentences(text, window)
    return parts, [text[a:b].split() for a, b in parts]


def run_hashes(text: str | None, run: int = RUN, min_words: int = MIN_WORDS, window: int = WINDOW) -> list[tuple[int, int] | None]:
    """Hash of the span that starts at each sentence, as signed integers of 64 and 32 bits; None where there is none."""
    from xxhash import xxh64_intdigest

    words = _cut(text or "", window)[1]
    keys = [" ".join(w).encode("utf-8").lower() for w in words]  # of bytes: ASCII only
    whole = b" ".join(filter(None, keys))
    starts, ends, at = [], [], 0  # of each sentence's words in all words; of one without any, where the next ones start and the last ones end
    for k in keys:
        starts.append(at + (at > 0))
        at += len(k) + (at > 0 and len(k) > 0)
        ends.append(at)
    out: list[tuple[int, int] | None] = []
    for start, end in zip(starts, _runs(list(map(len, words)), run, min_words)):
        if end is None:
            out.append(None)
        else:
            span = whole[start : ends[end - 1]]
            h, check = xxh64_intdigest(span), zlib.crc32(span)
            out.append((h - (1 << 64) if h >> 63 else h, check - (1 << 32) if check >> 31 else check))
    return out


def without(text: str, places: Iterable[int], run: int = RUN, min_words: int = MIN_WORDS, window: int = WINDOW) -> tuple[str, int, list[tuple[int, int]]]:
    """(the text without the spans that start at these sentences, sentences removed, removed spans)."""
    parts, words = _cut(text, window)
    ends = _runs(list(map(len, words)), run, min_words)
    gone = {k for p in places for k in range(p, ends[p] or p)}
    kept, spans = [], []
    for i, (a, b) in enumerate(parts):
        if i not in gone:
            kept.append(text[a:b])
        elif spans and spans[-1][1] == a:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return "".join(kept), len(gone), spans


def _keys(docs: DataFrame) -> list[F.Column]:
    """What tells documents apart: the id, and 32 bits of a hash of id and text for rows of one id.

    Without an id, a hash of the text with the sign bit set stands for it: before all ids from 0 on."""
    id_, text = F.col(f"_{place(docs, 'doc_id')}"), F.col(f"_{place(docs, 'text')}").cast("string")
    return [F.coalesce(id_.cast("long"), F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))).alias("doc"), F.hash(id_, text).alias("key")]


def repeated_places(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc, key, places) of documents with a non-first occurrence: the sentences at which one starts."""
    prepare(docs.sparkSession)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [run_hashes(t, run, min_words, window) for t in batch.column(2).to_pylist()]
            first = pa.array([[h and h[0] for h in x] for x in found], pa.list_(pa.int64()))
            second = pa.array([[h and h[1] for h in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first, second], names=["doc", "key", "hashes", "checks"])

    texts = numbered(docs).select(*_keys(docs), F.col(f"_{place(docs, 'text')}").cast("string").alias("text"))
    held = stored(texts.mapInArrow(hashes, "doc long, key int, hashes array<long>, checks array<int>"), "sentence-runs")
    runs = held.select("doc", "key", F.posexplode(F.arrays_zip("hashes", "checks")).alias("place", "run"))
    runs = runs.select("doc", "key", "place", F.col("run.hashes").alias("hash"), F.col("run.checks").alias("check")).where("hash IS NOT NULL")
    repeated = runs.groupBy("hash", "check").agg(F.count("*").alias("n"), F.min(F.struct("doc", "key", "place")).alias("first")).where("n > 1").select("hash", "check", "first")
    repeated = stored(repeated, "sentence-repeats")  # a side of its own, so that Spark can split a hot hash on the other
    later = runs.join(repeated, ["hash", "check"]).where(F.struct("doc", "key", "place") != F.col("first"))
    return later.groupBy("doc", "key").agg(F.collect_set("place").alias("places"))


def sentence_dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_removed, removed) of every document: the text that stays, how many
    sentences went, and the removed spans of the input text (start:end in code points, comma-joined)."""
    places = repeated_places(docs, run, min_words, window)
    keyed = numbered(docs).select(F.col(f"_{place(docs, 'doc_id')}").cast("long").alias("doc_id"), F.col(f"_{place(docs, 'text')}").cast("string").alias("text"), *_keys(docs))
    joined = keyed.join(places, ["doc", "key"], "left").select("doc_id", "text", "places")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, spans = [], [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, gone, removed = without(text, at, run, min_words, window) if at else (text, 0, [])
                texts.append(left)
                counts.append(gone)
                spans.append(",".join(f"{a}:{b}" for a, b in removed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "text", "n_removed", "removed"])

    return joined.mapInArrow(apply, "doc_id long, text string, n_removed long, removed string")


def drop_repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without later occurrences in ``text``; ``n_chars`` follows where a text changed.

    All documents stay, even if nothing is left of a text (it is then empty); results for odd rows as above."""
    at, size, width = place(docs, "text"), size_column(docs), len(docs.columns)
    places = repeated_places(docs, run, min_words, window)
    joined = numbered(docs).select("*", *_keys(docs)).join(places, ["doc", "key"], "left").select(*(f"_{i}" for i in range(width)), "places")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(width).to_pylist()
            texts = [without(t, p, run, min_words, window)[0] if p else t for t, p in zip(batch.column(at).to_pylist(), starts)]
            yield with_texts(list(batch.columns[:width]), at, size, texts, map(bool, starts))

    return joined.mapInArrow(apply, numbered(docs).schema).toDF(*docs.columns)
