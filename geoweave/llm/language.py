"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the whole text (lower case, runs of anything
but letters as one space), weighted by relative frequency times inverse document frequency.
Document frequencies cover all learning documents. The regression is fitted by
follow-the-regularised-leader-proximal with L1 and L2 penalties on a sample of labelled
documents that is bounded by ``SAMPLE`` rows (twice that at most, by the chance of the draw)
and the ``GRAMS`` most frequent n-grams of each, shared equally among the languages and drawn
by a hash of doc_id; a fifth of the sample is held back to calibrate the temperature.
The model is a table of BUCKETS x languages, whatever the corpus.

Learned from: rows whose crc32(doc_id as text) mod 5 isn't 0 and whose lang isn't null.
Predicted from: the text alone.

Defined results: a null text and one without letters give ``und`` with score 0, as does
every text if there is nothing to learn from; ties go to the language first in order; a null
doc_id counts as held out; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import per_document, picked, prepare

BUCKETS = 1 << 16
SAMPLE = 3000
#: Most frequent n-grams of a sampled row that the fit sees; with ``SAMPLE``, the bound of what the driver holds.
GRAMS = 4096
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
#: Brings mean feature values near one.
_SCALE = 40.0
_STEP = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, in parts of bounded size; nothing for a text without letters."""
    if not text:
        return
    letters = _letters()
    edge = np.array([32], np.uint32)  # what the part before ended with
    for i in range(0, len(text), _STEP):
        codes = np.frombuffer(text[i : i + _STEP].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        tail = [32] if i + _STEP >= len(text) else []
        codes = np.concatenate([edge, np.where(letters[codes], codes, np.uint32(32)), np.array(tail, np.uint32)])
        space = codes == 32
        codes = codes[np.r_[True, ~(space[1:] & space[:-1])]]
        old = min(len(edge), len(codes))
        edge = codes[-2:]
        if space.all():
            continue
        a = codes * np.uint32(0x9E3779B1)
        b = a[1:] ^ (codes[:-1] * np.uint32(0x85EBCA77) + np.uint32(1))
        c = b[1:] ^ (codes[:-2] * np.uint32(0xC2B2AE3D) + np.uint32(2))
        mixed = np.concatenate([a[old:], b[old - 1 :], c[max(0, old - 2) :]])
        yield ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents) over all rows of ``texts`` (text).

    Each task sums its documents and few tasks sum the tasks; the driver gets the last sums."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.uint8), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[:] = 0
                for part in grams(text):
                    seen[part] = 1
                total += seen
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for m, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += np.frombuffer(sums, np.int64)
                n += m
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    rows = texts.mapInArrow(count, "n long, sums binary").repartition(8).mapInArrow(add, "n long, sums binary").collect()
    return sum((np.frombuffer(r.sums, np.int64) for r in rows), np.zeros(BUCKETS, np.int64)), sum(r.n for r in rows)


class Model:
    """Languages in order, and weights (bucket, language) with the document frequencies in them."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights.astype(np.float32), bias, temperature

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for part in grams(text):
            total += self.weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        p = _softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader-proximal for multinomial logistic regression, by coordinate."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = _softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], frequencies: np.ndarray, documents: int) -> Model:
    """Model from (order, lang, buckets, relative frequencies) of a sample; repeatable in any order of the rows."""
    languages = sorted({lang for _, lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + documents) / (1 + frequencies)) + 1
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    place = {lang: i for i, lang in enumerate(languages)}
    learn = [r for i, r in enumerate(rows) if i % 5] or rows
    check = [r for i, r in enumerate(rows) if i % 5 == 0]
    values = lambda r: np.append(r[3] * idf[r[2]] * _SCALE, 1.0)  # noqa: E731  the last feature is the constant
    at = lambda r: np.append(r[2], BUCKETS)
    model = Ftrl(BUCKETS + 1, len(languages))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            r = learn[i]
            if len(r[2]):
                model.step(at(r), values(r), place[r[1]])
    w = model.weights()
    logits = np.array([values(r) @ w[at(r)] for r in check]).reshape(-1, len(languages))
    return Model(languages, w[:-1] * (idf * _SCALE)[:, None], w[-1], _temperature(logits, np.array([place[r[1]] for r in check])))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model on the documents that are not held out and have a lang."""
    prepare(docs.sparkSession)
    rows = picked(docs, "doc_id", "text", "lang").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~_held_out() & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    frequencies, documents = document_frequencies(rows.select("text"))
    share = sample / max(1, len(counts))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int(min(1.0, share / n) * (1 << 30)))) for lang, n in sorted(counts.items())), F.lit(0))

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                parts = list(grams(text))
                at, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
                most = np.sort(np.argsort(-n, kind="stable")[:GRAMS])
                found.append((at[most].astype("<u4").tobytes(), (n[most] / max(1, n.sum())).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["draw", "lang", "at", "share"])

    # The limits leave about ``sample`` rows; the least draws of them are taken where one doc_id has very many rows.
    drawn = rows.select(draw.alias("draw"), "lang", "text").where(F.col("draw") < limits)
    held = drawn.mapInArrow(featurise, "draw long, lang string, at binary, share binary").orderBy("draw", "lang", "at", "share").limit(2 * sample).collect()
    return fit([(r.draw, r.lang, np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r["share"], "<f4").astype(float)) for r in held], frequencies, documents)


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, sample)
    found = per_document(docs, lambda i, t: (i, *model.predict(t)), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
