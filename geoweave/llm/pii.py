"""Personal data by weak supervision.

Strict patterns give base spans. Looser patterns give candidates (written-out e-mail
addresses, national phone numbers, other number groupings, IPv6, identity numbers, titled
or listed names). Five labelers vote on every candidate and base span: the strict pattern,
a checksum, a gazetteer, the words before it, and the characters beside it.

The votes of the whole corpus are counted together with what the classifier sees of a span:
a table bounded by the values of its few small columns and not by the corpus. On it the driver
runs expectation-maximisation from the majority vote on, with a logistic classifier in the place
of a constant prior. What that sees is what no labeler votes on: by
kind, the span's own characters (digits, length, signs) and what stands behind it, and a hash of
the word before. Every round fits it to the present probabilities and estimates anew how reliable
each labeler is; a span's log-odds are the classifier's plus those of its votes. So spans that
get the same votes are told apart by the company they keep, and spans that look alike by their
votes. A second pass over the texts adds the candidates that are accepted; base spans always stay.
No shuffle but that of the small counts.

Defined results: a null text is empty; repeated rows give equal rows; ``doc_id`` may be
null; of candidates that overlap, the first and longest counts; a very long text costs its
length; other columns may have any name and type; an empty table or one without candidates adds
nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import per_document, picked, prepare, replace_texts

KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "checksum", "gazetteer", "context", "neighbours")
#: Probability from which the classifier's candidates are added.
ACCEPT = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MARKED = r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?"
# Behind a plain " at " a dot with white space behind it only is the end of a sentence.
_SPELLED = re.compile(
    rf"[A-Za-z0-9._%+-]{{1,64}}(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}(?:(?:{_MARKED}|\x20?\.\x20?)[A-Za-z0-9-]{{1,63}}){{1,6}}"
    rf"|\x20{{1,2}}at\x20{{1,2}}[A-Za-z0-9-]{{1,63}}(?:(?:{_MARKED}|\.|\x20\.\x20?)[A-Za-z0-9-]{{1,63}}){{1,6}})",
    re.I | re.A,
)
#: What every written-out address holds.
_AT = re.compile(rf"(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}(?:{_MARKED}|\x20?\.\x20?)[A-Za-z0-9-]", re.I | re.A)
_NATIONAL = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])|(?<![0-9A-Za-z])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Fixed values of the gazetteers: the generic top-level domains (RFC 920 and 1591, and those added until 2011);
# country codes are two letters. Frequent given names of English, German, French and Spanish birth registers.
GENERIC_DOMAINS = frozenset("com org net edu gov mil int arpa info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx io".split())
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa "
    "Hans Peter Klaus Ursula Jürgen Monika Wolfgang Petra Günter Helga Werner Renate Dieter Ingrid Manfred Karin Uwe Sabine Andreas Susanne Stefan Birgit Jens Heike Matthias Anja Markus Katrin Sebastian Julia "
    "Jean Marie Pierre Michel Catherine Nathalie Philippe Isabelle Alain Sylvie Bernard Monique Jacques Françoise Christophe Valérie Nicolas Sophie Laurent Sandrine Julien Céline Antoine Camille "
    "José Antonio Carmen Manuel Francisco Isabel Juan Ana Javier Laura Carlos Cristina Jesús Marta Miguel Lucía Alejandro Elena Rafael Pilar Fernando Dolores Sergio Paula Pablo Rosa".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora")
_CAPITALISED = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]{0,20}")
_PART = re.compile(r"\x20([A-Z][a-zà-ÿ]{1,20})(?![a-zà-ÿ])")
_TITLED = re.compile(r"\.?\x20[A-Z][a-zà-ÿ]{1,20}")
_POSITIVE = re.compile(r"e-?mail|mailto|contact|phone|tel\b|call|mobile|fax|whatsapp|card|visa|mastercard|credit|\bip\b|address|server|host|ssn|social security|name|kontakt|telefon|téléphone|teléfono|karte|carte|tarjeta|correo", re.I)
_NEGATIVE = re.compile(r"isbn|issn|order|invoice|version|total|page|serial|model|article|doi|reference|build", re.I)

#: Hash values of the word before a span.
WORDS = 64
#: What the classifier sees besides kind and votes, and how many values each has.
SEEN = {"shape": 8, "length": 8, "signs": 4, "word": WORDS + 1, "after": 4}
_WORD_BEFORE = re.compile(r"(\w+)\W{0,3}$")

Span = tuple[str, int, int]
Evidence = tuple[int, ...]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards: linear on any text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, m.end() if m else 0))


def base_spans(text: str) -> list[Span]:
    """Spans of the strict patterns, by kind as listed and then start."""
    found: list[Span] = list(emails(text)) if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str) -> list[Span]:
    """Spans of the looser patterns."""
    found: list[Span] = []
    low = text.lower()
    if ("(at)" in low or "[at]" in low or " at " in low) and _AT.search(text):
        found += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    found += [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    found += [("card", m.start(), m.end()) for m in _GROUPED.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 38 and 13 <= len(_digits(m.group())) <= 19:
            found.append(("card", m.start(), m.end()))
    if ":" in text:
        found += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text)]
    found += [("id", m.start(), m.end()) for m in _ID.finditer(text)]
    return found + list(names(text))


def names(text: str) -> Iterator[Span]:
    """A title with two capitalised words, or a given name of the gazetteer with one, whatever stands before them."""
    at = 0
    for m in _CAPITALISED.finditer(text):
        word = m.group()
        if m.start() < at or word not in _FIRST:
            continue
        end = m.end()
        if word in TITLES:
            titled = _TITLED.match(text, end)
            end = titled.end() if titled else -1
        last = _PART.match(text, end) if end >= 0 else None
        if last:
            at = last.end()
            yield "name", m.start(), at


_FIRST = GIVEN_NAMES.union(TITLES)


def evidence(text: str, span: Span, strict: bool) -> Evidence:
    """(kind, the five votes, what else the classifier sees): small integers only. A vote is 1 (personal), -1 (not) or 0."""
    kind, a, b = span
    body = text[a:b]
    digits = _digits(body)
    checksum = gazetteer = 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" or "2221" <= digits[:4] <= "2720" else -1
    elif kind == "ip":
        checksum = 1 if ":" in body or all(map(_small, body.split("."))) else -1
        gazetteer = -1 if body.startswith(("0.", "127.", "255.")) else 0
    elif kind == "email":
        top = re.split(r"[^a-z]+", body.lower())[-1]
        gazetteer = 1 if len(top) == 2 or top in GENERIC_DOMAINS else -1
    elif kind == "phone":
        checksum = 1 if 8 <= len(digits) <= 15 else -1
        gazetteer = 1 if strict or digits[:1] == "0" or "2" <= digits[:1] <= "9" and len(digits) == 10 else -1
    elif kind == "id":
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
    elif kind == "name":
        parts = body.replace(".", "").split()
        gazetteer = 1 if not GIVEN_NAMES.isdisjoint(parts) else 0
        checksum = 1 if parts[0] in TITLES else 0
    before = text[max(0, a - 40) : a]
    context = 1 if _POSITIVE.search(before) else -1 if _NEGATIVE.search(before) else 0
    beside = text[max(0, a - 1) : a] + text[b : b + 1]
    neighbours = -1 if any(c.isalnum() or c in "_=/#" for c in beside) else 1
    shape = min(3, len(digits) // 5) * 2 + (" " in body or "-" in body or "(" in body)
    length = min(7, (b - a) // 4)
    signs = min(3, sum(not c.isalnum() for c in body))
    word = _WORD_BEFORE.search(before)
    before_word = zlib.crc32(word.group(1).lower().encode("utf-8")) % WORDS if word else WORDS
    behind = text[b : b + 1]
    after = 0 if not behind else 1 if behind.isspace() else 2 if behind in ".,;:!?" else 3
    return KINDS.index(kind), 1 if strict else 0, checksum, gazetteer, context, neighbours, shape, length, signs, before_word, after


def spans_and_evidence(text: str) -> list[tuple[Span, Evidence, bool]]:
    """Base spans, then candidates that touch no base span and no earlier candidate."""
    base = base_spans(text)
    out = [(s, evidence(text, s, True), True) for s in base]
    taken = sorted((a, b) for _, a, b in base)
    rest = [c for c in candidates(text)]
    if rest:
        import bisect

        for s in sorted(rest, key=lambda s: (s[1], -s[2])):
            i = bisect.bisect_left(taken, (s[1], s[2]))
            if (i == 0 or taken[i - 1][1] <= s[1]) and (i == len(taken) or taken[i][0] >= s[2]):
                taken.insert(i, (s[1], s[2]))
                out.append((s, evidence(text, s, False), False))
    return out


def count_evidence(docs: DataFrame) -> DataFrame:
    """(evidence columns, n) over all spans of all texts; summed in every batch before the shuffle."""
    prepare(docs.sparkSession)
    names = ["kind", *LABELERS, *SEEN]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(e for _, e, _ in spans_and_evidence(text))
        columns = list(zip(*((*e, n) for e, n in counts.items()))) or [[] for _ in [*names, "n"]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names, "n"])

    counted = picked(docs, "text").select(F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))


class Model:
    """Labeler reliabilities, the evidence of their votes, and the span classifier."""

    def __init__(self, weights: np.ndarray, reliability: np.ndarray):
        self.weights, self.reliability = weights, reliability

    def log_odds(self, e: np.ndarray) -> np.ndarray:
        return self.weights[_features(e)].sum(axis=1) + _evidence_of_votes(self.reliability, e)

    def probability(self, e: Evidence) -> float:
        return float(_logistic(self.log_odds(np.array([e])))[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


_WIDTH = 1 + len(LABELERS) + len(SEEN)
#: Number of the classifier's features: kinds, what is seen of a span by kind, and words whatever the kind.
_N_FEATURES = len(KINDS) * (1 + sum(SEEN.values()) - SEEN["word"]) + SEEN["word"]


def _features(e: np.ndarray) -> np.ndarray:
    """The features that each row has, by number: its kind, each thing seen with its kind, the word before."""
    kind, out, first = e[:, 0], [e[:, 0]], len(KINDS)
    for j, (name, n) in enumerate(SEEN.items()):
        value = e[:, 1 + len(LABELERS) + j]
        if name == "word":
            out.append(first + value)
            first += n
        else:
            out.append(first + kind * n + value)
            first += len(KINDS) * n
    return np.stack(out, axis=1)


def _evidence_of_votes(reliability: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Log-odds of each row's votes, given P(vote | class) as [labeler, class, vote + 1]; 0 for a labeler that abstains."""
    ratio = np.log(reliability[:, 1] / reliability[:, 0])
    ratio[:, 1] = 0
    return sum(ratio[j, e[:, 1 + j] + 1] for j in range(len(LABELERS)))


def _reliability(e: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(vote | class) as [labeler, class, vote + 1] of the labelers that don't abstain (vote 0), with one smoothing count."""
    seen = np.ones((len(LABELERS), 2, 3))
    for j in range(len(LABELERS)):
        seen[j, 1] += np.bincount(e[:, 1 + j] + 1, n * p, 3)
        seen[j, 0] += np.bincount(e[:, 1 + j] + 1, n * (1 - p), 3)
    return seen / (seen[:, :, :1] + seen[:, :, 2:])


def majority(e: np.ndarray) -> np.ndarray:
    return _logistic(1.5 * e[:, 1 : 1 + len(LABELERS)].sum(axis=1))


def expectation_maximisation(e: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each row by its kind and votes alone, reliabilities): what the classifier is compared with."""
    p = majority(e)
    of_kind = 2 + np.bincount(e[:, 0], n, len(KINDS))
    for _ in range(rounds):
        prior = ((1 + np.bincount(e[:, 0], n * p, len(KINDS))) / of_kind)[e[:, 0]]
        reliability = _reliability(e, n, p)
        before, p = p, _logistic(np.log(prior / (1 - prior)) + _evidence_of_votes(reliability, e))
        if np.abs(p - before).max() < 1e-9:
            break
    return p, reliability


def classifier(features: np.ndarray, n: np.ndarray, p: np.ndarray, weights: np.ndarray, penalty: float = 1.0, steps: int = 20) -> np.ndarray:
    """Weights of the penalised logistic regression of ``p`` on the features, by Newton's method from ``weights`` on."""
    width, each = len(weights), features.shape[1]
    pairs = (features[:, :, None] * width + features[:, None, :]).reshape(-1)
    for _ in range(steps):
        q = _logistic(weights[features].sum(axis=1))
        gradient = np.bincount(features.reshape(-1), np.repeat(n * (q - p), each), width) + penalty * weights
        hessian = np.bincount(pairs, np.repeat(n * q * (1 - q), each * each), width * width).reshape(width, width) + penalty * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(rows: list[tuple[int, ...]], rounds: int = 20) -> Model:
    """Model from rows of :func:`count_evidence`; their order has no effect.

    It starts from the majority vote, which leaves ties open for the classifier."""
    if not rows:
        weights = np.zeros(_N_FEATURES)
        weights[: len(KINDS)] = -20.0
        return Model(weights, np.full((len(LABELERS), 2, 3), 1 / 3))
    table = np.array(sorted(rows), dtype=np.int64)
    e, n = table[:, :-1], table[:, -1].astype(float)
    p = majority(e)
    # The classifier can't tell rows with equal features apart: they are one, with the mean of their probabilities.
    features, of = np.unique(_features(e), axis=0, return_inverse=True)
    of = of.reshape(-1)
    held = np.bincount(of, n)
    weights = np.zeros(_N_FEATURES)
    for _ in range(rounds):
        weights = classifier(features, held, np.bincount(of, n * p) / held, weights)
        model = Model(weights, _reliability(e, n, p))
        before, p = p, _logistic(model.log_odds(e))
        if np.abs(p - before).max() < 1e-6:
            break
    return model


def train(docs: DataFrame) -> Model:
    return fit([tuple(r) for r in count_evidence(docs).collect()])  # bounded by the values of the evidence


def find(text: str | None, model: Model, accept: float = ACCEPT, memo: dict | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind as listed and then start."""
    memo = {} if memo is None else memo
    base: list[Span] = []
    added: list[Span] = []
    for span, e, strict in spans_and_evidence(text or ""):
        if strict:
            base.append(span)
        else:
            if e not in memo:
                memo[e] = model.probability(e) >= accept
            if memo[e]:
                added.append(span)
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    model, memo = train(docs), {}

    def row(doc_id, text):
        base, every = find(text, model, accept, memo)
        counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
        return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)

    return per_document(docs, row, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out: list[str] = []
    at = 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents, all columns, with personal data replaced in ``text``; ``n_chars`` follows where a text changed.

    A null text stays null and one without findings as it is; rows that agree change alike; a null
    ``doc_id`` or other columns, of any name and type, have no say; an empty table stays empty."""
    model, memo = train(docs), {}
    return replace_texts(docs, lambda t: redacted(t, find(t, model, accept, memo)[1]))
