"""Secret scans with a recursive decoding worklist.

Every text is scanned as it stands; then its URL-escaped, Unicode-escaped, base64 and
compressed parts are unwrapped into layers, each layer is scanned and unwrapped in turn,
until no layer gives a new one. Text and bytes are layers alike: what base64 or a URL run
hides may be compressed, and what is compressed may be so again. A layer is known by the
digest of its content and the place that it came from, and one seen before is not entered
again, so cycles end, of archives that unpack to themselves too. Every character of a layer
knows the span of the document that it came from, so findings of any depth are reported at
document positions (code points, end exclusive).

Base64 is tried at its four alignments, so a path or name before it does no harm, and lines
of equal length are joined. Bytes that aren't UTF-8 or that hold control characters are
scanned in their readable stretches. Archives are unpacked as streams of ``PART`` bytes, each
scanned with the last ``CARRY`` characters before it, so a bomb costs time but no memory (in
such a stream, a run longer than that is seen in parts).

Defined results: a null text is empty and has no findings; repeated rows give equal rows;
``doc_id`` may be null; findings of one kind and place count once; other columns may have any
name and type; an empty table gives no rows. One pass, no shuffle. Escapes are
unwrapped in windows around them, which reach to the ends of the unbroken runs of value,
base64 and escape characters that they touch, so no edge cuts a match, and the windows of a
text don't overlap: a very long text costs its length.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame

from geoweave.llm.common import per_document

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What a line of joined base64 may hold, and its end.
_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
#: How gzip, zlib, bzip2 and zstandard data begins: as bytes, in base64 and URL-escaped.
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\x28\xb5\x2f\xfd")
_MAGIC64 = re.compile(r"H4sI|eA[EF]|e[FN][47][\w+/-]|eJ[w-z]|eNo|QlpoO?|KLUv")
_MAGIC_URL = re.compile(r"(?i:%1f%8b)|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA])|BZh[0-9]|(?:\(|%28)(?i:%b5)(?:/|%2[fF])(?i:%fd)")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
#: Stretches of a layer of bytes that may hold a finding or base64.
_READABLE = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]{12,}")
_URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: Characters on either side of an escape that its layer holds, so that a keyword or a value beside it is seen.
MARGIN = 96
#: Bytes of an archive that are unpacked at a time, and characters before them that are scanned again.
PART = 1 << 20
CARRY = 1 << 16
#: What a keyword, a value, base64 or an escape is made of; and such runs with signs and spaces between them.
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=%\\&#;{}:\"'-")
_RUNS = re.compile(r"""\x20*+[A-Za-z0-9+/_.=%\\&#;{}:"'-]*+(?:\x20++[:=]\x20*+[A-Za-z0-9+/_.=%\\&#;{}:"'-]*+|(?<=[:=])\x20++[A-Za-z0-9+/_.=%\\&#;{}:"'-]++)*+""")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Base findings: leftmost non-overlapping matches of each kind; matches that fail a length rule are dropped."""
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class _Same(Sequence):
    """One number, ``n`` times."""

    __slots__ = ("n", "value")

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        if isinstance(at, slice):
            return _Same(self.value, len(range(*at.indices(self.n))))
        if not -self.n <= at < self.n:
            raise IndexError(at)
        return self.value

    def __iter__(self) -> Iterator[int]:
        return repeat(self.value, self.n)


class Layer:
    """A text whose character ``i`` came from ``[starts[i], ends[i])`` of the document; neither ever falls."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int]):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


#: Makes the bytes of a layer, part by part, as often as asked.
Stream = Callable[[], Iterable[bytes]]
#: A layer of bytes and the span of the document that it came from.
Packed = tuple[Stream, int, int]


def _run_start(text: str, at: int, least: int) -> int:
    """Where the run that reaches to a place starts, over the spaces beside an assignment sign too."""
    while at > least:
        if text[at - 1] in _RUN:
            at -= 1
            continue
        before = at
        while before > least and text[before - 1] == " ":
            before -= 1
        if before == at or before == least or text[before - 1] not in ":=" and text[at : at + 1] not in (":", "=", " "):
            break
        at = before
    return at


def _windows(text: str, found: list[re.Match]) -> Iterator[tuple[int, int, list[re.Match]]]:
    """Stretches of the text around escapes: a margin, and on to the ends of the runs there; stretches that touch are one."""
    group: list[re.Match] = []
    start = end = 0
    for m in found:
        if group and m.start() <= end:
            group.append(m)
        else:
            low = max(end, m.start() - MARGIN)
            low = _run_start(text, low, end)
            if group and low <= end:
                group.append(m)
            else:
                if group:
                    yield start, end, group
                start, group = low, [m]
        if (edge := min(len(text), m.end() + MARGIN)) > end:
            end = _RUNS.match(text, edge).end()
    if group:
        yield start, end, group


def _percent(part: str) -> str:
    return bytes.fromhex(part.replace("%", "")).decode("utf-8", "replace")


def _escape(part: str) -> str | None:
    digits = part[2:].strip("{};") if part[0] == "\\" else part[2:-1].lstrip("xX")
    code = int(digits, 10 if part[0] == "&" and part[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 else None


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """Layers in which the pattern's matches are decoded and all else stays."""
    for a, b, group in _windows(layer.text, list(pattern.finditer(layer.text))):
        pieces: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at, changed = a, False
        for m in group:
            got = decode(m.group())
            if got is None:
                continue
            changed = True
            pieces.append(layer.text[at : m.start()])
            starts += layer.starts[at : m.start()]
            ends += layer.ends[at : m.start()]
            pieces.append(got)
            first, last = layer.origin(m.start(), m.end())
            starts += [first] * len(got)
            ends += [last] * len(got)
            at = m.end()
        if changed:
            pieces.append(layer.text[at:b])
            starts += layer.starts[at:b]
            ends += layer.ends[at:b]
            text = "".join(pieces)
            if any(0xD800 <= ord(c) < 0xE000 for c in text):
                text, starts, ends = _surrogates(text, starts, ends)
            yield Layer(text, starts, ends)


def _surrogates(text: str, starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """Escaped surrogate pairs become their character; lone ones U+FFFD."""
    out, s, e, i = [], [], [], 0
    while i < len(text):
        pair = text[i : i + 2]
        step = 2 if len(pair) == 2 and "\ud800" <= pair[0] < "\udc00" <= pair[1] < "\ue000" else 1
        c = pair.encode("utf-16", "surrogatepass").decode("utf-16") if step == 2 else "\ufffd" if "\ud800" <= text[i] < "\ue000" else text[i]
        out.append(c)
        s.append(starts[i])
        e.append(ends[i + step - 1])
        i += step
    return "".join(out), s, e


def _inflated(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The content of gzip, zlib, bzip2 or zstandard data in parts, as far as it is sound; nothing of other data."""
    parts = iter(parts)
    head = b""
    for part in parts:
        head += part
        if len(head) >= 4:
            break
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        yield from _zlib(head, parts, 31 if head[:1] == b"\x1f" else 15)
    elif head[:3] == b"BZh":
        yield from _bzip2(head, parts)
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        yield from _zstandard(head, parts)


def _zlib(head: bytes, parts: Iterator[bytes], kind: int) -> Iterator[bytes]:
    unpacker = zlib.decompressobj(kind)
    try:
        while head:
            if out := unpacker.decompress(head, PART):
                yield out
            head = unpacker.unconsumed_tail
            if unpacker.eof:  # another member may follow
                head = unpacker.unused_data
                if head[:2] != b"\x1f\x8b" or kind != 31:
                    return
                unpacker = zlib.decompressobj(kind)
            elif not out and not head or not head and len(out) < PART:
                head = next(parts, b"")
            elif not head:  # a full part may have left more inside
                while more := unpacker.decompress(b"", PART):
                    yield more
                head = next(parts, b"")
    except zlib.error:
        return


def _bzip2(head: bytes, parts: Iterator[bytes]) -> Iterator[bytes]:
    unpacker = bz2.BZ2Decompressor()
    try:
        while not unpacker.eof:
            if out := unpacker.decompress(head, PART):
                yield out
            head = b""
            if unpacker.needs_input:
                head = next(parts, b"")
                if not head:
                    return
    except OSError:
        return


class _Reader(io.RawIOBase):
    """Parts as a file."""

    def __init__(self, head: bytes, parts: Iterator[bytes]):
        self.held, self.parts = head, parts

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if not self.held:
            self.held = next(self.parts, b"")
        n = len(self.held) if n < 0 else n
        out, self.held = self.held[:n], self.held[n:]
        return out


def _zstandard(head: bytes, parts: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    try:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(_Reader(head, parts), read_across_frames=True) as reader:
            while out := reader.read(PART):
                yield out
    except zstandard.ZstdError:
        return


def _texts(packed: Packed) -> Iterator[Layer]:
    """The readable stretches of a layer of bytes."""
    stream, start, end = packed
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held = ""
    for part in stream():
        text = held + decoder.decode(part)
        for m in _READABLE.finditer(text):
            yield Layer(m.group(), _Same(start, len(m.group())), _Same(end, len(m.group())))
        held = text[-CARRY:] if len(text) > CARRY else text


def _of(data: bytes) -> Stream:
    return lambda: (data,)


def _encoded(body: str, start: int, end: int) -> Iterator[Packed]:
    """What base64 may hold: from its four alignments on, and from where an archive may begin."""
    body = body.rstrip("=")
    places = {0, 1, 2, 3, *(m.start() for m in _MAGIC64.finditer(body) if not body[m.start() - 1 : m.start()].isalnum())}
    raw = body.encode().translate(_URL_SAFE)
    for at in sorted(places):
        size = len(raw) - at
        if size % 4 == 1:
            size -= 1
        if size >= 8:
            yield _of(base64.b64decode(raw[at : at + size] + b"=" * (-size % 4))), start, end


def _base64(layer: Layer) -> Iterator[Packed]:
    text, joined_to = layer.text, 0
    for m in _BASE64.finditer(text):
        yield from _encoded(m.group(), *layer.origin(m.start(), m.end()))
        if m.start() < joined_to or m.group().endswith("="):
            continue
        # Lines of one length, and a last one that may be shorter, are one run.
        width, lines, end = m.end() - m.start(), [m.group()], m.end()
        while (line := _LINE.match(text, end)) and len(line.group(1)) <= width:
            lines.append(line.group(1))
            end = line.end()
            if len(line.group(1)) < width or line.group(1).endswith("="):
                break
        if len(lines) > 1:
            joined_to = end
            yield from _encoded("".join(lines), *layer.origin(m.start(), end))


def _escaped_archives(layer: Layer) -> Iterator[Packed]:
    done = 0
    for m in _MAGIC_URL.finditer(layer.text):
        if m.start() >= done:
            run = _URL_RUN.match(layer.text, m.start())
            done = run.end()
            yield _of(unquote_to_bytes(run.group())), *layer.origin(m.start(), done)


def unwrap(layer: Layer) -> Iterator[Layer | Packed]:
    """The layers one step inside a layer."""
    text = layer.text
    if "%" in text:
        yield from _substituted(layer, _PERCENT, _percent)
        yield from _escaped_archives(layer)
    if "\\" in text or "&#" in text:
        yield from _substituted(layer, _UNICODE, _escape)
    yield from _base64(layer)


def _opened(packed: Packed, seen: set) -> Iterator[Layer | Packed]:
    """The texts inside a layer of bytes, and the layer that it unpacks to; nothing if it was seen."""
    stream, start, end = packed
    digest, head = hashlib.blake2b(digest_size=16), b""
    for part in stream():
        digest.update(part)
        head = head if len(head) >= 4 else head + part[:4]
    key = (digest.digest(), start, end)
    if not head or key in seen:
        return
    seen.add(key)
    yield from _texts(packed)
    if _MAGIC.match(head):
        yield lambda: _inflated(stream()), start, end


def findings(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base findings, all findings), each by start and then kind as in ``KINDS``."""
    text = text or ""
    order = lambda f: (f[1], KINDS.index(f[0]), f[2])
    base = sorted(scan(text), key=order)
    every = set(base)
    document = Layer(text, range(len(text)), range(1, len(text) + 1))
    seen: set = set()
    work: list[Iterator[Layer | Packed]] = [unwrap(document)]
    while work:  # depth first; of every layer under way, what it holds is made step by step
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif isinstance(inner, tuple):
            work.append(_opened(inner, seen))
        elif inner.text:
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *inner.origin(0, len(inner.text)), 0)
            if key not in seen:
                seen.add(key)
                for kind, a, b in scan(inner.text):
                    every.add((kind, *inner.origin(a, b)))
                work.append(unwrap(inner))
    return base, sorted(every, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base findings, and all spans."""

    def row(doc_id, text):
        base, every = findings(text)
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)

    return per_document(docs, row, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")
