"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch (white space written as the mark, each word with the
marks before it) are sorted, which lays them out as the depth-first order of their trie.
Walking it, the forward table of the common prefix with the word before is kept and only
the rest of the word is computed.

The forward table is that of a Viterbi pass: for every position the greatest forward score and
the last piece that gives it, from which the pieces are traced back. For a unigram model
(``kind="unigram"``) the score of a path is the sum of its pieces' scores, and an unknown
character costs ``UNKNOWN`` more than the least piece. The public model is a BPE model, whose scores only rank
merges: the path of greatest sum is another one than merging leaves. Its paths are therefore
restricted: a piece may follow the last piece of its prefix only if merging the two texts alone
gives just these two pieces. Exactly one path to each position satisfies that, which is the one
that merging leaves, so the maximum is over one path and its score is carried along; the test of
a pair is kept. The table of a prefix doesn't depend on what follows it, which is what lets words
share it. (A word to which no path leads, of a model that breaks these rules, is merged as a whole.)

Words are split where a mark follows something else; the model has no piece across such a
place (checked when it is loaded). Characters outside the vocabulary become byte pieces.
Decoding joins the pieces, byte pieces as UTF-8, and drops the mark put in front.

Defined results: a null text is empty and has no ids; repeated rows give equal rows;
``doc_id`` may be null; of two unigram paths of one score the one whose last piece is longer
counts; a very long text costs its length; other columns may have any name and type; an empty
table gives no rows. A mark in the text itself decodes to a space, as with the library.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import picked, prepare
from geoweave.llm.tokens import gathered, lots

MARK = "▁"
MODEL = "piece_bpe_32k.model"
MEMO_WORDS = 1 << 19
#: What an unknown character's score is below that of the least piece of a unigram model.
UNKNOWN = 10.0
_ONE = [1]
_WORDS = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
_LINES = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


class Pieces:
    """A model's vocabulary and the shared-prefix pass over sorted words."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i]}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.bytes)}
        self._content = [bytes([byte_of[i]]) if i in byte_of else b"" if model.is_control(i) else t.encode("utf-8") for i, t in enumerate(self.texts)]
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece has a mark inside, so words can't be encoded by themselves")
        # A character that no piece holds merges with nothing, so words may be cut around it as well.
        self._lines = not any("\n" in t for t in self.ids)
        self._split = (_LINES if self._lines else _WORDS).findall
        self._lengths: dict[str, list[int]] = {}
        for t in self.ids:
            self._lengths.setdefault(t[-1], []).append(len(t))
        self._lengths = {c: sorted(set(n), reverse=True) for c, n in self._lengths.items()}
        self._unigram = kind == "unigram"
        self._unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._limit = memo_words

    def _merge(self, text: str) -> list[str]:
        """Pieces that merging the best-scored neighbours first, leftmost among equals, leaves."""
        parts, scores = list(text), self.scores.get
        low = float("-inf")
        pairs = [scores(a + b, low) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == low:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = scores(parts[i] + parts[i + 1], low)
            if i:
                pairs[i - 1] = scores(parts[i - 1] + parts[i], low)
        return parts

    def _follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 4 * self._limit:
                self._pairs.clear()
            known = self._pairs[key] = last + piece not in self.ids and self._merge(last + piece) == [last, piece]
        return known

    def _reachable(self, piece: str) -> bool:
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self._merge(piece) == [piece]
        return known

    def _best(self, word: str, end: int, forward: list[float]) -> tuple[float, str]:
        """The greatest forward score at a position, and its last piece: the longest of those that give it."""
        best, last = float("-inf"), ""
        for length in (*self._lengths.get(word[end - 1], ()), 1):
            piece = word[max(0, end - length) : end]
            score = self.scores.get(piece, self._unknown if length == 1 else None) if length <= end else None
            if score is not None and forward[end - length] + score > best:
                best, last = forward[end - length] + score, piece
        return best, last

    def _extend(self, word: str, table: list[str], forward: list[float]) -> bool:
        """Complete the tables: the entries ``i`` are the last piece of the first ``i`` characters and its forward score. False if no path leads on."""
        ids, pairs, scores, unknown = self.ids, self._pairs, self.scores, self._unknown
        for end in range(len(table), len(word) + 1):
            if self._unigram:
                score, piece = self._best(word, end, forward)
                table.append(piece)
                forward.append(score)
                continue
            for length in self._lengths.get(word[end - 1], _ONE):
                start = end - length
                if start < 0:
                    continue
                piece = word[start:end]
                if piece not in ids and length > 1:
                    continue
                if start:
                    last = table[start]
                    known = pairs.get((last, piece))
                    if not (self._follows(last, piece) if known is None else known):
                        continue
                elif not self._reachable(piece):
                    continue
                table.append(piece)
                forward.append(forward[start] + scores.get(piece, unknown))
                break
            else:
                return False
        return True

    def _traced(self, table: list[str], at: int) -> list[str]:
        out = []
        while at:
            out.append(table[at])
            at -= len(table[at])
        return out[::-1]

    def _ids_of(self, pieces: list[str]) -> bytes:
        ids = array("I")
        for piece in pieces:
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids.extend(self.bytes[b] for b in piece.encode("utf-8"))
        return ids.tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words in the depth-first order of their trie."""
        table, forward = [""], [0.0]
        before = ""
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del table[same + 1 :], forward[same + 1 :]
            if self._extend(word, table, forward):
                pieces = self._traced(table, len(word))
            else:
                pieces = self._merge(word)
            self._memo[word] = self._ids_of(pieces)
            before = word[: len(table) - 1]

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow cuts texts without runs of spaces into words and finds the distinct ones; others are cut in Python."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if texts.offset:
            texts = texts.take(pa.array(range(len(texts))))
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK)) if self._lines else pc.is_valid(texts)
        plain = pc.replace_substring(pc.replace_substring(pc.binary_join_element_wise(_text(MARK), texts, _text("")), " ", f" {MARK}"), "\n", " \n ")
        split = pc.split_pattern(pc.if_else(pc.or_(runs, pc.equal(texts, _text(""))), _text(""), plain), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        others = {i: self._split(MARK + t.replace(" ", MARK)) for i, t in zip(np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist(), texts.filter(runs).to_pylist()) if t}
        needed = set(distinct).union(*others.values())
        unseen = needed.difference(self._memo)
        if len(self._memo) + len(unseen) > self._limit:
            self._memo = {w: self._memo[w] for w in needed if w in self._memo}
        self.learn(unseen)
        out = gathered(split, coded, list(map(self._memo.__getitem__, distinct)))
        for i, words in others.items():
            out[i] = b"".join(map(self._memo.__getitem__, words))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte pieces that are not UTF-8 become U+FFFD."""
        text = b"".join(map(self._content.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_held: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """This process's encoder for ``path``."""
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, round_trip) of every document; one pass, no shuffle.

    ``ids`` are little-endian unsigned 16-bit integers where the vocabulary allows it, else
    32-bit ones; the checksum is of 32-bit ones. ``round_trip``: decoding gives the text again
    (its marks read as spaces)."""
    prepare(docs.sparkSession)
    path = model or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        narrow = len(pieces.texts) <= 1 << 16
        for doc_ids, column in lots(batches):
            coded = pieces.encode(column)
            same = [pieces.decode(c) == (t or "").replace(MARK, " ") for c, t in zip(coded, column.to_pylist())]
            held = [np.frombuffer(c, "<u4").astype("<u2").tobytes() for c in coded] if narrow else coded
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(held, pa.binary()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(zlib.crc32, coded), pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"],
            )

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_ids long, ids_crc32 long, round_trip boolean")


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids, n_ids) as :func:`encode` gives them; null ids give a null text."""
    prepare(coded.sparkSession)
    path = model or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            texts = []
            for ids, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                wide = None if ids is None else ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                texts.append(None if wide is None else pieces.decode(wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids", "n_ids").mapInArrow(run, "doc_id long, text string")
