"""Token ids of whole texts by the tokenizers library, with every distinct word encoded once.

``word_bpe_49k.json`` drops white space and encodes each word by itself, so the ids of a
text are the concatenated ids of its words. Words are split at ASCII white space only, a
part of what the tokenizer splits at, and kept in a bounded memo in each Python worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geoweave.llm.common import release_memory

#: Distinct words that a worker remembers; when they are full, those of the texts at hand stay.
MEMO_WORDS = 1 << 19
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII punctuation that is always a piece of its own behind a word; no apostrophe, for the sake of 's and the like.
_TAIL = b".,;:!?()[]{}|#*$%&\"-_/\\=+~`^@<>"
_SIGNS = re.escape(_TAIL.decode())
#: What may stand beside such a run for it to be one: ASCII letters, digits and white space, and letters below U+02B0 but U+0130, of which lower case makes two characters.
_BESIDE = r"A-Za-z0-9\t\n\f\r \x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{2af}"
_ENTANGLED = f"[^{_BESIDE}{_SIGNS}][{_SIGNS}]|[{_SIGNS}][^{_BESIDE}{_SIGNS}]"
_PART = 2048
_TEXTS = 256
#: Bytes of text encoded together.
LOT_BYTES = 6 << 20


def _plain(word: bytes) -> bool:
    """Whether a word has letters below U+0100 only, which no normalisation but lower case changes."""
    text = word.decode("utf-8")
    return text.isalpha() and max(text) < "\u0100"


class WordTokenizer:
    """Encodes UTF-8 texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        # For lower-case words of plain letters the file's normalizer and splitting pattern change nothing.
        lean = Tokenizer.from_file(path)
        lean.normalizer = normalizers.Sequence([])
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._encode_plain = lean.encode_batch_fast
        self._last = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a word
        self._last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._limit = memo_words
        self._reset({}, np.empty(0, "<u4"), np.empty(0, np.int32))

    def _reset(self, rows: dict[bytes, int], pool: np.ndarray, sizes: np.ndarray) -> None:
        """The memo: word to row; the ids of row ``r`` are ``sizes[r]`` ids of the pool, row after row."""
        self._memo, self._pools, self._sizes = rows, [pool], [sizes]

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, sizes, starts) of all rows."""
        if len(self._pools) > 1:
            self._pools, self._sizes = [np.concatenate(self._pools)], [np.concatenate(self._sizes)]
        pool, sizes = self._pools[0], self._sizes[0]
        return pool, sizes, np.cumsum(sizes, dtype=np.int64) - sizes

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._memo.update(zip(words, range(len(self._memo), len(self._memo) + len(words))))
        self._pools.append(ids)
        self._sizes.append(sizes)

    def _one_by_one(self, words: list[bytes]) -> None:
        for i in range(0, len(words), _PART):
            part = words[i : i + _PART]
            found = [e.ids for e in self._encode([w.decode("utf-8") for w in part], add_special_tokens=False)]
            self._add(part, np.array([x for ids in found for x in ids], "<u4"), np.fromiter(map(len, found), np.int32, len(found)))

    def _together(self, words: list[bytes]) -> None:
        """Words of plain letters: encoded as one text and cut behind the ids that end a word."""
        for i in range(0, len(words), _PART):
            part = words[i : i + _PART]
            ids = np.array(self._encode_plain([b" ".join(part).decode("utf-8").lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=0).astype(np.int32))
            else:
                self._one_by_one(part)

    def _learn(self, words: list[bytes]) -> None:
        """Add distinct words that the memo lacks."""
        letters, others, composed, cores, tails = [], [], [], [], []
        for word in words:
            if word.isalpha() or _plain(word):
                letters.append(word)
                continue
            core = word.rstrip(_TAIL)
            if len(core) < len(word) and (core.isalpha() or _plain(core)):
                composed.append(word)
                cores.append(core)
                tails.append(word[len(core) :])
            else:
                others.append(word)
        memo = self._memo
        self._together([*letters, *(set(cores).difference(letters) - memo.keys())])
        self._one_by_one([*others, *(set(tails).difference(others) - memo.keys())])
        if composed:
            pool, sizes, starts = self._merged()
            both = np.empty((len(composed), 2), np.int64)
            both[:, 0] = [memo[w] for w in cores]
            both[:, 1] = [memo[w] for w in tails]
            self._add(composed, _pick(pool, starts[both.reshape(-1)], sizes[both.reshape(-1)]), sizes[both].sum(axis=1).astype(np.int32))

    def encode(self, texts: pa.Array | Sequence[bytes | None]) -> list[bytes]:
        """The ids of each text; a null text is empty.

        Arrow splits the texts and finds the distinct words; Python sees each of those once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        if texts.offset:  # ascii_lower misreads arrays that begin inside their buffers
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        # Case doesn't change ids. For fewer words, that of ASCII letters is removed first, but for texts with special
        # tokens or with characters from U+0300 on, where combining marks begin.
        odd = pc.or_(pc.match_substring_regex(texts, r"[^\x{0}-\x{2ff}]"), pc.match_substring(texts, "<|"))
        lowered = pc.if_else(odd, texts, pc.ascii_lower(texts))
        # Runs of these signs are pieces of their own, so spaces around them change no id and leave fewer distinct words.
        entangled = pc.or_(odd, pc.match_substring_regex(lowered, _ENTANGLED))
        split = pc.ascii_split_whitespace(pc.if_else(entangled, lowered, pc.replace_substring_regex(lowered, f"([{_SIGNS}]+)", r" \1 ")))
        coded = split.flatten().dictionary_encode()
        distinct = pc.cast(coded.dictionary, pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self._memo.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(rows < 0).tolist()
        if len(self._memo) + len(missing) > self._limit:
            pool, sizes, starts = self._merged()
            held = np.flatnonzero(rows >= 0)
            kept = rows[held]
            self._reset(dict(zip([distinct[i] for i in held.tolist()], range(len(held)))), _pick(pool, starts[kept], sizes[kept]), sizes[kept])
            rows[held] = np.arange(len(held))
        if missing:
            unseen = [distinct[i] for i in missing]
            self._learn(unseen)
            rows[missing] = [self._memo[w] for w in unseen]
        pool, sizes, starts = self._merged()
        return _gathered(split, coded.indices.to_numpy(), pool, starts[rows], sizes[rows])


def _pick(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of the pool, one behind the other."""
    reach = np.cumsum(sizes, dtype=np.int64)
    places = np.repeat((starts - reach + sizes).astype(np.int32), sizes)
    places += np.arange(len(places), dtype=np.int32)
    return pool[places]


def gathered(split: pa.ListArray, coded: pa.DictionaryArray, ids: list[bytes]) -> list[bytes]:
    """The ids of each text from those of its words: ``split`` are the texts' words, ``coded`` all of them by their
    dictionary, ``ids`` those of the dictionary's words."""
    sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    return _gathered(split, coded.indices.to_numpy(), np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes, dtype=np.int64) - sizes, sizes)


def _gathered(split: pa.ListArray, words: np.ndarray, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = split.offsets.to_numpy()[1:]
    out: list[bytes] = []
    first = 0
    for i in range(0, len(split), _TEXTS):  # word by word to ids, some texts at a time
        last = int(ends[min(i + _TEXTS, len(split)) - 1])
        part = words[first:last]
        n = sizes[part]
        flat = _pick(pool, starts[part], n).tobytes()
        reach = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        bounds = reach[np.concatenate([[first], ends[i : i + _TEXTS]]) - first] * 4
        out += [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        first = last
    return out


def lots(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = LOT_BYTES) -> Iterator[list[pa.Array]]:
    """The columns of a few batches together, until their texts have ``size`` bytes: words repeat more in larger lots."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.column(text).nbytes
        if total >= size:
            yield [pa.concat_arrays([b.column(i) for b in held]) for i in range(batch.num_columns)]
            held, total = [], 0
            release_memory()
    if held:
        yield [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]
        del held
        release_memory()


_held: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """This process's encoder for ``path``; it lasts as long as the worker."""
    if path not in _held:
        _held[path] = WordTokenizer(path)
    return _held[path]
