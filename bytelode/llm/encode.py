"""Whole texts as token ids of a public tokenizer, many texts at a time, with a memory of word encodings."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Id appended to each document.
END_ID = 1
#: Marks that can be taken off the end of a word: the vocabulary's splitter parts them from a letter before.
_MARKS = ".,;:!?|*$%&#)(\""
#: Text bytes that are encoded together; what is held at a time follows from it and the longest text.
SLICE_BYTES = 2 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    """Encodes texts as tokenizers' encode(add_special_tokens=False) does, remembering the ids of each word.

    The vocabulary drops white space before it merges, so that no id depends on what stands beyond a space or line feed: the ids of
    a text are those of its parts between them. Parts of Latin-1 letters go to the library's merges at once, lowered (its
    normaliser would do the same), marks after a letter apart (as its splitter does); all others go through the whole library call.
    The memory is emptied when it holds LIMIT parts.
    """

    LIMIT = 500_000
    LONGEST = 64

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}

    def _merge(self, word: str) -> bytes:
        """Ids of one run of letters or of marks."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def _learn(self, part: str) -> bytes:
        known, low = self.known, part
        if not part.isascii():
            try:
                part.encode("latin-1")
                low = part.lower()
            except UnicodeEncodeError:
                pass
        else:
            low = part.lower()
        core = low.rstrip(_MARKS)
        if low is not part and core.isalpha() or core.isalpha() and core.isascii():
            ids = known.get(core)
            if ids is None:
                ids = self._merge(core)
                if len(core) <= self.LONGEST:
                    known[core] = ids
            if len(core) < len(low):
                marks = low[len(core) :]
                tail = known.get(marks)
                if tail is None:
                    tail = known[marks] = self._merge(marks)
                ids = ids + tail
        else:
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(part) <= self.LONGEST:
            known[part] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id after it, and the position at which each text ends."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
            known[""] = b""
        get, learn = known.get, self._learn
        found = [x if (x := get(w)) is not None else learn(w) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(b"".join(found) + END_ID.to_bytes(4, "little"), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        # One entry more for each text: the end id.
        bounds = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        index = np.insert(index.astype(np.int64), bounds, len(found))
        sizes, starts = np.append(sizes, 1), np.append(starts, len(flat) - 1)
        n = sizes[index]
        ends = np.cumsum(n)
        at = np.repeat(starts[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return flat[at], ends[bounds + np.arange(len(bounds))]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """encode() over consecutive slices of many texts: first text, one past the last, ids, ends. Null texts are empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.empty(0, np.int64)
        first = 0
        while first < len(texts):
            done = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
            yield first, last, *self.encode(texts.slice(first, last - first))
            first = last


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python process; reused workers keep its memory between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
