"""Words of many texts at once, as numbers: each distinct word is looked at once in a slice of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and texts that are worked on together.
SLICE_BYTES = 4 << 20
SLICE_TEXTS = 1024


@dataclass
class Slice:
    """texts first to last (one past) of a batch; word k is number index[k] in names and belongs to text owner[k] of the slice."""

    first: int
    last: int
    index: np.ndarray
    owner: np.ndarray
    names: list[str]


def word_slices(texts: pa.Array, prepare: Callable[[bytes], bytes] | None = None, slice_bytes: int = SLICE_BYTES, slice_texts: int = SLICE_TEXTS) -> Iterator[Slice]:
    """Words (runs of other than \\x20, \\x09-\\x0D) of whole texts, null as empty. prepare changes a text's bytes first; it may only
    change ASCII bytes into ASCII bytes."""
    texts = texts.fill_null("").cast(pa.large_binary())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.empty(0, np.int64)
    first = 0
    while first < len(texts):
        done = int(sizes[first - 1]) if first else 0
        last = min(first + slice_texts, max(first + 1, int(np.searchsorted(sizes, done + slice_bytes, "right"))))
        part = texts.slice(first, last - first)
        if prepare:
            part = pa.array([prepare(t) for t in part.to_pylist()], pa.large_binary())
        words = pc.ascii_split_whitespace(part.cast(pa.large_string()))
        flat = words.flatten().dictionary_encode()
        offsets = words.offsets.to_numpy()
        owner = np.repeat(np.arange(last - first), np.diff(offsets))
        index = flat.indices.to_numpy(zero_copy_only=False)
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if "" in names:  # what stands before a leading or after a trailing separator
            keep = index != names.index("")
            index, owner = index[keep], owner[keep]
        yield Slice(first, last, index, owner, names)
        first = last
