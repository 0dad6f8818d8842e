"""Words of whole Arrow text columns, found and hashed by numpy.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  None of
these bytes occurs inside a multi-byte UTF-8 character, so splitting bytes is
splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20


@dataclass
class Text:
    """Texts end to end: ``data[offsets[i]:offsets[i + 1]]`` is the i-th."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_of(column: pa.Array) -> Text:
    """The UTF-8 bytes of a text column; a null counts as an empty text."""
    column = column.fill_null("") if column.null_count else column
    # A slice is copied out, so that a cast does not take its whole parent along.
    column = pa.concat_arrays([column]).cast(pa.large_string())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Text(whole[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words in order.  ``first[i]:first[i + 1]`` are those of the i-th text;
    ``codes`` say which of ``uniques`` each is; ``starts`` are byte positions."""

    first: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    uniques: list[bytes]


def _stops(inside: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The positions after the last bytes of the runs that start at ``begins``."""
    final = inside.copy()
    final[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(final) + 1


def _begins(offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    return begins


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """The runs of ``inside`` bytes as words; ``breaks[i]`` starts a new word
    at byte i, as does the start of every text."""
    begins = _begins(offsets, inside)
    if breaks is not None:
        begins |= inside & breaks
    starts = np.flatnonzero(begins)
    cuts = np.concatenate(([0], np.cumsum(_stops(inside, begins) - starts)))
    chars = np.ascontiguousarray(data[inside])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(chars)]).dictionary_encode()
    return Words(np.searchsorted(starts, offsets), starts, column.indices.to_numpy().astype(np.int64), column.dictionary.to_pylist())


def split_words(text: Text, lower: bool = False) -> Words:
    return _runs(LOWER[text.data] if lower else text.data, text.offsets, ~IS_SPACE[text.data])


LETTER, DIGIT, OTHER, WHOLE = 1, 2, 3, 4
KIND = np.full(256, WHOLE, np.uint8)
KIND[0x21:0x7F] = OTHER
KIND[[0x27, 0x3C]] = WHOLE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[IS_SPACE] = 0


def split_pieces(text: Text) -> Words:
    """Words cut further, and lower-cased, where that is safe for a tokenizer
    that keeps letter runs, single digits and runs of other characters apart.

    Letters are those of ASCII and of U+00C0 to U+00FF.  A word holding
    anything else, an apostrophe (contractions) or ``<`` (special tokens) is
    kept whole and as it is.
    """
    data, size = text.data, len(text.data)
    kind = KIND[data]
    lead = data == 0xC3
    after = np.zeros(size, bool)
    after[1:] = lead[:-1]
    after &= (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    paired = np.zeros(size, bool)
    paired[:-1] = after[1:]
    kind[after | (lead & paired)] = LETTER
    inside = kind > 0
    if (odd := np.flatnonzero(kind == WHOLE)).size:
        begins = _begins(text.offsets, inside)
        starts = np.flatnonzero(begins)
        words = np.unique(np.searchsorted(starts, odd, "right") - 1)
        kind[gather(starts[words], _stops(inside, begins)[words] - starts[words])] = WHOLE
    lowered = np.where(after & (data <= 0x9E), data | 0x20, LOWER[data])
    breaks = kind == DIGIT
    breaks[1:] |= kind[1:] != kind[:-1]
    return _runs(np.where(kind == WHOLE, data, lowered), text.offsets, inside, breaks)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] : starts[i] + sizes[i]``, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
