"""Exact token counts at every prefix, by dynamic programming.

Two tokens may stand side by side in an encoding exactly if the merge rules,
applied to their joined characters, keep them.  Hence the encoding of a prefix
ends in the one token that is compatible with the encoding of what is before
it: ``count(prefix) = count(prefix without its last token) + 1``.  The table
of a word is built this way, sharing the states of equal beginnings, and the
counts of a text follow from its words.  Each text is stored once as the
differences of its counts from one prefix to the next; a count, or the longest
prefix within a budget, is then read off without encoding anything again.

The counts are those the tokenizers library gives for the prefix as a text of
its own: a cut word ends there, which can raise or lower the count.  Words
whose normal form is not aligned with their characters (combining marks, a few
letters), or that hold white space beyond ASCII or a special token, are
normalised a letter with its marks at a time; a prefix that ends inside such a
letter is the normal form before it and a few characters of its own.

Defined cases: a null or empty text has no prefixes and no tokens; repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.encoder import END, PATTERN, PIECE
from accesslens.llm.words import gather, slices, split_pieces, text_of

#: Pieces, and beginnings of pieces, remembered by one Python worker.
REMEMBERED = 200_000
#: Letters of a beginning that words share.
SHARED = 24
#: Pairs of tokens whose fit is remembered.
PAIRS = 1_000_000
COUNTS = "doc_id long, n_bytes long, n_tokens long, width int, deltas binary"
KINDS = {1: np.int8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}


#: Pieces of which a prefix is cut differently than the whole.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: Characters given to the library at once where it counts prefixes.
PREFIXES = 1 << 20


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that normalisation may join to, or move before, those
    before them: a text can be normalised in parts that start with others."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    every = [chr(c) for c in range(sys.maxunicode + 1)]
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    first = ((c, unicodedata.normalize("NFD", c)[0]) for c in every)
    return frozenset(c for c, start in first if start in seconds or unicodedata.combining(start))


def _normal(text: str) -> str:
    return "".join(c.lower() for c in unicodedata.normalize("NFC", text))


@lru_cache(maxsize=2)
def counter(path: str) -> "PrefixCounter":
    return PrefixCounter(path)


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else
    the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            parts = json.load(source)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps[0].get("pattern") != {"Regex": PATTERN} or parts["model"].get("end_of_word_suffix") != END:
            raise ValueError("prefix tables need a vocabulary with word ends and the splitting pattern they were written for")
        self.vocab = parts["model"]["vocab"]
        merges = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in parts["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.halves = {left + right: (left, right) for left, right in reversed(merges)}
        self.longest = max(map(len, self.vocab))
        self.letters = _byte_letters()
        self.cut = regex.compile(PATTERN)
        self.special = [token["content"] for token in parts["added_tokens"]]
        self.states: dict[str, tuple[str, int, int]] = {}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The outermost constituents of a token from smallest to whole, each
        with the rank of the merge that consumes it (none: beyond all)."""
        chain, consumed = [], len(self.rank)
        while True:
            chain.append((token, consumed))
            halves = self.halves.get(token)
            if halves is None:
                return chain[::-1]
            consumed, token = self.rank[halves], halves[side]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between two sound tokens."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            rank = self.rank.get((x, y))
            # At equal rank the leftmost merge comes first.
            if rank is not None and rank < x_end and rank <= y_end:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def is_sound(self, token: str) -> bool:
        """Whether merging a token's own characters gives the token."""
        known = self.sound.get(token)
        if known is None:
            halves = self.halves.get(token)
            known = halves is None or (self.is_sound(halves[0]) and self.is_sound(halves[1]) and self._parts_meet(*halves))
            self.sound[token] = known
        return known

    def _parts_meet(self, left: str, right: str) -> bool:
        """Whether both halves are complete when their merge is due, with no
        other merge across the boundary before it."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while i + 1 < len(a) or j + 1 < len(b):
            (x, x_end), (y, y_end) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_end and rank <= y_end:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        return True

    def _last(self, run: str, end: int, ending: str, lasts: list[str], counts: list[int]) -> tuple[str, int]:
        """Last token and number of tokens of ``run[:end]``, with or without
        the mark of a word end; the lists hold the same of shorter beginnings
        without it."""
        vocab, pairs = self.vocab, self.pairs
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = run[start:end] + ending
            if token in vocab:
                if not start:
                    if self.is_sound(token):
                        return token, 1
                else:
                    pair = lasts[start], token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = self.is_sound(token) and self.compatible(*pair)
                        if len(pairs) < PAIRS:
                            pairs[pair] = fits
                    if fits:
                        return token, counts[start] + 1
        raise ValueError(f"no encoding of {run[:end]!r}")

    def _run(self, run: str) -> list[int]:
        """Counts after each of a run's letters, each letter one byte."""
        states, lasts, counts, closed = self.states, [""], [0], []
        for end in range(1, len(run)):
            # Beginnings are shared between words up to a length; the keys of
            # longer ones would take space with the square of it.
            state = states.get(run[:end]) if end <= SHARED else None
            if state is None:
                state = (*self._last(run, end, "", lasts, counts), self._last(run, end, END, lasts, counts)[1])
                if end <= SHARED:
                    states[run[:end]] = state
            lasts.append(state[0])
            counts.append(state[1])
            closed.append(state[2])
        closed.append(self._last(run, len(run), END, lasts, counts)[1])
        return closed

    def _piece(self, piece: str) -> list[int]:
        """Counts after each character of a lower-case run."""
        if piece.isascii() and piece.isprintable():  # each byte stands for itself
            return self._run(piece)
        counts = self._run("".join(self.letters[byte] for byte in piece.encode()))
        ends = accumulate(len(char.encode()) for char in piece)
        return [counts[end - 1] for end in ends]

    def _by_library(self, text: str) -> list[int]:
        counts, some = [], max(1, PREFIXES // max(1, len(text)))
        for at in range(0, len(text), some):
            prefixes = [text[: i + 1] for i in range(at, min(at + some, len(text)))]
            counts += [len(item) for item in self.library.encode_batch_fast(prefixes, add_special_tokens=False)]
        return counts

    def _bytes(self, text: str) -> str:
        return "".join(self.letters[byte] for byte in text.encode())

    def _whole(self, normal: str) -> int:
        """Tokens of a short normalised text."""
        return sum(self._run(self._bytes(piece))[-1] for piece in self.cut.findall(normal))

    def _normal_counts(self, normal: str, partial: dict[int, list[str]]) -> tuple[list[int], dict[tuple[int, str], int]]:
        """Counts after each character of a normalised text, from 0 on, and
        for the given texts that may follow after so many characters."""
        counts, others, alone = [0], {}, -1

        def fresh(at: int) -> None:
            others.update(((at, tail), counts[at] + self._whole(tail)) for tail in partial.get(at, ()))

        fresh(0)
        for match in self.cut.finditer(normal):
            start, stop = match.span()
            while len(counts) <= start:
                counts.append(counts[-1])
                fresh(len(counts) - 1)
            piece, base = match[0], counts[start]
            if piece in CONTRACTIONS:
                counts += [base + self._whole(piece[:i]) for i in range(1, len(piece) + 1)]
                for at in range(start + 1, stop + 1):
                    others.update(((at, tail), base + self._whole(normal[start:at] + tail)) for tail in partial.get(at, ()))
                continue
            run, lasts, sums, at = self._bytes(piece), [""], [0], start
            for char in piece:
                for end in range(len(sums), len(sums) + len(char.encode())):
                    closed = self._last(run, end, END, lasts, sums)[1]
                    last, n = self._last(run, end, "", lasts, sums)
                    lasts.append(last)
                    sums.append(n)
                counts.append(base + closed)
                at += 1
                for tail in partial.get(at, ()):
                    if alone == start and at - start < 3:  # with the apostrophe before, a contraction may arise
                        others[at, tail] = counts[start - 1] + self._whole(normal[start - 1 : at] + tail)
                        continue
                    before = normal[start if at - start < 8 else at - 1 : at]
                    others[at, tail] = base + self._followed(before, at - start, run, lasts, sums, closed, tail)
            if piece == "'":
                alone = stop
        while len(counts) <= len(normal):
            counts.append(counts[-1])
            fresh(len(counts) - 1)
        return counts, others

    def _followed(self, before: str, n_before: int, run: str, lasts: list[str], sums: list[int], closed: int, tail: str) -> int:
        """Tokens of the beginning of a piece, ``lasts`` and ``sums`` being its
        states, with ``tail`` after it; ``before`` is all of it or its end."""
        if len(before) == n_before:
            return self._whole(before + tail)
        first = self.cut.match(("!" if before == "'" else before) + tail)[0]
        longer = self._bytes(first[1:])
        if not longer:
            return closed + self._whole(tail)
        # Only the states within reach, so that none is the word's start.
        done = len(sums) - 1
        low = max(0, done - self.longest - 1)
        text, own, n = run[low:done] + longer, lasts[low:], sums[low:]
        for end in range(done - low + 1, len(text) + 1):
            closed = self._last(text, end, END, own, n)[1]
            last, more = self._last(text, end, "", own, n)
            own.append(last)
            n.append(more)
        return closed + self._whole(tail[len(first) - 1 :])

    def _plain(self, text: str) -> list[int]:
        """Counts after each character of a text without special tokens."""
        join, parts, size = joining(), [], 0
        places: list[tuple[int, str]] = []
        partial: dict[int, list[str]] = {}
        starts = [i for i, c in enumerate(text) if not i or c not in join]
        for start, stop in zip(starts, [*starts[1:], len(text)], strict=False):
            for end in range(start + 1, stop):
                tail = _normal(text[start:end])
                partial.setdefault(size, []).append(tail)
                places.append((size, tail))
            parts.append(_normal(text[start:stop]))
            size += len(parts[-1])
            places.append((size, ""))
        counts, others = self._normal_counts("".join(parts), partial)
        return [others[place] if place[1] else counts[place[0]] for place in places]

    def _sections(self, word: str) -> list[int]:
        """Counts after each character of any text: special tokens stand for
        themselves once whole, and are plain text before."""
        counts: list[int] = []
        special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        at = 0
        for match in [*special.finditer(word), None]:
            base = counts[-1] if counts else 0
            own = self._plain(word[at:] if match is None else word[at : match.end() - 1])
            counts += [base + n for n in own]
            if match is not None:
                before = match.start() - at
                counts.append(base + (own[before - 1] if before else 0) + 1)
                at = match.end()
        return counts

    def _counts(self, word: str) -> list[int]:
        """Counts after each character of a word without white space."""
        lower = word.lower()
        if len(lower) != len(word) or not unicodedata.is_normalized("NFC", word) or any(s in word for s in self.special) or any(len(c.lower()) > 1 for c in word):
            return self._checked(word)
        counts: list[int] = []
        for piece in self.cut.findall(lower):
            base = counts[-1] if counts else 0
            own = self._by_library(piece) if piece in CONTRACTIONS else self._piece(piece)
            counts += [base + n for n in own]
        if len(counts) != len(word) or (not word.isascii() and counts[-1] != len(self.library.encode(word, add_special_tokens=False))):
            return self._checked(word)
        return counts

    def _checked(self, word: str) -> list[int]:
        counts = self._sections(word)
        if counts[-1] != len(self.library.encode(word, add_special_tokens=False)):
            return self._by_library(word)
        return counts

    def _steps(self, word: bytes) -> bytes:
        """Differences of the counts from byte to byte of one word, as 32-bit
        numbers; within a character they are zero until its last byte."""
        if word.isascii() and PIECE.match(word):
            counts = self._run(word.decode())
            return array("i", map(sub, counts, [0, *counts[:-1]])).tobytes()
        if PIECE.match(word):
            text = word.decode()
            counts = self._piece(text)
        else:
            text = word.decode("utf-8", "replace")
            counts = self._counts(text)
        steps = [n - before for n, before in zip(counts, [0, *counts], strict=False)]
        if len(text) < len(word):
            sizes = [len(char.encode()) for char in text]
            if sum(sizes) == len(word):
                steps = [x for n, size in zip(steps, sizes, strict=True) for x in (*[0] * (size - 1), n)]
            else:  # broken UTF-8: the whole count at the last byte
                steps = [*[0] * (len(word) - 1), sum(steps)]
        return array("i", steps).tobytes()

    def differences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For texts end to end: the difference at every byte, and offsets."""
        text = text_of(column)
        words = split_pieces(text)
        if len(self.words) > REMEMBERED:
            self.words, self.older = {}, self.words
        if len(self.states) > 2 * REMEMBERED:
            self.states = {}
        known, older = self.words, self.older
        for word in words.uniques:
            if word not in known:
                known[word] = older.get(word) or self._steps(word)
        parts = [known[word] for word in words.uniques]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.int32)
        each = sizes[words.codes]
        out = np.zeros(len(text.data), np.int32)
        out[gather(words.starts, each)] = flat[gather((np.cumsum(sizes) - sizes)[words.codes], each)]
        return out, text.offsets


def prefix_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, width, deltas`` of every whole text.

    ``deltas`` holds a signed little-endian number of ``width`` bytes for each
    byte of the text: what the token count of the prefix ending there has more
    than that of the prefix one byte shorter.  Inside a character the count is
    that of the characters before.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            deltas, offsets = own.differences(batch.column(1))
            sums = np.concatenate(([0], np.cumsum(deltas, dtype=np.int64)))
            sizes, totals = np.diff(offsets), np.diff(sums[offsets])
            width = 1 if np.abs(deltas).max(initial=0) < 128 else 2 if np.abs(deltas).max() < 1 << 15 else 4
            data = pa.py_buffer(deltas.astype(KINDS[width]).tobytes())
            blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * width), data])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(totals), pa.array(np.full(n, width, np.int32)), blobs.cast(pa.binary())], ["doc_id", "n_bytes", "n_tokens", "width", "deltas"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, COUNTS)


def counts_of(row) -> np.ndarray:
    """The token count at every byte prefix of one stored row, from 0 on."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(row.deltas, KINDS[row.width]).astype(np.int64))))


def longest_within(row, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(row) <= budget)[-1])


def truncated(counts: DataFrame, budget: int) -> DataFrame:
    """``doc_id, keep_bytes``: where to cut each stored text for ``budget``
    tokens, from the stored differences alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for width, deltas in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums = np.cumsum(np.frombuffer(deltas, KINDS[width]).astype(np.int64))
                keep.append(int(np.flatnonzero(np.concatenate(([0], sums)) <= budget)[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.int64())], ["doc_id", "keep_bytes"])

    return counts.select("doc_id", "width", "deltas").mapInArrow(cut, "doc_id long, keep_bytes long")


def over(limit: int) -> Column:
    return F.col("n_tokens") > limit
