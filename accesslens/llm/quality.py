"""Document quality by histogram gradient-boosted trees.

Features are statistics of the whole text, counted by numpy over many texts at
once.  The trees are grown on the driver from a sample of labelled documents
of at most ``SAMPLE`` rows (those in the lowest shares of a hash of the id), on
features cut into at most ``BINS`` quantile bins; they are then flattened into
arrays, and tasks walk all trees for all rows of a batch together.

Defined cases: a null text counts as empty, and an empty text gets the score
its all-zero statistics lead to; without a single usable label every score is
1, with labels of one class it is their smoothed rate; a null label is
ignored, and of several labels of a document the largest counts; rows that
repeat are scored alike; other columns are ignored (``keep_good`` returns them
untouched).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.staging import staged
from accesslens.llm.words import slices, split_words, text_of

SAMPLE = 20_000
#: Hash shares the labelled rows are dealt into, to choose the sample.
SHARES = 1 << 14
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 60, 4, 0.15, 20, 1.0
#: From this score on a document is predicted to be good.
GOOD = 0.7
#: Bytes that are counted, a set each.
BYTE_SETS = [
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\v\f\r", b"\n", bytes(range(128, 256)), bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
    b".", b",;:", b"!?", b"|", b"#$%&*", b"<>{}[]()", b"\"'", b"/\\_=+~^`", b"@", b"-",
]
#: Beside a share for each set: size, words, word length and its spread,
#: distinct words, most frequent word, words repeated at once, line length, distinct lines.
WIDTH = len(BYTE_SETS) + 9


def features(column: pa.Array) -> np.ndarray:
    """Texts x WIDTH statistics."""
    text = text_of(column)
    n, sizes = len(text), text.sizes
    out = np.zeros((n, WIDTH), np.float32)
    per_byte = np.maximum(sizes, 1)

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[bounds])

    lines = None
    for k, members in enumerate(BYTE_SETS):
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        count = sums(table[text.data], text.offsets)
        out[:, k] = count / per_byte
        lines = count + 1 if members == b"\n" else lines
    words = split_words(text, lower=True)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    lengths = np.array([len(w) for w in words.uniques] or [0], np.int64)[words.codes]
    mean = sums(lengths, words.first) / some
    owner = np.repeat(np.arange(n), count)
    pairs, times = np.unique(owner * max(1, len(words.uniques)) + words.codes, return_counts=True)
    held = pairs // max(1, len(words.uniques))
    distinct = np.bincount(held, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, held, times)
    again = np.zeros(len(words.codes), np.int64)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    different = [len(set(text.data[a:b].tobytes().split(b"\n"))) for a, b in zip(text.offsets[:-1], text.offsets[1:], strict=True)]
    spread = np.sqrt(np.maximum(0, sums(lengths * lengths, words.first) / some - mean * mean))
    own = (np.log1p(sizes), np.log1p(count), mean, spread, distinct / some, most / some, sums(again, words.first) / some, sizes / lines, np.array(different, float) / lines)
    for k, values in enumerate(own, len(BYTE_SETS)):
        out[:, k] = values
    return out


@dataclass
class Model:
    """Trees end to end: inner node i sends a row left if its bin of
    ``feature[i]`` is at most ``cut[i]``; a leaf points at itself."""

    edges: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 1), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        bins, rows = self.binned(x), np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(DEPTH):
            node = np.where(bins[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees on the logistic loss; the same rows give the same model."""
    none = np.zeros(0, np.int64)
    if not len(y):
        return Model([], none, none, none, none, none, np.zeros(0), np.inf)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if y.min() == y.max():
        return Model([], none, none, none, none, none, np.zeros(0), base)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, k], quantiles, method="lower")) for k in range(x.shape[1])]
    model = Model(edges, none, none, none, none, none, np.zeros(0), base)
    bins = model.binned(x)
    width = x.shape[1]
    flat = bins + np.arange(width) * BINS
    raw = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(grad: float, hess: float) -> int:
        at = len(feature)
        for items, item in ((feature, 0), (cut, BINS), (left, at), (right, at), (value, -RATE * grad / (hess + RIDGE))):
            items.append(item)
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, depth: int) -> int:
            grad, hess = g[rows].sum(), h[rows].sum()
            at = leaf(grad, hess)
            if depth == DEPTH or len(rows) < 2 * LEAST:
                raw[rows] += value[at]
                return at
            places = flat[rows].ravel()
            tables = [np.bincount(places, np.repeat(v, width), width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = tables
            gain = gl**2 / (hl + RIDGE) + (grad - gl) ** 2 / (hess - hl + RIDGE) - grad**2 / (hess + RIDGE)
            gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = 0
            k, b = divmod(int(gain.argmax()), BINS)
            if gain[k, b] <= 1e-9:
                raw[rows] += value[at]
                return at
            goes = bins[rows, k] <= b
            feature[at], cut[at] = k, b
            left[at], right[at] = grow(rows[goes], depth + 1), grow(rows[~goes], depth + 1)
            return at

        roots.append(grow(np.arange(len(y)), 0))
    return Model(edges, *(np.array(v, np.int64) for v in (roots, feature, cut, left, right)), np.array(value), base)


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """True for the rows no label is learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == rest, F.lit(False))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, features array<float>")


def train(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``stats`` that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = stats.where(~held_out()).join(known, "doc_id").select("doc_id", "label", "features", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).alias("share"))
    rows = staged(rows, "labelled")
    # The lowest hash shares that together hold at most ``sample`` rows: no
    # task sends more than its part of them to the driver.
    below, held = 0, 0
    for row in sorted(rows.groupBy("share").count().collect()):
        held += row["count"]
        if held > sample:
            break
        below = row.share + 1
    found = sorted(rows.where(F.col("share") < below).collect(), key=lambda row: (row.share, row.doc_id, row.features))
    x = np.array([row.features for row in found], np.float32).reshape(len(found), WIDTH)
    return fit(x, np.array([row.label for row in found], np.float64))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``stats``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "features").mapInArrow(walk, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    stats = staged(statistics(docs, **columns), "statistics")
    rows = scored(stats, train(stats, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, as they are, that are predicted to be good."""
    model = train(statistics(docs, id_col, text_col), labels)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= GOOD))

    return docs.mapInArrow(keep, docs.schema)
