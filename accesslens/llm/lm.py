"""A log-bilinear neural language model and a unigram base, over words.

Counts of all words of all training documents are made in Spark.  The most
frequent ``VOCABULARY - 1`` words and the end of a text get vectors; other
words share one entry, ``OTHER``, and are told apart by their smoothed share
of its counts, so the model is a distribution over all words:

    P(w | context) = P(entry | context) * (1 or (c + 0.1) / (rest + ...)).

The prediction for the next entry is the sum of the two words before, each
vector times a matrix of its position; its score with an entry is bilinear
plus a bias.  Training is noise-contrastive, in numpy, with noise words shared
by a batch: every task takes all its training tokens once, from a common
start, and the tasks' parameters are averaged by their numbers of tokens in a
tree of sums.  Scoring normalises over all entries; the normaliser of a pair
of context words is computed once a task, by batched matrix products.

The counts of the ``COMMON`` most frequent words are sent to every task (two
numbers each, a fixed bound); rarer words are joined by their hash, and being
rare none of them is a hot key.  Words are told apart by 64-bit hashes.

Defined cases: a null text is empty and has its end token alone; without any
training token the base and the model give every token probability 1; a null
id counts as training; repeated rows count and are scored each; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.staging import staged
from accesslens.llm.words import hashes, slices, split_words, text_of

VOCABULARY, WIDTH, CONTEXT = 512, 24, 2
OTHER, START = 0, VOCABULARY
COMMON = 200_000
NOISE, BATCH, RATE = 64, 4096, 0.08
SMOOTH = 0.1
#: Tokens permuted together, and distinct words held before they are passed on.
MIXED, HELD = 1 << 19, 1 << 20
#: A word no text can hold, for the end of a text.
END = hashes([b" "])[0].view(np.int64)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all of ``docs`` (doc_id, text), end tokens included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

        for batch in slices(batches):
            words = split_words(text_of(batch.column(1)), lower=True)
            held.append((hashes(words.uniques).view(np.int64), np.bincount(words.codes, minlength=len(words.uniques))))
            held.append((np.array([END]), np.array([batch.num_rows])))
            if sum(len(w) for w, _ in held) > HELD:
                yield merged()
        if held:
            yield merged()

    return docs.select("doc_id", "text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """The corpus totals and the common words, sorted by hash; ``entries``
    holds each common word's vector entry (``OTHER`` for most)."""

    total: int
    distinct: int
    words: np.ndarray
    n: np.ndarray
    entries: np.ndarray
    entry_counts: np.ndarray
    rest: int
    rest_distinct: int

    @classmethod
    def of(cls, table: DataFrame) -> "Counts":
        total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        # Counts fall into a few hundred bands; the highest that together hold
        # at most COMMON words are sent, found without sorting any word.
        band = F.floor(F.log2("n") * 16)
        sizes = sorted(table.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
        lowest, held = None, 0
        for row in sizes:
            held += row.words
            if held > COMMON - 1:
                break
            lowest = row.band
        chosen = (F.col("word") == int(END)) | (F.lit(False) if lowest is None else band >= lowest)
        common = table.where(chosen).select("word", "n").toPandas()
        words, n = common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
        order = np.lexsort((words, -n, words != END))
        words, n = words[order], n[order]
        entries = np.where(np.arange(len(words)) < VOCABULARY - 1, np.arange(len(words)) + 1, OTHER)
        own = n[: VOCABULARY - 1]
        counts = np.zeros(VOCABULARY, np.int64)
        counts[1 : len(own) + 1] = own
        counts[OTHER] = total - own.sum()
        order = np.argsort(words)
        return cls(int(total), int(distinct), words[order], n[order], entries[order], counts, int(counts[OTHER]), int(distinct) - len(own))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1 if not common) and entry of each word hash."""
        if not len(self.words):
            return np.full(len(words), -1), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        return np.where(hit, self.n[at], -1), np.where(hit, self.entries[at], OTHER)

    @property
    def log_total(self) -> float:
        return math.log10(self.total + SMOOTH * (self.distinct + 1))

    @property
    def log_rest(self) -> float:
        return math.log10(self.rest + SMOOTH * (self.rest_distinct + 1))


SEQUENCES = "key long, doc_id long, entries binary, n_tokens long, n_common long, n_rest long, logs double, rest_logs double, rare array<long>, times array<int>"


def sequences(docs: DataFrame, counts) -> DataFrame:
    """Per document: its entries (16 bits each, the end included), the sums
    over its common words, and its rare words with their numbers.

    ``logs`` is the sum of log10(c + 0.1) over common words; ``rest_logs`` and
    ``n_rest`` are the same and the number for those without an own entry.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = counts.value, TaskContext.get().partitionId() << 40
        end_count, end_entry = (int(x[0]) for x in own.find(np.array([END])))
        for batch in slices(batches):
            n = batch.num_rows
            words = split_words(text_of(batch.column(1)), lower=True)
            hashed = hashes(words.uniques).view(np.int64)
            found, entry = own.find(hashed)
            each, entries = found[words.codes], entry[words.codes]
            size = np.diff(words.first)
            owner = np.repeat(np.arange(n), size)
            common, rest = each >= 0, (each >= 0) & (entries == OTHER)
            logs = np.where(common, np.log10(np.maximum(each, 0) + SMOOTH), 0.0)
            sums = lambda values: np.bincount(owner, values, n)
            with_end = np.insert(entries, words.first[1:], end_entry).astype("<u2")
            bounds = (words.first + np.arange(n + 1)) * 2
            pairs, times = np.unique(owner[~common] * max(1, len(hashed)) + words.codes[~common], return_counts=True)
            of, code = np.divmod(pairs, max(1, len(hashed)))
            cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            end_log = math.log10(end_count + SMOOTH) if end_count >= 0 else math.log10(SMOOTH)
            end_rest = end_entry == OTHER
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key + np.arange(n)), batch.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(with_end.tobytes())]).cast(pa.binary()),
                    pa.array(size + 1), pa.array((sums(common) + (end_count > 0)).astype(np.int64)), pa.array((sums(rest) + end_rest).astype(np.int64)),
                    pa.array(sums(logs) + end_log), pa.array(sums(np.where(rest, logs, 0.0)) + (end_log if end_rest else 0.0)),
                    pa.ListArray.from_arrays(cuts, pa.array(hashed[code])), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ],
                [part.split()[0] for part in SEQUENCES.split(", ")],
            )
            key += n

    return docs.select("doc_id", "text").mapInArrow(read, SEQUENCES)


@dataclass
class Model:
    context: np.ndarray  # (VOCABULARY + 1) x WIDTH
    mixing: np.ndarray  # CONTEXT x WIDTH x WIDTH
    target: np.ndarray  # VOCABULARY x WIDTH
    bias: np.ndarray  # VOCABULARY

    @classmethod
    def start(cls, counts: np.ndarray) -> "Model":
        rng = np.random.default_rng(9)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        share = (counts + SMOOTH) / (counts.sum() + SMOOTH * len(counts))
        return cls(small(VOCABULARY + 1, WIDTH), np.stack([np.eye(WIDTH, dtype=np.float32)] * CONTEXT), small(VOCABULARY, WIDTH), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.mixing, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Model":
        shapes = [(VOCABULARY + 1, WIDTH), (CONTEXT, WIDTH, WIDTH), (VOCABULARY, WIDTH), (VOCABULARY,)]
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        return cls(*(p.astype(np.float32).reshape(s) for p, s in zip(np.split(flat, cuts), shapes, strict=True)))

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context[before[:, i]] @ self.mixing[i] for i in range(CONTEXT))


def contexts(entries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each entry of documents end to end, the ``CONTEXT`` before it,
    nearest first; ``START`` where the document has none."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(entries))
    out = np.full((len(entries), CONTEXT), START, np.int64)
    for i in range(CONTEXT):
        has = at - i - 1 >= first
        out[has, i] = entries[at[has] - i - 1]
    return out


def parts_of(batch: pa.RecordBatch, entries: int, tokens: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``MIXED`` tokens with their entries and sizes; the
    arguments are the columns of both."""
    sizes = batch.column(tokens).to_numpy()
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + MIXED, "right")))
        data = b"".join(batch.column(entries).slice(start, stop - start).to_pylist())
        yield start, stop, np.frombuffer(data, "<u2").astype(np.int64), sizes[start:stop]
        start = stop


class Trainer:
    """Noise-contrastive steps with per-parameter rates (Adagrad)."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.cumulative = np.cumsum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.squares = [np.full_like(p, 1e-2) for p in model.parts()]

    def _sum_rows(self, rows: int, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(ids, values[:, k], rows) for k in range(values.shape[1])], axis=1).astype(np.float32)

    def step(self, before: np.ndarray, word: np.ndarray) -> None:
        m, n = self.model, len(word)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1], "right"), VOCABULARY - 1)
        vectors = [m.context[before[:, i]] for i in range(CONTEXT)]
        hat = sum(v @ m.mixing[i] for i, v in enumerate(vectors))
        good = np.einsum("ij,ij->i", hat, m.target[word]) + m.bias[word] - self.log_noise[word]
        bad = hat @ m.target[drawn].T + m.bias[drawn] - self.log_noise[drawn]
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        on_good, on_bad = (sigmoid(good) - 1) / n, sigmoid(bad) / n
        on_hat = on_good[:, None] * m.target[word] + on_bad @ m.target[drawn]
        on_target = self._sum_rows(VOCABULARY, word, on_good[:, None] * hat)
        np.add.at(on_target, drawn, on_bad.T @ hat)
        on_bias = np.bincount(word, on_good, VOCABULARY) + np.bincount(drawn, on_bad.sum(axis=0), VOCABULARY)
        on_mixing = np.stack([v.T @ on_hat for v in vectors])
        on_context = sum(self._sum_rows(VOCABULARY + 1, before[:, i], on_hat @ m.mixing[i].T) for i in range(CONTEXT))
        for part, square, grad in zip(m.parts(), self.squares, (on_context, on_mixing, on_target, on_bias.astype(np.float32)), strict=True):
            square += (grad * n / 64) ** 2
            part -= RATE * (grad * n / 64) / np.sqrt(square)


def train(docs: DataFrame, counts: Counts) -> Model:
    """The average of the models that the tasks train on all their tokens;
    ``docs`` has entries and n_tokens of the training documents."""
    start = Model.start(counts.entry_counts)
    if not counts.total:
        return start
    noise = (counts.entry_counts + SMOOTH) / (counts.entry_counts.sum() + SMOOTH * VOCABULARY)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, tokens = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trainer = trainer or Trainer(Model.of(start.flat()), noise, TaskContext.get().partitionId())
            for _, _, entries, sizes in parts_of(batch, 0, 1):
                before, order = contexts(entries, sizes), trainer.rng.permutation(len(entries))
                for step in range(0, len(order), BATCH):
                    rows = order[step : step + BATCH]
                    trainer.step(before[rows], entries[rows])
                tokens += len(entries)
        if trainer is not None:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "weights": [(trainer.model.flat().astype(np.float64) * tokens).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, total = tokens + n, np.frombuffer(weights, np.float64) + (0 if total is None else total)
        if tokens:
            yield pa.RecordBatch.from_pydict({"tokens": [tokens], "weights": [total.tobytes()]})

    kind = "tokens long, weights binary"
    trained = staged(docs.select("entries", "n_tokens").mapInArrow(learn, kind), "task-models")
    # A tree of sums: some ten models a task, until one is left.
    left = trained.count()
    while left > 1:
        left = -(-left // 10)
        trained = staged(trained.repartition(left).mapInArrow(add, kind), "task-models")
        left = trained.count()
    row = trained.first()
    return Model.of(np.frombuffer(row.weights, np.float64) / row.tokens) if row else start


_SCORERS: dict[bytes, "Scorer"] = {}


class Scorer:
    """Normalised log10 probabilities, with the normalisers met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.full((VOCABULARY + 1) ** CONTEXT, np.nan, np.float32)

    @classmethod
    def of(cls, flat: bytes) -> "Scorer":
        if flat not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[flat] = cls(Model.of(np.frombuffer(flat, np.float32)))
        return _SCORERS[flat]

    def logs(self, entries: np.ndarray, before: np.ndarray) -> np.ndarray:
        m, base = self.model, VOCABULARY + 1
        pair = before @ (base ** np.arange(CONTEXT))
        new = np.unique(pair)
        new = new[np.isnan(self.known[new])]
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            score = m.predicted(np.stack([part // base**i % base for i in range(CONTEXT)], axis=1)) @ m.target.T + m.bias
            top = score.max(axis=1)
            self.known[part] = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
        out = np.empty(len(entries))
        for at in range(0, len(entries), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = np.einsum("ij,ij->i", m.predicted(before[part]), m.target[entries[part]]) + m.bias[entries[part]] - self.known[pair[part]]
        return out / math.log(10)


def neural_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``entry_score`` instead of its entries."""
    flat = docs.sparkSession.sparkContext.broadcast(model.flat().tobytes())
    rest = [c for c in docs.columns if c != "entries"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, entries, sizes in parts_of(batch, 0, batch.schema.get_field_index("n_tokens")):
                logs = Scorer.of(flat.value).logs(entries, contexts(entries, sizes))
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))
                own = batch.slice(start, stop - start).columns[1:]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sums)], [*rest, "entry_score"])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.select(rest).dtypes)
    return docs.select("entries", *rest).mapInArrow(score, f"{kinds}, entry_score double")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row, learning from those not held out."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = staged(word_counts(texts.where(~held_out())), "word-counts")
    counts = Counts.of(table)
    rows = staged(sequences(texts, docs.sparkSession.sparkContext.broadcast(counts)), "sequences")
    model = train(rows.where(~held_out()), counts)

    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    seen = rare.join(table, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = seen.groupBy("key").agg(
        F.sum("times").alias("n_rare"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + SMOOTH)).alias("rare_logs")
    )
    scored = neural_scores(rows.select("key", "doc_id", "entries", "n_tokens", "n_common", "n_rest", "logs", "rest_logs"), model)
    whole = scored.join(sums, "key", "left")
    n_rare, rare_logs = F.coalesce("n_rare", F.lit(0)), F.coalesce("rare_logs", F.lit(0.0))
    return whole.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * counts.log_total).alias("base_score"),
        (F.col("entry_score") + F.col("rest_logs") + rare_logs - (F.col("n_rest") + n_rare) * counts.log_rest).alias("score"),
    )
