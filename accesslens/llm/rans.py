"""Token ids as range-asymmetric-numeral-system files with static tables.

One *model* (the frequency of every id over the whole corpus, scaled to a sum
of ``2**BITS``) is shared by all files.  A file is a sequence of blocks; each
block holds ``BLOCK`` ids (the last fewer), dealt over interleaved lanes with
states of their own, and is decoded without any other block.  The table of
blocks at the end of a file is the checkpoint list for parallel decoding: byte
offset, number of ids, id position in the file, crc32 of the ids, crc32 of the
bytes.  All lanes of many blocks are coded together by numpy.

File layout, little-endian: ``MAGIC``, then the blocks, then the table, then
the table's offset and number of rows as two unsigned 64-bit numbers.  A block
is its lanes' final states (``LANES`` unsigned 64-bit numbers) and then 32-bit
words in the order the decoder reads them.

Documents go into files in ascending id order: a range partition of the
documents' ids, each partition one file, the files' first positions from the
prefix sums of their sizes.  Equal ids (repeated rows) stay neighbours, ordered
by their ids' digest; a null id sorts first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm import files
from accesslens.llm.encoder import encoder
from accesslens.llm.staging import output_folder, staged
from accesslens.llm.words import slices, text_of

MAGIC = b"RANSIDS1"
BITS = 20
LOW = np.uint64(1 << 31)
BLOCK, LANES = 1 << 15, 64
TABLE = np.dtype([("offset", "<u8"), ("size", "<u8"), ("first", "<u8"), ("count", "<u4"), ("ids_crc", "<u4"), ("bytes_crc", "<u4"), ("pad", "<u4")])
IDS = "doc_id long, n_tokens long, ids binary"
MANIFEST = "path string, part int, tokens long, documents long"
#: Ids coded together: blocks of one call.
TOGETHER = 64


class Model:
    """Scaled frequencies; every id that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def scaled(cls, counts: np.ndarray) -> "Model":
        """Counts to frequencies that sum to ``2**BITS``: floor with a minimum
        of one, the difference taken from or given to the largest."""
        total, whole = int(counts.sum()), 1 << BITS
        if (counts > 0).sum() > whole:
            raise ValueError("more distinct ids than slots")
        if not total:
            return cls(np.array([whole], np.int64))
        share = counts.astype(np.float64) / total * whole
        freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
        spare = whole - int(freq.sum())
        for i in np.argsort(-freq, kind="stable"):
            if spare >= 0:
                freq[i] += spare
                break
            cut = min(int(freq[i]) - 1, -spare)
            freq[i] -= cut
            spare += cut
        return cls(freq)


def encode_blocks(model: Model, blocks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """``blocks`` is blocks x BLOCK ids, of which the first ``counts[i]`` are
    used.  Position ``j`` belongs to lane ``j % LANES``."""
    n = len(blocks)
    lanes = blocks.reshape(n, BLOCK // LANES, LANES)
    state = np.full((n, LANES), LOW, np.uint64)
    mask, shift, wide = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(BITS)
    words, owner = [], []
    lane = np.arange(LANES)
    for step in range(-(-int(counts.max(initial=0)) // LANES) - 1, -1, -1):
        live = step * LANES + lane < counts[:, None]
        freq = model.freq[lanes[:, step]]
        full = live & (state >= (freq << np.uint64(63 - BITS)))
        # The decoder reads lanes upwards, so words leave in downward order.
        block, which = np.nonzero(full[:, ::-1])
        which = LANES - 1 - which
        words.append((state[block, which] & mask).astype(np.uint32))
        owner.append(block)
        state = np.where(full, state >> shift, state)
        safe = np.where(live, freq, np.uint64(1))
        coded = ((state // safe) << wide) + state % safe + model.first[lanes[:, step]]
        state = np.where(live, coded, state)
    flat = np.concatenate(words[::-1] and [w[::-1] for w in words[::-1]] or [np.zeros(0, np.uint32)])
    owners = np.concatenate(owner and [o[::-1] for o in owner[::-1]] or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(n + 1))
    flat = flat[order].astype("<u4")
    return [state[i].astype("<u8").tobytes() + flat[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)]


def decode_blocks(model: Model, data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The inverse of ``encode_blocks``: blocks x BLOCK ids."""
    n = len(data)
    state = np.stack([np.frombuffer(block, "<u8", LANES) for block in data]).astype(np.uint64) if n else np.zeros((0, LANES), np.uint64)
    streams = [np.frombuffer(block, "<u4", offset=8 * LANES) for block in data]
    sizes = np.array([len(s) for s in streams], np.int64)
    flat = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    out = np.zeros((n, BLOCK // LANES, LANES), np.uint32)
    mask, shift, wide = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(BITS)
    lane = np.arange(LANES)
    for step in range(-(-int(counts.max(initial=0)) // LANES)):
        live = step * LANES + lane < counts[:, None]
        slot = state & mask
        ids = model.symbol[slot]
        out[:, step] = np.where(live, ids, 0)
        state = np.where(live, model.freq[ids] * (state >> wide) + slot - model.first[ids], state)
        low = live & (state < LOW)
        place = at[:, None] + np.cumsum(low, axis=1) - low
        state = np.where(low, (state << shift) | flat[np.where(low, place, len(flat) - 1)], state)
        at = at + low.sum(axis=1)
    return out.reshape(n, BLOCK)


class Writer:
    """Writes ids as blocks; ``close`` adds the table."""

    def __init__(self, sink, model: Model):
        self.sink, self.model, self.rest, self.table = sink, model, [], []
        self.waiting, self.at, self.first = 0, len(MAGIC), 0
        sink.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * TOGETHER:
            self._flush(self.waiting // BLOCK)

    def _flush(self, blocks: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for start in range(0, blocks, TOGETHER):
            part = ids[start * BLOCK : (start + TOGETHER) * BLOCK][: (blocks - start) * BLOCK]
            counts = np.array([min(BLOCK, len(part) - i) for i in range(0, len(part), BLOCK)], np.int64)
            padded = np.full(len(counts) * BLOCK, int(np.argmax(self.model.freq)), np.uint32)
            padded[: len(part)] = part
            for i, data in enumerate(encode_blocks(self.model, padded.reshape(-1, BLOCK), counts)):
                own = part[i * BLOCK : i * BLOCK + counts[i]].astype("<u4").tobytes()
                self.table.append((self.at, len(data), self.first, counts[i], zlib.crc32(own), zlib.crc32(data), 0))
                self.sink.write(data)
                self.at, self.first = self.at + len(data), self.first + int(counts[i])
        left = ids[blocks * BLOCK :]
        self.rest, self.waiting = [left], len(left)

    def close(self) -> None:
        self._flush(-(-self.waiting // BLOCK))
        self.sink.write(np.array(self.table, TABLE).tobytes() + struct.pack("<QQ", self.at, len(self.table)))
        self.sink.close()


def read_table(source) -> np.ndarray:
    size = source.size()
    source.seek(size - 16)
    at, rows = struct.unpack("<QQ", source.read(16))
    source.seek(at)
    return np.frombuffer(source.read(rows * TABLE.itemsize), TABLE)


def read_ids(source, model: Model, start: int = 0) -> Iterator[np.ndarray]:
    """Ids from the ``start``-th block on, a group of blocks at a time."""
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of coded ids")
    table = read_table(source)
    for at in range(start, len(table), TOGETHER):
        rows = table[at : at + TOGETHER]
        data = []
        for row in rows:
            source.seek(int(row["offset"]))
            data.append(source.read(int(row["size"])))
            if zlib.crc32(data[-1]) != row["bytes_crc"]:
                raise ValueError("a block's bytes differ from their checksum")
        counts = rows["count"].astype(np.int64)
        for ids, count, crc in zip(decode_blocks(model, data, counts), counts, rows["ids_crc"], strict=True):
            if zlib.crc32(ids[:count].astype("<u4").tobytes()) != crc:
                raise ValueError("decoded ids differ from their checksum")
            yield ids[:count]


def token_ids(docs: DataFrame, path: str, end_id: int | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of every whole text (null: empty),
    with ``end_id`` appended unless None, as little-endian numbers of 16 bits
    where the vocabulary allows and else 32 (``unpacked`` reads either)."""
    kind = "<u2" if max(encoder(path).size, end_id or 0) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        tail = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for batch in slices(batches):
            ids, counts = own.encode(text_of(batch.column(1)))
            data = memoryview(ids.astype(kind).tobytes())
            ends = (np.cumsum(counts) * int(kind[-1])).tolist()
            blobs = [bytes(data[a:b]) + tail for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            sizes = pa.array(counts + (end_id is not None), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, IDS)


def unpacked(blob: bytes, count: int) -> np.ndarray:
    """The ``count`` ids of one ``ids`` value, of 16 or 32 bits each."""
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * count else "<u4").astype(np.uint32)


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs, from one row of counts a task; the sum of
    all tasks is as long as the vocabulary, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            blobs, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            joined = b"".join(blobs)
            if len(joined) == 2 * sum(counts):  # then every value is of 16 bits
                ids = np.frombuffer(joined, "<u2")
            else:
                ids = np.concatenate([np.zeros(0, np.uint32), *map(unpacked, blobs, counts)])
            part = np.bincount(ids)
            if len(part) > len(total):
                part, total = total, part.copy()
            total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = ids.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_ids(ids: DataFrame, folder: str | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame, Model]:
    """Write ``doc_id, n_tokens, ids`` as coded files in ascending id order.

    Returns the index of documents (doc_id, part, place, first: position
    of its ids in its file, n_tokens), the manifest of files, and the model.
    A file is named by its task attempt; only files in the manifest count.
    """
    spark = ids.sparkSession
    folder = output_folder(spark, folder, "token-ids")
    model = Model.scaled(count_ids(ids))
    shared = spark.sparkContext.broadcast(model.freq.astype(np.uint32))
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    kind = "path string, part int, place long, doc_id long, first long, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        target, path, at, place = None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if target is None:
                target = Writer(files.writer(folder, path.rpartition("/")[2]), Model(shared.value.astype(np.int64)))
            counts = batch.column(1).to_numpy()
            for blob, n in zip(batch.column(2), counts.tolist(), strict=True):
                target.add(unpacked(blob.as_py(), n))
            firsts = at + np.cumsum(counts) - counts
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), batch.column(0), pa.array(firsts), batch.column(1)],
                ["path", "part", "place", "doc_id", "first", "n_tokens"],
            )
            at, place = at + int(counts.sum()), place + n
        if target is not None:
            target.close()

    index = staged(ordered.mapInArrow(write, kind), "token-index")
    manifest = index.groupBy("path", "part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    return index, manifest, model


def read_documents(index: DataFrame, manifest: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files.

    A task decodes whole files and cuts them by the documents' sizes, which
    it gets beside them in order; ``start`` counts the ids of all documents
    before, over all files (there are as many sums as files).
    """
    spark = index.sparkSession
    sums = manifest.orderBy("part").select("part", "tokens").collect()
    starts, total = [], 0
    for row in sums:
        starts.append((row["part"], total))
        total += row["tokens"]
    bases = spark.createDataFrame(starts, "part int, base long")
    shared = spark.sparkContext.broadcast(model.freq.astype(np.uint32))
    rows = index.join(bases, "part").select("path", "place", "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens")
    ordered = rows.repartition(max(1, len(sums)), "path").sortWithinPartitions("path", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value.astype(np.int64))
        path, source, blocks, rest = None, None, iter(()), np.zeros(0, np.uint32)
        for batch in batches:
            out = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if name != path:
                    if source is not None:
                        source.close()
                    path, source = name, files.reader(name)
                    blocks, rest = read_ids(source, own), np.zeros(0, np.uint32)
                parts, have = [rest], len(rest)
                while have < size:
                    parts.append(next(blocks))
                    have += len(parts[-1])
                joined = np.concatenate(parts) if len(parts) > 1 else rest
                out.append(joined[:size].astype("<u4").tobytes())
                rest = joined[size:]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
        if source is not None:
            source.close()

    return ordered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def encode_corpus(spark: SparkSession, docs: DataFrame, path: str, end_id: int | None, folder: str | None = None, **columns: str) -> DataFrame:
    """Tokenise, write coded files in id order, and read them back."""
    ids = staged(token_ids(docs, path, end_id, **columns), "tokens")
    return read_documents(*write_ids(ids, folder))
