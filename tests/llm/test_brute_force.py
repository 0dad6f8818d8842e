"""Queries that SQL cannot express against plain Python over whole tables."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from accesslens.llm import lm, packing, quality, queries, rans, token_counts


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(queries.VOCABULARY)
    return {i: library.encode(text, add_special_tokens=False).ids for i, text in texts.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_quality_separates_held_out_labels(spark, sf_dir):
    rows = {row.doc_id: row for row in queries.op1_quality(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL").collect()
    right = [rows[r.doc_id].predicted == r.quality for r in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert sum(right) > 0.85 * len(right)


def test_token_files(spark, sf_dir, ids):
    rows = {row.doc_id: row for row in queries.op2_token_files(spark, sf_dir).collect()}
    at = 0
    assert set(rows) == set(ids)
    for i in sorted(ids):
        own = [*ids[i], 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(own), crc(own))
        at += len(own)


def test_packing(spark, sf_dir, ids):
    rows = queries.op7_packing(spark, sf_dir).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        places[row.sequence_id].append((row.offset, row.length))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        own, at = [*ids[i], 1], 0
        for k, row in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (row.piece, row.start, row.ids_crc32) == (k, at, crc(own[at : at + row.length]))
            assert row.length == min(4096, len(own) - at)
            at += row.length
        assert at == len(own)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1 + math.ceil(1.02 * sum(r.length for r in rows) / 4096)


def test_token_counts(spark, sf_dir, ids, texts):
    rows = {row.doc_id: row for row in queries.op8_token_counts(spark, sf_dir).collect()}
    for i, text in texts.items():
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(text.encode()), len(ids[i]), len(ids[i]) > 2048)


def test_language_model(spark, sf_dir, texts):
    rows = {row.doc_id: row for row in queries.op9_language_model(spark, sf_dir).collect()}
    split = lambda text: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w] + ["\0end"]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = collections.Counter(w for i, text in texts.items() if not held[i] for w in split(text))
    total, size = sum(counts.values()), len(counts)
    for i, text in texts.items():
        words, row = split(text), rows[i]
        assert (row.held_out, row.n_tokens, row.train_tokens, row.n_known) == (held[i], len(words), total, sum(w in counts for w in words))
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in words), rel=1e-9)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())


def test_language_model_is_normalised():
    model = lm.Model.start(np.arange(lm.VOCABULARY))
    before = np.full((lm.VOCABULARY, 2), 7)
    assert (10 ** lm.Scorer(model).logs(np.arange(lm.VOCABULARY), before)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(300, np.int64)
    found = rng.zipf(1.3, 90_000) % 300
    counts += np.bincount(found, minlength=300)
    model = rans.Model.scaled(counts)
    assert model.freq.sum() == 1 << rans.BITS and ((model.freq > 0) == (counts > 0)).all()
    sizes = np.array([rans.BLOCK, rans.BLOCK, 90_000 - 2 * rans.BLOCK])
    padded = np.zeros(3 * rans.BLOCK, np.uint32)
    padded[:] = np.argmax(counts)
    padded[:90_000] = found
    data = rans.encode_blocks(model, padded.reshape(3, -1), sizes)
    back = rans.decode_blocks(model, data, sizes)
    alone = rans.decode_blocks(model, data[1:2], sizes[1:2])
    assert (back.ravel()[:90_000] == found).all() and (alone[0] == found[rans.BLOCK : 2 * rans.BLOCK]).all()


@pytest.mark.parametrize("capacity,lengths", [(10, [4, 4, 4, 3, 3, 3, 10, 1]), (100, [34] * 7 + [33] * 5 + [1] * 3), (4096, [1366] * 31 + [2731] * 3 + [20] * 999), (8, []), (5, [5])])
def test_plan_fills_without_overlap(capacity, lengths):
    counts = collections.Counter(lengths)
    made = packing.plan(dict(counts), capacity)
    fill = collections.Counter()
    spans = []
    for length, n in counts.items():
        sequence, offset = made.place(np.full(n, length), np.arange(n))
        spans += zip(sequence.tolist(), offset.tolist(), [length] * n, strict=True)
    for sequence, offset, length in sorted(spans):
        assert fill[sequence] == offset
        fill[sequence] += length
    assert all(size <= capacity for size in fill.values()) and sum(fill.values()) == sum(lengths)


def test_every_prefix_count(texts):
    own, library = token_counts.counter(queries.VOCABULARY), Tokenizer.from_file(queries.VOCABULARY)
    import pyarrow as pa

    odd = ["x y é é İ 漢字 don't 'REx 12ab we've", "<|endoftext|>b a<|startoftext|>", "'sre''re aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ſtraße ŒUVRE ǅ"]
    for text in [*odd, *(t[:200] for t in list(texts.values())[:10])]:
        steps, _ = own.differences(pa.array([text]))
        counts = np.concatenate(([0], np.cumsum(steps)))
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(library.encode(text[:i], add_special_tokens=False).ids), text[:i]


def test_prefix_counts_of_all_ascii_characters():
    """Control characters too, next to separators that are not ASCII."""
    import random

    import pyarrow as pa

    own, library, rng = token_counts.counter(queries.VOCABULARY), Tokenizer.from_file(queries.VOCABULARY), random.Random(8)
    characters = [chr(c) for c in range(128)] + list("\x85\xa0\u2028\u3000é漢İ")
    for _ in range(400):
        text = "".join(rng.choice(characters) for _ in range(rng.randrange(1, 14)))
        steps, _ = own.differences(pa.array([text]))
        counts = np.concatenate(([0], np.cumsum(steps)))
        for i in range(len(text) + 1):
            assert counts[len(text[:i].encode())] == len(library.encode(text[:i], add_special_tokens=False).ids), text[:i]


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(1)
    x = rng.random((2000, quality.WIDTH)).astype(np.float32)
    y = ((x[:, 3] > 0.4) & (x[:, 5] < 0.8)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97


def test_pipeline_rows(spark, sf_dir, texts, ids):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [set(texts)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), "test")
        assert docs.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
        kept.append({row.doc_id for row in docs.select("doc_id").collect()})
        assert kept[-1] < kept[-2] or kept[-1] == kept[-2]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {row.doc_id for row in rows} == kept[-1]
    assert sum(row.length for row in rows) == sum(len(ids[i]) + 1 for i in kept[-1])
