"""Top-k search over many shards and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import topk
from accesslens.llm.staging import staged


def brute_force(queries, query_ids, docs, doc_ids, k):
    """Ids and scores of the k best for each query, in whole numbers of any size."""
    for query, query_id in zip(queries.tolist(), query_ids.tolist(), strict=True):
        scores = [sum(x * y for x, y in zip(query, doc, strict=True)) for doc in docs.tolist()]
        order = sorted((i for i in range(len(scores)) if doc_ids[i] != query_id), key=lambda i: (-scores[i], doc_ids[i]))[:k]
        yield [int(doc_ids[i]) for i in order], [scores[i] for i in order]


@pytest.mark.parametrize(("size", "length"), [(0, 3), (3, 8), (40, 32), (3_000, 24), (1 << 20, 5), (1 << 25, 8)])
@pytest.mark.parametrize("k", [1, 5, 60])
def test_best_over_several_shards(size, length, k):
    rng = np.random.default_rng(5)
    docs, ids = rng.integers(-size, size + 1, (210, length)), rng.integers(0, 200, 210)
    docs[50:60] = docs[50]
    best = topk.Best(docs[::6].copy(), ids[::6].copy(), k)
    for at in range(0, 210, 45):
        best.search(topk.Shard(docs[at : at + 45], ids[at : at + 45]))
    for row, (found, scores) in enumerate(brute_force(docs[::6], ids[::6], docs, ids, k)):
        assert best.ids[best.row == row].tolist() == found and best.scores[best.row == row].tolist() == scores


def test_top_k_sends_nothing_through_the_driver(spark, monkeypatch):
    plans = []

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, purpose)

    monkeypatch.setattr(topk, "staged", seen)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 30
    # Neither the blocks of queries nor copies of them, one for each shard.
    assert not [plan for plan in plans if "Broadcast" in plan or "Generate" in plan]


def test_top_k_over_many_blocks(spark, monkeypatch):
    for name, size in (("SHARD", 16), ("BLOCK", 4), ("GROUP", 8)):
        monkeypatch.setattr(topk, name, size, raising=False)
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.integers(-9, 10, 6 if i % 3 else 4).tolist()) for i in rng.integers(0, 120, 240)] + [(0, [1] * 4), (0, [1] * 4)]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, 5).collect()
    want = {}
    for length in (4, 6):
        ids, cells = (np.array(x) for x in zip(*[r for r in rows if len(r[1]) == length], strict=True))
        asked = ids % 4 == 0
        for query_id, (found, scores) in zip(ids[asked].tolist(), brute_force(cells[asked], ids[asked], cells, ids, 5), strict=True):
            want.setdefault(query_id, []).extend(zip((-s for s in scores), found, strict=True))
    want = {(q, rank, i, -s) for q, hits in want.items() for rank, (s, i) in enumerate(sorted(hits)[:5], 1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
