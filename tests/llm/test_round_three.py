"""The prefix trie, whitening and the n-gram join against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import ngram_join, queries, trie, whitening

SPACE = "[\x20\x09-\x0d]+"
TURNS = "conv_id long, turn long, role string, text string, depth string, f0 string, digest string"
DOCS = "doc_id long, text string, class string, n_shingles string, block string, shingles string"
VECTORS = "vec_id long, embedding array<double>, x string, n string, component string"


def expected_trie(rows, group=20):
    """``{prefix: (...)}`` by building every rebuilt conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        head, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, group))
        whole = tuple(own.get(base, [])[:head] + turns[head:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    words = lambda t: len([w for w in re.split(SPACE, t) if w])
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * words(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p in members
    )


def trie_rows(df):
    rows = df.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, rows.collect()))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "d", "f", "x") for r in rows], TURNS)


def test_trie_of_the_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert trie_rows(queries.op11_prefix_trie(spark, sf_dir)) == expected_trie(rows)


def test_trie_cases(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c\td  e"])) for c in range(90) for t in range(rng.choice([0, 1, 2, 5, 9]))]
    rows += [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 0, "user", "nobody"), (40, 0, "user", "wort " * 50_000), (-21, 4, "user", "x"), (-20, 1, "user", "y")]
    rows += rows[:40]
    assert trie_rows(trie.prefix_trie(conversations(spark, rows))) == expected_trie(rows)
    assert trie.prefix_trie(conversations(spark, [])).count() == 0


def test_trie_of_nested_chains_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 3)
    monkeypatch.setattr(trie, "JOINED", 30)
    monkeypatch.setattr(trie, "GROUP", 1 << 40)
    rows = [(c, t, "user", "same" if t < c // 2 else f"own {c}") for c in range(1, 30) for t in range(c)]
    rows += [(c, t, "user", "same") for c in range(100, 150) for t in range(2)]
    assert trie_rows(trie.prefix_trie(conversations(spark, rows))) == expected_trie(rows, 1 << 40)


def test_clashing_fingerprints_are_noticed(spark):
    """With powers of 1 the order of turns is lost."""
    rows = [(21 + c, t, "user", text) for c, texts in enumerate(itertools.permutations("abcdef")) if c < 18 for t, text in enumerate(texts[::-1])]
    table = conversations(spark, rows)
    assert trie_rows(trie.prefix_trie(table, bases=((1, 1), *trie.BASES))) == expected_trie(rows)
    with pytest.raises(ArithmeticError):
        trie.prefix_trie(table, bases=((1, 1),))


def expected_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, ((n * x - sums) ** 2).sum(axis=1), values[::-1], axes[:, ::-1], (x - sums / n)


def test_whitening_of_the_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, deviation, values, axes, centred = expected_whitening([r.embedding for r in table])
    out = queries.op12_whitening(spark, sf_dir).orderBy("vec_id", "component").toPandas()
    assert len(out) == 16 * len(table) and set(out.n) == {n}
    found = out.whitened.to_numpy().reshape(-1, 16)
    want = centred @ axes[:, :16] / np.sqrt(values[:16])
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-7
    assert (out.deviation.to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    assert np.allclose(out.explained.to_numpy().reshape(-1, 16), values[:16] / values.sum(), rtol=1e-10)
    assert out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "c") for i, v in rows], VECTORS)


def test_whitening_cases(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(5).round(2).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0, 2.0, 3.0, 4.0, float("-inf")]), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    rows = good + [(200 + i, good[0][1]) for i in range(500)] + [(5, good[5][1]), (None, good[6][1])] + bad
    out = whitening.whiten(vectors(spark, rows)).toPandas()
    assert len(out) == 5 * (60 + 502) and set(out.n) == {60} and out.identity_error.max() < 1e-9
    assert set(out.component) == {1, 2, 3, 4, 5} and out.vec_id.isna().sum() == 5
    assert out.groupby("component").explained.first().sum() == pytest.approx(1)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    wide = [(0, [2.0**34, 0.0]), (1, [-(2.0**34), 1.0]), (2, [0.0, 7.0])]
    x, _, deviation, *_ = expected_whitening([v for _, v in wide])
    exact = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    found = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, wide)).collect()}
    assert max(exact) >= 1 << 63 and [found[i] for i in range(3)] == [d if d < 1 << 63 else None for d in exact]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])).toPandas()
    assert set(flat.component) == {1} and flat.explained.max() == pytest.approx(1)


@pytest.mark.parametrize("seed", range(6))
def test_eigenpairs_are_numbered_right(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 40))
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    true = np.sort(rng.choice([1e-3, 1.0, 1.0 + 1e-13, 2.0, 2.0 + 1e-6, 5.0], size) + (rng.random(size) if seed % 2 else 0))[::-1]
    matrix = axes @ np.diag(true) @ axes.T
    matrix = (matrix + matrix.T) / 2
    values, found = whitening.leading_eigenpairs(matrix, 16)
    assert np.allclose(values, true[:16], atol=1e-11) and np.allclose(found.T @ found, np.eye(len(values)), atol=1e-10)
    assert np.abs(matrix @ found - found * values).max() < 1e-10
    for shift in (0.5, 1.5, 4.0):
        assert whitening.eigenvalues_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "c", "n", "b", "s") for i, t in rows], DOCS)


def expected_join(rows):
    sets = []
    for i, text in rows:
        w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    named = sorted({(i, s) for i, s in sets if i is not None and s}, key=lambda x: x[0])
    distinct = list({s for _, s in named})
    near = {s: [t for t in distinct if 100 * len(s & t) >= 80 * len(s | t)] for s in distinct}
    least, weight = {}, collections.Counter(s for _, s in named)
    for i, s in named:
        if s not in least:
            todo, least[s] = [s], i
            while todo:
                for t in near[todo.pop()]:
                    if t not in least:
                        least[t] = i
                        todo.append(t)
    links = {s: sum(weight[t] for t in near[s]) - 1 for s in distinct}
    return sorted(((i if i is not None else -1), len(s), (least[s] if s else i) if i is not None else -1, (links[s] if s else 0) if i is not None else -1) for i, s in sets)


def join_rows(df):
    gone = F.lit(-1)
    return sorted(map(tuple, df.select(F.coalesce("doc_id", gone), "n_shingles", F.coalesce("component_id", gone), F.coalesce("n_links", gone)).collect()))


def test_join_cases(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long_ = " ".join(f"w{i}" for i in range(60_000))
    rows = [(0, words), (1, words.upper()), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "One TWO"), (5, "one two"), (5, "other words of it"), (None, words), (None, None), (7, long_), (8, long_ + " end"), (9, "漢字 é x y z a b c d e f g h"), (10, "漢字 é x y z a b c d e f g h q")]
    assert join_rows(ngram_join.similar_documents(documents(spark, rows))) == expected_join(rows)
    assert ngram_join.similar_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("classes,room,work", [(1024, 500_000, 1_000_000), (7, 1400, 30)])
def test_join_at_the_threshold(spark, monkeypatch, classes, room, work):
    """Families of copies around 0.8, and a passage that a third of all share."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", room)
    monkeypatch.setattr(ngram_join, "WORK", work)
    rng = random.Random(5)
    passage, rows = [f"p{k}" for k in range(40)], []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 200]))]
        for _ in range(rng.choice([2, 10, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice([f"e{rng.randrange(5)}", f"x{rng.random()}"])
            copy = copy[: len(copy) - rng.randrange(0, 4)] + (passage if rng.random() < 0.3 else [])
            rows.append((len(rows), " ".join(copy)))
    found, expect = join_rows(ngram_join.similar_documents(documents(spark, rows))), expected_join(rows)
    assert found == expect and sum(r[3] for r in expect) > 500


def test_merge_skip_counts():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 9))]
        threshold, start = rng.randrange(1, 6), rng.randrange(0, 20)
        counts = collections.Counter(x for numbers in lists for x in numbers if x >= start)
        found = dict(zip(*ngram_join.merge_skip(lists, threshold, start), strict=True))
        assert found == {x: n for x, n in counts.items() if n >= threshold}
