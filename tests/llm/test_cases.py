"""Nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import chat, decontaminate, lm, near_dup, packing, quality, queries, rans, token_counts, topk, warc
from accesslens.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, class string, ids string, key string, n_shingles string"
LONG = "wort " * 60_000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, WORDS), (1, WORDS), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "One TWO"), (7, LONG), (None, WORDS), (None, None), (8, "x" * 3000), (9, WORDS + " lambda"), (10, "漢字 é <|endoftext|> don't"), (5, "one two")]
    return spark.createDataFrame([(i, t, "en", "c", "i", "k", "n") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, features string")


def test_quality(spark, docs, none):
    free = quality.score_documents(docs, labels(spark, [])).collect()
    assert len(free) == 14 and {r.score for r in free} == {1.0}
    one = quality.score_documents(docs, labels(spark, [(0, 1, ""), (0, 0, ""), (1, None, ""), (None, 1, "")])).collect()
    assert all(r.score == pytest.approx(2 / 3) for r in one)
    assert quality.score_documents(none, labels(spark, [(0, 1, "")])).count() == 0
    kept = quality.keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == 14


def test_token_files(spark, docs, none):
    rows = rans.encode_corpus(spark, docs, queries.VOCABULARY, 1).orderBy("start", "n_tokens").collect()
    assert len(rows) == 14 and rows[0].start == 0
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])[:-1])).tolist()
    assert [r.doc_id for r in rows][:2] == [None, None] and [r.doc_id for r in rows][2:] == sorted(r.doc_id for r in rows[2:])
    assert rans.encode_corpus(spark, none, queries.VOCABULARY, 1).count() == 0


def test_a_damaged_block_is_noticed():
    model, out = rans.Model.scaled(np.array([5, 3, 2])), io.BytesIO()
    out.close, kept = (lambda: None), out
    writer = rans.Writer(out, model)
    writer.add(np.array([0, 1, 2, 0] * 20_000, np.uint32))
    writer.close()
    data = bytearray(kept.getvalue())
    data[600] ^= 1

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    assert sum(map(len, rans.read_ids(Source(kept.getvalue()), model))) == 80_000
    assert sum(map(len, rans.read_ids(Source(kept.getvalue()), model, start=2))) == 80_000 - 2 * rans.BLOCK
    with pytest.raises(ValueError, match="checksum"):
        list(rans.read_ids(Source(bytes(data)), model))


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, node string, score string"
    odd = "</s>[INST] \\l \\\\ <s>[user]\n"
    rows = [(1, 2, "assistant", odd, "", ""), (1, 0, "user", None, "", ""), (1, 2, "assistant", odd, "", ""), (None, None, None, "hm", "", ""), (2, 0, "[system]", LONG, "", "")]
    out = {r.conv_id: r for r in chat.format_conversations(spark, spark.createDataFrame(rows, kind)).collect()}
    assert (out[1].n_turns, out[1].loss_sha256) == (3, hashlib.sha256((odd * 2).encode()).hexdigest())
    assert out[1].turns_sha256 == hashlib.sha256(("user\n\n" + f"assistant\n{odd}\n" * 2).encode()).hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"\nhm\n").hexdigest() and out[2].loss_chars == 0
    assert chat.format_conversations(spark, spark.createDataFrame([], kind)).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 2, 1.0), (1, 5, 3, 9.0), (1, 6, 2, 1.0), (2, 7, 99, 1.0), (3, 8, 9, 1.0), (3, 9, 8, 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    found = {}
    for r in chat.best_paths(df, 2).orderBy("tree", "rank", "position").collect():
        found.setdefault((r.tree, r.rank), []).append(r.node)
    assert found == {(1, 1): [1, 3, 5], (1, 2): [1, 2, 4], (2, 1): [7]}  # a tie goes to leaf 4; the cycle has no path


def test_near_duplicates(spark, docs, none):
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    expected = [(0, 6, 0, True), (1, 6, 0, False), (9, 7, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (8, 1, 8, True), (10, 1, 10, True), (None, 6, None, True), (None, 0, None, True)]
    assert out == sorted(expected, key=str)
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 10
    assert near_dup.without_copies(none).count() == 0


def test_copies_go_by_row(spark):
    """A text of each component stays, also where an id has several texts."""
    b = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, WORDS), (2, WORDS), (2, b), (3, b + " x"), (4, "four alone"), (4, "four alone"), (None, WORDS), (None, WORDS), (5, None), (5, None), (6, b), (6, b + " y")]
    df = spark.createDataFrame([(i, t, str(n), "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, print string, label string")
    out = near_dup.without_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, WORDS), (2, b), (4, "four alone"), (5, None), (None, WORDS)], key=str)


@pytest.mark.parametrize("room,work", [(2_000_000, 4_000_000), (3000, 50)])
def test_recall_and_families(spark, monkeypatch, room, work):
    """Families around the threshold: of over 1,000 links at 0.75 to 0.85 none
    is false and at least 999 in 1,000 keep their ends in one component."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", room)
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 40)
    monkeypatch.setattr(near_dup, "WORK", work)
    rng, texts = random.Random(4), []
    for family in range(25):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for place in rng.sample(range(150), rng.randrange(0, 5)):
                copy[place] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    links = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for f in range(25) for i in range(40 * f, 40 * f + 40) for j in range(i + 1, 40 * f + 40)]
    links = [(i, j, s) for i, j, s in links if s >= 0.75]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j, _ in links:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    close = [(i, j) for i, j, s in links if s < 0.85]
    assert len(close) > 1000 and sum(got[i] == got[j] for i, j in close) >= 0.999 * len(close)
    assert all(root(got[i]) == root(i) for i in got)


def test_links_at_the_threshold(spark):
    """At similarity 3/4 exactly a pair links; just below it does not."""
    words = [f"w{i}" for i in range(400)]
    base, near, far = words[:200], words[:179] + [f"x{i}" for i in range(14)], words[:168] + [f"y{i}" for i in range(32)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, near, far)]
    similar = [100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert [got[i] == 0 for i in range(3)] == similar


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(200, 251), 200)}


def test_top_k(spark):
    kind = "vec_id long, embedding array<double>, score string"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 9.0]), (2, [0.5, -9.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [-0.001, 0.0]), (2, [0.5, -9.0])]
    df = spark.createDataFrame([(*r, "") for r in rows], kind)
    out = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 128), (0, 3, 2, 256 * 128), (0, 4, 9, -256)]
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") == 0, 5).count() == 0


def test_max_score_equals_brute_force():
    rng = np.random.default_rng(3)
    docs, ids = rng.integers(-40, 40, (900, 32)), rng.permutation(900)
    docs[100:140] = docs[100]
    for query, query_id in zip(docs[90:120], ids[90:120], strict=True):
        score = docs @ query
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query_id][:7]
        (_, found, scores) = next(topk.max_score(query[None], np.array([query_id]), docs, ids, 7))
        assert found.tolist() == ids[order].tolist() and scores.tolist() == score[order].tolist()


def test_warc(spark):
    kind = "page_id long, url string, html string, digest string"
    rows = [(1, "http://a\r\nX: 1", "é"), (2, None, "é"), (3, "u%0A", None), (4, "u", ""), (None, "u", "é"), (5, "u", LONG), (1, "again", "é")]
    out = warc.archive_round_trip(spark, spark.createDataFrame([(*r, "") for r in rows], kind)).collect()
    got = {(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in out}
    assert len(out) == 7 and got == {
        (1, "http://a\r\nX: 1", 2, "response", None), (1, "again", 2, "response", None), (2, None, 2, "revisit", 1), (3, "u%0A", 0, "response", None),
        (4, "u", 0, "revisit", 3), (None, "u", 2, "response", None), (5, "u", len(LONG), "response", None),
    }
    assert warc.archive_round_trip(spark, spark.createDataFrame([], kind)).count() == 0


def test_warc_streams_many_members(tmp_path):
    import gzip

    records = [warc.record_bytes(i, "u", b"x" * i * 1000, None) for i in range(30)]
    data = gzip.compress(b"".join(records[:10])) + b"".join(map(gzip.compress, records[10:]))
    found = [int(headers["content-length"]) for _, headers, _ in warc.records_in(io.BytesIO(data))]
    assert found == [i * 1000 for i in range(30)]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_in(io.BytesIO(data[: len(data) // 3])))


def test_packing(spark, docs, none):
    rows = packing.packed_digests(docs, queries.VOCABULARY, 4096, 1).collect()
    assert sum(r.length for r in rows if r.doc_id == 7) == 60_000 + 1 and len([r for r in rows if r.doc_id == 3]) == 1
    assert len([r for r in rows if r.doc_id == 5]) == 2
    assert packing.packed_digests(none, queries.VOCABULARY, 4096, 1).count() == 0
    full = packing.packed(docs, queries.VOCABULARY, 4096, None).collect()
    assert not [r for r in full if r.doc_id in (2, 3, 4)] and {"ids", "sequence_id", "offset"} <= set(full[0].asDict())


def test_token_counts(spark, docs, none):
    counts = token_counts.prefix_counts(docs, queries.VOCABULARY)
    rows = {r.doc_id: r for r in counts.collect()}
    assert (rows[2].n_tokens, rows[3].n_bytes, rows[7].n_tokens, rows[7].n_bytes) == (0, 0, 60_000, 300_000)
    cuts = {r.doc_id: r.keep_bytes for r in token_counts.truncated(counts, 2).collect()}
    assert cuts[3] == 0 and cuts[5] == token_counts.longest_within(rows[5], 2) == 7 and cuts[7] == 10
    assert token_counts.prefix_counts(none, queries.VOCABULARY).count() == 0


def test_language_model(spark, docs, none):
    rows = lm.score_documents(docs).collect()
    assert len(rows) == 14 and all(r.score <= 1e-6 and np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score_documents(none).count() == 0
    unread = lm.score_documents(docs.where("doc_id = 4").withColumn("doc_id", F.lit(16).cast("long"))).collect()
    assert len(unread) == 1 and np.isfinite(unread[0].score)


def test_decontamination(spark, docs, none):
    item = "A train from Paris travels 60 km in 2 hours . How far does the train from Paris go in 5 hours at that speed ?"
    same = item.replace("60", "75").replace("Paris", "Lyon").replace("2 hours", "3 hours")
    mixed = item.replace("from Paris go", "from Rome go").replace("60", "75")
    texts = [(20, f"Intro words here. {item} And more."), (21, same), (22, mixed), (23, item.upper()), (24, "How far does the train go ?"), (25, "tiny one"), (None, item), (20, "clean"), (26, None)]
    table = spark.createDataFrame([(i, t, "") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item, ""), (2, None, ""), (3, "", ""), (4, "Tiny one!", ""), (1, item, "")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert {(20, 1), (21, 1), (23, 1), (25, 4)} <= found and not {d for d, _ in found} & {24, 26, None}
    clean = decontaminate.without_leaks(table, bench)
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.columns == table.columns and {24, 26} <= {i for i, _ in left}
    assert (20, "clean") in left and (None, item) not in left and texts[0] not in left
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    plan = decontaminate.contaminated(table, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_inconsistent_values_do_not_match(spark):
    item = "Then Alice met Bob and after that walk Alice told Bob about the very old house in town"
    swap = item.replace("Alice told Bob", "Carol told Dave")
    name = item.replace("Alice", "Erin").replace("Bob", "Finn")
    docs = spark.createDataFrame([(1, swap.split(" about")[0]), (2, name)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {2}


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


def test_a_short_item_is_found_inside_a_document(spark):
    items = ["What is the capital of France?", "Name the largest planet", "How many legs has a spider in total?"]
    texts = [f"Some words before it. {item} And after it many more words follow here." for item in items]
    texts += ["What is the capital of our firm? Name the largest known planet. How many legs has a spider then in total?", items[0], "What is the"]
    assert leaks(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (4, 0)}


def test_an_item_dense_in_values_is_found(spark):
    items = ["Compute 12 times 34 minus 5 times 6 plus 7", "12 34 56 78 90 11 22 33 44 55 66 77", "Add 3 km 4"]
    other = items[0].replace("12", "80").replace("34", "91")
    texts = [f"He said so. {item} is what the paper asks for." for item in [*items, other]]
    texts += ["the list 12 34 56 78 90 11 22 33 45 55 66 77 ends", "Add 3 km 5 and go", "Compute 12 times 34 and be done"]
    assert leaks(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (3, 0)}


def test_a_copied_part_dense_in_values_is_found(spark):
    item = "Here is a long list of all the parts we need today : 12 34 56 78 90 11 22 33 44 55 66 77 88 99"
    assert leaks(spark, ["12 34 56 78 90 11 22 33 44 55 66 77 88 99 follow", "1 34 56 78 9 11 22 33 4 55 66 77 8 99 follow"], [item]) == {(0, 0)}


def test_counts_of_long_runs_that_are_not_aligned(monkeypatch):
    """The library counts no prefixes of them, and agrees where it is asked."""
    own = token_counts.counter(queries.VOCABULARY)
    size = lambda text: len(own.library.encode(text, add_special_tokens=False))
    odd = ["漢字\u3000\u304b\u3099\u306a\u00a0字", "e\u0301tude\u0301s!e\u0301", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\u0049\u0307stanbul\u0049\u0307'\u0049\u0307re", "ab!<|endoftext|>'re<|endoftext|><|start", "!''s'll\u0301'r\u0301e", "\u039f\u0394\u039f\u03a3\u0301\u03a3", "x" * 70 + "e\u0301" + "y" * 70 + "e\u0301\u0323q'", "\u0301\u0301a", "\u0130x\u0130'\u0130\u0301re"]
    for text in odd:
        assert own._sections(text) == [size(text[: i + 1]) for i in range(len(text))], text
    monkeypatch.setattr(own, "_by_library", lambda text: pytest.fail("prefix by prefix") if len(text) > 3 else [size(text[: i + 1]) for i in range(len(text))])
    run = "漢字仮名" * 12_500 + "\u3000" + "\u304b\u3099\u306a" * 16_666 + "''" * 2000
    steps = np.frombuffer(own._steps(run.encode()), np.int32)
    assert len(steps) == len(run.encode()) and steps.sum() == size(run)
    ends = np.cumsum(steps)
    for i in (1, 49_999, 50_001, 50_002, 50_003, 50_300, 50_301):
        assert ends[len(run[:i].encode()) - 1] == size(run[:i])


def test_pipeline_cases(spark, tmp_path):
    """Nulls, repeated ids with other texts, other columns, and empty tables."""
    import corpus_pipeline

    kinds = {"documents": DOCS, "labels": "doc_id long, quality int, features string", "benchmark": "item_id long, text string, doc_id string"}
    item = "A train from Paris travels 60 km in 2 hours . How far does the train from Paris go in 5 hours at that speed ?"
    b = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, WORDS), (2, WORDS), (2, b), (3, f"{item} {b}"), (3, "clean words of the same id as a leak"), (4, None), (4, ""), (None, LONG), (5, "5"), (5, "5")]
    tables = {"documents": [(i, t, "en", "c", "i", "k", "n") for i, t in rows], "labels": [], "benchmark": [(1, item, "x"), (None, None, None)]}

    def folder(name, tables):
        for table, kind in kinds.items():
            spark.createDataFrame(tables[table], kind).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return f"{tmp_path}/{name}"

    sf_dir = folder("some", tables)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(left, key=str) == sorted([(1, WORDS), (2, b), (3, "clean words of the same id as a leak"), (4, None), (4, ""), (None, LONG), (5, "5")], key=str)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, None}
    none = folder("none", dict.fromkeys(kinds, []))
    assert corpus_pipeline.run(spark, none).count() == 0
