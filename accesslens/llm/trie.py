"""The prefix trie of rebuilt conversations, from composable fingerprints.

Conversation c is rebuilt as a head of its base's first turns and c's own turns
after as many.  No rebuilt text is ever made: a run of turns t1..tn has the
fingerprint (sum of t_j * B ** (j - 1), B ** n) modulo a prime, and

    (s, v) * (t, w) = (s + v * t, v * w)

is that of two runs put together.  So the prefix sums of the stored
conversations give that of every rebuilt prefix: a head's times the quotient
of two own prefixes.  Two primes make 62 bits.

1. Turns are numbered and summed in stretches of a global sort, whose sums are
   then composed: a conversation may fill many tasks.
2. Rebuilt turns, as references to stored ones, are grouped by depth and
   fingerprint to nodes.  A node is proved when all its members refer to equal
   last turns (SHA-256 of role and text, kept with the stored turn) and to one
   parent; with its parent proved, the prefixes are equal.  Should one fail,
   all is done again with another B.
3. A conversation owns the nodes whose smallest member it is: a chain down to
   its end.  Chains hang on chains; subtree sums are running sums along a chain,
   with the totals of the chains below it added by pointer doubling, in as many
   rounds as the logarithm of their nesting.
4. Ends of a node are joined to texts of bounded size in the tasks of a global
   sort; only these texts meet in the task that digests the node, as a stream.

Defined cases: null roles and texts are empty, null turns come first, equal
turn numbers are ordered by role and text, repeated rows are turns of their
own, and rows with a null conversation id take no part.  Very long texts are
only hashed and counted.  An empty table gives no rows, not even a root.
Other columns are ignored.  Numbers follow the sign of a negative id as Spark
does: the base of -1 is 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

GROUP, HEADS = 20, 4
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = ((1_103_515_245, 1_597_334_677), (1_220_703_125, 1_340_780_792), (742_938_285, 950_706_376))
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a chain that one window adds up, and characters of ids joined in one text.
STRETCH = 1 << 16
JOINED = 1 << 16
NODE = ["depth", "f0", "f1"]
END_TEXTS = "depth long, f0 long, f1 long, first long, ids string"
END_DIGESTS = "depth long, f0 long, f1 long, ends_sha256 string"


def power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent`` modulo ``prime``, by the exponent's bits."""
    out: Column = F.lit(1).cast("long")
    for k in range(40):
        factor = pow(base, 1 << k, prime)
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << k)) != 0, F.lit(factor).cast("long")).otherwise(F.lit(1).cast("long")) % prime
    return out


def _of(column: Column, values: list[int]) -> Column:
    """The entry of a short list of longs that ``column`` numbers from 0."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (column + 1).cast("int"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, i, words, digest``: turns in order, numbered from 1
    in each stretch (``part``) of a conversation."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    turns = turns.where("conv_id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    turns = turns.select("conv_id", F.monotonically_increasing_id().alias("at"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.unhex(digest).alias("digest"))
    turns = staged(turns, "sorted-turns").withColumn("part", F.shiftright("at", 33))
    return turns.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")).cast("long")).drop("at")


def prefix_fingerprints(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """``conv_id, pos, words, digest`` with the fingerprints ``s0, s1`` of the
    prefix up to the turn, and ``p0, p1`` of that before it."""
    local = turns
    for k, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        value = F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(prime))
        local = local.withColumn(f"t{k}", value * power(base, F.col("i") - 1, prime) % prime)
    along = Window.partitionBy("conv_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("conv_id", "part", "i", "words", "digest", "t0", "t1", *[(F.sum(f"t{k}").over(along) % prime).alias(f"l{k}") for k, prime in enumerate(PRIMES)])
    whole = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"t{k}").alias(f"l{k}") for k in range(2)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, (base, prime) in enumerate(zip(bases, PRIMES, strict=True)):
        whole = whole.withColumn(f"v{k}", power(base, F.col("ahead"), prime))
        whole = whole.withColumn(f"o{k}", F.coalesce(F.sum(F.col(f"v{k}") * (F.col(f"l{k}") % prime) % prime).over(before), F.lit(0)) % prime)
    joined = local.join(whole.select("conv_id", "part", "ahead", "v0", "v1", "o0", "o1"), ["conv_id", "part"])
    up_to = lambda k, value: (F.col(f"o{k}") + F.col(f"v{k}") * F.pmod(value, F.lit(PRIMES[k]))) % PRIMES[k]
    return joined.select(
        "conv_id", (F.col("ahead") + F.col("i")).alias("pos"), "words", "digest",
        *[up_to(k, F.col(f"l{k}")).alias(f"s{k}") for k in range(2)],
        *[up_to(k, F.col(f"l{k}") - F.col(f"t{k}")).alias(f"p{k}") for k in range(2)],
    )


def plans(turns: DataFrame) -> DataFrame:
    """How each conversation is rebuilt: ``own`` turns of its base ``base`` are
    cut at ``head``, of which the base has ``kept``; ``b0, b1`` are the
    fingerprints of that head and ``c0, c1`` those of what is cut off."""
    starts = [F.max(F.when(F.col("pos") == j, F.col(f"s{k}"))).alias(f"s{k}_{j}") for k in range(2) for j in range(1, HEADS)]
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"), *starts)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("head", head)
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("own").alias("held"), *[F.col(f"s{k}_{j}").alias(f"h{k}_{j}") for k in range(2) for j in range(1, HEADS)])
    convs = convs.join(bases, "base", "left").withColumn("kept", F.least("head", F.coalesce("held", F.lit(0))))
    prefix = lambda name, k, at: F.element_at(F.array(F.lit(0).cast("long"), *[f"{name}{k}_{j}" for j in range(1, HEADS)]), (F.col(at) + 1).cast("int"))
    return convs.select(
        "conv_id", "base", "own", "head", "kept", (F.col("kept") + F.greatest(F.lit(0), F.col("own") - F.col("head"))).alias("depths"),
        *[prefix("h", k, "kept").alias(f"b{k}") for k in range(2)], *[prefix("s", k, "head").alias(f"c{k}") for k in range(2)],
    )


def rebuilt(turns: DataFrame, rebuild: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """``conv_id, depth, f0, f1, p0, p1, words, digest, ends``: every turn of
    every rebuilt conversation, by reference to the stored turn."""
    heads = rebuild.where("kept > 0").select("conv_id", "base", "depths", F.explode(F.sequence(F.lit(1).cast("long"), "kept")).alias("depth"))
    stored = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), F.col("s0").alias("f0"), F.col("s1").alias("f1"), "p0", "p1", "words", "digest")
    heads = heads.join(stored, ["base", "depth"])
    tails = turns.join(rebuild.where("own > head"), "conv_id").where("pos > head").withColumn("depth", F.col("kept") + F.col("pos") - F.col("head"))

    def composed(name: str, k: int) -> Column:
        base, prime = bases[k], PRIMES[k]
        suffix = F.pmod(F.col(f"{name}{k}") - F.col(f"c{k}"), F.lit(prime)) * _of(F.col("head"), [pow(base, -j, prime) for j in range(HEADS)]) % prime
        return (F.col(f"b{k}") + _of(F.col("kept"), [pow(base, j, prime) for j in range(HEADS)]) * suffix) % prime

    own = [composed("s", k).alias(f"f{k}") for k in range(2)] + [composed("p", k).alias(f"p{k}") for k in range(2)]
    tails = tails.select("conv_id", "depth", *own, "words", "digest", "depths")
    both = tails.unionByName(heads.select(tails.columns))
    return both.select("conv_id", "depth", "f0", "f1", "p0", "p1", "words", "digest", (F.col("depth") == F.col("depths")).alias("ends"))


def grouped(rows: DataFrame) -> DataFrame:
    """The nodes below the root; ``proved`` where all members agree on the
    last turn and on the parent."""
    same = lambda c: F.min(c) == F.max(c)
    return rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p0").alias("p0"), F.min("p1").alias("p1"),
        F.max("words").alias("words"), (same("digest") & same("p0") & same("p1")).alias("proved"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, rising, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, size = None, [], 0
        for batch in batches:
            out = []
            for *key, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != node or size >= JOINED):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                node, size = key, size + 12
                held.append(conv_id)
            if out:
                yield _texts(out)
        if held:
            yield _texts([(*node, held[0], ",".join(map(str, held)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node:
                        out.append((*node, hashed.hexdigest()))
                    node, hashed = key, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            if out:
                yield _digests(out)
        if node:
            yield _digests([(*node, hashed.hexdigest())])

    order = [*NODE, "conv_id"]
    texts = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, END_TEXTS)
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, END_DIGESTS)


def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [field.split() for field in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, kinds[k]) for values, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, END_TEXTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, END_DIGESTS)


def chain_totals(chains: DataFrame) -> DataFrame:
    """``conv_id, parent, at, saved, leaves``: sums over each chain and all
    chains that hang on it, however deep.

    After round k a chain has those of all within 2 ** k steps, and points at
    the chain 2 ** k steps above it."""
    now = staged(chains.withColumn("up", F.col("parent")), "chains")
    while now.where("up IS NOT NULL").limit(1).count():
        given = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        after = now.join(above, "up", "left").join(given, "conv_id", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")]
        now = staged(after.select("conv_id", "parent", "at", *added, F.col("next").alias("up")), "chains")
    return now.drop("up")


def suffix_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Each node's sums over its chain from itself down; long chains are added
    in stretches first."""
    nodes = nodes.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    whole = nodes.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    below = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "stretch", *[F.coalesce(F.sum(f"all_{c}").over(below), F.lit(0)).alias(f"below_{c}") for c in columns])
    along = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    added = {c: F.sum(c).over(along) for c in columns}
    summed = nodes.withColumns(added).join(whole, ["conv_id", "stretch"])
    return summed.withColumns({c: F.col(c) + F.col(f"below_{c}") for c in columns}).drop("stretch", *[f"below_{c}" for c in columns])


def prefix_trie(conversations: DataFrame, *, bases: tuple[tuple[int, int], ...] = BASES) -> DataFrame:
    """One row for each node of the trie, with its counts and subtree sums."""
    numbered = staged(numbered_turns(conversations), "numbered-turns")
    for pair in bases:
        turns = staged(prefix_fingerprints(numbered, pair), "turns")
        rebuild = staged(plans(turns), "rebuild")
        rows = staged(rebuilt(turns, rebuild, pair), "rebuilt")
        below = staged(grouped(rows), "nodes")
        if not below.where("NOT proved").limit(1).count():
            break
    else:
        raise ArithmeticError("different prefixes share fingerprints under all bases")

    zero = F.lit(0).cast("long")
    root = rebuild.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("f0"), zero.alias("f1"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), zero.alias("words"))
    nodes = below.drop("proved").unionByName(root)
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("f0"), F.col("p1").alias("f1")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted-nodes")

    saved = (F.col("n_convs") - 1) * F.col("words")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    valued = nodes.withColumn("saved", saved).withColumn("leaves", leaf)
    chains = valued.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by(F.struct("p0", "p1"), "depth").alias("p"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = chains.select("conv_id", (F.col("top") - 1).alias("depth"), F.col("p.p0").alias("f0"), F.col("p.p1").alias("f1"), "saved", "leaves")
    chains = chains.join(nodes.select(*NODE, F.col("conv_id").alias("parent")), NODE, "left")
    totals = staged(chain_totals(chains.select("conv_id", "parent", F.col("depth").alias("at"), "saved", "leaves")), "chain-totals")

    hung = totals.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    valued = valued.join(hung, ["conv_id", "depth"], "left")
    valued = valued.withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", zero) for c in ("saved", "leaves")})
    summed = suffix_sums(valued.select("conv_id", *NODE, "n_convs", "n_children", "saved", "leaves"), ["saved", "leaves"])

    ends = rows.where("ends").select("conv_id", *NODE).unionByName(rebuild.where("depths = 0").select("conv_id", zero.alias("depth"), zero.alias("f0"), zero.alias("f1")))
    out = summed.join(end_digests(ends), NODE, "left").join(totals.select("conv_id", "parent", "at"), "conv_id")
    parent = F.when(F.col("depth") == F.col("at") + 1, F.col("parent")).otherwise(F.col("conv_id"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
