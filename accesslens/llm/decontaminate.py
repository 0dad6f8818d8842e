"""Benchmark leaks found by template windows, in DataFrame operations only.

A text becomes a template: its words in lower case, with numbers, names and
units replaced by typed placeholders.  Every ``WINDOW`` template words are
hashed and joined with the benchmark's; a question with other numbers or names
gives the same windows.  Where a matching window holds placeholders, the
values in them are checked: along one alignment of document and item the same
value must stand for the same value, both ways.

A *number* starts with a digit.  A *unit* is a word of ``UNITS`` after a
number.  A *name* starts with a capital, is not all capitals and does not
begin a sentence.  Marks other than ``.!?`` are left out; these end sentences
and are left out after that.

A document matches an item by at least ``LEAST`` different windows of it, or
by all if it has fewer.  A window counts by its template if it has ``LITERAL``
plain words.  An item without such a window takes longer ones, just as long as
needed to hold them.  Windows of ``WINDOW`` words with fewer plain words are
compared by their values: they match only a copy.  An item shorter than a
window is one window as a whole, looked for at every place of a document.

Defined cases: null and empty texts match nothing; rows with a null id are not
reported and count as clean; of rows that repeat an id, one that matches makes
the id match; items that repeat are reported each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.staging import staged

WINDOW = 8
LITERAL = 5
LEAST = 3
#: Windows of the benchmark up to which they are broadcast (16 bytes and a
#: row's overhead each); a larger benchmark is joined by shuffling.
BROADCAST_ROWS = 200_000
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Words that measure the number before them.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "gram", "grams", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degrees", "mph", "kmh", "kb", "mb", "gb",
]
SPACE = r"[\x20\x09-\x0D]+"
DROPPED = r"[^\p{L}\p{N}\x20\x09-\x0D.!?]+"


def _starts_with_digit(word: Column) -> Column:
    return F.substring(word, 1, 1).between("0", "9")


def _words(df: DataFrame, text: str) -> DataFrame:
    """``raw``: words with their sentence marks; ``core``: without them."""
    df = df.withColumn("raw", F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), DROPPED, ""), SPACE)).drop(text)
    df = df.withColumn("raw", F.filter("raw", lambda x: x != ""))
    return df.withColumn("core", F.transform("raw", lambda x: F.btrim(x, F.lit(".!?"))))


def _template_word(word: Column, i: Column) -> Column:
    before = F.get("raw", i - 1)
    lower = F.lower(word)
    first = F.substring(word, 1, 1)
    inside = (i > 0) & ~F.substring(before, -1, 1).isin(".", "!", "?")
    return (
        F.when(_starts_with_digit(word), F.lit(NUMBER))
        .when(lower == word, F.when((i > 0) & _starts_with_digit(before) & word.isin(UNITS), F.lit(UNIT)).otherwise(word))
        .when((i > 0) & _starts_with_digit(before) & lower.isin(UNITS), F.lit(UNIT))
        .when(inside & (first != F.lower(first)) & (word != F.upper(word)), F.lit(NAME))
        .otherwise(lower)
    )


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def _hashed(df: DataFrame, words: str, lengths: list[int]) -> tuple[DataFrame, list[str]]:
    """A column for each length: a hash for the window of so many ``words``
    that starts at each.  Windows that run over the end are dropped after
    exploding.  A length between powers of two is two overlapping windows."""

    def joined(hashes: str, by: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, by + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    names = {length: f"{words}_{length}" for length in lengths}
    df, step = df.withColumn("hashes", F.transform(words, lambda x: F.xxhash64(x))), 1
    while True:
        for length in lengths:
            if step <= length < 2 * step:
                df = df.withColumn(names[length], F.col("hashes") if length == step else joined("hashes", length - step))
        if 2 * step > max(lengths):
            return df.drop("hashes"), list(names.values())
        df, step = df.withColumn("hashes", joined("hashes", step)), 2 * step


def templates(df: DataFrame, text: str) -> DataFrame:
    """``template`` of each text, beside the other columns."""
    df = _words(df, text).withColumn("template", F.transform("core", _template_word))
    return df.withColumn("template", F.filter("template", lambda x: x != "")).drop("raw", "core")


def valued_templates(df: DataFrame, text: str) -> DataFrame:
    """``template`` and, aligned with it, the lower-case ``values``."""
    df = _words(df, text)
    both = F.transform("core", lambda x, i: F.struct(_template_word(x, i).alias("word"), F.lower(x).alias("value")))
    df = df.withColumn("both", both).withColumn("both", F.filter("both", lambda x: x["word"] != "")).drop("raw", "core")
    return df.withColumn("template", F.col("both.word")).withColumn("values", F.col("both.value")).drop("both")


def _windows(df: DataFrame, kinds: list[tuple[bool, int]], *keep: str, wanted: Column | None = None) -> DataFrame:
    """``keep`` columns, ``literal``, ``length``, ``at`` and ``hash`` of every
    window of ``kinds``: whether of values or of template words, and how long.

    Empty texts have none: their one null row goes.  The outer form and the
    missing filter on ``size`` matter, since a filter on the array would be
    pushed below the templates and evaluate them again, once for each word.
    """
    df, kept = df.withColumn("size", F.size("template")), []
    for literal, words in ((False, "template"), (True, "values")):
        lengths = sorted(length for of, length in kinds if of == literal)
        if lengths:
            df, names = _hashed(df, words, lengths)
            kept += [F.struct(F.lit(literal).alias("literal"), F.lit(length).alias("length"), F.col(name).alias("hashes")) for length, name in zip(lengths, names, strict=True)]
    if len(kept) == 1:
        (literal, length), hashes = kinds[0], F.col(names[0])
        sized = df.select(*keep, "size", F.lit(literal).alias("literal"), F.lit(length).alias("length"), F.posexplode_outer(hashes).alias("at", "hash"))
    else:
        each = df.select(*keep, "size", F.explode_outer(F.array(*kept)).alias("of"))
        sized = each.select(*keep, "size", "of.literal", "of.length", F.posexplode_outer("of.hashes").alias("at", "hash"))
    return sized.where(F.col("at") <= F.col("size") - F.col("length"))


WINDOWS = "row long, item_id long, item_at int, hash long, literal boolean, length int, slots int, words array<string>, item_values array<string>, needed int, needed_any int"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The columns ``WINDOWS`` of every window.

    ``slots`` is the number of its placeholders; ``needed`` how many template
    windows make a match (null if the item has none), ``needed_any`` how many
    windows of both kinds do.
    """
    items = valued_templates(benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")), "text")
    plain = F.filter(F.transform("template", lambda x, i: F.when(~_is_slot(x), i)), lambda i: i.isNotNull())
    # The fewest template words that hold LITERAL plain ones; null if there are not so many.
    span = F.array_min(F.zip_with(F.slice("plain", LITERAL, F.greatest(F.size("plain"), F.lit(1))), "plain", lambda last, first: last - first + 1))
    size = F.size("template")
    whole = F.when((size < LITERAL) & (F.size("plain") == size), size)
    items = items.withColumn("plain", plain).withColumn("exact", F.least(F.lit(WINDOW), size)).withColumn("own", F.coalesce(whole, F.when(span.isNotNull(), F.greatest("exact", span))))
    items = staged(items.drop("plain").where("exact > 0"), "benchmark-items")
    kinds = [(False, row.own) for row in items.select("own").distinct().collect() if row.own] + [(True, row.exact) for row in items.select("exact").distinct().collect()]
    if not kinds:
        return benchmark.sparkSession.createDataFrame([], WINDOWS)
    found = _windows(items, kinds, "row", "item_id", "template", "values", "own", "exact").where(F.when(F.col("literal"), F.col("length") == F.col("exact")).otherwise(F.col("length") == F.col("own")))
    words, values = F.slice("template", F.col("at") + 1, F.col("length")), F.slice("values", F.col("at") + 1, F.col("length"))
    found = found.select("row", "item_id", F.col("at").alias("item_at"), "hash", "literal", "length", words.alias("words"), values.alias("item_values"))
    found = found.withColumn("slots", F.size(F.filter("words", _is_slot)))
    enough = F.size("words") - F.col("slots") >= F.least(F.lit(LITERAL), F.size("words"))
    usable = found.where(enough != F.col("literal"))
    by_template = F.sum(F.when(~F.col("literal"), 1))
    counted = usable.groupBy("row").agg(F.least(F.lit(LEAST), by_template).cast("int").alias("needed"), F.least(F.lit(LEAST), F.countDistinct("item_at")).cast("int").alias("needed_any"))
    return usable.join(counted, "row").select(*[part.split()[0] for part in WINDOWS.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows``: the items each document leaks, with how
    many different windows of the item it holds."""
    windows = staged(benchmark_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    sizes = windows.groupBy("literal", "length").count().collect()
    # Without any window of the benchmark, its plain form finds nothing.
    kinds = [(row.literal, row.length) for row in sizes] or [(False, WINDOW)]
    keys = windows.select("hash", "literal", "length", "row", "item_id", "item_at", "slots", "needed", "needed_any")
    keys = F.broadcast(keys) if sum(row["count"] for row in sizes) <= BROADCAST_ROWS else keys
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    texts = valued_templates(named, "text") if any(literal for literal, _ in kinds) else templates(named, "text")
    found = _windows(texts, kinds, "doc_id")
    matches = staged(found.join(keys, ["hash", "literal", "length"]).drop("hash", "size"), "window-matches")
    plain = matches.where("literal OR slots = 0")
    valued = _consistent(matches.where("NOT literal AND slots > 0"), named, windows.where("NOT literal"))
    hits = plain.select(*HITS).unionByName(valued)
    counts = hits.groupBy("doc_id", "row", "item_id", "needed", "needed_any").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(~F.col("literal"), F.col("item_at"))).alias("by_template"))
    return counts.where("by_template >= needed OR n_windows >= needed_any").select("doc_id", "item_id", "n_windows")


HITS = ["doc_id", "row", "item_id", "item_at", "literal", "needed", "needed_any"]


def _consistent(matches: DataFrame, named: DataFrame, windows: DataFrame) -> DataFrame:
    """The matches with placeholders whose values agree along their alignment."""
    texts = valued_templates(named.join(matches.select("doc_id").distinct(), "doc_id", "left_semi"), "text")
    own = F.slice("template", F.col("at") + 1, F.col("length")), F.slice("values", F.col("at") + 1, F.col("length"))
    both = matches.join(texts, "doc_id").select(*HITS, (F.col("at") - F.col("item_at")).alias("shift"), own[0].alias("own"), own[1].alias("own_values"))
    both = both.join(windows.select("row", "item_at", "words", "item_values"), ["row", "item_at"]).where("own = words")
    slots = both.select("doc_id", "row", "shift", F.explode(F.arrays_zip("words", "item_values", "own_values")).alias("slot")).where(_is_slot(F.col("slot.words")))
    distinct = slots.groupBy("doc_id", "row", "shift").agg(
        F.countDistinct("slot.words", "slot.item_values").alias("theirs"), F.countDistinct("slot.words", "slot.own_values").alias("ours"), F.countDistinct("slot.words", "slot.item_values", "slot.own_values").alias("pairs")
    )
    good = distinct.where("theirs = pairs AND ours = pairs").select("doc_id", "row", "shift")
    return both.join(good, ["doc_id", "row", "shift"], "left_semi").select(*HITS)


#: A column that ``without_leaks`` adds for its own use.
ROW = "_leaking_row"


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that leak no item.

    Rows are told apart by id and text (64 bits), so another text of the same
    id stays, and a leak without an id goes."""
    keyed = docs.withColumn(ROW, F.xxhash64(id_col, text_col))
    leaks = contaminated(keyed, benchmark, id_col=ROW, text_col=text_col).select(F.col("doc_id").alias("leak")).distinct()
    return keyed.join(leaks, F.col(ROW) == F.col("leak"), "left_anti").drop(ROW)
