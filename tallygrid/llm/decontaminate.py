"""Benchmark decontamination with DataFrame functions only: SimHash windows and Hamming blocks.

A text is normalised to its words: runs of letters, marks and digits, in lower case. A
shingle is five words in a row; its weight in a window or item is how often it occurs there.
A window of a document has as many words as a benchmark item (fewer at the text's end) and
begins at a shingle of such an item. No start is lost by that: moving a window to its first
shingle of the item keeps all shared ones. A document holds an item if the weighted Jaccard
similarity, sum of the lesser weights over sum of the greater, is 0.8 or more.

1. One narrow pass looks shingles up in a bitmap of the benchmark's shingles inside the
   expression, so only windows around possible hits become rows. A window similar enough
   lacks at most one in nine of its shingles, so every few places are enough to find out
   whether a text has any; only then all places are looked up. The bitmap has a bounded size,
   and what passes it by chance is removed by the exact join that follows. Windows with too few
   benchmark shingles to reach the threshold go before they are fingerprinted.
2. Every window and item gets a 128-bit SimHash. Its 16 blocks of eight bits are indexed with
   all values at most one bit away, for items only. Two fingerprints at most RADIUS = 31 bits
   apart differ by at most one bit in some block, so no pair within the radius is missed;
   a pair meets in its first such block only.
3. Pairs within the radius are verified on their weighted shingles. At a similarity of 0.8 the
   expected distance is 19 bits with a deviation of 4, so the radius passes 99.8 percent there
   and practically all above 0.85.

Defined results: null or empty texts and items, and items of fewer than five words, hold no
shingle and match nothing. Very long texts and items are compared whole; what a passage costs grows with the square
of the length of the item it may hold, since it begins a window at each of its words. Null ids are kept as ids. Items with equal texts are each
reported. Repeated rows of one id give one result. Empty tables give an empty table. Only
the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.session import store

WORDS = 5
THRESHOLD = 0.8
BLOCKS = 16
RADIUS = 2 * BLOCKS - 1
#: The bitmap has 64 bits per word and at most this many words (4 MB).
MAX_BITMAP_WORDS = 1 << 19
#: Tables made from the benchmark are broadcast up to this many rows, and shuffled beyond.
MAX_BROADCAST_ROWS = 500_000
#: Shingles of all items are broadcast up to so many bytes, and shuffled beyond.
MAX_BROADCAST_BYTES = 32_000_000


def _words(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the hashes of its text's words, in order, as ``short``; texts without a shingle go.

    They are a column of their own: inside a lambda they would be made anew each time.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return df.withColumn("short", F.transform(words, lambda w: F.xxhash64(w))).filter(F.size("short") >= WORDS)


def _shingle(i: Column) -> Column:
    """Hash of the shingle that begins at word ``i`` of ``short``."""
    return F.xxhash64(*[F.element_at("short", i + k) for k in range(WORDS)])


def _shingles(df: DataFrame) -> DataFrame:
    return df.withColumn("sh", F.transform(F.sequence(F.lit(1), F.size("short") - (WORDS - 1)), _shingle))


def _stride(least: int, threshold: float) -> int:
    """Places between two look-ups that no window over the threshold can slip through."""
    lacking = (1 - threshold) / (1 + threshold)
    for step in (4, 3, 2):
        sizes = range(max(1, math.ceil(threshold * least - 1e-9)), 1000)
        if all(w // step > math.floor(w * lacking + 1e-9) for w in sizes):
            return step
    return 1


def _probes(h: Column, n_bits: int) -> list[Column]:
    """The two places of a hash in a bitmap of ``n_bits``, a power of two up to 2^25."""
    last = F.lit(n_bits - 1).cast("long")
    return [h.bitwiseAND(last), F.call_function("shiftrightunsigned", h, F.lit(25)).bitwiseAND(last)]


def _bit(shingles: Column, seed: int) -> Column:
    """64 bits of the SimHash: bit b is set if more shingles have it than lack it."""
    half = F.size(shingles)

    def vote(b: Column) -> Column:
        ones = F.aggregate(
            shingles, F.lit(0), lambda n, h: n + F.getbit(F.xxhash64(h, F.lit(seed)), b).cast("int")
        )
        return F.when(ones * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(vote(b)))


def _block(high: Column, low: Column, b: Column) -> Column:
    """Eight bits of a 128-bit fingerprint: blocks 0 to 7 of ``low``, then of ``high``."""
    word = F.when(b < 8, low).otherwise(high)
    return F.call_function("shiftrightunsigned", word, (b % 8) * 8).bitwiseAND(F.lit(255).cast("long")).cast("int")


def _counted(shingles: Column) -> Column:
    """Each shingle with its occurrence number, so that weights become set sizes; ``shingles`` are sorted."""
    return F.transform(shingles, lambda h, i: F.xxhash64(h, i - F.array_position(shingles, h)))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, item, similarity): each document with each item it holds, and its best window's similarity."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    items = store(_shingles(_words(items, F.col("text"))).select("item", "sh").distinct())
    shingles = store(items.select(F.size("sh").alias("m"), F.explode("sh").alias("h")).distinct())
    n_shingles, least, longest = shingles.agg(F.count("*"), F.min("m"), F.max("m")).first()
    least, longest = least or 1, longest or 1

    # The bitmap: a power of two of 64-bit words, two or more a shingle while that is allowed.
    n_words = 1 << max(6, min(MAX_BITMAP_WORDS.bit_length() - 1, n_shingles.bit_length() + 1))
    word = lambda place: F.call_function("shiftrightunsigned", place, F.lit(6))
    inside = lambda place: place.bitwiseAND(F.lit(63).cast("long")).cast("int")
    places = shingles.select(F.explode(F.array(*_probes(F.col("h"), 64 * n_words))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), inside(F.col("p")))
    set_words = places.select(word(F.col("p")).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = docs.sparkSession.range(n_words).withColumnRenamed("id", "w").join(set_words, "w", "left")
    bitmap = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("x"))
    bitmap = store(bitmap.select(F.col("x.b").alias("bits")))

    def likely(h: Column) -> Column:
        first, second = _probes(h, 64 * n_words)
        test = lambda p: F.getbit(F.element_at("bits", word(p).cast("int") + 1), inside(p)) == 1
        return test(first) & test(second)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = _words(texts, F.col("text")).select("id", "short").join(F.broadcast(bitmap))
    some = F.sequence(F.lit(1), F.size("short") - (WORDS - 1), F.lit(_stride(least, threshold)))
    hashed = _shingles(hashed.filter(F.exists(some, lambda i: likely(_shingle(i)))))
    hashed = hashed.withColumn(
        "hits", F.filter(F.sequence(F.lit(1), F.size("sh")), lambda i: likely(F.element_at("sh", i)))
    )
    around = F.transform(
        "hits",
        lambda at, k: F.struct(
            at.alias("at"),
            F.slice("sh", at, longest).alias("sh"),
            F.transform(F.slice("hits", k + 1, longest), lambda other: other - at).alias("near"),
        ),
    )
    hits = hashed.select("id", F.explode(around).alias("x")).select("id", "x.at", "x.sh", "x.near")
    hits = hits.withColumn("h", F.element_at("sh", 1)).join(_sized(shingles, n_shingles), "h")
    windows = hits.select("id", "at", "m", "near", F.slice("sh", F.lit(1), F.col("m")).alias("sh"))
    enough = F.size(F.filter("near", lambda d: d < F.col("m"))) >= threshold / (1 + threshold) * (F.size("sh") + F.col("m")) - 1e-9
    windows = windows.filter(enough)
    # Copies of one window in one text are one window: rows that repeat a long passage stay few.
    windows = windows.groupBy("id", "m", "sh").agg(F.min("at").alias("at"))

    prints = lambda df: df.withColumns({"high": _bit(F.col("sh"), 1), "low": _bit(F.col("sh"), 2)})
    numbers = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    keyed = prints(items.withColumn("m", F.size("sh"))).select("*", F.explode(numbers).alias("block"))
    value = _block(F.col("high"), F.col("low"), F.col("block"))
    near = F.array(value, *[value.bitwiseXOR(F.lit(1 << k)) for k in range(8)])
    index = store(keyed.select("item", "m", "high", "low", "block", F.explode(near).alias("value")))
    n_index = index.count()
    weighted = store(items.select("item", F.array_sort("sh").alias("item_sh")).withColumn("weights", _counted(F.col("item_sh"))).drop("item_sh"))
    item_bytes = 8 * weighted.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()[0]

    probes = prints(windows).select("*", F.explode(numbers).alias("block"))
    probes = probes.withColumn("value", _block(F.col("high"), F.col("low"), F.col("block")))
    index = index.withColumnsRenamed({"high": "item_high", "low": "item_low"})
    met = probes.join(_sized(index, n_index), ["m", "block", "value"])
    high, low = F.col("high").bitwiseXOR(F.col("item_high")), F.col("low").bitwiseXOR(F.col("item_low"))
    met = met.filter(F.bit_count(high) + F.bit_count(low) <= RADIUS)
    first = F.array_position(F.transform(numbers, lambda b: F.bit_count(_block(high, low, b)) <= 1), F.lit(True)) - 1
    met = met.filter(F.col("block") == first)

    met = met.withColumn("sh", F.array_sort("sh")).withColumn("window", _counted(F.col("sh")))
    # Several items may have one id, or none; a text is then compared with each of them of the length it met.
    met = met.join(
        F.broadcast(weighted) if item_bytes <= MAX_BROADCAST_BYTES else weighted,
        met["item"].eqNullSafe(weighted["item"]) & (F.size("weights") == F.col("m")),
    ).drop(weighted["item"])
    shared = F.size(F.array_intersect("window", "weights"))
    similarity = shared / (F.size("window") + F.size("weights") - shared)
    found = met.select("id", "item", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    found = found.groupBy("id", "item").agg(F.max("similarity").alias("similarity"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item. A null id is compared like any other."""
    leaks = benchmark_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(F.col("__leak")), "left_anti")
