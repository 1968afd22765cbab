"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Items fall into size classes (powers of two of their distinct shingle count). An item's sketch is its bottom-m MinHash
values, m chosen per class so that a document that holds `threshold` of the item's shingles must hold one of the m: with
at most n - ceil(threshold * n) shingles missing, m is one more than that, so the search loses nothing. Short items
inside long documents are found as well as any, because the sketch belongs to the item and a document probes with all
its shingles below the largest value of the classes it is long enough for. Candidates are then verified by exact
containment on the shingle texts.

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text, shingles are five words; a text of fewer words is one shingle.

Defined results: null, empty or blank texts and items have no shingles and match nothing; an item is matched by a
document holding at least threshold of its distinct shingles (ties included); rows that repeat give a row each, a null
id is an id of its own on either side; an empty table on either side gives no pairs; columns of docs other than doc_id and text are not read by `leaks` and pass through
`decontaminate` (internal columns start with `__dc_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_SPLIT, cut, let, small_side

WIDTH = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    bare = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    # Between words, and nowhere else, blanks are left: no split is empty but that of an empty text.
    return let(bare, lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, WORD_SPLIT)))


def shingle_count(words: Column, width: int) -> Column:
    """Shingles with repeats: an upper bound of the set's size."""
    n = F.size(words)
    return F.when(n == 0, 0).otherwise(F.greatest(n - width + 1, F.lit(1)))


def shingle_texts(words: Column, width: int) -> Column:
    """All shingles as texts, with repeats."""


    def body(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < width, F.array(F.concat_ws(" ", w))).otherwise(many)

    return let(words, body)


def shingle_hashes(word_hashes: Column, width: int) -> Column:
    """64-bit hashes of all shingles, with repeats, from the words' hashes."""


    def body(w: Column) -> Column:
        n = F.size(w)
        whole = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        many = F.slice(whole, F.lit(1), n - width + 1)
        short = F.array(F.aggregate(w, n.cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, short).otherwise(many)

    return let(word_hashes, body)


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def item_index(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per item: item_id, __dc_key, shingles (distinct texts), n, need, size_class, sketch (its bottom-m hashes)."""
    key = F.struct(F.col("item_id").alias("id")).alias("__dc_key")  # a key even where the id is null
    rows = items.select("item_id", key, F.array_distinct(shingle_texts(words_of(F.col("text")), width)).alias("shingles"), F.array_distinct(shingle_hashes(hashed_words(F.col("text")), width)).alias("hashes"))
    rows = rows.withColumn("n", F.size("shingles")).where("n > 0")
    # Ties of the threshold count; the small slack keeps 0.8 * 5 from rounding up to 5.
    rows = rows.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    rows = rows.withColumn("size_class", F.floor(F.log2(F.col("n").cast("double")) + F.lit(1e-12)).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    m = F.floor(largest * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1
    return rows.withColumn("sketch", F.slice(F.array_sort("hashes"), F.lit(1), F.greatest(m, F.lit(1)))).drop("hashes")


#: Slots of the table that says which hashes any sketch may hold: this many for each value, within these limits.
SLOTS_EACH, SLOTS = 16, (1 << 12, 1 << 18)


def _slot(value: Column, size: int) -> Column:
    return value.bitwiseAND(F.lit(size - 1)).cast("int")


def _marks(sketches: DataFrame, n: int) -> bytearray:
    """A byte for each slot: 1 where some of the n sketch values falls. At most SLOTS[1] numbers come to the driver."""
    size = min(SLOTS[1], max(SLOTS[0], 1 << (SLOTS_EACH * n).bit_length()))
    found = bytearray(size)
    for row in sketches.select(_slot(F.col("hash"), size).alias("at")).distinct().collect():
        found[row.at] = 1
    return found


def _probes(docs: DataFrame, classes: list, marks: bytearray, width: int) -> DataFrame:
    """(__dc_id, __dc_text, __dc_n, hash): the shingles of each document that can be in the sketch of a class it is long enough for.

    Most hashes fall in slots without a mark and never become rows.
    """
    none = F.array().cast("array<struct<n:int,hash:bigint>>")
    marked = lambda x: F.substring(F.lit(marks), _slot(x, len(marks)) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    def bound(n: Column) -> Column:
        """The largest sketch value of the classes that n shingles are enough for; null if they are too few for any."""
        return F.greatest(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), *[F.when(n >= c["need"], F.lit(c["bound"]).cast("bigint")) for c in classes])

    def found(w: Column, n: Column, most: Column) -> Column:
        kept = F.filter(shingle_hashes(w, width), lambda x: marked(x) & (x <= most))
        return F.when(most.isNull(), none).otherwise(F.transform(kept, lambda x: F.struct(n.alias("n"), x.alias("hash"))))

    # One expression, each part of which is evaluated once: as columns the optimizer would copy them into the filter.
    probes = let(hashed_words(F.col("text")), lambda w: let(shingle_count(w, width), lambda n: let(bound(n), lambda most: found(w, n, most))))
    rows = docs.select(F.col("doc_id").alias("__dc_id"), F.xxhash64("text").alias("__dc_text"), F.explode(probes).alias("p"))
    return rows.select("__dc_id", "__dc_text", F.col("p.n").alias("__dc_n"), F.col("p.hash").alias("hash"))


def candidates(docs: DataFrame, index: DataFrame, width: int = WIDTH) -> DataFrame:
    """(__dc_id, __dc_text, items): documents that hold a sketch value of an item and are long enough for it."""
    classes = index.groupBy("size_class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("bound")).collect()  # a row per power of two
    sketches = cut(index.select("__dc_key", "need", F.explode("sketch").alias("hash")))
    side, _ = small_side(sketches, 32)
    found = _probes(docs, classes, _marks(sketches, sketches.count()), width).join(side, "hash").where("__dc_n >= need")
    return found.groupBy("__dc_id", "__dc_text").agg(F.collect_set("__dc_key").alias("items"))


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, matched, containment), with __dc_text to tell rows of one doc_id apart."""
    index = cut(item_index(items, width, threshold))
    found = cut(candidates(docs.select("doc_id", "text"), index, width))
    side, _ = small_side(found)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__dc_text"))
    on = rows["doc_id"].eqNullSafe(side["__dc_id"]) & (rows["__dc_text"] == side["__dc_text"])
    rows = rows.join(side, on).select("doc_id", rows["__dc_text"], F.array_distinct(shingle_texts(words_of(F.col("text")), width)).alias("doc_shingles"), "items")
    pairs = rows.select("doc_id", "__dc_text", "doc_shingles", F.explode("items").alias("__dc_key"))
    bounded, _ = small_side(index.select("__dc_key", "item_id", "shingles", "n", "need"))
    pairs = pairs.join(bounded, "__dc_key")
    pairs = pairs.withColumn("matched", F.size(F.array_intersect("doc_shingles", "shingles"))).where("matched >= need")
    return pairs.select("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), F.col("matched").cast("long").alias("matched"), (F.col("matched") / F.col("n")).alias("containment"), "__dc_text")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item."""
    bad = cut(leaks(docs, items, width, threshold).select(F.col("doc_id").alias("__dc_id"), "__dc_text").distinct())
    side, _ = small_side(bad, 32)
    return docs.join(side, docs["doc_id"].eqNullSafe(side["__dc_id"]) & (F.xxhash64(docs["text"]) == side["__dc_text"]), "left_anti")
