"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one
window).  As a set of word shingles it lies in a document where all its shingles do,
at their places; so any one of them is enough to find it, and the rarest is taken.

1. One pass over the documents.  Words are split, exploded with their places, and every
   shingle is looked up among the benchmark's, by hash and then by its words.  What matches
   is written, with a row for each document's end; the words themselves go no further.
2. Shingles are ordered by rarity: their exact number of places in all documents.  A window
   with a shingle that is nowhere is nowhere and leaves; of the others the rarest shingle
   is the prefix (exact containment needs one).
3. Prefixes join the matches; where the window would begin before the document or end after
   it, it leaves (length and positional bounds).
4. Candidates are verified: shingles side by side cover the window, and each must have
   matched at its place.
5. Words in occurrences are counted once by the running end of the occurrences before.

The benchmark is broadcast in slices of at most ``SLICE`` shingles, counted before: a larger
one takes more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipoff.llm.common import Workspace, text_or_empty, unused

#: Most shingles of the benchmark that are broadcast at once (some 100 bytes each).
SLICE = 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, of which only A to Z are lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def windows_of(bench: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(words, item): every distinct window with each item that has it."""
    split = bench.select(F.col(item_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return split.select("item", "w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at"), window).alias("words"), "item").distinct()


def shingled(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, offset, size, words): the shingles of every distinct window."""
    size = F.least(F.lit(shingle), F.size("words"))
    offsets = F.sequence(F.lit(0), F.size("words") - size)
    placed = windows.select("window", F.size("words").alias("length"), size.alias("size"), "words", F.explode(offsets).alias("offset"))
    return placed.withColumn("words", F.slice("words", F.col("offset") + 1, F.col("size")))


def matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], text_col: str, ends: bool) -> DataFrame:
    """(row, place, n_words, found_<size> .., document): places of documents where shingles of
    the benchmark are; with ``ends`` one more row, with the document's other columns, for each.

    ``shingles`` (shingle, size, hash, words) is broadcast: at most ``SLICE`` rows.  A place
    takes along the words of its shingle and no others, so its cost doesn't depend on the
    document's length, even where Spark doesn't compile the stage.
    """
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != text_col]
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(True).alias(unused(docs, "whole")), *others).alias("document"), words(text_or_empty(text_col)).alias("w"))
    split = split.withColumn("n_words", F.size("w"))
    aside = [F.concat("w", F.array(F.lit(""))), *[F.slice("w", k + 1, F.size("w")) for k in range(1, max(sizes, default=1))]]
    placed = split.select("row", "document", "n_words", F.posexplode(F.arrays_zip(*aside)).alias("place", "at"))
    for size in sizes:
        own = shingles.filter(F.col("size") == size).select(F.col("shingle").alias(f"shingle_{size}"), F.col("hash").alias(f"hash_{size}"), F.col("words").alias(f"words_{size}"))
        at = [F.col("at").getField(str(k)) for k in range(size)]
        placed = placed.join(F.broadcast(own), F.xxhash64(*at) == F.col(f"hash_{size}"), "left")
        same = F.lit(True)
        for k, word in enumerate(at):  # hashes may meet, words don't
            same &= word == F.get(F.col(f"words_{size}"), F.lit(k))
        placed = placed.withColumn(f"found_{size}", F.when(same, F.col(f"shingle_{size}"))).drop(f"shingle_{size}", f"hash_{size}", f"words_{size}")
    end = F.col("place") == F.col("n_words")
    kept = F.coalesce(*[F.col(f"found_{s}") for s in sizes], F.lit(None).cast("long")).isNotNull()
    return placed.filter(kept | end if ends else kept).select("row", "place", "n_words", *[f"found_{s}" for s in sizes], F.when(end, F.col("document")).alias("document"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_hit (words in an occurrence of a window), items
    (ids of the items with occurring windows, as sorted strings), n_items and contaminated.

    Null and empty texts, of documents and items, have no words, and neither hit nor are hit.
    Texts are taken whole however long.  Repeated rows of documents each get their result;
    items with one id are one item, an item without an id hits words and is not listed.
    Null ids and further columns of documents are carried, but for those with one of the new
    names, which are replaced.  Without documents there are no rows, without items no hits.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    new = ("n_words", "n_hit", "items", "n_items", "contaminated")
    docs = docs.drop(*[c for c in new if c != text_col])
    listed = work.put(windows_of(bench, window, item_col, item_text_col), "listed")
    numbered = work.put(listed.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows")
    placed = shingled(numbered, shingle)
    shingles = placed.select("size", "words").distinct().select(F.monotonically_increasing_id().alias("shingle"), "size", "words")
    # as documents hash them: nulls are passed over, so a shorter shingle hashes alike
    shingles = work.put(shingles.withColumn("hash", F.xxhash64(*[F.get(F.col("words"), F.lit(k)) for k in range(shingle)])), "shingles")
    counted = {r["size"]: r["n"] for r in shingles.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a size
    sizes, slices = sorted(counted), max(1, -(-sum(counted.values()) // SLICE))
    found = None
    for i in range(slices):
        own = shingles if slices == 1 else shingles.filter(F.pmod("hash", F.lit(slices)) == i)
        got = matches(docs, own, sizes, text_col, ends=i == 0)
        found = got if found is None else found.unionByName(got)
    found = work.put(found, "found")

    small = F.broadcast if slices == 1 else lambda df: df
    each = F.array(*[F.col(f"found_{s}") for s in sizes]) if sizes else F.array().cast("array<long>")
    places = found.select("row", "place", "n_words", F.explode(each).alias("shingle")).filter("shingle is not null")
    counts = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("places"))
    placed = work.put(placed.join(shingles.select("shingle", "size", "words"), ["size", "words"]).drop("words").join(counts, "shingle", "left"), "placed")
    rarest = F.min_by(F.struct("shingle", "offset"), F.struct("places", "offset"))
    prefix = placed.groupBy("window", "length", "size").agg(rarest.alias("rarest"), F.min(F.coalesce("places", F.lit(0))).alias("least")).filter("least > 0")
    prefix = prefix.select("window", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("prefix"))

    start = F.col("place") - F.col("prefix")
    candidates = places.join(small(prefix), "shingle").select("row", "n_words", "window", "length", start.alias("start")).filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    # shingles side by side, and the last one, cover a window
    cover = placed.filter((F.col("offset") % F.col("size") == 0) | (F.col("offset") + F.col("size") == F.col("length"))).select("window", "offset", "shingle")
    needed = cover.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
    asked = candidates.join(small(cover), "window").select("row", "window", "length", "start", (F.col("start") + F.col("offset")).alias("place"), "shingle")
    held = asked.join(places.select("row", "place", "shingle"), ["row", "place", "shingle"])
    held = held.groupBy("row", "start", "window", "length").agg(F.count(F.lit(1)).alias("held"))
    occurs = work.put(held.join(small(needed), "window").filter("held = needed").select("row", "start", "length", "window"), "occurrences")

    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    longest = occurs.groupBy("row", "start").agg(F.max("length").alias("length"))
    fresh = stop - F.greatest("start", F.least(stop, F.coalesce(F.max(stop).over(before), F.col("start"))))
    hits = longest.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    owners = listed.join(numbered, "words").select("window", "item")
    items = occurs.select("row", "window").distinct().join(small(owners), "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    row = unused(docs, "row")
    ends = found.filter("document is not null").select(F.col("row").alias(row), *[F.col("document").getField(c).alias(c) for c in docs.columns if c != text_col], F.col("n_words").cast("long").alias("n_words"))
    return (
        ends.join(hits.withColumnRenamed("row", row), row, "left")
        .join(items.withColumnRenamed("row", row), row, "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
        .withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
        .drop(row)
    )
