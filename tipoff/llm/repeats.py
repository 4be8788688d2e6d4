"""What repeats: the steps that the two exact substring operators share.

1. Equal texts become one row with a multiplicity; a text that occurs twice repeats
   as a whole.  The rows are bucketed by the text's key, so that the two later
   joins on it move no text.
2. Every text is cut into regions (``regions``); a region is a name and a content, and
   has each window once.
3. Equal (name, content) become one row with a weight: partial sums first, so
   thousands of copies leave each task as one row.  A name with one occurrence cannot
   repeat and is done with.
4. All others are the operators' own work: they say which windows of a content repeat.
   ``contents`` gives them its symbols; ``rivals`` tells that some of its windows may
   equal windows of other contents of the name.
5. Window ranges that repeat come together by text and are cut out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import Workspace, bounded_batches, map_batches, text_key, text_or_empty, unused
from tipoff.llm.regions import byte_symbols, regions, word_symbols


@dataclass(frozen=True)
class Unit:
    """Words or bytes, the window's width and the gram that names it."""

    words: bool
    width: int
    gram: int

    def symbols(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass")
        return word_symbols(raw) if self.words else byte_symbols(raw)


def distinct_texts(docs: DataFrame, work: Workspace, text_col: str) -> DataFrame:
    """(key, text, m): each text once, with its number of rows; bucketed by key."""
    texts = docs.select(text_or_empty(text_col).alias("text")).select(text_key("text").alias("key"), "text")
    return work.bucketed(texts.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m")), "key")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


REGION = "name long, content long, key binary, start int, windows int, m long"


def region_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    """A row a region of every distinct text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ms, found = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        with np.errstate(over="ignore"):
            found = [regions(unit.symbols(t), unit.width, unit.gram) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(r.name) for r in found])
        owner = pa.array(np.repeat(np.arange(len(found)), sizes))
        cat = lambda f: np.concatenate([f(r) for r in found])
        return pa.RecordBatch.from_arrays(
            [signed(cat(lambda r: r.name)), signed(cat(lambda r: r.content)), pa.array(keys, pa.binary()).take(owner), pa.array(cat(lambda r: r.start).astype(np.int32)), pa.array(cat(lambda r: r.windows).astype(np.int32)), pa.array(ms, pa.int64()).take(owner)],
            names=["name", "content", "key", "start", "windows", "m"],
        )

    return map_batches(texts.select("key", "text", "m"), run, REGION)


def repeated(rows: DataFrame, work: Workspace) -> DataFrame:
    """(item, name, content, n, rivals, key, start, windows): the contents of every name that
    occurs twice or more, with one place of each; ``item`` is a number of their own.
    ``rivals``: some content of the name occurs once, and other contents may have some of
    its windows."""
    groups = work.put(rows.groupBy("name", "content").agg(F.sum("m").alias("n"), F.min(F.struct("key", "start", "windows")).alias("at")), "groups")
    work.rest()
    names = groups.groupBy("name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("total > 1").select("name", "kinds", "least")
    return groups.join(names, "name").select(F.monotonically_increasing_id().alias("item"), "name", "content", "n", F.expr("least = 1 and kinds > 1").alias("rivals"), "at.key", "at.start", "at.windows")


def unlisted(column: pa.ListArray, *fields: str) -> tuple[list[int], dict[str, np.ndarray]]:
    """A column of lists of structs as (ends, arrays): row i has the places ends[i] to
    ends[i + 1] of each array; a null list has none."""
    flat = column.flatten()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return [0, *np.cumsum(sizes).tolist()], {f: flat.field(f).to_numpy(zero_copy_only=False) for f in fields}


def contents(wanted: DataFrame, texts: DataFrame, unit: Unit) -> DataFrame:
    """(name, content, n, key, start, windows, symbols) of the wanted regions.

    Symbols are the bytes, or the words joined by a space.
    """
    width, words = unit.width, unit.words
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("name", "content", "n", "start", "windows")).alias("found"))  # of one text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, found = unlisted(batch.column(2), "name", "content", "n", "start", "windows")
        starts, stops = found["start"].tolist(), (found["start"] + found["windows"] + width - 1).tolist()
        parts: list[bytes] = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            symbols = raw.split() if words else raw
            got = [symbols[starts[j] : stops[j]] for j in range(ends[i], ends[i + 1])]
            parts += map(b" ".join, got) if words else got
        keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))))
        return pa.RecordBatch.from_arrays([*[pa.array(found[c]) for c in ("name", "content", "n")], keys, pa.array(found["start"]), pa.array(found["windows"]), pa.array(parts, pa.binary())], names=["name", "content", "n", "key", "start", "windows", "symbols"])

    return map_batches(texts.join(lists, "key").select("key", "text", "found"), run, "name long, content long, n long, key binary, start int, windows int, symbols binary")



def cut(texts: DataFrame, spans: DataFrame, unit: Unit, keep: Callable[[bytes, np.ndarray], bytes]) -> DataFrame:
    """(key, n_units, n_removed, n_spans, kept): texts without the repeated windows.

    ``spans`` are ranges of window starts.  ``keep`` makes the kept text of the
    raw text and a mask over its units.
    """
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))  # of one text
    width, words = unit.width, unit.words

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        ends, found = unlisted(batch.column(3), "first", "stop")
        for i, (key, text, m) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True)):
            raw = text.encode("utf-8", "surrogatepass")
            n = len(raw.split()) if words else len(raw)
            gone = np.zeros(n + 1, np.int32)
            if m > 1 and n >= width:
                gone[0] += 1
            mine = slice(ends[i], ends[i + 1])
            np.add.at(gone, found["first"][mine], 1)
            np.add.at(gone, found["stop"][mine] - 1 + width, -1)
            mask = np.cumsum(gone[:n]) > 0
            runs = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(n > 0 and mask[0])
            rows.append((key, n, int(mask.sum()), runs, keep(raw, mask)))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "n_units", "n_removed", "n_spans", "kept"])

    return map_batches(texts.join(lists, "key", "left").select("key", "text", "m", "spans"), run, "key binary, n_units long, n_removed long, n_spans long, kept binary")


def keep_words(raw: bytes, mask: np.ndarray) -> bytes:
    """Kept words, joined by one space."""
    if not mask.any():
        return b" ".join(raw.split())
    return b" ".join([w for w, gone in zip(raw.split(), mask.tolist(), strict=True) if not gone])


def keep_bytes(raw: bytes, mask: np.ndarray) -> bytes:
    """Kept bytes."""
    return np.frombuffer(raw, np.uint8)[~mask].tobytes() if mask.any() else raw


def keep_characters(raw: bytes, mask: np.ndarray) -> bytes:
    """Kept bytes without the halves of characters that a cut has split."""
    return keep_bytes(raw, mask).decode("utf-8", "ignore").encode()


#: Takes the found contents and the texts; returns the windows of contents that
#: repeat wherever they occur (name, content, first, stop), within the region, and
#: further ranges of single texts (key, first, stop).
Judge = Callable[[DataFrame, DataFrame, Workspace], tuple[DataFrame, DataFrame]]


def remove_repeats(docs: DataFrame, unit: Unit, judge: Judge, name: str, text_col: str = "text", keep: Callable[[bytes, np.ndarray], bytes] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of docs with (n_units, n_removed, n_spans, kept) for the text.

    Columns of docs with one of the new names are replaced, others are carried; the
    text itself is not, it is not moved again.  ``finish`` may change the columns of
    (key, n_units, n_removed, n_spans, kept) before they join the rows: a digest moves
    less than a text.  The ranges of one text are one row, as the text is: a task's
    memory follows its longest text.
    """
    work = Workspace(docs.sparkSession, name)
    bounded_batches(docs.sparkSession)
    texts = distinct_texts(docs, work, text_col)
    work.rest()
    rows = work.put(region_rows(texts, unit), "regions")
    found = work.put(repeated(rows, work), "repeated")
    work.drop("groups")
    work.rest()
    settled, single = judge(found, texts, work)
    whole = rows.filter("m = 1").join(settled, ["name", "content"]).select("key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("stop")).alias("stop"))
    spans = work.put(whole.unionByName(single.select("key", "first", "stop")), "spans")
    work.drop("regions")
    work.rest()
    keep = keep or (keep_words if unit.words else keep_bytes)
    result = cut(texts, spans, unit, keep)
    result = finish(result) if finish else result
    own = unused(docs, "text_key")
    others = docs.withColumn(own, text_key_of(text_col)).drop(text_col, *[c for c in result.columns if c != "key"])
    return others.join(result.withColumnRenamed("key", own), own).drop(own)


def text_key_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.encode(text_or_empty(text_col), "utf-8")))


def partition_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows of a partition sorted by their first column, in blocks of whole groups of
    about ``limit`` symbol bytes (the last column)."""
    block: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if size >= limit and row[0] != last:
                yield block
                block, size = [], 0
            last = row[0]
            block.append(row)
            size += len(row[-1])
    if block:
        yield block
