"""Substring deduplication with a compressed FM-index a shard.

A shard holds the regions of some names.  Its index is the Burrows-Wheeler
transform of their words in a wavelet tree of packed bits with rank samples; the
suffix array is dropped after construction.  All regions of those names, whatever
document they are of, are streamed through it: backward search from each word gives
the matching statistic (how far to the left the words have another occurrence), and
an end whose statistic reaches the window's width reports an interval.  Equal
windows have equal names, so no region need be asked of another shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import Workspace
from tipoff.llm.regions import Rolling, word_symbols
from tipoff.llm.repeats import Unit, contents, partition_rows, remove_repeats

#: Bytes of words in one shard.
SHARD_BYTES = 8_000_000
#: Contents of one name beyond which its windows are counted one by one instead:
#: equal windows meet in a partial sum, so no shard grows with a hot name.
HOT_KINDS = 20_000


class WaveletTree:
    """Rank queries on a symbol sequence: one packed bit vector a level."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.samples: list[np.ndarray] = []
        self.zeros: list[int] = []
        at = values
        for level in range(self.levels - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.samples.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        # where each symbol's run starts after the last level
        self.start = np.zeros(sigma, np.int64)
        for k in range(self.levels):
            self.start = self._down(k, np.arange(sigma), self.start)

    def _down(self, k: int, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.samples[k][word] + np.bitwise_count(self.bits[k][word] & below)
        one = (symbol >> (self.levels - 1 - k)) & 1
        return np.where(one, self.zeros[k] + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i."""
        at = i
        for k in range(self.levels):
            at = self._down(k, symbol, at)
        return at - self.start[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; symbols that end a text must be distinct already."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    h = 1
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        h *= 2
    return order


class FmIndex:
    """Index of some texts (arrays of symbols) with a weight each."""

    def __init__(self, texts: list[np.ndarray], weights: list[int]) -> None:
        flat = np.concatenate(texts)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        k, n = len(texts), len(flat) + len(texts)
        lengths = np.array([len(t) for t in texts])
        stops = np.cumsum(lengths + 1) - 1
        body = np.ones(n, bool)
        body[stops] = False
        text = np.empty(n, np.int64)
        text[body] = codes + k
        text[stops] = np.arange(k)  # every text ends with a symbol of its own
        self.codes, self.owner_start = codes, np.concatenate([[0], np.cumsum(lengths)])
        order = suffix_array(text)
        bwt = np.maximum(text[order - 1] - k + 1, 0)  # separators are one symbol here
        counts = np.bincount(np.maximum(text - k + 1, 0), minlength=len(self.alphabet) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.tree = WaveletTree(bwt, len(self.alphabet) + 1)
        self.n = n
        weight = np.repeat(np.array(weights, np.int64), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffixes that begin with a symbol and go on in [low, high)."""
        both = np.tile(self.first[symbol], 2) + self.tree.rank(np.tile(symbol, 2), np.concatenate([low, high]))
        return both[: len(low)], both[len(low) :]

    def repeats(self, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, stop): where windows of ``limit`` words of the texts start that occur
        once more; the texts are streamed through the index, all side by side.

        From an end, backward search goes on as long as the words from there occur twice:
        that is the end's matching statistic.  The windows within it repeat.  The next end
        asked is that of the first window before them, or the one before where there is none.
        """
        start, stop = self.owner_start[:-1], self.owner_start[1:]
        text = np.flatnonzero(stop - start >= limit)
        end = stop[text] - 1
        at, low, high = end.copy(), np.zeros(len(text), np.int64), np.full(len(text), self.n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(text):
            new_low, new_high = self.step(self.codes[at] + 1, low, high)
            more = self.weight[new_high] - self.weight[new_low] > 1
            low, high, at = np.where(more, new_low, low), np.where(more, new_high, high), at - more
            over = np.flatnonzero(~more | (at < start[text]))
            if not len(over):
                continue
            length = end[over] - at[over]
            good = over[length >= limit]
            found.append((text[good], at[good] + 1 - start[text[good]], end[good] + 2 - limit - start[text[good]]))
            end[over] = np.where(length >= limit, at[over] + limit - 1, end[over] - 1)
            at[over], low[over], high[over] = end[over], 0, self.n
            keep = end - limit + 1 >= start[text]
            if not keep.all():
                text, end, at, low, high = text[keep], end[keep], at[keep], low[keep], high[keep]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        got = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((got[1], got[0]))
        return got[0][order], got[1][order], got[2][order]


VERDICT = "name long, content long, n long, key binary, begin int, first int, stop int"


def shard_spans(rows: list[tuple], width: int) -> list[tuple]:
    """Repeated window ranges (VERDICT) of one shard's rows (name, content, n, key, start, windows, words).

    The index holds every content once, with its weight; every content is streamed
    through it.
    """
    sizes = np.array([r[5] + width - 1 for r in rows])
    with np.errstate(over="ignore"):
        texts = np.split(word_symbols(b" ".join([r[6] for r in rows])), np.cumsum(sizes)[:-1])
    index = FmIndex(texts, [r[2] for r in rows])
    return [(*rows[i][:5], a, b) for i, a, b in zip(*(x.tolist() for x in index.repeats(width)), strict=True)]


def judge_words(width: int):
    """Windows that repeat: FM-index shards, and single windows for hot names."""
    names = [c.split()[0] for c in VERDICT.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in partition_rows(batches, SHARD_BYTES):
            spans = shard_spans(rows, width)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans, strict=True), types, strict=True)], names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                count = row[5]
                at = np.arange(count)
                with np.errstate(over="ignore"):
                    words = word_symbols(row[6])
                    a, b = Rolling(words, 0).spans(at, at + width), Rolling(words, 1).spans(at, at + width)
                same = [pa.array([x] * count, t) for x, t in zip(row[:5], types[:5], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *same, pa.array(at.astype(np.int32))], names=["a", "b", *names[:6]])

    def judge(found: DataFrame, texts: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        columns = ["name", "content", "n", "key", "start", "windows", "symbols"]
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = work.put(contents(found, texts, Unit(True, width, 0)).select(*columns), "contents")
        work.rest()
        hot = work.put(rows.groupBy("name").count().filter(F.col("count") > HOT_KINDS).select("name"), "hot")
        cold = rows.join(hot, "name", "left_anti").select(*columns)
        by_index = cold.repartition(parts, "name").sortWithinPartitions("name", "content").mapInArrow(shards, VERDICT)
        single = rows.join(hot, "name", "left_semi").select(*columns).mapInArrow(windows, "a long, b long, " + VERDICT.rpartition(", ")[0])
        twice = single.groupBy("a", "b").agg(F.sum("n").alias("total")).filter("total > 1").select("a", "b")
        by_count = single.join(twice, ["a", "b"]).withColumn("stop", F.col("first") + 1).select(*names)
        verdict = work.put(by_index.unionByName(by_count), "verdict")
        work.drop("contents")
        often = verdict.filter("n > 1").select("name", "content", "first", "stop")
        return often, verdict.filter("n = 1").select("key", (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("stop")).alias("stop"))

    return judge


def dedup_words(docs: DataFrame, width: int = 35, gram: int = 8, text_col: str = "text", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Remove every word in a window of ``width`` words that also starts elsewhere.

    Returns docs without the text, with n_units (words), n_removed, n_spans and kept
    (the kept words joined by a space, UTF-8 bytes).  Null and short texts lose
    nothing; repeated rows of at least a window lose all; null ids and further
    columns are carried; an empty table gives no rows.  Words are compared by
    64-bit hashes of their bytes.
    """
    return remove_repeats(docs, Unit(True, width, gram), judge_words(width), "fm", text_col, finish=finish)
