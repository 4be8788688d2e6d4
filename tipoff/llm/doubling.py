"""Substring deduplication by distributed prefix doubling.

A position first has the rank of its next ``base`` bytes.  In every round Spark sorts
the pairs (rank of a position, rank of the position an offset on) by range
partitions; the place of a pair among the distinct pairs is the new rank, for twice
the length.  A position whose pair occurs once is unique and leaves; the offsets grow
until the threshold is reached, and the last pair is made of overlapping halves
where the threshold is no power.

Only positions that may repeat take part (see ``repeats``), from long strings to short
ones, so that what repeats as a whole is settled by few positions:

1. Regions.  A string of several windows has two positions, its first and its last
   window; a last pair of their ranks ranks the string.  Regions and runs are shorter
   than two windows, so both ends hold all bytes of the string.  A string whose rank
   occurs twice repeats with all its windows.
2. Runs.  All windows of a region share a gram; blocks are laid from its first place
   in the window to both sides, and the windows that cover the same blocks form a run.
   Equal windows have equal blocks, so a run repeats only among runs with its core.
   Runs are ranked as regions are.
3. Windows.  Every window of the runs that a repeat ends in is a position of its own.

Equal strings (by two 64-bit hashes) are one row with a weight throughout; a rank's
weight is the sum over its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import Workspace, map_batches, unused
from tipoff.llm.regions import U64, Rolling, mix
from tipoff.llm.repeats import Unit, contents, keep_characters, remove_repeats, signed, unlisted

#: Bytes of a block in narrowing.
BLOCK = 25
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


def offsets(width: int, base: int) -> list[tuple[int, int]]:
    """(length before, offset) of each round: lengths double from base to width."""
    out, have = [], base
    while have < width:
        step = min(have, width - have)
        out.append((have, step))
        have += step
    return out


RUN = "run_name long, run_content long, n long, name long, content long, key binary, start int, windows int"


def runs(rivals: DataFrame, unit: Unit) -> DataFrame:
    """Narrowed runs: windows that cover the same blocks around the region's gram.

    Two windows of one run have that gram at different places, so they differ.
    ``start`` is within the region.
    """
    width, gram = unit.width, unit.gram

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cores, spans, starts, sizes, owner = [], [], [], [], []
        names = batch.column(0).to_pylist()
        with np.errstate(over="ignore"):
            for i, (name, symbols) in enumerate(zip(names, batch.column(6).to_pylist(), strict=True)):
                s = _BYTES[np.frombuffer(symbols, np.uint8)]
                hashes = Rolling(s, 0)
                at = np.arange(len(s) - width + 1)
                places = np.flatnonzero(hashes.grams(gram).view(np.int64) == name)
                anchor = places[np.searchsorted(places, at)]
                low = anchor - (anchor - at) // BLOCK * BLOCK
                high = anchor + (at + width - anchor) // BLOCK * BLOCK
                start = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (anchor[1:] != anchor[:-1])]))
                stop = np.append(start[1:], len(at))
                cores.append(mix(hashes.spans(low[start], high[start]) + (anchor[start] - low[start]).astype(U64)))
                spans.append(Rolling(s, 1).spans(start, stop + width - 1))
                starts.append(start)
                sizes.append(stop - start)
                owner.append(np.full(len(start), i))
        cat = np.concatenate
        rows = pa.array(cat(owner))
        take = lambda k: batch.column(k).take(rows)
        return pa.RecordBatch.from_arrays([signed(cat(cores)), signed(cat(spans)), take(2), take(0), take(1), take(3), pa.array(cat(starts).astype(np.int32)), pa.array(cat(sizes).astype(np.int32))], names=[x.split()[0] for x in RUN.split(", ")])

    return map_batches(rivals.select("name", "content", "n", "key", "start", "windows", "symbols"), run, RUN)


PAIR = "left long, right long, run long, place int, n long"


def _pairs_at(hashes: Rolling, at: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the first round for windows at ``at``: heads follow one another."""
    have, step = offsets(width, base)[0]
    place = (at[:, None] + np.array(_heads(width, base))).reshape(-1)
    return hashes.spans(place, place + have), hashes.spans(place + step, place + step + have)


#: The place of a string's only window; the first and the last of several are 0 and 1.
ONLY = 2


def end_pairs(hashes: Rolling, start: np.ndarray, windows: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, string, place) of the first round for the first and last window of
    strings; the length is part of the first rank, so that strings of one rank have one.

    The ends must meet, or bytes between them would go unread."""
    if len(windows) and int(windows.max()) > width:
        raise ValueError("a string of more than two windows' length has bytes in neither end")
    several = np.flatnonzero(windows > 1)
    string = np.concatenate([np.arange(len(start)), several])
    window = np.concatenate([np.where(windows > 1, 0, ONLY), np.ones(len(several), np.int64)])
    heads = len(_heads(width, base))
    left, right = _pairs_at(hashes, np.concatenate([start, start[several] + windows[several] - 1]), width, base)
    left = left ^ np.repeat(np.where(window == 0, windows[string], 0).astype(U64), heads)
    return left, right, np.repeat(string, heads), (window[:, None] * heads + np.arange(heads)).reshape(-1).astype(np.int32)


#: Bytes of texts that are hashed together.
TOGETHER = 1 << 18


def laid(raws: list[bytes]) -> tuple[Rolling, np.ndarray]:
    """Hashes of all texts one after another, and where each starts."""
    sizes = np.array([len(r) for r in raws])
    with np.errstate(over="ignore"):
        return Rolling(_BYTES[np.frombuffer(b"".join(raws), np.uint8)], 0), np.cumsum(sizes) - sizes


def region_pairs(found: DataFrame, texts: DataFrame, width: int, length: int) -> DataFrame:
    """The first round's pairs of the ends of all found regions; ``length`` is that of
    the first ranks."""
    lists = found.groupBy("key").agg(F.collect_list(F.struct("item", "start", "windows", "n")).alias("found"))  # of one text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, found = unlisted(batch.column(1), "item", "start", "windows", "n")
        raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        at = 0
        while at < len(raws):  # short texts together
            stop, size = at, 0
            while stop < len(raws) and (stop == at or size + len(raws[stop]) <= TOGETHER):
                size += len(raws[stop])
                stop += 1
            hashes, base = laid(raws[at:stop])
            mine = slice(ends[at], ends[stop])
            start = found["start"][mine] + np.repeat(base, np.diff(ends[at : stop + 1]))
            with np.errstate(over="ignore"):
                left, right, string, place = end_pairs(hashes, start, found["windows"][mine].astype(np.int64), width, length)
            for to, x in zip(out, (left, right, found["item"][mine][string], place, found["n"][mine][string]), strict=True):
                to.append(x)
            at = stop
        return _pair_batch(out)

    return map_batches(texts.join(lists, "key").select("text", "found"), run, PAIR)


def _pair_batch(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    left, right, run, place, n = (np.concatenate(x) for x in rows)
    return pa.RecordBatch.from_arrays([signed(left), signed(right), pa.array(run), pa.array(place), pa.array(n)], names=["left", "right", "run", "place", "n"])


def run_pairs(runs: DataFrame, rivals: DataFrame, width: int, base: int, ends: bool) -> DataFrame:
    """The first round's pairs of the ends of runs, or of every window of them.

    A position is (run, place): the window's place among the run's windows, and
    which of the window's base ranks it is.
    """
    heads = len(_heads(width, base))
    lists = runs.groupBy("name", "content").agg(F.collect_list(F.struct("run", "start", "windows", "n")).alias("runs"))  # of one region

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, found = unlisted(batch.column(1), "run", "start", "windows", "n")
        hashes, begin = laid(batch.column(0).to_pylist())
        start, windows = found["start"] + np.repeat(begin, np.diff(bounds)), found["windows"].astype(np.int64)
        with np.errstate(over="ignore"):
            if ends:
                left, right, string, place = end_pairs(hashes, start, windows, width, base)
            else:
                string = np.repeat(np.arange(len(windows)), windows)
                window = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
                left, right = _pairs_at(hashes, start[string] + window, width, base)
                string, place = np.repeat(string, heads), (window[:, None] * heads + np.arange(heads)).reshape(-1).astype(np.int32)
        return _pair_batch([[x] for x in (left, right, found["run"][string], place, found["n"][string])])

    return map_batches(rivals.join(lists, ["name", "content"]).select("symbols", "runs"), run, PAIR)


def _heads(width: int, base: int) -> list[int]:
    """Places of the ranks after the first round that one window needs."""
    heads = [0]
    for _, step in offsets(width, base)[1:]:
        heads = sorted({*heads, *(h + step for h in heads)})
    return heads


def rerank(pairs: DataFrame) -> DataFrame:
    """(run, place, rank) of the positions whose pair occurs twice or more.

    Sorted by range partitions of the pair; equal pairs lie in one partition, so
    partition and place in it are a rank.  Weights count a text's copies.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(TaskContext.get().partitionId() << 40)
        for batch in batches:
            if batch.num_rows:
                yield ranker.take([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    return pairs.select("left", "right", "run", "place", "n").repartitionByRange(parts, "left", "right").sortWithinPartitions("left", "right").mapInArrow(run, RANKED)


RANKED = "run long, place int, n long, rank long"


class Ranker:
    """Ranks of sorted pairs, batch by batch.

    Of a pair that may go on in the next batch only a first row of weight one is
    held back, as it may be unique; so a pair of any number of rows takes no memory.
    """

    def __init__(self, rank: int) -> None:
        self.rank = rank
        self.last: tuple[int, int] | None = None
        self.weight = 0
        self.held: list[np.ndarray] | None = None

    def take(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        left, right = rows[0], rows[1]
        goes_on = self.last == (int(left[0]), int(right[0]))
        if goes_on and self.held is not None:
            rows = [np.concatenate(x) for x in zip(self.held, rows, strict=True)]
            left, right, self.weight = rows[0], rows[1], 0
        first = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        group = np.cumsum(first) - 1
        weights = np.bincount(group, weights=rows[4])
        if goes_on:
            weights[0] += self.weight
        elif self.last is not None:
            self.rank += 1
        often = weights[group] > 1
        ranks = self.rank + group
        self.held = [x[-1:] for x in rows] if weights[-1] <= 1 else None
        self.last, self.weight, self.rank = (int(left[-1]), int(right[-1])), int(weights[-1]), int(ranks[-1])
        return pa.RecordBatch.from_arrays([pa.array(rows[2][often]), pa.array(rows[3][often]), pa.array(rows[4][often]), pa.array(ranks[often])], names=[c.split()[0] for c in RANKED.split(", ")])


def next_pairs(ranks: DataFrame, before: list[int], after: list[int], step: int) -> DataFrame:
    """Pairs of the next round: the ranks at each head and a step on, if both live."""
    parts = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide, narrow = len(before), len(after)
    low = [before.index(h) for h in after]
    high = [before.index(h + step) for h in after]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            edge = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            cut = int(edge[-1]) if len(edge) else 0
            held = [x[cut:] for x in rows]
            if cut:
                yield joined([x[:cut] for x in rows])
        if held is not None and len(held[0]):
            yield joined(held)

    def joined(rows: list[np.ndarray]) -> pa.RecordBatch:
        rid, place, n, rank = rows
        dense = np.cumsum(np.concatenate([[0], rid[1:] != rid[:-1]])).astype(np.int64)
        key = (dense << 32) | place.astype(np.int64)  # sorted: rows come by run and place
        window, slot = place // wide, place % wide
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for k in range(narrow):
            i = np.flatnonzero(slot == low[k])
            want = (dense[i] << 32) | (window[i] * wide + high[k]).astype(np.int64)
            j = np.minimum(np.searchsorted(key, want), len(key) - 1)
            live = key[j] == want
            i, j = i[live], j[live]
            for to, x in zip(out, (rank[i], rank[j], rid[i], (window[i] * narrow + k).astype(np.int32), n[i]), strict=True):
                to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["left", "right", "run", "place", "n"])

    return ranks.repartition(parts, "run").sortWithinPartitions("run", "place").select("run", "place", "n", "rank").mapInArrow(run, PAIR)


def doubled(pairs: DataFrame, width: int, base: int, work: Workspace, name: str) -> DataFrame:
    """(run, place, n, rank) of the positions whose window of ``width`` bytes occurs twice."""
    rounds = offsets(width, base)
    heads = _heads(width, base)
    ranks = work.put(rerank(work.put(pairs, f"{name}_pairs_0")), f"{name}_ranks_0")
    work.drop(f"{name}_pairs_0")
    for k, (_, step) in enumerate(rounds[1:], 1):
        after = [h for h in heads if h + step in heads] if k < len(rounds) - 1 else [0]
        work.rest()
        pairs = work.put(next_pairs(ranks, heads, after, step), f"{name}_pairs_{k}")
        work.drop(f"{name}_ranks_{k - 1}")
        ranks = work.put(rerank(pairs), f"{name}_ranks_{k}")
        work.drop(f"{name}_pairs_{k}")
        heads = after
    return ranks


def repeated_strings(pairs: DataFrame, width: int, base: int, work: Workspace, name: str) -> DataFrame:
    """(run) of the strings that occur twice, by the last pair: ranks of both ends."""
    ranks = doubled(pairs, width, base, work, name)
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("rank")))
    ends = ranks.groupBy("run").agg(at(0).alias("first"), at(1).alias("last"), at(ONLY).alias("only"), F.min("n").alias("n"))
    pairs = ends.select(F.coalesce("only", "first").alias("left"), F.coalesce("only", "last").alias("right"), "run", F.lit(0).alias("place"), "n").filter("left is not null and right is not null")
    return rerank(pairs).select("run")


def judge_bytes(unit: Unit, base: int):
    width = unit.width

    def judge(found: DataFrame, texts: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        twice = repeated_strings(region_pairs(found, texts, width, base), width, base, work, "regions")
        settled = work.put(found.join(twice.withColumnRenamed("run", "item"), "item").select("name", "content", F.lit(0).alias("first"), F.col("windows").alias("stop")), "settled")
        work.rest()
        rivals = work.put(contents(found.filter("rivals"), texts, unit), "contents")
        narrowed = work.put(runs(rivals, unit), "runs")
        groups = narrowed.groupBy("run_name", "run_content").agg(F.sum("n").alias("n"), F.min(F.struct("name", "content", "start", "windows")).alias("at"))
        names = groups.groupBy("run_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("total > 1").select("run_name", "kinds", "least")
        some = groups.join(names, "run_name").select(F.monotonically_increasing_id().alias("run"), "run_name", "run_content", "n", F.expr("kinds > 1 and least = 1").alias("rivals"), "at.*")
        some = work.put(some, "run_groups")
        work.rest()
        twice = work.put(repeated_strings(run_pairs(some, rivals, width, base, ends=True), width, base, work, "run_ends"), "repeated_runs")
        work.rest()
        place = found.filter("n = 1").select("name", "content", "key", F.col("start").alias("begin"))
        whole = narrowed.filter("n = 1").join(some.join(twice, "run").select("run_name", "run_content"), ["run_name", "run_content"]).select("name", "content", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("stop"))
        # of runs that repeat as a whole, only their windows' part in others is still asked
        ranks = doubled(run_pairs(some.filter("rivals"), rivals, width, base, ends=False), width, base, work, "windows")
        single = ranks.filter("n = 1").join(some.select("run", "name", "content", "start"), "run").select("name", "content", (F.col("start") + F.col("place")).cast("int").alias("first"))
        spans = whole.unionByName(single.withColumn("stop", F.col("first") + 1)).join(place, ["name", "content"])
        return settled, spans.select("key", (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("stop")).alias("stop"))

    return judge


def dedup_bytes(docs: DataFrame, width: int = 400, gram: int = 64, base: int = 100, text_col: str = "text", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Remove every byte in a string of ``width`` bytes that also starts elsewhere.

    Returns docs without the text, with n_units (bytes), n_removed, n_spans and kept
    (bytes).  Null and short texts lose nothing; repeated rows of at least ``width``
    bytes lose all; null ids and further columns are carried; an empty table gives
    no rows.
    """
    unit = Unit(False, width, gram)
    return remove_repeats(docs, unit, judge_bytes(unit, base), "doubling", text_col, finish=finish)


def clean_texts(docs: DataFrame, width: int = 400, gram: int = 64, base: int = 100) -> DataFrame:
    """docs with the repeated bytes cut out of ``text`` and ``n_chars``, if there, brought
    up to date.

    Characters that a cut has split are dropped; null texts stay null, empty and short
    ones as they are; all rows of a repeated long text lose it; an empty table gives
    no rows; columns named n_units, n_removed, n_spans or kept are carried like any other.
    """
    unit = Unit(False, width, gram)
    mine = {c: unused(docs, f"own_{c}") for c in ("n_units", "n_removed", "n_spans", "kept") if c in docs.columns}
    blank = unused(docs, "blank")
    got = remove_repeats(docs.withColumnsRenamed(mine).withColumn(blank, F.col("text").isNull()), unit, judge_bytes(unit, base), "doubling", keep=keep_characters)
    got = got.withColumn("text", F.when(~F.col(blank), F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.drop(*mine).withColumnsRenamed({v: k for k, v in mine.items()}).select(*docs.columns)
