"""Ranked lexical search: three-phase uniform-threshold top-k over term-partitioned postings.

A list is the postings of a term, in segments of at most a chunk of documents: lists are
spread by term and chunk, so a term that is in a third of all documents is many segments
and not one task.  A segment has the chunk's document numbers with their counts; what a
posting adds to a score is worked out where it is read.

1. Heads.  The first entries of every list by what they add give partial sums; the best
   documents by partial sums are looked up exactly, and the k-th best of them is a bound
   that the k-th best of all does not fall below.
2. Uniform threshold.  All lists of an item give their entries from one threshold on.  What
   a document did not show adds less than the threshold in each list, and no more than the
   list's head; the threshold is the highest at which this comes to ``UNSEEN`` of the bound.  (At
   all of the bound no document could be missed, but most that show anything would be looked
   up.)  Documents whose upper bound reaches the lower one are candidates.
3. Lookup.  Candidates are looked up in all lists of their item: exact scores.

Terms are the asked items' own: items are taken in blocks of a bounded number of terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipoff.llm.common import Workspace, bounded_batches, map_batches, text_or_empty

#: Documents and postings of a chunk, at most.
CHUNK_DOCS, CHUNK_POSTINGS = 16_384, 2_000_000
#: Terms of the items that are ranked together: some 50 bytes each on the driver and in every worker.
BLOCK_TERMS = 1_000_000
#: Share of the bound that may go unseen: a lower one fetches more and looks up less.
UNSEEN = 0.5
#: Entries of a list's head for each of the k asked, and of the documents that set the bound.
HEAD, SEEDS = 2, 4

_TERM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order: runs of letters, digits and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    """What a term weighs that df of n_docs documents have."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Scoring:
    """The corpus' figures and its terms' weights; b is a percentage, k1 in tenths."""

    docs: int
    words: int
    weights: np.ndarray
    b: int
    k1: int

    def added(self, term: int, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a document's score."""
        m = 100 - self.b + self.b * n.astype(np.int64) * self.docs // max(1, self.words)
        tf = tf.astype(np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + self.k1 * m))


#: A list's segment; the row of a chunk's documents has ``term`` -1, their ids and lengths.
SEGMENT = "list long, term int, chunk long, size int, total long, at binary, tf binary, n binary, ids array<long>"


def segments(docs: DataFrame, asked: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """The lists of the asked terms, chunk by chunk."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(asked)})  # at most BLOCK_TERMS
    schema = pa.schema([("list", pa.int64()), ("term", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()), ("total", pa.int64()), ("at", pa.binary()), ("tf", pa.binary()), ("n", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq = known.value, TaskContext.get().partitionId() << 11
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[tuple[list[int], list[int], int]] = []
        postings = 0
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(words)
                mine = counts.keys() & number.keys()
                held.append(([number[t] for t in mine], [counts[t] for t in mine], len(ids)))
                ids.append(doc)
                lengths.append(len(words))
                postings += len(mine)
                if len(ids) >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    yield chunk(seq, ids, lengths, held)
                    ids, lengths, held, postings, seq = [], [], [], 0, seq + 1
        if ids:
            yield chunk(seq, ids, lengths, held)

    def chunk(seq: int, ids: list[int | None], lengths: list[int], held: list[tuple[list[int], list[int], int]]) -> pa.RecordBatch:
        n = np.array(lengths, np.int64)
        at = np.repeat(np.array([h[2] for h in held], np.uint32), [len(h[0]) for h in held])
        term = np.array([t for h in held for t in h[0]], np.int64)
        tf = np.array([c for h in held for c in h[1]], np.uint32)
        order = np.argsort(term, kind="stable")
        term, at, tf = term[order], at[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        stop = np.append(first, len(term))[1:]
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
        named, none = term[first].tolist(), [None] * len(first)
        columns = [
            [-1, *((t << 32) | seq for t in named)], [-1, *named], [seq] * (len(named) + 1), [len(ids), *(stop - first).tolist()], [int(n.sum()), *[0] * len(named)],
            [None, *cut(at)], [None, *cut(tf)], [n.astype(np.uint32).tobytes(), *cut(n[at].astype(np.uint32))], [ids, *none],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    bounded_batches(spark)
    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(run, SEGMENT)


def _entries(batch: pa.RecordBatch, i: int, scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """(at, added) of a segment: columns term, chunk, at, tf, n."""
    at, tf, n = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint32) for k in (2, 3, 4))
    return at, scoring.added(batch.column(0)[i].as_py(), tf, n)


ENTRY = ["term", "chunk", "at", "tf", "n"]


def heads(lists: DataFrame, scoring: Scoring, depth: int) -> DataFrame:
    """(term, chunk, at, added): the ``depth`` entries of every list that add most."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, (term, chunk) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True)):
            at, added = _entries(batch, i, scoring)
            best = np.argpartition(-added, depth - 1)[:depth] if len(at) > depth else np.arange(len(at))
            for to, x in zip(out, (np.full(len(best), term, np.int32), np.full(len(best), chunk), at[best].astype(np.int32), added[best]), strict=True):
                to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["term", "chunk", "at", "added"])

    first = map_batches(lists.select(*ENTRY), run, "term int, chunk long, at int, added long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("added"), "chunk", "at"))
    return first.filter("added > 0").withColumn("place", place).filter(F.col("place") <= depth).drop("place")


FOUND = "item int, chunk long, at binary, over binary"
_FOUND = pa.schema([("item", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("over", pa.binary())])


def _found(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)


def over_threshold(lists: DataFrame, scoring: Scoring, asks: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """FOUND: the entries from an item's threshold on; ``asks`` has (item, threshold, most
    that goes unseen) by term.  ``over`` is what an entry adds beyond what may go unseen, in
    steps of a 255th of the largest, rounded up; the step comes first."""
    shared = lists.sparkSession.sparkContext.broadcast(asks)  # at most BLOCK_TERMS entries

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes, bytes]] = []
        asked = shared.value
        for i, (term, chunk) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True)):
            if term not in asked:
                continue
            at, added = _entries(batch, i, scoring)
            order = np.argsort(-added, kind="stable")
            at, added = at[order].astype(np.uint16), added[order]
            for item, threshold, unseen in asked[term]:
                take = int(np.searchsorted(-added, -threshold, "right"))
                if take:
                    over = added[:take] - unseen  # 1 and more
                    step = -(-int(over[0]) // 255)
                    rows.append((item, chunk, at[:take].tobytes(), np.int64(step).tobytes() + (-(-over // step)).astype(np.uint8).tobytes()))
        return _found(rows)

    return map_batches(lists.select(*ENTRY), run, FOUND)


def gathered(found: DataFrame) -> DataFrame:
    """(item, chunk, parts): what the lists of an item have found in a chunk's documents."""
    return found.groupBy("item", "chunk").agg(F.collect_list(F.struct("at", "over")).alias("parts"))  # a row a list


def candidates(found: DataFrame, lacking: np.ndarray) -> DataFrame:
    """(item, chunk, at): documents whose upper bound reaches their item's lower one;
    ``lacking`` is what an item's documents need beyond what may go unseen in all lists."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, chunk, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            total = np.zeros(CHUNK_DOCS, np.int64)
            for p in parts:
                step = int(np.frombuffer(p["over"][:8], np.int64)[0])
                total[np.frombuffer(p["at"], np.uint16)] += np.frombuffer(p["over"][8:], np.uint8).astype(np.int64) * step
            good = np.flatnonzero((total > 0) & (total >= lacking[item]))
            if len(good):
                rows.append((item, chunk, good.astype(np.uint16).tobytes()))
        types = (pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["item", "chunk", "at"])

    return map_batches(gathered(found), run, "item int, chunk long, at binary")


def looked_up(asked: DataFrame, pairs: DataFrame, lists: DataFrame, scoring: Scoring, least: np.ndarray) -> DataFrame:
    """(item, chunk, at, score): exact scores of documents, asked as (item, chunk, at binary),
    from their item's ``least`` on."""
    wanted = asked.join(pairs, "item").select((F.shiftleft(F.col("term").cast("long"), 32).bitwiseOR(F.col("chunk"))).alias("list"), "item", "at")
    wanted = wanted.groupBy("list").agg(F.collect_list(F.struct("item", F.col("at").alias("asked"))).alias("wanted"))  # of one chunk

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes, bytes]] = []
        chunks, wants = batch.column(1).to_pylist(), batch.column(5).to_pylist()
        for i, chunk in enumerate(chunks):
            at, added = _entries(batch, i, scoring)
            adds = np.zeros(CHUNK_DOCS, np.int64)
            adds[at] = added
            for w in wants[i]:
                ask = np.frombuffer(w["asked"], np.uint16)
                mine = ask[adds[ask] > 0]
                if len(mine):
                    rows.append((w["item"], chunk, mine.tobytes(), adds[mine].tobytes()))
        return _found(rows)

    def scores(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for item, chunk, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            total = np.zeros(CHUNK_DOCS, np.int64)
            for p in parts:
                total[np.frombuffer(p["at"], np.uint16)] += np.frombuffer(p["over"], np.int64)
            good = np.flatnonzero((total > 0) & (total >= least[item]))
            for to, x in zip(out, (np.full(len(good), item, np.int32), np.full(len(good), chunk), good.astype(np.int32), total[good]), strict=True):
                to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["item", "chunk", "at", "score"])

    joined = lists.join(wanted, "list").select(*ENTRY, "wanted")
    return map_batches(gathered(map_batches(joined, run, FOUND)), scores, "item int, chunk long, at int, score long")


def packed(rows: DataFrame) -> DataFrame:
    """(item, chunk, at) with a row a document as (item, chunk, at binary)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [np.array(x, np.uint16).tobytes() for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["item", "chunk", "at"])

    return map_batches(rows.groupBy("item", "chunk").agg(F.collect_list("at").alias("at")), run, "item int, chunk long, at binary")


def asked_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the terms of every item once each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
        owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    return map_batches(items.select(F.col(item_col).cast("long"), text_or_empty(text_col)), run, "item_id long, term binary").distinct()


def uniform_threshold(tops: list[int], room: int) -> int:
    """The highest t with sum(min(t - 1, top)) <= room, at least 1."""
    left, room = sorted(tops), max(0, room)
    while left and left[0] * len(left) <= room:
        room -= left.pop(0)
    return room // len(left) + 1 if left else max(tops, default=0) + 1


def ranked_block(docs: DataFrame, pairs: list[tuple[int | None, bytes]], k: int, b: int, k1: int, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """The k best documents of the items of one block, given as (item_id, term)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
    place = {i: p for p, i in enumerate(ids)}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = work.bucketed(segments(docs, vocabulary, id_col, text_col).repartition(parts, "list"), "list")
    of_docs, lists = lists.filter("term = -1"), lists.filter("term >= 0")

    total = of_docs.agg(F.sum("size").alias("docs"), F.sum("total").alias("words")).first()
    held = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum("size").alias("df")).collect()}  # at most BLOCK_TERMS
    n_docs = total["docs"] or 0
    weights = np.array([weight(n_docs, held.get(t, 0)) if t in held else 0 for t in range(len(vocabulary))], np.int64)
    scoring = Scoring(n_docs, total["words"] or 0, weights, b, k1)
    terms_of: list[list[int]] = [[] for _ in ids]
    for i, t in pairs:
        if number[t] in held:
            terms_of[place[i]].append(number[t])
    flat = [(p, t) for p, mine in enumerate(terms_of) for t in mine]
    frame = spark.createDataFrame(pa.table({"item": pa.array([f[0] for f in flat], pa.int32()), "term": pa.array([f[1] for f in flat], pa.int32())}))

    first = work.put(heads(lists, scoring, HEAD * k), "heads")
    most = {r["term"]: r["added"] for r in first.groupBy("term").agg(F.max("added").alias("added")).collect()}  # at most BLOCK_TERMS
    partial = first.join(frame, "term").groupBy("item", "chunk", "at").agg(F.sum("added").alias("score"))
    place_of = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "chunk", "at"))
    seeds = partial.withColumn("place", place_of).filter(F.col("place") <= SEEDS * k).select("item", "chunk", "at")
    seeded = looked_up(packed(seeds), frame, lists, scoring, np.zeros(len(ids), np.int64)).withColumn("place", place_of)
    bound = {r["item"]: r["score"] for r in seeded.filter(F.col("place") == k).select("item", "score").collect()}  # a row an item

    asks: dict[int, list[tuple[int, int, int]]] = {}
    lacking = np.zeros(len(ids), np.int64)
    least = np.array([max(1, bound.get(p, 0)) for p in range(len(ids))], np.int64)
    for p, mine in enumerate(terms_of):
        low = bound.get(p, 0)
        tops = [most.get(t, 0) for t in mine]
        threshold = uniform_threshold(tops, int(UNSEEN * low))
        unseen = {t: min(threshold - 1, top) for t, top in zip(mine, tops, strict=True)}
        lacking[p] = low - sum(unseen.values())
        for t, top in zip(mine, tops, strict=True):
            if top >= threshold:
                asks.setdefault(t, []).append((p, threshold, unseen[t]))
    chosen = work.put(candidates(over_threshold(lists, scoring, asks), lacking), "candidates")
    exact = looked_up(chosen, frame, lists, scoring, least)
    asked = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    named = exact.join(asked, "item").join(of_docs.select("chunk", F.posexplode("ids").alias("at", "doc_id")), ["chunk", "at"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return work.put(named.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, k1: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all documents for each item.

    Null, empty and termless texts are no documents and ask nothing; texts are whole, however
    long.  Repeated rows rank each on its own, equal scores by doc_id, a null one last; items
    with one id (or with none) are one item with the terms of all.  Items that no document
    shares a term with have no rows, nor has anything where a table is empty.  Other columns
    of either table are not looked at.
    """
    work = Workspace(docs.sparkSession, "lexical")
    pairs = work.put(asked_terms(items, item_col, item_text_col), "asked")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    out = None
    for i in range(blocks):  # every block asks all documents
        mine = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        block = Workspace(docs.sparkSession, "lexical")
        got = ranked_block(docs, [(r["item_id"], bytes(r["term"])) for r in mine.collect()], k, b, k1, id_col, text_col, block)
        block.unbucket()
        out = got if out is None else out.unionByName(got)
    return out
