"""Phrase collocations from compressed position bitmaps.

Documents of a language are laid out in shards: every word has a position, and a piece's
end leaves one position free, which no bitmap has.  A bitmap is kept as its cells, the
bytes of eight positions that are not zero.  A phrase's bitmap has the positions of its
last words; shifted by one and ANDed with those of the words in the same cells it gives
the bitmaps of the longer phrases, whose popcount is their support in the shard.  A free
position ends every phrase, so none crosses a piece.

Supports are summed over shards.  A phrase can be rare in every shard and frequent in
all, so each length is summed before the next is tried: in a shard, words are taken a
batch at a time and followed depth-first through the phrases that are frequent in all
shards, and what is found of the next length must be frequent from its second word on.

Words and their numbers stay in tables; a shard gets the numbers of its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipoff.llm.common import Workspace, bounded_batches, map_batches, text_or_empty
from tipoff.llm.regions import Rolling, byte_symbols
from tipoff.llm.repeats import unlisted
from tipoff.operators.ordering import numbered

#: Bytes of text in a shard, and cells of the words that are followed at once.
SHARD_BYTES, BATCH_CELLS = 6_000_000, 200_000
#: Parts in which frequent words are numbered.
NUMBERING = 256
#: Most buckets that a shard's phrases are dealt to.  Up to twice as many shards (of some 8 MB
#: of phrases) a bucket is 16 MB; beyond, it grows with the corpus: shards should then be larger.
BUCKETS = 65_536

#: Byte to what it is: a newline ends a piece, a space a word.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_KIND = np.zeros(256, np.int8)
_KIND[32], _KIND[10] = 1, 2

SHARD = "lang string, shard long, n long, words array<long>, names array<binary>, counts array<long>, codes binary"


def laid_out(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(codes by position, word hashes, words, their counts) of a shard's bytes; a code is a
    word's place among the hashes and one, and zero where a piece has ended."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=0, append=0))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = Rolling(byte_symbols(raw), 1).spans(starts, stops).view(np.int64)
    words, first, code, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    place = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
    codes = np.zeros(int(place[-1]) + 1, np.int32)
    codes[place] = code + 1
    return codes, words, [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], counts


def shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Shards (SHARD) of about ``SHARD_BYTES`` of one language; a longer text is cut where a
    piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = text.encode("utf-8", "surrogatepass").lower().translate(_ENDS)
                while raw:
                    part, raw = split_at(raw)
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= SHARD_BYTES:
                        yield shard(lang, seq, held.pop(lang))
                        seq, size[lang] = seq + 1, 0
        for lang, parts in held.items():
            yield shard(lang, seq, parts)
            seq += 1

    def split_at(raw: bytes) -> tuple[bytes, bytes]:
        if len(raw) <= SHARD_BYTES:
            return raw, b""
        at = raw.rfind(b"\n", 0, SHARD_BYTES)
        at = at if at > 0 else raw.find(b"\n", SHARD_BYTES)
        return (raw[:at], raw[at:]) if at > 0 else (raw, b"")

    def shard(lang: str, seq: int, parts: list[bytes]) -> pa.RecordBatch:
        codes, words, names, counts = laid_out(b"\n".join(parts))
        row = ([lang], [seq], [int(counts.sum())], [words], [names], [counts], [codes.tobytes()])
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text_or_empty(text_col)).mapInArrow(run, SHARD)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the concatenated ranges [low, high)."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - low, size)


class Bitmaps:
    """The words' bitmaps of one shard: cells (word, place of the byte, bits).

    ``numbers`` has the number of every code; of codes without one (0) no cell is made.
    """

    def __init__(self, codes: np.ndarray, numbers: np.ndarray) -> None:
        found = numbers[codes]
        at = np.flatnonzero(found)
        self.words, code = np.unique(found[at], return_inverse=True)
        self.kinds = len(self.words)
        cell = (at >> 3) * max(1, self.kinds) + code  # ordered by place
        order = np.argsort(cell, kind="stable")
        cell, at = cell[order], at[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.bits = np.add.reduceat(np.left_shift(1, at & 7), first).astype(np.uint16) if len(first) else np.zeros(0, np.uint16)
        self.place, self.word = np.divmod(cell[first], max(1, self.kinds))
        self.ends = np.searchsorted(self.place, np.arange((len(codes) >> 3) + 3))
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_ends = np.searchsorted(self.word[self.by_word], np.arange(self.kinds + 1))

    def batches(self) -> Iterator[np.ndarray]:
        """Words, a batch of neighbours at a time."""
        low = 0
        while low < self.kinds:
            high = max(low + 1, int(np.searchsorted(self.word_ends, self.word_ends[low] + BATCH_CELLS, "right")) - 1)
            yield np.arange(low, high)
            low = high

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells (node, place, bits) of words; a word's node is its place in ``words``."""
        node, at = ranges(self.word_ends[words], self.word_ends[words + 1])
        at = self.by_word[at]
        return node, self.place[at], self.bits[at]

    def extend(self, node: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parent, word, support, cells) of all phrases that are a word longer."""
        moved = bits << 1
        low, carry = moved & 255, moved >> 8
        over = np.flatnonzero(carry)
        node, place = np.concatenate([node, node[over]]), np.concatenate([place, place[over] + 1])
        moved = np.concatenate([low, carry[over]])
        owner, at = ranges(self.ends[place], self.ends[place + 1])
        both = moved[owner] & self.bits[at]
        live = np.flatnonzero(both)
        owner, at, both = owner[live], at[live], both[live]
        child, index = np.unique(node[owner] * max(1, self.kinds) + self.word[at], return_inverse=True)
        support = np.bincount(index, weights=np.bitwise_count(both), minlength=len(child)).astype(np.int64)
        parent, word = np.divmod(child, max(1, self.kinds))
        return parent, word, support, (index, place[owner], both)


class Known:
    """The frequent phrases of one length that a shard has, and what they begin with: a
    phrase is the number of what it begins with, and its last word."""

    def __init__(self, phrases: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        number = np.zeros(len(phrases), np.uint64)
        for k in range(phrases.shape[1]):
            level, number = np.unique(self.key(number, phrases[:, k]), return_inverse=True)
            self.levels.append(level)

    @staticmethod
    def key(number: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (number.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)

    def has(self, phrases: np.ndarray) -> np.ndarray:
        """Which rows are known phrases or begin one."""
        number, good = np.zeros(len(phrases), np.int64), np.ones(len(phrases), bool)
        for k in range(phrases.shape[1]):
            level = self.levels[k]
            if not len(level):
                return np.zeros(len(phrases), bool)
            key = self.key(number, phrases[:, k])
            number = np.minimum(np.searchsorted(level, key), len(level) - 1)
            good &= level[number] == key
        return good


def followed(maps: Bitmaps, known: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, supports) of ``longest`` words in a shard, a batch of first words at a time.

    ``known`` has the frequent phrases of one word less (none are needed for pairs).
    """
    before = Known(known) if longest > 2 else None
    for words in maps.batches():
        phrases, cells = maps.words[words][:, None], maps.of(words)
        for length in range(2, longest + 1):
            parent, word, support, cells = maps.extend(*cells)
            phrases = np.column_stack([phrases[parent], maps.words[word]])
            if before is None:
                continue
            good = before.has(phrases if length < longest else phrases[:, 1:])
            number = np.cumsum(good) - 1
            live = good[cells[0]]
            cells = (number[cells[0][live]], cells[1][live], cells[2][live])
            phrases, support = phrases[good], support[good]
        if len(phrases):
            yield phrases, support


COUNTED = "lang string, bucket int, shard long, phrases binary, counts binary"


def counted(coded: DataFrame, length: int, buckets: int) -> DataFrame:
    """Supports (COUNTED) of phrases of ``length`` words, by shard and bucket of phrases.

    ``coded`` is (lang, shard, codes, own, known): ``own`` numbers the shard's frequent words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, own = unlisted(batch.column(3), "k", "w1")
            for i, (lang, shard, codes, known) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4)], strict=True)):
                place = np.frombuffer(codes, np.int32)
                numbers = np.zeros(int(place.max()) + 1, np.int64)
                mine = slice(ends[i], ends[i + 1])
                numbers[own["k"][mine] + 1] = own["w1"][mine]
                maps = Bitmaps(place, numbers)
                before = np.concatenate([np.frombuffer(k, np.uint32) for k in known or [b""]]).astype(np.int64).reshape(-1, max(1, length - 1))
                found = list(followed(maps, before, length))
                if found:
                    yield dealt(lang, shard, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    def dealt(lang: str, shard: int, phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = np.zeros(len(phrases), np.uint64)
        for k in range(length):
            bucket = (bucket ^ phrases[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (bucket >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        phrases, counts = phrases[order].astype(np.uint32), counts[order].astype(np.uint32)
        rows = [(lang, i, shard, phrases[a:b].tobytes(), counts[a:b].tobytes()) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])

    bounded_batches(coded.sparkSession)
    return coded.select("lang", "shard", "codes", "own", "known").mapInArrow(run, COUNTED)


SUMMED = "lang string, shard long, phrases binary, totals array<long>"


def summed(rows: DataFrame, length: int, least: int) -> DataFrame:
    """SUMMED: the phrases of a bucket with ``least`` occurrences in all shards, in a row of
    shard -1 with their totals, and those of them that each shard has.

    A bucket's rows are a shard's part each; a phrase that is everywhere is one entry a shard.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucket(lang: str, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        phrases = np.concatenate([np.frombuffer(h[1], np.uint32) for h in held]).reshape(-1, length)
        counts = np.concatenate([np.frombuffer(h[2], np.uint32) for h in held]).astype(np.int64)
        shard = np.repeat(np.arange(len(held)), [len(h[2]) // 4 for h in held])
        order = np.lexsort(phrases.T[::-1])
        sorted_ = phrases[order]
        first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]))
        totals = np.add.reduceat(counts[order], first)
        often = totals >= least
        out = [(lang, -1, sorted_[first[often]].tobytes(), totals[often])]
        mine = order[np.repeat(often, np.diff(np.append(first, len(order))))]
        mine = mine[np.argsort(shard[mine], kind="stable")]
        edge = np.searchsorted(shard[mine], np.arange(len(held) + 1)).tolist()
        out += [(lang, h[0], phrases[mine[a:b]].tobytes(), None) for h, a, b in zip(held, edge[:-1], edge[1:], strict=True) if b > a]
        types = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in SUMMED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for lang, number, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is not None and key != (lang, number):
                    yield bucket(key[0], held)
                    held = []
                key = (lang, number)
                held.append(rest)
        if key is not None:
            yield bucket(key[0], held)

    return rows.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, SUMMED)


def totals_of(rows: DataFrame, length: int) -> DataFrame:
    """(lang, w1 .. wk, f) of the frequent phrases."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        phrases = [np.frombuffer(p, np.uint32).reshape(-1, length) for p in batch.column(1).to_pylist()]
        langs = batch.column(0).take(pa.array(np.repeat(np.arange(len(phrases)), [len(p) for p in phrases])))
        flat = np.concatenate(phrases).astype(np.int64)
        return pa.RecordBatch.from_arrays([langs, *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(length)], batch.column(2).flatten()], names=["lang", *[f"w{k + 1}" for k in range(length)], "f"])

    return map_batches(rows.filter("shard = -1").select("lang", "phrases", "totals"), run, "lang string, " + ", ".join(f"w{k + 1} long" for k in range(length)) + ", f long")


def frequent(docs: DataFrame, longest: int, least: int, text_col: str, lang_col: str, work: Workspace) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(words, sizes, phrases): frequent words (lang, w1, word, f), words of each language
    (lang, n), and (lang, w1 .., f) of the frequent phrases of 2 words and more."""
    spark = docs.sparkSession
    laid = work.put(shards(docs, text_col, lang_col), "shards")
    sizes = laid.groupBy("lang").agg(F.sum("n").alias("n"))
    each = laid.select("lang", F.explode(F.arrays_zip("words", "names", "counts")).alias("x")).select("lang", "x.words", "x.names", "x.counts")
    counts = each.groupBy("lang", "words").agg(F.min("names").alias("name"), F.sum("counts").alias("f")).filter(F.col("f") >= least)
    part = F.pmod(F.xxhash64("lang", "words"), F.lit(NUMBERING))
    place = F.row_number().over(Window.partitionBy(part).orderBy("lang", "words"))
    words = work.put(counts.select("lang", "words", F.col("name").cast("string").alias("word"), "f", (place * NUMBERING + part).cast("long").alias("w1")), "words")
    own = laid.select("lang", "shard", F.posexplode("words").alias("k", "words")).join(words.select("lang", "words", "w1"), ["lang", "words"])
    own = own.groupBy("shard").agg(F.collect_list(F.struct("k", "w1")).alias("own"))  # of one shard
    coded = work.put(laid.select("lang", "shard", "codes").join(own, "shard"), "coded")
    work.rest()
    buckets = min(BUCKETS, max(1, coded.count() // 2))
    known, phrases = None, []
    for length in range(2, longest + 1):
        shard_rows = coded.withColumn("known", F.array().cast("array<binary>")) if known is None else coded.join(known, "shard")
        rows = work.put(summed(counted(shard_rows, length, buckets), length, least), f"phrases_{length}")
        work.rest()
        phrases.append(totals_of(rows, length))
        known = rows.filter("shard >= 0").groupBy("shard").agg(F.collect_list("phrases").alias("known"))  # of one shard
    return words, sizes, phrases


def scored(words: DataFrame, sizes: DataFrame, phrases: list[DataFrame]) -> DataFrame:
    """(lang, w1 .., length, a, l, r, n, score): each frequent phrase at its lowest-scoring cut."""
    by_length = [words.select("lang", "w1", "f"), *phrases]
    out = None
    for length, table in enumerate(phrases, 2):
        rows = table.withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, length):
            left = by_length[k - 1].withColumnRenamed("f", f"l{k}")
            right = by_length[length - k - 1].select("lang", *[F.col(f"w{j}").alias(f"w{j + k}") for j in range(1, length - k + 1)], F.col("f").alias(f"r{k}"))
            rows = rows.join(left, ["lang", *[f"w{j}" for j in range(1, k + 1)]]).join(right, ["lang", *[f"w{j}" for j in range(k + 1, length + 1)]])
            # squares of counts and a million fit in 38 digits up to 10^15 occurrences
            score = F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))")
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        lowest = F.array_min(F.array(*cuts))
        longer = [F.lit(None).cast("long").alias(f"w{j}") for j in range(length + 1, len(phrases) + 2)]
        rows = rows.withColumn("cut", lowest).select("lang", *[f"w{j}" for j in range(1, length + 1)], *longer, F.lit(length).alias("length"), "a", "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    return out.join(sizes, "lang")


def inside_longer(phrases: list[DataFrame], share: int) -> list[DataFrame]:
    """Of each length, the phrases inside a longer candidate that has ``share`` percent of
    their occurrences."""
    out = []
    for length, table in enumerate(phrases, 2):
        parts = None
        for more, longer in enumerate(phrases[length - 1 :], length + 1):
            for k in range(more - length + 1):
                part = longer.select("lang", *[F.col(f"w{j + k}").alias(f"w{j}") for j in range(1, length + 1)], "f")
                parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            continue
        keys = ["lang", *[f"w{j}" for j in range(1, length + 1)]]
        most = parts.groupBy(*keys).agg(F.max("f").alias("most"))
        out.append(table.join(most, keys).filter(100 * F.col("most") >= share * F.col("f")).select(*keys))
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to
    ``longest`` words with at least ``least`` occurrences.

    Phrases lie within pieces; null texts count as empty, a null language is ``und``; texts
    are whole, however long, and repeated rows count each.  Equal scores are ordered by
    occurrences, then by the phrase's bytes.  Further columns are not looked at; an empty table
    gives no rows.  Words are told apart by 64-bit hashes.
    """
    work = Workspace(docs.sparkSession, "phrases")
    words, sizes, phrases = frequent(docs, longest, least, text_col, lang_col, work)
    table = scored(words, sizes, phrases)
    columns = [f"w{j}" for j in range(1, longest + 1)]
    for length, gone in enumerate(inside_longer(phrases, share), 2):
        keys = ["lang", *columns[:length]]
        table = table.join(gone.withColumn("length", F.lit(length)), [*keys, "length"], "left_anti")
    # by score and occurrences first: only what may be among the first is named; a language's
    # phrases are placed by ranges, as they may be many
    placed = numbered(table, ["lang"], [F.desc("score"), F.desc("a"), *[F.asc(c) for c in columns]], "place")
    edge = placed.filter(F.col("place") == top).select("lang", F.col("score").alias("edge_score"), F.col("a").alias("edge_a"))  # a row a language
    kept = F.col("edge_score").isNull() | (F.col("score") > F.col("edge_score")) | ((F.col("score") == F.col("edge_score")) & (F.col("a") >= F.col("edge_a")))
    first = work.put(placed.join(edge, "lang", "left").filter(kept).drop("place", "edge_score", "edge_a"), "first")
    for c in columns:
        name = words.select("lang", F.col("w1").alias(c), F.col("word").alias(f"{c}_word"))
        first = first.join(name, ["lang", c], "left")
    named = first.withColumn("phrase", F.concat_ws(" ", *[f"{c}_word" for c in columns]))
    ranked = numbered(named, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank")
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
