"""Near-duplicate classes by weighted MinHash over TF-IDF shingles.

Five-word shingles weigh their count times the mean inverse document frequency of
their words; frequencies are counted over all documents.  Improved consistent
weighted sampling draws, for every hash function, one (shingle, level) of a text, so
that two texts draw the same with a chance equal to their weighted Jaccard
similarity.  Texts that share the draws of a band meet in a bucket.

No bucket gives all its pairs, and none is capped:

1. The text that meets the most others is the centre of its buckets; every member is
   compared to the centre by the exact similarity, in blocks of bounded size.
   Components of the links that hold take in the large groups of copies at once.
2. In a bucket that still holds several components, every member outside the largest
   is compared to every member of another component, again exactly and in blocks
   (``compared``); only links between components leave a task.

So each pair of a bucket is compared or lies within a component, and the classes are
those of all pairs that meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import Workspace, bounded_batches
from tipoff.llm.regions import U64, Rolling, mix, word_symbols
from tipoff.llm.repeats import distinct_texts, text_key_of

_TABLE = 1 << 12
_QUANTILES = 1 << 16
#: Weights are whole numbers of this part, so that sums don't depend on their order.
SCALE = 10_000
#: Distinct words of the documents a task has read, before it hands their counts on.
FLUSH = 2_000_000


@dataclass(frozen=True)
class Params:
    """10 bands of 3 draws: a pair of similarity 0.8 meets with a chance of 0.9992."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 10
    rows: int = 3
    #: Words in fewer than one of so many documents weigh the same.  The table of
    #: the others has at most this many times the mean distinct words of a document.
    rare: int = 4096
    #: Shingles of one block of members, and of one block of those that are compared to them.
    member_block: int = 500_000
    asker_block: int = 100_000


@dataclass(frozen=True)
class Idf:
    """Inverse document frequencies by word hash: log(1 + (N + 1) / (df + 1))."""

    words: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.rare)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], self.rare)


def _gamma_quantiles() -> np.ndarray:
    """Logarithms of the quantiles of Gamma(2, 1), by Newton's method."""
    q = (np.arange(_QUANTILES + 1) + 2.0**-6) / (_QUANTILES + 2.0**-5)
    x = np.sqrt(2 * q) + q
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return np.log(x)


class Sampler:
    """Consistent weighted draws.  The step and shift of each element come from tables
    by a part of its hash, its race time from the rest."""

    def __init__(self, draws: int) -> None:
        rng = np.random.default_rng(20240501)
        self.r = -np.log(rng.random((draws, _TABLE)) * rng.random((draws, _TABLE)))
        self.beta = rng.random((draws, _TABLE))
        self.inverse = 1 / self.r
        self.odd = mix(np.arange(1, draws + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
        self.log_c = _gamma_quantiles()
        self.slope = np.diff(self.log_c)

    def draw(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One 64-bit name of (shingle, level) for every text and hash function; no text
        may be without shingles.  Short texts are drawn for together."""
        out = np.empty((len(found), len(self.odd)), U64)
        at = 0
        while at < len(found):
            stop, size = at, 0
            while stop < len(found) and (stop == at or size + len(found[stop][0]) <= 1 << 14):
                size += len(found[stop][0])
                stop += 1
            self._draw(found[at:stop], out[at:stop])
            at = stop
        return out

    def _draw(self, found: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        shingles = np.concatenate([s for s, _ in found])
        log_w = np.log(np.concatenate([w for _, w in found]).astype(np.float64))
        sizes = np.array([len(s) for s, _ in found])
        starts = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            for i, odd in enumerate(self.odd):
                h = shingles * odd
                h ^= h >> U64(32)
                h *= U64(0x9E3779B97F4A7C15)
                slot = (h & U64(_TABLE - 1)).astype(np.int64)
                beta = self.beta[i][slot]
                level = np.floor(log_w * self.inverse[i][slot] + beta)
                q = (h >> U64(48)).astype(np.int64)
                race = self.log_c[q] + self.slope[q] * ((h >> U64(16)) & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
                race -= self.r[i][slot] * (level - beta + 1)
                least = np.flatnonzero(race == np.repeat(np.minimum.reduceat(race, starts), sizes))
                best = least[np.searchsorted(least, starts)]  # the first of each text
                out[:, i] = mix(shingles[best] ^ (level[best].astype(np.int64) + (1 << 40)).astype(U64) * odd)


_SAMPLERS: dict[int, Sampler] = {}


def sampler(draws: int) -> Sampler:
    if draws not in _SAMPLERS:
        _SAMPLERS[draws] = Sampler(draws)
    return _SAMPLERS[draws]


def weighted(text: str, idf: Idf, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes ascending, whole weights) of a text.

    A text with fewer words than a shingle is one shingle; without words, none.
    """
    with np.errstate(over="ignore"):
        words = word_symbols(text.encode("utf-8", "surrogatepass"))
        if not len(words):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        width = min(width, len(words))
        shingles = Rolling(words, 0).grams(width)
    sums = np.concatenate([[0.0], np.cumsum(idf.of(words))])
    mean = np.rint((sums[width:] - sums[:-width]) * (SCALE / width)).astype(np.int64)
    names, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    return names, counts * mean[first]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum()) + int(b[1].sum()) - low
    return low / high if high > 0 else 0.0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): the rows of documents that hold each word, by its hash; a task hands
    on sums over what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    mine = np.unique(word_symbols(text.encode("utf-8", "surrogatepass")))
                words.append(mine)
                rows.append(np.full(len(mine), m, np.int64))
                size += len(mine)
            if size > FLUSH:
                yield summed(words, rows)
                words, rows, size = [], [], 0
        if size:
            yield summed(words, rows)

    def summed(words: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        names, of = np.unique(np.concatenate(words), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(of, np.concatenate(rows)).astype(np.int64))], names=["word", "n"])

    return texts.select("text", "m").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def inverse_frequencies(texts: DataFrame, params: Params) -> Idf:
    """Frequencies over all documents (rows of texts count m); what reaches the driver
    are the words that are not rare, whose number has a bound (``Params.rare``)."""
    total = texts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first().n
    floor = max(1.0, total / params.rare)
    got = word_counts(texts).filter(F.col("n") >= floor).toArrow()
    words, n = got["word"].to_numpy().view(U64), got["n"].to_numpy().astype(np.float64)
    order = np.argsort(words)
    return Idf(words[order], np.log1p((total + 1) / (n[order] + 1)), float(np.log1p((total + 1) / (floor + 1))))


def members(texts: DataFrame, idf: Idf, params: Params) -> DataFrame:
    """(bucket, key, size): a row a band of every text with words; size in shingles."""
    n = params.bands * params.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighted(t, idf, params.shingle) for t in batch.column(1).to_pylist()]
            some = [i for i, f in enumerate(found) if len(f[0])]
            if not some:
                continue
            found = [found[i] for i in some]
            draws = sampler(n).draw(found)
            bucket = np.empty((len(some), params.bands), U64)
            with np.errstate(over="ignore"):
                for band in range(params.bands):
                    name = np.full(len(some), band + 1, U64)
                    for k in range(params.rows):
                        name = mix(name * U64(0x9E3779B97F4A7C15) ^ draws[:, band * params.rows + k])
                    bucket[:, band] = name
            keys = batch.column(0).take(pa.array(np.repeat(some, params.bands)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), keys, pa.array(np.repeat([len(s) for s, _ in found], params.bands).astype(np.int32))], names=["bucket", "key", "size"])

    return texts.select("key", "text").mapInArrow(run, "bucket long, key binary, size int")


def meeting(found: DataFrame) -> DataFrame:
    """(bucket, key, size, n): members of the buckets with several; n are in the bucket."""
    # most members meet no other: they are dropped by a count of one number
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(shared, "bucket")


def block_of(key: str, blocks: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.col(blocks)).cast("int")


CELL = "cell binary, asked int, held int, key binary, root binary, asks boolean, meets boolean"


def central(met: DataFrame, params: Params) -> DataFrame:
    """CELL rows that compare the members of all buckets to their centre, each pair once.

    The centre of a bucket is the member that meets the most others in all its
    buckets: in a group of edited copies, the text they were made from.
    """
    reach = met.groupBy("key").agg(F.sum("n").alias("reach"))
    centre = met.join(reach, "key").groupBy("bucket").agg(F.max(F.struct("reach", "key")).alias("best")).select("bucket", F.col("best.key").alias("cell"))
    pairs = met.join(centre, "bucket").filter("key <> cell").select("cell", "key", "size").distinct()
    blocks = pairs.groupBy("cell").agg(F.ceil(F.sum("size") / params.member_block).cast("int").alias("blocks"))
    held = pairs.join(blocks, "cell").select("cell", F.lit(0).alias("asked"), block_of("key", "blocks", 1).alias("held"), "key", F.col("key").alias("root"), F.lit(False).alias("asks"), F.lit(True).alias("meets"))
    asked = blocks.select("cell", F.lit(0).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("held"), F.col("cell").alias("key"), F.col("cell").alias("root"), F.lit(True).alias("asks"), F.lit(False).alias("meets"))
    return held.unionByName(asked)


def apart(met: DataFrame, roots: DataFrame, work: Workspace, params: Params) -> DataFrame:
    """CELL rows of the buckets with several components: all members outside the largest
    against all members, a cell for every two blocks."""
    rooted = work.put(met.join(roots, "key", "left").select("bucket", "key", "size", F.coalesce("root", "key").alias("root")), "rooted")
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("most")).filter("parts > 1")
    sizes = whole.select("bucket", F.col("most.root").alias("largest"), F.ceil((F.col("size") - F.col("most.size")) / params.asker_block).cast("int").alias("askers"), F.ceil(F.col("size") / params.member_block).cast("int").alias("holders"))
    rows = rooted.join(sizes, "bucket").withColumns({"rest": F.col("root") != F.col("largest"), "own_asked": block_of("key", "askers", 2), "own_held": block_of("key", "holders", 3)})
    meets = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda x: F.struct(x.alias("asked"), F.col("own_held").alias("held")))
    asks = F.transform(F.sequence(F.lit(0), F.col("holders") - 1), lambda x: F.struct(F.col("own_asked").alias("asked"), x.alias("held")))
    cells = F.when(F.col("rest"), F.array_distinct(F.concat(meets, asks))).otherwise(meets)
    spread = rows.select("bucket", "key", "root", "rest", "own_asked", "own_held", F.explode(cells).alias("at"))
    return spread.select(
        F.unhex(F.lpad(F.hex("bucket"), 16, "0")).alias("cell"), "at.asked", "at.held", "key", "root",
        (F.col("rest") & (F.col("at.asked") == F.col("own_asked"))).alias("asks"), (F.col("at.held") == F.col("own_held")).alias("meets"),
    )


class Members:
    """The members of one cell: which of them are similar to a text?"""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.names, self.codes = np.unique(np.concatenate([s for s, _ in found]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in found])
        sizes = np.array([len(s) for s, _ in found])
        self.starts = np.cumsum(sizes) - sizes
        self.totals = np.add.reduceat(self.weights, self.starts)
        self.dense = np.zeros(len(self.names), np.int64)

    def similar(self, text: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Weighted Jaccard similarity of every member to the text."""
        at = np.minimum(np.searchsorted(self.names, text[0]), len(self.names) - 1)
        hit = self.names[at] == text[0]
        self.dense[at[hit]] = text[1][hit]
        low = np.add.reduceat(np.minimum(self.dense[self.codes], self.weights), self.starts)
        self.dense[at[hit]] = 0
        return low / (self.totals + int(text[1].sum()) - low)


def cell_links(rows: list[tuple], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between the components (roots) of one cell's rows (root, asks, meets, features)
    that make the same components as all its pairs at or over the threshold."""
    held, asked = [r for r in rows if r[2]], [r for r in rows if r[1]]
    if not held or not asked:
        return []
    over: dict[bytes, bytes] = {}

    def top(root: bytes) -> bytes:
        while root in over:
            root = over[root]
        return root

    index = Members([r[3] for r in held])
    found = []
    for root, _, _, features in asked:
        for j in np.flatnonzero(index.similar(features) >= threshold).tolist():
            a, b = top(root), top(held[j][0])
            if a != b:
                over[max(a, b)] = min(a, b)
                found.append((root, held[j][0]))
    return found


def compared(cells: DataFrame, texts: DataFrame, idf: Idf, params: Params) -> DataFrame:
    """(u, v) links between the roots of each cell's rows, by whole texts."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            links = []
            for cell, asked, held, root, asks, meets, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cell, asked, held) != name:
                    links += cell_links(rows, params.threshold)
                    name, rows = (cell, asked, held), []
                rows.append((root, asks, meets, weighted(text, idf, params.shingle)))
            if links:
                yield packed(links)
        if links := cell_links(rows, params.threshold):
            yield packed(links)

    def packed(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links, strict=True)], names=["u", "v"])

    whole = cells.join(texts.select("key", "text"), "key").select("cell", "asked", "held", "root", "asks", "meets", "text")
    return whole.repartition(parts, "cell", "asked", "held").sortWithinPartitions("cell", "asked", "held").mapInArrow(run, "u binary, v binary")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(key, root): the smallest key of each node's component.

    Labels fall to the smallest neighbour's and then to their label's label; every
    round is a written table, and only the number of changes reaches the driver.
    """
    both = work.put(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    label = work.put(both.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("least")).select("key", F.least("key", "least").alias("root")), "labels_0")
    turn = 0
    while True:
        turn += 1
        near = both.join(label.withColumnRenamed("key", "v"), "v").groupBy(F.col("u").alias("key")).agg(F.min("root").alias("least"))
        lower = label.join(near, "key").select("key", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        jump = label.select(F.col("key").alias("root"), F.col("root").alias("next"))
        label = work.put(lower.join(jump, "root", "left").select("key", "was", F.least("root", F.coalesce("next", "root")).alias("root")), f"labels_{turn}")
        work.drop(f"labels_{turn - 1}")
        if not label.filter("was <> root").limit(1).count():
            return label.select("key", "root")
        label = label.select("key", "root")


def joined(roots: DataFrame, over: DataFrame) -> DataFrame:
    """(key, root): ``roots`` under the roots that ``over`` gives to their roots."""
    upper = over.select(F.col("root").alias("upper"), F.col("key").alias("root"))
    below = roots.join(upper, "root", "left").select("key", F.coalesce("upper", "root").alias("root"))
    # texts that had no link are their own roots, so far without a row
    alone = over.join(roots, "key", "left_anti").select("key", "root")
    return below.unionByName(alone)


CLASS = ("class_id", "class_rows", "__root")


def near_classes(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with class_id (the smallest id of the class), class_rows and
    __root (the class's key); like-named columns are replaced.

    Equal texts are one class at once.  Null and empty texts are equal to each other
    and near to nothing else; a text of fewer words than a shingle is one shingle.
    Null ids count last: a class of null ids has a null class id.  An empty table
    gives no rows.
    """
    work = Workspace(docs.sparkSession, "minhash")
    bounded_batches(docs.sparkSession)
    texts = distinct_texts(docs, work, text_col)
    work.rest()
    idf = inverse_frequencies(texts, params)
    met = work.put(meeting(work.put(members(texts, idf, params), "members")), "meeting")
    work.drop("members")
    work.rest()
    links = work.put(compared(work.put(central(met, params), "central"), texts, idf, params), "links")
    roots = components(links, Workspace(work.spark, "components"))
    work.rest()
    more = work.put(compared(work.put(apart(met, roots, work, params), "apart"), texts, idf, params), "more_links")
    roots = work.put(joined(roots, components(more, Workspace(work.spark, "components"))), "joined")
    work.unbucket()
    work.rest()
    keyed = docs.drop(*CLASS, "__key").withColumn("__key", text_key_of(text_col))
    ids = keyed.groupBy("__key").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n"))
    root_of = ids.join(roots.withColumnRenamed("key", "__key"), "__key", "left").select("__key", "least", "n", F.coalesce("root", "__key").alias("__root"))
    root_of = work.put(root_of, "roots")
    classes = root_of.groupBy("__root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"))
    named = root_of.select("__key", "__root").join(classes, "__root")
    return keyed.join(named, "__key").drop("__key")


def keep_one(classed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each class: that with the class's id; of repeated rows any one."""
    return classed.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).dropDuplicates(["__root"]).drop(*CLASS)
