"""Packing by lexical retrieval: neighbours of a seed document fill its window.

Every shard is a block of rows of one input partition, bounded in tokens, with a
BM25 inverted index of its own (terms: token ids).  The first unused document is
the seed; all its terms query the index; its unused neighbours, best first, fill the
window to the last token, and the next unused document only where none is left.  What a
window cuts off opens the next one, so that padding arises only at the end of a
shard.  Ids come from the tokenizers library: a document's chunks between white
space are looked up in a cache, and the library encodes the chunks that are new.

No shuffle: rows are packed where they are read; a third of all rows with one
source or one text changes nothing but the neighbours.  A document's neighbours are
those of its shard: rows should come in an order that keeps like with like (a crawl's
order by host), or be range-partitioned so beforehand.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.bpe import PairIndexBpe
from tipoff.llm.common import bounded_batches, text_or_empty, uncollected

#: Tokens and documents of one shard: the first bounds the memory of a task, the second the
#: time of a shard of short documents, as every question looks at all that are unused.
SHARD_TOKENS, SHARD_DOCS = 6_000_000, 20_000
#: Neighbours asked of the index at a time; a seed may ask again and again.
NEIGHBOURS = 16
#: BM25's parameters.
K1, B = 1.2, 0.75
#: A term in more than this share of a shard's documents has a row of weights instead of
#: postings; as rows are at most so full, they are at most 9 times the postings.
DENSE = 0.12

#: Share of used documents beyond which they leave the postings.
SHRINK = 0.15

#: Lower-case words that a worker keeps, besides the chunks.
WORD_ENTRIES = 900_000
#: A word of Latin letters and the marks after it, which are pieces of their own.
#: Without the dotted capital I, whose lower case is two characters, and the apostrophe.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@[-^`{-~]*)")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LibraryIds(PairIndexBpe):
    """Whole texts to ids, new chunks by the tokenizers library in one call."""

    #: It has no pieces to keep, so more chunks.
    entries = 600_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # for words of lower-case letters: nothing to normalise, nothing to cut but at spaces
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
        spec["added_tokens"] = []
        self._word_library = Tokenizer.from_str(json.dumps(spec))
        self._tails: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._ends = np.array([t.endswith(self.suffix) for t in self.tokens]) if self.suffix else None

    def _learn(self, chunks: set[str]) -> None:
        """Most new chunks are a word, new or known, with or without end marks."""
        cache, tails = self._chunks, self._tails
        if len(self._words) > WORD_ENTRIES:
            self._words = {}
        known = self._words
        parts, words, rest = [], set(), []
        fits = _WORD.fullmatch if self._ends is not None else lambda c: None
        for c in chunks:
            plain = fits(c)
            if plain is None:
                rest.append(c)
                continue
            word, tail = plain.groups()
            word = word.lower()
            if tail not in tails:
                tails[tail] = self._one(tail)
            parts.append((c, word, tails[tail]))
            if word not in known:
                words.add(word)
        self._learn_words(list(words))
        for c, word, tail in parts:
            cache[c] = known[word] + tail if tail else known[word]
        for i in range(0, len(rest), 2000):
            block = rest[i : i + 2000]
            for c, e in zip(block, self._library.encode_batch_fast(block, add_special_tokens=False), strict=True):
                cache[c] = array("I", e.ids).tobytes()

    def _one(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Letters only: one piece each, that ends where a token ends a word."""
        for i in range(0, len(words), 2000):
            block = words[i : i + 2000]
            ids = np.array(self._word_library.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.uint32)
            stops = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            packed, start = ids.tobytes(), 0
            for word, stop in zip(block, stops, strict=True):
                self._words[word] = packed[start:stop]
                start = stop


@functools.lru_cache(maxsize=2)
def load(path: str) -> LibraryIds:
    return LibraryIds(path)


class Bm25Shard:
    """Inverted index of one shard: postings (document, weight) by term.

    The separator at a document's end is no term: all would share it."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.float64)
        mean = max(1.0, float(lengths.mean())) if self.n else 1.0
        terms, owners, tfs, self.of = [], [], [], [(0, 0)] * self.n
        at = 0
        for i, d in enumerate(docs):
            t, c = np.unique(d[:-1], return_counts=True)
            terms.append(t)
            tfs.append(c)
            owners.append(np.full(len(t), i, np.int32))
            self.of[i] = (at, at + len(t))
            at += len(t)
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        tf = (np.concatenate(tfs) if tfs else np.zeros(0)).astype(np.float32)
        size = int(self.terms.max()) + 1 if len(self.terms) else 1
        df = np.bincount(self.terms, minlength=size)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner].astype(np.float32) / mean))
        order = np.argsort(self.terms, kind="stable")
        self.ids = np.arange(self.n)  # documents that the postings are of
        self.post, self.post_weight, self.post_term = owner[order], (weight * self.idf[self.terms])[order], self.terms[order]
        self.first = np.concatenate([[0], np.cumsum(df)])
        common = np.flatnonzero(df > DENSE * self.n)
        self.row = np.full(size, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for i, t in enumerate(common.tolist()):
            a, b = self.first[t], self.first[t + 1]
            self.rows[i, self.post[a:b]] = self.post_weight[a:b]

    def shrink(self, used: np.ndarray) -> None:
        """Take used documents out of the postings; weights stay those of the whole shard."""
        keep = np.flatnonzero(~used[self.ids])
        place = np.full(len(self.ids), -1, np.int32)
        place[keep] = np.arange(len(keep))
        self.ids, self.rows = self.ids[keep], np.ascontiguousarray(self.rows[:, keep])
        post = place[self.post]
        left = post >= 0
        self.post, self.post_weight, self.post_term = post[left], self.post_weight[left], self.post_term[left]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.post_term, minlength=len(self.row)))])

    def neighbours(self, seed: int, used: np.ndarray, k: int) -> list[int]:
        """Up to k unused documents by BM25 score for all terms of the seed."""
        if self.of[seed][0] == self.of[seed][1]:
            return []  # an empty text
        gone = used[self.ids]
        if np.count_nonzero(gone) > SHRINK * len(self.ids):
            self.shrink(used)
            gone = used[self.ids]
        terms = self.terms[slice(*self.of[seed])]
        row = self.row[terms]
        asked = np.zeros(len(self.rows), np.float32)
        asked[row[row >= 0]] = 1
        total = (asked @ self.rows).astype(np.float64)
        rare = terms[row < 0]
        if len(rare):
            spans = list(zip(self.first[rare].tolist(), self.first[rare + 1].tolist(), strict=True))
            owner = np.concatenate([self.post[a:b] for a, b in spans])
            total += np.bincount(owner, weights=np.concatenate([self.post_weight[a:b] for a, b in spans]), minlength=len(self.ids))
        total[gone] = 0
        found = np.flatnonzero(total > 0)
        if len(found) > k:
            found = found[total[found] >= np.partition(total[found], -k)[-k]]
        return self.ids[found[np.lexsort((found, -total[found]))][:k]].tolist()


def pack_shard(docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard.

    The document that opens a window, or goes on in it, is its seed.  Neighbours are
    asked for in blocks until the window is full; where no unused document shares a
    term with the seed, the next unused one is laid and is the seed from there on.
    """
    index = Bm25Shard(docs)
    used = np.zeros(len(docs), bool)
    sequence, room, unused = 0, window, 0
    queue: list[int] = []
    seed, current, at = -1, -1, 0  # at: how much of the current document is laid
    while True:
        if current < 0:
            if not queue and seed >= 0:
                queue = index.neighbours(seed, used, NEIGHBOURS)[::-1]
            if queue:
                current = queue.pop()
            else:
                while unused < len(docs) and used[unused]:
                    unused += 1
                if unused == len(docs):
                    return
                current = seed = unused
            used[current], at = True, 0
        length = min(room, len(docs[current]) - at)
        yield current, at, length, sequence, window - room
        at, room = at + length, room - length
        if at == len(docs[current]):
            current = -1
        if room == 0:
            sequence, room, queue, seed = sequence + 1, window, [], current


def pack(docs: DataFrame, path: str, window: int = 2048, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into windows of ``window`` tokens: one row a piece.

    A document is its ids and the separator id; a null or empty text is the
    separator alone.  Repeated rows and ids are packed each; null ids stay null;
    further columns are not carried.  An empty table gives no rows.  Sequence
    numbers are unique over all partitions, not consecutive.
    """
    bounded_batches(docs.sparkSession)
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    end = np.array([separator], np.uint32).tobytes()

    def shard(ids: list[int | None], packed: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        arrays = [np.frombuffer(p, np.uint32) for p in packed]
        rows = list(pack_shard(arrays, window))
        d = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in d], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(memoryview(packed[r[0]])[4 * r[1] : 4 * (r[1] + r[2])]) for r in rows], pa.int64()),
                pa.array([len(arrays[i]) for i in d], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        ), (rows[-1][3] + 1 if rows else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        packed: list[bytes] = []
        size = 0
        for batch in batches:
            with uncollected():
                new = [x + end for x in encoder.encode_packed(batch.column(1).to_pylist())]
            ids += batch.column(0).to_pylist()
            packed += new
            size += sum(map(len, new)) // 4
            if size >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                out, n = shard(ids, packed, base)
                yield out
                ids, packed, size, base = [], [], 0, base + n
        if packed:
            yield shard(ids, packed, base)[0]

    return got.mapInArrow(run, PIECES)
