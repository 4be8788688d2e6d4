"""Exact token counts at every prefix, by dynamic programming.

For byte-level BPE without normaliser the encoding of a piece's prefix of length
i ends in exactly one token t, and is the encoding of the prefix before t
followed by t.  So one pass over the piece finds, for every prefix, its last
token and its count: t is the token that ends at i and may stand after the last
token of the prefix before it.  Two tokens may stand side by side if, taken back
merge by merge from the latest, no merge across their border would have come
first.

A document's table has the count of every prefix, one number a character.  Within a
piece it is the piece's own table on top of the pieces before; a prefix that ends in
white space, in a contraction or in a special token is cut otherwise than the whole
text, and has its count from the piece that it would end in.  From the table follow
the total, the count of any prefix, and the longest prefix within a budget, by looking
up and bisecting, without encoding again.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.bpe import _BEYOND, byte_alphabet
from tipoff.llm.common import CACHE_ENTRIES, map_batches, text_or_empty, trimmed

_RUN = re.compile(r"\s\s|^\s|\s\Z|[\x1c-\x1f]")
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_SPACES = regex.compile(f"[{_WHITE}]+")
#: The cutting pattern's contractions of more than a letter.
_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounts:
    """Prefix tables for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.byte_of = to_byte
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {t: bytes(map(to_byte.__getitem__, t)) for t in vocab if t not in special}
        self.token = {raw[t]: i for t, i in vocab.items() if t in raw}
        self.longest = max(map(len, self.token))
        self.made_at = dict.fromkeys(self.token.values(), -1)
        self.parts_of: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            if new not in self.parts_of:
                self.parts_of[new], self.made_at[new] = pair, r
        self.special = sorted(special, key=len, reverse=True)
        self._special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None
        self._special_mark = os.path.commonprefix(list(self.special))  # what each special string begins with
        self._pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
        self._cutter = Tokenizer.from_file(path).pre_tokenizer
        self._beside: dict[int, bool] = {}
        self._tables: dict[bytes, array] = {}
        self._totals: dict[str, int] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Can the encoding have b right after a?"""
        if len(self._beside) > 4 * CACHE_ENTRIES:
            self._beside.clear()
        known = self._beside[a << 20 | b] = self._walk_back(a, b)
        return known

    def _walk_back(self, a: int, b: int) -> bool:
        before = len(self.rank) + 1  # merges across the border must not come before this
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < before:
                return False
            if self.made_at[a] > self.made_at[b]:
                before, a = self.made_at[a], self.parts_of[a][1]
            elif self.made_at[b] >= 0:
                # of equal merges the left one is applied first, so a tie is lost by b
                before, b = self.made_at[b] + 1, self.parts_of[b][0]
            else:
                return True

    def piece_table(self, piece: bytes) -> array:
        """Counts of the piece's prefixes of 1, 2, ... bytes."""
        table = self._tables.get(piece)
        if table is not None:
            return table
        n, token, beside, longest = len(piece), self.token.get, self._beside.get, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = token(piece[j:i])
                if t is None:
                    continue
                if j:
                    fits = beside(last[j] << 20 | t)
                    if fits is None:
                        fits = self.may_follow(last[j], t)
                    if not fits:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        table = array("I", count[1:])
        if n <= 1000:  # a longer one seldom comes back
            if len(self._tables) > CACHE_ENTRIES:
                self._tables = {}
            self._tables[piece] = table
        return table

    def pieces(self, text: str) -> list[bytes]:
        if _BEYOND.search(text):
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self._cutter.pre_tokenize_str(text)]
        return [p.encode() for p in self._pattern.findall(text)]

    def total(self, text: str) -> int:
        return sum(self.piece_table(p)[-1] for p in self.pieces(text))

    def parts(self, text: str) -> list[str]:
        """A text without special tokens, cut where no piece reaches across: before
        single spaces.  A text with other white space runs is one part."""
        if _RUN.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def runs(self, text: str) -> list[tuple[bool, str]]:
        if self._special_at is None or self._special_mark not in text:
            return [(False, text)]
        return [(x in self.special, x) for x in self._special_at.split(text) if x]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table."""
        n = 0
        for special, run in self.runs(text):
            if special:
                n += 1
            elif run:
                parts = self.parts(run)
                missing = set(parts).difference(self._totals)
                if missing:
                    if len(self._totals) + len(missing) > CACHE_ENTRIES:
                        self._totals = trimmed(self._totals)
                        missing = set(parts).difference(self._totals)
                    for p in missing:
                        self._totals[p] = self.total(p)
                n += sum(map(self._totals.__getitem__, parts))
                if len(parts) == 1 and len(run) > 1000:
                    self._totals.pop(run, None)
        return n

    def prefix_counts(self, text: str) -> array:
        """Tokens of text[:i] for every i, from 0 to the whole text."""
        counts = array("I", [0])
        tail, base = "", 0  # plain text since the last white space, and the tokens before it
        for special, run in self.runs(text):
            if special:
                before = counts[-1]
                # cut short it is plain text, and one with the plain text before it
                counts.extend(base + self.total(tail + run[:k]) for k in range(1, len(run)))
                counts.append(before + 1)
                tail, base = "", before + 1
            elif run:
                at = len(counts) - 1
                self._extend(counts, run)
                last = max((m.start() for m in _SPACES.finditer(run)), default=0)
                tail, base = run[last:], counts[at + last]
        return counts

    def _extend(self, counts: array, run: str) -> None:
        """Append the counts of the prefixes of a text without special tokens."""
        at = len(counts) - 1
        n = counts[-1]
        for piece in self.pieces(run):
            table, part = self.piece_table(piece), piece.decode()
            here = table if len(part) == len(piece) else [table[e - 1] for e in itertools.accumulate(len(c.encode()) for c in part)]
            first = len(counts)
            counts.extend(n + c for c in here)
            if part in _CONTRACTIONS:  # without its last letter, an apostrophe and a letter
                counts[first + 1] = n + self.total(part[0]) + self.total(part[1])
            n += table[-1]
        for m in _SPACES.finditer(run):  # at the end of a prefix, white space is one piece
            if m.end() - m.start() > 1:
                table, before, e = self.piece_table(m[0].encode()), counts[at + m.start()], 0
                for k, c in enumerate(m[0], at + m.start() + 1):
                    e += len(c.encode())
                    counts[k] = before + table[e - 1]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self.prefix_counts(text))


class PrefixTable:
    """Counts at every prefix of one text; positions are characters."""

    def __init__(self, counts: array) -> None:
        self.counts = np.frombuffer(counts, np.uint32)
        # a longer prefix may have fewer tokens: the least of any prefix from here on
        self._least = np.minimum.accumulate(self.counts[::-1])[::-1]
        self.total = int(self.counts[-1])

    def at(self, i: int) -> int:
        """Tokens of the first i characters."""
        return int(self.counts[max(0, min(i, len(self.counts) - 1))])

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return max(0, int(np.searchsorted(self._least, budget, "right")) - 1)


@functools.lru_cache(maxsize=4)
def load(path: str) -> PrefixCounts:
    return PrefixCounts(path)


COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts; null texts are empty.

    Row by row: repeated rows, null ids and further columns (not carried) have no
    effect.  No shuffle.
    """
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = load(path)
        n = [counts.count(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(got, run, COUNTED)


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored tables: (doc_id, counts), counts[i] being the tokens of the first i characters.

    Null and empty texts have the table [0]; repeated rows and null ids have one each;
    further columns are not carried; an empty table gives no rows.
    """
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tables = [load(path).prefix_counts(t) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
        flat = np.concatenate([np.frombuffer(t, np.uint32) for t in tables]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "counts"])

    return map_batches(got, run, "doc_id long, counts array<int>")


def within_budget(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_tokens, fits): from stored tables, how many characters fit the budget."""
    fits = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i).otherwise(0)))
    return tables.select("doc_id", F.element_at("counts", -1).cast("long").alias("n_tokens"), fits.alias("fits"))


def truncate(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with each text cut to its longest prefix of at most budget tokens.

    Null texts become empty; a negative budget leaves nothing; repeated rows and null
    ids are cut each; further columns are not carried; an empty table gives no rows.
    """
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[: load(path).table(t).longest_within(budget)] for t in texts], pa.string())], names=["doc_id", "text"])

    return map_batches(got, run, "doc_id long, text string")
