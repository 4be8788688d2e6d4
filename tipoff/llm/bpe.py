"""BPE encoding and decoding through a pair occurrence index.

A block of the distinct pieces of a partition is laid out as one row of symbols.
An index maps every pair that some merge knows to all its positions in that row.
The ranks that occur are taken in ascending order from a heap; a merge is applied
at all positions of its pair, and only the lists of the pairs beside those
positions change.  Work is in proportion to the merges applied, not to
vocabulary times text.

Texts reach the index as distinct pieces only: a document is cut into chunks at
white space, a chunk into the pieces of the tokenizer file's pattern, and chunks
seen before come from a bounded cache.  Chunks with characters past U+024F are
normalised and cut by the tokenizer library itself, so that its Unicode tables
count, not Python's.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import map_batches, text_or_empty, trimmed

_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: White space to the tokenizer library; Python's split() would add U+001C to U+001F.
_SPACE = re.compile("[\\t-\\r \x85\xa0  -     　]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBpe:
    """A tokenizer file (``tokenizers`` JSON, byte level, optional word-end suffix)."""

    #: Chunks, and pieces, that a worker keeps.
    entries = 400_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.inner = [vocab.get(alphabet[b], -1) for b in range(256)]
        self.last = [vocab.get(alphabet[b] + self.suffix, -1) for b in range(256)]
        self.byte_of = {c: b for b, c in alphabet.items()}
        self.rank: dict[int, int] = {}  # left << 20 | right -> rank
        self.pair_of: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if self.rank.setdefault(vocab[a] << 20 | vocab[b], r) == r:
                self.pair_of[r] = (vocab[a], vocab[b], vocab[a + b])
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        library = Tokenizer.from_file(path)
        self._normalizer, self._cutter = library.normalizer, library.pre_tokenizer
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._special_mark = os.path.commonprefix(list(self.special))  # what each special string begins with
        self._pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._pieces: dict[bytes, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    # -- cutting -----------------------------------------------------------
    def pieces(self, chunk: str) -> list[bytes]:
        """The pieces of a chunk without white space, in UTF-8."""
        if _BEYOND.search(chunk):
            text = self._normalizer.normalize_str(chunk) if self._normalizer else chunk
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self._cutter.pre_tokenize_str(text)]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        return [p.encode() for p in self._pattern.findall(chunk.lower() if self.lower else chunk)]

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, string) runs of a text."""
        if self._special_at is None or self._special_mark not in text:
            return [(False, text)]
        return [(x in self.special, x) for x in self._special_at.split(text) if x]

    # -- the index ---------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: ranks ascending over the pair index of all pieces."""
        sym: list[int] = []
        starts: list[int] = []
        nxt: list[int] = []
        for p in pieces:
            start = len(sym)
            starts.append(start)
            if p:
                sym.extend(map(self.inner.__getitem__, p))
                sym[-1] = self.last[p[-1]]
                nxt.extend(range(start + 1, len(sym)))
                nxt.append(-1)
        prv = list(range(-1, len(sym) - 1))
        for start in starts:
            if start < len(prv):
                prv[start] = -1
        known, index = self.rank.get, {}
        find = index.get
        for i, (a, b, j) in enumerate(zip(sym, sym[1:], nxt, strict=False)):
            if j >= 0 and (r := known(a << 20 | b)) is not None:
                if (at := find(r)) is None:
                    index[r] = [i]
                else:
                    at.append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            a, b, new = self.pair_of[r]
            at.sort()
            lowest = r
            for k, i in enumerate(at):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # the pair was used by its left neighbour
                sym[i], sym[j] = new, -1
                nxt[i] = after = nxt[j]
                before = prv[i]
                if after >= 0:
                    prv[after] = i
                    if (q := known(new << 20 | sym[after])) is not None:
                        if (to := find(q)) is None:
                            index[q] = [i]
                            heapq.heappush(heap, q)
                        else:
                            to.append(i)
                        if q < lowest:
                            lowest = q
                if before >= 0 and (q := known(sym[before] << 20 | new)) is not None:
                    if (to := find(q)) is None:
                        index[q] = [before]
                        heapq.heappush(heap, q)
                    else:
                        to.append(before)
                    if q < lowest:
                        lowest = q
                if lowest < r:  # a lower rank has become active: it goes first
                    index.setdefault(r, []).extend(at[k + 1 :])
                    heapq.heappush(heap, r)
                    break
        return [[x for x in sym[start : start + len(p)] if x >= 0] for start, p in zip(starts, pieces, strict=True)]

    # -- documents ---------------------------------------------------------
    def _learn(self, chunks: set[str]) -> None:
        if len(self._pieces) > self.entries:
            self._pieces = {}
        cut = {c: self.pieces(c) for c in chunks}
        new = list({p for ps in cut.values() for p in ps if p not in self._pieces})
        known = self._pieces
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            known[p] = array("I", ids).tobytes()
        for c, ps in cut.items():
            self._chunks[c] = known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers.

        Chunks are looked up for a block of texts; those that the cache lacks are
        learned together, so that the index spans the block's new pieces.
        """
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            block, gaps, missing, size = [], [], set(), 0
            while i < len(texts) and (not block or size < 400_000):
                runs = []
                for special, x in self.segments(texts[i]):
                    if special:
                        runs.append([array("I", [self.special[x]]).tobytes()])
                        continue
                    chunks = [y for y in _SPACE.split(x) if y] if any(c in x for c in _CONTROL) else x.split()
                    found = list(map(self._chunks.get, chunks))
                    if None in found:
                        at = [k for k, v in enumerate(found) if v is None]
                        new = [chunks[k] for k in at]
                        missing.update(new)
                        gaps.append((found, at, new))
                    runs.append(found)
                    size += len(chunks)
                block.append(runs)
                i += 1
            if missing:
                if len(self._chunks) + len(missing) > self.entries:
                    self._chunks = trimmed(self._chunks)
                self._learn(missing)
                for found, at, new in gaps:
                    for k, c in zip(at, new, strict=True):
                        found[k] = self._chunks[c]
            out += [b"".join(runs[0]) if len(runs) == 1 else b"".join(map(b"".join, runs)) for runs in block]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("I", x).tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def load(path: str) -> PairIndexBpe:
    """One table a worker process."""
    return PairIndexBpe(path)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: (doc_id, n_tokens, ids); ids little-endian unsigned 32-bit.

    Null and empty texts have no ids.  Rows stay rows: equal or repeated ids, null
    ids and further columns (not carried) have no effect.  No shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = load(path).encode_packed(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Decode the ids of ``encode``: (doc_id, n_tokens, ids, text).

    Null and empty ids give an empty text; an id that the file doesn't have is an
    error (ids come from the same file); repeated rows and null document ids are
    decoded each; further columns are not carried; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        texts = [bpe.decode(array("I", x or b"").tolist()) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return map_batches(encoded.select("doc_id", "n_tokens", "ids"), run, ENCODED + ", text string")
