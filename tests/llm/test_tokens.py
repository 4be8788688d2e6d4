"""BPE, token counts and packing against the library on hard texts."""

import hashlib
import json
import random
import zlib
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tipoff.llm import bpe, packing, queries, tokencount
from tests.conftest import SF

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = ["", " ", "\n\n", "a", "a  b\n c\t", "don't 'RE y's", "aaaa" * 200, "héé é Σας ΑΣ İstanbul ß", "日本語 テスト １２３ 😀😀 ٣", "x<|endoftext|>y<|startoftext|>", "ΑΣ <|endoftext|>", "a\x1cb\x85c　d", "In " * 400, "word,### (853) l'été ...", None]
texts = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'stre<|>.é")), max_size=60)


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("kind", [bpe.PairIndexBpe, packing.LibraryIds])
def test_ids_are_the_librarys(kind):
    mine, lib = kind(WORD), library(WORD)
    known = [t or "" for t in HARD]
    for _ in range(2):  # cold and from the cache
        assert mine.encode(known) == [lib.encode(t, add_special_tokens=False).ids for t in known]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_any_text(text):
    lib = library(WORD) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    want = lib.encode(text, add_special_tokens=False).ids
    assert bpe.load(WORD).encode([text]) == [want] == packing.load(WORD).encode([text])
    assert bpe.load(WORD).decode(want) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_counts_at_every_prefix(text):
    lib = library(BYTE) if not hasattr(test_counts_at_every_prefix, "lib") else test_counts_at_every_prefix.lib
    test_counts_at_every_prefix.lib = lib
    counts = tokencount.load(BYTE)
    want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    table = counts.table(text)
    assert [table.at(i) for i in range(len(text) + 1)] == want
    assert counts.count(text) == want[-1]
    for budget in (0, 1, 3, 10):
        assert table.longest_within(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe.PairIndexBpe, "entries", 3)
    mine, lib = bpe.PairIndexBpe(WORD), library(WORD)
    known = [t or "" for t in HARD]
    assert mine.encode(known) == [lib.encode(t, add_special_tokens=False).ids for t in known]


@pytest.mark.parametrize("path, kind", [(WORD, bpe.PairIndexBpe), (BYTE, tokencount.PrefixCounts)])
def test_special_strings_are_the_files(tmp_path, path, kind):
    spec = json.loads(Path(path).read_text())
    last = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    spec["added_tokens"] += [{"id": last + 1, "content": "[CUT]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    lib, mine = Tokenizer.from_file(str(other)), kind(str(other))
    for text in ("a[CUT]b", "[CUT]", "no [CUT here", "x <|endoftext|> [CUT][CUT] y"):
        want = lib.encode(text, add_special_tokens=False).ids
        assert (mine.count(text) == len(want)) if kind is tokencount.PrefixCounts else (mine.encode([text]) == [want])


def frame(spark, rows=None):
    rows = [(None if i == 3 else i % 12, t, i) for i, t in enumerate(HARD)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_encode_and_decode_frames(spark):
    lib = library(WORD)
    got = bpe.decode(bpe.encode(frame(spark), WORD), WORD).collect()
    want = sorted((t or "") for t in HARD)
    assert len(got) == len(HARD)
    assert sorted(array("I", r.ids).tolist() for r in got) == sorted(lib.encode(t, add_special_tokens=False).ids for t in want)
    assert all(r.text == lib.decode(array("I", r.ids).tolist(), skip_special_tokens=False) for r in got)
    assert bpe.encode(frame(spark, []), WORD).count() == 0


def test_count_frames(spark):
    lib = library(BYTE)
    got = tokencount.count_tokens(frame(spark), BYTE, limit=5).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for t in HARD)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    cut = tokencount.truncate(frame(spark), BYTE, 4).collect()
    assert all(len(lib.encode(r.text, add_special_tokens=False).ids) <= 4 for r in cut)
    tables = tokencount.prefix_tables(frame(spark), BYTE)
    want = sorted([len(lib.encode((t or "")[:i], add_special_tokens=False).ids) for i in range(len(t or "") + 1)] for t in HARD if len(t or "") < 500)
    assert sorted(r.counts for r in tables.collect() if len(r.counts) <= 500) == want
    fits = sorted(tokencount.within_budget(tables, 4).collect(), key=lambda r: (r.n_tokens, r.fits))
    assert sorted(r.fits for r in fits) == sorted(len(r.text) for r in cut)
    assert tokencount.prefix_tables(frame(spark, []), BYTE).count() == 0 and tokencount.truncate(frame(spark, []), BYTE, 4).count() == 0
    assert tokencount.prefix_tables(frame(spark, [(None, None, 1)]), BYTE).first() == (None, [0])
    assert {r.text for r in tokencount.truncate(frame(spark), BYTE, -1).collect()} == {""}


def test_prefix_table_of_a_long_text():
    lib = library(BYTE)
    rng = random.Random(1)
    parts = ["a", "the", "  ", " \n\n ", "'re", "we'll", "\t", "<|endoftext|>", "é", "12345", "!?", "\u3000", " can't", "x" * 30]
    text = "".join(rng.choices(parts, k=400_000))
    assert len(text) > 1_000_000
    table = tokencount.load(BYTE).table(text)
    assert table.total == len(lib.encode(text, add_special_tokens=False).ids)
    for i in rng.sample(range(40_000), 60):
        assert table.at(i) == len(lib.encode(text[:i], add_special_tokens=False).ids)
    for budget in rng.sample(range(20_000), 20):
        i = table.longest_within(budget)
        assert table.at(i) <= budget and (table.counts[i + 1 :] > budget).all()


def check_pieces(rows, want, window=2048):
    """Every id in one piece; sequences gapless; little padding."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for (doc, n), pieces in docs.items():
        ids = want[doc]
        assert n == len(ids)
        covered = np.zeros(n, int)
        for r in pieces:
            covered[r.start : r.start + r.length] += 1
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert (covered == 1).all()
    return sequences


def test_packing_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lib = library(WORD)
    want = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32) for r in docs.collect()}
    sequences = check_pieces(queries.op6_packing(spark, SF).collect(), want)
    assert len(sequences) <= sum(map(len, want.values())) // 2048 + docs.rdd.getNumPartitions()


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "the " * 5000), (4, "the cat"), (5, "the cat"), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lib = library(WORD)
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in rows}
    check_pieces(packing.pack(docs, WORD).collect(), want)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_a_seed_asks_until_its_window_is_full():
    """Many short documents: all of one topic are laid before any of the other."""
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(0, 40, 9) + 100 * (i % 2), 1).astype(np.uint32) for i in range(400)]
    docs = [np.append(d, 7 + 1000 * (i % 2)).astype(np.uint32)[1:] for i, d in enumerate(docs)]
    first = [d for d, _, _, sequence, _ in packing.pack_shard(docs, 500) if sequence == 0]
    terms = [set(d.tolist()) - {1} for d in docs]
    mixed = {i % 2 for i in first}
    assert len(first) == 50 and (mixed == {0} or any(terms[0] & terms[i] for i in first if i % 2))


def test_shards_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the cat sat " * 50) for i in range(60)], "doc_id long, text string").coalesce(1)
    lib = library(WORD)
    want = {i: np.array([*lib.encode("the cat sat " * 50, add_special_tokens=False).ids, 1], np.uint32) for i in range(60)}
    check_pieces(packing.pack(docs, WORD, window=64).collect(), want, 64)


def test_retrieval_prefers_like_documents():
    rng = np.random.default_rng(1)
    topics = [np.concatenate([rng.integers(100 * k, 100 * k + 40, 60)]).astype(np.uint32) for k in (0, 1, 0, 1, 0, 1)]
    index = packing.Bm25Shard(topics)
    used = np.array([True, *[False] * 5])
    assert set(index.neighbours(0, used, 2)) == {2, 4}


def test_neighbours_are_those_of_the_whole_query():
    rng = np.random.default_rng(6)
    # each ends with the separator, which is no term though it counts as a token
    docs = [np.append(rng.zipf(1.3, rng.integers(1, 200)).clip(1, 900) + 1, 1).astype(np.uint32) for _ in range(150)]
    index, used = packing.Bm25Shard(docs), rng.random(150) < 0.2
    counts = [dict(zip(*(x.tolist() for x in np.unique(d[:-1], return_counts=True)), strict=True)) for d in docs]
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in c for c in counts) for c in counts for t in c}
    for seed in range(150):
        scores = np.zeros(150)
        for i, c in enumerate(counts):
            for t in counts[seed].keys() & c.keys():
                scores[i] += np.log1p((150 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        scores[used] = 0
        got = index.neighbours(seed, used, 16)
        assert not used[got].any() and len(set(got)) == min(16, np.count_nonzero(scores))
        assert scores[got] == pytest.approx(np.sort(scores)[::-1][: len(got)], rel=1e-4)


def test_op1_and_op9_queries(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib, lib9 = library(WORD), library(BYTE)
    for r in queries.op1_bpe(spark, SF).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in queries.op9_token_counts(spark, SF).collect():
        assert r.n_tokens == len(lib9.encode(docs[r.doc_id], add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 1024)


def test_clashing_columns_do_not_matter(spark):
    docs = frame(spark).withColumn("ids", F.lit(1)).withColumn("start", F.lit(2)).withColumn("n_bytes", F.lit(3))
    assert bpe.encode(docs, WORD).columns == ["doc_id", "n_tokens", "ids"]
    assert tokencount.count_tokens(docs, BYTE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert packing.pack(docs, WORD).count() >= len(HARD)
