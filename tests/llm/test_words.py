"""Decontamination, lexical search and phrases against plain versions and odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tipoff.llm import decontaminate, lexical, phrases


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def some(seed, count=40, kinds=60, most=90):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeXYé0_", k=rng.randint(1, 3))) for _ in range(kinds)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", "\n", "\t", ", "]) for _ in range(n))
    return rng, text, [text(rng.randint(0, most)) for _ in range(count)]


# -- decontamination -------------------------------------------------------------------


def brute_hits(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    asked = {}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            asked.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(a) for a in asked}:
            for i in range(len(w) - size + 1):
                got = asked.get(tuple(w[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed,window,shingle", [(1, 10, 5), (2, 4, 3), (3, 5, 5), (4, 6, 4)])
def test_decontamination(spark, seed, window, shingle):
    rng, text, texts = some(seed, kinds=14)
    items = [(i, text(rng.randint(0, 25))) for i in range(12)] + [(20, "abc"), (21, ""), (22, None), (3, text(30)), (23, text(2))]
    texts += [f"{text(20)}{t or ''} {text(10)}{t or ''}" for _, t in items] + [None, "", "...", texts[0], items[0][1] * 30]
    docs = spark.createDataFrame([(i if i % 5 else None, i, t, "x") for i, t in enumerate(texts)], "doc_id long, row long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row: (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, bench, window, shingle).collect()}
    want = brute_hits(texts, items, window)
    assert got == {i: (n, h, f, len(f), h > 0) for i, (n, h, f) in enumerate(want)}


def test_benchmark_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    rng, text, texts = some(5, count=15, kinds=10)
    items = [(i, text(12)) for i in range(5)] + [(9, "a")]
    docs = spark.createDataFrame(list(enumerate(texts + [items[0][1]])), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), 6, 3).collect()}
    assert got == dict(enumerate(brute_hits(texts + [items[0][1]], items, 6)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.limit(0)
    bench = docs.withColumnRenamed("doc_id", "item_id")
    assert decontaminate.decontaminate(none, bench).count() == 0
    got = decontaminate.decontaminate(docs, bench.limit(0)).first()
    assert (got.n_words, got.n_hit, got["items"], got.contaminated) == (3, 0, [], False)
    assert lexical.rank(none, bench).count() == 0 and lexical.rank(docs, bench.limit(0)).count() == 0
    assert phrases.collocations(none.withColumn("lang", decontaminate.F.lit("en"))).count() == 0


# -- search ----------------------------------------------------------------------------


def brute_rank(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    docs = [(i, Counter(split(t)), len(split(t))) for i, t in rows if split(t)]
    n_docs, words = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(split(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_docs) // words
            s = sum(lexical.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out |= {(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 16_384), (2, 7), (3, 1)])
def test_search(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    rng, text, texts = some(seed, count=80)
    items = [(i, text(rng.randint(0, 20))) for i in range(15)] + [(None, text(5)), (3, text(4)), (30, None), (31, "zzz"), (32, "...")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[5]) for i in range(25)] + [(None, texts[6]), (200, None), (201, ""), (202, " . "), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in lexical.rank(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_rank(rows, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    rng, text, texts = some(9, count=50)
    items = [(i, text(15)) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in lexical.rank(docs, spark.createDataFrame(items, "item_id long, text string"), k=3).collect()}
    assert got == brute_rank(list(enumerate(texts)), items, 3)


# -- phrases ---------------------------------------------------------------------------


def brute_phrases(rows, longest, least, share, top):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *p), a in found.items():
        inside = any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= share * a and any(list(q[1 + j : 1 + j + len(p)]) == p for j in range(len(q) - len(p))) for q, b in found.items())
        if not inside:
            cuts = [(1_000_000 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[(lang, *p[:k])], f[(lang, *p[k:])]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, mine in out.items() for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)}


@pytest.mark.parametrize("seed,longest,shard,cells", [(1, 3, 6_000_000, 200_000), (2, 3, 300, 50), (3, 4, 1000, 200_000), (4, 2, 500, 1)])
def test_phrases(spark, monkeypatch, seed, longest, shard, cells):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "BATCH_CELLS", cells)
    rng, text, texts = some(seed, count=60, kinds=25, most=80)
    rows = [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("en", ""), ("xx", "a b"), ("en", "in a row " * 60), ("de", "a" * 700), ("en", "\t a\t\tb . ")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = {tuple(r) for r in phrases.collocations(docs, longest, 4, 50, 30).collect()}
    assert got == brute_phrases(rows, longest, 4, 50, 30)


def test_bitmaps_hold_positions():
    codes = np.array([1, 2, 0, 2, 1, 1, 2, 1, 2, 2, 0, 0, 1, 2], np.int32)
    maps = phrases.Bitmaps(codes, np.array([0, 11, 12]))
    node, place, bits = maps.of(np.array([0, 1]))
    at = [(int(n), int(p) * 8 + b) for n, p, x in zip(node, place, bits, strict=True) for b in range(8) if x >> b & 1]
    assert sorted(at) == sorted((c - 1, i) for i, c in enumerate(codes.tolist()) if c)
    parent, word, support, _ = maps.extend(node, place, bits)
    assert dict(zip(zip(parent.tolist(), word.tolist(), strict=True), support.tolist(), strict=True)) == {(0, 1): 4, (1, 0): 2, (0, 0): 1, (1, 1): 1}


def test_items_digest_is_of_sorted_strings(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "one"), (9, "two")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).first()
    assert got["items"] == ["10", "9"] and hashlib.sha256(b"10,9").hexdigest()
