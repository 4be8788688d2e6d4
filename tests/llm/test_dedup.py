"""Substring and near deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tipoff.llm import doubling, fmindex, minhash, queries
from tipoff.llm.regions import byte_symbols, regions, word_symbols
from tests.conftest import SF


def corpus(seed=1):
    """Copies, near copies, shared passages, periodic texts, short, empty and null ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = text(120)
    base = [text(rng.randint(60, 400)) for _ in range(12)]
    out = list(base) + base[:3] + [base[0]]
    out += [f"{text(40)} {shared}\n{text(50)}" for _ in range(6)] + [f"{shared} {text(30)}"]
    for b in base[3:8]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append("  ".join(v[: len(v) // 2]) + " " + " ".join(v[len(v) // 2 :]))
    out += ["In " * 600, "ab " * 300 + text(30) + " ab" * 300, "x" * 3000, ("ab" * 337 + "c") * 4, "".join(rng.choices("ab", k=3000)), "short", "", None, None, text(35), text(35) + " "]
    p = ("qrstuvwxyz" * 34)[:337]
    out.append(p * 4)
    return out


def brute_words(texts, width=35):
    raws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(r[i : i + width]) for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - width + 1):
            if seen[tuple(r[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(r), len(gone), b" ".join(w for i, w in enumerate(r) if i not in gone)))
    return out


def brute_bytes(texts, width=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        spans = int((mask[1:] & ~mask[:-1]).sum()) + int(len(mask) > 0 and mask[0])
        out.append((len(r), int(mask.sum()), spans, np.frombuffer(r, np.uint8)[~mask].tobytes()))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_removed string")


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_units, r.n_removed, bytes(r.kept)) for r in fmindex.dedup_words(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_words(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling.dedup_bytes(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_bytes(texts)))


def templated(seed=1, count=60):
    """Texts of rows of one template, in pairs that differ in a row; dashed lines, short
    periods, and two texts of equal ends and lengths with another middle."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    row, out = letters(150), []
    for _ in range(count // 2):
        rows = [row + f"{rng.randrange(10**8):08d}" for _ in range(15)]
        other = list(rows)
        other[rng.randrange(15)] = row + f"{rng.randrange(10**8):08d}"
        out += ["\n".join(rows), "\n".join(other)]
    for k in (1, 3, 40, 120, 399, 400, 401, 900):
        p = letters(k)
        out += [p * (2500 // k), letters(50) + p * (1700 // k + 1), (p * (1200 // k + 1) + letters(5)) * 2]
    for _ in range(6):
        out.append("\n".join("-" * rng.choice([70, 80, 500]) + rng.choice(["", letters(30)]) for _ in range(25)))
    side, end = ("-" * 80 + "\n") * 12, ("=" * 80 + "\n") * 12
    return out + [side + letters(100) + side, side + letters(100) + side, end + letters(100) + end]


@pytest.mark.parametrize("width,gram,base", [(400, 64, 100), (240, 48, 60)])
def test_templated_texts(spark, width, gram, base):
    texts = templated(width)
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling.dedup_bytes(frame(spark, texts), width, gram, base).collect()}
    assert got == dict(enumerate(brute_bytes(texts, width)))


def test_templated_words(spark):
    texts = [t.replace("-", "- ") for t in templated(7)] + ["a b " * 300, "a b c " * 90 + "d", "x " * 500]
    got = {r.doc_id: (r.n_units, r.n_removed, bytes(r.kept)) for r in fmindex.dedup_words(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_words(texts)))


def test_regions_are_shorter_than_two_windows():
    with np.errstate(over="ignore"):
        for text in templated(3):
            got = regions(byte_symbols(text.encode()), 400, 64)
            assert got.windows.max(initial=0) <= 337
            assert np.array_equal(got.start + got.windows, np.append(got.start[1:], max(0, len(text) - 399))[: len(got.start)])


@pytest.mark.parametrize("width", [150, 500])
def test_other_widths(spark, width):
    texts = corpus(3)
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling.dedup_bytes(frame(spark, texts), width, 32, 50).collect()}
    assert got == dict(enumerate(brute_bytes(texts, width)))


def test_hot_names_are_counted_by_window(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "HOT_KINDS", 1)
    texts = corpus(4)
    got = {r.doc_id: (r.n_units, r.n_removed, bytes(r.kept)) for r in fmindex.dedup_words(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_words(texts)))


def test_small_shards(spark, monkeypatch):
    texts = corpus(5)
    rows = []
    for i, t in enumerate(texts):
        s = word_symbols((t or "").encode())
        if len(s) >= 35:
            rows.append((0, 0, 1, str(i).encode(), 0, len(s) - 34, b" ".join((t or "").encode().split())))
    spans = fmindex.shard_spans(rows, 35)
    want = brute_words([texts[int(r[3])] for r in rows])
    for row, (n, removed, _) in zip(rows, want, strict=True):
        mask = np.zeros(n, bool)
        for *_, key, _, a, b in spans:
            if key == row[3]:
                mask[a : b + 34] = True
        assert mask.sum() == removed


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_ranks_by_batches(size):
    """Pairs of one row, of many, of one heavy row, over any batch borders."""
    rng = np.random.default_rng(5)
    left, right = np.sort(rng.integers(0, 40, 500)), rng.integers(0, 3, 500)
    order = np.lexsort((right, left))
    rows = [left[order], right[order], np.arange(500), np.arange(500, dtype=np.int32), rng.choice([1, 1, 1, 2], 500)]
    rows[0][100:300], rows[1][100:300] = rows[0][100], 0
    order = np.lexsort((rows[1], rows[0]))
    rows = [x[order] for x in rows]
    ranker, got = doubling.Ranker(1 << 40), {}
    for i in range(0, 500, size):
        out = ranker.take([x[i : i + size] for x in rows])
        assert ranker.held is None or len(ranker.held[0]) == 1
        got |= dict(zip(out.column(0).to_pylist(), out.column(3).to_pylist(), strict=True))
    pairs = list(zip(rows[0].tolist(), rows[1].tolist(), strict=True))
    weight = Counter()
    for p, n in zip(pairs, rows[4].tolist(), strict=True):
        weight[p] += n
    place = {p: i for i, p in enumerate(sorted(set(pairs)))}
    assert got == {r: (1 << 40) + place[p] for r, p in zip(rows[2].tolist(), pairs, strict=True) if weight[p] > 1}


def test_empty_table(spark):
    none = frame(spark, ["a"]).limit(0)
    assert fmindex.dedup_words(none).count() == 0 and doubling.dedup_bytes(none).count() == 0
    assert minhash.near_classes(none).count() == 0


def test_null_ids_and_repeated_rows(spark):
    t = corpus()[0]
    docs = spark.createDataFrame([(None, t), (7, t), (7, t), (None, None)], "doc_id long, text string")
    got = sorted(r.n_removed for r in fmindex.dedup_words(docs).collect())
    assert got == [0, *[len(t.split())] * 3]


def test_equal_windows_have_equal_names():
    rng = random.Random(9)
    with np.errstate(over="ignore"):
        passage = bytes(rng.choices(range(97, 123), k=700))
        names = []
        for _ in range(5):
            text = bytes(rng.choices(range(97, 123), k=300)) + passage + bytes(rng.choices(range(97, 123), k=300))
            got = regions(byte_symbols(text), 400, 64)
            names.append({n for n, s, w in zip(got.name, got.start, got.windows, strict=True) if s <= 600 and s + w > 300})
        assert set.intersection(*names)


def test_queries_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = [d.text for d in docs]
    five = {d.doc_id: (w[0], w[1], hashlib.sha256(w[2]).hexdigest()) for d, w in zip(docs, brute_words(texts), strict=True)}
    seven = {d.doc_id: (b[0], b[1], b[2], hashlib.sha256(b[3]).hexdigest()) for d, b in zip(docs, brute_bytes(texts), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_fm_dedup(spark, SF).collect()} == five
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()} == seven


def test_clean_texts_keep_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 500, "en", "s", 500), (2, "é" * 500 + "z", "en", "s", 501), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in doubling.clean_texts(docs).collect()}
    assert got[2].text == "z" and got[2].n_chars == 1 and got[1].text == "" and got[3].text is None and got[3].n_chars is None


# -- near duplicates -----------------------------------------------------------------


def test_similarity_is_weighted_jaccard():
    idf = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    a, b = (minhash.weighted(t, idf, 5) for t in ("a b c d e f", "a b c d e g"))
    assert minhash.similarity(a, b) == pytest.approx(1 / 3)
    assert minhash.similarity(a, a) == 1.0
    assert len(minhash.weighted("", idf, 5)[0]) == 0 and len(minhash.weighted("one two", idf, 5)[0]) == 1


def test_draws_agree_as_often_as_the_similarity():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    known = np.sort(word_symbols(" ".join(words[:2000]).encode()))
    idf = minhash.Idf(known, np.log1p(np.random.default_rng(1).random(2000) * 50 + 1), 8.0)
    found = []
    for _ in range(25):
        x = rng.choices(words, k=300)
        y = list(x)
        for k in rng.sample(range(300), 12):
            y[k] = "other"
        found += [minhash.weighted(" ".join(x), idf, 5), minhash.weighted(" ".join(y), idf, 5)]
    draws = minhash.Sampler(128).draw(found)
    assert (draws[7] == minhash.Sampler(128).draw(found[7:8])[0]).all()
    gaps = [np.mean(draws[i] == draws[i + 1]) - minhash.similarity(found[i], found[i + 1]) for i in range(0, 50, 2)]
    assert abs(np.mean(gaps)) < 0.03


def near_corpus():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(2000)]
    out = []
    for g in range(12):
        base = rng.choices(words, k=rng.randint(80, 300))
        out.append((g, " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            v = list(base)
            v[rng.randrange(len(v))] = "edit"
            out.append((g, " ".join(v)))
    out += [(100 + i, " ".join(rng.choices(words, k=60))) for i in range(30)]
    out += [(200, "same text here of six words"), (200, "same text here of six words"), (201, ""), (201, None), (202, "tiny")]
    return out


def test_near_classes_find_the_groups(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, (_, t) in enumerate(rows)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    first = {}
    for i, (g, _) in enumerate(rows):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, (g, _) in enumerate(rows)}


def test_keep_one_row_of_each_class(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (1, "z")], "doc_id long, text string")
    kept = minhash.keep_one(minhash.near_classes(docs))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "q r s t u v"), (1, "z"), (5, "a b c d e f")]


def test_cells_link_components_once():
    idf = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    same = minhash.weighted("a b c d e f g h", idf, 5)
    other = minhash.weighted("q r s t u v w x", idf, 5)
    rows = [(bytes([i // 2]), i % 2 == 0, True, same if i < 40 else other) for i in range(60)]
    links = minhash.cell_links(rows, 0.8)
    assert len(links) == 19 + 9  # components of two rows each become two
    assert minhash.cell_links([], 0.8) == [] and minhash.cell_links(rows[1:2], 0.8) == []


def test_cell_similarities_are_those_of_pairs():
    rng = random.Random(6)
    idf = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 2.5)
    found = [minhash.weighted(" ".join(rng.choices("abc", k=rng.randint(1, 60))), idf, 2) for _ in range(40)]
    index = minhash.Members(found[10:])
    for f in found:
        assert index.similar(f).tolist() == [minhash.similarity(f, g) for g in found[10:]]


def test_components_of_a_long_chain(spark):
    from tipoff.llm.common import Workspace

    keys = [i.to_bytes(2, "big") for i in random.Random(2).sample(range(60000), 80)]
    links = spark.createDataFrame([(bytearray(min(a, b)), bytearray(max(a, b))) for a, b in zip(keys, keys[1:], strict=False)], "u binary, v binary")
    got = minhash.components(links, Workspace(spark, "test"))
    assert {bytes(r.root) for r in got.collect()} == {min(keys)} and got.count() == 80


def star(n, seed):
    """A text and n copies, each with a stretch of its own replaced: near to the text, seldom to each other."""
    rng = random.Random(seed)
    base = [f"star{seed}word{i}" for i in range(400)]
    out = [" ".join(base)]
    for _ in range(n):
        v, at = list(base), rng.randrange(370)
        v[at : at + 30] = rng.choices(base, k=30)
        out.append(" ".join(v))
    return out


def brute_classes(texts, idf):
    """Smallest position of each text's component, by all pairs."""
    found = [minhash.weighted(t, idf, 5) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j) and minhash.similarity(found[i], found[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("params", [minhash.Params(), minhash.Params(member_block=3000, asker_block=2000)])
def test_stars_are_whole(spark, params):
    """Groups that hang together by one text only; small blocks don't change the classes."""
    texts = [t for n, seed in ((20, 1), (200, 2)) for t in star(n, seed)]
    random.Random(4).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = minhash.inverse_frequencies(docs.selectExpr("text", "1L as m"), params)
    want = brute_classes(texts, idf)
    assert len(set(want)) == 2
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs, params).collect()}
    assert got == dict(enumerate(want))


def test_two_thousand_variants(spark):
    texts = star(2000, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.class_id for r in minhash.near_classes(docs).collect()} == {0}


def test_query_finds_what_all_pairs_find(spark):
    """Classes of the query equal the components of all pairs at 0.8, but for links that no band shares."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    idf = minhash.inverse_frequencies(docs.selectExpr("coalesce(text, '') as text", "1L as m"), minhash.Params())
    position = brute_classes([r.text or "" for r in rows], idf)
    equal = {}
    for i, r in enumerate(rows):  # texts without words have no similarity, but are equal
        equal.setdefault(r.text or "", i)
    want = {r.doc_id: rows[position[equal[r.text or ""]]].doc_id for r in rows}
    got = {r.doc_id: r.class_id for r in queries.op2_minhash(spark, SF).collect()}
    alike = sum(want[d] == got[d] for d in want)
    assert alike >= 0.99 * len(want)
