"""WARC, rules, classifier, audio and the pipeline."""

import base64
import gzip
import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tipoff.llm import classifier, media, minhash, queries, rules, warc
from tipoff.llm.common import Workspace
from tests.conftest import SF
from tests.llm.test_dedup import brute_bytes, brute_classes

# -- WARC ------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = {}
    for r in rows:
        raw = (r.html or "").encode()
        f = first[r.html or ""]
        want[r.page_id] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == r.page_id else "revisit", None if f == r.page_id else f)
    assert {r.page_id: tuple(r)[1:] for r in queries.op3_warc(spark, SF).collect()} == want


def test_warc_edges(spark):
    rows = [(1, None, None), (2, "http://A.b.com:80/x y?q#f", ""), (3, "http://a.b.com/x", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (4, "http://a.b.com/x", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (None, "u", "same"), (9, "nonsense", "same"), (12, "http://é.example/ü", "x" * 50000), (5, "http://[broken", "q"), (5, "http://[broken", "q")]
    got = warc.round_trip(spark, pages(spark, rows)).collect()
    found = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert found == sorted([(1, 0, "response", None), (2, 0, "revisit", 1), (3, 20, "response", None), (4, 20, "revisit", 3), (-1, 4, "revisit", 9), (9, 4, "response", None), (12, 50000, "response", None), (5, 1, "response", None), (5, 1, "response", None)])
    assert warc.round_trip(spark, pages(spark, []).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(spark, pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), 3).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_point_lookups(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 5}", f"page {i}") for i in range(200)]
    index, manifest = warc.archive(pages(spark, rows))
    reader = warc.IndexReader(index)
    for url in ("http://h3.example.com/p2", "http://h0.example.com/p0"):
        assert sorted(c.page_id for c in reader.url(url)) == [i for i, u, _ in rows if u == url]
    assert reader.url("http://absent.example.com/") == []
    place = manifest.first()
    with open(place.file.removeprefix("file:"), "rb") as f:
        whole = gzip.decompress(f.read())
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == manifest.filter(manifest.file == place.file).count()


def test_keys_sort_by_reversed_host():
    assert warc.url_key("https://www.Example.com/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/" and warc.url_key(None) == "-"
    assert warc.capture_key("u", -5) < warc.capture_key("u", 3) < warc.capture_key("u", 10)


# -- rules -----------------------------------------------------------------------------


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_rules_match_brute_force(spark):
    extra = [("x", t) for t in (None, "", "a\x1cb c\x85d", "same line\nsame line\n\n \n", "a b c d e " * 9, "#*$%&|<> é", "w " * 9, "the cat " * 5)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").union(spark.createDataFrame(extra, "lang string, text string"))
    for r in rules.measure(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.text)
        assert not (r.kept and r.base_failed)


def test_distance_is_jensen_shannon():
    p, q = np.array([1, 0, 3]), np.array([2, 2, 0])
    m = (p / 4 + q / 4) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert rules.distance(p, q) == pytest.approx(math.sqrt((kl(p / 4) + kl(q / 4)) / 2))
    assert rules.distance(p, p) == 0 and rules.distance(p, np.zeros(3)) == 0


def test_references_cover_all_documents_that_pass_the_base_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = rules.references(docs)
    for i, lang in enumerate(rules.LANGS[:-1]):
        texts = [r.text for r in docs.filter((docs.lang == lang) & docs.text.isNotNull()).collect() if not brute_base(r.text)[-1]]
        assert refs[i][0].sum() == sum(map(len, texts)) and refs[i][1].sum() == sum(len(t.encode().split()) for t in texts)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [r for r in rules.measure(docs).collect() if r.n_words >= 100 and not r.base_failed]
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_classes_beyond_latin():
    got = dict(zip(rules.CLASSES, rules.class_histogram("aÉж٠ 　\n。\U0001f600́"), strict=True))
    assert got == {"lower": 1, "upper": 1, "other letter": 1, "digit": 1, "space": 2, "line break": 1, "punctuation": 1, "symbol": 1, "rest": 1}


def test_very_long_text_is_judged_whole(spark):
    text = " ".join(f"w{i}" for i in range(120_000)) + " the end the end the end"
    row = rules.measure(spark.createDataFrame([(text, "en")], "text string, lang string")).first()
    assert row.n_words == 120_006 and row.n_repeat_words == 0 and not row.base_failed


def test_rules_replace_like_named_columns(spark):
    docs = spark.createDataFrame([("a b", None, "old", 1)], "text string, lang string, kept string, n_words int")
    got = rules.measure(docs)
    assert got.columns[:2] == ["text", "lang"] and got.first().n_words == 2 and got.first().kept is False
    assert rules.measure(docs.limit(0)).count() == 0


# -- classifier ------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    model = classifier.train(docs, train, classifier.Params(labelled=400))
    rows = classifier.score(docs.join(test, "doc_id"), model).collect()
    right = np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in rows])
    assert right > 0.93
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.97


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None), (None, None, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert {r.quality_score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert {r.quality_score for r in classifier.classify(docs, one).collect()} == {1.0}
    assert classifier.classify(docs.limit(0), one).count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.7
    xt, xm = rng.normal(size=(400, 3)) + 3 * y[:, None], rng.normal(size=(400, 2)) + y[:, None]
    py = rng.random(400) < 0.7
    pt, pm = rng.normal(size=(400, 3)) + 3 * py[:, None], rng.normal(size=(400, 2)) + py[:, None]
    taken = []

    def surest(model, asked, had):
        out = []
        for a in asked:
            p = 1 / (1 + np.exp(-model[a.view].logit({"t": pt, "m": pm}[a.view])))
            p = p if a.label else 1 - p
            got = [i for i in np.argsort(-p, kind="stable").tolist() if p[i] >= a.least and i not in had[a.other()]][: a.most]
            taken.extend(got)
            out.append((got, pt[got], pm[got]))
        return out

    alone = classifier.co_train(xt[:80], xm[:80], y[:80].astype(float), None, classifier.Params())
    both = classifier.co_train(xt[:80], xm[:80], y[:80].astype(float), surest, classifier.Params(per_round=0.5, sure=0.8))
    assert len(taken) > 50
    assert not np.allclose(alone.meta.weights, both.meta.weights)
    accuracy = lambda m: np.mean((m.scores(xt[80:], xm[80:])[0] >= 0.5) == y[80:])
    assert accuracy(both) > 0.9


def test_surest_are_those_of_all_documents(spark):
    """Rounds take the top of all rows, equal texts once, none that is held out."""
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text or "", r.lang, r.source, r.n_chars) for r in docs.collect()]
    model = {"t": classifier.Linear(np.zeros(1), np.ones(1), np.linspace(-1, 1, len(classifier.text_view(""))), 3.0), "m": classifier.Linear(np.zeros(1), np.ones(1), np.linspace(-2, 2, len(classifier.meta_view("", "", "", 0))), 1.0)}
    hashes = [r.h for r in docs.selectExpr("xxhash64(coalesce(text, '')) as h").collect()]
    held = set(hashes[:20])
    asked = [classifier.Ask("t", 1.0, 30, 0.6), classifier.Ask("m", 0.0, 10, 0.6)]
    got = classifier.surest_of(docs.repartition(5), Workspace(spark, "test"))(model, asked, {"t": held, "m": held})
    for a, (found, ft, fm) in zip(asked, got, strict=True):
        view = [classifier.text_view(t) if a.view == "t" else classifier.meta_view(t, la, so, n) for t, la, so, n in rows]
        p = 1 / (1 + np.exp(-model[a.view].logit(np.stack(view))))
        p = np.round(p if a.label else 1 - p, 9)
        best = {}
        for h, x in zip(hashes, p.tolist(), strict=True):
            if x >= a.least and h not in held:
                best[h] = max(x, best.get(h, 0))
        want = sorted(best, key=lambda h: (-best[h], h))[: a.most]
        assert found == want and len(ft) == len(fm) == len(want)


def test_surety_is_measured():
    p, right = np.array([0.99, 0.9, 0.9, 0.8, 0.7]), np.array([True, True, True, True, False])
    assert classifier.surety(p, right, 0.8) == 0.8 and classifier.surety(p, right, 0.84) == 2.0
    assert classifier.surety(p[:0], right[:0], 0.5) == 2.0


def test_scores_replace_columns_and_repeat(spark):
    long = "many words of one kind " * 50_000
    docs = spark.createDataFrame([(1, long, "en", "s", 3, "old"), (1, long, "en", "s", 3, "old"), (2, "z", "de", "t", 1, "old")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == 3 and all(r.kept is True for r in got)


# -- audio -----------------------------------------------------------------------------


def test_law_tables():
    assert media.MU_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.A_TABLE[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    assert len(set(media.A_TABLE.tolist())) == 256 and len(set(media.MU_TABLE.tolist())) == 255


def plain_ima(data, block):
    out = []
    for s in range(0, len(data), block):
        part = data[s : s + block]
        value, index = int.from_bytes(part[:2], "little", signed=True), min(part[2], 88)
        out.append(value)
        for b in part[4:]:
            for code in (b & 15, b >> 4):
                step = media.IMA_STEPS[index]
                change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + media.IMA_INDEX[code & 7]))
                out.append(value)
    return out


def test_ima_blocks():
    data = np.random.default_rng(2).integers(0, 256, 64 * 9 + 20, dtype=np.uint8).tobytes()
    assert media.decode_ima(data, 64).tolist() == plain_ima(data, 64)
    x = (np.sin(np.arange(3000) / 20) * 8000).astype(np.int16)
    y = media.decode_ima(media.encode_ima(x, 256), 256)[: len(x)]
    assert np.abs(x[200:].astype(int) - y[200:]).mean() < 400


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100]
    assert media.resample(x, 8000, 8000).tolist() == x.tolist()
    assert media.resample(np.arange(10, dtype=np.int16) * 10, 10, 15).tolist()[:4] == [0, 6, 13, 20]


@pytest.mark.parametrize("rate, to", [(8000, 4000), (16000, 4000), (11025, 4000), (48000, 44100)])
def test_nothing_folds_back(rate, to):
    assert np.abs(media.low_pass_taps(rate, to)).sum() < 1 << 15  # sums of 16-bit samples fit 32 bits
    assert set(media.resample(np.full(5000, -32768, np.int16), rate, to).tolist()) == {-32768}
    at = np.arange(20_000) / rate
    low = (np.sin(2 * np.pi * at * to * 0.1) * 20_000).astype(np.int16)
    high = (np.sin(2 * np.pi * at * (to / 2 + (rate - to) / 4)) * 20_000).astype(np.int16)
    kept = media.resample(low, rate, to)
    assert len(kept) == (20_000 - 1) * to // rate + 1
    wanted = np.sin(2 * np.pi * np.arange(len(kept)) / to * to * 0.1) * 20_000
    assert np.abs(kept[100:-100] - wanted[100:-100]).max() < 1000
    if rate > 2 * to - 1:
        assert np.abs(media.resample(high, rate, to)[100:-100]).max() < 200
    short = media.resample(np.array([5, 6], np.int16), rate, to)
    assert 1 <= len(short) <= 2


def test_decode_column(spark):
    tone = (np.sin(np.arange(800) / 9) * 9000).astype("<i2")
    rows = [(1, media.wav(media.MU_LAW, 8000, bytes(range(256)))), (2, media.wav(media.A_LAW, 8000, bytes(range(256)))), (3, media.wav(media.IMA_ADPCM, 8000, media.encode_ima(tone, 128), 4, 128)), (4, media.wav(media.PCM, 16000, tone.tobytes(), 16)), (5, None), (6, b"junk")]
    frame = spark.createDataFrame([(i, bytearray(m) if m else None, "old") for i, m in rows], "id long, media binary, pcm string")
    got = {r.id: r for r in media.decode_column(frame, "media").collect()}
    assert len(got[1].pcm) == len(got[2].pcm) == 2 * 511 and len(got[4].pcm) == 1600
    assert got[5].pcm is None and got[6].media_error and abs(len(got[3].pcm) - 3200) < 300


def plain_wav(kind, payload):
    """A file laid out field by field."""
    code, rate, align, bits, count = {"ima": (17, 16000, 36, 4, len(payload) // 36 * 65), "alaw": (6, 8000, 1, 8, len(payload)), "ulaw": (7, 8000, 1, 8, len(payload))}[kind]
    extra = struct.pack("<HH", 2, 65) if kind == "ima" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", code, 1, rate, 16000 * 36 // 65 if kind == "ima" else 8000, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def plain_law(kind, b):
    """G.711 from the bits of one byte."""
    if kind == "ulaw":
        b ^= 255
        x = ((2 * (b & 15) + 33) * 2 ** (b >> 4 & 7) - 33) * 4
        return -x if b & 128 else x
    b ^= 0x55
    e, m = b >> 4 & 7, b & 15
    x = 16 * m + 8 if e == 0 else (16 * m + 264) * 2 ** (e - 1)
    return x if b & 128 else -x


def plain_low_pass(x, f):
    """Every f-th sample, each a weighted sum of its neighbours."""
    half = 8 * f
    shape = [(math.sin(math.pi * t / f) / (math.pi * t / f) if t else 1) * (1 + math.cos(math.pi * t / (half + 1))) for t in range(-half, half + 1)]
    taps = [round(s / sum(shape) * 16384) for s in shape]
    taps[half] += 16384 - sum(taps)
    wide = [x[0]] * half + x + [x[-1]] * half
    return [max(-32768, min(32767, (sum(a * b for a, b in zip(taps, wide[k : k + 2 * half + 1], strict=True)) + 8192) // 16384)) for k in range(0, len(x), f)]


def plain_feature(kind, payload):
    x = plain_low_pass(plain_ima(payload, 36), 4) if kind == "ima" else plain_low_pass([plain_law(kind, b) for b in payload], 2)
    rms = int((sum(v * v for v in x) // len(x)) ** 0.5)
    return f"{kind};n={len(x)};peak={max(map(abs, x))};rms={rms};zc={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))}"


def test_op10(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = set()
    for r in queries.op10_telephony(spark, SF).collect():
        raw = docs[r.doc_id]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        pick = zlib.crc32(payload) % 8
        kind = "ima" if pick == 0 else "alaw" if pick < 4 else "ulaw"
        seen.add(kind)
        whole = plain_wav(kind, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())
        if len(payload) < 20_000:
            assert r.feature == plain_feature(kind, payload)
    assert seen == {"ima", "alaw", "ulaw"}


def test_text_audio_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "é" * 300_000, "x"), (2, "é" * 300_000, "x")], "doc_id long, text string, media string")
    got = sorted(media.text_audio(docs).collect(), key=lambda r: r.n_bytes)
    assert [r.n_bytes for r in got] == [0, 0, 600_000, 600_000] and got[0].payload_bytes == 576
    assert got[0].media_sha256 == got[1].media_sha256 and got[2].feature == got[3].feature
    assert media.text_audio(docs.limit(0)).count() == 0


# -- the pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in got.select("doc_id").collect()} <= ids


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls, repeats, empty and long texts, clashing columns, no rows at all."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60_000))
    docs = whole.limit(60).selectExpr("*", "'mine' as kept", "'own' as n_removed", "1L as class_id")
    odd = [(None, None, None, None, None), (7001, None, "en", "s", None), (7002, "", "en", "s", 0), (7003, "", "en", "s", 0), (7004, long, "en", "s", len(long)), (7004, long, "en", "s", len(long))]
    rows = spark.createDataFrame([(*r, "mine", "own", 1) for r in odd], docs.schema)
    docs = docs.unionByName(rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "packing":
            assert got.columns == docs.columns, name
            assert {(r.kept, r.n_removed, r.class_id) for r in got.collect()} == {("mine", "own", 1)}, name
        else:
            assert sum(r.length for r in got.collect() if r.doc_id == 7002) == 1
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sum(r.doc_id == 7004 for r in kept) == 1 and sum(not r.text for r in kept) == 1
    cut = corpus_pipeline.suffix_dedup(spark, docs, SF).collect()
    assert sum(r.text is None for r in cut) == 2 and all(r.text == "" for r in cut if r.doc_id == 7004)


def test_pipeline_is_its_stages_by_plain_versions(spark):
    """What each stage keeps of the documents equals a plain computation of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = corpus_pipeline.quality_classifier(spark, docs, SF)
    model = classifier.train(docs, labels)
    params = classifier.Params()
    want = []
    for r in docs.collect():
        both, _, _ = model.scores(classifier.text_view(r.text or "")[None], classifier.meta_view(r.text or "", r.lang, r.source, r.n_chars)[None])
        if round(float(both[0]), 6) >= params.threshold:
            want.append(r.doc_id)
    assert ids(one) == sorted(want)
    two = corpus_pipeline.quality_rules(spark, one, SF)
    refs = {}
    rows = one.collect()
    for r in rows:
        if not brute_base(r.text)[-1]:
            lang = r.lang if r.lang in rules.LANGS else "other"
            c, w = refs.setdefault(lang, (np.zeros(len(rules.CLASSES)), np.zeros(200)))
            c += rules.class_histogram(r.text)
            h = rules.common_histogram(rules.word_hashes(r.text), rules.LANGS.index(lang))
            w[: len(h)] += h
    want = []
    for r in rows:
        lang = r.lang if r.lang in rules.LANGS else "other"
        n = len((r.text or "").encode().split())
        h = rules.common_histogram(rules.word_hashes(r.text or ""), rules.LANGS.index(lang))
        far = n >= 100 and (rules.distance(rules.class_histogram(r.text), refs[lang][0]) > rules.Rules.max_class_distance or rules.distance(h, refs[lang][1][: len(h)]) > rules.Rules.max_word_distance)
        if not brute_base(r.text)[-1] and not far:
            want.append(r.doc_id)
    assert ids(two) == sorted(want)
    three = corpus_pipeline.near_dedup(spark, two, SF)
    rows = sorted(two.collect(), key=lambda r: r.doc_id)
    idf = minhash.inverse_frequencies(two.selectExpr("coalesce(text, '') as text", "1L as m"), minhash.Params())
    first = brute_classes([r.text for r in rows], idf)
    assert len(set(ids(three)) ^ {rows[i].doc_id for i in set(first)}) <= 0.01 * len(rows)
    four = corpus_pipeline.suffix_dedup(spark, three, SF)
    texts = {r.doc_id: r.text for r in three.collect()}
    cut = brute_bytes(list(texts.values()), corpus_pipeline.PASSAGE_BYTES)
    want = {i: kept.decode("utf-8", "ignore") for i, (*_, kept) in zip(texts, cut, strict=True)}
    assert {r.doc_id: r.text for r in four.collect()} == want
    five = corpus_pipeline.packed(spark, four, SF)
    sums = {}
    for r in five.collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        total = r.doc_tokens
        assert 0 < r.length <= 2048 and r.start + r.length <= total
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sums == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_pipeline_runs(spark):
    other = minhash.near_classes(spark.read.parquet(f"{SF}/documents.parquet"))
    classes = sorted(other.select("doc_id", "class_id").collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(other.select("doc_id", "class_id").collect()) == classes  # its tables are still there
    assert rows and all(0 < r.length <= 2048 for r in rows)


def test_text_audio_gives_its_pcm(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    seen = set()
    for r in media.text_audio(docs).collect():
        raw = ("some words " * r.doc_id).encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        kind = r.feature.split(";")[0]
        seen.add(kind)
        x = plain_low_pass(plain_ima(payload, 36), 4) if kind == "ima" else plain_low_pass([plain_law(kind, b) for b in payload], 2)
        assert list(struct.unpack(f"<{len(r.pcm) // 2}h", r.pcm)) == x
    assert len(seen) >= 2
