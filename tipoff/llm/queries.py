"""Contract queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import bpe, classifier, decontaminate, doubling, fmindex, lexical, media, minhash, packing, phrases, rules, rules_sql, text_sql, tokencount, warc
from tipoff.llm.common import map_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = bpe.load(path)
        ids, decoded = [], []
        for x in batch.column(2).to_pylist():
            ids.append(hashlib.sha256(x).hexdigest())
            decoded.append(hashlib.sha256(table.decode(array("I", x).tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(encoded, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = minhash.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classed.select("doc_id", "class_id", "class_rows", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda r: r.select("key", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return fmindex.dedup_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=35, finish=digest)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda r: r.select("key", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return doubling.dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=400, finish=digest)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return classifier.classify(docs, labels).select("doc_id", "quality_score", "text_score", "meta_score", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_audio(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, bench, window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_fm_dedup": op5_fm_dedup,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_telephony": op10_telephony,
    "op11_decontamination": op11_decontamination,
    "op12_lexical_search": op12_lexical_search,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p group by d)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(('0x' || substr(p.d, cast(k // 4 * 5 + 1 as bigint), 5))::int >> cast(15 - k % 4 * 5 as int) & 31 as bigint) + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p join f on p.d = f.d
""",
    "op4_quality_rules": rules_sql.SQL,
    "op5_fm_dedup": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, i, array_to_string(w[i : i + 34], ' ') as t from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
t as (select t from s group by t having count(*) > 1),
x as (select distinct r, i + k as i from s join t using (t), (select unnest(range(0, 35)) as k)),
g as (select r, list(i) as gone, count(*) as n from x group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
       sha256(array_to_string(case when n is null then w else list_filter(w, lambda v, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join g using (r)
""",
    "op11_decontamination": text_sql.DECONTAMINATION,
    "op12_lexical_search": text_sql.SEARCH,
    "op13_phrases": text_sql.PHRASES,
}
