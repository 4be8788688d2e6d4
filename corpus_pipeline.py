"""A corpus from raw documents to packed sequences, in five stages.

Every stage is written as Parquet to the shared folder and read again, so each
works on all that its predecessor kept and a lost executor costs one stage's tasks.

In all stages null texts count as empty, texts are taken whole however long, repeated
rows are treated alike (but for near-dedup, which keeps one of them), null ids and
further columns, whatever their names, are carried, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tipoff.llm import classifier, doubling, minhash, packing, rules
from tipoff.llm.common import Workspace, opened, release
from tipoff.llm.queries import tokenizer

#: Bytes of a repeated passage: what 50 words of prose have at least, short words included.
PASSAGE_BYTES = 240

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage: Stage) -> Stage:
    """The stage with all further columns under names that no operator uses."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"carried_{i}__" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        got = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return got.withColumnsRenamed({v: k for k, v in aside.items()})

    return run_stage


@carrying
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; all, where no labels are."""
    return classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select(*docs.columns)


@carrying
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules (null and empty texts don't) and the divergence
    from their language."""
    return rules.measure(docs).filter("kept").select(*docs.columns)


@carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: of equal ids any one."""
    return minhash.keep_one(minhash.near_classes(docs)).select(*docs.columns)


@carrying
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``PASSAGE_BYTES`` bytes that also start elsewhere;
    a text may become empty, a null one stays null."""
    return doubling.clean_texts(docs, width=PASSAGE_BYTES, gram=48, base=60)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; an empty text is a separator."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packed),
]

#: Co-training, sampling and retrieval have no SQL form; tests compare the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        others = opened()  # our own, and those of results that are not ours
        docs = work.put(stage(spark, docs, sf_dir), f"stage_{i}")
        release(keep=others)  # what the stage needed is no longer read
        if i:
            work.drop(f"stage_{i - 1}")
    return docs
