"""From raw documents to packed sequences: classify, apply rules, drop near copies, mix sources, pack.

Each stage works on all that the one before kept and returns the columns of documents, the last the pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import minhash_dedup, packing, quality_classifier, quality_rules, source_mixing
from siltbed.llm.common import scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, learned from the labels outside its held-out fold."""
    model = quality_classifier.fit(docs, _labels(spark, sf_dir), ~quality_classifier.fold(F.col("doc_id")))
    return quality_classifier.with_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs fitted on the labels of what came in."""
    ratios = [f"r_{rule}" for rule in quality_rules.GRID]
    stats = written(quality_rules.with_stats(docs.select(*COLUMNS)).select(*COLUMNS, "digest", "base_failed", *ratios), "stats")
    cutoffs = quality_rules.fit_cutoffs(stats.select("doc_id", "digest", "lang", "base_failed", *ratios), _labels(spark, sf_dir))
    return quality_rules.with_verdict(stats, cutoffs).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and of its rows one, that of the least digest of all its columns. Rows without an id stay."""
    found = written(minhash_dedup.near_duplicates(docs), "found")
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    twice = written(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "twice")
    again = left.join(twice, "doc_id", "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.xxhash64(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return left.join(twice, "doc_id", "left_anti").unionByName(one).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target takes."""
    _, cuts = source_mixing.fit(docs)
    out = source_mixing.with_copies(docs.select(*COLUMNS), cuts, source_mixing.uniform_of(F.col("doc_id"), F.col("text")), source_mixing.size_of(F.col("text")))
    return out.where("n_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, their ids digested."""
    return packing.digested(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("minhash near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against their operators instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes when its result is written
            docs = written(stage(spark, docs, sf_dir), "stage", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
