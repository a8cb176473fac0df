"""Token counts through a digest cache.

A text's key is the SHA-256 of its content, beside a digest of the tokenizer's file and library version. Keys are joined to the counts stored in a
Parquet cache; runs of ASCII blanks are made one blank first if the tokenizer drops blanks, so that the count stays. Of the
keys that miss, one text each is encoded, and the new counts are appended to the cache. Digests are shuffled, texts never.

Defined results: a null text counts as empty (0 tokens, 0 bytes) and other columns, null or not, pass through; repeated
rows each get their own row; an empty table gives an empty result; a cache that holds a key twice counts it once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import IdFilter, documents, free_name, scratch_path, written

CACHE = "digest binary, tokenizer string, n_tokens bigint"
LIMIT = 2048
#: Bits, least and most, of the filter of ids whose texts are encoded, as a power of two: 16 for each id up to 16 MB.
LEAST_BITS, MOST_BITS = 16, 27


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def keeps_blanks(path: str) -> bool:
    """Whether this tokenizer's tokens carry blanks."""
    with open(path, encoding="utf-8") as f:
        return not json.load(f)["model"].get("end_of_word_suffix")


def content_digest(text: Column, exact: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(text if exact else F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest and n_tokens of what the cache holds for this version of the tokenizer, each digest once."""
    try:
        cache = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(keys: DataFrame, docs: DataFrame, path: str, cache_path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes one text of each digest that the cache lacks and appends its count. keys: digest and id of every row of docs.

    Which row stands for a digest, the one of the least id, is settled on digests alone; texts are encoded where they are
    read, if a filter of such ids lets them pass, and once per task. What it lets pass wrongly costs an encoding: one in
    fifteen up to ten million misses, more beyond, where at last each task encodes all its misses once."""
    spark, version, exact = docs.sparkSession, tokenizer_version(path), keeps_blanks(path)
    asked = keys.groupBy("digest").agg(F.min("id").alias("id")).join(read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti")
    asked = written(asked, "misses")
    n = asked.count()
    if not n:
        return
    wanted = IdFilter(asked.select("id"), min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltbed.llm.tokenizing import encoder

        done: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column("p").to_numpy())))
            keep = []
            digests = batch.column("digest").to_pylist()
            for x in digests:
                keep.append(x not in done)
                done.add(x)
            batch = batch.filter(pa.array(keep, pa.bool_()))
            _, ends = encoder(path).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.diff(ends, prepend=0).astype(np.int64))], names=["digest", "n_tokens"])

    own = docs.select(content_digest(docs[text], exact).alias("digest"), docs[text].alias("text"), wanted.place(docs[doc_id].cast("string")).alias("p"))
    found = own.mapInArrow(count, "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = found.join(asked.select("digest"), "digest", "left_semi").select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
    found.write.mode("append").option("compression", "zstd").parquet(cache_path)


def with_token_counts(docs: DataFrame, path: str, cache_path: str, text: str = "text", to: str = "n_tokens", doc_id: str = "doc_id") -> DataFrame:
    """docs without its text column, with the count of the whole text's tokens."""
    key, got = free_name(docs, "digest"), free_name(docs, to if to not in docs.columns else "counted")
    rows = written(docs.withColumn(key, content_digest(docs[text], keeps_blanks(path))).drop(text), "keys")
    count_misses(rows.select(F.col(key).alias("digest"), F.col(doc_id).cast("string").alias("id")), docs, path, cache_path, text, doc_id)
    # Written, so that the join may split the rows of a text that many documents share among tasks.
    stored = written(read_cache(docs.sparkSession, cache_path, tokenizer_version(path)), "counts").select(F.col("digest").alias(key), F.col("n_tokens").alias(got))
    return rows.join(stored, key, "left").drop(key).withColumnRenamed(got, to)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, counted into a new cache."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token_cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
