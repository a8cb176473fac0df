"""What the operators of this package share: the scratch folder, row ids and byte-exact text helpers."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one made here in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="siltbed-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same."""
    return f"{scratch_root(spark)}/siltbed-{uuid.uuid4().hex}/{name}"


class _Scopes(threading.local):
    def __init__(self):
        self.paths: list[list[str]] = []


_SCOPES = _Scopes()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that written() wrote within it, but for outer ones. What is still used must have been written as such."""
    _SCOPES.paths.append([])
    try:
        yield
    finally:
        for name in _SCOPES.paths.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, compression: str = "zstd", outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, columns pruned on each read, no lineage left to rerun. It lasts as long as the scratch() around it, or the next outer one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _SCOPES.paths[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text falls on the fold that is never learned from; a null id is never held out nor learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class IdFilter:
    """One bit for each value of so many bits of an id's hash, whatever the number of ids: what has no id among them is seldom let pass. ids: one column, id."""

    def __init__(self, ids: DataFrame, bits: int):
        self.size = bits
        words = ids.select(self.place(F.col("id")).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
        self.words = np.zeros(1 << (bits - 5), np.uint32)
        got = words.toArrow()  # at most 2 ** (bits - 5) rows
        self.words[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)

    def place(self, doc_id: Column) -> Column:
        return F.xxhash64(doc_id).bitwiseAND((1 << self.size) - 1)

    def passes(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 5] >> (places & 31).astype(np.uint32) & 1).astype(bool)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet, whatever extra columns it brings."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
