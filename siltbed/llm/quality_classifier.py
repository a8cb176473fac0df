"""Quality scores from random-indexing word vectors and a two-layer network.

Words are runs of letters, of digits, or of other marks, hashed to BUCKETS places. A place has a sparse random index
vector; its context vector is the sum of the index vectors of its neighbours, two on each side, over the learning
texts. A word's vector is its index vector plus its unit context vector. A document pools its words' vectors to their
mean and deviation, beside its length, its share of distinct words and of words that repeat the one before. A network of one hidden layer, in numpy, turns
that into a logit, and a temperature fitted on rows that it did not learn from makes it a probability.

The model is fitted on at most SAMPLE labelled rows, those lowest by a hash of their id; the bound holds at any size of
the input. Scoring reads each whole text once and shuffles nothing.

Defined results: null and empty texts have no words and get the network's score of an empty document; without labels of
both kinds every document gets the share of good labels, or 1 without any label; a document labelled twice counts as
bad if any label says so; rows with a null doc_id are scored but teach nothing; other columns pass through
untouched, but for columns of the result's names, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.common import documents, held_out

SAMPLE = 6000
BUCKETS, DIMENSIONS, NONZERO, REACH = 8192, 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-3
#: Tasks that sum context vectors; each sends one table to the driver.
TASKS = 8
THRESHOLD = 0.7
GROUP, SLICE = 64, 4_000_000
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


def index_vectors() -> np.ndarray:
    """The sparse random vectors of all places."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] = 1 - 2 * (k % 2)
    return out


def places(text: bytes) -> np.ndarray:
    """The place of each word of a text."""
    words = _WORD.findall(text)
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


def grouped(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The places of some texts at a time."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    held, size = [], 0
    for x in texts:
        raw = x.as_py()
        held.append(places(raw))
        size += len(raw)
        if len(held) == GROUP or size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def pooled(docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of each document's word vectors, its length, and how much its words repeat."""
    n = np.array([len(x) for x in docs])
    doc = np.repeat(np.arange(len(docs)), n)
    counts = np.bincount(doc * BUCKETS + (np.concatenate(docs) if docs else np.zeros(0, np.int64)), minlength=len(docs) * BUCKETS).reshape(len(docs), BUCKETS)
    share = (counts / np.maximum(n, 1)[:, None]).astype(np.float32)
    mean, square = share @ vectors, share @ (vectors * vectors)
    distinct = (counts > 0).sum(1) / np.maximum(n, 1)
    again = np.array([float((x[1:] == x[:-1]).mean()) if len(x) > 1 else 0.0 for x in docs])
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n)[:, None] / 8, distinct[:, None], (share * share).sum(1, keepdims=True), again[:, None]], 1).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """A hidden layer of rectified units and one output, on standardised input."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((x - self.mean) / self.scale).clip(-8, 8) @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """The network, learned from four fifths of the rows, its temperature fitted on the last fifth."""
    rng = np.random.default_rng(5)
    last = np.arange(len(y)) % 5 == 4
    net = Network(x[~last].mean(0), x[~last].std(0) + 1e-3)
    net.layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    z, t = ((x[~last] - net.mean) / net.scale).clip(-8, 8), y[~last]
    m, v = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = net.layers
        h = np.maximum(z @ w1 + b1, 0)
        error = (_sigmoid(h @ w2 + b2) - t) / len(t)
        back = np.outer(error, w2) * (h > 0)
        grads = [z.T @ back + DECAY * w1, back.sum(0), h.T @ error + DECAY * w2, np.array([error.sum()])]
        for p, g, a, b in zip(net.layers, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    logits, t = net.logits(x[last]), y[last]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.logaddexp(0, np.where(t == 1, -logits, logits) / k).mean() for k in grid] if last.any() else [0.0]
    net.temperature = float(grid[int(np.argmin(loss))]) if last.any() else 1.0
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    prior: float

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.network is None:
            return np.full(len(docs), self.prior)
        return self.network.probabilities(pooled(docs, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows where `learn`, a column of doc_id, holds. docs: doc_id, text."""
    chosen = labels.where("doc_id is not null and quality is not null").where(learn).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    # At most `sample` rows, whatever the input: small enough to send to every executor.
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in chosen.collect()], "doc_id bigint, y double")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(TASKS, "doc_id")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        for batch in batches:
            for group in grouped(batch.column("text")):
                for reach in range(1, REACH + 1):
                    a = np.concatenate([x[:-reach] for x in group])
                    b = np.concatenate([x[reach:] for x in group])
                    for d in range(DIMENSIONS):
                        total[:, d] += np.bincount(a, index[b, d], BUCKETS).astype(np.int64) + np.bincount(b, index[a, d], BUCKETS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((BUCKETS, DIMENSIONS))
    for r in rows.select("text").mapInArrow(contexts, "sums binary").toLocalIterator():
        total += np.frombuffer(bytes(r.sums), "<i8").reshape(BUCKETS, DIMENSIONS)
    length = np.sqrt((total * total).sum(1, keepdims=True))
    vectors = (index_vectors() + total / np.maximum(length, 1e-9)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([pooled(g, vectors) for g in grouped(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = sorted(rows.mapInArrow(features, "doc_id bigint, y double, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([float(r.y == 1) for r in got])
    if len(set(y.tolist())) < 2:
        return Model(vectors, None, float(y.mean()) if len(y) else 1.0)
    return Model(vectors, train(np.stack([np.frombuffer(bytes(r.x)) for r in got]), y), float(y.mean()))


def with_quality(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default), with score and predicted."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    name = text

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(model.scores(g) for g in grouped(batch.column(name)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(score, schema)


def fold(doc_id: Column) -> Column:
    return held_out(doc_id, 4, 2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from three quarters of the labels."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold(F.col("doc_id")))
    rows = docs.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "text")
    return with_quality(rows, model, keep=["doc_id", "held_out"])
