"""Language by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. Three letters in a row are bound into one
vector: the first letter's, rotated by two places, times the second's, rotated by one, times the third's; all else than
letters is one border symbol, so that beginnings and ends of words count. A text's bundle is the sum of its n-gram
vectors by the root of their counts. A language's prototype is the sum of the unit bundles of its learning texts, less
the mean of all prototypes; a text gets the language with the highest cosine.

N-grams are bundled GRAMS at a time, so memory does not grow with the letters of a text or the n-grams of a group of texts,
but for one row of bytes for each letter that a worker has met.

Bundles are integers and prototypes sum rounded integers, so no order of tasks changes a prediction. What reaches the
driver is one vector per language.

Defined results: `und` with score 0 for null texts, texts without a letter, and when nothing could be learned; null
languages and held-out rows teach nothing; ties go to the first language by name; repeated rows teach as often as they
occur; other columns pass through untouched, but for columns of the
result's names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.common import documents, held_out

DIMENSIONS, SEED = 1024, 7
#: Unit vectors are summed as integers of this scale.
SCALE = 1 << 20
#: Bytes of text, documents, and distinct n-grams that are handled at once.
SLICE, GROUP, GRAMS = 4_000_000, 128, 4096
UNKNOWN = "und"


class Bundler:
    """Bundles of texts; letters get their vectors when they first occur."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.place = np.full(0x110000, -1, np.int32)  # of a code point among the letters so far; 0: no letter
        self.rows = np.zeros((0, dimensions), np.int8)
        self._add([0])

    def _add(self, points: list[int]) -> None:
        new = np.stack([np.random.default_rng([self.seed, p]).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for p in points])
        self.place[points] = len(self.rows) + np.arange(len(points))
        self.rows = np.concatenate([self.rows, new])

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.place[points]
        if (out < 0).any():
            fresh = np.unique(points[out < 0]).tolist()
            self.place[[p for p in fresh if not chr(p).isalpha()]] = 0
            if letters := [p for p in fresh if chr(p).isalpha()]:
                self._add(letters)
            out = self.place[points]
        return out

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A row for each text; zeros where a text has no letter."""
        parts = [self._symbols(f" {x.lower()} ") for x in texts]
        doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        s = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])  # one border symbol at a time
        s, doc = s[keep].astype(np.int64), doc[keep]
        ok = (s[1:-1] > 0) & (doc[2:] == doc[:-2])
        a, b, c, doc = s[:-2][ok], s[1:-1][ok], s[2:][ok], doc[1:-1][ok]
        if not len(a):
            return np.zeros((len(texts), self.dimensions))
        n = len(self.rows)
        code = (a * n + b) * n + c
        if n < 160:
            seen = np.bincount(code, minlength=n**3) > 0
            grams = np.flatnonzero(seen)
            index = (np.cumsum(seen) - 1)[code]
        else:
            grams, index = np.unique(code, return_inverse=True)
        out = np.zeros((len(texts), self.dimensions), np.float64)
        order = np.argsort(index, kind="stable") if len(grams) > GRAMS else np.arange(len(index))
        index, doc = index[order], doc[order]
        for lo in range(0, len(grams), GRAMS):
            own = grams[lo : lo + GRAMS]
            vectors = np.roll(self.rows[own // (n * n)], 2, 1) * np.roll(self.rows[own // n % n], 1, 1) * self.rows[own % n]
            first, last = np.searchsorted(index, [lo, lo + len(own)]) if len(grams) > GRAMS else (0, len(index))
            counts = np.bincount(doc[first:last] * len(own) + index[first:last] - lo, minlength=len(texts) * len(own)).reshape(len(texts), len(own))
            out += np.rint(np.sqrt(counts) * 16).astype(np.float32) @ vectors.astype(np.float32)  # whole numbers, exact in both
        return out


_BUNDLERS: dict[tuple, Bundler] = {}


def bundled(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(how many texts, their bundles) by runs of bounded size."""
    own = _BUNDLERS.setdefault((DIMENSIONS, SEED), Bundler())
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = min(lo + GROUP, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right"))))
        yield hi - lo, own.bundles(texts.slice(lo, hi - lo).to_pylist())
        lo = hi


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def fit_prototypes(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages by name, centred unit prototypes) from rows of text and lang."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = np.array(batch.column("lang").to_pylist(), object), 0
            for n, v in bundled(batch.column("text")):
                units = np.rint(_units(v) * SCALE).astype(np.int64)
                for lang in set(langs[at : at + n].tolist()):
                    by[lang] = by.get(lang, 0) + units[langs[at : at + n] == lang].sum(0)
                at += n
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([v.tolist() for v in by.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    each = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(sums, "lang string, v array<bigint>")
    total = each.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in total})
    place, out = {x: k for k, x in enumerate(langs)}, np.zeros((len(langs), DIMENSIONS))
    for r in total:
        out[place[r.lang], r.i] = r.x
    if len(langs) > 1:
        out = _units(out)
        out = out - out.mean(0)
    return langs, _units(out)


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default), with lang_pred and score, the cosine to the prototype as a number from 0 to 1."""
    langs, prototypes = model
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    name, prototypes = text, prototypes.astype(np.float64)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, scores = [], []
            for n, v in bundled(batch.column(name)):
                known = v.any(1) & bool(langs)
                if not langs:
                    tags += [UNKNOWN] * n
                    scores += [0.0] * n
                    continue
                near = _units(v) @ prototypes.T
                best = near.argmax(1)
                tags += [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, (1 + near.max(1)) / 2, 0.0).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def fold(doc_id: Column) -> Column:
    return held_out(doc_id, 3, 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two thirds of the documents."""
    docs = documents(spark, sf_dir)
    model = fit_prototypes(docs.where("doc_id is not null").where(~fold(F.col("doc_id"))).select("lang", "text"))
    rows = docs.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "text")
    return with_language(rows, model, keep=["doc_id", "held_out"])
