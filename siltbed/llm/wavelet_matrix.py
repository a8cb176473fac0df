"""Token ids as wavelet matrices: one compressed file per shard.

A file numbers the ids that occur in it and holds these numbers as bit-planes, highest bit first; each plane lists its bits after all ids
with a 0 in the plane above were moved, in order, before those with a 1. Planes are cut into blocks that are compressed
alone, with the count of ones before each block stored beside them, so that rank, select, access, counts and occurrence
lookups read only the blocks they touch. Decoding all ids undoes the moves from the lowest plane up.

A shard is one row of a Parquet table (binary column), so a file appears whole or not at all when an executor is lost.
Shards follow the ascending order of (doc_id, hash of the text), null ids first; a document never spans two shards.
Null and empty texts hold the end id alone. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.llm.common import documents, scratch_path

MAGIC = b"WVMX0001"
#: Bits of a block; ids of a shard at most, unless one document has more.
BLOCK = 1 << 16
SHARD_TOKENS = 1 << 22
END_ID = 2


def build(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of these ids; ends has where each document ends."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    used = np.flatnonzero(np.bincount(ids)) if n else np.zeros(0, np.int64)
    place = np.zeros(int(used[-1]) + 1 if n else 0, np.uint16 if len(used) <= 1 << 16 else np.uint32)
    place[used] = np.arange(len(used))
    planes, level = max(1, (len(used) - 1).bit_length()), place[ids]
    head, blocks = [], []
    for plane in range(planes - 1, -1, -1):
        bits = (level >> level.dtype.type(plane) & level.dtype.type(1)).astype(bool)
        raw = np.packbits(bits, bitorder="little")
        ones, lengths = [0], []
        for lo in range(0, n, BLOCK):
            lengths.append(len(blocks))
            blocks.append(pack(raw[lo // 8 : (lo + BLOCK) // 8].tobytes()))
            ones.append(ones[-1] + int(np.count_nonzero(bits[lo : lo + BLOCK])))
        head.append(np.array(ones, "<u4").tobytes() + np.array([len(blocks[i]) for i in lengths], "<u4").tobytes())
        level = np.concatenate([level.take(np.flatnonzero(~bits)), level.take(np.flatnonzero(bits))])  # faster than masks
    meta = pack(used.astype("<u4").tobytes()), pack(np.asarray(ends, "<i8").tobytes()), pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), pack(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    index = pack(b"".join(head))
    return MAGIC + struct.pack("<QQBIIIII", n, len(doc_ids), planes, *map(len, (*meta, index))) + b"".join((*meta, index, *blocks))


class WaveletMatrix:
    """A file, read block by block."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, docs, self.planes, *sizes = struct.unpack_from("<QQBIIIII", data, 8)
        at = 8 + struct.calcsize("<QQBIIIII")
        parts = []
        for size in sizes:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        self.used = np.frombuffer(parts[0], "<u4")
        self.ends = np.frombuffer(parts[1], "<i8")
        null = np.frombuffer(parts[3], np.uint8)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(parts[2], "<i8").tolist(), null.tolist(), strict=True)]
        count = -(-self.n // BLOCK)
        index = np.frombuffer(parts[4], "<u4").reshape(self.planes, 2 * count + 1).astype(np.int64)
        self.ones, lengths = index[:, : count + 1], index[:, count + 1 :].ravel()
        self.at = (at + np.cumsum(lengths) - lengths).reshape(self.planes, count)
        self.size = lengths.reshape(self.planes, count)
        self.zeros = self.n - self.ones[:, -1]
        self.data, self.kept = data, {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block."""
        if (plane, block) not in self.kept:
            at = self.at[plane, block]
            raw = zstandard.ZstdDecompressor().decompress(self.data[at : at + self.size[plane, block]], max_output_size=BLOCK // 8)
            self.kept[plane, block] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self.kept[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        return int(self.ones[plane, block]) + (int(np.count_nonzero(self._block(plane, block)[:rest])) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th bit (from 0) of this kind is."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.ones.shape[1]) * BLOCK, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        lo = block * BLOCK
        here = self._block(plane, block)[: self.n - lo]
        return lo + int(np.flatnonzero(here == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            out = out << 1 | bit
            i = int(self.zeros[p]) + self._rank1(p, i) if bit else i - self._rank1(p, i)
        return int(self.used[out])

    def _place(self, token: int) -> int | None:
        """The token's place among the ids that occur."""
        k = int(np.searchsorted(self.used, token))
        return k if k < len(self.used) and self.used[k] == token else None

    def _range(self, token: int | None, lo: int, hi: int) -> tuple[int, int]:
        if token is None:
            return 0, 0
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token occurs at positions lo to hi."""
        a, b = self._range(self._place(token), lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0)."""
        token = self._place(token)
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        """All positions of token, ascending."""
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        level = np.zeros(self.n, kind)
        unpack = zstandard.ZstdDecompressor()
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(unpack.decompress(self.data[a : a + s], max_output_size=BLOCK // 8) for a, s in zip(self.at[p].tolist(), self.size[p].tolist(), strict=True))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").astype(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bits)] = level[: self.zeros[p]]
            out[np.flatnonzero(bits)] = level[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            level = out
        return self.used[level].astype("<u4")


SHARDS = "part int, seq int, n_docs bigint, n_tokens bigint, file binary"


def write_shards(docs: DataFrame, tokenizer: str, to: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, most: int = SHARD_TOKENS) -> None:
    """Encodes docs in ascending order of their ids and writes them to the Parquet table `to`, a row for each shard's file."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from siltbed.llm.tokenizing import encoder, slices

        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            values = [[part], [seq], [len(names)], [len(ids)], [build(ids, ends, names)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_tokens", "file"])

        end = np.array([end_id], "<u4")
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                ids, ends = encoder(tokenizer).encode(texts)
                lo = 0
                for name, hi in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), ends.tolist(), strict=True):
                    own = np.concatenate([ids[lo:hi], end])
                    if held and size + len(own) > most:
                        yield row()
                        held, names, size, seq = [], [], 0, seq + 1
                    held.append(own)
                    names.append(name)
                    size += len(own)
                    lo = hi
                at += len(texts)
        if held:
            yield row()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(shard, SHARDS).write.option("compression", "none").parquet(to)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, shards): each document with its place in its shard, its ids as little-endian unsigned 32-bit integers; and for each shard the ids of all shards before it. Joined by part and seq they give a document's start; a caller drops the ids first, so that they do not move."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file")), strict=True):
                m = WaveletMatrix(file)
                raw, ends = m.ids().tobytes(), m.ends
                n = len(ends)
                starts = np.append(0, ends[:-1])
                own = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(m.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), own], names=["part", "seq", "doc_id", "start_here", "n_tokens", "ids"])

    # A running sum over one row per shard.
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("before"))
    rows = shards.select("part", "seq", "file").mapInArrow(read, "part int, seq int, doc_id bigint, start_here bigint, n_tokens bigint, ids binary")
    return rows, before


def op8_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as wavelet matrices, read back from the files, and digested."""
    import public_tokenizers

    path = scratch_path(spark, "shards")
    write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    rows, before = read_documents(spark, path)
    rows = rows.select("part", "seq", "doc_id", "start_here", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(before, ["part", "seq"]).select("doc_id", (F.col("start_here") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
