"""Language-model scores by a probabilistic suffix tree of words, with one of bytes for the spelling of new words.

A text is its tokens: words in lower case (A-Z), then one end, which counts as the empty word.

Words. Contexts are the last 1 to WORDS tokens of the same text that training holds TWICE at least, whatever the size of
the corpus. A context is tested against the longest state that is a suffix of it: over all its places in training, the
logarithm of its next token's probability, smoothed and with that place itself left out, less the logarithm of the
suffix's; contexts whose sum exceeds GAIN nats are states. So short contexts that tell nothing are dropped while longer
ones of theirs that diverge stay. A token is scored by the longest state before it; a state's distribution is its counts,
smoothed with its suffix state's, which weighs WEIGHTS counts: (n(context, w) + m p(w | suffix)) / (n(context) + m). At
the root a token costs (c - d) / N + U p: its share in training less a discount d, got from how many words occur once and
twice (Ney), and the mass that all discounts leave, U = d V / N, times its spelling p.

Bytes. A word's spelling is its bytes and an end. The tree learns from the words that training holds SELDOM times at most,
which are most like those it lacks. The 63 most frequent bytes are symbols; the rest share one, with a distribution inside it. A context
of up to DEPTH symbols of the word that occurs LEAST times is tested: twice the count times the Kullback-Leibler
divergence of its next symbols from its suffix's must exceed what chance gives, and the divergence a floor. Contexts that
pass, and all their suffixes, are states (Witten-Bell smoothing). The alphabet bounds this tree; it is the one thing that
all tasks get.

Neither counts nor states of words are ever gathered whole. Texts are cut into blocks, stored as numbers of words. In each
round a block sends the keys (56 bits) of its distinct sequences of the next length, with their counts in its learning
texts, and those of its contexts, with its share of their sums, to buckets of keys; a bucket adds up and sends each block
its totals, in the block's order, which the next round joins to the block. Sequences whose context is no candidate are
never sent. A sequence moves once per block however often it occurs; neither a bucket nor a block grows with the corpus,
their numbers do: at 10^13 tokens a block's part of a bucket is down to a key or two, and a round costs what a shuffle of
single rows would. A block is BLOCK bytes of text, or one longer text, which a task holds some twenty times over. Two sequences share a key with probability 1.4e-17. Sums are integers, so no order of tasks changes a score.

`score` is the log10 probability of the text; over all texts it sums to one at most. `root_score` beside it is the same
without the tree of words.

Defined results: null and empty texts hold the end alone; rows with a null doc_id are scored but teach nothing; repeated
rows teach as often as they occur; without learning texts N and V are 0 and all symbols are equally likely; an empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import documents, held_out, scratch, scratch_path, written
from siltbed.llm.tokenizing import slices
from siltbed.llm.wordhash import END, mixed, word_hashes

DEPTH, BITS = 4, 6
SYMBOLS = 1 << BITS
RARE = SYMBOLS - 1
#: Occurrences of a context of bytes, and of one of words, that is tested.
LEAST, TWICE = 16, 2
#: Occurrences at most of words that the spelling is learned from.
SELDOM = 10
#: Standard deviations above chance, and least divergence in nats, for a context of bytes to be kept.
SIGMAS, FLOOR = 4.0, 0.005
#: Words in a context at most, by its length the weight of its suffix, and the nats that a state must gain.
WORDS = 3
WEIGHTS = (1000.0, 20.0, 0.5)
GAIN = 1.0
#: Parts of a nat in which gains are summed.
PARTS = 64
#: Bits of a sequence's key; bytes of text in a block; sequences in a bucket, about, and least and most bits of its number.
KEY_BITS = 56
BLOCK = 8_000_000
BUCKET, LEAST_BITS, BUCKET_BITS = 2_000_000, 7, 24


def symbols_of(data: bytes, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, symbols, bytes, where each word ends): at every byte and at the end of each word, the run of DEPTH + 1 symbols up to there."""
    n = len(ends)
    lengths = np.diff(ends, prepend=0)
    raw = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    first = ends - lengths + np.arange(n) * (DEPTH + 1)  # of a word's padding
    at = np.repeat(first + DEPTH - (ends - lengths), lengths) + np.arange(len(data))
    raw[at] = np.frombuffer(data, np.uint8)
    s = place[raw].astype(np.uint32)
    code = s.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= s[:-k] << np.uint32(BITS * k)
    keep = np.ones(len(raw), bool)
    keep[(first[:, None] + np.arange(DEPTH)).ravel()] = False
    return code[keep], s[keep], raw[keep], np.cumsum(lengths + 1)


@dataclass
class Tree:
    """States by order: their codes and rows in `logs` (log10 of next-symbol probabilities); inside: log10 by byte."""

    name: str
    place: np.ndarray
    codes: list[np.ndarray]
    rows: list[np.ndarray]
    logs: np.ndarray
    inside: np.ndarray

    def table(self) -> np.ndarray:
        """The row of the longest state for every run of DEPTH symbols."""
        out = np.zeros(SYMBOLS**DEPTH, np.int32)
        for k in range(1, DEPTH + 1):
            out.reshape(-1, SYMBOLS**k)[:, self.codes[k]] = self.rows[k]
        return out


def fit_tree(runs: DataFrame, seen: np.ndarray, place: np.ndarray) -> Tree:
    """The tree of these runs. What reaches the driver are the next-symbol counts of contexts that occur LEAST times; the alphabet bounds them."""
    each = runs.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k"), "code", "n")
    each = each.select("k", F.expr(f"code & (shiftleft(1L, {BITS} * (k + 1)) - 1)").alias("code"), "n").groupBy("k", "code").agg(F.sum("n").alias("n"))
    frequent = each.groupBy("k", F.shiftright("code", BITS).alias("context")).agg(F.sum("n").alias("total")).where((F.col("total") >= LEAST) | (F.col("k") == 0))
    got = each.withColumn("context", F.shiftright("code", BITS)).join(frequent, ["k", "context"]).select("k", "context", (F.col("code") % SYMBOLS).alias("next"), "n").toArrow()
    k, context, nxt, n = (got.column(c).to_numpy() for c in ("k", "context", "next", "n"))
    root = np.zeros(SYMBOLS)
    np.add.at(root, nxt[k == 0], n[k == 0])
    codes, smooth, good = [np.zeros(1, np.int64)], [((root + 1) / (root.sum() + SYMBOLS))[None].astype(np.float32)], [np.ones(1, bool)]
    parents = [np.zeros(1, np.int64)]
    for order in range(1, DEPTH + 1):
        mine = k == order
        own = np.unique(context[mine])
        counts = np.zeros((len(own), SYMBOLS), np.float32)
        counts[np.searchsorted(own, context[mine]), nxt[mine]] = n[mine]
        at = np.searchsorted(codes[-1], own & ((1 << BITS * (order - 1)) - 1))  # a suffix occurs no less often
        probs, passed = np.zeros_like(counts), np.zeros(len(own), bool)
        for lo in range(0, len(own), 1 << 14):
            c, base = counts[lo : lo + (1 << 14)].astype(np.float64), smooth[-1][at[lo : lo + (1 << 14)]].astype(np.float64)
            sums, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            share = c / sums
            divergence = np.where(c > 0, share * np.log(np.where(c > 0, share, 1) / np.maximum(base, 1e-300)), 0).sum(1)
            passed[lo : lo + (1 << 14)] = (2 * sums[:, 0] * divergence > kinds[:, 0] + SIGMAS * np.sqrt(2.0 * kinds[:, 0])) & (divergence > FLOOR)
            probs[lo : lo + (1 << 14)] = (c + kinds * base) / (sums + kinds)
        codes.append(own)
        smooth.append(probs)
        good.append(passed)
        parents.append(at)
    for order in range(DEPTH, 1, -1):
        good[order - 1][parents[order][good[order]]] = True
    rows, size = [], 0
    for g in good:
        rows.append(size + np.arange(int(g.sum())))
        size += int(g.sum())
    codes, probs = [c[g] for c, g in zip(codes, good, strict=True)], [x[g] for x, g in zip(smooth, good, strict=True)]
    rare = place == RARE
    inside = np.zeros(256)
    inside[rare] = np.log10((seen[rare] + 1) / (seen[rare].sum() + rare.sum()))
    return Tree(uuid.uuid4().hex, place, codes, rows, np.log10(np.concatenate(probs)), inside)


_TABLES: dict[str, np.ndarray] = {}


@dataclass
class Model:
    tree: Tree
    tokens: int
    distinct: int
    discount: float  # taken from each distinct token's count

    def spelling(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """The log10 probability of each word's bytes and end."""
        if self.tree.name not in _TABLES:
            _TABLES.clear()
            _TABLES[self.tree.name] = self.tree.table()
        code, s, raw, stops = symbols_of(data, ends, self.tree.place)
        states = _TABLES[self.tree.name][code >> np.uint32(BITS)].astype(np.int64)
        value = self.tree.logs.ravel()[states * SYMBOLS + s].astype(np.float64) + self.tree.inside[raw]
        return np.add.reduceat(value, np.append(0, stops[:-1]))

    def root(self, c: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """The probability of tokens that occur c times in training and are spelt so; spellings below 1e-250 count as that."""
        if not self.tokens:
            return 10.0 ** np.maximum(spelt, -250)
        return np.maximum(c - self.discount, 0) / self.tokens + self.discount * self.distinct / self.tokens * 10.0 ** np.maximum(spelt, -250)


def packed(x: np.ndarray, size: int) -> bytes:
    """The low bytes of each number, plane by plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T
    return out.view("<u8")[:, 0].astype(np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of keys of KEY_BITS, by one sort of numbers that hold the top of a key and its place."""
    n = len(keys)
    low = np.uint64(max(1, (n - 1).bit_length()))
    both = np.sort((keys << np.uint64(64 - KEY_BITS)) >> low << low | np.arange(n, dtype=np.uint64))
    order = (both & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():  # two keys with the same top
        return np.unique(keys, return_inverse=True)
    first = np.append(True, ranked[1:] != ranked[:-1])[:n]
    back = np.empty(n, np.int64)
    back[order] = np.cumsum(first) - 1
    return ranked[first], back


#: A block; what it asks buckets; what they tell it.
BLOCKS = "block bigint, n bigint, words binary, ids binary, docs binary, seen array<bigint>"
ASKED = "block bigint, bucket int, n bigint, keys binary, sums binary"
TOLD = "block bigint, bucket int, n bigint, sums binary"
SUM_BYTES = 6
COUNT, TEST = 0, WORDS + 1  # kinds of buckets: sequences of 1 to WORDS + 1 tokens, contexts of 1 to WORDS


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers of all tokens, tokens of each text, distinct words); the end of a text is the first word, the empty one."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    at = cut.offsets.to_numpy().astype(np.int64)
    at, pieces = at - at[0], cut.flatten()
    full = pc.greater(pc.binary_length(pieces), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64)))
    sizes = before[at[1:]] - before[at[:-1]] + 1
    found = pieces.filter(full).dictionary_encode()
    ids, is_word = np.zeros(int(sizes.sum()), np.int64), np.ones(int(sizes.sum()), bool)
    is_word[np.cumsum(sizes) - 1] = False
    ids[is_word] = found.indices.to_numpy() + 1
    return ids, sizes, [b"", *found.dictionary.cast(pa.binary()).to_pylist()]


def blocked(rows: DataFrame) -> DataFrame:
    """Texts by bounded size, as a table in buckets of blocks, which no round shuffles again. rows: doc_id, held_out, learns, text."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            ids, sizes, words = numbered(table.column("text").combine_chunks())
            learns = table.column("learns").to_numpy().astype(bool)
            n = np.bincount(ids, np.repeat(learns, sizes), len(words))
            seen = np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, [len(x) for x in words]), 256).astype(np.int64)
            docs, sink = table.drop_columns(["text"]).append_column("size", pa.array(sizes)).combine_chunks().to_batches()[0], pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(docs)
            row = [number], [len(ids)], [squeezed(b" ".join(words))], [packed(ids, 4)], [sink.getvalue().to_pybytes()], [seen.tolist()]
            number += 1
            pa.default_memory_pool().release_unused()
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=["block", "n", "words", "ids", "docs", "seen"])

        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), BLOCK):
                mine = batch.slice(at, len(part))
                at += len(part)
                new = mine.column("text").nbytes
                if held and size + new > BLOCK:
                    yield block()
                    held, size = [], 0
                held.append(mine)
                size += new
        if held:
            yield block()

    blocks = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "learns", "text").mapInArrow(run, BLOCKS)
    name = f"siltbed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").format("parquet").option("compression", "uncompressed").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


class Block:
    """A block's tokens, and the totals that are known of them by now."""

    def __init__(self, table: pa.Table, told: pa.Table | None):
        """table: the block's row; told: the rows that buckets sent it."""
        row = {c: table.column(c)[0].as_py() for c in ("block", "n", "words", "ids", "docs")}
        self.number = row["block"]
        self.ids = unpacked(row["ids"], row["n"], 4).astype(np.int64)
        self.words = unsqueezed(row["words"]).split(b" ")
        with pa.ipc.open_stream(row["docs"]) as source:
            self.docs = source.read_next_batch()
        self.sizes = self.docs.column("size").to_numpy()
        self.places = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.learns = np.repeat(self.docs.column("learns").to_numpy(zero_copy_only=False).astype(bool), self.sizes)
        self.counts: list[np.ndarray] = []
        self.tests: list[np.ndarray] = []
        if told is not None:
            bucket = told.column("bucket").to_numpy()
            order, kinds = np.argsort(bucket).tolist(), bucket >> BUCKET_BITS
            for kind in range(TEST + WORDS):
                rows = [(told.column("sums")[i].as_py(), told.column("n")[i].as_py()) for i in order if kinds[i] == kind]
                if rows:
                    known = np.concatenate([unpacked(x, n, SUM_BYTES) for x, n in rows])
                    self.counts.append(known.astype(np.float64)) if kind < TEST else self.tests.append(known > 0)
        hashes = np.zeros(len(self.words), np.uint64)
        if len(hashes) > 1:
            joined = b" ".join(self.words)[1:] + b" "
            hashes[1:] = word_hashes(joined, np.array([len(joined)]))[0]
        self.hashes = hashes

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of distinct tokens, the place of each word among them)."""
        return distinct(mixed(self.hashes + np.uint64(1)) >> np.uint64(64 - KEY_BITS))

    def seen(self) -> np.ndarray:
        """How often training holds each word."""
        return self.counts[0][self.single()[1]]

    def spelling(self, model: Model) -> np.ndarray:
        """The log10 probability of each token's spelling."""
        return model.spelling(b"".join(self.words), np.cumsum([len(x) for x in self.words]))[self.ids]

    def walk(self, model: Model | None = None, spelt: np.ndarray | None = None) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """(what the block asks next, as kind, keys and its shares of their sums; with a model, tokens' probabilities after the states known by now)."""
        own, back = self.single()
        if not self.counts:
            return [(COUNT, own, np.bincount(back[self.ids], self.learns, len(own)).astype(np.uint64))], np.zeros(0)
        asks: list[tuple[int, np.ndarray, np.ndarray]] = []
        tokens, n, back = self.hashes[self.ids], self.counts[0], back[self.ids]
        p = model.root(n[back], spelt) if model else np.zeros(0)
        key, at = mixed(tokens + np.uint64(1)), np.arange(len(tokens))
        for k in range(1, WORDS + 1):
            go = np.flatnonzero(n[back] >= TWICE)
            go = go[at[go] + 1 < len(tokens)]
            go = go[self.places[at[go] + 1] > 0]
            context, context_keys, context_n = back[go], own, n
            last, at = key[at[go]], at[go] + 1
            key = np.zeros(len(tokens), np.uint64)
            key[at] = mixed(last * np.uint64(0x9E3779B97F4A7C15) + tokens[at] + np.uint64(k + 1))
            own, back = distinct(key[at] >> np.uint64(64 - KEY_BITS))
            if k == len(self.counts):
                asks.append((COUNT + k, own, np.bincount(back, self.learns[at], len(own)).astype(np.uint64)))
                break
            n = self.counts[k]
            if len(n) != len(own):
                raise ValueError("a block got totals of other sequences than it asked for")
            if model:
                used, weight = np.flatnonzero(np.bincount(context, minlength=len(context_n))), WEIGHTS[k - 1]
                both, every, before = n[back], context_n[context], p[at]
                if k - 1 < len(self.tests):
                    state = np.zeros(len(context_n), bool)
                    state[used] = self.tests[k - 1]
                    p[at] = np.where(state[context], (both + weight * before) / (every + weight), before)
                else:
                    gain = np.log((np.maximum(both, 1) - 1 + weight * before) / ((every - 1 + weight) * before))
                    share = np.bincount(context, np.rint(gain * PARTS) * self.learns[at], len(context_n))[used].astype(np.int64)
                    asks.append((TEST + k - 1, context_keys[used], (share << 1 ^ share >> 63).view(np.uint64)))
        return asks, p


def at_blocks(blocks: DataFrame, told: DataFrame | None, run, schema: str) -> DataFrame:
    """run(block's row, the rows that buckets sent it or None) for each block; only the latter are shuffled."""
    own = blocks.drop("seen").groupBy("block")
    if told is None:
        return own.applyInArrow(lambda table: run(table, None), schema)
    return own.cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(run, schema)


def asked(blocks: DataFrame, told: DataFrame | None, bits: int, shared=None) -> DataFrame:
    """What blocks ask next, by buckets: totals of sequences and, once the model is known, of contexts' gains."""

    def run(table: pa.Table, told: pa.Table | None) -> pa.Table:
        block, model, out = Block(table, told), shared and shared.value, []
        for kind, keys, sums in block.walk(model, block.spelling(model) if model else None)[0]:
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
            for i, (k, x) in enumerate(zip(np.split(keys, cuts), np.split(sums, cuts), strict=True)):
                if len(k):
                    out.append((block.number, kind << BUCKET_BITS | i, len(k), packed(k, 7), packed(x, 5)))
        pa.default_memory_pool().release_unused()
        return table_of(out, ASKED_KINDS)

    return at_blocks(blocks, told, run, ASKED)


ASKED_KINDS = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "sums": pa.binary()}
TOLD_KINDS = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.int64(), "sums": pa.binary()}


def table_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)})


def answered(rows: DataFrame) -> DataFrame:
    """Totals over all blocks, for each block in its order: counts of sequences, or whether contexts are states. Rows of block -1 hold, for
    single tokens, N, V and how many occur once and twice, as buckets 0 to 3."""

    def run(table: pa.Table) -> pa.Table:
        kind = int(table.column("bucket")[0].as_py()) >> BUCKET_BITS
        block, bucket, sizes = (table.column(c).to_pylist() for c in ("block", "bucket", "n"))
        keys = np.concatenate([unpacked(x.as_py(), n, 7) for x, n in zip(table.column("keys"), sizes, strict=True)])
        sums = np.concatenate([unpacked(x.as_py(), n, 5) for x, n in zip(table.column("sums"), sizes, strict=True)])
        own, back = distinct(keys)
        out = []
        if kind < TEST:
            total = np.bincount(back, sums, len(own)).astype(np.uint64)
            if kind == COUNT:
                out = [(-1, i, int(x), b"") for i, x in enumerate((total.sum(), *map(np.count_nonzero, (total, total == 1, total == 2))))]
        else:
            gain = (sums >> np.uint64(1)).astype(np.int64) ^ -(sums & np.uint64(1)).astype(np.int64)
            total = (np.bincount(back, gain, len(own)) > GAIN * PARTS).astype(np.uint64)
        parts = np.split(total[back], np.cumsum(sizes)[:-1])
        return table_of([*out, *((a, b, n, packed(x, SUM_BYTES)) for a, b, n, x in zip(block, bucket, sizes, parts, strict=True))], TOLD_KINDS)

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def new_word_runs(blocks: DataFrame, told: DataFrame, place: np.ndarray) -> DataFrame:
    """code, n: how often each run of DEPTH + 1 symbols occurs in learning texts' words that training holds SELDOM times at most."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(table, told)
        n = np.bincount(block.ids[block.learns], minlength=len(block.words)) * (block.seen() <= SELDOM)
        n[0] = 0  # the end
        each, kept = np.array([len(x) for x in block.words])[n > 0], n[n > 0]
        codes = symbols_of(b"".join(x for x, m in zip(block.words, n.tolist(), strict=True) if m), np.cumsum(each), place)[0]
        codes, back = np.unique(codes, return_inverse=True)
        return pa.table({"code": codes.astype(np.int64), "n": np.bincount(back, np.repeat(kept, each + 1), len(codes)).astype(np.int64)})

    return at_blocks(blocks, told, run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def fit(blocks: DataFrame, told: DataFrame) -> Model:
    """The root and the spelling. told: the totals of single tokens."""
    seen = np.zeros(256, np.int64)
    for r in blocks.select(F.posexplode("seen").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        seen[r.byte] = r.n
    stats = {r.bucket: int(r.n) for r in told.where("block = -1").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # 4 rows
    tokens, kinds, once, twice = (stats.get(i, 0) for i in range(4))
    seen[END] = kinds
    frequent = np.argsort(-seen, kind="stable")[:RARE]
    place = np.full(256, RARE, np.uint8)
    place[frequent] = np.arange(len(frequent))
    if place[END] == RARE:  # always a symbol of its own
        place[[END, int(frequent[-1])]] = place[[int(frequent[-1]), END]]
    with scratch(blocks.sparkSession):
        tree = fit_tree(written(new_word_runs(blocks, told, place), "runs"), seen, place)
    return Model(tree, tokens, kinds, (once + 0.5) / (once + 2 * twice + 1))


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, root_score double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the scores of every row, learned from those with learns. docs: doc_id, held_out, learns, text."""
    spark = docs.sparkSession
    blocks = blocked(docs)
    total = blocks.agg(F.sum("n").alias("n")).first().n or 0
    bits = min(BUCKET_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, total / BUCKET))))))
    told, shared = None, None
    for step in range(WORDS + 2):  # one after the other, so that the disk holds what one round moves
        found = written(answered(asked(blocks, told, bits, shared)), f"sums_{step}", "uncompressed")
        told = found if told is None else told.unionByName(found)
        forget(spark)
        if step == 0:
            shared = spark.sparkContext.broadcast(fit(blocks, told))

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        block, m = Block(table, told), shared.value
        spelt, seen = block.spelling(m), block.seen()[block.ids]
        asks, p = block.walk(m, spelt)
        if any(len(keys) for _, keys, _ in asks):
            raise ValueError("a block lacks totals that it asked for")
        beyond = (np.minimum(spelt, -250) + 250) * (seen == 0)  # what a float cannot hold
        each = (np.log10((seen + 1) / (m.tokens + m.distinct + 1)), np.log10(p) + beyond, np.log10(m.root(seen, spelt)) + beyond)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        sums = [np.bincount(doc, x, len(block.sizes)) for x in each]
        known = np.bincount(doc, seen > 0, len(block.sizes)).astype(np.int64)
        columns = [block.docs.column("doc_id"), block.docs.column("held_out"), pa.array(block.sizes), pa.array(known), pa.array(np.full(len(known), m.tokens)), *map(pa.array, sums)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "root_score"])

    return at_blocks(blocks, told, run, SCORED)


def forget(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that no table needs any more. Its listeners hold the last query that ended, so another one ends first."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column) -> Column:
    return held_out(doc_id, 7, 2)


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, learned from six sevenths of the documents."""
    out = fold(F.col("doc_id"))
    return scored(documents(spark, sf_dir).select("doc_id", out.alias("held_out"), (F.col("doc_id").isNotNull() & ~out).alias("learns"), "text"))
