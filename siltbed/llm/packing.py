"""Order-preserving packing of documents into training sequences by dynamic programming.

The documents of a task, each with an end id, form one stream in the table's order. Windows of at most `window` ids cut
the stream at document ends (free), at sentence ends (a small penalty) or, in sentences longer than `reach`, at fixed
steps (a larger one). The cost of a window is its padding plus the penalty of its cut; with key(i) = cost(i) + place(i),
the best predecessor of a cut is the smallest key within the last `window` ids, which a monotone queue yields in
constant time. Streams are solved run by run; a run's last window is solved again with the next run, so memory is
bounded whatever the task reads. Each run is forced to end somewhere, which pads more the shorter runs are: runs of 4096
ids pad 16 %, of 20,000 5 %, of RUN 1.3 %. What is left at a task's end is padded, or cut at powers of two, which need no
padding, if that costs less: at most `window` ids of a task, in pieces that no sentence ends.

Nothing is shuffled: each task packs what it reads, so sequences never wait for other tasks. sequence_id joins the
task's number and the sequence's number in it.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; null doc_ids stay null; an
empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import documents

WINDOW = 2048
END_ID = 1
#: Penalties in ids of padding: a cut at a sentence's end, inside a long sentence, and a short sequence more at the end.
SENTENCE, INSIDE, SHORT = 4, 24, 32
#: Sentences longer than this may be cut inside, at these steps.
REACH, STEP = 256, 64
#: Ids solved at once.
RUN = 1 << 20
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending, and their penalties. stops has for each id whether it ends a sentence."""
    sentence = np.flatnonzero(stops[ids]) + 1
    places = np.union1d(sentence, doc_ends)
    gaps = np.diff(places, prepend=0)
    long = np.flatnonzero(gaps > REACH)
    inside = [np.arange(places[i] - gaps[i] + STEP, places[i], STEP) for i in long.tolist()]
    every = np.union1d(places, np.concatenate(inside)) if inside else places
    cost = np.full(len(every), INSIDE, np.int64)
    cost[np.searchsorted(every, sentence)] = SENTENCE
    cost[np.searchsorted(every, doc_ends)] = 0
    return every, cost


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least padding plus penalties; the last place is always cut. places ascend from above 0, gaps up to window."""
    at, pen = [0, *places.tolist()], [0, *penalties.tolist()]
    n = len(at)
    key, back = [0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        low = at[j] - window
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        key[j] = k = key[i] + window + pen[j]  # cost(j) + place(j), as cost(j) = cost(i) + window - (at[j] - at[i]) + pen[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(length: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences that a task's last window becomes."""
    powers = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return powers if SHORT * len(powers) < window - length else [length]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, run: int = RUN) -> DataFrame:
    """The pieces of docs: each with its ids as little-endian unsigned 32-bit integers, its place in its document and in its sequence."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from siltbed.llm.tokenizing import encoder, slices

        enc = encoder(tokenizer)
        stops = np.zeros(enc.size, bool)
        for mark in (".", "!", "?", "。", "！", "？"):
            ids = enc.library.encode(f"a{mark}", add_special_tokens=False).ids
            stops[ids[-1]] = True
        task, made = TaskContext.get().partitionId(), 0
        names: list[int | None] = []  # of the documents held, the first perhaps without the ids that are packed already
        held: list[np.ndarray] = []
        sizes: list[int] = []
        done_before, size = 0, 0

        def solved(last: bool) -> pa.RecordBatch | None:
            nonlocal names, held, sizes, done_before, size, made
            stream = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            cuts = best_cuts(*candidate_cuts(stream, ends, stops), window)
            if last:
                low = cuts[-2] if len(cuts) > 1 else 0
                cuts = [*cuts[:-1], *(low + np.cumsum(tail_cuts(cuts[-1] - low, window))).tolist()]
            else:
                cuts.pop()
            if not cuts:
                return None
            done = cuts[-1]
            edges = np.union1d(ends[ends < done], cuts)
            lows = np.append(0, edges[:-1])
            doc, seq = np.searchsorted(ends, lows, "right"), np.searchsorted(cuts, lows, "right")
            firsts, starts = np.append(0, ends[:-1]), np.append(0, cuts[:-1])
            start = lows - firsts[doc] + np.where(doc == 0, done_before, 0)
            whole = np.array(sizes)
            ids = pa.Array.from_buffers(pa.binary(), len(lows), [None, pa.py_buffer((np.append(0, edges) * 4).astype(np.int32)), pa.py_buffer(stream[:done].astype("<u4").tobytes())])
            number = (np.int64(task) << 33) + made + seq
            out = pa.RecordBatch.from_arrays([pa.array([names[i] for i in doc.tolist()], pa.int64()), pa.array(start, pa.int64()), pa.array(edges - lows, pa.int64()), ids, pa.array(whole[doc], pa.int64()), pa.array(number, pa.int64()), pa.array(lows - starts[seq], pa.int64()), pa.array((cuts - starts)[seq], pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])
            made += len(cuts)
            k = int(np.searchsorted(ends, done, "right"))
            if k < len(held):
                cut = done - int(firsts[k])
                done_before = cut + (done_before if k == 0 else 0) if cut > 0 else (done_before if k == 0 else 0)
                held = [held[k][max(cut, 0) :], *held[k + 1 :]]
            else:
                done_before, held = 0, []
            names, sizes = names[k:], sizes[k:]
            size = sum(map(len, held))
            return out

        end = np.array([end_id], "<u4")
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                ids, ends = enc.encode(texts)
                lo = 0
                for name, hi in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), ends.tolist(), strict=True):
                    own = np.concatenate([ids[lo:hi], end])
                    names.append(name)
                    held.append(own)
                    sizes.append(len(own))
                    size += len(own)
                    lo = hi
                    if size >= run and (out := solved(False)) is not None:
                        yield out
                at += len(texts)
        if held and (out := solved(True)) is not None:
            yield out

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(packed, PIECES)


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return digested(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
