"""Whole texts to token ids by the tokenizers library, with each distinct blank-separated chunk encoded once.

Pre-tokens never join what stands left of a blank to what follows it, so the ids of a text are the ids of its chunks, end
to end. Arrow cuts a batch of texts into chunks and finds the distinct ones; the library encodes those that a bounded
cache doesn't hold. Chunks of Latin letters and plain punctuation are cut once more, where pre-tokens end, so that a word
is encoded once whatever punctuation follows it. All else goes to the library as it stands.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks whose ids one Python worker keeps, the less used half forgotten beyond that; and half as many words in each of two generations.
MOST_PIECES = 400_000
#: Characters of text that are encoded at once.
SLICE = 10_000_000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"[.,;:!?*#$%&|()\-]"
#: Letters, then punctuation; each run is one pre-token. No apostrophe, digit, angle bracket or underscore.
_DROPPED = re.compile(rf"([{_LETTERS}]+)({_MARKS}*)\Z")
_KEPT = re.compile(rf"(\n?)( ?[{_LETTERS}]+)({_MARKS}*)\Z")
#: A text is cut only before a blank or line feed that one of these follows; else what stands there depends on more.
_ODD = r"[ \n]([^!-~À-ÖØ-öø-ÿ]|$)"


class ChunkEncoder:
    """encode(texts): (ids, ends): all ids of all texts, exactly as the library gives them, and where each text ends."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        suffix = model["model"].get("end_of_word_suffix")
        #: Byte-level pre-tokens carry the blank before them; the other kind drops blanks and marks a word's last token.
        self.keeps_blanks = not suffix
        self.size = 1 + max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"])])
        self.lasts = np.zeros(self.size, bool)
        self.lasts[[i for x, i in model["model"]["vocab"].items() if (x.endswith(suffix) if suffix else x == "Ċ")]] = True
        self.most, self.new, self.old = most, {}, {}
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 1024) for e in self.library.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]

    def _learn(self, words: list[str], others: list[str], out: dict[str, bytes]) -> None:
        """The ids of pieces that are not cached; words are pieces of one pre-token of letters."""
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(self._encode(["\n".join(part)])[0], "<u4")
            at = np.flatnonzero(self.lasts[ids])
            if self.keeps_blanks:  # the line feed between two words is a token of its own
                starts, ends = np.append(0, at + 1), np.append(at, len(ids))
            else:
                starts, ends = np.append(0, at[:-1] + 1), at + 1
            if len(starts) != len(part):
                raise ValueError("a word was not one pre-token")
            raw = ids.tobytes()
            out.update((x, raw[4 * a : 4 * b]) for x, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))
        out.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(others, self._encode(others), strict=True))

    def _of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks that are not known yet."""
        new, old, match = self.new, self.old, (_KEPT if self.keeps_blanks else _DROPPED).match
        cut, words, others = [], {}, {}
        for x in chunks:
            m = match(x)
            if m is None:
                cut.append((x,))
                others[x] = None
                continue
            parts = m.groups("") if self.keeps_blanks else (m[1].lower(), m[2])
            cut.append(parts)
            for p in parts:
                if p not in new and p:
                    (words if p[-1].isalpha() else others)[p] = old.get(p)
        learnt: dict[str, bytes] = {"": b""}
        self._learn([p for p, x in words.items() if x is None], [p for p, x in others.items() if x is None], learnt)
        for kept in (words, others):
            learnt.update((p, x) for p, x in kept.items() if x is not None)
        new.update((p, x) for p, x in learnt.items() if len(p) < 64)
        out = [b"".join([new[p] if p in new else learnt[p] for p in parts]) for parts in cut]
        if len(new) > self.most // 2:
            self.old, self.new = new, {}
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.keeps_blanks:
            odd = pc.match_substring_regex(texts, _ODD)
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
            if pc.any(odd).as_py():
                cut = pa.array([[x] if o else y for x, y, o in zip(texts.to_pylist(), cut.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
        else:
            cut = pc.ascii_split_whitespace(texts)
        at = cut.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        pieces = cut.flatten()
        if self.keeps_blanks and len(pieces):  # chunks have a blank before them but for a text's first and those that begin a line
            first = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False).copy()
            first[at[:-1][at[:-1] < at[1:]]] = True
            pieces = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), pieces, "")
        found = pieces.dictionary_encode()
        known = pc.index_in(found.dictionary, value_set=self.known)
        fresh = found.dictionary.filter(pc.is_null(known))
        coded = self._of(fresh.to_pylist())
        n = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
        self.sizes = np.concatenate([self.sizes, n])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), "<u4")])
        place = known.to_numpy(zero_copy_only=False).astype(np.float64)
        gap = np.isnan(place)
        place[gap] = len(self.known) + np.arange(len(fresh))
        place = place.astype(np.int64)
        self.known = pa.concat_arrays([self.known, fresh])
        index = place[found.indices.to_numpy()]
        self.used = np.append(self.used, np.zeros(len(fresh), np.int64)) + np.bincount(index, minlength=len(self.known))
        each = self.sizes[index]
        ends = np.cumsum(each)
        out = self.pool[np.repeat(self.starts[index] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        if len(self.known) > self.most:
            self._keep(np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2]))
        return out, np.append(0, ends)[at[1:]]

    def _forget(self) -> None:
        self.known, self.pool = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts = self.sizes = self.used = np.zeros(0, np.int64)

    def _keep(self, kept: np.ndarray) -> None:
        """Forgets all chunks but these."""
        n, ends = self.sizes[kept], np.cumsum(self.sizes[kept])
        self.pool = self.pool[np.repeat(self.starts[kept] - (ends - n), n) + np.arange(ends[-1])]
        self.known, self.starts, self.sizes, self.used = self.known.take(pa.array(kept)), ends - n, n, self.used[kept] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        collecting = gc.isenabled()
        gc.disable()  # no cycles arise here, and going through all kept pieces takes longer than encoding
        done = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        base = 0
        for part in slices(texts):
            ids, ends = self._slice(part)
            done.append((ids, ends + base))
            base += len(ids)
            pa.default_memory_pool().release_unused()
        if collecting:
            gc.enable()
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """texts in runs of at most so many bytes, or of one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each tokenizer file in a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
