"""Parts of the operators: encoders, files, frames, trees, cuts, components, cutoffs and caches."""

import random
from collections import Counter
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.llm import language_id, minhash_dedup, mpeg_audio, packing, quality_classifier, quality_rules, shingles, source_mixing, token_counts, wordhash
from siltbed.llm.common import scratch, written
from siltbed.llm.components import components
from siltbed.llm.tokenizing import ChunkEncoder
from siltbed.llm.wavelet_matrix import WaveletMatrix, build

PIECES = ["a", "Word", " ", "  ", "\n", "\t", ".", ",", "!!", "'s", "don't", "É", "ñandú", "é", "日本", "😀", " ", " ", "<|endoftext|>", "<|startoftext|>", "12", "x9", "-", "\r", "\x0b", "\x1c", "\x85", "İ", "ΟΔΟΣ", "ﬁ", "_", "(", "~"]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def encoder(request):
    return ChunkEncoder(public_tokenizers.path(request.param), most=200)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.none(), max_size=5))
def test_chunks_give_the_librarys_ids(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    lo = 0
    for x, hi in zip(texts, ends.tolist(), strict=True):
        assert ids[lo:hi].tolist() == encoder.library.encode(x or "", add_special_tokens=False).ids
        lo = hi


@pytest.mark.parametrize("n", [0, 1, 5, 70_000, 140_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 50_256).astype("<u4")
    m = WaveletMatrix(build(ids, np.array([n]), [7]))
    assert (m.ids() == ids).all() and m.doc_ids == [7] and m.count(60_000) == 0
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert m.access(i) == ids[i]
        at = np.flatnonzero(ids == ids[i])
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(int(ids[i])) == len(at) and m.count(int(ids[i]), lo, hi) == ((at >= lo) & (at < hi)).sum()
        k = int(rng.integers(0, len(at)))
        assert m.select(int(ids[i]), k) == at[k]
    if n:
        assert list(islice(m.occurrences(int(ids.min())), 3)) == np.flatnonzero(ids == ids.min())[:3].tolist()
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix(b"not one of these files")


@settings(max_examples=60, deadline=None)
@given(text=st.binary(max_size=2000) | st.just(b"\xff\xfa\xc4\xc0" * 400))
def test_audio_round_trip(text):
    payload = mpeg_audio.padded(text)
    x = mpeg_audio.parse_stream(mpeg_audio.encode_stream(payload))
    n = len(payload) // 576
    assert x["payload"] == payload and x["frames"] == n and x["samples"] == 1152 * n and x["crc_errors"] == x["skipped_bytes"] == 0
    assert x["table"]["kind"] == "Xing" and x["table"]["frames"] == n and len(x["table"]["toc"]) == 100 and x["tags"]["payload_bytes"] == str(len(payload))


def test_audio_resynchronises_and_checks():
    data = mpeg_audio.encode_stream(mpeg_audio.padded(b"a" * 3000))
    first = mpeg_audio.parse_stream(data)["offsets"]
    noise = b"\xff\xfa\xc4\xc0 no frame \xff\xe0"
    x = mpeg_audio.parse_stream(data[: first[2]] + noise + data[first[2] :])
    assert x["skipped_bytes"] == len(noise) and x["frames"] == 6 and x["offsets"][2] == first[2] + len(noise)
    broken = bytearray(data)
    broken[first[1] + 7] ^= 1  # side info, under the checksum
    assert mpeg_audio.parse_stream(bytes(broken))["crc_errors"] == 1
    tail = b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    assert mpeg_audio.parse_stream(data + tail)["tags"]["TIT2"] == "title"
    assert mpeg_audio.parse_stream(data[:-10])["frames"] == 5
    for odd in (None, b"", b"\xff" * 3000, b"ID3\x03\0\0\0\0\x0f\x7f"):
        x = mpeg_audio.parse_stream(odd)
        assert x["frames"] == 0 and x["payload"] == b"" and x["offsets"] == []


def test_audio_tables_and_kinds():
    assert mpeg_audio.header_of(int.from_bytes(mpeg_audio.DATA_HEADER, "big"))[4:] == (672, 1152, True)
    layer1 = bytes((0xFF, 0xFF, 0x14, 0))  # MPEG-1 Layer I, 32 kbit/s, 48 kHz, no checksum: 32 bytes
    x = mpeg_audio.parse_stream((layer1 + bytes(28)) * 4)
    assert (x["frames"], x["samples"], x["layer"], x["crc_checked"]) == (4, 1536, 1, 0)
    for mode, covered in ((0xC0, 16), (0x00, 32), (0x60, 22)):  # mono, stereo, joint from subband 12 on
        head = bytes((0xFF, 0xFE, 0xC4, mode))  # Layer I, 384 kbit/s, 48 kHz, protected: 384 bytes
        body = bytes(range(1, covered + 1))
        good = head + mpeg_audio.crc16(head[2:] + body).to_bytes(2, "big") + body
        good = good.ljust(384, b"\0")
        bad = bytearray(good)
        bad[6 + covered - 1] ^= 1
        x = mpeg_audio.parse_stream(good * 2 + bytes(bad) + good)
        assert (x["frames"], x["crc_checked"], x["crc_errors"]) == (4, 4, 1)
    frame = bytearray(bytes((0xFF, 0xFB, 0x54, 0)) + bytes(188))
    frame[36:62] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + (5).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes(2)
    frame[62:64] = bytes((10, 20))
    x = mpeg_audio.parse_stream(bytes(frame) + (bytes((0xFF, 0xFB, 0x54, 0)) + bytes(188)) * 3)
    assert x["table"] == {"kind": "VBRI", "frames": 3, "bytes": 999, "toc": [50, 100]} and x["frames"] == 3


@settings(max_examples=80, deadline=None)
@given(gaps=st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=12))
def test_cuts_are_the_best(gaps):
    places, penalties = np.cumsum([g for g, _ in gaps]), np.array([p for _, p in gaps])
    window, cost = 10, {0: 0}
    for j, (at, p) in enumerate(zip(places.tolist(), penalties.tolist())):
        cost[at] = min(cost[x] + window - (at - x) + p for x in [0, *places[:j].tolist()] if at - x <= window)
    cuts = packing.best_cuts(places, penalties, window)
    got, low, price = 0, 0, dict(zip(places.tolist(), penalties.tolist()))
    for c in cuts:
        assert 0 < c - low <= window
        got, low = got + window - (c - low) + price[c], c
    assert cuts[-1] == places[-1] and got == cost[places[-1]]


def test_tails():
    assert packing.tail_cuts(2048) == [2048] and packing.tail_cuts(1024) == [1024] and packing.tail_cuts(1500)[0] == 1024
    assert sum(packing.tail_cuts(1500)) == 1500 and packing.tail_cuts(2047) == [2047]


def test_small_runs_pack_the_same_text(spark):
    """What a run leaves goes into the next: batches of one partition, run through pack()'s own function in this process."""
    texts = [f"Sentence number {i} is here. " * (i % 50 + 1) for i in range(400)]
    texts[7] = "word " * 9000  # longer than a run, without an end of a sentence
    library = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).library
    want = [[*library.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for run in (4096, 1 << 20):
        got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), run=run).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
            assert r.start == len(by.get(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id]) and r.sequence_tokens <= 2048
            by[r.doc_id] = by.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
        assert [by[i] for i in range(400)] == want
        ordered = sorted(got, key=lambda r: (r.sequence_id, r.offset))
        assert [(r.doc_id, r.start) for r in ordered] == sorted((r.doc_id, r.start) for r in got)
        at = {}
        for r in ordered:
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length


def test_word_hashes():
    texts = ["One TWO  one", None, "", "two\x0bÉ é", "one two"]
    [(n, data, ends)] = list(wordhash.normal(pa.array(texts)))
    h, at = wordhash.word_hashes(data, ends)
    assert n == 5 and at.tolist() == [3, 3, 3, 6, 8]
    assert h[0] == h[2] == h[6] and h[1] == h[3] == h[7] and h[4] != h[5] and len(set(h.tolist())) == 4


def test_shingle_sets_and_signatures():
    texts = ["a b c d e f", "A B C D E F", "a b c d", "a b c", "b a c", "", None, "x " * 20]
    sets = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and len({int(s[0]) for s in sets[2:5]}) == 3
    m, rng = shingles.MinHash(64), np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    hits = [(m.signature(a) == m.signature(np.concatenate([a[100:], rng.integers(0, 1 << 63, 100, np.uint64)]))).mean() for _ in range(20)]
    assert abs(np.mean(hits) - 900 / 1100) < 0.05


def test_scratch_tables_go(spark):
    with scratch(spark):
        gone = written(spark.range(3), "gone")
        with scratch(spark):
            inner = written(gone, "inner")
            kept = written(inner, "kept", outer=True)
        assert kept.count() == 3
        out = written(kept, "out", outer=True)
    assert out.count() == 3
    for df in (gone, inner, kept):
        with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
            df.count()


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = [(5, 3), (3, 9), (9, 9), (20, 21), (None, 4), (21, 20), *chain, *((1000, x) for x in range(1001, 1200))]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20} | {x: 100 for x in range(100, 161)} | {x: 1000 for x in range(1000, 1200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_stars_miss(spark):
    """A chain of copies, each near the next alone: its ends meet only through the second pass or through each other."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for i in range(30):
        rows.append((29 - i, " ".join(words)))
        for at in rng.sample(range(600), 4):
            words[at] = f"e{i}x{at}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(x.split()[k : k + 5]) for k in range(596)} for i, x in rows}
    label = {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == label and len(set(label.values())) < 30


def test_rest_pairs_finds_what_differs(spark, monkeypatch):
    """With every class its own component, blocks of any size give the same pairs once each."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"e{i}x{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash_dedup.signed(docs).select("digest", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig")
    posts = minhash_dedup.posted(classes)
    none = spark.createDataFrame([], "node long, component long")
    posts = posts.join(minhash_dedup.shared_shingles(minhash_dedup.full_sets(docs, posts.select(F.col("rep").alias("id")))), "rep")
    seen = []
    for block in (256, 7):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = [tuple(r) for r in minhash_dedup.rest_pairs(posts, none).collect()]
        assert len(got) == len(set(got))
        seen.append(set(got))
    assert seen[0] == seen[1]
    sets = {i: {tuple(x.split()[k : k + 5]) for k in range(196)} for i, x in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near and near <= seen[0]


def test_repeated_ids_join_their_texts(spark):
    x, y, z = ("".join(f"{c}{i} " for i in range(60)) for c in "xyz")
    docs = spark.createDataFrame([(3, x), (7, x), (7, y), (9, y), (11, z), (11, z), (12, "one two"), (12, "three four")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {(3, 56): 3, (7, 56): 3, (9, 56): 3, (11, 56): 11, (12, 1): 12}


def test_templates_grow_in_proportion(spark, monkeypatch):
    """Documents of 400 shared and 100 own words resemble each other by 0.665: no links, and no rows that grow with pairs."""
    sizes, keep = [], minhash_dedup.written
    monkeypatch.setattr(minhash_dedup, "written", lambda df, name, *a, **k: (out := keep(df, name, *a, **k), name == "early" and sizes.append(out.count()))[0])
    shared = " ".join(f"t{i}" for i in range(400))
    made = []
    for n in (300, 1200):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")).alias("text"))
        classes = minhash_dedup.signed(docs).select("digest", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig")
        posts = minhash_dedup.posted(classes)
        posts = posts.join(minhash_dedup.shared_shingles(minhash_dedup.full_sets(docs, posts.select(F.col("rep").alias("id")))), "rep")
        made.append(minhash_dedup.rest_pairs(posts, spark.createDataFrame([], "node long, component long")).count())
    assert made == [0, 0] and sizes[1] <= 1.2 * 4 * sizes[0]


def test_recall_of_signatures():
    """Sets that resemble each other by 0.75 and more have MATCHES equal values, each pair of 3,000."""
    m, rng, missed, n = shingles.MinHash(minhash_dedup.K), np.random.default_rng(5), 0, 0
    for size in (28, 70, 700):
        for _ in range(1000):
            both = size * 6 // 7  # J = 0.75
            a, b, c = (rng.integers(0, 1 << 63, k, np.uint64) for k in (both, size - both, size - both))
            missed += int((m.signature(np.concatenate([a, b])) == m.signature(np.concatenate([a, c]))).sum() < minhash_dedup.MATCHES)
            n += 1
    assert missed == 0 and n == 3000


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (1, 5, 40, 700) for k in (0, 1, 3, 8) if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.0125))
    for r in rows.collect():
        want = 1.0 if r.k > r.n * 0.0125 else sum(comb(r.n, i) * 0.0125**i * 0.9875 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9 * max(want, 1e-9) + 1e-12


def test_cutoffs_hold_back_without_proof(spark):
    ratios = [f"r_{x}" for x in quality_rules.GRID]
    schema = "doc_id long, digest string, lang string, base_failed boolean, " + ", ".join(f"{r} double" for r in ratios)

    def fitted(n_good, over, texts=1 << 30, times=1):
        rows = [(i, f"d{i % texts}", "en", False, 0.4 if i < over else 0.0, 0.0, 0.0, 0.0) for i in range(n_good)] * times + [(n_good + i, f"b{i}", "en", False, 0.9, 0.0, 0.0, 0.0) for i in range(50)]
        labels = [(i, int(i < n_good)) for i in range(n_good + 50)]
        return {(r.stratum, r.rule): r.cutoff for r in quality_rules.fit_cutoffs(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    assert fitted(100, 0) == {}  # too few to prove a rate of 0.0125
    assert fitted(3000, 0) == {("en", "symbols"): 0.5}
    assert fitted(3000, 1500) == {("en", "symbols"): 0.5}
    assert fitted(10, 0, times=300) == {} == fitted(3000, 0, texts=10)  # rows of one id, or of one text, are one trial


def test_mix_spreads_over_any_partitioning(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    took = []
    for n in (1, 7):
        part = docs.repartition(n)
        rows, cuts = source_mixing.fit(part)
        took.append({r.doc_id: r.n_copies for r in source_mixing.with_copies(rows, cuts, F.col("u"), F.col("size")).collect()})
        assert {r.doc_id: r.n_copies for r in source_mixing.with_copies(part, cuts, source_mixing.uniform_of(F.col("doc_id"), F.col("text")), source_mixing.size_of(F.col("text"))).collect()} == took[-1]
    assert took[0] == took[1] and set(took[0].values()) <= {0, 1, 2}


def test_inclusion_follows_the_stated_odds(spark):
    """180 sources alike but for their weights and random numbers: sizes are sampled as often as their probabilities say, in an order that is not that of the random numbers."""
    docs = spark.range(180 * 60).select(F.col("id").alias("doc_id"), F.format_string("s%03d", F.col("id") % 180).alias("source"), F.repeat(F.lit("w "), F.pow(F.lit(2), F.floor(F.col("id") / 180) % 6).cast("int") * 3).alias("text"))
    rows, cuts = source_mixing.fit(docs)
    out = source_mixing.with_copies(rows, cuts, F.col("u"), F.col("size")).join(cuts.select("source", "rate", "copies"), "source")
    p = source_mixing.inclusion_of(F.col("size"), F.col("rate"))
    got = out.groupBy("rate", "copies", "size").agg(F.avg(F.col("n_copies") - F.col("copies")).alias("share"), F.avg(p).alias("p"), F.count(F.lit(1)).alias("n")).where("rate > 0").collect()
    assert len(got) >= 6
    for r in got:
        assert abs(r.share - r.p) < 0.02 + 4 * (r.p * (1 - r.p) / r.n) ** 0.5, r
    assert len({round(r.p, 3) for r in got}) >= 3
    taken = out.where("rate > 0").groupBy("source").agg(F.max(F.when(F.col("n_copies") > F.col("copies"), F.col("u"))).alias("hi"), F.min(F.when(F.col("n_copies") == F.col("copies"), F.col("u"))).alias("lo"))
    assert taken.where("hi > lo").count() > 0.9 * taken.count()


def test_cache_encodes_misses_once(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, None, "z"), (4, "c", "w")], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.n_tokens, r.digest) for r in token_counts.with_token_counts(first, path, cache).collect()}
    assert got == {1: (2, "x"), 2: (2, "y"), 3: (0, "z"), 4: (1, "w")}
    assert spark.read.parquet(cache).count() == 3
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).where("n_tokens = 77").limit(0).write.mode("append").parquet(cache)
    more = spark.createDataFrame([(5, "a b", "x"), (6, "new words here", "y")], "doc_id long, text string, digest string")
    assert {r.doc_id: r.n_tokens for r in token_counts.with_token_counts(more, path, cache).collect()} == {5: 2, 6: 3}
    assert spark.read.parquet(cache).count() == 4
    assert token_counts.tokenizer_version(path) != token_counts.tokenizer_version(public_tokenizers.path("byte_bpe_50k.json"))


def test_cache_that_holds_a_part(spark, tmp_path):
    """Counts come from the cache where it has them, of this version of the tokenizer alone; only misses are encoded."""
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    rows = [(i, f"text number {i % 6}") for i in range(60)] + [(None, "text number 0"), (None, "a new one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = docs.where("doc_id % 6 < 3")
    known = half.select(token_counts.content_digest(half["text"]).alias("digest")).distinct()
    known.select("digest", F.lit(token_counts.tokenizer_version(path)).alias("tokenizer"), F.lit(1000).cast("long").alias("n_tokens")).write.parquet(cache)
    known.select("digest", F.lit("another").alias("tokenizer"), F.lit(2000).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    got = token_counts.with_token_counts(docs, path, cache).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, 1000 if x.startswith("text") and int(x[-1]) < 3 else 3) for i, x in rows)
    assert spark.read.parquet(cache).where("n_tokens < 1000").count() == 4
    assert token_counts.with_token_counts(docs, path, cache).count() == 62 and spark.read.parquet(cache).count() == 10


def test_counts_of_a_tokenizer_that_keeps_blanks(spark, tmp_path):
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["a b", "a\n\n b", "a  b"]
    library = ChunkEncoder(path).library
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.with_token_counts(docs, path, str(tmp_path / "cache")).collect()}
    assert got == {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_bundles_depend_on_letters_alone():
    b = language_id.Bundler(64)
    one, two, none, long = b.bundles(["Héllo, wörld", "héllo -- WÖRLD!", "42 !?", "日本語" * 50])
    assert (one == two).all() and not none.any() and long.any()
    assert (language_id.Bundler(64).bundles(["zz", "Héllo, wörld"])[1] == one).all()
    many = "".join(chr(0x4E00 + i) for i in range(400))
    assert language_id.Bundler(64).bundles([many]).any()


def test_bundles_against_brute_force(monkeypatch):
    """Letters' vectors rotated, bound and bundled one n-gram at a time, however many n-grams are handled at once."""
    rng = random.Random(6)
    texts = ["Ab, cab! bad", "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(3000)), "x", ""]
    vector = lambda c: np.random.default_rng([7, ord(c) if c != " " else 0]).integers(0, 2, 64, np.int8).astype(int) * 2 - 1
    want = []
    for x in texts:
        s = " " + "".join(c if c.isalpha() else " " for c in x.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        grams = [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
        sums = np.zeros(64)
        for g in set(grams):
            sums += round(float(np.sqrt(grams.count(g))) * 16) * np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2])
        want.append(sums)
    for most in (4096, 100):
        monkeypatch.setattr(language_id, "GRAMS", most)
        assert (language_id.Bundler(64).bundles(texts) == np.array(want)).all()


def test_long_texts_of_many_letters_take_bounded_memory():
    import resource
    import subprocess
    import sys

    code = """
import random, resource
from siltbed.llm.language_id import Bundler
rng = random.Random(1)
text = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(1_400_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Bundler().bundles([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600)
    assert int(got.stdout) < 700 and resource  # MB, the process itself included


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 10))
    y = (rng.random(1500) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    p = quality_classifier.train(x, y).probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.8
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[own].mean()) < 0.15


def test_features_against_brute_force(spark):
    """Context vectors, pooled vectors and counts, word by word."""
    texts = ["The cat sat, the cat ran 42 42 times", "a a a a b", "", "!!! ???", "naïve é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    vectors = quality_classifier.fit(docs, labels, F.lit(True)).vectors
    index = quality_classifier.index_vectors().astype(float)
    context = np.zeros_like(index)
    seqs = [quality_classifier.places(x.encode()).tolist() for x in texts]
    for own in seqs:
        for i, w in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    context[w] += index[own[j]]
    unit = context / np.maximum(np.sqrt((context**2).sum(1, keepdims=True)), 1e-12)
    used = sorted({w for own in seqs for w in own})
    assert np.allclose(vectors[used], (index + unit)[used], atol=1e-4)
    got = quality_classifier.pooled([np.array(x, np.int64) for x in seqs], vectors)
    for row, own in zip(got, seqs, strict=True):
        v = vectors[own].astype(float) if own else np.zeros((1, quality_classifier.DIMENSIONS))
        want = [*v.mean(0), *v.std(0), np.log1p(len(own)) / 8, len(set(own)) / max(1, len(own)), sum((own.count(w) / len(own)) ** 2 for w in set(own)), np.mean([a == b for a, b in zip(own, own[1:])]) if len(own) > 1 else 0.0]
        assert np.allclose(row, want, atol=2e-3)


def test_one_kind_of_label(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, want in (([], 1.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = quality_classifier.fit(docs, labels(rows), F.lit(True))
        assert {r.score for r in quality_classifier.with_quality(docs, model).collect()} == {want}
