"""Near-duplicates by a signature-coordinate inverted join.

Documents are sets of distinct word shingles; documents with equal sets form a class, joined by its smallest id. A
class's MinHash signature has K coordinates. Every class is posted under each of its (coordinate, value) pairs; pairs
of sets with a Jaccard similarity of 0.75 share at least MATCHES of K values, but for four cases in ten million.

Skip: a value that one class alone has joins nothing, and a class with fewer than MATCHES shared values is left out for
good. Prefix: two classes that agree in MATCHES values agree in one of the rarest K - MATCHES + 1 of each, so only these
are posted, and common passages, which fill common postings, seldom count. Merge: first every member of a posting is
held against the posting's centre, the member most of whose shingles other documents share; collisions of the signatures
are counted, pairs above the threshold are confirmed on full sets, and the links' components are found. A posting whose
members are one component by then is done, which settles large groups of copies without forming their pairs. Members of
the others are dealt by their rarest shared shingles, of which similar sets have one in common, so that documents of one
template, which fill one posting, do not meet each other; members outside a shingle's largest component are held against
all of its members, in blocks of bounded size. Pairs in one component already are skipped, as are those too few of whose
shingles occur in any other document's set; of the rest collisions are counted and links confirmed. So every pair of
classes that could add a link between components is counted, and no group is ever in one task.

Sets are of 64-bit numbers of shingles: two of the s distinct shingles of a corpus share one with probability s * s / 2^65
at most, which can move a size or an intersection by one.

Defined results: documents without words have an empty set, are linked with nothing, and stay; rows with a null doc_id
are linked with nothing, their component is null and they stay; rows that repeat a doc_id are one node, which joins the
links of all its texts; copies and ties
go to the smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import IdFilter, documents, scratch, written
from siltbed.llm.components import components

K, MATCHES = 64, 30
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
BLOCK = 256
#: Rows of postings, about, and pairs of rows that are handled at once.
CELLS, PAIRS = 10_000, 1_000_000
#: Bits of the filter of wanted ids that every task gets.
FILTER_BITS = 24

SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sig array<int>"


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The size, digest and signature of each document's set; digest and signature are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltbed.llm.shingles import MinHash, shingle_sets

        hashes = MinHash(K)
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for own in shingle_sets(batch.column("text")):
                sizes.append(len(own))
                digests.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                sigs.append(hashes.signature(own).view(np.int32) if len(own) else None)
            flat = np.concatenate([x for x in sigs if x is not None] or [np.zeros(0, np.int32)])
            cut = np.append(0, np.cumsum([0 if x is None else K for x in sigs])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat), mask=pa.array([x is None for x in sigs], pa.bool_())) if sigs else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SIGNED)


def posted(classes: DataFrame) -> DataFrame:
    """rep, n, sig and posts (c, key: size and pair of a posting) of each class that may have a partner."""
    value = F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)
    tokens = classes.select("rep", "n", F.posexplode("sig").alias("j", "v")).select("rep", "n", (F.shiftleft(F.col("j").cast("long"), 32) + value).alias("key"))
    # Written, so that the join below it may split a common value's rows among tasks.
    shared = written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    posts = tokens.join(shared, "key").groupBy("rep").agg(F.collect_set(F.struct("c", "key")).alias("posts")).where(F.size("posts") >= MATCHES)
    posts = posts.withColumn("posts", F.slice(F.sort_array("posts"), F.lit(1), F.size("posts") - (MATCHES - 1)))
    return classes.select("rep", "n", "sig").join(posts, "rep")


def full_sets(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rep, shingles: the sets of documents with these ids, and of a few others that the filter lets pass."""
    wanted = IdFilter(ids, FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltbed.llm.shingles import shingle_sets

        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column("p").to_numpy())))
            sets = list(shingle_sets(batch.column("text")))
            cut = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            flat = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["rep", "shingles"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), wanted.place(docs[doc_id].cast("long")).alias("p")).where("doc_id is not null")
    return rows.mapInArrow(run, "rep bigint, shingles array<bigint>").join(ids, F.col("rep") == F.col("id"), "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return rows.where(100 * F.col("both") >= SIMILAR * (F.col("sum") - F.col("both"))).select("a", "b")


def _sizes_fit(m, n):
    return 100 * F.least(m, n) >= SIMILAR * F.greatest(m, n)


def _could_share(m, sum_of_sizes):
    """Whether sets that share m at most can be similar enough: intersection >= SIMILAR % of (sum of sizes - intersection)."""
    return (100 + SIMILAR) * m >= SIMILAR * sum_of_sizes


def shared_shingles(sets: DataFrame) -> DataFrame:
    """rep, m, early: how many shingles of each set another set has too, and the rarest of them.

    No pair shares more than the lesser m. Ordered by rarity, a set's own shingles alone come first, then these; similar
    sets have one in common among the first (size - intersection + 1) of each, which early covers for any partner."""
    each = sets.select("rep", F.explode("shingles").alias("x"))
    twice = each.groupBy("x").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("x", "c")
    own = each.join(written(twice, "twice"), "x").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("c", "x"))).alias("own"))
    sizes = sets.groupBy("rep").agg(F.max(F.size("shingles")).alias("n"))
    reach = F.floor(F.col("n") * (100 - SIMILAR) / 100) + 1 - (F.col("n") - F.size("own"))
    early = F.transform(F.slice("own", F.lit(1), F.greatest(reach, F.lit(0)).cast("int")), lambda o: o["x"])
    return own.join(sizes, "rep").select("rep", F.size("own").alias("m"), early.alias("early"))


def star_pairs(posts: DataFrame) -> DataFrame:
    """Each class with its postings' centres, the members with the greatest share of common shingles, if enough values collide."""
    members = posts.select("rep", "n", "m", "sig", F.explode(F.transform("posts", lambda p: p["key"])).alias("key"))
    centres = written(members.groupBy("key").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("rep")).alias("low"), "n", "m")).alias("x")).select("key", (-F.col("x.low")).alias("a"), F.col("x.n").alias("n_a"), F.col("x.m").alias("m_a")), "centres")
    pairs = members.join(centres, "key").where(F.col("a") != F.col("rep")).where(_sizes_fit(F.col("n_a"), F.col("n")) & _could_share(F.least("m", "m_a"), F.col("n") + F.col("n_a")))
    pairs = pairs.groupBy("a", F.col("rep").alias("b")).agg(F.first("sig").alias("sig_b"))
    pairs = pairs.join(posts.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return pairs.where(same >= MATCHES).select("a", "b")


def rest_pairs(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of classes in different components that share a posting, enough values, and could share enough shingles.

    Classes in postings that hold more than one component are dealt by their early shingles. Of two similar sets the
    smaller one has a common shingle among its first (its size - least intersection with an equal size + 1); only shingles
    that some class has there and that more than one component has keep their rows."""
    own = posts.join(labels, posts["rep"] == labels["node"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    members = own.select("rep", "comp", F.explode(F.transform("posts", lambda p: p["key"])).alias("key"))
    mixed = written(members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
    open_ = members.join(mixed, "key").select("rep").distinct()
    early = own.join(open_, "rep").select("rep", "comp", "n", "m", F.posexplode("early").alias("i", "x"))
    rows = early.select("rep", "comp", "n", "m", "x", (F.col("n") - F.col("m") + F.col("i")).alias("place"))
    first = F.col("place") <= F.col("n") - F.ceil(2 * SIMILAR * F.col("n") / (100 + SIMILAR))
    rows = written(rows.withColumn("first", first), "early")
    by = rows.groupBy("x", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("first").alias("first"))
    by = by.groupBy("x").agg(F.sum("c").alias("every"), F.max(F.struct("c", "comp")).alias("most"), F.max("first").alias("first")).where("first").where(F.col("every") > F.col("most.c"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    by = written(by.select("x", "every", F.col("most.comp").alias("main"), blocks(F.col("every")).alias("wide"), blocks(F.col("every") - F.col("most.c")).alias("high")), "shingles")
    rows = rows.join(by.drop("every"), "x").withColumn("outside", F.col("comp") != F.col("main")).withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
    left = rows.where("outside").select("*", (F.col("h") % F.col("high")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(True).alias("asks"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), (F.col("h") % F.col("wide")).cast("int").alias("j"), F.lit(False).alias("asks"))

    def met(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in cols}
        order = np.lexsort((col["j"], col["i"], col["x"]))
        col = {c: v[order] for c, v in col.items()}
        cell = np.cumsum(np.append(0, (col["x"][1:] != col["x"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])))
        q, r = np.flatnonzero(col["asks"]), np.flatnonzero(~col["asks"])
        start, end = np.searchsorted(cell[r], cell[q], "left"), np.searchsorted(cell[r], cell[q], "right")
        sums = np.cumsum(end - start)
        found, lo = [np.zeros((2, 0), np.int64)], 0
        while lo < len(q):  # some pairs of rows at a time
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PAIRS, "right")))
            n = (end - start)[lo:hi]
            x, y = np.repeat(q[lo:hi], n), r[np.repeat(end[lo:hi] - np.cumsum(n), n) + np.arange(n.sum())]
            own, other = {c: v[x] for c, v in col.items()}, {c: v[y] for c, v in col.items()}
            least = -(-SIMILAR * (own["n"] + other["n"]) // (100 + SIMILAR))  # of an intersection
            ok = (own["comp"] != other["comp"]) & (np.minimum(own["m"], other["m"]) >= least) & (~other["outside"] | (other["rep"] > own["rep"]))
            ok &= (100 * np.minimum(own["n"], other["n"]) >= SIMILAR * np.maximum(own["n"], other["n"])) & (own["place"] <= own["n"] - least) & (other["place"] <= other["n"] - least)
            both = np.stack([own["rep"][ok], other["rep"][ok]])
            found.append(np.unique(np.sort(both, 0), axis=1))
            lo = hi
        got = np.concatenate(found, 1)
        return pa.table({"a": got[0], "b": got[1]})

    cols = ["x", "i", "j", "asks", "outside", "rep", "comp", "n", "m", "place"]
    rows = left.select(cols).unionByName(right.select(cols))
    # Many small postings are handled at once: the rows of about CELLS of them, or of a block of a large one.
    size = by.agg(F.sum(F.col("every") * (F.col("wide") + F.col("high"))).alias("n")).first().n or 0
    rows = rows.withColumn("group", F.pmod(F.xxhash64("x", "i", "j"), F.lit(max(64, size // CELLS))))
    pairs = rows.groupBy("group").applyInArrow(met, "a bigint, b bigint").distinct()
    a, b = (posts.groupBy(F.col("rep").alias(x)).agg(F.first("sig").alias(f"sig_{x}")) for x in "ab")
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "a").join(b, "b").where(same >= MATCHES).select("a", "b")


def repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that occur with more than one set. rows: doc_id, digest."""
    twice = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    reps = rows.join(twice, "doc_id").join(classes.select("digest", "rep"), "digest").groupBy("doc_id").agg(F.collect_set("rep").alias("reps"))
    return reps.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a < b")


def classes_components(docs: DataFrame, one: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """r, lowest: the smallest id reachable from each class that has links. one: doc_id and digest of documents with words."""
    posts = written(posted(classes), "posts")
    sets = written(full_sets(docs, posts.select(F.col("rep").alias("id")), doc_id, text), "sets")
    # Classes without early shared shingles have no partner.
    posts = written(posts.join(shared_shingles(sets).where(F.size("early") > 0), "rep"), "posts")
    first = components(confirmed(star_pairs(posts), sets).unionByName(repeated_ids(one, classes)))
    more = written(confirmed(rest_pairs(posts, first), sets), "more")
    # Links between components join whole components: the graph of the second round has components as nodes.
    label = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    lifted = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    second = components(lifted).select(F.col("node").alias("low"), F.col("component").alias("lowest"))
    nodes = posts.select("rep").union(first.select("node")).distinct().join(first, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("low"))
    return written(nodes.join(second, "low", "left").select(F.col("rep").alias("r"), F.coalesce("lowest", "low").alias("lowest")).distinct(), "nodes", outer=True)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = written(signed(docs, doc_id, text), "signed")
    one = rows.where("digest is not null and doc_id is not null")
    classes = one.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "sig"), "doc_id").alias("x")).select("digest", "rep", "x.n", "x.sig")
    classes = written(classes, "classes")
    with scratch(docs.sparkSession):
        nodes = classes_components(docs, one, classes, doc_id, text)
    out = rows.join(classes.select("digest", "rep"), "digest", "left").join(nodes, F.col("rep") == F.col("r"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= {SIMILAR} * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, any_value(len(sh))::bigint AS n_shingles, min(r.id) AS component_id, s.doc_id = min(r.id) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""
