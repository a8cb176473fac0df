"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

A document's size is its words. Sources, by name, weigh 3, 1, 2, 3, 1, 2, ... and share 150 % of all words; a source's
target stops at twice its own words and the excess is shared again by weight. A source whose target is r times its size
gives every document floor(r) certain whole copies; the rest of its target is a sample with unequal probabilities. A
document of b binary digits of size has the measure x = 2 ** floor(b / 2), about the root of its size, and is included
with probability p = min(1, rate * x): longer documents more often, the longest of a well-filled sample certainly. The
source's rate is such that the expected words of the sample are what is left of its target. Documents rank by random odds
over inclusion odds, (u / (1 - u)) / (p / (1 - p)), certain ones first, and the lowest ranks are taken while they fit
what is left: the sample's size in words is fixed, but for less than one document. One closing document of each source,
the one whose size comes nearest to the gap that remains, is added if that brings the source nearer to its target.

u comes from a hash of the document's id and text, so reruns agree on any partitioning. The cut between taken and left
is found without sorting a source: sizes are summed in 2^12 steps of rank, running sums over the steps find the one
step that holds the cut, and only its documents are ordered. A decision depends on a document's own values and on its
source's row in a small table of cuts, so texts never move.

Defined results: a null text has size 0; a null source is a source, the last; rows that agree in id and text share one
rank and are taken or left together; a corpus without words has targets of 0; an empty table gives an empty result.
The windows over sources and over a source's measures hold one row for each, so sources are bounded by one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.llm.common import WORD, documents, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
STEPS = 1 << 12
SPREAD = 64
SEED = "mix-1:"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def measure_of(size: Column) -> Column:
    """2 ** floor(binary digits / 2)."""
    return F.pow(F.lit(2.0), F.floor(F.length(F.bin(size)) / 2))


def uniform_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 from 52 bits of a digest of id and text."""
    own = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(own, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, from rows of source and size. The windows hold one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long"))
    by = by.withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    last = F.max(F.when(~F.col("capped"), F.struct(-F.col("ratio"), "level"))).over(every)["level"]  # at the lowest that isn't capped
    return by.withColumn("last", last).select("source", "source_size", F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("last")).alias("target"))


def with_plan(by: DataFrame, sizes: DataFrame) -> DataFrame:
    """by with the certain copies, the words that are left to sample, and the rate of inclusion per measure.

    The measures of a source descend; those whose documents would be included with more than certainty are certain, and
    the rate of the others makes up what these leave."""
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = by.withColumn("copies", F.floor(r).cast("long")).withColumn("left", F.col("target") - F.floor(r).cast("long") * F.col("source_size"))
    each = sizes.groupBy("source", measure_of(F.col("size")).alias("x")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy(F.col("x").desc())
    each = each.withColumn("above", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("below", F.sum(F.col("x") * F.col("words")).over(Window.partitionBy("source").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    each = each.join(by.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("below") > 0, F.greatest(F.col("left") - F.col("above"), F.lit(0.0)) / F.col("below")).otherwise(0.0)
    # The largest measure that is not certain; all smaller ones would give a higher rate, all larger ones more than certainty.
    rates = each.withColumn("rate", rate).where(F.col("rate") * F.col("x") <= 1).groupBy(F.col("source").alias("s")).agg(F.max_by("rate", "x").alias("rate"))
    return by.join(rates, by["source"].eqNullSafe(rates["s"]), "left").drop("s").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def inclusion_of(size: Column, rate: Column) -> Column:
    """The probability that a document of this size is sampled."""
    return F.least(F.lit(1.0), rate * measure_of(size))


def rank_of(u: Column, p: Column) -> Column:
    """Pareto's ranking variable q as q / (1 + q), which orders alike and lies between 0 and 1: 0 for certain documents."""
    q = F.when(p < 1, (u / (1 - u)) / F.when(p > 0, p / (1 - p)).otherwise(1.0)).otherwise(0.0)
    return q / (1 + q)


def with_source(rows: DataFrame, table: DataFrame, source: str, u: str) -> DataFrame:
    """rows with their source's row of a table, whose own key column is named _source. Each source is spread over SPREAD keys by a row's random number, so that no task gets all rows of one."""
    table = table.withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = rows.withColumn("_part", F.least(F.floor(F.col(u) * SPREAD), F.lit(SPREAD - 1)).cast("int"))
    return rows.join(table, rows[source].eqNullSafe(table["_source"]) & (rows["_part"] == table["_key"])).drop("_source", "_key", "_part")


def fit_cuts(rows: DataFrame, by: DataFrame) -> DataFrame:
    """by with cut (the highest rank that is taken) and closer (the closing document's rank). rows: source, size, u."""
    plan = by.select(F.col("source").alias("_source"), "rate", "left")
    ranked = with_source(rows, plan, "source", "u").withColumn("rank", rank_of(F.col("u"), inclusion_of(F.col("size"), F.col("rate"))))
    blocks = ranked.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    blocks = blocks.withColumn("step", F.floor(F.col("rank") * STEPS).cast("int"))
    steps = blocks.groupBy("source", "step").agg(F.sum("size").alias("size"), F.max("rank").alias("top"), F.first("left").alias("left"))
    w = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("after", F.sum("size").over(w))
    whole = steps.where(F.col("after") <= F.col("left")).groupBy("source").agg(F.max("top").alias("cut"), F.max("after").alias("sum"))
    edge = steps.where(F.col("after") > F.col("left")).groupBy(F.col("source").alias("es")).agg(F.min("step").alias("es_step"), F.min_by(F.col("after") - F.col("size"), "step").alias("before"))
    inner = blocks.join(edge, blocks["source"].eqNullSafe(edge["es"]) & (blocks["step"] == edge["es_step"]))
    inner = inner.withColumn("after", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    inner = inner.where(F.col("after") <= F.col("left")).groupBy("source").agg(F.max("rank").alias("cut"), F.max("after").alias("sum"))
    # A source whose very first blocks do not fit has no row in either.
    found = whole.unionByName(inner).groupBy(F.col("source").alias("c")).agg(F.max("cut").alias("cut"), F.max("sum").alias("sum"))
    cuts = by.join(found, by["source"].eqNullSafe(found["c"]), "left").drop("c").withColumn("cut", F.coalesce("cut", F.lit(-1.0))).withColumn("gap", F.col("left") - F.coalesce("sum", F.lit(0)))
    rest = with_source(blocks, cuts.select(F.col("source").alias("_source"), "cut", "gap"), "source", "rank").where((F.col("rank") > F.col("cut")) & (F.abs(F.col("gap") - F.col("size")) < F.col("gap")))
    close = rest.groupBy(F.col("source").alias("z")).agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank"))["rank"].alias("closer"))
    return cuts.join(close, cuts["source"].eqNullSafe(close["z"]), "left").drop("z", "sum", "gap", "left")


def with_copies(docs: DataFrame, cuts: DataFrame, u: Column, size: Column, source: str = "source") -> DataFrame:
    """docs with n_copies, the whole copies that the mix takes, and their source's size and target."""
    cuts = cuts.withColumnRenamed("source", "_source").withColumnsRenamed({c: f"_{c}" for c in ("copies", "rate", "cut", "closer", "source_size", "target")})
    out = with_source(docs.withColumn("_u", u).withColumn("_size", size), cuts, source, "_u")
    rank = rank_of(F.col("_u"), inclusion_of(F.col("_size"), F.col("_rate")))
    more = (rank <= F.col("_cut")) | F.coalesce(rank == F.col("_closer"), F.lit(False))
    return out.withColumn("n_copies", F.col("_copies") + F.when(F.col("_rate") > 0, more.cast("long")).otherwise(0)).drop("_u", "_size", "_copies", "_rate", "_cut", "_closer")


def fit(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): id, source, size and random number of every document, and the table of cuts."""
    rows = written(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), size_of(docs[text]).alias("size"), uniform_of(docs[doc_id], docs[text], seed).alias("u")), "sizes")
    by = written(with_plan(written(targets(rows), "targets"), rows), "plan")
    return rows, written(fit_cuts(rows, by), "cuts")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    rows, cuts = fit(documents(spark, sf_dir))
    out = with_copies(rows, cuts, F.col("u"), F.col("size"))
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("n_copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
  (('0x' || substr(md5('{SEED}' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce("text", ''))), 1, 13))::bigint + 0.5::double) / 4503599627370496::double AS u FROM documents),
b AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM b),
r AS (SELECT *, (2 * source_size)::double / weight AS ratio FROM w),
v AS (SELECT *, ({SHARE}::double * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER q, 0))::double / (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0))::double AS level
  FROM r WINDOW q AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN (2 * source_size)::double ELSE weight * (SELECT arg_min(level, ratio) FROM v WHERE ratio > level) END AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::double END AS x, floor(x)::bigint AS copies, target - copies * source_size AS rest FROM t),
x AS (SELECT source, pow(2::double, length(bin(size)) // 2) AS m, sum(size) AS words FROM d GROUP BY ALL),
y AS (SELECT x.source, m, rest, coalesce(sum(words) OVER (PARTITION BY x.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(m * words) OVER (PARTITION BY x.source ORDER BY m ROWS UNBOUNDED PRECEDING) AS below
  FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source),
z0 AS (SELECT *, CASE WHEN below > 0 THEN greatest(rest - above, 0::double) / below ELSE 0 END AS rate FROM y),
rt AS (SELECT source, arg_max(rate, m) AS rate FROM z0 WHERE rate * m <= 1 GROUP BY source),
k AS (SELECT d.doc_id, d.size, p.*, coalesce(rt.rate, 0::double) AS rate, least(1::double, coalesce(rt.rate, 0::double) * pow(2::double, length(bin(d.size)) // 2)) AS incl,
  CASE WHEN incl < 1 THEN (u / (1 - u)) / CASE WHEN incl > 0 THEN incl / (1 - incl) ELSE 1 END ELSE 0 END AS q, q / (1 + q) AS rnk
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN rt ON d.source IS NOT DISTINCT FROM rt.source),
g AS (SELECT source, rnk, sum(size) AS bsize, any_value(rest) AS rest FROM k GROUP BY source, rnk),
c AS (SELECT *, sum(bsize) OVER (PARTITION BY source ORDER BY rnk ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM g),
h AS (SELECT source, coalesce(max(rnk) FILTER (fits), -1) AS cut, any_value(rest) - coalesce(sum(bsize) FILTER (fits), 0) AS gap FROM c GROUP BY source),
z AS (SELECT c.source, arg_min(rnk, (abs(gap - bsize), rnk)) AS closer FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE rnk > cut AND abs(gap - bsize) < gap GROUP BY c.source)
SELECT k.doc_id, k.size, k.source_size, k.target, (k.size * (copies + CASE WHEN rate > 0 AND (rnk <= cut OR coalesce(rnk = closer, false)) THEN 1 ELSE 0 END))::bigint AS taken
FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source LEFT JOIN z ON k.source IS NOT DISTINCT FROM z.source
"""
