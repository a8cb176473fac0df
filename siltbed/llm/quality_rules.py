"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Base rules look at a text's own counts. On top, each of four ratios (symbols, capitals, repeated words, repeated lines)
may reject what exceeds a cutoff, chosen per stratum (language) from labelled documents. A cutoff is allowed only if an
exact binomial test refutes that it rejects more than ALPHA / 4 of the good documents of its stratum; the tests of a
ratio run from its loosest cutoff on and end at the first that fails (a fixed sequence, which needs no correction of its
own), at level DELTA shared out evenly over all pairs of stratum and ratio (Bonferroni). So with probability 1 - DELTA no
stratum loses more than ALPHA of its good documents to all cutoffs together. Of the allowed cutoffs the loosest with the
best balance of bad against good documents is taken; where labels are too few to prove anything, nothing is rejected.

A trial is a distinct text under a distinct id: rows that repeat an id or a text count once, whatever their number, as
they prove no more than one does. One pass over the texts; what is shuffled is a few numbers per labelled document.

Defined results: a null text has no words and fails the base rules; a null language is a stratum of its own; rows with a
null doc_id are judged but calibrate nothing; repeated rows are judged each; a document labelled both good and bad, or a text that occurs under
labels of both kinds, counts as bad; of an id with several texts one calibrates; an empty table or no labels leave the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.llm.common import documents, written

#: Least words, and most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
ALPHA, DELTA = 0.05, 0.05
#: A good document lost weighs as much as so many bad ones caught.
PRICE = 10
#: Cutoffs of each ratio, from loose to strict.
GRID = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03),
    "capitals": (0.8, 0.6, 0.5, 0.4, 0.3),
    "repeats": (0.5, 0.4, 0.3, 0.2, 0.1),
    "lines": (0.8, 0.5, 0.3, 0.2, 0.1),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the text's digest and counts as columns, base_failed, and the ratios that cutoffs hold for as r_*.

    Windows are compared as whole strings; only texts that hold a window twice are sorted to mark all its places.
    Write the result before filtering by these columns: a filter pushed below them would split a text anew per window.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    out = out.withColumns({
        "digest": F.md5(t.cast("binary")),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "_capitals": F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long"),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_windows": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))),
    })
    out = out.withColumns({
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))),
    })
    same = lambda x, j: F.coalesce(x["w"] == F.get("_sorted", j)["w"], F.lit(False))
    marked = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    out = out.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(marked, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0)).cast("long"))
    out = out.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long")))
    return out.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "r_symbols": _ratio("n_symbols", "word_chars"),
        "r_capitals": _ratio("_capitals", "word_chars"),
        "r_repeats": _ratio("n_repeat_words", "n_words"),
        "r_lines": _ratio("n_dup_lines", "_n_lines"),
    }).drop("_words", "_capitals", "_lines", "_windows", "_n_lines", "_sorted")


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight places up, where it holds to about 1e-13."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to terms below 1e-300 of the largest; 1 where k exceeds the mean."""
    n_, low = n.cast("double"), F.greatest(F.lit(0), (k - 40 * F.sqrt(n * p) - 40).cast("long"))
    term = lambda i: F.exp(log_gamma(n_ + 1) - log_gamma(i + 1) - log_gamma(n_ - i + 1) + i * F.log(F.lit(p)) + (n_ - i) * F.log(F.lit(1 - p)))
    total = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda acc, i: acc + term(i.cast("double")))
    return F.when(k > n * p, 1.0).otherwise(total)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per stratum and ratio with an allowed cutoff: stratum, rule, cutoff. stats: doc_id, digest, stratum, base_failed, r_*."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = stats.join(labels, "doc_id").where(~F.col("base_failed"))
    # Each text once, then each id once.
    ratios = [f"r_{rule}" for rule in GRID]
    seen = seen.groupBy("digest", stratum).agg(F.min("quality").alias("quality"), F.min("doc_id").alias("doc_id"), *(F.max(r).alias(r) for r in ratios))
    seen = seen.groupBy("doc_id", stratum).agg(F.min("quality").alias("quality"), F.min_by(F.struct(*ratios), "digest").alias("_x")).select(stratum, "quality", "_x.*")
    good, bad = F.col("quality") == 1, F.col("quality") != 1
    tests = [(rule, i, cut) for rule, cuts in GRID.items() for i, cut in enumerate(cuts)]
    sums = {f"{kind}_{rule}_{i}": F.count_if(which & (F.col(f"r_{rule}") > cut)) for rule, i, cut in tests for kind, which in (("good", good), ("bad", bad))}
    by = seen.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if(good).alias("n"), *(c.alias(name) for name, c in sums.items()))
    rows = by.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cutoff"), F.col(f"good_{rule}_{i}").alias("good"), F.col(f"bad_{rule}_{i}").alias("bad")) for rule, i, cut in tests))).alias("x")).select("stratum", "n", "x.*")
    pairs = by.agg((F.count(F.lit(1)) * len(GRID)).alias("pairs"))
    rows = rows.join(F.broadcast(pairs))  # one row
    rows = rows.withColumn("passed", (F.col("n") > 0) & (binomial_tail(F.col("good"), F.col("n"), ALPHA / len(GRID)) <= DELTA / F.col("pairs")))
    each = Window.partitionBy("stratum", "rule")
    rows = rows.withColumn("allowed", F.min(F.col("passed").cast("int")).over(each.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    gain = F.col("bad") - PRICE * F.col("good")
    # Written, so that its size is known where documents are joined to it, and their texts need not move.
    return written(rows.where("allowed").where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, -F.col("i"))).alias("cutoff")), "cutoffs")


def with_verdict(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with kept: not base_failed and no ratio above its stratum's cutoff."""
    by = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_cut_{rule}") for rule in GRID))
    over = F.lit(False)
    for rule in GRID:
        over |= F.coalesce(F.col(f"r_{rule}") > F.col(f"_cut_{rule}"), F.lit(False))
    by = by.withColumnRenamed("stratum", "_stratum")
    return stats.join(by, stats[stratum].eqNullSafe(by["_stratum"]), "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *(f"_cut_{rule}" for rule in GRID))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    ratios = [f"r_{rule}" for rule in GRID]
    stats = written(with_stats(documents(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "lang", "digest", *STATS, "base_failed", *ratios), "stats")
    cutoffs = fit_cutoffs(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_verdict(stats, cutoffs).select("doc_id", *STATS, "base_failed", "kept")


def _oracle() -> str:
    tests = ", ".join(f"('{rule}', {i}, {cut!r}::double)" for rule, cuts in GRID.items() for i, cut in enumerate(cuts))
    p, pick = ALPHA / len(GRID), "CASE rule " + " ".join(f"WHEN '{rule}' THEN r_{rule}" for rule in GRID) + " END"
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce("text", '') AS t, regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS x FROM l, unnest(range(1, n_words - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) AS v(j) GROUP BY doc_id),
s AS (SELECT l.doc_id, lang, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words, len(ls) AS n_lines, capitals
  FROM l LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols::double / word_chars ELSE 0 END AS r_symbols, CASE WHEN word_chars > 0 THEN capitals::double / word_chars ELSE 0 END AS r_capitals,
  CASE WHEN n_words > 0 THEN n_repeat_words::double / n_words ELSE 0 END AS r_repeats, CASE WHEN n_lines > 0 THEN n_dup_lines::double / n_lines ELSE 0 END AS r_lines FROM s),
dig AS (SELECT doc_id, md5(t) AS digest FROM w),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid AS (SELECT * FROM (VALUES {tests}) AS g(rule, i, cutoff)),
one AS (SELECT lang, digest, min(quality) AS quality, min(doc_id) AS doc_id, any_value(r_symbols) AS r_symbols, any_value(r_capitals) AS r_capitals, any_value(r_repeats) AS r_repeats, any_value(r_lines) AS r_lines
  FROM r JOIN lab USING (doc_id) JOIN dig USING (doc_id) WHERE NOT base_failed GROUP BY lang, digest),
cnt AS (SELECT lang, rule, i, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {pick} > cutoff) AS good, count(*) FILTER (quality <> 1 AND {pick} > cutoff) AS bad FROM one, grid GROUP BY ALL),
tst AS (SELECT *, n > 0 AND CASE WHEN good > n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln({p!r}) + (n - k) * ln({1 - p!r})))) END
  <= {DELTA} / (SELECT {len(GRID)} * count(DISTINCT coalesce(lang, chr(1))) FROM cnt) AS passed FROM cnt),
alw AS (SELECT *, min(passed::int) OVER (PARTITION BY lang, rule ORDER BY i) = 1 AS allowed, bad - {PRICE} * good AS gain FROM tst),
cut AS (SELECT lang, rule, arg_max(cutoff, gain * 1000 - i) AS cutoff FROM alw WHERE allowed AND gain > 0 GROUP BY lang, rule),
over_ AS (SELECT DISTINCT doc_id FROM r JOIN cut ON r.lang IS NOT DISTINCT FROM cut.lang WHERE {pick} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over_.doc_id IS NULL AS kept FROM r LEFT JOIN over_ USING (doc_id)
"""


ORACLE = _oracle()
