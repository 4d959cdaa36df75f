"""Rank correlation and thresholds against human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import stripped
from loomlake.operators.shards import prefix_sums


def long_pairs(df: DataFrame, metrics: list[str], label: str) -> DataFrame:
    """(metric, x, y) for each metric that a row has, where it has a label too."""
    pairs = F.explode(F.create_map(*[v for m in metrics for v in (F.lit(m), F.col(m).cast("double"))]))
    return df.filter(F.col(label).isNotNull()).select(pairs.alias("metric", "x"), F.col(label).cast("double").alias("y")).filter("x is not null")


def value_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks of the distinct values of a column within keys.

    Rows are counted by value first, so the running sum sees one row a distinct value.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = prefix_sums(counts, keys, [F.col(value)], {"_n": "_upto"})
    return run.select(*keys, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def spearman(pairs: DataFrame) -> DataFrame:
    """n and Spearman's rank correlation by metric of (metric, x, y), to four digits; null without variance."""
    rows = pairs.groupBy("metric", "x", "y").agg(F.count("*").alias("k"))
    rx = value_ranks(pairs, ["metric"], "x", "rx")
    ry = value_ranks(pairs, ["metric"], "y", "ry")
    met = rows.join(rx, ["metric", "x"]).join(ry, ["metric", "y"])
    n, k = F.sum("k").cast("double"), F.col("k")
    s = lambda c: F.sum(c)
    sums = met.groupBy("metric").agg(n.alias("m"), s(k * F.col("rx")).alias("sx"), s(k * F.col("ry")).alias("sy"), s(k * F.col("rx") * F.col("ry")).alias("sxy"), s(k * F.col("rx") * F.col("rx")).alias("sxx"), s(k * F.col("ry") * F.col("ry")).alias("syy"))
    cov = F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("m") * F.col("syy") - F.col("sy") * F.col("sy"))
    return sums.select("metric", F.col("m").cast("long").alias("n"), F.round(F.try_divide(cov, F.sqrt(F.when(var > 0, var))), 4).alias("spearman"))


def f1_curve(pairs: DataFrame) -> DataFrame:
    """For each metric and candidate threshold: precision, recall and F1 of x >= threshold against y = 1."""
    at = pairs.groupBy("metric", "x").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    total = pairs.groupBy("metric").agg(F.sum("y").alias("all_pos"), F.count("*").alias("all_n"))
    run = prefix_sums(at, ["metric"], [F.desc("x")], {"n": "taken", "pos": "hits"})
    both = run.join(total, "metric").filter("all_pos > 0 and all_pos < all_n")
    p, r = F.col("hits") / F.col("taken"), F.col("hits") / F.col("all_pos")
    return both.select("metric", F.col("x").alias("threshold"), p.alias("precision"), r.alias("recall"), (2 * F.col("hits") / (F.col("taken") + F.col("all_pos"))).alias("f1"))


def suggest_threshold(pairs: DataFrame, *, ties: str = "lowest") -> DataFrame:
    """The threshold of each metric with the best F1; a metric with one class only has nulls.

    ties: 'lowest' takes the lowest of equal thresholds. 'rounded' walks thresholds upwards and compares
    each F1 with the best so far as rounded to four digits, so which of equal ones wins depends on how
    they round.
    """
    curve = f1_curve(pairs)
    names = pairs.select("metric").distinct()
    if ties == "lowest":
        best = curve.groupBy("metric").agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    elif ties == "rounded":
        # The best as rounded never falls, as rounding keeps order: it is the largest rounded F1 up to there. So the
        # walk ends at the last threshold above the largest of all, else at the first that rounds to it.
        one, grid = F.struct("threshold", "precision", "recall", "f1"), F.round("f1", 4)
        cells = curve.groupBy("metric", grid.alias("g")).agg(F.min_by(one, "threshold").alias("first"), F.max_by(one, F.when(F.col("f1") > grid, F.col("threshold"))).alias("last"))
        best = cells.groupBy("metric").agg(F.max_by(F.coalesce("last", "first"), "g").alias("b"))
    else:
        raise ValueError(f"ties must be lowest or rounded, not {ties!r}")
    return names.join(best, "metric", "left").select("metric", F.col("b.threshold").alias("threshold"), *[F.round(F.col(f"b.{c}"), 4).alias(c) for c in ("precision", "recall", "f1")])


def correlate(df: DataFrame, metrics: list[str], label: str) -> DataFrame:
    """n, rank correlation and suggested threshold of every metric; a metric without pairs has n = 0 and nulls."""
    pairs = long_pairs(df, metrics, label)
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    return names.join(spearman(pairs), "metric", "left").join(suggest_threshold(pairs), "metric", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def labelled(df: DataFrame, metrics: list[str], label: str = "human_good") -> DataFrame:
    """A label sheet read as text: rows with a label, metrics as numbers, '' and 'None' as null."""
    number = lambda c: F.expr(f"try_cast(nullif(nullif(trim(`{c}`), ''), 'None') as double)")
    kept = df.filter(stripped(F.col(label)) != "")
    return kept.withColumns({m: number(m) for m in metrics} | {label: F.col(label).cast("double").cast("int")})

