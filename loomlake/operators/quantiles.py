"""Exact interpolated percentiles of groups of any size, by counting passes over narrowing ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
CELLS = 1024


def quantiles(df: DataFrame, key: str | None, groups: list, value: str, names: dict[str, float]) -> DataFrame:
    """(key, one column a name): linear interpolation between the two values next to the place of each share.

    groups: the values of key that are wanted, a list that the caller knows; without a key the result is one row.
    Three passes read the column, all within one plan. A sketch of bounded size brackets each place by two values;
    counts over cells of the bracket, beside those below and above it, tell the cells that the place falls in; the
    distinct values of these are counted and walked. Only counts and brackets move, and the tables that are broadcast
    have a row for each group and name. The sketch decides how much is left to the last pass, never the result.
    Each pass must read the same values to the last bit; sums of floating point over shuffled rows are to be written first.
    Null values are left out, NaN is above all others; a group without values has no row.
    """
    of = F.col(key) if key else F.lit(0)
    base = df.filter(F.col(value).isNotNull()).select(of.alias("k"), F.col(value).cast("double").alias("v"))
    if key:
        base = base.filter(F.col("k").isin(groups))
    wide = 4 / ACCURACY
    shares = [min(1.0, max(0.0, p + d)) for p in names.values() for d in (-wide, wide)]
    sketch = base.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("v", shares, ACCURACY).alias("c"))
    places = []
    for i, p in enumerate(names.values()):
        at = F.lit(p) * (F.col("n") - 1)
        places.append(F.struct(F.lit(i).alias("place"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"), F.col("c")[2 * i].alias("least"), F.col("c")[2 * i + 1].alias("most")))
    brackets = sketch.select("k", F.inline(F.array(*places)))
    within = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("least"), F.col("most") - F.col("least")) * CELLS).cast("int"), F.lit(0))
    cell = F.when(F.col("v") < F.col("least"), -1).when(F.col("v") > F.col("most"), CELLS + 1).otherwise(within)
    known = ["k", "place", "low", "high", "part"]
    cells = base.join(F.broadcast(brackets), "k").groupBy(*known, cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    run = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "place").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    met = run.filter((F.col("upto") > F.col("low")) & (F.col("upto") - F.col("n") <= F.col("high")))
    chosen = met.groupBy(*known).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.col("upto") - F.col("n")).alias("before"))
    left = base.join(F.broadcast(chosen), "k").filter(F.col("v").between(F.col("least"), F.col("most")))
    counts = left.groupBy(*known, "before", "v").agg(F.count("*").alias("n"))
    listed = counts.groupBy(*known, "before").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("s"))
    none = F.lit(None).cast("double")

    def step(state, x):  # noqa: ANN001, ANN202
        upto = state["upto"] + x["n"]
        pick = lambda c: F.when(state[c].isNull() & (F.col(c) < upto), x["v"]).otherwise(state[c]).alias(c)
        return F.struct(upto.alias("upto"), pick("low"), pick("high"))

    found = listed.select("k", "place", "part", F.aggregate("s", F.struct(F.col("before").alias("upto"), none.alias("low"), none.alias("high")), step).alias("w"))
    between = F.col("w.low") + (F.col("w.high") - F.col("w.low")) * F.col("part")
    out = found.groupBy("k").agg(*(F.max(F.when(F.col("place") == i, between)).alias(name) for i, name in enumerate(names)))
    return out.withColumnRenamed("k", key) if key else out.drop("k")
