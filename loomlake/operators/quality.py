"""Quality gates, safety levels, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.operators.quantiles import quantiles


def nsfw_label(p: Column) -> Column:
    return F.when(p.isNull(), "unknown").when(p >= V.NSFW_BLOCKED, "blocked").when(p >= V.NSFW_REVIEW, "review").otherwise("ok")


def safety(p: Column) -> Column:
    """Safety block of a record from its NSFW probability; blocked only by the label."""
    kind = nsfw_label(p)
    # The names of the checks that are made and of those that are still to come.
    made, pending = ["nsfw"], ["csam_hash", "pii_scan"]
    return F.struct(
        p.alias("nsfw"), kind.alias("nsfw_label"), (kind == "blocked").alias("release_blocked"), kind.isin("review", "blocked").alias("needs_review"),
        F.array(*[F.lit(x) for x in made]).alias("checks_applied"), F.array(*[F.lit(x) for x in pending]).alias("checks_pending"),
    )


def gate_reasons(clip: Column, aesthetic: Column, faithfulness: Column, nsfw: Column, blocked: Column, duplicate: Column, **limits: float) -> Column:
    """Why a record fails the gate, in a fixed order; a missing metric never counts against it."""
    t = V.GATE | limits
    unknown = set(t) - set(V.GATE)
    if unknown:
        raise ValueError(f"no such limits: {sorted(unknown)}")
    tests = [
        (duplicate, "duplicate"), (clip < t["clip_min"], "low_clip"), (aesthetic < t["aesthetic_min"], "low_aesthetic"),
        (faithfulness < t["faithfulness_min"], "low_faithfulness"), (nsfw > t["nsfw_max"], "nsfw"), (blocked, "release_blocked"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in tests]))


def passed(reasons: Column) -> Column:
    return F.size(reasons) == 0


def merge_evaluation(df: DataFrame, quality: str, safety_block: str, split: str, duplicate: str, *, failed: str | None = None, **limits: float) -> DataFrame:
    """Write the results of an evaluation into the dataset block; what else it holds stays.

    failed: a boolean column of records that could not be evaluated; they get the reason eval_failed.
    """
    q, s, d = F.col(quality), F.col(safety_block), F.col(duplicate)
    reasons = gate_reasons(q["clip_score"], q["aesthetic"], q["faithfulness"], s["nsfw"], s["release_blocked"], d, **limits)
    if failed:
        reasons = F.concat(reasons, F.when(F.col(failed), F.array(F.lit("eval_failed"))).otherwise(F.array().cast("array<string>")))
    block = F.col("dataset").withField("split", F.col(split))
    block = block.withField("safety", s.withField("is_duplicate", d)).withField("quality", q.withField("passed_gate", passed(reasons)).withField("gate_reasons", reasons))
    return df.withColumn("dataset", block)


def per_image_total(images: Column, field: str, how: str = "mean") -> Column:
    """Mean or maximum of a field over images that have it, to four digits; null without any."""
    found = F.array_compact(F.transform(images, lambda i: i[field]))
    if how == "max":
        return F.round(F.array_max(found), 4)
    return F.round(F.try_divide(F.aggregate(found, F.lit(0.0), lambda t, x: t + x), F.size(found).cast("double")), 4)


def distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """n, mean, p10, p50, p90, min and max of each metric column, nulls left out; one row a metric."""
    long = df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    plain = long.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"))
    places = quantiles(long, "metric", metrics, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return plain.join(places, "metric", "left").select("metric", "n", "mean", *(F.round(p, 4).alias(p) for p in ("p10", "p50", "p90")), "min", "max")


def gate_counts(passed_gate: Column) -> list[Column]:
    return [F.count_if(passed_gate).alias("passed"), F.count_if(~passed_gate).alias("failed"), F.count_if(passed_gate.isNull()).alias("unknown")]


def by_stratum(df: DataFrame, stratum: str, gate: str, metrics: list[str]) -> DataFrame:
    """Size, gate pass rate and metric means of each stratum; records without a gate count as not passed."""
    name = F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("unknown")).alias("stratum")
    rate = F.round(F.count_if(F.col(gate)).cast("double") / F.count("*"), 4).alias("gate_pass_rate")
    return df.groupBy(name).agg(F.count("*").alias("n"), rate, *[F.round(F.avg(F.col(m).cast("double")), 4).alias(f"{m}_mean") for m in metrics])


def quality_report(df: DataFrame, stratum: str, gate: str, metrics: list[str]) -> DataFrame:
    """by_stratum and, in the row with a null stratum, the same over all records, with gate counts: one pass."""
    base = df.select(F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("unknown")).alias("stratum"), F.col(gate).alias("_gate"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return base.rollup("stratum").agg(F.count("*").alias("n"), *gate_counts(F.col("_gate")), *[F.round(F.avg(m), 4).alias(f"{m}_mean") for m in metrics])


def split_counts(df: DataFrame, split: str) -> DataFrame:
    """Rows by split; train, val and test are always there, unassigned only if it has rows."""
    spark = df.sparkSession
    have = df.groupBy(F.coalesce(F.col(split), F.lit("unassigned")).alias("split")).agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in V.SPLITS])).alias("split"))
    return names.join(have, "split", "full").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pack_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: gate counts, metric means, duplicates and blocked records of the dataset blocks."""
    q, s = F.col("dataset.quality"), F.col("dataset.safety")
    means = [F.round(F.avg(q[m]), 4).alias(f"{m}_mean") for m in metrics]
    return df.agg(F.count("*").alias("n"), *gate_counts(q["passed_gate"]), *means, F.count_if(s["is_duplicate"]).alias("n_duplicates"), F.count_if(s["release_blocked"]).alias("n_release_blocked"))

