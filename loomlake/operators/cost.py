"""Costs and latencies of stages, records and containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.functions.scalars import gpu_rate
from loomlake.functions.trace import telemetry_sum
from loomlake.operators.quantiles import quantiles
from loomlake.sources.staging import staged


def zero(c: object) -> object:
    return F.coalesce(c, F.lit(0.0))


def stage_facts(records: DataFrame) -> DataFrame:
    """One row a record and stage of its telemetry."""
    return records.select("id", F.explode("telemetry").alias("stage", "t")).select("id", "stage", "t.*")


def stage_costs(facts: DataFrame) -> DataFrame:
    """Latency, tokens and cost of each stage in canonical order; a stage without rows has zeros."""
    names = facts.sparkSession.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(n).alias("label")) for s, n in V.STAGE_LABELS.items()])).alias("ord", "s")).select("ord", "s.*")
    found = facts.groupBy("stage").agg(
        F.avg("compute_s").alias("compute_s_mean"), F.avg("output_tokens").alias("output_tokens_mean"), F.avg("projected_cost_usd").alias("cost_mean"), F.sum("projected_cost_usd").alias("cost_total"),
        F.sum("retries").alias("retries"),
    )
    found = found.join(quantiles(facts, "stage", list(V.STAGE_LABELS), "compute_s", {"compute_s_p50": 0.5, "compute_s_p90": 0.9}), "stage", "left")
    values = [zero(F.col(c)).alias(c) for c in ("compute_s_mean", "compute_s_p50", "compute_s_p90", "output_tokens_mean", "cost_mean", "cost_total")]
    return names.join(found, "stage", "left").select("ord", "stage", "label", *values, F.coalesce("retries", F.lit(0)).cast("long").alias("retries"))


def record_totals(records: DataFrame) -> DataFrame:
    """Per record: reasoning and end-to-end time and cost, over all stages that it has."""
    compute, cost = telemetry_sum("compute_s"), telemetry_sum("projected_cost_usd")
    has = F.col("render").isNotNull()
    part = lambda f: F.when(has, zero(F.col(f"render.{f}"))).otherwise(0.0)
    return records.select(
        "id", compute.alias("reasoning_s"), cost.alias("reasoning_usd"), has.alias("has_render"), part("compute_s").alias("render_s"), part("projected_cost_usd").alias("render_usd"),
        telemetry_sum("retries").cast("long").alias("retries"), telemetry_sum("output_tokens").cast("long").alias("output_tokens"),
        F.nullif(F.col("meta.created_at"), F.lit("")).alias("created_at"), F.col("final_image").isNotNull().alias("has_image"),
    )


def cost_summary(totals: DataFrame) -> DataFrame:
    """One row over record_totals: reasoning, render and end-to-end means and sums, latencies and projections.

    Totals are written first: where they are sums of floating point over shuffled rows, each reading would add them up
    in another order, and the passes of the percentiles would miss the values that the pass before has bracketed.
    """
    t = totals.withColumn("e2e_s", F.col("reasoning_s") + F.col("render_s")).withColumn("e2e_usd", F.col("reasoning_usd") + F.col("render_usd"))
    t = staged(t, "totals")
    mean = zero(F.avg("e2e_usd"))
    places = {f"e2e_s_p{p}": p / 100 for p in (50, 90, 99)}
    found = t.agg(
        F.count("*").alias("n"), F.count_if("has_image").alias("n_with_image"), F.min("created_at").alias("date_from"), F.max("created_at").alias("date_to"),
        zero(F.avg("reasoning_s")).alias("reasoning_s_mean"), zero(F.avg("reasoning_usd")).alias("reasoning_usd_mean"), zero(F.sum("reasoning_usd")).alias("reasoning_usd_total"),
        F.count_if("has_render").alias("n_rendered"), zero(F.avg(F.when(F.col("has_render"), F.col("render_s")))).alias("render_s_mean"), zero(F.avg(F.when(F.col("has_render"), F.col("render_usd")))).alias("render_usd_mean"),
        zero(F.sum("render_usd")).alias("render_usd_total"), mean.alias("e2e_usd_mean"), zero(F.sum("e2e_usd")).alias("e2e_usd_total"),
        *[(mean * k).alias(f"projected_{n}") for n, k in (("1k", 1e3), ("10k", 1e4), ("100k", 1e5), ("1m", 1e6))],
        zero(F.avg("e2e_s")).alias("e2e_s_mean"),
        F.sum("output_tokens").alias("tokens_total"), F.sum("retries").alias("total_retries"), F.try_divide(F.count_if(F.col("retries") == 0).cast("double"), F.count("*").cast("double")).alias("first_try_valid_rate"),
    )
    met = found.join(F.broadcast(quantiles(t, None, [], "e2e_s", places)), how="left")
    return met.select(*found.columns, *(zero(F.col(p)).alias(p) for p in places))


def histogram(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """(value, n) of a column; nulls count under `missing` or not at all."""
    c = F.col(column).cast("string")
    rows = df.select((F.coalesce(c, F.lit(missing)) if missing is not None else c).alias("value")).filter("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def histograms(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, value, n) of several columns of arrays of text in one pass; nulls count nowhere."""

    def named(name: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))

    each = [named(name, c) for name, c in values.items()]
    return df.select(F.inline(F.concat(*each))).filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))


def ledger_summary(runs: DataFrame) -> DataFrame:
    """Runs, cost and estimated real cost by kind, and over all in the row with a null kind."""
    base = runs.select(F.coalesce("kind", F.lit("?")).alias("kind"), zero(F.col("total_cost_usd")).alias("c"), zero(F.col("real_cost_est_usd")).alias("r"))
    return base.rollup("kind").agg(F.count("*").alias("n_runs"), F.round(F.sum("c"), 6).alias("total_cost_usd"), F.round(F.sum("r"), 6).alias("total_real_cost_est_usd"))


def billed_summary(containers: DataFrame, marginal_usd: float) -> DataFrame:
    """Billed totals of containers, and how often they exceed the marginal cost; null where that is 0."""
    parts = ["gpu_cost_usd", "cpu_cost_usd", "mem_cost_usd"]
    real = zero(F.sum("real_cost_usd"))
    return containers.agg(
        F.count("*").alias("n_containers"), F.round(real, 6).alias("total_real_cost_usd"), F.lit(round(marginal_usd, 6)).alias("total_marginal_cost_usd"),
        F.round(F.try_divide(real, F.lit(float(marginal_usd))), 2).alias("real_to_marginal_ratio"), *[F.round(zero(F.sum(p)), 6).alias(p) for p in parts], F.round(zero(F.sum("billed_s")), 1).alias("billed_s_total"),
    )


def with_rate(df: DataFrame, gpu: str, out: str = "rate_usd_per_s") -> DataFrame:
    """Add the list price of a GPU, null for unknown ones."""
    return df.withColumn(out, gpu_rate(F.col(gpu)))


def estimate(gpu: str, compute_s: float, samples: int) -> float:
    """Cost of so many samples of so many seconds each; an unknown GPU is an error."""
    key = gpu.strip().upper().replace("_", "-")
    key = key if key in V.GPU_RATES else V.GPU_ALIASES.get(key, key)
    return V.GPU_RATES[key] * compute_s * samples
