"""A run ledger as a stream: an extra of this engine over its append-only files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUN = "run_id string, kind string, started_at string, wall_s double, status string, error string, n_samples bigint, total_cost_usd double, real_cost_est_usd double"


def read_runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """New ledger files as they come; each is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(path)


def by_kind(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count("*").alias("n_runs"), F.round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"))


def by_hour(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Runs and cost an hour and kind; rows later than `late` no longer count."""
    timed = runs.withColumn("at", F.to_timestamp("started_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "kind").agg(F.count("*").alias("n_runs"), F.sum("total_cost_usd").alias("total_cost_usd"))


def start(totals: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run until the files at hand are read, into an in-memory table."""
    return totals.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
