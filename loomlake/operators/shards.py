"""Shards of a record set in its own order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.sources.staging import staged


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add running sums over the rows of equal keys up to each row, without sorting a key's rows in one task.

    sums: name of the new column by that of the summed one. Rows are range-partitioned by keys and order and
    written; what comes before a range is then the sums of the ranges before it, of which there are few. Rows
    that are equal by order must be told apart by it.
    """
    block, total = f"_block_{uuid.uuid4().hex}", {c: f"_before_{uuid.uuid4().hex}" for c in sums}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(df.repartitionByRange(parts, *keys, *order).withColumn(block, F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, block).agg(*(F.sum(c).alias(c) for c in sums))
    offsets = blocks.select(*keys, block, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(total[c]) for c in sums))
    met = rows.alias("r").join(offsets.alias("o"), [*(F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys), F.col(f"r.{block}") == F.col(f"o.{block}")])
    own = Window.partitionBy(*(F.col(f"r.{k}") for k in keys), F.col(f"r.{block}")).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.select(*(F.col(f"r.{c}") for c in df.columns), *((F.sum(F.col(f"r.{c}")).over(own) + F.col(total[c])).alias(name) for c, name in sums.items()))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Add row, 0 for the first by order, nulls first, without sorting everything in one task.

    Rows are written once; ties are numbered by a hash of their other columns.
    """
    one, tie = f"_one_{uuid.uuid4().hex}", f"_tie_{uuid.uuid4().hex}"
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.withColumn(one, F.lit(1)).withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in plain)))
    out = prefix_sums(rows, [], [F.col(order), F.col(tie)], {one: "row"})
    return out.withColumn("row", F.col("row") - 1).drop(one, tie)


def with_shards(df: DataFrame, order: str, size: int = 256) -> DataFrame:
    """Add row and shard, the archive name of each run of `size` rows."""
    if size < 1:
        raise ValueError("a shard has one row at least")
    out = numbered(df, order)
    return out.withColumn("shard", F.format_string("shard-%05d.tar", F.floor(F.col("row") / size).cast("long")))


def index_rows(df: DataFrame) -> DataFrame:
    """The flat index of records that have shard and n_images."""
    d, q, s = F.col("dataset"), F.col("dataset.quality"), F.col("dataset.safety")
    return df.select(
        "id", "prompt", d["stratum"].alias("stratum"), d["split"].alias("split"), F.col("meta.seed").alias("seed"), q["passed_gate"].alias("passed_gate"),
        F.coalesce(q["gate_reasons"], F.array().cast("array<string>")).alias("gate_reasons"), *[q[m].alias(m) for m in ("clip_score", "aesthetic", "image_reward", "faithfulness", "detection_coverage")],
        *[s[m].alias(m) for m in ("nsfw", "nsfw_label", "release_blocked", "is_duplicate")], "n_images", "shard",
    )


def manifest(df: DataFrame, order: str) -> DataFrame:
    """One row: counts, and licence, code version and planner of the first record."""
    first = lambda c: F.min_by(c, order)
    return df.agg(F.count("*").alias("n_samples"), first(F.col("dataset.license")).alias("license"), first(F.col("dataset.code_version")).alias("code_version"), first(F.col("meta.planner")).alias("planner"))
