"""Stratified prompt sets: subjects with contexts, dealt round by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.scalars import stripped
from loomlake.sources.staging import staged


def shuffle_key(seed: int, *columns: str) -> Column:
    """A deterministic order for a seed."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in the order of a seeded shuffle by key."""
    return df.orderBy(shuffle_key(seed, key), key).limit(max(0, n))


def combinations(subjects: DataFrame, contexts: DataFrame) -> DataFrame:
    """(genre, prompt) of each subject with each context of its genre."""
    return subjects.join(contexts, "genre").select("genre", F.concat_ws(" ", "subject", "context").alias("prompt"))


def round_robin(pool: DataFrame, n: int, *, seed: int = 0, genre: str = "genre", prompt: str = "prompt") -> DataFrame:
    """(round, genre, prompt): one prompt a genre and round, in shuffled order, n at most.

    Prompts are compared without case and outer white space; of equal ones the first dealt stays, and the
    round of another is not filled. The first n rounds, which Spark finds without sorting a genre in one
    task, are enough unless duplicates leave fewer than n prompts in them.
    """
    turn = F.row_number().over(Window.partitionBy("genre").orderBy(shuffle_key(seed, "genre", "prompt"), "prompt"))
    dealt = pool.select(F.col(genre).alias("genre"), F.col(prompt).alias("prompt")).withColumn("round", turn)

    def first(rows: DataFrame) -> DataFrame:
        key = F.lower(stripped(F.col("prompt")))
        least = rows.filter(key != "").groupBy(key.alias("_k")).agg(F.min(F.struct("round", "genre", "prompt")).alias("r"))
        return least.select("r.*").orderBy("round", "genre").limit(max(0, n))

    few = staged(first(dealt.filter(F.col("round") <= max(1, n))), "rounds")
    return (few if few.count() >= n else first(dealt)).orderBy("round", "genre")


def generate(curated: DataFrame, subjects: DataFrame, contexts: DataFrame, atmospheres: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """(pos, prompt): n unique prompts, the curated ones (pos, prompt) first, then base combinations, then those with an atmosphere.

    Raises ValueError if there are fewer than n.
    """
    base = combinations(subjects, contexts)
    more = base.crossJoin(F.broadcast(atmospheres.select("atmosphere"))).select("genre", F.concat_ws(", ", "prompt", "atmosphere").alias("prompt"))
    layers = curated.select(F.lit(0).alias("layer"), F.col("pos").cast("long").alias("round"), F.lit("").alias("genre"), "prompt")
    for i, pool in ((1, base), (2, more)):
        order = Window.partitionBy("genre").orderBy(shuffle_key(seed, "genre", "prompt"), "prompt")
        layers = layers.unionByName(pool.select(F.lit(i).alias("layer"), F.row_number().over(order).cast("long").alias("round"), "genre", "prompt"))
    key = F.lower(stripped(F.col("prompt")))
    unique = layers.filter(key != "").groupBy(key.alias("_k")).agg(F.min(F.struct("layer", "round", "genre", "prompt")).alias("r")).select("r.*")
    rows = unique.orderBy("layer", "round", "genre", "prompt").limit(max(0, n)).collect()  # at most n rows, as the caller asked
    if len(rows) < n:
        raise ValueError(f"{n} prompts were asked for, but there are only {len(rows)} unique ones")
    return curated.sparkSession.createDataFrame([(i, r["prompt"]) for i, r in enumerate(rows)], "pos long, prompt string")
