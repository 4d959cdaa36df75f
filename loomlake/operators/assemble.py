"""Look-up joins: records with renders, images and rates, prompts with strata."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import stripped
from loomlake.functions.trace import render_telemetry

HEAD = 4  # first characters of subjects by which their lengths are found


def prompt_stratum(prompts: DataFrame, subjects: DataFrame, *, prompt: str = "prompt", exact: DataFrame | None = None) -> DataFrame:
    """Add stratum: that of an equal prompt, else of the longest subject that begins it, else 'unknown'.

    subjects: subject, stratum. exact: prompt, stratum. Instead of comparing every prompt with every
    subject, each distinct prompt gives one key for each length of a subject that begins like it, for an
    equi-join: the lengths of the subjects that share their first characters with it, found by those characters.
    Other columns stay, whatever their names, but for stratum, which is written anew.
    """
    low = F.lower(F.col(prompt))
    mine = {n: f"{n}_{uuid.uuid4().hex}" for n in ("prompt", "subject", "head", "sizes", "stratum", "found", "whole", "exact")}
    table = subjects.filter("subject is not null").groupBy(F.lower("subject").alias(mine["subject"])).agg(F.min("stratum").alias(mine["stratum"]))
    # Subjects that are shorter than a head stand under each head that they are, padded with nothing.
    head = lambda c: F.substring(c, 1, HEAD)
    lengths = table.groupBy(head(F.col(mine["subject"])).alias(mine["head"])).agg(F.sort_array(F.collect_set(F.length(mine["subject"]))).alias(mine["sizes"]))
    names = prompts.select(low.alias(mine["prompt"])).filter(F.col(mine["prompt"]).isNotNull()).distinct()
    heads = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(HEAD), F.length(mine["prompt"]))), lambda n: F.substring(F.col(mine["prompt"]), F.lit(1), n)))
    begun = names.select(mine["prompt"], heads.alias(mine["head"])).join(lengths, mine["head"])
    fits = F.filter(mine["sizes"], lambda n: n <= F.length(mine["prompt"]))
    keys = begun.select(mine["prompt"], F.explode(F.transform(fits, lambda n: F.substring(F.col(mine["prompt"]), F.lit(1), n))).alias(mine["subject"]))
    best = keys.join(table, mine["subject"]).groupBy(mine["prompt"]).agg(F.max_by(mine["stratum"], F.length(mine["subject"])).alias(mine["found"]))
    out = prompts.drop("stratum").join(best, low == F.col(mine["prompt"]), "left")
    known = F.lit(None).cast("string")
    if exact is not None:
        out = out.join(exact.groupBy(F.col("prompt").alias(mine["whole"])).agg(F.min("stratum").alias(mine["exact"])), F.col(prompt) == F.col(mine["whole"]), "left")
        known = F.col(mine["exact"])
    return out.withColumn("stratum", F.coalesce(known, F.col(mine["found"]), F.lit("unknown"))).drop(*mine.values())


def assemble(records: DataFrame, traces: DataFrame, *, license_name: str, code_version: str) -> DataFrame:
    """Join render records to their traces by id; records without a trace go, repeated ones stay.

    The render's prompt, images and, where it has them, final images replace the trace's, and so does its
    seed, null or not. The
    dataset block is written anew, without split, safety and quality.
    """
    taken = {"prompt": "_prompt", "seed": "_seed", "telemetry": "_telemetry", "images": "_images"}
    finals = [c for c in ("final_image", "final_images") if c in records.columns]
    r = records.select("id", *[F.col(c).alias(n) for c, n in taken.items()], *[F.col(c).alias(f"_{c}") for c in finals])
    met = r.join(traces, "id")
    block = traces.schema["dataset"].dataType.simpleString()
    fresh = F.from_json(F.to_json(F.struct(F.lit(license_name).alias("license"), F.lit(code_version).alias("code_version"))), block)
    return met.withColumns({
        "enriched_prompt": F.col("_prompt"), "images": F.col("_images"), "render": render_telemetry(F.col("_telemetry"), keep_missing=True),
        "meta": F.col("meta").withField("seed", F.col("_seed")), "dataset": fresh, **{c: F.col(f"_{c}") for c in finals},
    }).drop(*taken.values(), *[f"_{c}" for c in finals])


def existing_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, idx, path) of the images of records that are among files (path).

    A record's images are those it lists, by their idx or place, else as many as its meta says.
    """
    listed = F.transform("images", lambda i, at: F.coalesce(i["idx"], at))
    guessed = F.when(F.coalesce(F.col("meta.n_variations"), F.lit(0)) > 0, F.sequence(F.lit(0), F.col("meta.n_variations") - 1))
    idx = F.when(F.size("images") > 0, listed).otherwise(guessed)
    wanted = records.select("id", F.explode(idx).alias("idx")).withColumn("path", F.concat(F.col("id"), F.lit("_"), F.col("idx").cast("string"), F.lit(".webp")))
    return wanted.join(files.select("path").distinct(), "path", "left_semi").select("id", "idx", "path")


def image_counts(records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, n_images) with zeros."""
    have = existing_images(records, files).groupBy("id").agg(F.count("*").alias("n_images"))
    return records.select("id").distinct().join(have, "id", "left").select("id", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def first_of_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by order; keys are compared without case and outer white space, empty ones go."""
    name = F.lower(stripped(key))
    best = df.withColumn("_k", name).filter("_k <> ''").groupBy("_k").agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("_r.*")
