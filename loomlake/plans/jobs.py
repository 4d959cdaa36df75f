"""Whole jobs: generate, evaluate, pack, export. Each writes what models made before it is used again."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.functions.evaluation import payload
from loomlake.functions.scalars import assign_split, derive_seed
from loomlake.functions.trace import chat_example, telemetry_sum, token_target, validate
from loomlake.operators import assemble, hashdup, quality, shards
from loomlake.plans import clients
from loomlake.plans.produce import Client, Meter, plan, produce_into, tracked
from loomlake.plans.report import datacard
from loomlake.sources import files

SCORES = "clip_score double, aesthetic double, image_reward double, faithfulness double, detection_coverage double, nsfw double, phash long"


def generate(prompts: DataFrame, make: Callable[[], Callable[[dict], dict]], outputs: str, folder: str, tasks: int | None = None, in_flight: int = 1) -> DataFrame:
    """Plan and render prompts (id, prompt) by a producer of `outputs`; written rows, failed ones with their error.

    Called again over the same folder it asks for what has no result there yet.
    """
    seeded = prompts.withColumn("seed", derive_seed(F.col("id")))
    return produce_into(seeded, make, outputs, folder, key="id", tasks=tasks, in_flight=in_flight)


def evaluate(records: DataFrame, make: Callable[[], Callable[[dict], dict]], folder: str, *, order: str = "id", seed: int = 0, threshold: int = 8, tasks: int | None = None, in_flight: int = 1) -> DataFrame:
    """Score records, mark duplicates by hash in `order`, split, gate and merge; records without images are left out.

    Failed rows get the reason eval_failed, and their missing hash makes no duplicate of them. Called again over the
    same folder it scores what has no scores there yet. Rows of one id are scored together, by the first of them.
    """
    wanted = payload(records)
    scored = produce_into(wanted, make, SCORES, folder, key="id", tasks=tasks, in_flight=in_flight).join(wanted.select("id").distinct(), "id", "left_semi")
    numbered = shards.numbered(scored, order)
    marked = hashdup.keep_first(numbered, threshold=threshold, hash_col="phash", pos="row")
    kinds = {f.name: f.dataType for f in records.schema["dataset"].dataType.fields}
    q = F.struct(*[F.col(m) for m in V.METRICS])
    as_kind = lambda c, kind: F.from_json(F.to_json(c), kind)
    once = marked.groupBy("id").agg(F.min_by(F.struct(q.alias("_q"), F.col("nsfw"), F.col("is_duplicate"), F.col("error").isNotNull().alias("_failed")), "row").alias("_r")).select("id", "_r.*")
    rows = records.join(once, "id")  # rows of one id are scored once each; the first of them stands for all
    rows = rows.withColumns({"_quality": as_kind(F.col("_q"), kinds["quality"]), "_safety": as_kind(quality.safety(F.col("nsfw")), kinds["safety"]), "_split": assign_split(F.col("prompt"), seed=seed)})
    return quality.merge_evaluation(rows, "_quality", "_safety", "_split", "is_duplicate", failed="_failed").select(*records.columns)


def pack(records: DataFrame, folder: str, *, name: str, order: str = "id", size: int = 256, only_passed: bool = False, images: DataFrame | None = None) -> dict:
    """Archives, index, manifest and data card of a record set in a folder; returns the manifest.

    images: id, idx, content.
    """
    kept = records.filter("dataset.quality.passed_gate") if only_passed else records
    placed = shards.with_shards(kept, order, size).withColumn("json", F.to_json(F.struct(*kept.columns), {"ignoreNullFields": "false"}))
    counts = images.groupBy("id").agg(F.count("*").alias("n_images")) if images is not None else None
    indexed = placed.join(counts, "id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0))) if counts is not None else placed.withColumn("n_images", F.lit(0))
    archives = files.write_shards(placed, f"{folder}/archives", images)
    files.write_jsonl(shards.index_rows(indexed), f"{folder}/index")
    manifest = shards.manifest(kept, order).first().asDict() | {"name": name, "shards": [r["shard"] for r in archives.orderBy("shard").collect()]}
    splits = {r["split"]: r["n"] for r in quality.split_counts(kept.select(F.col("dataset.split").alias("split")), "split").collect()}
    summary = quality.pack_summary(kept, V.METRICS).first().asDict()
    spark = records.sparkSession
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest | {"splits": splits, "summary": summary}, indent=2, ensure_ascii=False))
    files.write_text(spark, f"{folder}/README.md", datacard(manifest, splits, summary))
    return manifest


def written(df: DataFrame, folder: str, **sums: Column) -> dict:
    """Write JSON lines; rows, and other sums over them, are observed while they are written, in the same job."""
    seen = Observation()
    files.write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items())), folder)
    return seen.get


def assemble_dataset(renders: DataFrame, traces: DataFrame, subjects: DataFrame, folder: str, *, license_name: str, code_version: str, exact: DataFrame | None = None) -> dict:
    """Join renders with traces, set strata and write JSON lines; returns rows, their images and projected cost, from the one job that writes.

    subjects: subject, stratum. exact: prompt, stratum, of prompts that are known whole.
    """
    rows = assemble.assemble(renders, traces, license_name=license_name, code_version=code_version)
    named = assemble.prompt_stratum(rows, subjects, exact=exact)
    out = named.withColumn("dataset", F.col("dataset").withField("stratum", F.col("stratum"))).drop("stratum")
    cost = telemetry_sum("projected_cost_usd") + F.coalesce(F.col("render.projected_cost_usd"), F.lit(0.0))
    return written(out, folder, images=F.sum(F.greatest(F.size("images"), F.lit(0)).cast("long")), cost_usd=F.sum(cost))


def training_examples(records: DataFrame, folder: str, *, form: str = "chat", system: str = "") -> int:
    """Chat or token examples of the valid records as JSON lines; returns how many, from the one job that writes."""
    if form not in ("chat", "tokens"):
        raise ValueError(f"form must be chat or tokens, not {form!r}")
    valid = validate(records).filter(F.size("errors") == 0)
    made = valid.select(chat_example(system).alias("messages")) if form == "chat" else valid.select(token_target().alias("t")).select("t.*")
    return written(made, folder)["rows"]


def one_sample(prompt: str, client: Client, render: Callable[[str, str], dict], folder: str, spark: SparkSession, *, gpu: str | None = None, idle_s: float = 0.0, meter: Meter | None = None, **options: object) -> dict:
    """Plan and render one prompt, write its record and ledger row, and compare the marginal with the real cost.

    render(prompt, id) gives {"telemetry": ..., "images": [bytes, ...]}. Returns the record with cost: marginal_usd,
    real_usd (a container's whole life) and real_to_marginal, None where nothing was spent.
    """
    key = hashlib.sha256(f"{time.time_ns()}:{prompt}".encode()).hexdigest()[:32]
    meter = (meter or Meter(gpu, clients.cpu_core_seconds, clients.memory_peak_gib)).start()
    ledger: list[dict] = []
    with tracked(ledger.append, "pipeline", n_items=1, gpu=gpu) as run:
        record = {"id": key, **plan(client, prompt, **options)}
        made = render(prompt, key)
        record["render"] = made.get("telemetry")
        record["final_images"] = [f"{key}_{i}.webp" for i in range(len(made.get("images", [])))]
        marginal = sum(t["projected_cost_usd"] for t in record["telemetry"].values()) + ((record["render"] or {}).get("projected_cost_usd") or 0.0)
        run["total_cost_usd"] = marginal
    real = meter.stop(idle_s)["real_cost_usd"]
    record["cost"] = {"marginal_usd": marginal, "real_usd": real, "real_to_marginal": real / marginal if marginal else None}
    for name, content in zip(record["final_images"], made.get("images", []), strict=True):
        files.write_bytes(spark, f"{folder}/{name}", content)
    files.write_text(spark, f"{folder}/{key}.full.json", json.dumps(record, indent=2, ensure_ascii=False))
    files.write_text(spark, f"{folder}/runs/{key}.json", json.dumps(ledger[0]) + "\n")
    return record
