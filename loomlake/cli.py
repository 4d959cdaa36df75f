"""Command line: every job of this engine, over files."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from loomlake.operators.cost import estimate

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomlake")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, /, *places: str, **options: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=said)
        for place in places:
            p.add_argument(place)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type=type(default) if default is not None else str, default=default)
        return p

    c = command("cost", "cost of samples on a GPU", "gpu", samples=1)
    c.add_argument("seconds", type=float)
    q = command("query", "run a registered query over a folder of tables", out=None)
    q.add_argument("name", nargs="?")
    q.add_argument("tables", nargs="?")
    command("report", "report on record files", "records", "folder", runs=None, containers=None)
    command("quality", "gate counts, distributions and strata of record files", "records")
    command("plan", "make one record's decisions with a chat-completion server", "prompt", url="http://localhost:11434/v1", model="local", gpu="A100-80GB", retries=2, out="outputs")
    command("assemble", "join render records to their traces", "records", "traces", "out", license="unknown", code_version=None, subjects=None)
    for name, said, places in (("generate", "plan and render prompts by a producer of your own", ("prompts",)), ("evaluate", "score, gate and split record files by a producer of your own", ("records",))):
        c = command(name, said, *places, "folder", make=None, tasks=0, in_flight=1, **({"outputs": None, "limit": 0} if name == "generate" else {"out": None, "seed": 0}))
        c.epilog = "--make module:function or file.py:function names a function without arguments that returns the function of one row, a dictionary"
    command("pack", "archives, index, manifest and data card of record files", "records", "out", images=None, name="dataset", shard_size=256, only_passed=False)
    command("export", "training examples of record files", "records", "out", format="chat", system="")
    command("sheet", "a sheet for human labels", "records", "out", n=100, seed=0)
    command("calibrate", "rank correlations and thresholds from a labelled sheet", "sheet")
    return top


def loaded(spark: SparkSession, name: str) -> Callable:
    """The function that module:function or file.py:function names; a file is sent to the tasks."""
    module, _, function = name.rpartition(":")
    if module.endswith(".py"):
        spark.sparkContext.addPyFile(module)
        module = Path(module).stem
    return getattr(importlib.import_module(module), function)


def made_plan(args: argparse.Namespace) -> dict:
    from loomlake.functions import vocabulary as V
    from loomlake.plans import clients, produce

    key = args.gpu.strip().upper().replace("_", "-")
    rate = V.GPU_RATES[key if key in V.GPU_RATES else V.GPU_ALIASES[key]]
    return {"id": uuid.uuid4().hex, **produce.plan(clients.HttpClient(args.url, args.model), args.prompt, retries=args.retries, rate=rate, gpu=args.gpu)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "cost":
        print(f"{estimate(args.gpu, args.seconds, args.samples):.8f}")
        return 0
    from loomlake.plans import catalog, jobs, report

    if args.command == "query" and not args.name:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from loomlake.functions import vocabulary as V
    from loomlake.operators import calibration, prompts, quality
    from loomlake.plans.clients import code_version
    from loomlake.sources import files, seeds
    from loomlake.streaming.ledger import RUN

    if args.command == "plan":
        record = made_plan(args)
        print(json.dumps(record, indent=2, ensure_ascii=False))
        print(report.trace_text(record), file=sys.stderr)
        if args.out:
            files.write_text(SparkSession.builder.getOrCreate(), f"{args.out}/{record['id']}.trace.json", json.dumps(record, indent=2, ensure_ascii=False))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "query":
        df = catalog.QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show()
        return 0
    if args.command == "calibrate":
        rows = calibration.labelled(files.read_sheet(spark, args.sheet), V.METRICS)
        print(report.calibration_text([r.asDict() for r in calibration.correlate(rows, V.METRICS, "human_good").orderBy("metric").collect()]))
        return 0
    if args.command == "assemble":
        image = "array<struct<path:string,sha256:string,idx:int,width:int,height:int,seed:bigint>>"
        kinds = f"id string, prompt string, final_image string, final_images array<string>, images {image}, meta struct<seed:bigint>, telemetry struct<render:struct<compute_s:double,rate_usd_per_s:double,cost_usd:double,projected_cost_usd:double,gpu:string>>"
        found = files.read_jsonl(spark, args.records, kinds).select("*", "meta.seed", F.col("telemetry.render").alias("told")).drop("meta", "telemetry").withColumnRenamed("told", "telemetry")
        exact = None
        if args.subjects:
            subjects = files.read_sheet(spark, args.subjects).select("subject", "stratum")
        else:
            subjects, exact = seeds.strata(spark)
        made = jobs.assemble_dataset(found, files.read_documents(spark, args.traces), subjects, args.out, license_name=args.license, code_version=args.code_version or code_version(), exact=exact)
        print(f"{made['rows']} records, {made['images']} images, ${made['cost_usd']:.6f}")
        return 0
    if args.command == "generate":
        asked = files.read_prompts(spark, args.prompts, args.limit or None).select(F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "prompt"), 256).substr(1, 32).alias("id"), "prompt")
        rows = jobs.generate(asked, loaded(spark, args.make), args.outputs, args.folder, args.tasks or None, args.in_flight)
        print("{n} made, {failed} failed".format(**rows.agg(F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()))
        return 0
    records = files.read_jsonl(spark, args.records)
    if args.command == "evaluate":
        files.write_jsonl(jobs.evaluate(records, loaded(spark, args.make), args.folder, seed=args.seed, tasks=args.tasks or None, in_flight=args.in_flight), args.out)
        print(files.read_jsonl(spark, args.out).groupBy(F.col("dataset.quality.passed_gate").alias("passed")).count().orderBy("passed").collect())
    elif args.command == "report":
        runs = files.read_optional(spark, args.runs, f"{RUN}, model string, gpu string, n_items bigint, duration_s double") if args.runs else None
        boxes = files.read_optional(spark, args.containers, "real_cost_usd double, gpu_cost_usd double, cpu_cost_usd double, mem_cost_usd double, billed_s double") if args.containers else None
        print(report.write_bundle(report.build(records, runs, boxes), records, args.folder, runs))
    elif args.command == "quality":
        flat = records.select(F.col("dataset.stratum").alias("stratum"), F.col("dataset.quality.passed_gate").alias("gate"), *(F.col(f"dataset.quality.{m}").alias(m) for m in V.METRICS))
        print(report.quality_text([r.asDict() for r in quality.quality_report(flat, "stratum", "gate", V.METRICS).collect()], [r.asDict() for r in quality.distribution(flat, V.METRICS).orderBy("metric").collect()]))
    elif args.command == "pack":
        made = jobs.pack(records, args.out, name=args.name, size=args.shard_size, only_passed=args.only_passed, images=files.image_contents(spark, args.images) if args.images else None)
        print(f"{made['n_samples']} records in {len(made['shards'])} archives")
    elif args.command == "export":
        print(jobs.training_examples(records, args.out, form=args.format, system=args.system), "examples")
    elif args.command == "sheet":
        flat = records.select("id", "prompt", *(F.col(f"dataset.quality.{m}").alias(m) for m in V.METRICS))
        files.write_csv(files.label_sheet(prompts.sample_rows(flat, args.n, args.seed, "id"), V.METRICS).coalesce(1), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
