"""The cost and quality report: small aggregates collected, then rendered on the driver."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.operators import cost, shards
from loomlake.sources.files import tail, write_csv, write_text


def build(records: DataFrame, runs: DataFrame | None = None, containers: DataFrame | None = None) -> dict:
    """All figures of the report as a dictionary; every table that is collected has a bounded number of rows."""
    records = records.persist()
    try:
        totals = cost.cost_summary(cost.record_totals(records)).first().asDict()
        out: dict = {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "n_traces": totals["n"]}
        if not totals["n"]:
            return out
        facts = cost.stage_facts(records)
        out |= {"totals": totals, "stages": [r.asDict() for r in cost.stage_costs(facts).orderBy("ord").collect()]}
        told = F.transform(F.map_values("telemetry"), lambda t: t["projected_gpu"].cast("string"))
        one = {"render": F.col("render.projected_gpu"), "models": F.coalesce(F.col("meta.planner"), F.lit("unknown"))}
        counts = cost.histograms(records, {"planner": told} | {name: F.array(c.cast("string")) for name, c in one.items()}).collect()
        found = {name: {r["value"]: r["n"] for r in counts if r["name"] == name} for name in ("planner", "render", "models")}
        out |= {"gpus": {"planner": found["planner"], "render": found["render"]}, "models": found["models"]}
        out["rates_usd_per_s"] = {g: V.GPU_RATES.get(V.GPU_ALIASES.get(g.upper(), g.upper())) for g in {*out["gpus"]["planner"], *out["gpus"]["render"]}}
        if runs is not None and not runs.isEmpty():
            rows = cost.ledger_summary(runs).collect()
            out["ledger"] = {"total": next(r.asDict() for r in rows if r["kind"] is None), "by_kind": {r["kind"]: r["n_runs"] for r in rows if r["kind"] is not None}, "last": [r.asDict() for r in tail(runs, "started_at").collect()]}
        if containers is not None and not containers.isEmpty():
            out["billed"] = cost.billed_summary(containers, totals["e2e_usd_total"]).first().asDict()
        return out
    finally:
        records.unpersist()


def markdown(report: dict) -> str:
    lines = ["# Report", "", f"Made at {report['generated_at']} from {report['n_traces']} records."]
    if not report["n_traces"]:
        return "\n".join([*lines, ""])
    lines += ["", "| stage | mean s | p50 s | p90 s | tokens | mean $ | total $ | retries |", "|-|-|-|-|-|-|-|-|"]
    lines += [f"| {s['label']} {s['stage']} | {s['compute_s_mean']:.2f} | {s['compute_s_p50']:.2f} | {s['compute_s_p90']:.2f} | {s['output_tokens_mean']:.0f} | {s['cost_mean']:.6f} | {s['cost_total']:.6f} | {s['retries']} |" for s in report["stages"]]
    t = report["totals"]
    lines += ["", f"End to end: {t['e2e_s_mean']:.2f} s (p50 {t['e2e_s_p50']:.2f}, p90 {t['e2e_s_p90']:.2f}, p99 {t['e2e_s_p99']:.2f}), ${t['e2e_usd_mean']:.6f} each, ${t['e2e_usd_total']:.6f} in all.", ""]
    lines += [f"- {n} samples: ${t[f'projected_{n}']:.2f}" for n in ("1k", "10k", "100k", "1m")]
    for name in ("gpus", "models", "ledger", "billed"):
        if name in report:
            lines += ["", f"## {name}", "", "```json", json.dumps(report[name], indent=2, ensure_ascii=False, default=str), "```"]
    return "\n".join([*lines, ""])


RUN_COLUMNS = ("started_at", "kind", "model", "gpu", "n_items", "total_cost_usd", "real_cost_est_usd", "duration_s", "status")


def runs_table(runs: DataFrame) -> DataFrame:
    """The ledger's columns as text, in order of time; empty where a run doesn't have one, 0 for missing figures."""
    have = set(runs.columns)
    zero = {"n_items": "0", "total_cost_usd": "0.0", "real_cost_est_usd": "0.0", "duration_s": "0.0"}
    cells = [F.coalesce(F.col(c).cast("string") if c in have else F.lit(None).cast("string"), F.lit(zero.get(c, ""))).alias(c) for c in RUN_COLUMNS]
    return runs.select(*cells).orderBy("started_at")


def quality_text(summary: list[dict], metrics: list[dict]) -> str:
    """summary: rows of quality_report; metrics: rows of distribution."""
    total = next(r for r in summary if r["stratum"] is None)
    lines = [f"{total['n']} records: {total['passed']} passed the gate, {total['failed']} failed, {total['unknown']} not judged", "", f"{'metric':<20}{'n':>7}{'p10':>9}{'p50':>9}{'p90':>9}{'mean':>9}"]
    show = lambda v: "-" if v is None else f"{v:.3f}"
    lines += [f"{m['metric']:<20}{m['n']:>7}" + "".join(f"{show(m[c]):>9}" for c in ("p10", "p50", "p90", "mean")) for m in metrics if m["n"]]
    names = [c for c in total if c.endswith("_mean")]
    lines += ["", f"{'stratum':<20}{'n':>7}{'gate':>7}" + "".join(f"{c.removesuffix('_mean'):>20}" for c in names)]
    lines += [f"{r['stratum']:<20}{r['n']:>7}{r['passed'] / r['n']:>7.0%}" + "".join(f"{show(r[c]):>20}" for c in names) for r in sorted((r for r in summary if r["stratum"] is not None), key=lambda r: r["stratum"])]
    return "\n".join(lines)


def calibration_text(rows: list[dict]) -> str:
    """rows of correlate."""
    show = lambda v: "-" if v is None else f"{v:.3f}"
    return "\n".join([f"{'metric':<20}{'n':>6}{'spearman':>10}{'threshold':>11}{'f1':>8}", *(f"{r['metric']:<20}{r['n']:>6}{show(r['spearman']):>10}{show(r['threshold']):>11}{show(r['f1']):>8}" for r in rows)])


def trace_text(record: dict) -> str:
    """Time, tokens and cost of each stage of one record, and their sums."""
    told = {s: t for s, t in (record.get("telemetry") or {}).items() if t}
    lines = [f"{V.STAGE_LABELS.get(s, '-'):<4}{s:<16}{t['compute_s']:>9.2f} s{t['output_tokens']:>7} tokens{t['tokens_per_s']:>8.1f}/s  ${t['projected_cost_usd']:.6f}" + (f"  retries: {t['retries']}" if t["retries"] else "") for s, t in told.items()]
    return "\n".join([*lines, f"{'all':<20}{sum(t['compute_s'] for t in told.values()):>9.2f} s  ${sum(t['projected_cost_usd'] for t in told.values()):.6f}"])


def write_bundle(report: dict, records: DataFrame, folder: str, runs: DataFrame | None = None) -> str:
    """Markdown, JSON, stage CSV and, with runs, their CSV in a folder of this moment, and latest.md beside it; returns the folder."""
    spark = records.sparkSession
    at = f"{folder}/{time.strftime('%Y%m%d-%H%M%S')}"
    text = markdown(report)
    write_text(spark, f"{at}/report.md", text)
    write_text(spark, f"{at}/report.json", json.dumps(report, indent=2, ensure_ascii=False, default=str))
    if report.get("stages"):
        rows = ["stage,label,compute_s_mean,compute_s_p50,compute_s_p90,output_tokens_mean,cost_mean,cost_total"]
        rows += [f"{s['stage']},{s['label']},{s['compute_s_mean']:.6f},{s['compute_s_p50']:.6f},{s['compute_s_p90']:.6f},{s['output_tokens_mean']:.2f},{s['cost_mean']:.8f},{s['cost_total']:.8f}" for s in report["stages"]]
        write_text(spark, f"{at}/stages.csv", "\n".join([*rows, ""]))
    if runs is not None and not runs.isEmpty():
        write_csv(runs_table(runs).coalesce(1), f"{at}/runs.csv")
    write_text(spark, f"{folder}/latest.md", text)
    return at


def datacard(manifest: dict, splits: dict[str, int], summary: dict) -> str:
    """A short description of a packed dataset."""
    lines = [f"# {manifest.get('name', 'dataset')}", "", f"Licence: {manifest.get('license')}. Records: {manifest.get('n_samples')}.", "", "| split | records |", "|-|-|"]
    lines += [f"| {k} | {v} |" for k, v in splits.items()]
    lines += ["", *(f"- {k}: {v}" for k, v in summary.items()), ""]
    return "\n".join(lines)


def pack(records: DataFrame, order: str, size: int = 256, only_passed: bool = False) -> DataFrame:
    """Records with row and shard, those that passed the gate only if asked."""
    kept = records.filter("dataset.quality.passed_gate") if only_passed else records
    return shards.with_shards(kept, order, size)
