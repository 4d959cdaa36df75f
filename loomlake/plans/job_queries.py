"""Queries that run producers, whole jobs, prompt sets and small files over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import evaluation as E
from loomlake.functions import vocabulary as V
from loomlake.operators import cost, prompts
from loomlake.plans import jobs, produce, report
from loomlake.plans.record_queries import REC, records
from loomlake.plans.registry import query, table
from loomlake.sources import files, seeds
from loomlake.sources.staging import scratch, staged


@query("""with w as (select f.k as k, g.k as l, list(cos(pi() / 32 * f.k * (r + 0.5::double)) * cos(pi() / 32 * g.k * (c + 0.5::double)) order by r, c) as w from range(8) f(k), range(8) g(k), range(32) a(r), range(32) b(c) group by all),
  p as (select vec_id, list_transform(range(1024), lambda i: floor(100 * abs(embedding[(i * 7 + i // 32) % 64 + 1]::double))::double) as p from embeddings),
  c as (select vec_id, list(round(list_dot_product(p, w), 6) order by k, l) as c from p, w group by 1), m as (select vec_id, c, list_sort(c[2:])[32] as m from c),
  b as (select vec_id, list_sum(list_transform(range(64), lambda i: case when c[i + 1] > m then 1::hugeint << i::int else 0::hugeint end)) as h from m)
  select vec_id, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as hash from b""")
def perceptual_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of 32 x 32 pixels made from each vector."""
    pixels = F.expr("transform(sequence(0, 1023), i -> cast(floor(100 * abs(cast(embedding[(i * 7 + i div 32) % 64] as double))) as double))")
    return table(spark, d, "embeddings").select("vec_id", E.perceptual_hash(pixels).alias("hash"))


def quoted(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


CURATED = [(i, f"{s[k]} {c[(k + g) % len(c)]}") for i, (g, k, s, c) in enumerate((g, k, s, c) for g, (s, c) in enumerate(seeds.GENRES.values()) for k in range(3))]


@query(f"""with c(pos, prompt) as (values {quoted(CURATED)}), s(genre, subject) as (values {quoted([(g, x) for g, (s, _) in seeds.GENRES.items() for x in s])}), x(genre, context) as (values {quoted([(g, x) for g, (_, c) in seeds.GENRES.items() for x in c])}),
  a(atmosphere) as (values {quoted([(x,) for x in seeds.ATMOSPHERES])}), b as (select s.genre, subject || ' ' || context as prompt from s join x on s.genre = x.genre), m as (select genre, prompt || ', ' || atmosphere as prompt from b, a),
  l as (select 0 as layer, pos as round, '' as genre, prompt from c union all select 1, row_number() over (partition by genre order by sha256('4:' || genre || ':' || prompt), prompt), genre, prompt from b
    union all select 2, row_number() over (partition by genre order by sha256('4:' || genre || ':' || prompt), prompt), genre, prompt from m),
  u as (select *, row_number() over (partition by lower(prompt) order by layer, round, genre, prompt) as nth from l)
  select row_number() over (order by layer, round, genre, prompt) - 1 as pos, prompt from u where nth = 1 order by pos limit 900""")
def seed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A stratified prompt set from the engine's own vocabulary; 900 is the size that is asked for."""
    return prompts.generate(*seeds.tables(spark), 900, seed=4)


@query("select row_number() over (order by p_partkey) - 1 as pos, p_name || ' ' || p_partkey as prompt from part where p_partkey % 5 <> 0")
def prompt_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file of prompts with blank lines and outer white space, read back in the order of its lines."""
    path = scratch(spark, "prompts")
    line = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")))
    table(spark, d, "part").orderBy("p_partkey").coalesce(1).select(line.alias("value")).write.text(path)
    return files.read_prompts(spark, path)


@query("select r_regionkey::bigint as id, r_name as name from region")
def single_documents(spark: SparkSession, d: str) -> DataFrame:
    """One pretty JSON document a region, read back in one scan."""
    folder = scratch(spark, "documents")
    rows = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    for r in rows.collect():  # as many files as there are regions
        files.write_document(rows.filter(F.col("id") == r["id"]), f"{folder}/{r['id']}.trace.json")
    return files.read_documents(spark, folder, "id bigint, name string")


@query(f"with {REC} select id, case when k % 10 = 0 then -1 else s * 2 end::bigint as doubled, case when k % 10 = 0 then 'ValueError: no ' || k else '' end as error from rec")
def produced_columns(spark: SparkSession, d: str) -> DataFrame:
    """A producer over every record; its failures are data."""

    def make():
        def work(row: dict) -> dict:
            if row["k"] % 10 == 0:
                raise ValueError(f"no {row['k']}")
            return {"doubled": row["s"] * 2}

        return work

    rows = table(spark, d, "part").selectExpr("concat('p', p_partkey) as id", "p_partkey as k", "p_size as s")
    return produce.produce(rows, make, "doubled long", key="id").select("id", F.coalesce("doubled", F.lit(-1)).alias("doubled"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"""with {REC} select id, case when k % 7 = 0 then -1 when k % 2 = 0 then 1 else 0 end::bigint as retries, case when k % 7 = 0 then '' else p_name end as subject, case when k % 7 = 0 then '' else 'cold' end as temperature,
  k % 7 = 0 as failed from rec""")
def planned_records(spark: SparkSession, d: str) -> DataFrame:
    """All stages for every part with a scripted client: some answers are wrong once, some always."""

    def make():
        layout = {"entities": [{"id": "e", "kind": "object", "bbox": [0.1, 0.1, 0.5, "0.5"]}], "relations": [{"subject": "e", "predicate": "ON", "object": "floor"}]}
        rest = [
            layout, {"lens": "35mm", "rule_of_thirds": "yes", "subject_scale": 0.5, "leading_lines": False, "symmetry": 0}, {"key_light": "k", "fill_light": "low", "rim_light": True, "contrast": "low"},
            {"materials": {"a": "b"}}, {"primary_palette": ["#000000"], "temperature": "icy", "saturation": "dull"},
        ]

        def work(row: dict) -> dict:
            first = json.dumps({"subject": row["name"], "environment": "x", "camera": "y", "mood": "z", "dominant_elements": ["w"]})
            bad = ["no answer"] * (3 if row["k"] % 7 == 0 else 1 if row["k"] % 2 == 0 else 0)
            made = produce.plan(produce.ScriptedClient([*bad, f"<think>{{}}</think>```json\n{first}\n```", *map(json.dumps, rest)]), row["name"], rate=0.001)
            return {"retries": sum(t["retries"] for t in made["telemetry"].values()), "subject": made["semantic_plan"]["subject"], "temperature": made["color_script"]["temperature"]}

        return work

    rows = table(spark, d, "part").selectExpr("concat('p', p_partkey) as id", "p_partkey as k", "p_name as name")
    out = produce.produce(rows, make, "retries long, subject string, temperature string", key="id")
    return out.select("id", F.coalesce("retries", F.lit(-1)).alias("retries"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("temperature", F.lit("")).alias("temperature"), F.startswith(F.coalesce("error", F.lit("")), F.lit("StageFailed")).alias("failed"))


@query(f"""with {REC}, q as (select * from rec where s % 2 = 0 and k % 15 <> 0), g as (select count(*) as n from q)
  select n as n_samples, ceil(n / 64.0)::bigint as n_shards, (select count(*) from q where k % 4 = 0) as n_train, n as n_indexed, 'cc0' as license from g""")
def packed_set(spark: SparkSession, d: str) -> DataFrame:
    """The whole packing job over the records that passed the gate: manifest, index, archives."""
    folder = scratch(spark, "packed")
    made = jobs.pack(records(spark, d), folder, name="parts", size=64, only_passed=True)
    index = spark.read.json(f"{folder}/index")
    told = spark.read.option("multiLine", True).json(f"{folder}/manifest.json")
    return told.select("n_samples", F.size("shards").cast("long").alias("n_shards"), F.col("splits.train").alias("n_train"), F.lit(index.count()).cast("long").alias("n_indexed"), F.lit(made["license"]).alias("license"))


@query(f"""with {REC}, st as (select unnest({V.STAGES!r}) as stage) select 'planner ' || 'm' || k % 3 as name, count(*) as n from rec group by 1
  union all select 'stage ' || stage, case when stage = 'semantic_plan' then (select sum(k % 3)::bigint from rec) else 0 end from st
  union all select 'tokens ' || stage, case stage when 'semantic_plan' then (select round(avg(10 * s) * 100)::bigint from rec) when 'layout' then (select round(avg(s) * 100)::bigint from rec) else 0 end from st
  union all select 'p50 ' || stage, case stage when 'semantic_plan' then (select round(quantile_cont(s * 0.5::double, 0.5) * 100)::bigint from rec) when 'layout' then (select round(quantile_cont((k % 10)::double, 0.5) * 100)::bigint from rec) else 0 end from st
  union all select 'planner gpu T4', 2 * count(*) + count(*) filter (k % 33 = 1) from rec union all select 'render gpu T4', count(*) from rec where k % 5 <> 0 union all select 'rendered', count(*) from rec where k % 5 <> 0
  union all select 'run ' || event_type, count(*) from events group by 1 union all select 'ratio', 100""")
def report_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the report: planners, processors, all stages, rendered records, runs by kind, and billed to marginal cost."""
    events = table(spark, d, "events")
    runs = events.select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("started_at"), F.col("value").alias("total_cost_usd"), F.col("value").alias("real_cost_est_usd"))
    rows = staged(records(spark, d), "records")
    marginal = cost.cost_summary(cost.record_totals(rows)).first()["e2e_usd_total"]
    boxes = spark.createDataFrame([(marginal / 2, 0.0, 0.0, 0.0, 1.0)] * 2, "real_cost_usd double, gpu_cost_usd double, cpu_cost_usd double, mem_cost_usd double, billed_s double")
    made = report.build(rows, runs, boxes)
    found = [(f"planner {k}", n) for k, n in made["models"].items()] + [(f"{part} gpu {k}", n) for part, counts in made["gpus"].items() for k, n in counts.items()]
    for s in made["stages"]:
        found += [(f"stage {s['stage']}", int(s["retries"])), (f"tokens {s['stage']}", round(s["output_tokens_mean"] * 100)), (f"p50 {s['stage']}", round(s["compute_s_p50"] * 100))]
    found += [("rendered", made["totals"]["n_rendered"]), ("ratio", round(made["billed"]["real_to_marginal_ratio"] * 100)), *((f"run {k}", n) for k, n in made["ledger"]["by_kind"].items())]
    return spark.createDataFrame(found, "name string, n long")


@query("select * from (select event_id, event_type, value from events order by event_id desc limit 20) order by event_id")
def last_runs(spark: SparkSession, d: str) -> DataFrame:
    """The tail of a ledger that a report shows."""
    return files.tail(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")


@query("select p_partkey, p_name from part order by sha256('9:' || p_partkey), p_partkey limit 100")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample for human labels."""
    return prompts.sample_rows(table(spark, d, "part").select("p_partkey", "p_name"), 100, 9, "p_partkey")
