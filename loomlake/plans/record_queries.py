"""Queries that run the record operators over nested records made of the table part, one a row.

RECORDS says what the records hold; the equivalents state the expected results in terms of that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlake.functions import evaluation as E
from loomlake.functions import scalars as X
from loomlake.functions import trace as T
from loomlake.functions import vocabulary as V
from loomlake.operators import assemble, calibration, cost, quality, shards, spatial
from loomlake.plans.registry import query, table
from loomlake.sources import files, sinks
from loomlake.sources.staging import scratch


def told(seconds: str, usd: str, tokens: str, retries: str) -> str:
    return f"named_struct('compute_s', {seconds}, 'rate_usd_per_s', 0.001D, 'projected_cost_usd', {usd}, 'projected_gpu', 'T4', 'input_tokens', 5, 'output_tokens', {tokens}, 'tokens_per_s', 1.0D, 'retries', {retries}, 'last_error', null)"


#: Every column of a record as an expression over part; k is the key and s the size of a part.
RECORDS = {
    "id": "concat('p', k)",
    "prompt": "if(k % 50 = 7, '', p_name)",
    "semantic_plan": "named_struct('subject', p_name, 'environment', p_brand, 'camera', p_type, 'mood', if(k % 20 = 3, '', 'calm'), 'elements', if(s % 4 = 0, array(), array(p_brand, p_type)))",
    "layout": """named_struct('canvas', if(k % 40 = 11, array(1024), if(k % 3 = 1, null, array(1024, 1024))), 'entities', array(
      named_struct('id', 'lamp', 'kind', 'object', 'bbox', array((s % 4) / 4D, 0.25D, (s % 4) / 4D + 0.25D, 0.75D), 'z', 1),
      named_struct('id', if(k % 30 = 13, 'lamp', 'man_b'), 'kind', case when k % 25 = 4 then 'ghostly' when s % 3 = 0 then 'background' else 'character' end,
        'bbox', case when k % 17 = 5 then array(0D, 0D, 1D, 1D) when k % 19 = 6 then array(0.5D, 0.5D, 0.4D, 0.9D) else array(0.125D, 0.125D, 0.5D, 0.625D) end, 'z', 2)),
      'relations', array(named_struct('subject', 'lamp', 'predicate', get(array(' On_Top_Of', 'behind', 'beside', 'in', 'NEAR', 'partof'), cast(k % 6 as int)),
        'object', case when k % 12 = 0 then 'ghost' when k % 12 = 1 then 'floor' else 'man_b' end)))""",
    "composition": "named_struct('lens', '35mm', 'rule_of_thirds', s % 2 = 0, 'subject_scale', (s % 10) / 8D, 'leading_lines', s % 3 = 0, 'symmetry', s % 5 = 0)",
    "lighting": "named_struct('key_light', 'Side window', 'fill_light', get(array('low', 'medium', 'high', 'extreme'), cast(k % 4 as int)), 'rim_light', s % 2 = 1, 'contrast', 'high')",
    "materials": "named_struct('materials', if(k % 9 = 0, map(), map('Wet Glass', p_brand)))",
    "color_script": "named_struct('primary_palette', if(k % 11 = 0, array('#zz0000'), array('#A1B2C3', '#00ff00')), 'temperature', get(array('cool', 'Hot ', 'neutral', 'mauve'), s % 4), 'saturation', get(array('vivid', 'muted', 'medium'), cast(k % 3 as int)))",
    "visual_tokens": "array('A', upper(p_type))",
    "enriched_prompt": "if(s % 7 = 0, concat('rich ', p_name), null)",
    "final_image": "if(k % 6 = 0, null, concat('p', k, '.webp'))",
    "final_images": "if(k % 4 = 0, null, transform(sequence(0, cast(k % 4 as int) - 1), i -> concat('p', k, '_', i, '.webp')))",
    "images": "if(k % 4 = 0, null, transform(sequence(0, cast(k % 4 as int) - 1), i -> named_struct('path', if(k % 10 = 9, '', concat('p', k, '_', i, '.webp')), 'sha256', 'h', 'idx', if(k % 21 = 2, -1, i), 'width', 512, 'height', 256, 'seed', k + i)))",
    "render": f"if(k % 5 = 0, null, {told('3.5D', 's * 0.01D', '0', '0')})",
    "telemetry": f"map_concat(map('semantic_plan', {told('s * 0.5D', 's * 0.001D', '10 * s', 'cast(k % 3 as int)')}, 'layout', {told('cast(k % 10 as double)', '0.25D', 's', '0')}), if(k % 33 = 1, map('odd', {told('1D', '1D', '1', '1')}), map()))",
    "dataset": """named_struct('license', 'cc0', 'code_version', concat('v', k % 2), 'stratum', p_brand, 'split', get(array('train', 'val', 'test', 'holdout'), cast(k % 4 as int)),
      'safety', named_struct('nsfw', (s % 10) / 10D, 'nsfw_label', 'ok', 'release_blocked', s % 13 = 0, 'needs_review', false, 'applied', array(), 'pending', array(), 'is_duplicate', k % 14 = 0),
      'quality', named_struct('clip_score', s / 100D, 'aesthetic', if(k % 8 = 0, null, (k % 90) / 10D), 'image_reward', null, 'faithfulness', (s % 7) / 8D, 'detection_coverage', 0.5D,
        'per_image', transform(sequence(0, cast(k % 3 as int)), i -> named_struct('idx', i, 'clip_score', (s + i) / 64D, 'aesthetic', if(i = 1, null, i / 4D), 'image_reward', null, 'faithfulness', 0D, 'detection_coverage', 0D, 'nsfw', (s % 5 + i) / 8D, 'phash', 0L)),
        'passed_gate', if(k % 15 = 0, null, s % 2 = 0), 'gate_reasons', if(s % 2 = 0, null, array('low_clip'))))""",
    "meta": "named_struct('planner', concat('m', k % 3), 'base_url', 'u', 'projected_gpu', 'T4', 'created_at', concat('2024-01-0', 1 + k % 9), 'model_load_s', 1D, 'execution', 'e', 'seed', k, 'n_variations', cast(k % 4 as int))",
}


def records(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as k", "p_size as s", "p_name", "p_brand", "p_type")
    kinds = {f.name: f.dataType for f in StructType.fromDDL(T.SCHEMA).fields}
    return part.select(*(F.expr(e).cast(kinds[c]).alias(c) for c, e in RECORDS.items()))


REC = "rec as (select p_partkey as k, p_size as s, 'p' || p_partkey as id, * from part)"
TEMPERATURE = "['cold', 'warm', 'neutral', 'mauve'][s % 4 + 1]"
PREDICATE = "['on', 'behind', 'beside', 'inside', 'near', 'part_of'][k % 6 + 1]"
PHRASE = "['on', 'behind', 'beside', 'inside', 'near', 'part of'][k % 6 + 1]"
SATURATION = "['high', 'low', 'medium'][k % 3 + 1]"
FILL = "['low', 'medium', 'high', 'extreme'][k % 4 + 1]"
OBJECT = "case when k % 12 = 0 then 'ghost' when k % 12 = 1 then 'floor' else 'man_b' end"
KIND = "case when k % 25 = 4 then 'ghostly' when s % 3 = 0 then 'background' else 'character' end"
BOXED = "case when k % 17 = 5 then 'full' when k % 19 = 6 then 'bad' else 'fine' end"
SECOND = "case when k % 30 = 13 then 'lamp' else 'man_b' end"
SCALE = "regexp_replace(format('{:.6f}', (s % 10) / 8.0), '[.]?0+$', '')"
SLUGGED = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""with {REC}, t as (select *, {OBJECT} as obj, {KIND} as kind, {BOXED} as boxed, {SECOND} as second from rec)
  select id, array_to_string(list_filter([case when k % 50 = 7 then 'prompt' end, case when k % 20 = 3 then 'plan_fields' end, case when s % 4 = 0 then 'plan_elements' end, case when k % 40 = 11 then 'layout_canvas' end,
    case when kind = 'ghostly' then 'entity_kind' end, case when boxed = 'bad' then 'entity_box' end, case when boxed = 'full' and kind <> 'background' then 'entity_full_frame' end, case when second = 'lamp' then 'entity_ids' end,
    case when k % 6 = 2 then 'relation_predicate' end, case when obj = 'ghost' or (obj = 'man_b' and second = 'lamp') then 'relation_ends' end, case when (s % 10) / 8.0 > 1 then 'composition' end, case when k % 4 = 3 then 'lighting' end,
    case when k % 9 = 0 then 'materials' end, case when k % 11 = 0 then 'palette' end, case when s % 4 = 3 then 'temperature' end, case when k % 21 = 2 and k % 4 > 0 then 'images' end, case when k % 4 = 3 then 'split' end, case when k % 33 = 1 then 'telemetry_stages' end],
    lambda x: x is not null), ',') as errors from t""")
def record_errors(spark: SparkSession, d: str) -> DataFrame:
    return T.validate(records(spark, d)).select("id", F.array_join("errors", ",").alias("errors"))


@query(f"with {REC} select id, {PREDICATE} as predicate, {TEMPERATURE} as temperature, {SATURATION} as saturation from rec")
def record_normalised(spark: SparkSession, d: str) -> DataFrame:
    return T.normalised(records(spark, d)).select("id", F.col("layout.relations")[0]["predicate"].alias("predicate"), "color_script.temperature", "color_script.saturation")


@query(f"with {REC}, t as (select *, {OBJECT} as obj, {SECOND} as second from rec) select id, array_to_string(list_filter(['lamp', obj], lambda x: x <> 'lamp' and x <> second and x <> 'floor'), ',') as unknown_ends from t")
def fk_check(spark: SparkSession, d: str) -> DataFrame:
    """Ends of relations that are neither entities of their record nor implicit anchors."""
    ids = F.transform("layout.entities", lambda e: e["id"])
    ends = F.concat(F.transform("layout.relations", lambda r: r["subject"]), F.transform("layout.relations", lambda r: r["object"]))
    return records(spark, d).select("id", F.array_join(T.unknown_ends(ends, ids), ",").alias("unknown_ends"))


CELL = "case when k % 17 = 5 then 'center' when k % 19 = 6 then 'bottom' else 'left' end"


@query(f"""with {REC} select id, concat_ws(' ', 'PLAN_SUBJ:' || {SLUGGED.format('p_name')}, 'ENV:' || {SLUGGED.format('p_brand')}, 'CAM:' || {SLUGGED.format('p_type')}, 'MOOD:' || case when k % 20 = 3 then '' else 'calm' end,
    case when s % 4 <> 0 then 'ELEM:' || {SLUGGED.format('p_brand')} || ' ELEM:' || {SLUGGED.format('p_type')} end,
    'AT:lamp:object:' || ['left', 'center', 'center', 'right'][s % 4 + 1], 'AT:' || replace({SECOND}, '_', '-') || ':' || {KIND} || ':' || {CELL}, 'REL:lamp:' || {PREDICATE} || ':' || replace({OBJECT}, '_', '-'),
    'LENS_35MM', case when s % 2 = 0 then 'THIRDS' end, 'SCALE:' || {SCALE}, case when s % 3 = 0 then 'LEADING' end, case when s % 5 = 0 then 'SYMMETRY' end, 'LIGHT_KEY:side-window', 'FILL_' || upper({FILL}), case when s % 2 = 1 then 'RIM' end, 'CONTRAST_HIGH',
    case when k % 9 <> 0 then 'MAT:wet-glass:' || {SLUGGED.format('p_brand')} end, 'COLOR_' || upper({TEMPERATURE}), 'SAT_' || upper({SATURATION}), case when k % 11 = 0 then 'PAL:#zz0000' else 'PAL:#a1b2c3 PAL:#00ff00' end, 'RENDER') as tokens from rec""")
def visual_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.normalised(records(spark, d)).select("id", F.array_join(T.visual_tokens(), " ").alias("tokens"))


PROMPT_SQL = f"""concat_ws('. ', p_name || ' in ' || p_brand, p_type || ' shot', case when k % 20 = 3 then '' else 'calm' end || ' mood',
  'composition: 35mm lens, subject scale ' || {SCALE} || case when s % 2 = 0 then ', rule of thirds' else '' end || case when s % 3 = 0 then ', leading lines' else '' end || case when s % 5 = 0 then ', symmetrical composition' else '' end,
  'lighting: Side window key light, ' || {FILL} || ' fill' || case when s % 2 = 1 then ', rim light' else '' end || ', high contrast', case when k % 9 <> 0 then 'materials: Wet Glass ' || p_brand end,
  'color script: ' || {TEMPERATURE} || ' palette (' || case when k % 11 = 0 then '#zz0000' else '#A1B2C3, #00ff00' end || '), ' || {SATURATION} || ' saturation', 'spatial relations: lamp ' || {PHRASE} || ' ' || replace({OBJECT}, '_', ' '),
  case when s % 4 <> 0 then 'featuring ' || p_brand || ', ' || p_type end, 'highly detailed, cinematic')"""


@query(f"with {REC} select id, {PROMPT_SQL} as prompt from rec")
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    return T.normalised(records(spark, d)).select("id", T.render_prompt().alias("prompt"))


@query(f"""with {REC} select id, 'system,user,assistant' as roles, case when k % 50 = 7 then '' else p_name end as asked, case when s % 7 = 0 then 'rich ' || p_name else {PROMPT_SQL} end as said,
  'A,' || upper(p_type) as tokens, p_brand as environment, s % 2 = 0 as thirds from rec""")
def chat_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = T.normalised(records(spark, d)).select("id", T.chat_example("sys").alias("m"))
    kind = "struct<reasoning:struct<semantic_plan:struct<environment:string>,composition:struct<rule_of_thirds:boolean>>,visual_tokens:array<string>,render_prompt:string>"
    body = F.from_json(F.col("m")[2]["content"], kind)
    return rows.select(
        "id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.col("m")[1]["content"].alias("asked"), body["render_prompt"].alias("said"), F.array_join(body["visual_tokens"], ",").alias("tokens"),
        body["reasoning"]["semantic_plan"]["environment"].alias("environment"), body["reasoning"]["composition"]["rule_of_thirds"].alias("thirds"),
    )


@query(f"with {REC} select case when k % 50 = 7 then '' else p_name end as prompt, 'A ' || upper(p_type) as completion, count(*) as n from rec group by all")
def token_targets(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(T.token_target().alias("t")).groupBy("t.prompt", "t.completion").agg(F.count("*").alias("n"))


@query(f"""with {REC} select id, 'subject=' || p_name || '; environment=' || p_brand || '; camera=' || p_type || '; mood=' || case when k % 20 = 3 then '' else 'calm' end || '; elements=' || case when s % 4 = 0 then '' else p_brand || ', ' || p_type end as plan,
  'entities=[lamp(object), ' || {SECOND} || '(' || {KIND} || ')]; relations=[lamp ' || {PREDICATE} || ' ' || {OBJECT} || ']' as layout, 'key_light=Side window; fill=' || {FILL} || '; rim=' || case when s % 2 = 1 then 'True' else 'False' end || '; contrast=high' as lighting,
  case when k % 9 = 0 then '' else 'Wet Glass=' || p_brand end as materials, 'palette=' || case when k % 11 = 0 then '#zz0000' else '#A1B2C3, #00ff00' end || '; temperature=' || {TEMPERATURE} || '; saturation=' || {SATURATION} as colour from rec""")
def compact_priors(spark: SparkSession, d: str) -> DataFrame:
    names = {"plan": "semantic_plan", "layout": "layout", "lighting": "lighting", "materials": "materials", "colour": "color_script"}
    return T.normalised(records(spark, d)).select("id", *(T.compact_prior(s).alias(n) for n, s in names.items()))


@query(f"""with {REC} select id, case when k % 50 = 7 then '' else p_name end as first, 'N1 semantic_plan' as named, 2 as priors, true as ends, 'bad' as error from rec""")
def stage_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What the prompt of the third stage holds, and of a repair."""
    p = T.stage_prompt("composition", "Decide.", "{}")
    rows = records(spark, d).select("id", p.alias("p"), T.repair_prompt(F.lit("bad")).alias("r"))
    return rows.select(
        "id", F.get(F.split("p", "\n"), F.lit(1)).alias("first"), F.regexp_extract("p", r"- (\S+ semantic_plan): subject=", 1).alias("named"), F.regexp_count("p", F.lit(r"\n- N\d ")).alias("priors"),
        F.endswith(F.col("p"), F.lit("fits this JSON Schema:\n{}")).alias("ends"), F.get(F.split("r", "\n"), F.lit(1)).alias("error"),
    )


SPENT = "s * 0.5::double + k % 10 + case when k % 33 = 1 then 1 else 0 end"
PAID = "s * 0.001::double + 0.25::double + case when k % 33 = 1 then 1 else 0 end"


@query(f"""with {REC} select id, round({SPENT}, 6) as total_compute_s, round({PAID}, 8) as total_projected_cost_usd, round({SPENT} + case when k % 5 = 0 then 0 else 3.5 end, 6) as e2e_compute_s,
  round({PAID} + case when k % 5 = 0 then 0 else s * 0.01::double end, 8) as e2e_cost_usd from rec""")
def record_totals(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", *(c.alias(n) for n, c in T.totals().items()))


@query(f"""with {REC}, t as (select {SPENT} as rs, {PAID} as ru, k % 5 <> 0 as has, case when k % 5 = 0 then 0 else 3.5 end as es, case when k % 5 = 0 then 0 else s * 0.01::double end as eu, k % 3 + (k % 33 = 1)::int as retries, 10 * s + s + (k % 33 = 1)::int as tokens, k from rec)
  select count(*) as n, count(*) filter (k % 6 <> 0) as n_with_image, min('2024-01-0' || (1 + k % 9)) as date_from, max('2024-01-0' || (1 + k % 9)) as date_to, round(avg(rs), 6) as reasoning_s_mean, round(sum(ru), 6) as reasoning_usd_total, count(*) filter (has) as n_rendered,
  round(avg(es) filter (has), 6) as render_s_mean, round(avg(eu) filter (has), 6) as render_usd_mean, round(sum(ru + eu), 6) as e2e_usd_total, round(quantile_cont(rs + es, 0.9), 6) as e2e_s_p90, sum(tokens)::bigint as tokens_total, sum(retries)::bigint as total_retries,
  round(count(*) filter (retries = 0) / count(*)::double, 6) as first_try_valid_rate from t""")
def cost_report(spark: SparkSession, d: str) -> DataFrame:
    r = cost.cost_summary(cost.record_totals(records(spark, d)))
    rounded = ["reasoning_s_mean", "reasoning_usd_total", "render_s_mean", "render_usd_mean", "e2e_usd_total", "e2e_s_p90", "first_try_valid_rate"]
    return r.select("n", "n_with_image", "date_from", "date_to", "n_rendered", "tokens_total", "total_retries", *(F.round(c, 6).alias(c) for c in rounded))


def renders(spark: SparkSession, d: str) -> DataFrame:
    """Render records of some line items: several of a part, and some of parts that are not there."""
    line = table(spark, d, "lineitem").filter("l_linenumber = 1").selectExpr("if(l_orderkey % 10 = 0, -1, l_partkey) as k", "l_orderkey as o", "l_quantity as q")
    return line.selectExpr(
        "concat('p', k) as id", "concat('new ', o) as prompt", "if(o % 3 = 0, null, o) as seed",
        "if(o % 4 = 0, null, named_struct('compute_s', q, 'rate_usd_per_s', 0.5D, 'cost_usd', if(o % 2 = 0, null, q * 2), 'projected_cost_usd', q * 3, 'gpu', if(o % 5 = 0, null, 'T4'))) as telemetry",
        "array(named_struct('path', 'x', 'sha256', 'h', 'idx', 0, 'width', 1, 'height', 1, 'seed', o)) as images",
    )


@query("""select 'p' || l_partkey as id, 'new ' || l_orderkey as enriched_prompt, case when l_orderkey % 3 = 0 then -1 else l_orderkey end as seed, l_orderkey as image_seed, 'mit' as license, null::varchar as split, true as bare,
  case when l_orderkey % 4 = 0 then null when l_orderkey % 2 = 0 then l_quantity * 3 else l_quantity * 2 end as usd, case when l_orderkey % 4 = 0 then null when l_orderkey % 5 = 0 then 'unknown' else 'T4' end as gpu, p_name as subject
  from lineitem join part on p_partkey = l_partkey where l_linenumber = 1 and l_orderkey % 10 <> 0""")
def assemble_join(spark: SparkSession, d: str) -> DataFrame:
    out = assemble.assemble(renders(spark, d), records(spark, d), license_name="mit", code_version="v2")
    return out.select(
        "id", "enriched_prompt", F.coalesce("meta.seed", F.lit(-1)).cast("long").alias("seed"), F.col("images")[0]["seed"].alias("image_seed"), "dataset.license", "dataset.split", (F.col("dataset.quality").isNull() & F.col("dataset.safety").isNull()).alias("bare"),
        F.col("render.projected_cost_usd").alias("usd"), F.col("render.projected_gpu").alias("gpu"), F.col("semantic_plan.subject").alias("subject"),
    )


LISTED = "select id, k, case when k % 4 = 0 then [] when k % 21 = 2 then list_transform(range(k % 4), lambda i: -1) else range(k % 4) end as idx from rec"


@query(f"""with {REC}, w as (select id, k, unnest(idx) as idx from ({LISTED})), f as (select distinct 'p' || l_partkey || '_' || l_linenumber % 4 || '.webp' as path from lineitem where l_returnflag = 'A')
  select w.id, count(*) as n_images, min(w.idx) as least from w join f on f.path = w.id || '_' || w.idx || '.webp' group by 1""")
def image_semi_join(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "lineitem").filter("l_returnflag = 'A'").selectExpr("concat('p', l_partkey, '_', l_linenumber % 4, '.webp') as path")
    return assemble.existing_images(records(spark, d), paths).groupBy("id").agg(F.count("*").alias("n_images"), F.min("idx").cast("long").alias("least"))


@query(f"""with {REC}, w as (select id, k, unnest(idx) as idx from ({LISTED})), f as (select distinct 'p' || l_partkey || '_' || l_linenumber % 4 || '.webp' as path from lineitem where l_returnflag = 'A')
  select rec.id, count(f.path) as n_images from rec left join w on w.id = rec.id left join f on f.path = w.id || '_' || w.idx || '.webp' group by 1""")
def image_counts(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "lineitem").filter("l_returnflag = 'A'").selectExpr("concat('p', l_partkey, '_', l_linenumber % 4, '.webp') as path")
    return assemble.image_counts(records(spark, d), paths)


@query("""with k as (select *, row_number() over (partition by lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) order by doc_id) as r, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as t from documents)
  select doc_id, lang, n_chars from k where r = 1 and t <> ''""")
def keep_first_text(spark: SparkSession, d: str) -> DataFrame:
    return assemble.first_of_key(table(spark, d, "documents"), F.col("text"), "doc_id").select("doc_id", "lang", "n_chars")


@query(f"""with {REC}, i as (select id, k, s, unnest(range(k % 3 + 1)) as i from rec)
  select id, round(avg((s + i) / 64.0::double), 4) as clip, round(avg(case when i = 1 then null else i / 4.0::double end), 4) as aesthetic, round(max((s % 5 + i) / 8.0::double), 4) as nsfw, null::double as reward from i group by 1""")
def per_image_totals(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("dataset.quality.per_image")
    return records(spark, d).select("id", quality.per_image_total(p, "clip_score").alias("clip"), quality.per_image_total(p, "aesthetic").alias("aesthetic"), quality.per_image_total(p, "nsfw", "max").alias("nsfw"), quality.per_image_total(p, "image_reward").alias("reward"))


@query(f"""with {REC}, o as (select *, row_number() over (order by id) - 1 as row from rec)
  select id, format('shard-{{:05d}}.tar', row // 100) as shard, p_brand as stratum, ['train', 'val', 'test', 'holdout'][k % 4 + 1] as split, k as seed, case when k % 15 = 0 then 'unknown' when s % 2 = 0 then 'true' else 'false' end as passed_gate, case when s % 2 = 0 then '' else 'low_clip' end as reasons,
  s / 100.0::double as clip_score, s % 13 = 0 as release_blocked, k % 4 as n_images from o""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    placed = shards.with_shards(records(spark, d), "id", 100).withColumn("n_images", F.coalesce(F.size("images"), F.lit(0)))
    n = F.when(F.col("n_images") < 0, 0).otherwise(F.col("n_images")).cast("long").alias("n_images")
    return shards.index_rows(placed).select("id", "shard", "stratum", "split", "seed", F.coalesce(F.col("passed_gate").cast("string"), F.lit("unknown")).alias("passed_gate"), F.array_join("gate_reasons", ",").alias("reasons"), "clip_score", "release_blocked", n)


@query(f"with {REC} select count(*) as n_samples, 'cc0' as license, arg_min('v' || k % 2, id) as code_version, arg_min('m' || k % 3, id) as planner from rec")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return shards.manifest(records(spark, d), "id")


@query(f"""with {REC} select id, ['train', 'val', 'test'][(k % 3 + 1)::int] as split, 'cc0' as license, k % 7 = 0 as is_duplicate, array_to_string(list_filter([case when k % 7 = 0 then 'duplicate' end, case when s / 100.0::double < 0.3 then 'low_clip' end,
    case when (k % 90) / 10.0::double < 4.5 then 'low_aesthetic' end, case when (s % 7) / 8.0::double < 0.3 then 'low_faithfulness' end, case when (s % 10) / 10.0::double > 0.5 then 'nsfw' end, case when s % 13 = 0 then 'release_blocked' end, case when k % 29 = 0 then 'eval_failed' end],
    lambda x: x is not null), ',') as reasons from rec where k % 8 <> 0""")
def merged_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """The results of an evaluation in the dataset block, with a limit of the caller's."""
    k = F.substring("id", 2, 20).cast("long")
    rows = records(spark, d).filter(k % 8 != 0).withColumns({"q": F.col("dataset.quality"), "s": F.col("dataset.safety"), "x": F.get(F.array(*[F.lit(n) for n in V.SPLITS]), (k % 3).cast("int")), "dup": k % 7 == 0, "failed": k % 29 == 0})
    out = quality.merge_evaluation(rows, "q", "s", "x", "dup", failed="failed", clip_min=0.3)
    return out.select("id", "dataset.split", "dataset.license", "dataset.safety.is_duplicate", F.array_join("dataset.quality.gate_reasons", ",").alias("reasons"))


@query(f"""with {REC}, p as (select 'clip_score' as metric, s / 100.0::double as x, (s % 2 = 0)::int::double as y from rec where k % 15 <> 0 union all select 'aesthetic', (k % 90) / 10.0::double, (s % 2 = 0)::int::double from rec where k % 15 <> 0 and k % 8 <> 0),
  r as (select metric, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2.0 as rx, rank() over (partition by metric order by y) + (count(*) over (partition by metric, y) - 1) / 2.0 as ry from p),
  c as (select metric, x, sum(count(*)) over (partition by metric order by x desc) as taken, sum(sum(y)) over (partition by metric order by x desc) as hits from p group by 1, 2), a as (select metric, sum(y) as all_pos from p group by 1),
  f as (select metric, x, hits / taken as p, hits / all_pos as r, 2 * hits / (taken + all_pos) as f1, row_number() over (partition by metric order by 2 * hits / (taken + all_pos) desc, x) as nth from c join a using (metric)),
  g as (select metric, count(*) as n, round(corr(rx, ry), 4) as spearman from r group by 1)
  select g.metric, n, spearman, x as threshold, round(p, 4) as precision, round(r, 4) as recall, round(f1, 4) as f1 from g join f using (metric) where nth = 1 union all select 'image_reward', 0, null, null, null, null, null""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("dataset.quality")
    rows = records(spark, d).select(q["clip_score"].alias("clip_score"), q["aesthetic"].alias("aesthetic"), q["image_reward"].alias("image_reward"), q["passed_gate"].cast("int").alias("good"))
    return calibration.correlate(rows, ["clip_score", "aesthetic", "image_reward"], "good")


@query(f"""with {REC} select id, case when k % 50 = 7 then '' else p_name end as prompt, case when {KIND} = 'character' then 'lamp,' || {SECOND} else 'lamp' end as labels, k % 4 as n from rec where k % 4 > 0 and k % 10 <> 9""")
def evaluation_payload(spark: SparkSession, d: str) -> DataFrame:
    return E.payload(records(spark, d)).select("id", "prompt", F.array_join(F.transform("entities", lambda e: e["label"]), ",").alias("labels"), F.size("paths").cast("long").alias("n"))


@query("""select vec_id, len(list_filter([0.05::double, abs(embedding[1]::double), abs(embedding[2]::double)], lambda x: x >= 0.1)) as n,
  case when abs(embedding[1]::double) >= 0.1 then ['cat', 'dog'][(vec_id % 2) + 1] when abs(embedding[2]::double) >= 0.1 then 'dog' end as first,
  case when vec_id % 3 = 0 then null when vec_id % 3 = 1 then 0.0::double else 0.75::double end as nsfw from embeddings""")
def raw_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections that score enough, and the NSFW probability among labelled predictions."""
    at = lambda i: F.abs(F.get(F.col("embedding"), F.lit(i)).cast("double"))
    raw = lambda label, score: F.struct(label.cast("int").alias("label"), *(F.lit(x).alias(n) for n, x in (("x0", 10.0), ("y0", 20.0), ("x1", 110.0), ("y1", 220.0))), score.alias("score"))
    boxes = F.array(raw(F.lit(0), F.lit(0.05)), raw(F.col("vec_id") % 2, at(0)), raw(F.lit(1), at(1)))
    found = E.detections(boxes, F.array(F.lit("cat"), F.lit("dog")), F.lit(200.0), F.lit(400.0))
    said = lambda label, score: F.array(F.struct(F.lit(label).alias("label"), F.lit(score).alias("score")))
    predictions = F.when(F.col("vec_id") % 3 == 1, said("normal", 0.25)).when(F.col("vec_id") % 3 == 2, said("NSFW", 0.75))
    rows = table(spark, d, "embeddings").select("vec_id", found.alias("f"), E.nsfw_probability(predictions).alias("nsfw"))
    return rows.select("vec_id", F.size("f").cast("long").alias("n"), F.get("f", F.lit(0))["label"].alias("first"), "nsfw")


@query(f"""with {REC} select id, case when k % 4 = 0 then '' else array_to_string(list_transform(range(k % 4), lambda i: id || '_' || i || '.webp:' || (100 + k + i)), ',') end as refs,
  case when k % 4 > 0 then k % 4 when k % 6 <> 0 then 1 else 0 end as n_final, case when s % 3 = 0 then 20 else s end::bigint as steps, greatest(1, k % 4) as n, case when s % 2 = 0 then (case when k % 5 <= 1 then 4.0 else k % 5 end)::double else (k % 5)::double end as guidance,
  case when s % 2 = 0 then 'blur' end as negative from rec""")
def render_arguments(spark: SparkSession, d: str) -> DataFrame:
    """References of rendered images, the list of final ones, and a renderer's arguments with its defaults."""
    k = F.substring("id", 2, 20).cast("long")
    size = F.round(F.col("dataset.quality.clip_score") * 100).cast("int")
    hashes = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    refs = E.image_references(F.col("id"), hashes, F.lit(8), F.lit(8), k + 100)
    args = E.render_arguments(F.when(size % 3 != 0, size), (k % 5).cast("double"), k % 4, F.when(size % 2 == 0, "blur").otherwise(" "), default_steps=20, default_guidance=7.0, takes_negative=True)
    return records(spark, d).select(
        "id", F.array_join(F.transform(refs, lambda r: F.concat(r["path"], F.lit(":"), r["seed"].cast("string"))), ",").alias("refs"), F.size(E.final_images(F.col("final_images"), F.col("final_image"))).cast("long").alias("n_final"),
        args["steps"].cast("long").alias("steps"), args["n"].alias("n"), args["guidance"].alias("guidance"), args["negative"].alias("negative"),
    )


@query("""select event_id, round(case when value = 0 then 0 else (event_id % 90) / value end, 6) as per_s, format('{:.3f}', value) as fixed, bit_count(xor(event_id, user_id))::int as distance, 32 as same_bits from events""")
def small_scalars(spark: SparkSession, d: str) -> DataFrame:
    half = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + F.col("event_id")) % 2)
    return table(spark, d, "events").select("event_id", F.round(X.tokens_per_s(F.col("event_id") % 90, F.col("value")), 6).alias("per_s"), X.fixed(F.col("value"), 3).alias("fixed"), X.hamming(F.col("event_id"), F.col("user_id")).alias("distance"), F.bit_count(X.average_hash(half.cast("array<double>"))).alias("same_bits"))


@query(f"""with {REC} select id, p_name as subject, k % 4 as n_images, (s % 10) / 8.0::double as scale, k % 6 = 0 as no_image from rec""")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines, in two portions, and read back."""
    path = scratch(spark, "jsonl")
    rows = records(spark, d)
    files.write_jsonl(rows.filter("meta.seed % 2 = 0"), path)
    files.append_records(rows.filter("meta.seed % 2 = 1"), path)
    back = files.read_jsonl(spark, path)
    n = F.when(F.col("images").isNull(), 0).otherwise(F.size("images")).cast("long").alias("n_images")
    return back.select("id", "semantic_plan.subject", n, F.col("composition.subject_scale").alias("scale"), F.col("final_image").isNull().alias("no_image"))


@query(f"""with {REC} select id, round(s / 100.0::double, 4) as clip_score, round((k % 90) / 10.0::double, 4) as aesthetic, (s % 2)::int as human_good from rec where k % 5 <> 0 and k % 8 <> 0""")
def label_sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for labels written as CSV, labelled, read back: rows without a label are left out."""
    q, path = F.col("dataset.quality"), scratch(spark, "sheet")
    rows = records(spark, d).filter(q["aesthetic"].isNotNull()).select("id", "prompt", q["clip_score"].alias("clip_score"), q["aesthetic"].alias("aesthetic"))
    k, size = F.substring("id", 2, 20).cast("long"), F.round(F.col("clip_score") * 100).cast("int")
    done = files.label_sheet(rows, ["clip_score", "aesthetic"]).withColumn("human_good", F.when(k % 5 == 0, " ").otherwise(F.concat((size % 2).cast("string"), F.lit(".0"))))
    files.write_csv(done, path, {"clip_score": "%.4f", "aesthetic": "%.4f"})
    return calibration.labelled(files.read_sheet(spark, path), ["clip_score", "aesthetic"]).select("id", "clip_score", "aesthetic", "human_good")


@query(f"""with {REC}, o as (select *, row_number() over (order by id) - 1 as row from rec), i as (select id, k % 4 as n from rec)
  select format('shard-{{:05d}}.tar', row // 100) as shard, count(*) as n_records, sum(n)::bigint as n_images from o join i using (id) group by 1""")
def tar_shards(spark: SparkSession, d: str) -> DataFrame:
    """Archives of records with images beside them."""
    rows = records(spark, d)
    placed = shards.with_shards(rows.select("id", "prompt"), "id", 100).withColumn("json", F.to_json(F.struct("id", "prompt")))
    images = rows.select("id", F.explode(F.sequence(F.lit(1), F.col("meta.n_variations"))).alias("idx")).filter("idx > 0 and cast(substring(id, 2, 20) as bigint) % 4 >= idx").select("id", "idx", F.lit(b"im").alias("content"))
    return files.write_shards(placed, scratch(spark, "shards"), images).select("shard", "n_records", "n_images")


@query(f"""with {REC}, o as (select *, row_number() over (order by id) - 1 as row from rec), i as (select id, k % 4 as n from rec),
  m as (select row, -1 as idx, id || '.json' as name, '{{"id":"' || id || '"}}' as data from o
    union all select row, g.idx, id || '.' || g.idx || '.webp', id || ' image ' || g.idx from o join i using (id), (select unnest([1, 2, 3]) as idx) g where g.idx <= n)
  select format('shard-{{:05d}}.tar', row // 100) as archive, row_number() over (partition by row // 100 order by row, idx) - 1 as nth, name, octet_length(encode(data)) as size, sha256(data) as sha256 from m""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Every member of the archives that were written, by name, place, size and digest of its bytes."""
    rows = records(spark, d)
    placed = shards.with_shards(rows.select("id"), "id", 100).withColumn("json", F.to_json(F.struct("id")))
    images = rows.select("id", F.explode(F.sequence(F.lit(1), F.col("meta.n_variations"))).alias("idx")).filter("idx > 0 and cast(substring(id, 2, 20) as bigint) % 4 >= idx").select("id", "idx", F.concat("id", F.lit(" image "), F.col("idx").cast("string")).cast("binary").alias("content"))
    folder = scratch(spark, "shards")
    files.write_shards(placed, folder, images)
    return sinks.archive_members(spark, folder)


# Values of a field as JSON, and what they are read as; None is no value of its kind.
FLAGS = (("true", True), ('"Yes"', True), ("1", True), ("0.0", False), ('" off "', False), ('"maybe"', None), ("2", None), ("null", None), ("[1]", None))
SHARES = (("0.4", 0.4), ('" 0.7 "', 0.7), ("true", 1.0), ("1", 1.0), ('"1e-1"', 0.1), ("1.5", None), ('"x"', None), ("{}", None), ("-0.0001", None))


def listed_sql(values: tuple, kind: str) -> str:
    return "[" + ", ".join("null" if v is None else str(v).lower() for _, v in values) + f"]::{kind}[]"


@query(f"""with a as (select p_partkey as k, ({listed_sql(FLAGS, "boolean")})[p_partkey % 9 + 1] as f, ({listed_sql(SHARES, "double")})[p_partkey // 9 % 9 + 1] as s, p_partkey % 11 = 0 as bare, p_partkey % 13 = 0 as cut from part)
  select k, case when cut or bare or f is null or s is null then '' else f::varchar end as rule_of_thirds, case when cut or bare or f is null or s is null then null else s end as subject_scale,
    case when cut then 'no JSON' else concat_ws(',', case when f is null then 'rule_of_thirds is wrong' end, case when s is null then 'subject_scale is wrong' end, case when bare then 'symmetry is missing' end) end as errors from a""")
def lax_answers(spark: SparkSession, d: str) -> DataFrame:
    """Raw JSON answers with flags and numbers of many kinds, other fields, missing ones and broken texts, read as variants."""
    from loomlake.functions.lax import read_answers

    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v, _ in values)), (at + 1).cast("int"))
    parts = [F.lit('{"extra": {"lens": 3}, "lens": "50mm", "leading_lines": "t", "rule_of_thirds": '), pick(FLAGS, k % 9), F.lit(', "subject_scale": '), pick(SHARES, F.floor(k / 9) % 9)]
    said = F.concat(*parts, F.when(k % 11 != 0, ', "symmetry": "false"').otherwise(""), F.when(k % 13 != 0, "}").otherwise(""))
    out = read_answers(table(spark, d, "part").select(k.alias("k"), said.alias("answer")), "answer", "composition")
    return out.select("k", F.coalesce(F.col("read.rule_of_thirds").cast("string"), F.lit("")).alias("rule_of_thirds"), "read.subject_scale", F.concat_ws(",", "errors").alias("errors"))
