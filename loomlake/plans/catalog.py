"""The registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import scalars as X
from loomlake.functions import vocabulary as V
from loomlake.operators import assemble, calibration, cost, hashdup, prompts, quality, shards, spatial
from loomlake.plans.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels: quality and toxic are null where there is none."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


GATED = """select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, case when l.doc_id is null then null else coalesce(l.quality, 1) = 1 and coalesce(l.toxic, 0) = 0 end as gate
  from documents d left join labels l using (doc_id)"""


def gated(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return rows.withColumn("gate", F.when(F.col("known"), (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)))


@query(f"""with g as ({GATED}) select coalesce(nullif(lang, ''), 'unknown') as stratum, count(*) as n,
  round(cast(count(*) filter (gate) as double) / count(*), 4) as gate_pass_rate,
  round(avg(n_chars::double), 4) as n_chars_mean, round(avg(quality::double), 4) as quality_mean from g group by 1""")
def by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_stratum(gated(spark, d), "lang", "gate", ["n_chars", "quality"])


@query(f"""with g as ({GATED}) select coalesce(nullif(lang, ''), 'unknown') as stratum, count(*) as n, count(*) filter (gate) as passed,
  count(*) filter (not gate) as failed, count(*) filter (gate is null) as unknown, round(avg(n_chars::double), 4) as n_chars_mean from g group by rollup(1)""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(gated(spark, d), "lang", "gate", ["n_chars"])


@query("""with m as (select 'events_value' as metric, value::double as v from events union all select 'n_chars', n_chars::double from documents)
  select metric, count(v) as n, round(avg(v), 4) as mean, round(quantile_cont(v, 0.1), 4) as p10, round(quantile_cont(v, 0.5), 4) as p50,
  round(quantile_cont(v, 0.9), 4) as p90, round(min(v), 4) as min, round(max(v), 4) as max from m group by 1""")
def quality_distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.distribution(table(spark, d, "events").select(F.col("value").alias("events_value")), ["events_value"]).unionByName(quality.distribution(table(spark, d, "documents"), ["n_chars"]))


@query("""with x as (select d.doc_id, l.quality * 0.3::double as clip, (d.n_chars % 100) / 10.0::double as aes, (d.n_chars % 7) / 10.0::double as faith,
    case when l.toxic is null then null else 0.1::double + l.toxic * (d.n_chars % 10) / 10.0::double end as nsfw from documents d left join labels l using (doc_id)),
  r as (select doc_id, list_filter([case when doc_id % 50 = 0 then 'duplicate' end, case when clip < 0.22 then 'low_clip' end, case when aes < 4.5 then 'low_aesthetic' end,
    case when faith < 0.3 then 'low_faithfulness' end, case when nsfw > 0.5 then 'nsfw' end, case when nsfw >= 0.85 then 'release_blocked' end], lambda s: s is not null) as reasons from x)
  select doc_id, array_to_string(reasons, ',') as gate_reasons, len(reasons) = 0 as passed_gate from r""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    nsfw = F.when(F.col("toxic").isNotNull(), F.lit(0.1) + F.col("toxic") * (F.col("n_chars") % 10) / F.lit(10.0))
    blocked = quality.safety(nsfw)["release_blocked"]
    reasons = quality.gate_reasons(F.col("quality") * F.lit(0.3), (F.col("n_chars") % 100) / F.lit(10.0), (F.col("n_chars") % 7) / F.lit(10.0), nsfw, blocked, F.col("doc_id") % 50 == 0)
    return judged(spark, d).select("doc_id", F.array_join(reasons, ",").alias("gate_reasons"), quality.passed(reasons).alias("passed_gate"))


@query("""select doc_id, case when p is null then 'unknown' when p >= 0.85 then 'blocked' when p >= 0.5 then 'review' else 'ok' end as nsfw_label,
  coalesce(p >= 0.85, false) as release_blocked, coalesce(p >= 0.5, false) as needs_review
  from (select d.doc_id, (l.toxic * (d.n_chars % 11)) / 10.0::double as p from documents d left join labels l using (doc_id))""")
def safety_label(spark: SparkSession, d: str) -> DataFrame:
    s = quality.safety((F.col("toxic") * (F.col("n_chars") % 11)) / F.lit(10.0))
    return judged(spark, d).select("doc_id", s["nsfw_label"].alias("nsfw_label"), s["release_blocked"].alias("release_blocked"), s["needs_review"].alias("needs_review"))


SPLIT = "(('0x' || substr(sha256('7:' || doc_id::varchar), 1, 12))::bigint % 1000000) / 1e6::double"
SPLIT_NAME = f"case when {SPLIT} < 0.8::double then 'train' when {SPLIT} < 0.8::double + 0.1::double then 'val' else 'test' end"


@query(f"select doc_id, {SPLIT} as fraction, {SPLIT_NAME} as split from documents")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", X.split_fraction(key, 7).alias("fraction"), X.assign_split(key, seed=7).alias("split"))


@query(f"select s.split, count(d.split) as n from (values ('train'), ('val'), ('test')) s(split) left join (select {SPLIT_NAME} as split from documents) d on s.split = d.split group by 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.split_counts(split_assign(spark, d), "split")


@query("select doc_id, ('0x' || substr(sha256('render:' || doc_id::varchar), 1, 8))::bigint as seed from documents")
def derive_seed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.derive_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("""select u.conv_id, u.turn, length(u.text) as asked, length(a.text) as said from conversations u join conversations a
  on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'""")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("said"))
    return users.join(replies, ["conv_id", "turn"])


SUBJECTS = [("small", "size"), ("small ring", "thing"), ("red", "colour"), ("red w", "widget"), ("blue", "colour"), ("large", "size"), ("green", "colour")]
SUBJECT_SQL = ", ".join(f"('{s}', '{g}')" for s, g in SUBJECTS)


@query(f"""with s(subject, stratum) as (values {SUBJECT_SQL}), b as (select p_partkey, arg_max(stratum, length(subject)) as stratum from part join s on starts_with(lower(p_name), subject) group by 1)
  select p.p_partkey, p.p_name, coalesce(b.stratum, 'unknown') as stratum from part p left join b using (p_partkey)""")
def stratum_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    subjects = spark.createDataFrame(SUBJECTS, "subject string, stratum string")
    return assemble.prompt_stratum(table(spark, d, "part").select("p_partkey", "p_name"), subjects, prompt="p_name").select("p_partkey", "p_name", "stratum")


BOX = """list_value(least(abs(e[{0}]), 0.9)::double, least(abs(e[{1}]), 0.9)::double, least(abs(e[{0}]), 0.9)::double + 0.05 + abs(e[{2}])::double, least(abs(e[{1}]), 0.9)::double + 0.05 + abs(e[{3}])::double)"""
IOU_SQL = "case when w <= 0 or h <= 0 then 0.0 else w * h / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - w * h) end"


def box(e: str, i: int) -> object:
    at = lambda k: F.abs(F.get(F.col(e), F.lit(k)).cast("double"))
    x, y = F.least(at(i), F.lit(0.9)), F.least(at(i + 1), F.lit(0.9))
    return F.array(x, y, x + 0.05 + at(i + 2), y + 0.05 + at(i + 3))


def box_sql(i: int) -> str:
    at = lambda k: f"abs(embedding[{i + 1 + k}]::double)"
    x, y = f"least({at(0)}, 0.9::double)", f"least({at(1)}, 0.9::double)"
    return f"[{x}, {y}, {x} + 0.05::double + {at(2)}, {y} + 0.05::double + {at(3)}]"


@query(f"""with b as (select vec_id, {box_sql(0)} as a, {box_sql(4)} as b from embeddings),
  o as (select *, greatest(0.0::double, least(a[3], b[3]) - greatest(a[1], b[1])) as w, greatest(0.0::double, least(a[4], b[4]) - greatest(a[2], b[2])) as h from b)
  select vec_id, round({IOU_SQL}, 6) as iou from o""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(X.iou(box("embedding", 0), box("embedding", 4)), 6).alias("iou"))


def overlap_sql(a: int, b: int) -> str:
    """Overlap of the boxes at two places of a vector."""
    w = f"greatest(0.0::double, least(({box_sql(a)})[3], ({box_sql(b)})[3]) - greatest(({box_sql(a)})[1], ({box_sql(b)})[1]))"
    h = f"greatest(0.0::double, least(({box_sql(a)})[4], ({box_sql(b)})[4]) - greatest(({box_sql(a)})[2], ({box_sql(b)})[2]))"
    size = lambda i: f"(({box_sql(i)})[3] - ({box_sql(i)})[1]) * (({box_sql(i)})[4] - ({box_sql(i)})[2])"
    return f"case when {w} <= 0 or {h} <= 0 then 0.0::double else {w} * {h} / ({size(a)} + {size(b)} - {w} * {h}) end"


# Of the two detections that a cat may take, the second cat gets what the first has left.
@query(f"""with o as (select vec_id, {overlap_sql(0, 4)} as p1, {overlap_sql(0, 20)} as p3, {overlap_sql(8, 12)} as q, {overlap_sql(16, 4)} as r1, {overlap_sql(16, 20)} as r3 from embeddings),
  u as (select *, greatest(p1, p3) as p, case when greatest(p1, p3) < 0.3 then 0 when p3 > p1 then 3 else 1 end as used from o),
  v as (select vec_id, round(p, 4) as p, round(q, 4) as q, p >= 0.3 as mp, q >= 0.3 as mq, case used when 1 then r3 when 3 then r1 else greatest(r1, r3) end as r from u)
  select vec_id, round((mp::int + mq::int + (r >= 0.3)::int) / 3.0::double, 4) as score, 1.0::double as detection_coverage, round((p + q + round(r, 4)) / 3.0::double, 4) as mean_iou, 3 as n_entities, 3 as n_detected, mp::int + mq::int + (r >= 0.3)::int as n_matched from v""")
def layout_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Three entities against four detections made from each vector."""
    thing = lambda name, i: F.struct(F.lit(name).alias("label"), box("embedding", i).alias("bbox"))
    seen = lambda name, i: F.struct(F.lit(name).alias("label"), box("embedding", i).alias("bbox"), F.lit(0.5).alias("score"))
    e = F.array(thing("cat", 0), thing("big_dog", 8), thing("cat", 16))
    t = F.array(seen("cat", 4), seen("dog", 12), seen("Cat", 20), seen("tree", 24))
    rows = table(spark, d, "embeddings").select("vec_id", spatial.greedy_matches(e, t).alias("m")).select("vec_id", spatial.faithfulness(F.col("m")).alias("f"))
    return rows.select("vec_id", *[F.col("f")[c].alias(c) for c in ("score", "detection_coverage", "mean_iou", "n_entities", "n_detected", "n_matched")])


def sign_hash(e: str) -> object:
    return X.bits_to_long(F.transform(F.col(e), lambda x: x > 0))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Sign hashes of the vectors, and of each a variant with 0 to 11 bits changed under another id."""
    first = table(spark, d, "embeddings").select("vec_id", sign_hash("embedding").alias("hash"))
    mask = F.expr("shiftleft(shiftleft(1L, cast(vec_id % 12 as int)) - 1, cast(vec_id % 40 as int))")
    return first.unionByName(first.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.col("hash").bitwiseXOR(mask).alias("hash")))


HASH_SQL = "list_sum(list_transform(range(64), lambda i: case when {0} then 1::hugeint << i::int else 0::hugeint end))"
SIGNED_SQL = "(case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint"


HASHES_SQL = f"""f as (select vec_id, ({HASH_SQL.format('embedding[i + 1] > 0')})::ubigint as h from embeddings),
  h as (select vec_id, h from f union all select vec_id + 1000000, xor(h, (((1::ubigint << (vec_id % 12)::ubigint) - 1) << (vec_id % 40)::ubigint)::ubigint) from f)"""


@query(f"with {HASHES_SQL} select a.vec_id as a, b.vec_id as b, bit_count(xor(a.h, b.h))::int as distance from h a join h b on a.vec_id < b.vec_id where bit_count(xor(a.h, b.h)) <= 8")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return hashdup.hamming_pairs(hashes(spark, d), threshold=8, pos="vec_id")


@query(f"""with recursive {HASHES_SQL}, o as (select vec_id, h, row_number() over (order by vec_id) as n from h),
  walk as (select 0::bigint as n, null::bigint as vec_id, false as dup, []::ubigint[] as kept union all
    select n, vec_id, dup, case when dup then kept else list_append(kept, h) end from (select h.n, h.vec_id, h.h, w.kept, len(list_filter(w.kept, lambda k: bit_count(xor(k, h.h)) <= 8)) > 0 as dup from walk w join o h on h.n = w.n + 1))
  select vec_id, dup as is_duplicate from walk where n > 0""")
def near_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Greedy keep-first at the default distance."""
    return hashdup.keep_first(hashes(spark, d), threshold=8, pos="vec_id").select("vec_id", "is_duplicate")


@query(f"""with w as (select k, list(cos((i + 0.5::double) * k * pi() / 64) order by i) as w from range(64) a(k), range(64) b(i) group by k),
  c as (select vec_id, list(list_dot_product(embedding::double[], w) order by k) as c from embeddings, w group by vec_id),
  m as (select vec_id, c, list_sort(c[2:])[32] as m from c), b as (select vec_id, {HASH_SQL.format('c[i + 1] > m')} as h from m)
  select vec_id, {SIGNED_SQL} as hash from b""")
def dct_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the DCT of each vector."""
    return table(spark, d, "embeddings").select("vec_id", X.dct_hash(F.col("embedding").cast("array<double>")).alias("hash"))


@query("""with p as (select 'n_chars' as metric, d.n_chars::double as x, l.quality::double as y from documents d join labels l using (doc_id) where l.quality is not null),
  r as (select metric, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2.0 as rx, rank() over (partition by metric order by y) + (count(*) over (partition by metric, y) - 1) / 2.0 as ry from p)
  select metric, count(*) as n, round(corr(rx, ry), 4) as spearman from r group by 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).filter("quality is not null")
    return calibration.spearman(calibration.long_pairs(rows, ["n_chars"], "quality"))


@query("""with p as (select d.n_chars::double as x, l.quality::double as y from documents d join labels l using (doc_id) where l.quality is not null),
  c as (select x, sum(count(*)) over (order by x desc) as taken, sum(sum(y)) over (order by x desc) as hits from p group by x),
  f as (select x, hits / taken as p, hits / (select sum(y) from p) as r, 2 * hits / (taken + (select sum(y) from p)) as f1 from c)
  select 'n_chars' as metric, x as threshold, round(p, 4) as precision, round(r, 4) as recall, round(f1, 4) as f1 from f order by f1 desc, x limit 1""")
def suggest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return calibration.suggest_threshold(calibration.long_pairs(judged(spark, d).filter("quality is not null"), ["n_chars"], "quality"))


@query("""with p as (select d.lang as metric, d.n_chars::double as x, l.quality::double as y from documents d join labels l using (doc_id) where l.quality is not null),
  t as (select metric, sum(y) as all_pos from p group by 1 having sum(y) > 0 and sum(y) < count(*)),
  c as (select metric, x, sum(count(*)) over (partition by metric order by x desc) as taken, sum(sum(y)) over (partition by metric order by x desc) as hits from p group by 1, 2),
  f as (select metric, list({'x': x, 'p': hits / taken, 'r': hits / all_pos, 'f1': 2 * hits / (taken + all_pos)} order by x) as l from c join t using (metric) group by 1),
  w as (select metric, list_reduce(l, lambda b, i: case when i.f1 > round(b.f1, 4) then i else b end) as b from f)
  select metric, b.x as threshold, round(b.p, 4) as precision, round(b.r, 4) as recall, round(b.f1, 4) as f1 from (select distinct metric from p) left join w using (metric)""")
def suggest_threshold_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds by language of a walk that compares with the rounded best; the SQL walks step by step."""
    rows = judged(spark, d).filter("quality is not null")
    return calibration.suggest_threshold(rows.select(F.col("lang").alias("metric"), F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y")), ties="rounded")


GPU_OF = {"click": "a100", "view": "H100", "purchase": "l40s", "error": "t4", "signup": "A100_40GB"}
RATES_SQL = ", ".join(f"('{k}', {V.GPU_RATES[V.GPU_ALIASES.get(g.upper().replace('_', '-'), g.upper().replace('_', '-'))]}::double)" for k, g in GPU_OF.items())


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    gpu = F.coalesce(X.lookup(GPU_OF, F.col("event_type")), F.lit("unknown"))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("value").alias("seconds"), gpu.alias("gpu"))


@query(f"""with r(kind, rate) as (values {RATES_SQL}) select e.event_type as kind, count(*) as n, round(sum(e.value * r.rate), 6) as cost_usd,
  round(sum(e.value * 0.125 * 0.0000131::double + 2 * e.value * 0.00000222::double + coalesce(e.value * r.rate, 0)), 6) as real_cost_usd from events e left join r on e.event_type = r.kind group by 1""")
def rate_join_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = cost.with_rate(run_ledger(spark, d), "gpu")
    gpu = F.when(X.normal_gpu(F.col("gpu")).isNotNull(), F.col("gpu"))
    real = X.container_cost(gpu, F.col("seconds"), F.lit(0.0), F.lit(2.0))["real_cost_usd"]
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("seconds") * F.col("rate_usd_per_s")), 6).alias("cost_usd"), F.round(F.sum(real), 6).alias("real_cost_usd"))


def stage_of(i: str) -> object:
    return F.get(F.array(*[F.lit(s) for s in V.STAGES]), (F.col(i) % 7).cast("int"))


@query(f"""with f as (select list_extract({V.STAGES!r}, (event_id % 7)::int + 1) as stage, value as compute_s, event_id % 90 as tok, value * 0.000583::double as usd, (event_id % 13 = 0)::int as retries from events),
  s as (select unnest(range(6)) as ord) select s.ord::int as ord, list_extract({V.STAGES!r}, s.ord::int + 1) as stage, 'N' || (s.ord + 1) as label, round(coalesce(avg(compute_s), 0), 6) as compute_s_mean,
  round(coalesce(quantile_cont(compute_s, 0.5), 0), 6) as compute_s_p50, round(coalesce(quantile_cont(compute_s, 0.9), 0), 6) as compute_s_p90, round(coalesce(avg(tok), 0), 6) as output_tokens_mean,
  round(coalesce(avg(usd), 0), 8) as cost_mean, round(coalesce(sum(usd), 0), 6) as cost_total, coalesce(sum(retries), 0)::bigint as retries from s left join f on f.stage = list_extract({V.STAGES!r}, s.ord::int + 1) group by s.ord""")
def stage_costs(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select(
        stage_of("event_id").alias("stage"), F.col("value").alias("compute_s"), (F.col("event_id") % 90).alias("output_tokens"), (F.col("value") * 0.000583).alias("projected_cost_usd"), (F.col("event_id") % 13 == 0).cast("int").alias("retries")
    )
    digits = {"cost_mean": 8}
    out = cost.stage_costs(facts)
    return out.select("ord", "stage", "label", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[3:9]], "retries")


@query("""with t as (select user_id, sum(value) as s, sum(value * 0.000694::double) as usd from events group by 1)
  select count(*) as n, round(avg(s), 6) as e2e_s_mean, round(quantile_cont(s, 0.5), 6) as e2e_s_p50, round(quantile_cont(s, 0.9), 6) as e2e_s_p90, round(quantile_cont(s, 0.99), 6) as e2e_s_p99,
  round(avg(usd), 8) as e2e_usd_mean, round(sum(usd), 6) as e2e_usd_total, round(avg(usd) * 1000, 5) as projected_1k, round(avg(usd) * 1000000, 2) as projected_1m from t""")
def report_latency(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("reasoning_s"), F.sum(F.col("value") * 0.000694).alias("reasoning_usd"))
    zeros = {c: F.lit(0.0) for c in ("render_s", "render_usd")} | {c: F.lit(0).cast("long") for c in ("retries", "output_tokens")} | {c: F.lit(False) for c in ("has_render", "has_image")} | {"created_at": F.lit(None).cast("string")}
    digits = {"e2e_usd_mean": 8, "projected_1k": 5, "projected_1m": 2}
    names = ["e2e_s_mean", "e2e_s_p50", "e2e_s_p90", "e2e_s_p99", "e2e_usd_mean", "e2e_usd_total", "projected_1k", "projected_1m"]
    return cost.cost_summary(sums.withColumns(zeros)).select("n", *[F.round(c, digits.get(c, 6)).alias(c) for c in names])


@query("select event_type as kind, count(*) as n_runs, round(sum(value), 4) as total_cost_usd, round(sum(value * 16), 4) as total_real_cost_est_usd from events group by rollup(1)")
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("total_cost_usd"), (F.col("value") * 16).alias("real_cost_est_usd"))
    return cost.ledger_summary(runs).select("kind", "n_runs", *[F.round(c, 4).alias(c) for c in ("total_cost_usd", "total_real_cost_est_usd")])


@query("""with c as (select distinct r.r_name as genre, n.n_name || ' ' || p.p_name as prompt from region r join nation n on n.n_regionkey = r.r_regionkey join (select distinct p_name from part) p on true),
  d as (select *, row_number() over (partition by genre order by sha256('3:' || genre || ':' || prompt), prompt) as round from c)
  select round::int as round, genre, prompt from d order by round, genre limit 100""")
def round_robin_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("genre"))
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("subject"))
    subjects = r.join(n, "r_regionkey").select("genre", "subject")
    contexts = r.select("genre").crossJoin(table(spark, d, "part").select(F.col("p_name").alias("context")).distinct())
    return prompts.round_robin(prompts.combinations(subjects, contexts), 100, seed=3)


@query("select doc_id, row_number() over (order by doc_id) - 1 as row, format('shard-{:05d}.tar', (row_number() over (order by doc_id) - 1) // 64) as shard from documents")
def shard_index(spark: SparkSession, d: str) -> DataFrame:
    return shards.with_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 64).select("doc_id", F.col("row").cast("long").alias("row"), "shard")


SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""select p_partkey, 'MAT:' || {SLUG.format('p_name')} || ':' || {SLUG.format('p_brand')} as material, 'LENS_' || replace(upper({SLUG.format('p_brand')}), '-', '') as lens,
  case when (p_size % 10) / 10.0 < 1/3 then 'left' when (p_size % 10) / 10.0 > 2/3 then 'right' else 'center' end as col from part""")
def slug_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("p_size") % 10) / F.lit(10.0)
    return table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("MAT:"), X.slug(F.col("p_name")), F.lit(":"), X.slug(F.col("p_brand"))).alias("material"), X.lens_label(F.col("p_brand")).alias("lens"),
        X.cell(x, F.lit(0.5), x, F.lit(0.5)).alias("col"),
    )


@query("""select event_id, (props::json->>'k')::bigint as k, (props::json->>'k')::bigint between 0 and 50 as valid from events""")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(X.json_of(F.col("props")), "$.k", "long")
    return table(spark, d, "events").select("event_id", k.alias("k"), k.between(0, 50).alias("valid"))


@query("select event_type as value, count(*) as n from events where event_type is not null group by 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return cost.histogram(table(spark, d, "events"), "event_type")


@query("""with c as (select e.embedding as a, lead(e.embedding) over (order by vec_id) as b, vec_id from embeddings e)
  select vec_id, round(list_cosine_similarity(a::double[], b::double[]), 6) as cosine from c where b is not null""")
def cosine_next(spark: SparkSession, d: str) -> DataFrame:
    e = shards.numbered(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")), "vec_id")
    return e.join(e.select((F.col("row") - 1).alias("row"), F.col("a").alias("b")), "row").select("vec_id", F.round(X.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(f"""with g as ({GATED}) select count(*) as n, count(*) filter (gate) as passed, count(*) filter (not gate) as failed, count(*) filter (gate is null) as unknown,
  round(avg(quality::double), 4) as clip_score_mean, round(avg(case when n_chars > 1000 then n_chars / 100.0 end), 4) as aesthetic_mean,
  count(*) filter (doc_id % 9 = 0) as n_duplicates, count(*) filter (toxic = 1) as n_release_blocked from g""")
def pack_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.struct(F.col("quality").cast("double").alias("clip_score"), F.when(F.col("n_chars") > 1000, F.col("n_chars") / F.lit(100.0)).alias("aesthetic"), F.col("gate").alias("passed_gate"))
    s = F.struct((F.col("doc_id") % 9 == 0).alias("is_duplicate"), (F.col("toxic") == 1).alias("release_blocked"))
    return quality.pack_summary(gated(spark, d).select(F.struct(q.alias("quality"), s.alias("safety")).alias("dataset")), ["clip_score", "aesthetic"])


from loomlake.plans import job_queries, record_queries  # noqa: E402, F401  register their queries
