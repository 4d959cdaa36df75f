import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.functions import scalars as X
from loomlake.operators import assemble, calibration, cost, hashdup, prompts, quality, shards, spatial


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    r = one(
        spark, X.slug(F.lit("  Neon Ságe, 35mm! ")), X.cell(F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.2)), X.iou(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.0), F.lit(1.5), F.lit(1.0))),
        X.hamming(F.lit(0b1011), F.lit(0b1000)), X.lens_label(F.lit("35-mm")), X.gpu_rate(F.lit("a100")), X.gpu_rate(F.lit("H100"), "hour"), X.gpu_rate(F.lit("abacus")), X.tokens_per_s(F.lit(5), F.lit(0.0)),
    )
    assert r[0] == "neon-s-ge-35mm" and r[1] == "top-left" and r[2] == pytest.approx(1 / 3) and r[3] == 2 and r[4] == "LENS_35MM"
    assert r[5] == 0.000694 and r[6] == pytest.approx(0.001097 * 3600) and r[7] is None and r[8] == 0


@pytest.mark.parametrize("value", [0.4, 1.0, 0.0, 0.0005, 0.123456789, 12.5, 100.0, 123456.0, 0.1])
def test_short_number(spark, value):
    assert one(spark, X.short_number(F.lit(value)))[0] == f"{value:g}"


def test_container_cost(spark):
    parts = X.projected_container_cost(F.lit("T4"), F.lit(12.0), F.lit(40.0), F.lit(120.0), F.lit(0.0), F.lit(2.0))
    r = one(spark, *[c.alias(k) for k, c in parts.items()])
    assert r["billed_s"] == 172 and r["cpu_core_s"] == 172 * 0.125
    assert r["real_cost_usd"] == pytest.approx(172 * 0.000164 + 21.5 * 0.0000131 + 2 * 172 * 0.00000222)
    with pytest.raises(ValueError):
        X.gpu_rate(F.lit("T4"), "day")


def test_split_shares(spark):
    got = {r[0]: r[1] for r in spark.range(2000).select(X.assign_split(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()}
    assert abs(got["train"] / 2000 - 0.8) < 0.05
    with pytest.raises(ValueError):
        X.assign_split(F.lit("a"), train=0.9, val=0.2)


def test_dct(spark):
    assert one(spark, X.dct(F.array(*[F.lit(1.0)] * 4), 4))[0] == pytest.approx([4, 0, 0, 0], abs=1e-9)
    rng = np.random.default_rng(1)
    v = rng.standard_normal(64)
    coef = [sum(v[i] * math.cos((i + 0.5) * k * math.pi / 64) for i in range(64)) for k in range(64)]
    middle = sorted(coef[1:])[31]
    want = sum(1 << k for k, c in enumerate(coef) if c > middle)
    got = one(spark, X.dct_hash(F.array(*[F.lit(float(x)) for x in v])))[0]
    assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("text,ok", [('{"a": 1}', True), ('<think>{no}</think> {"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('Sure: {"a": 1} done', True), ("none", False)])
def test_json_of(spark, text, ok):
    assert (one(spark, F.try_variant_get(X.json_of(F.lit(text)), "$.a", "int"))[0] == 1) is ok


def test_gate_order_and_nulls(spark):
    none = F.lit(None).cast("double")
    r = one(spark, quality.gate_reasons(F.lit(0.1), F.lit(1.0), F.lit(0.1), F.lit(0.9), F.lit(True), F.lit(True)), quality.gate_reasons(none, none, none, none, F.lit(None).cast("boolean"), F.lit(None).cast("boolean")), quality.gate_reasons(F.lit(0.3), none, none, F.lit(0.5), F.lit(False), F.lit(False), clip_min=0.5))
    assert r[0] == ["duplicate", "low_clip", "low_aesthetic", "low_faithfulness", "nsfw", "release_blocked"] and r[1] == [] and r[2] == ["low_clip"]


def test_faithfulness_uses_a_detection_once(spark):
    e = [("cat", [0.0, 0.0, 0.5, 0.5]), ("cat", [0.0, 0.0, 0.5, 0.4]), ("dog", [0.5, 0.5, 1.0, 1.0])]
    d = [("Cat", [0.0, 0.0, 0.5, 0.5], 0.9), ("bird", [0.5, 0.5, 1.0, 1.0], 0.9)]
    df = spark.createDataFrame([(e, d), ([], d), (e, None)], "e array<struct<label:string,bbox:array<double>>>, d array<struct<label:string,bbox:array<double>,score:double>>")
    a, b, c = (r["f"] for r in df.select(spatial.greedy_matches(F.col("e"), F.col("d")).alias("m")).select(spatial.faithfulness(F.col("m")).alias("f")).collect())
    assert (a["n_matched"], a["n_detected"], a["mean_iou"]) == (1, 2, 0.5) and a["score"] == pytest.approx(0.3333)
    assert b["score"] is None and b["n_entities"] == 0 and c["n_detected"] == 0 and c["score"] == 0


def test_keep_first_is_greedy(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        v = rng.choice(values)
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values] + [None]
    got = {r["pos"]: r["is_duplicate"] for r in hashdup.keep_first(spark.createDataFrame(list(enumerate(signed)), "pos long, hash long"), threshold=8).collect()}
    kept, want = [], {}
    for i, v in enumerate(values):
        want[i] = any((v ^ k).bit_count() <= 8 for k in kept)
        if not want[i]:
            kept.append(v)
    assert got == want | {len(values): False}
    chain = hashdup.keep_first(spark.createDataFrame([(0, 0), (1, 3), (2, 15)], "pos long, hash long"), threshold=2)
    assert [r["is_duplicate"] for r in chain.orderBy("pos").collect()] == [False, True, False]


def test_hamming_pairs_brute_force(spark):
    rng = random.Random(2)
    base = rng.getrandbits(63)
    values = [base ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    got = {(r["a"], r["b"], r["distance"]) for r in hashdup.hamming_pairs(spark.createDataFrame(list(enumerate(values)), "pos long, hash long"), threshold=4).collect()}
    assert got == {(i, j, d) for i in range(60) for j in range(i + 1, 60) if (d := (values[i] ^ values[j]).bit_count()) <= 4}


def near_pairs(values, threshold):
    """All pairs of places of 64-bit values within a distance, compared one by one."""
    v = np.array(values, dtype=np.int64).view(np.uint64)
    near = [np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= threshold) + i + 1 for i in range(len(v))]
    return {(i, int(j)) for i, js in enumerate(near) for j in js}


@pytest.mark.parametrize("crowd", [2048, 400])
def test_hamming_pairs_of_crowded_bands(spark, monkeypatch, crowd):
    monkeypatch.setattr(hashdup, "CROWD", crowd)
    rng = random.Random(6)
    values = [rng.getrandbits(42) | 5 << 42 for _ in range(2300)]
    values += [v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 9))) for v in values[:400]]
    values += [rng.getrandbits(8) | 9 << 50 for _ in range(200)] + values[:3]
    got = [(r["a"], r["b"]) for r in hashdup.hamming_pairs(spark.createDataFrame(list(enumerate(values)), "pos long, hash long"), threshold=8).collect()]
    assert set(got) == near_pairs(values, 8) and len(got) == len(set(got))


def test_hamming_candidates_of_one_band(spark):
    n = 50_000
    hashes = spark.range(n).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 42) - 1)).bitwiseOR(F.lit(5 << 42)).alias("h")).distinct()
    assert hashdup.near_hashes(hashes, 8, verified=False).count() < n * n // 2 // 40


def test_hamming_keys_are_not_broadcast(spark):
    """The keys of a few thousand hashes would be broadcast by the size of the hashes, so at a few hundred thousand the driver runs out of memory."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, F.xxhash64("id")).otherwise(F.xxhash64(F.col("id") - 1).bitwiseXOR(F.lit(1 << 40))).alias("hash"))
    done = hashdup.near_hashes(rows.select(F.col("hash").alias("h")).distinct(), 8)
    assert len(done.collect()) == n // 2
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def first_independent(n, pairs):
    before = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    kept = []
    for i in range(n):
        kept.append(not any(kept[a] for a in before.get(i, [])))
    return {i for i in range(n) if not kept[i]}


def test_settle_rounds(spark):
    rng = random.Random(8)
    shapes = [[(i // 2, i) for i in range(1, 300)], [(0, i) for i in range(1, 400)]]
    shapes += [[tuple(sorted(rng.sample(range(120), 2))) for _ in range(m)] for m in (60, 150, 600)]
    mixed = {(a + 1000 * k, b + 1000 * k) for k, pairs in enumerate(shapes) for a, b in pairs}
    for pairs in ([(i, i + 1) for i in range(1000)], sorted(mixed)):
        dups, rounds = hashdup.settle(spark.createDataFrame(pairs, "a long, b long"))
        assert {r["p"] for r in dups.collect()} == first_independent(1 + max(b for _, b in pairs), pairs) and rounds <= 14
    assert hashdup.settle(spark.createDataFrame([], "a long, b long")) == (None, 0)


def test_settled_tables_are_not_broadcast(spark, monkeypatch):
    """Files of sorted keys are far smaller than their rows in memory: no round of keep-first may broadcast them by that size."""
    plans, write = [], hashdup.staged

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(hashdup, "staged", seen)
    dups, _ = hashdup.settle(spark.range(7).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["p"] for r in dups.collect()} == {1, 3, 5, 7}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_spearman_and_threshold(spark):
    up = spark.createDataFrame([(float(i), i * 2.0, 1.0, int(i > 2)) for i in range(6)], "a double, b double, flat double, good int")
    got = {r["metric"]: r for r in calibration.correlate(up, ["a", "flat"], "b").collect()}
    assert got["a"]["spearman"] == 1 and got["flat"]["spearman"] is None
    t = calibration.suggest_threshold(calibration.long_pairs(up, ["a"], "good")).first()
    assert (t["threshold"], t["f1"]) == (3, 1)
    labels = [1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 1]
    pairs = spark.createDataFrame([("m", float(i + 1), float(y)) for i, y in enumerate(labels)], "metric string, x double, y double")
    assert calibration.suggest_threshold(pairs).first()["threshold"] == 5
    assert calibration.suggest_threshold(pairs, ties="rounded").first()["threshold"] == 12
    assert calibration.suggest_threshold(pairs.filter("y = 1")).first()["f1"] is None


def test_rounded_walk(spark):
    rng = random.Random(12)
    rows = [(f"m{m}", float(x), float(rng.random() < share)) for m, (n, share) in enumerate([(40, 0.5), (400, 0.1), (3000, 0.5), (20_000, 0.5), (20_000, 0.02), (900, 0.9)]) for x in range(n)]
    pairs = spark.createDataFrame(rows, "metric string, x double, y double")
    walked = {}
    for r in calibration.f1_curve(pairs).orderBy("metric", "threshold").collect():
        best = walked.get(r["metric"])
        if best is None or r["f1"] > round(best["f1"], 4):
            walked[r["metric"]] = r
    got = {r["metric"]: r["threshold"] for r in calibration.suggest_threshold(pairs, ties="rounded").collect()}
    assert got == {m: r["threshold"] for m, r in walked.items()} and len(got) == 6


def test_longest_prefix(spark):
    subjects = spark.createDataFrame([("red", "a"), ("red fox", "b")], "subject string, stratum string")
    p = spark.createDataFrame([("Red fox runs",), ("red car",), ("blue",), (None,)], "prompt string")
    assert [r["stratum"] for r in assemble.prompt_stratum(p, subjects).orderBy("prompt").collect()] == ["unknown", "b", "unknown", "a"]
    exact = spark.createDataFrame([("blue", "sea")], "prompt string, stratum string")
    assert {r["prompt"]: r["stratum"] for r in assemble.prompt_stratum(p, subjects, exact=exact).collect()}["blue"] == "sea"


def test_prompts(spark):
    curated = spark.createDataFrame([(0, "A dog"), (1, "a DOG ")], "pos long, prompt string")
    subjects = spark.createDataFrame([("x", "cat"), ("y", "sun")], "genre string, subject string")
    contexts = spark.createDataFrame([("x", "asleep"), ("y", "rising"), ("y", "setting")], "genre string, context string")
    air = spark.createDataFrame([("in fog",)], "atmosphere string")
    got = [r["prompt"] for r in prompts.generate(curated, subjects, contexts, air, 7, seed=1).orderBy("pos").collect()]
    assert got[0] == "A dog" and set(got[1:4]) == {"cat asleep", "sun rising", "sun setting"} and len({g.lower() for g in got}) == 7
    with pytest.raises(ValueError):
        prompts.generate(curated, subjects, contexts, air, 8)


def test_shards_and_numbers(spark):
    rows = shards.with_shards(spark.range(5).select((F.lit(9) - F.col("id")).alias("k")), "k", 2).orderBy("k").collect()
    assert [(r["row"], r["shard"]) for r in rows] == [(0, "shard-00000.tar"), (1, "shard-00000.tar"), (2, "shard-00001.tar"), (3, "shard-00001.tar"), (4, "shard-00002.tar")]
    assert shards.with_shards(spark.range(0), "id", 2).count() == 0


def test_estimate():
    assert cost.estimate("a100", 2.0, 3) == pytest.approx(0.000694 * 6)
    with pytest.raises(KeyError):
        cost.estimate("abacus", 1, 1)


def test_latencies_of_unsteady_sums(spark):
    """Totals that differ a little at each reading, as sums in another order do, give the percentiles of one reading."""
    unsteady = F.expr("id + cast(java_method('java.lang.System', 'nanoTime') as double) % 1000000 * 1e-12")
    fixed = {"reasoning_s": unsteady, "reasoning_usd": F.lit(1.0), "render_s": F.lit(0.0), "render_usd": F.lit(0.0), "retries": F.lit(0), "output_tokens": F.lit(0), "has_render": F.lit(False), "has_image": F.lit(False), "created_at": F.lit("x")}
    r = cost.cost_summary(spark.range(2001).select(*(c.alias(name) for name, c in fixed.items()))).first()
    assert (round(r["e2e_s_p50"], 3), round(r["e2e_s_p90"], 3), round(r["e2e_s_p99"], 3)) == (1000, 1800, 1980)


@pytest.mark.parametrize("accuracy", [100_000, 20])
def test_quantiles_by_counting_passes(spark, monkeypatch, accuracy):
    """Against numpy: ties that fill whole brackets, clusters, infinite values, one value, nulls, an empty group; a coarse sketch changes nothing."""
    import numpy as np

    from loomlake.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    groups = {"ties": np.r_[np.full(4000, 0.5), np.arange(10)], "spread": rng.normal(size=5000), "far": np.r_[rng.random(3000) * 1e-9, 1e300, -1e300], "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "ends": np.r_[-np.inf, np.arange(50.0), np.inf, np.inf]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("other", 1.0), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    names = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}
    got = {r["g"]: r for r in q.quantiles(df, "g", [*groups, "none"], "v", names).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        for name, p in names.items():
            s, at = np.sort(x), p * (len(x) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = low + (high - low) * (at - np.floor(at)) if low != high or np.isfinite(low) else np.nan
            assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)
    whole = q.quantiles(df, None, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert q.quantiles(df.limit(0), "g", ["one"], "v", names).count() == 0
