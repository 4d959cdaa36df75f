import math

import numpy as np
from pyspark.sql import functions as F

from loomlake.functions import evaluation as E
from loomlake.functions.scalars import average_hash, cosine


def test_perceptual_hash_against_loops(spark):
    rng = np.random.default_rng(3)
    images = [rng.random(1024).tolist() for _ in range(3)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(images)] + [(3, None), (4, [1.0])], "i int, p array<double>")
    got = {r["i"]: r["h"] for r in df.select("i", E.perceptual_hash(F.col("p")).alias("h")).collect()}
    for i, p in enumerate(images):
        rows = [[sum(p[32 * y + x] * math.cos((x + 0.5) * k * math.pi / 32) for x in range(32)) for k in range(8)] for y in range(32)]
        block = [sum(rows[y][k] * math.cos((y + 0.5) * j * math.pi / 32) for y in range(32)) for j in range(8) for k in range(8)]
        middle = sorted(block[1:])[31]
        assert got[i] & (1 << 64) - 1 == sum(1 << b for b, c in enumerate(block) if c > middle)
    assert got[3] is None and got[4] is None


def test_average_hash_and_cosine(spark):
    v = [float(i) for i in range(64)]
    r = spark.createDataFrame([(v,)], "v array<double>").select(average_hash(F.col("v")), cosine(F.col("v"), F.col("v"))).first()
    assert r[0] & (1 << 64) - 1 == sum(1 << i for i in range(64) if i >= 31.5) and abs(r[1] - 1) < 1e-12


def test_scorer_columns(spark):
    df = spark.range(1).select(
        E.nsfw_probability(F.array(F.struct(F.lit("NSFW").alias("label"), F.lit(0.7).alias("score")))).alias("a"),
        E.nsfw_probability(F.array().cast("array<struct<label:string,score:double>>")).alias("b"),
        E.nsfw_probability(F.lit(None).cast("array<struct<label:string,score:double>>")).alias("c"),
        E.detections(F.array(F.struct(F.lit(1).alias("label"), *[F.lit(float(x)).alias(n) for n, x in (("x0", 0), ("y0", 10), ("x1", 50), ("y1", 20), ("score", 0.5))])), F.array(F.lit("cat"), F.lit("dog")), F.lit(100.0), F.lit(20.0)).alias("d"),
        E.final_images(F.array().cast("array<string>"), F.lit("x")).alias("e"),
        E.image_references(F.lit("r"), F.array(F.lit("h0"), F.lit("h1")), F.lit(8), F.lit(8), F.lit(5)).alias("f"),
        *[c.alias(k) for k, c in E.render_arguments(F.lit(None).cast("int"), F.lit(1.0), F.lit(0), F.lit("blurry"), default_steps=4, default_guidance=1.0, takes_negative=True).items()],
    )
    r = df.first()
    assert (r["a"], r["b"], r["c"]) == (0.7, 0, None) and r["d"][0][:] == ("dog", [0.0, 0.5, 0.5, 1.0], 0.5) and r["e"] == ["x"]
    assert r["f"][1]["path"] == "r_1.webp" and r["f"][1]["seed"] == 6
    assert (r["steps"], r["guidance"], r["n"], r["negative"]) == (4, 4.0, 1, "blurry")
