"""Scalar functions as column expressions; all of them stay in the JVM and pass nulls on."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V


def lookup(table: dict[str, object], key: Column) -> Column:
    """table[key], null where key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def stripped(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def lens_label(c: Column) -> Column:
    return F.concat(F.lit("LENS_"), F.replace(F.upper(slug(c)), F.lit("-"), F.lit("")))


def cell(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Name of the cell of a 3 x 3 grid that holds a box's centre."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    col = F.when(cx < 1 / 3, "left").when(cx > 2 / 3, "right").otherwise("center")
    row = F.when(cy < 1 / 3, "top").when(cy > 2 / 3, "bottom").otherwise("mid")
    return F.when(row == "mid", col).when(col == "center", row).otherwise(F.concat_ws("-", row, col))


def box_cell(box: Column) -> Column:
    return cell(*(F.get(box, F.lit(i)) for i in range(4)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where they don't meet."""
    ax0, ay0, ax1, ay1 = (F.get(a, F.lit(i)) for i in range(4))
    bx0, by0, bx1, by1 = (F.get(b, F.lit(i)) for i in range(4))
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    both = w * h
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(F.try_divide(both, union))


def label(c: Column) -> Column:
    """A label as detectors are asked for it."""
    return F.replace(F.lower(stripped(c)), F.lit("_"), F.lit(" "))


def labels_match(a: Column, b: Column) -> Column:
    a, b = label(a), label(b)
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_fraction(key: Column, seed: int | str, digits: int = 12) -> Column:
    """sha256(seed:key) as an integer from its first hex digits."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, digits), 16, 10).cast("bigint")


def split_fraction(key: Column, seed: int | str = 0) -> Column:
    return (hash_fraction(key, seed) % 1_000_000) / 1e6


def assign_split(key: Column, *, seed: int | str = 0, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the key's hash; the ratios must leave a part for test or sum to 1."""
    if train < 0 or val < 0 or train + val > 1 + 1e-9:
        raise ValueError("split ratios must not be negative and sum to at most 1")
    f = split_fraction(key, seed)
    return F.when(f < train, "train").when(f < F.lit(train) + F.lit(val), "val").otherwise("test")


def derive_seed(key: Column, salt: str = "render") -> Column:
    """An unsigned 32-bit seed."""
    return hash_fraction(key, salt, 8)


def normal_gpu(name: Column) -> Column:
    """Name in the rate card; null where unknown."""
    upper = F.upper(stripped(name))
    key = F.replace(upper, F.lit("_"), F.lit("-"))
    known = F.when(key.isin(list(V.GPU_RATES)), key)
    return F.coalesce(known, lookup(V.GPU_ALIASES, key), lookup(V.GPU_ALIASES, upper))


def known_gpu_rate(name: Column, per: str = "second") -> Column:
    """As gpu_rate, but an unknown GPU is an error when the row is read."""
    return F.coalesce(gpu_rate(name, per), F.raise_error(F.concat(F.lit("unknown GPU: "), F.coalesce(name, F.lit("null")))).cast("double"))


def scaled(rate: Column, per: str) -> Column:
    if per not in ("second", "hour"):
        raise ValueError(f"per must be second or hour, not {per!r}")
    return rate * (3600.0 if per == "hour" else 1.0)


def gpu_rate(name: Column, per: str = "second") -> Column:
    return scaled(lookup(V.GPU_RATES, normal_gpu(name)), per)


def resource_rate(gpu: Column | None = None, cores: Column | float = 0.0, mem_gib: Column | float = 0.0, per: str = "second") -> Column:
    """Dollars for a container; cores count from the billed minimum on, where there are any."""
    cores, mem = F.lit(cores) if not isinstance(cores, Column) else cores, F.lit(mem_gib) if not isinstance(mem_gib, Column) else mem_gib
    total = F.when(cores > 0, F.greatest(cores, F.lit(V.LEAST_CORES)) * V.CPU_RATE).otherwise(0.0) + mem * V.MEMORY_RATE
    return scaled(total if gpu is None else total + gpu_rate(gpu), per)


def container_cost(gpu: Column, billed_s: Column, cpu_core_s: Column, mem_gib: Column) -> dict[str, Column]:
    """The parts of a container's cost over its billed life; without a GPU that part is 0."""
    used = F.greatest(cpu_core_s, billed_s * V.LEAST_CORES)
    parts = {
        "gpu_cost_usd": billed_s * F.when(gpu.isNull(), 0.0).otherwise(gpu_rate(gpu)),
        "cpu_core_s": used,
        "cpu_cost_usd": used * V.CPU_RATE,
        "mem_cost_usd": mem_gib * billed_s * V.MEMORY_RATE,
    }
    return parts | {"real_cost_usd": parts["gpu_cost_usd"] + parts["cpu_cost_usd"] + parts["mem_cost_usd"]}


def projected_container_cost(gpu: Column, active_s: Column, model_load_s: Column, idle_s: Column, cpu_core_s: Column, mem_gib: Column) -> dict[str, Column]:
    billed = model_load_s + active_s + idle_s
    return {"billed_s": billed} | container_cost(gpu, billed, cpu_core_s, mem_gib)


def tokens_per_s(tokens: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(tokens.cast("double"), seconds), F.lit(0.0))


def short_number(c: Column) -> Column:
    """Up to six significant digits without trailing zeros, as %g prints numbers of 0.0001 and more."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(F.when(c == 0, F.lit(1.0)).otherwise(c)))))
    text = F.element_at(F.array(*[F.format_string(f"%.{d}f", c) for d in range(11)]), F.least(digits, F.lit(10)).cast("int") + 1)
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def fixed(c: Column, digits: int, missing: str = "-") -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c), F.lit(missing))


def dct(values: Column, n: int) -> Column:
    """DCT-II, not normalised, of an array of n numbers."""
    waves = F.lit(np.cos(np.outer(np.arange(n), np.arange(n) + 0.5) * (math.pi / n)).ravel())  # one literal, row by row
    wave = lambda k: F.aggregate(F.zip_with(values, F.slice(waves, k * n + 1, F.lit(n)), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), wave)


def bits_to_long(flags: Column, n: int = 64) -> Column:
    """Bit i of the result is flags[i]."""
    bits = F.transform(flags, lambda f, i: F.when(f & (i < n), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda t, b: t.bitwiseOR(b))


def average_hash(pixels: Column, n: int = 64) -> Column:
    mean = F.aggregate(pixels, F.lit(0.0), lambda t, x: t + x) / n
    # A fold over one item names the mean, so that it is worked out once.
    flags = F.aggregate(F.array(mean), F.array().cast("array<boolean>"), lambda _, m: F.transform(pixels, lambda x: x >= m))
    return bits_to_long(flags, n)


def dct_hash(values: Column, n: int = 64) -> Column:
    """Sign hash of the DCT coefficients of one vector against the median of those after the first."""
    above = lambda found: F.transform(found, lambda x: x > F.get(F.array_sort(F.slice(found, 2, n - 1)), F.lit((n - 1) // 2)))
    # A fold over one item names the coefficients, so that they are worked out once.
    flags = F.aggregate(F.array(dct(values, n)), F.array().cast("array<boolean>"), lambda _, found: above(found))
    return bits_to_long(flags, n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def json_of(text: Column) -> Column:
    """The JSON object in a model's answer as a variant: thinking and code fences off, else from the first brace to the last."""
    bare = stripped(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    unfenced = stripped(F.regexp_replace(bare, r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(*(F.try_parse_json(F.when(F.startswith(x, F.lit("{")), x)) for x in (bare, unfenced, inner)))
