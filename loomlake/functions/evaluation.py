"""Columns around outside scorers and renderers: their inputs, defaults and results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import stripped
from loomlake.operators.spatial import detectable_entities


def payload(records: DataFrame) -> DataFrame:
    """(id, prompt, entities, paths) to score; records without an image path are left out."""
    paths = F.filter(F.coalesce(F.transform("images", lambda i: i["path"]), F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    return records.select("id", "prompt", detectable_entities(F.col("layout.entities")).alias("entities"), paths.alias("paths")).filter(F.size("paths") > 0)


def detections(boxes: Column, labels: Column, width: Column, height: Column, least: float = 0.1) -> Column:
    """Raw boxes (label index, x0, y0, x1, y1, score) as (label, bbox in [0, 1], score) of those that score enough."""
    kept = F.filter(F.coalesce(boxes, F.array().cast("array<struct<label:int,x0:double,y0:double,x1:double,y1:double,score:double>>")), lambda b: b["score"] >= least)
    return F.transform(kept, lambda b: F.struct(F.get(labels, b["label"]).alias("label"), F.array(b["x0"] / width, b["y0"] / height, b["x1"] / width, b["y1"] / height).alias("bbox"), b["score"].alias("score")))


def nsfw_probability(predictions: Column) -> Column:
    """Score of the label nsfw in any case; 0 if it isn't among the predictions, null without any."""
    hit = F.get(F.filter(predictions, lambda p: F.lower(p["label"]) == "nsfw"), F.lit(0))
    return F.when(predictions.isNotNull(), F.coalesce(hit["score"], F.lit(0.0)))


def image_references(record_id: Column, hashes: Column, width: Column, height: Column, seed: Column) -> Column:
    """One reference a rendered variation, its seed counted up from the first."""
    return F.transform(hashes, lambda h, i: F.struct(F.concat(record_id, F.lit("_"), i.cast("string"), F.lit(".webp")).alias("path"), h.alias("sha256"), i.cast("int").alias("idx"), width.cast("int").alias("width"), height.cast("int").alias("height"), (seed + i).cast("long").alias("seed")))


def cost_per_image(cost: Column, n: Column) -> Column:
    """An image's part of a render's cost, to eight digits; 0 without images."""
    return F.coalesce(F.round(F.try_divide(cost, n.cast("double")), 8), F.lit(0.0))


def grey_pixels(content: Column, size: int = 32) -> Column:
    """Image files decoded, made grey and resized to size x size, row by row; null where that fails.

    Decoding needs Pillow on the executors; without it reading the column is an error.
    """

    @F.pandas_udf("array<double>")
    def run(blobs: pd.Series) -> pd.Series:
        import io

        from PIL import Image

        def one(blob: bytes | None) -> list[float] | None:
            try:
                image = Image.open(io.BytesIO(blob)).convert("L").resize((size, size), Image.Resampling.LANCZOS)
                return [float(x) for x in image.getdata()]
            except (OSError, TypeError, ValueError):
                return None

        return blobs.map(one)

    return run(content)


def final_images(images: Column, single: Column) -> Column:
    """The list of final images; where there is none, the single one."""
    return F.when(F.coalesce(F.size(images), F.lit(0)) > 0, images).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def render_arguments(steps: Column, guidance: Column, n: Column, negative: Column, *, default_steps: int, default_guidance: float, takes_negative: bool) -> dict[str, Column]:
    """Arguments with a model's defaults: one image at least; a negative prompt, where it is taken, needs guidance above 1."""
    asked = F.coalesce(stripped(negative), F.lit("")) != ""
    scale = F.coalesce(guidance, F.lit(default_guidance))
    use = asked & F.lit(takes_negative)
    return {"steps": F.coalesce(steps, F.lit(default_steps)), "guidance": F.when(use & (scale <= 1), 4.0).otherwise(scale), "n": F.greatest(F.lit(1), F.coalesce(n, F.lit(1))), "negative": F.when(use, negative)}


def low_block(size: int, keep: int) -> np.ndarray:
    """The first rows of the DCT-II matrix."""
    return np.cos(np.pi / size * np.outer(np.arange(keep), np.arange(size) + 0.5))


def perceptual_hash(pixels: Column, size: int = 32, keep: int = 8) -> Column:
    """64-bit hash of a grey image of size x size pixels, given row by row.

    Of its two-dimensional DCT the keep x keep block of the lowest frequencies is compared with the median
    of that block without the first coefficient. A null image or one of another size has a null hash.
    """

    @F.pandas_udf("long")
    def run(images: pd.Series) -> pd.Series:
        wave = low_block(size, keep)

        def one(p: object) -> int | None:
            if p is None or len(p) != size * size:
                return None
            block = (wave @ np.asarray(p, float).reshape(size, size) @ wave.T).ravel()
            rest = np.sort(block[1:])
            value = sum(1 << i for i, c in enumerate(block.tolist()) if c > rest[len(rest) // 2])
            return value - (1 << 64) if value >> 63 else value

        return images.map(one).astype("Int64")

    return run(pixels)
