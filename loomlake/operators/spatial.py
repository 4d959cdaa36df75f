"""Agreement of a layout with detections: greedy matching by overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlake.functions import vocabulary as V
from loomlake.functions.scalars import iou, labels_match

RESULT = "struct<id:string,detected:boolean,matched:boolean,iou:double>"


def detectable_entities(entities: Column) -> Column:
    """Entities that a detector can find, as (label, bbox)."""
    kept = F.filter(entities, lambda e: e["kind"].isin(V.DETECTABLE_KINDS))
    return F.transform(kept, lambda e: F.struct(e["id"].alias("label"), e["bbox"].alias("bbox")))


def greedy_matches(entities: Column, detections: Column, iou_threshold: float = 0.3) -> Column:
    """One result an entity (label, bbox), in order, against detections (label, bbox, score).

    An entity takes the free detection of its label with the greatest overlap, the first one on ties; it
    is used up only if the overlap reaches the threshold. detected tells whether any detection has its
    label, used up or not. One fold over the entities keeps the list of used detections.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{RESULT}>").alias("out"))
    # The fold inside runs over positions; a null list of detections has none.
    places = F.transform(F.coalesce(detections, F.array().cast("array<struct<label:string,bbox:array<double>,score:double>>")), lambda d, i: F.struct(d["label"].alias("label"), d["bbox"].alias("bbox"), i.alias("i")))

    def step(state: Column, e: Column) -> Column:
        same = F.filter(places, lambda d: F.coalesce(labels_match(e["label"], d["label"]), F.lit(False)))
        free = F.filter(same, lambda d: ~F.array_contains(state["used"], d["i"].cast("int")))
        kind = "struct<iou:double,i:int>"
        scored = F.transform(free, lambda d: F.struct(iou(e["bbox"], d["bbox"]).alias("iou"), d["i"].cast("int").alias("i")))
        best = F.aggregate(scored, F.struct(F.lit(0.0).alias("iou"), F.lit(-1).alias("i")).cast(kind), lambda b, d: F.when(d["iou"] > b["iou"], d).otherwise(b))

        def settle(now: Column, b: Column) -> Column:
            hit = (b["i"] >= 0) & (b["iou"] >= iou_threshold)
            row = F.struct(e["label"].alias("id"), (F.size(same) > 0).alias("detected"), hit.alias("matched"), F.round(b["iou"], 4).alias("iou"))
            return F.struct(F.when(hit, F.array_append(now["used"], b["i"])).otherwise(now["used"]).alias("used"), F.array_append(now["out"], row).alias("out"))

        # A fold over one item names the best overlap.
        return F.aggregate(F.array(best), state, settle)

    return F.aggregate(entities, start, step)["out"]


def faithfulness(matches: Column) -> Column:
    """Score, coverage, mean overlap and counts from greedy_matches; null scores without entities.

    The mean is over detected entities and their overlaps as already rounded, 0 if there are none.
    """
    n = F.size(matches)
    count = lambda f: F.size(F.filter(matches, f))
    found = F.transform(F.filter(matches, lambda m: m["detected"]), lambda m: m["iou"])
    share = lambda c: F.round(F.try_divide(c.cast("double"), n.cast("double")), 4)
    return F.struct(
        share(count(lambda m: m["matched"])).alias("score"), share(count(lambda m: m["detected"])).alias("detection_coverage"),
        F.when(n > 0, F.coalesce(F.round(F.try_divide(F.aggregate(found, F.lit(0.0), lambda t, x: t + x), F.size(found).cast("double")), 4), F.lit(0.0))).alias("mean_iou"),
        n.alias("n_entities"), count(lambda m: m["detected"]).alias("n_detected"), count(lambda m: m["matched"]).alias("n_matched"), matches.alias("per_entity"),
    )
