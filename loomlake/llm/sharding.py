"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a content key (60 bits of the text's MD5) and then doc_id, so equal texts stand
together. A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by
them, exact sizes of the ranges are measured, and overfull ranges, which one key may cause, are
subdivided by doc_id quantiles of their own. Running sums inside the small ranges plus the ranges'
offsets give each record its exact place in the whole order, hence its shard and slot, without ever
sorting everything in one task. Records over 1/64 of a shard, of which there are at most 64 a shard,
are dealt first, largest to the emptiest shard; the ranges then fill what is left of each shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import stage_table
from loomlake.llm.native import longs, range_of, search


def shard_by_size(docs: DataFrame, *, shards: int = 16, ranges: int | None = None, whole_group: float = 0.002, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all rows into shards of nearly equal bytes; equal texts stay together where they are small.

    ranges: how many ranges the splitters make; by default four a shuffle partition.
    whole_group: a group of equal texts up to this part of a shard is never divided; a larger one is cut
    at shard boundaries like any other run of records.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).
    size is the text's UTF-8 bytes plus 1; a null text has size 1, crc32 0 and the group of the empty
    text. Repeated rows each get a place; null keys sort first. An empty table gives no rows. Only the
    splitters and one size a range reach the driver, so their number doesn't grow with the rows.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("long")
    slim = stage_table(
        docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), digest.alias("k")),
        "shards",
    )
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    totals = slim.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total = totals["bytes"] or 0
    if not total:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    large = slim.filter(F.col("size") > total // (64 * shards)).orderBy(F.desc("size"), "k", "doc_id").collect()
    used, held = [0] * shards, [0] * shards
    dealt: list[str] = []
    heap = [(0, s) for s in range(shards)]
    for r in large:
        _, s = heapq.heappop(heap)
        dealt.append(f"({'null' if r['doc_id'] is None else r['doc_id']}, {r['size']}, {r['text_crc32']}, {s}, {held[s]})")
        used[s], held[s] = used[s] + r["size"], held[s] + 1
        heapq.heappush(heap, (used[s], s))
    slim = slim.filter(F.col("size") <= total // (64 * shards))
    left = total - sum(used)
    ends = room_ends(used, left)
    # A record is drawn with a probability in proportion to its size, about 64 a range.
    chance = F.col("size") * F.lit(64.0 * ranges / max(1, left))
    drawn = slim.filter((F.xxhash64("doc_id", "k", "size").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) < chance)
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile_approx("k", at, 100 * ranges).alias("q")).first()["q"] if at else []
    splitters = sorted(set(found or []))
    ranged = slim.withColumn("range", range_of(F.col("k"), splitters))
    weights = ranged.groupBy("range").agg(F.sum("size").alias("w"))
    fair = max(1, left // ranges)
    over = weights.filter(F.col("w") > 2 * fair).collect()
    if over:
        parts = {r["range"]: int(min(ranges, r["w"] // fair + 1)) for r in over}
        most = max(parts.values())
        inner = ranged.filter(F.col("range").isin(list(parts))).groupBy("range").agg(F.percentile_approx("doc_id", [i / most for i in range(1, most)], 20 * max(most, 500)).alias("q"))
        ranged = ranged.join(F.broadcast(inner), "range", "left").withColumn("sub", F.when(F.col("q").isNull(), 0).otherwise(F.coalesce(search(F.col("doc_id"), F.array_sort("q"), most), F.lit(0)))).drop("q")
        # Only one key may be cut by doc_id; ranges of several keys stay ordered by key first.
        mixed = [r["range"] for r in ranged.filter(F.col("range").isin(list(parts))).groupBy("range").agg((F.min("k") != F.max("k")).alias("mixed")).collect() if r["mixed"]]
        top = ranged.filter(F.col("range").isin(mixed)).groupBy("range", "k").agg(F.sum("size").alias("w")).filter(F.col("w") > fair).select("range", F.col("k").alias("hot"))
        hot: dict[int, list[int]] = {}
        for r in top.orderBy("range", "hot").collect() if mixed else []:  # at most two a range, as each is over half of one's share
            hot.setdefault(r["range"], []).append(r["hot"])
        width = max([len(h) for h in hot.values()], default=0)
        if mixed:
            table = F.create_map(*[x for r in mixed for x in (F.lit(r), longs(hot.get(r, [])))])
            keys = F.when(F.col("range").isin(mixed), table[F.col("range")])
            ups = search(F.col("k"), keys, max(1, width))
            same = F.coalesce(F.array_contains(keys, F.col("k")), F.lit(False))
            ranged = ranged.withColumn("part", F.when(keys.isNull(), 0).otherwise(2 * ups - F.when(same, 1).otherwise(0))).withColumn("sub", F.when(F.col("range").isin(mixed) & ~same, 0).otherwise(F.col("sub")))
        else:
            ranged = ranged.withColumn("part", F.lit(0))
    else:
        ranged = ranged.withColumn("part", F.lit(0)).withColumn("sub", F.lit(0))
    cell = ["range", "part", "sub"]
    sizes = sorted((tuple(r[c] for c in cell), r["w"], r["n"]) for r in ranged.groupBy(*cell).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect())
    rows, before, count = ["(0, 0, 0, 0L, 0L)"] * (not sizes), 0, 0
    for (a, b, c), w, n in sizes:
        rows.append(f"({a}, {b}, {c}, {before}L, {count}L)")
        before, count = before + w, count + n
    offsets = spark.sql(f"select * from values {', '.join(rows)} as t(range, part, sub, before, place)")
    own = Window.partitionBy(*cell).orderBy(F.col("k"), F.col("doc_id").asc_nulls_first(), "size")
    placed = (
        ranged.join(F.broadcast(offsets), cell)
        .withColumn("start", F.col("before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("rank", F.col("place") + F.row_number().over(own) - 1)
    )
    # A group up to the limit takes the shard of its first record; it lies in one cell, as cells divide large groups only.
    group = Window.partitionBy(*cell, "k")
    limit = int(whole_group * total / shards)
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
    whole = F.when(F.col("group_bytes") <= limit, F.col("group_start") + F.floor(F.col("group_bytes") / 2)).otherwise(F.col("start") + F.floor(F.col("size") / 2))
    placed = placed.withColumn("shard", range_of(whole, ends[:-1]))
    placed = stage_table(placed.select("doc_id", "size", "text_crc32", "shard", "rank"), "shards")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    first = F.get(longs([firsts.get(s, 0) - held[s] for s in range(shards)]), F.col("shard"))
    out = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))
    if dealt:
        rest = spark.sql(f"select cast(doc_id as bigint) as doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, shard, cast(slot as bigint) as slot from values {', '.join(dealt)} as t(doc_id, size, text_crc32, shard, slot)")
        out = out.unionByName(rest)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(*columns)


def room_ends(used: list[int], left: int) -> list[int]:
    """Where each shard's share of the left bytes ends, so that all shards come as near one level as they can."""
    low, high = 0, max(used, default=0) + left + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(max(0, mid - u) for u in used) <= left else (low, mid)
    rooms = [max(0, low - u) for u in used]
    spare, n = left - sum(rooms), len(used)
    out, at = [], 0
    for i, r in enumerate(rooms):
        at += r + spare * (i + 1) // n - spare * i // n
        out.append(at)
    return out
