"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation their squared distance is the sum of
those in disjoint blocks of dimensions, so two that are within the limit are within a block's
proportional share of it in one block at least. Each block is range-joined under that share, twice:

* between tasks on a k-d tree whose splits come from a bounded sample. Each level of a path splits another
  dimension of the block, so a vector's squared distance to a leaf is the sum over the splits it crosses,
  and it visits the leaves within the block's share. A label takes as many levels as its vectors need;
* within a task by halving the home vectors again and again; those visitors go on that are within the
  share of a half's bounding box, and few are left for each small group.

Of the pairs that meet, each is taken in its first block that passes, then verified by the exact cosine.
Equal vectors are one node with a weight. Links are counted where they are found and only a spanning
forest of them leaves a group, so a dense group gives rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import lean, stage_table
from loomlake.llm.graph import components, local_roots

TILE = 4096
LEAF = 4
SLACK = 1e-9
Tree = list[tuple[np.ndarray, np.ndarray]]


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int) -> list[tuple[int, int]]:
    at = [dim * i // min(blocks, dim) for i in range(min(blocks, dim) + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates, row by row, so that a vector's coordinates don't depend on its company."""
    wide = vectors.astype(np.float64)
    return np.einsum("ij,jk->ik", wide / np.linalg.norm(wide, axis=1)[:, None], rotation(vectors.shape[1]))


def split_tree(x: np.ndarray, levels: int) -> Tree:
    """For each level the dimension and the place of every node's split: the sample's median where it is spread most.

    No path splits one dimension twice. Node n has its lower half in node 2n of the next level.
    """
    out, groups, used = [], [np.arange(len(x))], [frozenset()]
    for _ in range(min(levels, x.shape[1])):
        axis, place, halves, paths = [], [], [], []
        for g, path in zip(groups, used, strict=True):
            spread = x[g].std(axis=0) if len(g) > 1 else np.zeros(x.shape[1])
            spread[list(path)] = -1
            a = int(spread.argmax())
            m = float(np.median(x[g, a])) if len(g) else 0.0
            low = x[g, a] <= m
            axis.append(a)
            place.append(m)
            halves += [g[low], g[~low]]
            paths += [path | {a}] * 2
        out.append((np.array(axis), np.array(place)))
        groups, used = halves, paths
    return out


def visits(x: np.ndarray, tree: Tree, depth: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaves, `depth` levels down, that each row lives in or comes near enough to."""
    row, leaf, home, gone = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool), np.zeros(len(x))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(len(tree) + 1):
        rest = depth[row] > level
        if level == len(tree):
            rest[:] = False
        done.append((row[~rest], leaf[~rest], home[~rest]))
        row, leaf, home, gone = row[rest], leaf[rest], home[rest], gone[rest]
        if not len(row):
            break
        axis, place = tree[level]
        off = x[row, axis[leaf]] - place[leaf]
        own, far = 2 * leaf + (off > 0), 2 * leaf + (off <= 0)
        over = gone + off * off
        near = over <= share
        row, leaf, home, gone = np.r_[row, row[near]], np.r_[own, far[near]], np.r_[home, np.zeros(int(near.sum()), bool)], np.r_[gone, over[near]]
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def close_pairs(x: np.ndarray, own: np.ndarray, other: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of own, j of other) to compare: all within `share`, and some that are farther apart."""
    todo = [(own, other)]
    while todo:
        own, other = todo.pop()
        if not len(own) or not len(other):
            continue
        box = x[own]
        spread = np.ptp(box, axis=0)
        a = int(spread.argmax())
        if len(own) <= LEAF or spread[a] == 0:
            step = max(1, (1 << 18) // len(own))
            for at in range(0, len(other), step):
                part = other[at : at + step]
                yield np.repeat(own, len(part)), np.tile(part, len(own))
            continue
        low = box[:, a] <= np.median(box[:, a])
        if low.all():
            low = box[:, a] < box[:, a].max()
        for half in (own[low], own[~low]):
            box = x[half]
            gap = x[other]
            gap = np.maximum(np.maximum(box.min(axis=0) - gap, gap - box.max(axis=0)), 0)
            todo.append((half, other[np.einsum("ij,ij->i", gap, gap) <= share]))


def join_group(block: int, tiles: tuple[int, int], sub: np.ndarray, home: np.ndarray, ids: np.ndarray, vectors: np.ndarray, cosine: float, limit: float, blocks: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Verified links (i, j) among one leaf's rows for which this leaf and block are in charge, and how many pairs were compared."""
    dim = vectors.shape[1]
    wide = vectors.astype(np.float64)
    norm = np.linalg.norm(wide, axis=1)
    unit = rotated(vectors)
    shares = blocks_of(dim, blocks)
    budget = [limit * (hi - lo) / dim + SLACK for lo, hi in shares]

    def apart(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        for d in range(*shares[k]):
            total += (unit[i, d] - unit[j, d]) ** 2
        return np.round(total, 11)

    left, right = np.flatnonzero(home & (sub == tiles[0])), np.flatnonzero(sub == tiles[1])
    sides = [(left, right)] if tiles[0] == tiles[1] else [(left, right), (np.flatnonzero(home & (sub == tiles[1])), np.flatnonzero(sub == tiles[0]))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    compared = 0
    for own, other in sides:
        for i, j in close_pairs(unit[:, slice(*shares[block])], own, other, budget[block] + SLACK):
            keep = ids[i] < ids[j]  # the leaf of the lesser id is in charge
            i, j = i[keep], j[keep]
            compared += len(i)
            keep = apart(block, i, j) <= budget[block]
            i, j = i[keep], j[keep]
            for k in range(block):
                keep = apart(k, i, j) > budget[k]
                i, j = i[keep], j[keep]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                near = (wide[p] * wide[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
                found.append((p[near], q[near]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, compared
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), compared


def near_vectors(table: DataFrame, *, cosine: float = 0.98, blocks: int = 4, tile: int = TILE, sample: int = 20_000) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    table: vec_id, embedding, label; label of any type that can be grouped by. Vectors link if their labels
    are equal and not null, their lengths are equal and their cosine in double precision is at least
    `cosine`. Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    label, link with nothing and keep their own id. Repeated rows are vectors of their own and link with
    each other. Null vec_ids are kept with a null component and take no part. Extra columns are not read.
    An empty table gives no rows.

    sample: how many vectors the splits are taken from; all vectors are indexed, and no result depends on it.
    """
    limit = 2 * (1 - cosine)
    bad = F.col("embedding").isNull() | F.col("label").isNull() | F.col("vec_id").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = table.select("vec_id", "embedding", "label").withColumn("ok", ~F.coalesce(bad, F.lit(True)))
    good = rows.filter("ok").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(table.schema["embedding"].dataType.elementType)))
    nodes = stage_table(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    # A crowd: equal labels and lengths, with as many levels of splits as bring its leaves to half a tile.
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") * F.lit(2.0 / tile)))).cast("int")
    crowds = stage_table(nodes.groupBy("label", F.size("embedding").alias("dim")).agg(levels.alias("levels")).withColumn("crowd", F.monotonically_increasing_id()), "crowds")
    wide = F.col("embedding").cast("array<double>").alias("vector")
    points = nodes.join(crowds, (nodes["label"] == crowds["label"]) & (F.size("embedding") == F.col("dim"))).select("id", "n", "crowd", "dim", "levels", wide)
    deepest = crowds.agg(F.max("levels")).first()[0] or 0
    trees: dict[int, list[Tree]] = {}
    if deepest:
        drawn = points.filter("levels > 0").select("dim", "vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("dim", "vector").toArrow()
        dims = drawn.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            some = rotated(np.array(drawn.column(1).filter(pa.array(dims == dim)).combine_chunks().flatten()).reshape(-1, dim))
            most = min(deepest, max(0, int(np.log2(max(1, len(some) / 4)))))
            trees[dim] = [split_tree(some[:, lo:hi], most) for lo, hi in blocks_of(dim, blocks)]
    shared = table.sparkSession.sparkContext.broadcast(trees)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims, depth = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                for dim in np.unique(dims).tolist():
                    some = np.flatnonzero(dims == dim)
                    mine = batch.take(pa.array(some))
                    vectors = np.asarray(mine.column(5).flatten(), np.float64).reshape(-1, dim)
                    unit = rotated(vectors)
                    for k, (lo, hi) in enumerate(blocks_of(dim, blocks)):
                        tree = shared.value[dim][k] if dim in shared.value else []
                        row, leaf, home = visits(unit[:, lo:hi], tree, depth[some], limit * (hi - lo) / dim + 2 * SLACK)
                        out = mine.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([out.column(2), pa.array(np.full(len(row), k, np.int32)), pa.array(leaf), pa.array(home), out.column(0)], names=["crowd", "block", "leaf", "home", "id"])

    spots = stage_table(points.select("id", "n", "crowd", "dim", "levels", "vector").mapInArrow(lean(leaves), "crowd long, block int, leaf long, home boolean, id long"), "leaves")
    key = ["crowd", "block", "leaf"]
    sizes = spots.groupBy(*key).agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).filter("m > 1 and homes > 0").withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    met = spots.join(sizes.select(*key, "tiles"), key).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*key, "id", "home", "sub", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"))
    met = met.join(points.select("id", "n", "vector"), "id")
    group = [*key, "i", "j"]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(4 * parts, *group).sortWithinPartitions(*group).select(*group, "sub", "home", "id", "n", "vector")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([np.asarray(whole.column(c)) for c in range(5)])
            edge = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            sub, home, ids, n = (np.asarray(whole.column(c)) for c in range(5, 9))
            lists = whole.column(9).combine_chunks()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a < 2 or not home[a:b].any():
                    continue
                vectors = np.asarray(lists.slice(a, b - a).flatten(), np.float64).reshape(b - a, -1)
                i, j, _ = join_group(int(keys[1, a]), (int(keys[3, a]), int(keys[4, a])), sub[a:b], home[a:b], ids[a:b], vectors, cosine, limit, blocks)
                if not len(i):
                    continue
                own, w = ids[a:b], n[a:b]
                counts = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
                roots = local_roots(b - a, i, j)
                some = np.flatnonzero(counts)
                out[0].append(own[some])
                out[1].append(own[roots[some]])
                out[2].append(counts[some].astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["u", "v", "found"])

        for batch in batches:
            # A group is held until the next one begins.
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(5)) if batch.num_rows else None
            if last is None:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in range(5)])
            begin = int(np.argmax((keys == np.array(last)[:, None]).all(axis=0)))
            if begin:
                yield from closed(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            elif held and tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in range(5)) != last:
                yield from closed(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from closed(pa.Table.from_batches(held))

    found = stage_table(met.mapInArrow(lean(links), "u long, v long, found long"), "links")
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("found").alias("found"))
    roots = components(found.select("u", "v"))
    labelled = nodes.select("id", "least", "n", "label", "embedding").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(least, "root").select("label", "embedding", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "label", "embedding").join(by_node, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
