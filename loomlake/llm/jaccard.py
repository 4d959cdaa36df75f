"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with equal shingle sets are one class and take part once. MinHash bands propose candidates, each
pair in the first band that it shares. The pair's MinHash values are then compared a few at a time, and it
is dropped once the posterior probability that its similarity reaches the threshold is below a tolerance.
Only documents with a pair left send their shingle sets to the bucket in charge of it, where exactly the
pairs that are left are verified by the intersections of their sets.

No pair ever becomes a row: a bucket sends on the documents with pairs left, and after verification the
links of a spanning forest and a count of links for each member. Crowded buckets are divided into tiles, and
each pair of tiles is a task of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomlake.llm.common import byte_table, lean, mix, ranges, stage_table
from loomlake.llm.graph import components, local_roots

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TILE = 1024
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
TABLE = byte_table(3)
BASE = 0xD1342543DE82EF95
SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles as 64-bit hashes.

    Words stand between ASCII white space, A-Z in lower case. A text of fewer than `size` words is one
    shingle of all its words; a text without words has none.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]).translate(LOWER), np.uint8)
    none = np.zeros(0, np.uint64)
    if not len(data):
        return [none for _ in texts]
    blank = SPACE[data]
    turn = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
    begin, end = turn[::2], turn[1::2]
    if not len(begin):
        return [none for _ in texts]
    up, down = powers(BASE, len(data) + 1), powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    word = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    del sums, up, down
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    at = np.searchsorted(begin, np.r_[0, np.cumsum(lengths)])
    many = max(0, len(word) - size + 1)
    rolled = np.zeros(many, np.uint64)
    for k in range(size):
        rolled += word[k : k + many] * np.uint64((2 * k + 1) * 0x9FB21C651E98DF25 % (1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = word[a:b] * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1))
            out.append(mix(np.array([few.sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(none)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values, a row for each set; an empty set has zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        sizes = np.array([len(sets[i]) for i in full])
        flat, begin = np.concatenate([sets[i] for i in full]), np.cumsum(sizes) - sizes
        for k, salt in enumerate(SALTS):
            out[full, k] = (mix(np.minimum.reduceat(flat * salt, begin)) >> np.uint64(48)).astype(np.uint16)
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes()


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair may still reach the threshold.

    With a flat prior the posterior probability of a similarity of at least t, given m of n matches, is
    that of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def charged(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common band is the given one."""
    bands = sig.view(np.uint64)  # ROWS values of 16 bits
    at = np.broadcast_to(band, i.shape)
    keep = bands[i, at] == bands[j, at]
    i, j, at = i[keep], j[keep], at[keep]
    for k in range(int(at.max(initial=0))):
        keep = (bands[i, k] != bands[j, k]) | (at <= k)
        i, j, at = i[keep], j[keep], at[keep]
    return i, j


def pruned(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs that are still likely enough when all values have been compared."""
    hits = np.zeros(len(i), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        hits += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = hits >= least[n]
        i, j, hits = i[keep], j[keep], hits[keep]
    return i, j


def each_group(batches: Iterator[pa.RecordBatch], keys: int, make: Callable[[list[np.ndarray], pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call make(key columns, rows, group bounds) on runs of whole groups of a sorted partition."""
    held: list[pa.RecordBatch] = []

    def closed(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [whole.column(c).to_numpy() for c in range(keys)]
        change = np.zeros(whole.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        yield from make(cols, whole, np.r_[0, np.flatnonzero(change) + 1, whole.num_rows])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(keys)]
        same = np.ones(batch.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        begin = int(np.argmax(same))
        if held:
            last = held[-1]
            if begin or any(last.column(c)[last.num_rows - 1].as_py() != cols[c][0] for c in range(keys)):
                yield from closed(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
        elif begin:
            yield from closed(pa.Table.from_batches([batch.slice(0, begin)]))
        held.append(batch.slice(begin))
    if held:
        yield from closed(pa.Table.from_batches(held))


def tile_pairs(df: DataFrame, size: str, tile: int) -> DataFrame:
    """Give each row of a group of `size` rows a tile, and repeat it for every pair of tiles that it is in."""
    df = df.withColumn("tiles", F.ceil(F.col(size) / tile).cast("int")).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return df.withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")}).drop("tiles", "other", size)


def across(sub: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one pair of tiles: between them, or all within one."""
    if i == j:
        return np.triu_indices(len(sub), 1)
    a, b = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the two sets of each pair share."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    rank, row = (np.cumsum(count > 1) - 1)[at[keep]], np.repeat(np.arange(n), sizes)[keep]
    kinds = max(1, int((count > 1).sum()))
    out = np.zeros(len(i), np.int64)
    if len(i) > 8 * n:
        order = np.argsort(rank, kind="stable")
        column, row = rank[order], row[order]
        both = np.zeros((n, n), np.float32)
        width = max(256, (1 << 24) // n // 4)
        for lo in range(0, kinds, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            block = np.zeros((n, min(width, kinds - lo)), np.float32)
            block[row[a:b], column[a:b] - lo] = 1
            both += block @ block.T
        return both[i, j].astype(np.int64)
    left = np.bincount(row, minlength=n)
    first = np.cumsum(left) - left
    ends = np.cumsum(left[i] + left[j])
    at = 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        p, q, nth = i[at:stop], j[at:stop], np.arange(stop - at)
        keys = np.concatenate([np.repeat(nth, left[x]) * kinds + rank[ranges(first[x], left[x])] for x in (p, q)])
        keys.sort()
        out[at:stop] = np.bincount(keys[1:][keys[1:] == keys[:-1]] // kinds, minlength=stop - at)
        at = stop
    return out


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a Jaccard similarity of at least threshold."""
    if not len(i):
        return i, j
    sizes, both = np.array([len(s) for s in sets], np.int64), shared_counts(sets, i, j)
    keep = both * 1_000_000 >= np.int64(round(threshold * 1_000_000)) * (sizes[i] + sizes[j] - both)
    return i[keep], j[keep]


def keyed_classes(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, cls, root, copy_id, n_links, class_id, kept. cls is the key of the shingle set, root that of its class.

    Texts link if the Jaccard similarity of their sets of `size`-word shingles is at least `threshold`
    (see shingle_sets for words and short texts). copy_id is the least doc_id with the same shingle set,
    n_links the number of other documents that it links with directly, class_id the least doc_id that
    links reach. kept marks the document that stays of each class. Texts without words, null ones
    too, link with nothing. Repeated rows link with each other and are all marked as kept. Rows with a
    null doc_id are left out. Bands miss a pair of similarity 0.8 with probability 3e-6.
    """
    spark = docs.sparkSession
    missed = (1 - threshold**ROWS) ** BANDS
    if missed > 1e-5:
        raise ValueError(f"{BANDS} bands of {ROWS} values miss a pair at this threshold with probability {missed:.1e}; it must be 0.79 at least")
    least = least_matches(threshold, tolerance)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "cls", "n", "sig"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    signs = stage_table(rows.mapInArrow(lean(signed), "doc_id long, cls binary, n int, sig binary"), "signatures")
    nodes = signs.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = stage_table(nodes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = mix(np.arange(ROWS, dtype=np.uint64) + np.uint64(11)) | np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            value = mix((sig * factor).sum(axis=2, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(value.ravel().view(np.int64)), pa.array(np.repeat(batch.column(2).to_numpy(), BANDS))], names=["id", "band", "bucket", "n"])

    buckets = nodes.select("id", "sig", "n").mapInArrow(lean(banded), "id long, band int, bucket long, n int")
    # A tile has TILE documents and about a million shingles at most.
    crowds = buckets.groupBy("band", "bucket").agg(F.count("*").alias("docs"), F.greatest(F.count("*"), F.ceil(F.sum("n") * TILE / (1 << 20))).alias("m")).filter("docs > 1").drop("docs")
    group = ["band", "bucket", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = tile_pairs(buckets.join(crowds, ["band", "bucket"]), "m", TILE).join(nodes.select("id", "sig"), "id")
    met = met.select(*group, "sub", "id", "sig").repartition(parts, *group).sortWithinPartitions(*group)

    def left_over(keys: list[np.ndarray], sub: np.ndarray, sig: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, i, j): of the groups from row lo to row hi the pairs that are left; groups of equal size up to 32 are taken together."""
        width = np.diff(bounds)
        same = keys[2][bounds[:-1]] == keys[3][bounds[:-1]]
        for w in np.unique(width[(width > 1) & (width <= 32) & same]):
            some = bounds[:-1][(width == w) & same]
            a, b = np.triu_indices(w, 1)
            step = max(1, (1 << 15) // len(a))
            for at in range(0, len(some), step):
                i, j = (some[at : at + step, None] + a).ravel(), (some[at : at + step, None] + b).ravel()
                yield 0, len(sub), *pruned(sig, *charged(sig, i, j, keys[0][i]), least)
        for g in np.flatnonzero((width > 32) | ((width > 1) & ~same)):
            lo, hi = bounds[g], bounds[g + 1]
            i, j = across(sub[lo:hi], keys[2][lo], keys[3][lo])
            out = [pruned(sig, *charged(sig, i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)] + lo, keys[0][lo]), least) for at in range(0, len(i), 1 << 16)]
            if out:
                yield lo, hi, np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def signature_rows(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(keys: list[np.ndarray], whole: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            some = np.zeros(whole.num_rows, bool)
            for _, _, i, j in left_over(keys, whole.column(4).to_numpy(), signature_rows(whole.column(6)), bounds):
                some[i] = some[j] = True
            if some.any():
                yield from whole.select([0, 1, 2, 3, 4, 5]).filter(pa.array(some)).to_batches()

        yield from each_group(batches, 4, make)

    near = stage_table(met.mapInArrow(lean(candidates), "band int, bucket long, i int, j int, sub int, id long"), "candidates")
    picked = near.select("id").distinct().join(nodes.select("id", "cls", F.col("copy_id").alias("doc_id"), "copies", "sig"), "id")
    texts = rows.join(picked, "doc_id").select("id", "copies", "sig", "cls", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(4).to_pylist(), size)
                keep = pa.array([set_key(s) == c for s, c in zip(sets, part.column(3).to_pylist(), strict=True)], pa.bool_())
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "copies", "sig", "shingles"])
                yield made.filter(keep)

    sets = stage_table(texts.mapInArrow(lean(shingled), "id long, copies long, sig binary, shingles binary"), "shingles")
    tiled = near.join(sets, "id").select(*group, "sub", "id", "sig", "copies", "shingles").repartition(parts, *group).sortWithinPartitions(*group, "id")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(keys: list[np.ndarray], whole: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Repeated rows of a text gave its set more than once.
            ids = whole.column(5).to_numpy()
            fresh = np.r_[True, ids[1:] != ids[:-1]]
            fresh[bounds[:-1]] = True
            bounds = np.r_[0, np.cumsum(fresh)][bounds]
            whole, keys = whole.filter(pa.array(fresh)), [k[fresh] for k in keys]
            sub, ids, copies = whole.column(4).to_numpy(), whole.column(5).to_numpy(), whole.column(7).to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi, i, j in left_over(keys, sub, signature_rows(whole.column(6)), bounds):
                used = np.unique(np.r_[i, j])
                i, j = np.searchsorted(used, i), np.searchsorted(used, j)
                lists = [np.frombuffer(b, np.uint64) for b in whole.column(8).take(pa.array(used)).to_pylist()]
                i, j = exact(lists, i, j, threshold)
                if not len(i):
                    continue
                w = copies[used]
                counts = np.bincount(i, w[j], len(used)) + np.bincount(j, w[i], len(used))
                roots, some = local_roots(len(used), i, j), np.flatnonzero(counts)
                out[0].append(ids[used[some]])
                out[1].append(ids[used[roots[some]]])
                out[2].append(counts[some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["u", "v", "found"])

        yield from each_group(batches, 4, make)

    found = stage_table(tiled.mapInArrow(lean(verified), "u long, v long, found long"), "links")
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("found").alias("found"))
    roots = components(found.select("u", "v")).withColumnRenamed("node", "id")
    named = nodes.select("id", "cls", "copy_id", "copies").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(firsts, "root").select("cls", "root", "copy_id", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "class_id")
    worded = signs.filter("n > 0").select("doc_id", "cls").join(named, "cls").select("doc_id", "cls", "root", "copy_id", "n_links", "class_id")
    bare = signs.filter("n = 0").select("doc_id", "cls", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return worded.unionByName(bare).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def jaccard_classes(docs: DataFrame, **options: object) -> DataFrame:
    """One row a document: doc_id, copy_id, n_links, class_id, kept; see keyed_classes for what they mean and for options."""
    return keyed_classes(docs, **options).drop("cls", "root")


def drop_near_copies(docs: DataFrame, **options: object) -> DataFrame:
    """docs without those that another document of their class stands for; columns as they were, whatever their names.

    One row of each class stays, one with its least doc_id. Rows with one doc_id and different texts are judged
    each by its own class. Texts without words, null ones too, and rows with a null doc_id all stay. An empty
    table gives no rows.
    """
    found = stage_table(keyed_classes(docs, **options).select("doc_id", "cls", "root", "kept"), "classes")
    ids = found.groupBy("doc_id").agg(F.count_if("kept").alias("k"), F.count("*").alias("n"))
    several = ids.filter("k > 0 and n > 1").select("doc_id")
    left = docs.join(ids.filter("k = 0 or n > 1").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if several.isEmpty():
        return left
    at, size = docs.columns.index(options.get("text", "text")), options.get("size", 5)
    cls, root, nth = (f"{x}_{uuid.uuid4().hex}" for x in ("cls", "root", "nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                keys = [set_key(s) for s in shingle_sets(part.column(at).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, cls])

    some = docs.join(several, "doc_id", "left_semi").select(*docs.columns).mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(cls, BinaryType())]))
    stay = found.filter("kept").select("doc_id", F.col("cls").alias(cls), F.col("root").alias(root)).distinct()
    order = Window.partitionBy("doc_id", root).orderBy(cls, F.xxhash64(options.get("text", "text")))
    met = some.join(stay, ["doc_id", cls]).withColumn(nth, F.row_number().over(order)).filter(F.col(root).isNull() | (F.col(nth) == 1))
    return left.unionByName(met.select(*docs.columns))
