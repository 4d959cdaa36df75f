"""Near duplicates of 64-bit hashes by Hamming distance, keeping the first of each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import hamming
from loomlake.sources.staging import staged, unstage

#: Rows of a key from which on it is divided, and rows up to which a table of such keys is broadcast.
CROWD = 2048
FEW = 20_000


def band_edges(threshold: int, bits: int) -> list[int]:
    """Bounds of so few bands that two hashes within threshold differ by at most two bits in one of them."""
    bands = threshold // 3 + 1
    return [bits * i // bands for i in range(bands + 1)]


def band_of(h: Column, low: int, high: int) -> Column:
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", h, F.lit(64 - high)), F.lit(64 - high + low))


def probes(h: Column, edges: list[int]) -> Column:
    """Keys (band, flip, value) of a hash: each band as it is, flip -1, and with each of its bits flipped."""
    keys = []
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = band_of(h, low, high)
        flips = [F.struct(F.lit(i).alias("band"), F.lit(-1).alias("flip"), part.alias("value"))]
        flips += [F.struct(F.lit(i).alias("band"), F.lit(k).alias("flip"), part.bitwiseXOR(F.lit((1 << k) - (1 << 64) * (k == 63))).alias("value")) for k in range(high - low)]
        keys += flips
    return F.array(*keys)


def rest_of(h: Column, low: int, high: int) -> Column:
    """The bits of h outside a band, pushed together."""
    below = h.bitwiseAND(F.lit((1 << low) - 1))
    return below if high == 64 else F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, F.lit(high)), F.lit(low)).bitwiseOR(below)


def lone_key(x: Column, y: Column, edges: list[int], band: str, flip: str) -> Column:
    """Whether the key on which a and b meet is the one that counts for the pair.

    That is in its first band with at most two bits, x flipping the lower of the two, none where it is one
    bit, and neither flipping where the band is equal.
    """
    mine, other = F.col(f"a.{flip}"), F.col(f"b.{flip}")
    apart = [hamming(band_of(x, low, high), band_of(y, low, high)) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    here, first = F.lit(False), F.lit(True)
    for i, d in enumerate(apart):
        one = F.when(d == 0, (mine == -1) & (other == -1)).when(d == 1, mine == -1).otherwise((mine >= 0) & (mine < other))
        here = here | ((F.col(f"a.{band}") == i) & first & one)
        first = first & (d > 2)
    return here


def kept_apart(df: DataFrame, name: str) -> DataFrame:
    """df written, and never broadcast: a file of sorted keys is packed to a byte a row and less, so its size says nothing of its rows."""
    return staged(df, name).hint("merge")


def few(df: DataFrame) -> tuple[DataFrame, int]:
    """df written, for a broadcast if it has at most FEW rows, and its number of rows."""
    df = staged(df, "crowded")
    n = df.count()
    return (F.broadcast(df) if n <= FEW else df.hint("merge")), n


def crowded_keys(hashes: DataFrame, edges: list[int]) -> DataFrame:
    """(band, value) that more than CROWD hashes may reach, flipped or not.

    Values that CROWD / 32 hashes have are counted alone, so what isn't named has under three times CROWD.
    """
    own = F.array(*[F.struct(F.lit(i).alias("band"), band_of(F.col("h"), low, high).alias("v")) for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    heavy = hashes.select(F.inline(own)).groupBy("band", "v").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD // 32)
    width = F.element_at(F.array(*[F.lit(high - low) for low, high in zip(edges[:-1], edges[1:], strict=True)]), F.col("band") + 1)
    flipped = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return heavy.select("band", "n", F.explode(F.concat(F.array("v"), flipped)).alias("value")).groupBy("band", "value").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD).select("band", "value")


def near_hashes(hashes: DataFrame, threshold: int, bits: int = 64, *, verified: bool = True) -> DataFrame:
    """(x, y): distinct hashes x < y of (h) that differ in at most threshold bits, each pair once.

    Both sides flip at most one bit of a band, so hashes that are two bits apart in it meet. Keys that more than
    CROWD hashes reach are not joined: their hashes meet on a second key of bands of the bits outside, of which
    one again differs in at most two bits; two sides that flip the same bit are not brought together. Second keys that are crowded too are divided into pairs of tiles, so
    no group of the join compares many more than CROWD x CROWD pairs, whatever the hashes. A job counts band values first,
    and pairs are written where there are crowds. verified=False gives all pairs that meet, whatever their distance.
    """
    edges = band_edges(threshold, bits)
    keyed = hashes.select("h", F.inline(probes(F.col("h"), edges)))
    crowds, n = few(crowded_keys(hashes, edges))
    x, y = F.col("a.h"), F.col("b.h")

    def meet(left: DataFrame, right: DataFrame, keys: list[str], counts: Column) -> DataFrame:
        met = F.lit(True)
        for k in keys:
            met = met & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        close = hamming(x, y) <= threshold if verified else F.lit(True)
        left, right = left.hint("merge"), right.hint("merge")  # Spark doesn't count what a hash is multiplied to, and would broadcast all keys
        return left.alias("a").join(right.alias("b"), met & (x < y) & close & counts).select(x.alias("x"), y.alias("y"))

    first = lone_key(x, y, edges, "band", "flip")
    if not n:
        return meet(keyed, keyed, ["band", "value"], first)
    thin = keyed.join(crowds, ["band", "value"], "left_anti")
    out = meet(thin, thin, ["band", "value"], first)
    hot = keyed.join(crowds, ["band", "value"])
    sides = kept_apart(hot.groupBy("band", "value", "flip").agg(F.count("*").alias("n")), "flips")
    ends = [sides.select("band", "value", F.col("flip").alias(c), F.col("n").alias(f"n_{c}")) for c in "fg"]
    pairs = kept_apart(ends[0].join(ends[1], ["band", "value"]).filter("f < g or (f = -1 and g = -1)").select("band", "value", "f", "g", (F.col("n_f") * F.col("n_g") > CROWD * CROWD).alias("many")), "flips")
    unstage(sides)
    beside = [hot.join(pairs.filter("not many").withColumn("flip", F.col(c)), ["band", "value", "flip"]) for c in "fg"]
    out = out.unionByName(meet(*beside, ["band", "value", "f", "g"], first))
    if pairs.filter("many").isEmpty():
        return staged(out, "near")
    pairs = pairs.filter("many").drop("many")
    keys = ["band", "value", "f", "g", "band2", "value2"]
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inner = band_edges(threshold, bits - (high - low))  # a single band has all bits, and few distinct hashes reach its values
        again = F.transform(probes(F.col("rest"), inner), lambda k: F.struct(k["band"].alias("band2"), k["flip"].alias("flip2"), k["value"].alias("value2")))
        more = hot.filter(F.col("band") == i).withColumn("rest", rest_of(F.col("h"), low, high))
        left, right = (more.join(pairs.withColumn("flip", F.col(c)), ["band", "value", "flip"]).select("h", "rest", "flip", *keys[:4], F.inline(again)) for c in "fg")
        counts = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
        most = F.greatest(F.sum("l"), F.sum("r"))
        tiles, m = few(counts.groupBy(*keys).agg(F.ceil(most / CROWD).cast("int").alias("tiles")).filter("tiles > 1"))
        second = lone_key(F.col("a.rest"), F.col("b.rest"), inner, "band2", "flip2")
        if not m:
            out = out.unionByName(meet(left, right, keys, first & second))
            continue

        def cut(side: DataFrame, own: str, other: str, tiles: DataFrame = tiles) -> DataFrame:
            all_tiles = side.join(tiles, keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
            return all_tiles.withColumn(own, F.expr("pmod(xxhash64(h), tiles)").cast("int")).withColumn(other, F.explode(F.expr("sequence(0, tiles - 1)")))

        out = out.unionByName(meet(cut(left, "s", "t"), cut(right, "t", "s"), [*keys, "s", "t"], first & second))
    return staged(out, "near")


def hamming_pairs(df: DataFrame, *, threshold: int, hash_col: str = "hash", pos: str = "pos", bits: int = 64) -> DataFrame:
    """(a, b, distance) of all rows a before b whose hashes differ in at most threshold bits; null hashes have none.

    Equal hashes are one node of the join; see near_hashes.
    """
    if not 0 <= threshold < bits:
        raise ValueError("threshold must be within the hash")
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(pos).alias("pos"), F.col(hash_col).alias("h"))
    nodes = rows.select("h").distinct()
    near = near_hashes(nodes, threshold, bits)
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(nodes.select(F.col("h").alias("x"), F.col("h").alias("y")))
    left = rows.select(F.col("pos").alias("a"), F.col("h").alias("x"))
    right = rows.select(F.col("pos").alias("b"), F.col("h").alias("y"))
    return left.join(both.hint("merge"), "x").join(right, "y").filter("a < b").select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def settle(pairs: DataFrame) -> tuple[DataFrame | None, int]:
    """(p): the later ends of (a, b), a before b, that an earlier one which is itself kept makes a duplicate; and the rounds.

    That is all but the lexicographically first maximal independent set. A row is kept if none of its literals
    holds, at first that each earlier neighbour is kept. A round puts in what the round before settled, and in
    place of a row with one literal left, that literal turned round: a chain of n links takes log n rounds.
    Rows that wait for several others are settled once these are, so rounds grow with the depth of such waits.
    """
    edges = kept_apart(pairs.select("a", "b", F.lit(0).alias("s")), "pairs")
    known = kept_apart(edges.select(F.col("a").alias("p")).distinct().join(edges.select(F.col("b").alias("p")).distinct(), "p", "left_anti").withColumn("kept", F.lit(1)), "settled")
    found: list[DataFrame] = []
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        told = edges.join(known.withColumnRenamed("p", "a"), "a", "left").withColumn("v", F.col("kept").bitwiseXOR(F.col("s"))).drop("kept")
        left = F.when(F.col("v").isNull(), F.struct("a", "s"))
        state = kept_apart(told.groupBy("b").agg(F.max("v").alias("hit"), F.min(left).alias("low"), F.max(left).alias("high")), "states")
        held = F.coalesce(F.col("hit") == 1, F.lit(False))
        done = kept_apart(state.filter(held | F.col("low").isNull()).select(F.col("b").alias("p"), F.when(held, 0).otherwise(1).alias("kept")), "settled")
        waits = state.filter(~held & F.col("low").isNotNull())
        lone = waits.filter("low = high").select(F.col("b").alias("a"), F.col("low.a").alias("to"), F.col("low.s").bitwiseXOR(F.lit(1)).alias("turn"))
        rest = told.filter("v is null").join(waits.select("b"), "b", "left_semi").join(lone, "a", "left")
        new = kept_apart(rest.select(F.coalesce("to", "a").alias("a"), "b", F.col("s").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("s")).distinct(), "pairs")
        for table in (edges, state, *([known] if rounds == 1 else [])):
            unstage(table)
        edges, known = new, done
        found.append(done)
    if not found:
        return None, 0
    every = found[0]
    for table in found[1:]:
        every = every.unionByName(table)
    return every.filter("kept = 0").select("p"), rounds


def keep_first(df: DataFrame, *, threshold: int = 8, hash_col: str = "hash", pos: str = "pos") -> DataFrame:
    """Add is_duplicate: whether an earlier row that is itself kept lies within threshold; see settle.

    Equal hashes are settled beforehand, the first row standing for all. A null hash is never a duplicate.
    """
    h, first, gone = (f"_{name}_{uuid.uuid4().hex}" for name in ("h", "first", "gone"))
    firsts = df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias(h)).agg(F.min(pos).alias(first))
    near = hamming_pairs(firsts.select(F.col(h).alias("h"), F.col(first).alias("pos")), threshold=threshold, hash_col="h", pos="pos")
    dups, _ = settle(near.select("a", "b"))
    out = df.join(firsts, F.col(hash_col) == F.col(h), "left")
    later = F.coalesce(F.col(pos) > F.col(first), F.lit(False))
    if dups is None:
        return out.withColumn("is_duplicate", later).select(*df.columns, "is_duplicate")
    out = out.join(dups.select(F.col("p").alias(gone)).hint("merge"), F.col(first) == F.col(gone), "left")
    return out.withColumn("is_duplicate", later | F.col(gone).isNotNull()).select(*df.columns, "is_duplicate")
