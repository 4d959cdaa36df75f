"""How far the sources of a language differ in their words, by mergeable radix tries.

A trie's paths are the language, a zero byte and a term; its leaves count, by source, the term's
occurrences and the documents that have it. A trie is kept in preorder: each leaf says how many bytes of
its path it shares with the leaf before, and the bytes behind those. Preorder is the order of UTF-8 bytes,
and two tries merge by merging their leaves.

1. Partitions count whole texts in tries of bounded size.
2. Prefixes that divide all leaves evenly are drawn from the tries' own paths. Tries are cut there, and
   each range of prefixes is merged in one place; leaves of too few documents go.
3. Merged ranges are traversed in order. Each streams sums over its terms for pairs of sources, and for
   each source the first candidates by value, equal values in the order of their terms.

Sources meet in blocks, so neither a language with very many sources nor a term that all of them have
makes a task of its own. What reaches the driver are prefixes, a bounded number for each range.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import drop_table, lean, stage_table
from loomlake.llm.suffix import partition_keys

UNIT = 1_000_000_000
LEAST = 3
TOP = 200
SLICE = 1 << 22  # bytes of text that are counted at once
HELD = 1_500_000  # leaf counters that a task holds before it merges or passes them on
LEAVES = 8192  # leaves of a piece of a trie
RANGE = 200_000  # leaf counters that a range should get
PREFIX = 64  # bytes of a path that divide ranges
SHARED = 32  # bytes of its path that a leaf shares with the one before, at most
BLOCK = 512  # sources that are compared at once
#: Bytes of terms, A-Z in lower case; all others are zero.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
COUNTERS = {"path": pa.binary(), "source": pa.string(), "count": pa.int64(), "docs": pa.int64()}


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 on and the bytes of a column of strings without nulls."""
    column = column.cast(pa.binary())
    raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return raw - raw[0], np.frombuffer(data, np.uint8)[raw[0] : raw[-1]] if data else np.zeros(0, np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, one after another, and the number of the text each stands in."""
    at, data = binary_parts(texts)
    mapped = LETTERS[data]
    inside = mapped != 0
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    before[at[:-1][at[:-1] < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    places = np.cumsum(inside, dtype=np.int32)
    offsets = np.r_[places[start] - 1, places[-1] if len(places) else 0].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(mapped[inside])])
    return found, np.searchsorted(at, start, "right") - 1


def count_terms(langs: list[str], sources: list[str], texts: pa.Array) -> pa.Table:
    """COUNTERS of some documents."""
    terms, doc = terms_of(texts)
    coded = terms.dictionary_encode()
    groups: dict[tuple[str, str], int] = {}
    of = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], np.int64)
    code = np.asarray(coded.indices).astype(np.int64)
    keys, counts = np.unique(code * len(groups) + of[doc], return_counts=True)
    once = np.unique(code * len(of) + doc)
    # Both have the same pairs of term and group, so the counts stand side by side.
    docs = np.unique(once // len(of) * len(groups) + of[once % len(of)], return_counts=True)[1]
    names = list(groups)
    group = pa.array(keys % len(groups), pa.int32())
    heads = pa.DictionaryArray.from_arrays(group, pa.array([x.encode() for x, _ in names], pa.binary())).dictionary_decode()
    paths = pa.compute.binary_join_element_wise(heads, coded.dictionary.take(pa.array(keys // len(groups))), b"\0")
    owner = pa.DictionaryArray.from_arrays(group, pa.array([x for _, x in names], pa.string())).dictionary_decode()
    return pa.table([paths, owner, pa.array(counts), pa.array(docs)], names=list(COUNTERS))


def added_up(tables: list[pa.Table]) -> pa.Table:
    """One row for each path and source, in the order of paths."""
    whole = pa.concat_tables(tables)
    made = whole.group_by(["path", "source"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")]).rename_columns(list(COUNTERS))
    return made.sort_by([("path", "ascending"), ("source", "ascending")]).combine_chunks()


class Trie:
    """Leaves in preorder, with their counters.

    paths: the leaves' whole paths in order; leaf, source, count, docs: one row a counter, by rising leaf.
    """

    def __init__(self, paths: pa.Array, leaf: np.ndarray, source: pa.Array, count: np.ndarray, docs: np.ndarray) -> None:
        self.paths, self.leaf, self.source, self.count, self.docs = paths, leaf, source, count, docs

    @classmethod
    def of(cls, rows: pa.Table) -> Trie:
        """rows: as added_up gives them."""
        coded = rows["path"].combine_chunks().dictionary_encode()
        return cls(coded.dictionary, np.asarray(coded.indices).astype(np.int64), rows["source"].combine_chunks(), np.asarray(rows["count"]), np.asarray(rows["docs"]))

    def rows(self) -> pa.Table:
        return pa.table([self.paths.take(pa.array(self.leaf)), self.source, pa.array(self.count), pa.array(self.docs)], names=list(COUNTERS))

    def part(self, low: int, high: int) -> Trie:
        """The leaves from low to before high."""
        a, b = np.searchsorted(self.leaf, [low, high])
        return Trie(self.paths.slice(low, high - low), self.leaf[a:b] - low, self.source.slice(a, b - a), self.count[a:b], self.docs[a:b])

    def keep(self, leaves: np.ndarray) -> Trie:
        """The leaves that are marked."""
        some = leaves[self.leaf]
        rank = np.cumsum(leaves) - 1
        return Trie(self.paths.filter(pa.array(leaves)), rank[self.leaf[some]], self.source.filter(pa.array(some)), self.count[some], self.docs[some])

    def pack(self) -> bytes:
        at, data = binary_parts(self.paths)
        sizes = np.diff(at).astype(np.int64)
        heads = np.zeros((len(sizes), SHARED), np.uint8)
        columns = np.arange(SHARED)
        inside = columns < sizes[:, None]
        heads[inside] = data[(at[:-1, None] + columns)[inside]]
        same = (heads[1:] == heads[:-1]) & inside[1:] & inside[:-1]
        shared = np.r_[0, np.where(same.all(1), SHARED, same.argmin(1))] if len(sizes) else np.zeros(0, np.int64)
        tail = np.repeat(shared, sizes) <= np.arange(len(data)) - np.repeat(at[:-1], sizes)
        offsets = np.r_[0, np.cumsum(sizes - shared)].astype(np.int32)
        labels = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[tail])])
        leaves = pa.record_batch([pa.array(shared, pa.uint8()), labels], names=["shared", "label"])
        counters = pa.record_batch([pa.array(np.diff(self.leaf, prepend=0), pa.int32()), self.source.dictionary_encode(), pa.array(self.count), pa.array(self.docs)], names=["step", "source", "count", "docs"])
        sink = io.BytesIO()
        for batch in (leaves, counters):
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
        return sink.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        source = pa.BufferReader(data)
        leaves, counters = (pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(2))
        paths, path = [], b""
        for n, label in zip(leaves["shared"].to_pylist(), leaves["label"].to_pylist(), strict=True):
            path = path[:n] + label
            paths.append(path)
        step = np.asarray(counters["step"]).astype(np.int64)
        return cls(pa.array(paths, pa.binary()), np.cumsum(step), counters["source"].combine_chunks().cast(pa.string()), np.asarray(counters["count"]), np.asarray(counters["docs"]))


class Counting:
    """Counters that are merged when they are many; what still are many is passed on."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = self.bytes = 0

    def add(self, table: pa.Table) -> Iterator[Trie]:
        self.tables.append(table)
        self.rows += table.num_rows
        self.bytes += table.nbytes
        if self.rows > HELD or self.bytes > 64 * HELD:
            self.merge()
            if 2 * self.rows > HELD or 2 * self.bytes > 64 * HELD:
                yield from self.out()

    def merge(self) -> None:
        whole = added_up(self.tables)
        self.tables, self.rows, self.bytes = [whole], whole.num_rows, whole.nbytes

    def out(self) -> Iterator[Trie]:
        if self.rows:
            self.merge()
            yield Trie.of(self.tables[0])
        self.tables, self.rows, self.bytes = [], 0, 0


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, n, trie) of documents (lang, source, text)."""
    held = Counting()

    def rows(tries: Iterator[Trie]) -> Iterator[pa.RecordBatch]:
        for trie in tries:
            for at in range(0, len(trie.paths), LEAVES):
                part = trie.part(at, min(at + LEAVES, len(trie.paths)))
                yield pa.record_batch([pa.array([part.paths[0].as_py()[:PREFIX]], pa.binary()), pa.array([len(part.leaf)], pa.int64()), pa.array([part.pack()], pa.binary())], names=["low", "n", "trie"])

    for batch in batches:
        at, _ = binary_parts(batch.column(2))
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
            part = batch.slice(first, stop - first)
            yield from rows(held.add(count_terms(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2))))
            first = stop
    yield from rows(held.out())


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, n, sources, sums, trie): merged pieces of tries with the terms of at least `least` documents of a language."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tries = stage_table(docs.select("lang", "source", "text").mapInArrow(lean(counted), "low binary, n long, trie binary"), "tries")
    total = tries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    each = max(1, -(-total // (RANGE * tasks)))
    ranges = each * tasks
    drawn = sorted(bytes(r["low"]) for r in tries.select("low").orderBy(F.xxhash64("low", "n")).limit(50 * ranges).collect())
    cuts = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else set())
    buckets = partition_keys(spark, tasks)
    shared = spark.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            for data in batch.column(0):
                trie = Trie.unpack(data.as_py())
                paths = trie.paths.to_pylist()
                at = 0
                while at < len(paths):
                    nth = bisect.bisect_right(shared.value, paths[at])
                    stop = bisect.bisect_left(paths, shared.value[nth], at) if nth < len(shared.value) else len(paths)
                    yield pa.record_batch([pa.array([buckets[nth % tasks]], pa.int32()), pa.array([nth], pa.int32()), pa.array([trie.part(at, stop).pack()], pa.binary())], names=["bucket", "nth", "trie"])
                    at = stop

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, now = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            trie = Trie.of(added_up(held))
            trie = trie.keep(np.bincount(trie.leaf, trie.docs, len(trie.paths)) >= least)
            langs = [p.rpartition(b"\0")[0] for p in trie.paths.to_pylist()]
            first = 0
            while first < len(langs):
                stop = min(first + LEAVES, len(langs))
                if langs[stop - 1] != langs[first]:
                    stop = next(i for i in range(first, stop) if langs[i] != langs[first])
                part = trie.part(first, stop)
                coded = part.source.dictionary_encode()
                sums = np.zeros(len(coded.dictionary), np.int64)
                np.add.at(sums, np.asarray(coded.indices), part.count)
                yield pa.record_batch(
                    [pa.array([langs[first].decode("utf-8", "surrogateescape")], pa.string()), pa.array([stop - first], pa.int64()), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([part.pack()], pa.binary())],
                    names=["lang", "n", "sources", "sums", "trie"],
                )
                first = stop

        for batch in batches:
            for nth, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if nth != now:
                    yield from out()
                    held, size, now = [], 0, nth
                held.append(Trie.unpack(data.as_py()).rows())
                size += held[-1].num_rows
                if size > 2 * HELD:
                    held = [added_up(held)]
                    size = max(0, held[0].num_rows - HELD)
        yield from out()

    dealt = tries.select("trie").mapInArrow(lean(cut), "bucket int, nth int, trie binary").repartition(tasks, "bucket").sortWithinPartitions("nth")
    made = stage_table(dealt.mapInArrow(lean(merged), "lang string, n long, sources array<string>, sums array<long>, trie binary"), "terms")
    drop_table(tries)
    return made


def share(count: np.ndarray, total: int | np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exactly."""
    if not count.size or int(count.max()) < (1 << 63) // UNIT - 1:
        return 1 + UNIT * (count.astype(np.int64) + 1) // (total + terms)
    return np.asarray(1 + UNIT * (count.astype(object) + 1) // (np.asarray(total, object) + terms), np.int64)


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(counts: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray, n: int, terms: int) -> np.ndarray:
    """Sums over n leaves of the gain of each left source against each right one.

    counts: leaf, left source and count of its counters, then the same of the right ones. left, right: totals of
    the sources. Work follows the counters: leaves that neither of two sources has all give the same.
    """
    leaf, owner, count, other_leaf, other, other_count = counts
    p0, q0 = share(np.zeros(len(left), np.int64), left, terms), share(np.zeros(len(right), np.int64), right, terms)
    q = np.tile(q0, (n, 1))
    q[other_leaf, other] = share(other_count, right[other], terms)
    p = share(count, left[owner], terms)
    has = np.zeros((n, len(left)), bool)
    has[leaf, owner] = True
    there = np.zeros((n, len(right)), bool)
    there[other_leaf, other] = True
    out = gain(p0[:, None], q0[None, :]) * (n - has.sum(0)[:, None] - there.sum(0)[None, :] + has.astype(np.float64).T @ there.astype(np.float64)).astype(np.int64)
    for i in range(len(left)):
        mine = owner == i
        out[i] += gain(p[mine][:, None], q[leaf[mine]]).sum(0)
    for j in range(len(right)):
        at = other_leaf[other == j]
        out[:, j] += np.where(has[at], 0, gain(p0[None, :], q[at, j][:, None])).sum(0)
    return out


def traversed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs and candidates among terms; batches: lang, trie, terms, total, i, left, left_n, j, right, right_n."""
    sums: dict[tuple[str, int, int], list] = {}
    size = 0

    def row(lang: str, part: str, source: list[str], item: list, value: np.ndarray) -> pa.RecordBatch:
        k = len(source)
        return pa.record_batch([pa.array([lang] * k, pa.string()), pa.array(source, pa.string()), pa.array([part] * k, pa.string()), pa.array(item, pa.binary()).cast(pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, _, _), (left, right, found) in sums.items():
            a, b = np.divmod(np.arange(found.size), len(right))
            apart = np.array([left[x] != right[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[apart], b[apart]
            yield row(lang, "pair", [left[x] for x in a.tolist()], [right[y].encode() for y in b.tolist()], found.ravel()[apart])

    for batch in batches:
        for r in batch.to_pylist():
            trie = Trie.unpack(r["trie"])
            names = trie.source.dictionary_encode()
            indices = np.asarray(names.indices)

            def mine(sources: list[str]) -> tuple[np.ndarray, ...]:
                place = {s: k for k, s in enumerate(sources)}
                number = np.array([place.get(s, -1) for s in names.dictionary.to_pylist()], np.int64)[indices]  # noqa: B023
                some = number >= 0
                return trie.leaf[some], number[some], trie.count[some]  # noqa: B023

            a, b = mine(r["left"]), mine(r["right"])
            left, right = np.array(r["left_n"], np.int64), np.array(r["right_n"], np.int64)
            step = max(1, (1 << 21) // (len(left) + len(right)))
            found = np.zeros((len(left), len(right)), np.int64)
            for low in range(0, len(trie.paths), step):
                high = min(low + step, len(trie.paths))
                cut = [np.searchsorted(x[0], [low, high]) for x in (a, b)]
                pieces = [c[u:v] - (low if k == 0 else 0) for x, (u, v) in zip((a, b), cut, strict=True) for k, c in enumerate(x)]
                found += pair_sums(tuple(pieces), left, right, high - low, r["terms"])
            key = (r["lang"], r["i"], r["j"])
            if key not in sums:
                sums[key] = [r["left"], r["right"], np.zeros_like(found)]
                size += found.size
            sums[key][2] += found
            if size > 1 << 20:
                yield from out()
                sums, size = {}, 0
            if r["j"] == 0:
                whole = np.zeros(len(trie.paths), np.int64)
                np.add.at(whole, trie.leaf, trie.count)
                q = share(whole, r["total"], r["terms"])
                p = share(a[2], left[a[1]], r["terms"])
                over = p > q[a[0]]
                leaf, owner = a[0][over], a[1][over]
                value = gain(p[over], q[leaf])
                order = np.lexsort((leaf, -value, owner))
                nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
                order = order[nth < TOP]
                if len(order):
                    head = len(r["lang"].encode("utf-8", "surrogatepass")) + 1
                    yield row(r["lang"], "term", [r["left"][x] for x in owner[order].tolist()], [x[head:] for x in trie.paths.take(pa.array(leaf[order])).to_pylist()], value[order])
    yield from out()


def source_divergence(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others, and by which terms.

    Terms are runs of ASCII letters, A-Z in lower case, and of all other code points from U+0080 on. A language
    keeps those in at least `least` of its documents; with their shares p and q, value is floor((p-q)*(p-q)/q),
    summed over them in part `pair`; part `term` has the TOP first terms that a source has more of than its
    language. All arithmetic is in integers. Null lang, source and text are ''. Each row is a document: repeated
    rows count each. A language with one source has no pairs, a group without terms has pairs alone, an empty
    table gives no rows, and other columns are not read.
    """
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = kept_terms(plain, least)
    sums = terms.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    sizes = terms.groupBy("lang").agg(F.sum("n").alias("terms"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "terms"])
    from pyspark.sql import Window

    numbered = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    numbered = stage_table(numbered.withColumn("total", F.sum("n").over(Window.partitionBy("lang"))), "groups")
    blocks = numbered.filter("terms > 0").groupBy("lang", F.expr(f"at div {BLOCK}").cast("int").alias("i"), "terms", "total").agg(F.sort_array(F.collect_list(F.struct("at", "source", "n"))).alias("x"))
    blocks = stage_table(blocks.select("lang", "i", "terms", "total", F.col("x.source").alias("left"), F.col("x.n").alias("left_n")), "blocks")
    against = blocks.select("lang", F.col("i").alias("j"), F.col("left").alias("right"), F.col("left_n").alias("right_n"))
    rows = terms.select("lang", "trie").join(blocks, "lang").join(against, "lang").select("lang", "trie", "terms", "total", "i", "left", "left_n", "j", "right", "right_n")
    found = stage_table(rows.mapInArrow(lean(traversed), "lang string, source string, part string, item string, value long"), "found")
    none = numbered.filter("terms = 0").select("lang", "source")
    zeros = none.join(none.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(zeros)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
