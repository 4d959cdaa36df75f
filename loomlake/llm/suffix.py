"""Repeated substrings across documents by distributed prefix doubling.

A position's rank at depth k stands for the k bytes from it on. Sorting positions by the pair of ranks
at p and p + k ranks them at depth 2k; positions that have become unique, or whose string no other
document has, drop out, and the threshold ends the rounds. Three sorted rounds do this for a threshold L:

1. whole stretches: content-defined chunks with the L - 1 bytes behind them. A stretch that an earlier
   document has too settles all positions in it at once, so copies cost a row a chunk, not a row a byte;
2. depth (about) L/2, sampled: of each L-byte string its least k-byte substring (by hash) must repeat if
   the string does. Positions whose sampled substring stays within one document are unique and end here;
3. the last doubling, for the positions that are left: pairs of ranks at p and p + L/2.

Ranks are names instead of dense numbers, so that no round needs a global renumbering or sends ranks back
to the texts. Names that decide about bytes have 96 bits from two unlike hashes. Every round is a shuffle:
rows are dealt out by the leading bits of their rank and packed, Spark sorts the packs by those bits within
its partitions, and a worker sorts by the rest, one range of ranks at a time. Of the rows of one rank only
those of its least document are kept back, so a string that very many documents share costs no memory.

Texts are read once into compressed blocks of about half a megabyte. Rows name a block and a place in it,
so ids, repeated rows and other columns of the table never matter to a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import KEPT, byte_table, drop_table, lean, mix, ranges, stage_table

GEAR = byte_table(4, np.uint32)
TABLE = byte_table(5)
BASE = 0xDA942042E4DD58B5
OTHER = 0x8CB92BA72F3D8DD7
CHUNK_BITS = 5
LONGEST = 4095  # window starts that one row may stand for
SLICE = 1 << 19
ROWS = 4096  # most rows of a block
SUB = 16  # most ranges of ranks that Spark sorts apart in a partition
PIECE = 1 << 20  # a longer text is worked on in pieces that overlap
PLACE = 24  # low bits of a rank that tell its position in a block
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + (1 << 18)), np.uint64(base))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * SLICE:
            _POWERS[base] = have
            KEPT["suffix"] = _POWERS.clear
    return have[:n]


class Strings:
    """Hashes of any substrings of several texts that lie one after another."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.data, self.sizes = data, sizes
        self.first = np.cumsum(sizes) - sizes
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * powers(BASE, n), out=self.sums[1:])
        self.undo = powers(pow(BASE, -1, 1 << 64), n + 1)
        self.stop = np.repeat(self.first + sizes, sizes)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.undo[begin] + (end - begin).astype(np.uint64))

    def fixed(self, k: int) -> np.ndarray:
        """The hash of k bytes from each position on, as far as they are there."""
        n = max(0, len(self.data) - k + 1)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.undo[:n])

    def unlike(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """32 bits of another hash of strings of at least 8 bytes; its letters are mixes of 8 bytes, not bytes."""
        n = len(self.data) - 7
        eights = np.ndarray((n,), np.dtype("<u8"), self.data, strides=(1,))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(eights) * powers(OTHER, n), out=sums[1:])
        return (mix((sums[end - 7] - sums[begin]) * powers(pow(OTHER, -1, 1 << 64), n + 1)[begin]) >> np.uint64(32)).astype(np.uint32)

    def chunk_starts(self) -> np.ndarray:
        """First bytes of chunks: those after a gear hash with zero bits on top, and each text's first."""
        h = GEAR[self.data]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        cut = np.zeros(len(h) + 1, bool)
        cut[1:] = h >> np.uint32(32 - CHUNK_BITS) == 0
        cut[self.first] = True
        return np.flatnonzero(cut[: len(h)])


Columns = list[np.ndarray]
SPAN = {"doc": np.int64, "block": np.int64, "at": np.int64}


def packed(cols: Columns) -> bytes:
    """Columns byte plane by byte plane, so that equal high bytes stand together for the shuffle's compression.

    Of 64-bit integers, which mostly rise in the order of the texts, the steps are taken.
    """
    steps = [np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c for c in cols]
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in steps)


def unpacked(data: bytes, n: int, kinds: list[type]) -> Columns:
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        column = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(column) if kind is np.int64 else column)
        at += n * width
    return out


def partition_keys(spark: SparkSession, tasks: int) -> np.ndarray:
    """For each of so many hash partitions a number that goes there."""
    ids, need = F.col("id").cast("int"), 16
    while True:
        rows = spark.range(need * tasks).groupBy(F.pmod(F.hash(ids), F.lit(tasks)).alias("p")).agg(F.min(ids).alias("k")).collect()
        if len(rows) == tasks:
            return np.array([k for _, k in sorted((r["p"], r["k"]) for r in rows)], np.int32)
        need *= 2


def dealt(parts: Iterator[Columns], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Deal rows out by their first key: one row (bucket, sub, n, rows) for what a range of ranks gets of some megabytes of text."""
    held: list[Columns] = []
    size = 0
    subs = max(1, min(SUB, 256 // len(buckets)))
    cells = np.uint64(len(buckets) * subs)

    def out() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cell = ((cols[0] >> np.uint64(32)) * cells >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cols, cell = [c[order] for c in cols], cell[order]
        at = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        pieces = [packed([c[a:b] for c in cols]) for a, b in zip(at[:-1], at[1:], strict=True)]
        some = cell[at[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(buckets[some // subs]), pa.array((some % subs).astype(np.int32)), pa.array(np.diff(at).astype(np.int32)), pa.array(pieces, pa.binary())], names=["bucket", "sub", "n", "rows"])

    for cols in parts:
        if len(cols[0]):
            held.append(cols)
            size += len(cols[0])
            if size > 1 << 18:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class Runs:
    """Rows in groups of equal keys, read in any order; least tells the smallest document of a group so far.

    shared: the rows of all groups with several documents are wanted; else only those that a smaller document
    precedes. What is certain goes out when the rows are sorted; kept back are rows whose document is the
    least of its group so far, so a string that very many documents have takes little memory.
    """

    def __init__(self, keys: int, shared: bool) -> None:
        self.keys, self.shared, self.rows, self.size, self.limit = keys, shared, [], 0, 400_000

    def add(self, cols: Columns) -> Iterator[Columns]:
        self.rows.append([*cols, np.zeros(len(cols[0]), bool)])
        self.size += len(cols[0])
        if self.size > self.limit:
            yield from self.sort()

    def sort(self) -> Iterator[Columns]:
        if not self.size:
            return
        cols = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        order = np.argsort(cols[0], kind="stable") if self.keys == 1 else np.lexsort(cols[: self.keys][::-1])
        cols = [c[order] for c in cols]
        n = len(order)
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols[: self.keys]:
            new[1:] |= c[1:] != c[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        doc, gone = cols[self.keys], cols[-1]
        least = np.minimum.reduceat(doc, at)
        if self.shared:
            # gone marks a row that went out, left behind to tell that its group is shared.
            many = ((least != np.maximum.reduceat(doc, at)) | np.logical_or.reduceat(gone, at))[group]
            go, keep = many & ~gone, ~many | new
            cols[-1] = many
        else:
            go = doc > least[group]
            keep = ~go
        self.rows = [[c[keep] for c in cols]]
        self.size = int(keep.sum())
        self.limit = max(400_000, 2 * self.size)  # so that rows are sorted a few times only
        if go.any():
            yield [c[go] for c in cols[self.keys + 1 : -1]]


def by_block(parts: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at) packed: one row a block for some hundred thousand of them."""
    held: list[Columns] = []
    size = 0

    def out() -> pa.RecordBatch:
        block, at = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        cut = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array([packed([at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["block", "at"])

    for cols in parts:
        held.append(cols)
        size += len(cols[0])
        if size > 1 << 19:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def ranked(parts: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], kinds: list[type], shared: bool) -> DataFrame:
    """One round: make gives columns (keys, doc, block, at) of the texts; rows (block, at) of the groups come out, packed.

    Rows travel packed, some hundreds in one, as Spark spends more on a small row than its sorting takes.
    """
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, buckets = len(kinds), partition_keys(spark, tasks)
    kinds = [*kinds, *SPAN.values()]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        found, now = Runs(keys, shared), None
        for batch in batches:
            for sub, n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if sub != now:
                    yield from found.sort()
                    found, now = Runs(keys, shared), sub
                yield from found.add(unpacked(data.as_py(), n, kinds))
        yield from found.sort()

    rows = parts.mapInArrow(lean(lambda b: dealt(make(b), buckets), "suffix"), "bucket int, sub int, n int, rows binary")
    return rows.repartition(tasks, "bucket").sortWithinPartitions("sub").mapInArrow(lean(lambda b: by_block(groups(b)), "suffix"), "block long, at binary")


def blocks(docs: DataFrame, most: int = SLICE) -> DataFrame:
    """(block, data): the rows of docs in compressed blocks of about `most` bytes of text; a longer text is a block alone."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
            ends, at = np.cumsum(size), 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[at] - size[at] + most, "right"))
                stop = min(max(stop, at + 1), at + ROWS)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])
                made, at = made + 1, stop

    return docs.mapInArrow(lean(run, "suffix"), "block long, data binary")


def unblocked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks with the list of what spans (block, at) has of each."""
    lists = spans.groupBy("block").agg(F.collect_list("at").alias("spans"))
    return texts.join(lists, "block", "left").select("block", "data", "spans")


def listed(spans: list[bytes] | None) -> np.ndarray:
    return np.concatenate([unpacked(x, len(x) // 8, [np.int64])[0] for x in spans]) if spans else np.zeros(0, np.int64)


class Block:
    """One block's texts as bytes, one after another."""

    def __init__(self, block: int, data: bytes, columns: tuple[int, int], spans: list[bytes] | None = None) -> None:
        self.batch, self.block = unblocked(data), block
        ids = self.batch.column(columns[0])
        self.known = np.asarray(pc.is_valid(ids))
        self.ids = np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))
        texts = pc.fill_null(self.batch.column(columns[1]), "")
        self.sizes = np.asarray(pc.binary_length(texts), np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
        self.spans, self.base = listed(spans), 0

    def marked(self, more: int = 0) -> np.ndarray:
        """Which positions the spans have, each of them longer by `more`."""
        begin, n = self.spans >> 12, len(self.data)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, begin, 1)
        np.subtract.at(step, np.minimum(begin + (self.spans & 4095) + more, n), 1)
        return np.cumsum(step, out=step)[:n] > 0

    def pieces(self, length: int, piece: int) -> Iterator[tuple[Block, np.ndarray]]:
        """The block and what its spans mark; one of a long text in pieces that have each window of `length` bytes once."""
        mark = self.marked()
        if len(self.sizes) > 1 or len(self.data) <= 2 * piece:
            yield self, mark
            return
        for at in range(0, len(self.data), piece):
            part = copy(self)
            part.base, part.data = at, self.data[at : at + piece + length - 1]
            part.sizes = np.array([len(part.data)])
            yield part, mark[at : at + piece + length - 1]

    def rows(self, owner: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Columns:
        """doc, block and at: the first of `count` window starts, and 12 bits for how many they are."""
        return [self.ids[owner], np.full(len(owner), self.block), begin + self.base << 12 | count]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first + self.sizes, at, "right")


def each_block(batches: Iterator[pa.RecordBatch], columns: tuple[int, int]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), columns, batch.column(2)[i].as_py() if batch.num_columns > 2 else None)


def each_piece(batches: Iterator[pa.RecordBatch], columns: tuple[int, int], length: int, piece: int) -> Iterator[tuple[Block, np.ndarray]]:
    for b in each_block(batches, columns):
        yield from b.pieces(length, piece)


def stretched(rank: np.ndarray, live: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of live neighbours of equal rank within one text, at most LONGEST in each: where they start and how many they are.

    first: where texts start; at: the neighbours' places, where they aren't one after another.
    """
    n = len(rank)
    new = np.r_[True, rank[1:] != rank[:-1]] | ~live if n else np.zeros(0, bool)
    new[1:] |= ~live[:-1]
    new[first[first < n]] = True
    if at is not None:
        new[1:] |= np.diff(at) != 1
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    some = live[start]
    start, size = start[some], size[some]
    parts = -(-size // LONGEST)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + LONGEST * nth
    return begin, np.minimum(np.repeat(start + size, parts) - begin, LONGEST)


def chiefs(name: np.ndarray, window: int) -> np.ndarray:
    """For each `window` names from a position on, the position of the least one, by its upper bits; of equal ones the first.

    Positions are packed below the names, counted within blocks that overlap, so that a text of any size has room.
    """
    n, place = len(name) - window + 1, np.uint64(PLACE)
    block = (1 << PLACE) - window + 1
    if block < 1:
        raise ValueError("length is too large")
    out = np.empty(n, np.int64)
    for at in range(0, n, block):
        part = name[at : at + block + window - 1]
        low = (part >> place << place) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while 2 * reach <= window:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < window:
            low = np.minimum(low[: len(low) - (window - reach)], low[window - reach :])
        out[at : at + block] = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64) + at
    return out


def repeated_windows(texts: DataFrame, columns: tuple[int, int], length: int = 50, piece: int = PIECE) -> DataFrame:
    """(block, at): ranges of starts, as Block.rows packs them, of `length`-byte strings that a document with a smaller id has too.

    texts: blocks. columns: where doc_id and text stand in them; rows without an id take no part.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    depth = (length + 1) // 2
    window = length - depth + 1

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for b, _ in each_piece(batches, columns, length, piece):
            if len(b.data) < length:
                continue
            s = Strings(b.data, b.sizes)
            begin = s.chunk_starts()
            owner = b.owner(begin)
            limit = (b.first + b.sizes)[owner]
            after = np.minimum(np.r_[begin[1:], len(b.data)], limit)
            stop = np.minimum(after, limit - length + 1)
            some = (stop > begin) & b.known[owner]
            begin, after, stop, owner, limit = begin[some], after[some], stop[some], owner[some], limit[some]
            if len(begin) and (stop - begin).max() > LONGEST:
                parts = -(-(stop - begin) // LONGEST)
                back = np.repeat(np.arange(len(begin)), parts)
                nth = np.arange(len(back)) - np.repeat(np.cumsum(parts) - parts, parts)
                owner, limit, last, end = owner[back], limit[back], stop[back], after[back]
                begin = begin[back] + LONGEST * nth
                stop, after = np.minimum(begin + LONGEST, last), np.minimum(begin + LONGEST, end)
            end = np.minimum(after + length - 1, limit)
            yield [s.hash(begin, end), s.unlike(begin, end), *b.rows(owner, begin, stop - begin)]

    whole = stage_table(ranked(texts, stretches, [np.uint64, np.uint32], False), "stretches")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for b, settled in each_piece(batches, columns, length, piece):
            n = len(b.data) - length + 1
            if n <= 0:
                continue
            s = Strings(b.data, b.sizes)
            name = s.fixed(depth)
            chief = chiefs(name, window)
            live = (s.stop[:n] - np.arange(n) >= length) & np.repeat(b.known, b.sizes)[:n] & ~settled[:n]
            # 48 bits of a name do, as the next round tells apart what they confuse.
            rank = mix(name[chief]) & ~np.uint64(0xFFFF)
            at, count = stretched(rank, live, b.first)
            yield [rank[at], *b.rows(b.owner(at), at, count)]

    left = stage_table(ranked(with_spans(texts, whole), sampled, [np.uint64], True), "samples")

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for b, wanted in each_piece(batches, columns, length, piece):
            at = np.flatnonzero(wanted[: max(0, len(b.data) - length + 1)])
            if not len(at):
                continue
            s = Strings(b.data, b.sizes)
            name = s.fixed(depth)
            pair = mix(name[at] + mix(name[at + length - depth]))
            # A window that equals the one a byte before it, in text of one letter, joins its row.
            first, count = stretched(pair, np.ones(len(at), bool), np.searchsorted(at, b.first), at)
            yield [pair[first], s.unlike(at[first], at[first] + length), *b.rows(b.owner(at[first]), at[first], count)]

    pairs = stage_table(ranked(with_spans(texts, left).filter("spans is not null"), doubled, [np.uint64, np.uint32], False), "pairs")
    drop_table(left)
    return whole.unionByName(pairs)


def dedup_report(docs: DataFrame, *, length: int = 50, size: int = SLICE, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, its text taken as UTF-8 bytes.

    A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller
    doc_id. Texts are judged as they are read, not by what is left of them. A null text is empty.
    Rows with one doc_id don't count against each other; rows with a null doc_id keep everything.
    An empty table gives no rows; other columns are not read. size: bytes of text in a block; piece: how
    many bytes of a longer text are worked on at once.
    """
    texts = stage_table(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size), "blocks")
    spans = repeated_windows(texts, (0, 1), length, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches, (0, 1)):
            gone = b.marked(length - 1)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[b.first[b.sizes > 0]] = gone[b.first[b.sizes > 0]]
            removed, runs = np.zeros((2, len(gone) + 1), np.int32)
            np.cumsum(gone, out=removed[1:])
            np.cumsum(first, out=runs[1:])
            kept = b.data[~gone].tobytes()
            stop = b.first + b.sizes
            cut = np.r_[b.first, len(b.data)] - removed[np.r_[b.first, len(b.data)]]
            sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.batch.column(0), pa.array(b.sizes), pa.array((removed[stop] - removed[b.first]).astype(np.int64)), pa.array((runs[stop] - runs[b.first]).astype(np.int64)), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return with_spans(texts, spans).mapInArrow(lean(run, "suffix"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """docs with the repeated bytes of their texts removed, as far as they are whole code points.

    All columns stay, whatever their names; n_chars, where there is one, is counted anew. Null texts stay
    null. Rows with one doc_id don't count against each other; rows with a null doc_id stay as they are.
    An empty table gives no rows.
    """
    names = docs.columns
    columns = (names.index("doc_id"), names.index("text"))
    count = names.index("n_chars") if "n_chars" in names else None
    texts = stage_table(blocks(docs), "blocks")
    spans = repeated_windows(texts, columns, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches, columns):
            if not len(b.spans):
                yield b.batch
                continue
            gone = b.marked(length - 1)
            # A code point goes if all its bytes go.
            lead = b.data & 0xC0 != 0x80
            lead[b.first[b.sizes > 0]] = True
            points = np.flatnonzero(lead)
            gone = np.repeat(np.logical_and.reduceat(gone, points), np.diff(np.r_[points, len(gone)]))
            kept, places = b.data[~gone].tobytes(), np.r_[b.first, len(b.data)]
            cut = (places - np.concatenate([[0], np.cumsum(gone)])[places]).tolist()
            some = np.asarray(pc.is_valid(b.batch.column(columns[1]))).tolist()
            cols = list(b.batch.columns)
            left = [kept[x:y] if yes else None for x, y, yes in zip(cut[:-1], cut[1:], some, strict=True)]
            cols[columns[1]] = pa.array(left, pa.binary()).cast(b.batch.schema.field(columns[1]).type, safe=False)
            if count is not None:
                chars = np.diff(np.concatenate([[0], np.cumsum(lead & ~gone)])[places])
                cols[count] = pa.array(chars, mask=~np.array(some, bool)).cast(cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.batch.schema)

    return with_spans(texts, spans).mapInArrow(lean(run, "suffix"), docs.schema)
