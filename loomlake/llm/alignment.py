"""Alignment of two tokenizers by union-find over their overlapping tokens.

Tokens of both sides that share a byte are linked. The links of a text are a bipartite graph, and its
connected components are the least groups of tokens that begin and end together on both sides. Union-find
over the links gives the components; the members of each, in order, expand its links again, and how often
two ids are linked is counted over the whole corpus.

No token of either side crosses a place where white space follows something else. So texts are cut there
into segments, and components are found once for a segment that a task meets often. Texts stand in blocks of
some megabytes. A block asks for the corpus-wide counts of the distinct pairs it has, so a pair that every
text has is one row a block, and no text, link or count goes through the driver. Of each text a list of its
pairs stays with its block.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.bpe import printable_bytes, read_spec
from loomlake.llm.common import KEPT, drop_table, lean, ranges, stage_table

MARK = "▁"
#: A segment begins with white space that comes behind something else: space, tab and line feed, which both sides know as such.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*)?|\s+").findall
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
BLOCK = 1 << 21  # code points of text that share a block
CACHE = 96 << 20  # bytes of segments that a worker keeps from block to block


class LeftTokens:
    """Byte-level BPE of a space and the text, special strings taken as plain text."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_padding()
        self.model.no_truncation()
        self.model.encode_special_tokens = True
        byte_of = printable_bytes()
        vocab = {t: i for t, i in self.model.get_vocab(with_added_tokens=False).items() if set(t) <= byte_of.keys()}
        self.sizes = np.zeros(self.model.get_vocab_size() + 1, np.int64)
        self.sizes[list(vocab.values())] = list(map(len, vocab))

    def encode(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment. The byte-level alphabet spells any text."""
        out = []
        for at in range(0, len(segments), 5000):
            part = segments[at : at + 5000]
            out += [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(part, add_special_tokens=False)]
        return out


class RightTokens:
    """Pieces of a text behind the space that the model adds, for models whose pieces have white space only at their beginning."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(r"\S[ \t]", p.replace(MARK, " ")) or "\n" in p for p in pieces):
            raise ValueError("a piece has white space behind other characters, or a line feed")
        code = [BYTE.fullmatch(p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.labels = [bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for m, p in zip(code, pieces, strict=True)]
        self.sizes = np.array([len(x) for x in self.labels], np.int64)

    def encode(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment; none where they don't spell it."""
        out = []
        # No piece has a line feed, so what the model adds and the line feed are two tokens that nothing merges with.
        for s, ids in zip(segments, self.model.encode(["\n" + s for s in segments], num_threads=1) if segments else [], strict=True):
            ids = ids[2:]
            right = MARK not in s and b"".join(map(self.labels.__getitem__, ids)) == s.encode("utf-8", "surrogatepass")
            out.append(array("I", ids).tobytes() if right else b"")
        return out


_BUILT: dict[int, "Aligner"] = {}


def aligner(spec: str, model: bytes) -> Aligner:
    """Made once a process for each pair of tokenizers."""
    key = hash((spec, model))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Aligner(spec, model)
    KEPT["alignment"] = _BUILT.clear
    return _BUILT[key]


def linked(left_ends: np.ndarray, right_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the left and right tokens of each overlap, by their ends in the same bytes.

    Ends of either side cut the bytes into parts; a part lies in one token of each side, and each
    overlapping pair has exactly one part.
    """
    side = np.zeros(int(left_ends[-1]) + 1 if len(left_ends) else 0, np.uint8)
    side[left_ends] = 1
    side[right_ends] += 2
    side = side[side > 0]
    ends = side & 1, side >> 1
    return tuple(np.cumsum(e, dtype=np.int64) - e for e in ends)


def components(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each link of left and right tokens the least link of its connected component, by union-find.

    Nodes are numbered by the link in which they come first. Links unite the higher of two roots with the lower,
    then all paths are compressed by pointer jumping, until no link joins two trees.
    """
    n = len(left)
    if not n:
        return np.zeros(0, np.int64)
    number = np.arange(n)
    u = 2 * np.maximum.accumulate(np.where(np.r_[True, left[1:] != left[:-1]], number, 0))
    v = 2 * np.maximum.accumulate(np.where(np.r_[True, right[1:] != right[:-1]], number, 0)) + 1
    parent = np.arange(2 * n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return a // 2
        parent[np.maximum(a, b)[apart]] = np.minimum(a, b)[apart]
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def id_texts(n: int, between: bytes, last: bytes) -> np.ndarray:
    """Decimal ids with what follows them, padded with zero bytes: first those inside a group, then those at its end."""
    wide = max(2, len(str(n)) + 1)
    return np.array([str(i).encode() + x for x in (between, last) for i in range(n)], f"S{wide}").view(np.uint8).reshape(2 * n, wide)


def grouped(a: np.ndarray, b: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of the tokens a and b, which spell the same bytes, and the number of the group of each token of either side."""
    left, right = linked(*(np.cumsum(sizes[ids]) for sizes, ids in zip(sides, (a, b), strict=True)))
    root = components(left, right)
    group = np.cumsum(np.r_[True, root[1:] != root[:-1]]) - 1 if len(root) else root
    first = [np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool) for x in (left, right)]
    return left, right, group[first[0]], group[first[1]]


class Aligner:
    """What is known of segments, by number: tokens, groups and links, their pairs of ids, and the text of their groups."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.left, self.right = LeftTokens(spec), RightTokens(model)
        self.base = len(self.right.sizes)
        self.spelling = id_texts(len(self.left.sizes), b",", b"|"), id_texts(self.base, b",", b";")
        self.forget(0)

    def forget(self, keep: int) -> None:
        """All but the first segments."""
        self.place = dict(list(self.place.items())[:keep]) if keep else {}
        self.texts: list[bytes] = self.texts[:keep] if keep else []
        self.sizes = self.sizes[:keep].copy() if keep else np.zeros((0, 4), np.int64)
        self.first = self.first[: keep + 1].copy() if keep else np.zeros(1, np.int64)
        self.pairs = self.pairs[: self.first[-1]].copy() if keep else np.zeros(0, np.int64)
        self.held = sum(map(len, self.place)) + sum(map(len, self.texts)) + 300 * keep

    def learn(self, new: list[str]) -> None:
        """Segments that weren't known; those that a side doesn't spell have no tokens."""
        if self.held > CACHE:
            raise ValueError("forget before learning")
        ids = [self.left.encode(new), self.right.encode(new)]
        ids[0] = [x if y else b"" for x, y in zip(*ids, strict=True)]
        have = [np.array([len(x) // 4 for x in side], np.int64) for side in ids]
        a, b = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in ids)
        left, right, of_left, of_right = grouped(a, b, (self.left.sizes, self.right.sizes))
        last = [np.cumsum(n) - 1 for n in have]
        some = have[0] > 0
        # Groups and links end with each segment.
        groups, links = np.zeros(len(new) + 1, np.int64), np.zeros(len(new) + 1, np.int64)
        groups[1:] = np.where(some, of_left[last[0]] + 1, 0) if len(a) else 0
        links[1:] = np.where(some, np.searchsorted(left, last[0], "right"), 0) if len(a) else 0
        groups, links = np.maximum.accumulate(groups), np.maximum.accumulate(links)
        self.sizes = np.concatenate([self.sizes, np.stack([*have, np.diff(groups), np.diff(links)], 1)])
        self.pairs = np.concatenate([self.pairs, a[left] * self.base + b[right]])
        self.first = np.concatenate([self.first, self.first[-1] + links[1:]])
        said, ends = self.spelt(a, b, of_left, of_right)
        cut = np.r_[0, ends][np.cumsum(have[0] + have[1])].tolist()
        texts = [said[x:y] for x, y in zip([0, *cut], cut, strict=False)]
        self.place.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        self.held += sum(map(len, new)) + len(said) + 300 * len(new)

    def spelt(self, a: np.ndarray, b: np.ndarray, of_left: np.ndarray, of_right: np.ndarray) -> tuple[bytes, np.ndarray]:
        """a1,a2|b1;a3|b2,b3; with the ids of each group, and where the text of each token ends."""
        n = int(of_left[-1]) + 1 if len(of_left) else 0
        wide = max(x.shape[1] for x in self.spelling)
        out = np.zeros((len(a) + len(b), wide), np.uint8)
        have = [np.bincount(x, minlength=n) for x in (of_left, of_right)]
        before = [np.cumsum(have[1]) - have[1], np.cumsum(have[0])]
        for ids, of, k, ahead, spelling in zip((a, b), (of_left, of_right), have, before, self.spelling, strict=True):
            code = ids.copy()
            code[np.cumsum(k) - 1] += len(spelling) // 2
            out[np.arange(len(ids)) + ahead[of], : spelling.shape[1]] = spelling[code]
        return out.tobytes().translate(None, b"\0"), np.cumsum((out != 0).sum(1))

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text n_a, n_b, n_groups, n_links, the groups' digest, then its distinct pairs of ids and how often each is linked."""
        if self.held > CACHE:
            self.forget(len(self.place) // 4)
            if 2 * self.held > CACHE:  # few segments that are very long
                self.forget(0)
        split = [SEGMENT(" " + t) if t else [] for t in texts]
        self.learn(list({s for segments in split for s in segments if s not in self.place}))
        links = np.diff(self.first)
        for segments in split:
            at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
            sizes = self.sizes[at]
            if not len(at) or not sizes[:, 0].all():
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            said = b"".join(map(self.texts.__getitem__, at.tolist()))
            keys, counts = np.unique(self.pairs[ranges(self.first[at], links[at])], return_counts=True)
            yield (*sizes.sum(0).tolist(), hashlib.sha256(said[:-1]).hexdigest(), keys, counts)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<i8").ravel()


REPORT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "n_pairs": pa.int64()}


def align_tokens(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    left: path of a byte-level BPE file, for a space and the text; right: path of a sentencepiece model, which adds
    that space itself. The tokens' overlaps in bytes are links; the count of a pair of ids is how many links of the
    corpus have it. n_best: links whose count no other pair with that right id exceeds; count_sum: counts over links.
    Texts that are null, empty or not spelt exactly by both sides have no tokens: zeros and an empty digest. Repeated
    rows and null ids give a row each and count each; an empty table gives no rows; other columns are not read.
    """
    with open(right, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((read_spec(left), f.read()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = aligner(*shared.value), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, str | None]] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = list(known.align([t for _, t in held]))
            columns = [[d for d, _ in held], *(list(c) for c in zip(*(x[:5] for x in found), strict=True)), [len(x[5]) for x in found]]
            table = pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, REPORT.values(), strict=True)], names=list(REPORT))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(table)
            counts = np.concatenate([x[6] for x in found])
            keys, place = np.unique(np.concatenate([x[5] for x in found]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, counts)
            return pa.record_batch(
                [pa.array([made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([squeezed(np.diff(place, prepend=0))], pa.binary()), pa.array([squeezed(counts)], pa.binary())]
                + [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(x)) for x in (keys, total)],
                names=["block", "rows", "place", "times", "pairs", "n"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, text.as_py()))
                size += len(held[-1][1] or "") + 100
                if size > BLOCK:
                    yield out()
                    held, size, made = [], 0, made + 1
        if held:
            yield out()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stage_table(plain.mapInArrow(lean(blocks, "alignment"), "block long, rows binary, place binary, times binary, pairs array<long>, n array<long>"), "alignment")
    width = F.lit(len(RightTokens(shared.value[1]).sizes))
    asked = made.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    counts = stage_table(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    # One row for each id of the right side, whose number the model's file bounds.
    most = F.broadcast(counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most")))
    known = counts.join(most, F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = asked.select("block", "at", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    told = stage_table(told.select("block", F.col("told.at").alias("at"), F.col("told.count").alias("count"), F.col("told.best").alias("best")), "pairs_told")
    drop_table(counts)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = pa.ipc.open_stream(batch.column(0)[k].as_py()).read_next_batch()
                per = np.asarray(table.column(6))
                links = int(per.sum())
                place, times = np.cumsum(unsqueezed(batch.column(1)[k].as_py(), links)), unsqueezed(batch.column(2)[k].as_py(), links)
                best = total = np.zeros(len(per), np.int64)
                if links:
                    at = np.asarray(batch.column(3)[k].values)
                    count, good = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    count[at], good[at] = np.asarray(batch.column(4)[k].values), np.asarray(batch.column(5)[k].values).astype(np.int64)
                    sums = [np.r_[0, np.cumsum(times * x[place])] for x in (good, count)]
                    ends = np.cumsum(per)
                    best, total = (s[ends] - s[ends - per] for s in sums)
                yield pa.record_batch([*table.columns[:5], pa.array(best), pa.array(total), table.column(5)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = made.select("block", "rows", "place", "times").join(told, "block", "left").select("rows", "place", "times", "at", "count", "best")
    return rows.mapInArrow(lean(report), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
