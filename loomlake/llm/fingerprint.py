"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes proposes chunk boundaries; normalised chunking asks for more zero bits
before the normal size and for fewer after it, so that sizes gather near the normal one. Boundaries
depend on nearby bytes only: an insertion changes the chunks around it and no others. The fingerprint is
the set of chunk digests with their lengths; what one fingerprint has of another, weighted by length, is
the containment of the first text in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import byte_table, lean, mix, padded
from loomlake.llm.native import longs, range_of

LEAST, NORMAL, MOST = 12, 32, 192
STRICT_BITS, LOOSE_BITS = 7, 4
PAD = 32
GEAR = byte_table(1, np.uint32)
WORDS = byte_table(2)
BASE = 0x9E3779B97F4A7C15


def cuts(strict: list[int], loose: list[int], length: int) -> list[int]:
    """Ends of the chunks of one text; the candidates are positions after which a text may be cut."""
    out, at, i, j, ns, nl = [], 0, 0, 0, len(strict), len(loose)
    while length - at > LEAST:
        low, mid, top = at + LEAST, at + NORMAL, min(at + MOST, length)
        while i < ns and strict[i] < low:
            i += 1
        if i < ns and strict[i] < mid:
            end = strict[i]
        else:
            while j < nl and loose[j] < mid:
                j += 1
            end = loose[j] if j < nl and loose[j] < top else top
        if end >= length:
            break
        out.append(end)
        at = end
    if length > at:
        out.append(length)
    return out


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunks as 64-bit numbers: a 48-bit digest, then 16 bits of length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    data, first = padded(np.frombuffer(b"".join(texts), np.uint8), starts, starts + lengths, PAD)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    hashed = GEAR[data]
    hashed[data == 0] = 0  # pads, and so NUL bytes, add nothing
    for step in (1, 2, 4, 8, 16):
        hashed[step:] = hashed[step:] + (hashed[:-step] << np.uint32(step))
    loose_at = np.flatnonzero(hashed >> np.uint32(32 - LOOSE_BITS) == 0)
    strict_at = loose_at[hashed[loose_at] >> np.uint32(32 - STRICT_BITS) == 0]
    del hashed
    power = np.full(len(data) + 1, np.uint64(BASE))
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(WORDS[data] * power[:-1], out=sums[1:])
    ends: list[int] = []
    owner: list[int] = []
    begins: list[int] = []
    bounds = [np.searchsorted(a, [first, first + lengths]) for a in (strict_at, loose_at)]
    for d, (f, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
        (a, b), (p, q) = bounds[0][:, d], bounds[1][:, d]
        found = cuts((strict_at[a:b] - f + 1).tolist(), (loose_at[p:q] - f + 1).tolist(), n)
        ends += [f + x for x in found]
        begins += [f, *(f + x for x in found[:-1])] if found else []
        owner += [d] * len(found)
    s, e, own = np.array(begins, np.int64), np.array(ends, np.int64), np.array(owner, np.int64)
    if not len(s):
        return [np.zeros(0, np.uint64) for _ in texts]
    back = np.uint64(pow(BASE, -1, 1 << 64))
    undo = np.full(len(data) + 1, back)
    undo[0] = 1
    np.cumprod(undo, out=undo)
    size = (e - s).astype(np.uint64)
    digest = mix((sums[e] - sums[s]) * undo[s] + size * np.uint64(0xD6E8FEB86659FD93))
    value = digest >> np.uint64(16) << np.uint64(16) | size
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[fresh], own[fresh]
    at = np.searchsorted(own, np.arange(len(texts) + 1))
    return [value[at[d] : at[d + 1]] for d in range(len(texts))]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The length-weighted part of a's chunks that b has; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.uint64(0xFFFF)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    return float((a[both] & low).sum()) / float((a & low).sum())


def spelled(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every whole text; null is as empty, whose fingerprint is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([spelled(x) for x in chunk_sets(texts)], pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(lean(run), f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """Rows (block, tail, doc_id, text), so that each block sorted by the last three has every row's successor.

    Blocks are ranges of doc_id between quantiles. The first row of a block also ends the block before it
    (tail 1), and the very first row the last block. Only quantiles and one doc_id a block reach the driver.
    """
    at = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx("doc_id", at, 20 * max(blocks, 500)).alias("q")).first()["q"] if at else []
    splitters = sorted(set(found or []))
    rows = docs.select("doc_id", "text").withColumn("block", F.coalesce(range_of(F.col("doc_id"), splitters), F.lit(0)))
    heads = {r["block"]: r["head"] for r in rows.groupBy("block").agg(F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    n = (order[-1] + 1) if order else 1
    head = F.get(longs([heads.get(b, 0) for b in range(n)]), F.col("block"))
    prior = F.get(longs([before.get(b, 0) for b in range(n)]), F.col("block")).cast("int")
    first = F.when(F.col("doc_id") == head, F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("tail")), F.struct(prior.alias("b"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("tail"))))
    return rows.select("doc_id", "text", F.explode(first).alias("x")).select(F.col("x.b").alias("block"), "x.tail", "doc_id", "text"), len(order)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, the text with its last quarter taken from the next document, and compare.

    Next is by ascending (doc_id, text), after the last the first; a single document follows itself.
    Null texts are empty; rows with a null doc_id are left out, as they have no place in the order.
    Repeated rows each give a row. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, n = with_next(docs.select("doc_id", "text").filter("doc_id is not null"), 4 * parts)
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "tail", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(own: list[tuple]) -> Iterator[pa.RecordBatch]:
        """own: successive rows (block, tail, doc_id, text); the last one only follows."""
        pairs = [i for i in range(len(own) - 1) if own[i][1] == 0]
        if not pairs:
            return
        texts = [x[3] or "" for x in own]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in ((texts[i], texts[i + 1]) for i in pairs)]
        blobs = [t.encode("utf-8", "surrogatepass") for t in edited]
        prints = chunk_sets([t.encode("utf-8", "surrogatepass") for t in texts] + blobs)
        first, later = prints[: len(texts)], prints[len(texts) :]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([own[i][2] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()),
                pa.array([spelled(first[i]) for i in pairs], pa.string()), pa.array([spelled(x) for x in later], pa.string()),
                pa.array([containment(first[i], x) for i, x in zip(pairs, later, strict=True)], pa.float64()), pa.array([containment(first[i], first[i + 1]) for i in pairs], pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3] or "")
                if size > 1 << 20 or len(held) > 1000:
                    yield from made(held)
                    held, size = held[-1:], 0
        yield from made(held)

    return rows.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
