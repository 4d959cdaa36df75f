"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k takes pieces of capacity//(k+1) < length <=
capacity//k, and a bin of class k is full with exactly k pieces. So bins are filled without looking at
other bins, and each partition packs by itself: no shuffle, state of at most one open bin a class.
As documents may be cut, one whose length would leave much of its slot empty is first cut by exactly
the slot of the next class. Open bins that are left at a partition's end are joined end to end and cut
at the capacity; the very last run is cut at powers of two, where no padding is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomlake.llm.bpe import automaton, read_spec
from loomlake.llm.common import lean

Piece = tuple[int, int]


def harmonic_cuts(total: int, capacity: int, smallest: int, waste: float) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document with total tokens; class 1 pieces of full length fill a bin alone."""
    out = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // max(rest, smallest)
        if (capacity // k - rest) * k <= waste * capacity:
            out.append((rest, k))
            break
        step = capacity // (k + 1)
        if step < smallest or step >= rest:
            out.append((rest, k))
            break
        out.append((step, k + 1))
        rest -= step
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, smallest: int = 16, waste: float = 0.04, end_id: int = 0) -> DataFrame:
    """Pack all documents' tokens, each followed by end_id, into sequences of at most capacity tokens.

    tokenizer: path of a byte-level BPE vocabulary file, broadcast as text of fixed size.
    smallest: no class has slots below this length; shorter ends share the slots of the last class.
    waste: part of a bin that a class may leave empty before a document is cut once more.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is end_id alone. Every row of a repeated doc_id is packed as a document of its own. An empty
    table gives no rows. Other columns are not read. Sequence ids are unique, not gapless.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(spec.value)
        made = TaskContext.get().partitionId() << 32
        bins: dict[int, list] = {}
        rows: list[tuple] = []

        def close(pieces: list) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, made, offset))
                offset += len(ids) // 4
            made += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = auto.encode_packed(text.as_py()) + last
                total, at = len(ids) // 4, 0
                for length, k in harmonic_cuts(total, capacity, smallest, waste):
                    piece = (doc, at, ids[4 * at : 4 * (at + length)], total)
                    at += length
                    held = bins.setdefault(k, [])
                    if length == capacity:
                        close([piece])
                        continue
                    held.append(piece)
                    if len(held) == k:
                        close(bins.pop(k))
                if len(rows) >= 20_000:
                    yield flush()
        rest = [x for k in sorted(bins) for x in bins[k]]
        left = sum(len(x[2]) // 4 for x in rest)
        run_of, room = [], min(capacity, left) if left >= capacity else (1 << left.bit_length() - 1 if left else 0)
        while rest:
            doc, start, ids, total = rest.pop(0)
            n = min(room, len(ids) // 4)
            run_of.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                rest.insert(0, (doc, start + n, ids[4 * n :], total))
            room, left = room - n, left - n
            if not room:
                close(run_of)
                run_of, room = [], capacity if left >= capacity else (1 << left.bit_length() - 1 if left else 0)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(lean(run, "bpe"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
