"""Document scoring with a hidden Markov language model.

Symbols are the most frequent words, the end of a text, and classes of the other words by their last
bytes. Hidden states are trained by Baum-Welch: each partition adds up its expected counts, Spark sums
them by symbol, and the next round starts from the sums. A word that shares its symbol has the same
probability within it in every state, so the likelihood of a text is the scaled forward recursion over
its symbols, from start to end, times those shares. Within a class a seen word has its discounted share, and
what is left is divided evenly between as many unseen words as the class has seen ones, and one more.

All counts are over the whole corpus. What reaches the driver is bounded by `words`, `classes` and
`states`; counts of the rarer words stay in Spark and meet their texts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import crc_text, lean, mix, stage_table

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = b""
RUN = 256
SLICE = 2_000_000  # tokens that are scored at once
SCALED = 4  # forward states are scaled at each fourth token: four emissions are far from underflow
DISCOUNT = 0.75
LEAST = 4  # rarer words have no symbol of their own


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(texts: DataFrame, classes: int) -> DataFrame:
    """(word, class, c) over all rows of texts; the end of each text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([class_of(w, classes) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "class", "c"])
            seen.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py()))
                seen[END] += 1
                if len(seen) > 120_000:
                    yield out()
        yield out()

    parts = texts.select("text").mapInArrow(lean(run), "word binary, class int, c long")
    return parts.groupBy("word", "class").agg(F.sum("c").alias("c"))


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """start: states; move: states x states; emit: symbols x states."""
        self.start, self.move, self.emit = start, move, emit

    def forward(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence; symbols holds them one after another."""
        order = np.argsort(-lengths, kind="stable")
        at = (np.cumsum(lengths) - lengths)[order]
        out = np.zeros(len(lengths))
        top = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(top), "left").tolist()
        state = np.repeat(self.start[None, :], alive[0] if top else 0, axis=0)
        for t, live in enumerate(alive):
            if live < len(state):
                out[order[live : len(state)]] += np.log10(state[live:].sum(axis=1))
                state, at = state[:live], at[:live]
            state = (state @ self.move if t else state) * self.emit[symbols[at[:live]]]
            at += 1
            if t % SCALED == SCALED - 1:
                scale = state.sum(axis=1)
                state /= scale[:, None]
                out[order[:live]] += np.log10(scale)
        out[order[: len(state)]] += np.log10(state.sum(axis=1))
        return out

    def bounds(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, nth: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run the state it starts from, the forward state at its end (but for last runs) and the backward state there.

        The product of a run's steps is a matrix; with these, states are carried from run to run of a text both ways.
        """
        k, runs = len(self.start), len(nth)
        enter, ends, leave = np.repeat(self.start[None, :], runs, axis=0), np.zeros((runs, k)), np.ones((runs, k))
        many = np.flatnonzero(pieces > 1)
        if not len(many):
            return enter, ends, leave
        many = many[np.argsort(-size[many], kind="stable")]
        # States first, runs last, so that all runs are stepped at once.
        emit, move = np.ascontiguousarray((self.emit / self.emit.max(axis=1, keepdims=True)).T, np.float32), np.ascontiguousarray(self.move.T, np.float32)
        whole = np.zeros((len(many), k, k), np.float32)
        where = np.zeros(runs, np.int64)
        where[many] = np.arange(len(many))
        for at in range(0, len(many), 512):
            some = many[at : at + 512]
            falling, begin = -size[some], first[some]
            m = np.eye(k, dtype=np.float32)[:, :, None] * emit[:, symbols[begin]][None]
            for t in range(1, int(size[some[0]])):
                n = int(np.searchsorted(falling, -t, "left"))
                if n < m.shape[2]:
                    whole[at + n : at + m.shape[2]] = m[:, :, n:].transpose(2, 0, 1)
                    m = m[:, :, :n]
                m = np.matmul(move, m)
                m *= emit[:, symbols[begin[:n] + t]]
                if t % 4 == 0:
                    m /= m.max(axis=(0, 1))
            whole[at : at + m.shape[2]] = m.transpose(2, 0, 1)
        whole /= whole.max(axis=(1, 2))[:, None, None]
        after = many[nth[many] > 0]
        after = after[np.argsort(nth[after], kind="stable")]
        waves = np.split(after, np.flatnonzero(np.diff(nth[after])) + 1)
        for r in waves:
            v = np.einsum("ni,nij->nj", enter[r - 1], whole[where[r - 1]])
            ends[r - 1] = v = v / v.sum(axis=1, keepdims=True)
            enter[r] = v @ self.move
        for r in reversed(waves):
            v = np.einsum("nij,nj->ni", whole[where[r]], leave[r]) @ self.move.T
            leave[r - 1] = v / v.max(axis=1, keepdims=True)
        return enter, ends, leave

    def expect(self, symbols: np.ndarray, lengths: np.ndarray, counts: Counts) -> None:
        """Add the expected counts of these sequences. They are taken in runs of RUN tokens, with exact states at their bounds."""
        k = len(self.start)
        emit = np.vstack([self.emit, np.ones((1, k))]).astype(np.float32)
        pad, move = len(self.emit), self.move.astype(np.float32)
        begin = np.cumsum(lengths) - lengths
        pieces = -(-lengths // RUN)
        of = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = begin[of] + nth * RUN, np.minimum(RUN, lengths[of] - nth * RUN)
        enter, ends, leave = self.bounds(symbols, first, size, nth, pieces[of])
        order = np.argsort(-size, kind="stable")
        padded = np.append(symbols.astype(np.int64), pad)
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            n, top = len(some), int(size[some[0]])
            steps = np.arange(top)[:, None]
            live = steps < size[some][None, :]
            sym = padded[np.where(live, first[some][None, :] + steps, len(symbols))]
            e = emit[sym]
            alpha = np.empty((top, n, k), np.float32)
            scale = np.empty((top, n), np.float32)
            a = enter[some].astype(np.float32)
            for t in range(top):
                a = (a @ move if t else a) * e[t]
                scale[t] = s = a.sum(axis=1)
                a = a / s[:, None]
                alpha[t] = a
            beta = leave[some].astype(np.float32)
            beta /= (alpha[top - 1] * beta).sum(axis=1)[:, None]
            gamma = np.empty_like(alpha)
            gamma[top - 1] = alpha[top - 1] * beta
            for t in range(top - 2, -1, -1):
                e[t + 1] *= beta
                e[t + 1] /= scale[t + 1][:, None]
                beta = e[t + 1] @ move.T
                gamma[t] = alpha[t] * beta
            if top > 1:
                on = live[1:, :, None]
                counts.move += self.move * ((alpha[:-1] * on).reshape(-1, k).T @ e[1:].reshape(-1, k))
            later = nth[some] > 0
            if later.any():
                counts.move += self.move * (ends[some[later] - 1].T @ (gamma[0][later] / enter[some[later]]))
            counts.start += gamma[0][~later].sum(axis=0)
            flat, sizes = sym.ravel(), pad + 1
            for i in range(k):
                counts.emit[:, i] += np.bincount(flat, gamma[:, :, i].ravel(), sizes)[:pad]


class Counts:
    def __init__(self, symbols: int, states: int) -> None:
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def model(self, share: np.ndarray, weight: float = 50.0) -> Hmm:
        """Counts as probabilities; emissions are smoothed towards each symbol's share of all tokens."""
        k = len(self.start)
        start = (self.start + 1) / (self.start.sum() + k)
        move = (self.move + 1 + 10 * np.eye(k)) / (self.move.sum(axis=1, keepdims=True) + k + 10)
        emit = (self.emit + weight * share[:, None]) / (self.emit.sum(axis=0)[None, :] + weight)
        return Hmm(start, move, emit)


def first_model(symbols: np.ndarray, lengths: np.ndarray, share: np.ndarray, states: int, rounds: int) -> Hmm:
    """A starting point from a bounded sample: random sequences seed the states, then a few rounds of Baum-Welch."""
    rng = np.random.default_rng(5)
    counts = Counts(len(share), states)
    begin = np.cumsum(lengths) - lengths
    for d, k in zip(rng.permutation(len(lengths)), np.arange(len(lengths)) % states, strict=True):
        if d < 4 * states or lengths[d] > 100:
            counts.emit[:, k] += np.bincount(symbols[begin[d] : begin[d] + lengths[d]], minlength=len(share)) * rng.exponential(1.0)
    counts.move += np.eye(states) * 50
    model = counts.model(share)
    for _ in range(rounds):
        counts = Counts(len(share), states)
        model.expect(symbols, lengths, counts)
        model = counts.model(share)
    return model


def encode(docs: DataFrame, top: dict[bytes, int], logs: list[float], classes: int) -> DataFrame:
    """One row a document: row, doc_id, held_out, n_tokens, symbols (16-bit), base and known of the frequent words, the rare words."""
    shared = docs.sparkSession.sparkContext.broadcast((top, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, logs = shared.value
        table, words, row = np.array(logs), len(ids), TaskContext.get().partitionId() << 36
        end, get = words + classes, ids.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: list[list] = [[], [], [], [], [], [], []]
                for t in batch.column(2):
                    tokens = words_of(t.as_py())
                    found = [get(w, -1) for w in tokens]
                    symbols = np.array([*found, end], np.int64)
                    rare = np.flatnonzero(symbols < 0).tolist()
                    odd = [tokens[i] for i in rare]
                    base = table[symbols[symbols >= 0]].sum() if len(rare) < len(symbols) else 0.0
                    if rare:
                        symbols[rare] = [words + class_of(w, classes) for w in odd]
                    held = Counter(odd)
                    for column, value in zip(out, (row, len(symbols), symbols.astype("<u2").tobytes(), float(base), len(symbols) - len(rare), list(held), list(held.values())), strict=True):
                        column.append(value)
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), batch.column(0), batch.column(1), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.list_(pa.binary())), pa.array(out[6], pa.list_(pa.int32()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "symbols", "base", "known", "rare", "times"],
                )

    return docs.mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, base double, known long, rare array<binary>, times array<int>")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.array([len(p) // 2 for p in parts], np.int64)


def token_slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of slices of rows with about `most` tokens each, and at least one row."""
    at = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1)).tolist()
    return list(zip(at, [*at, len(sizes)][1:], strict=True))


def baum_welch(texts: DataFrame, model: Hmm, share: np.ndarray) -> Hmm:
    """One round over all rows of texts (symbols); counts are added up within partitions, then by symbol."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    k, n = len(model.start), len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(n, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                shared.value.expect(*unpacked(batch.column(0).slice(at, 500)), counts)
        some = np.flatnonzero(counts.emit.any(axis=1))
        keys = np.concatenate([some, np.arange(n, n + k + 1)])
        values = np.vstack([counts.emit[some], counts.move, counts.start])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(values[:, i]) for i in range(k))], names=["symbol", *(f"s{i}" for i in range(k))])

    parts = texts.select("symbols").mapInArrow(lean(run), "symbol int, " + ", ".join(f"s{i} double" for i in range(k)))
    rows = parts.groupBy("symbol").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).toArrow()
    at = np.asarray(rows.column(0))
    values = np.stack([np.asarray(rows.column(i + 1)) for i in range(k)], axis=1)
    counts = Counts(n, k)
    low = at < n
    counts.emit[at[low]] = values[low]
    rest = dict(zip(at[~low].tolist(), values[~low], strict=True))
    for i in range(k):
        counts.move[i] = rest.get(n + i, 0)
    counts.start[:] = rest.get(n + k, 0)
    return counts.model(share)


def drawn_runs(texts: DataFrame, rate: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of runs of `length` tokens, each run of every text (row, symbols) drawn with probability `rate`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs, parts = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py()
                nth = np.arange(-(-len(data) // (2 * length)), dtype=np.uint64)
                chance = (mix(mix(nth + np.uint64(1)) + np.uint64(row)) >> np.uint64(11)) / float(1 << 53)
                for k in np.flatnonzero(chance < rate).tolist():
                    rows.append(row)
                    runs.append(k)
                    parts.append(data[2 * length * k : 2 * length * (k + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(runs, pa.int64()), pa.array(parts, pa.binary())], names=["row", "run", "symbols"])

    found = texts.select("row", "symbols").mapInArrow(lean(run), "row long, run long, symbols binary").toArrow()
    return unpacked(found.sort_by([("row", "ascending"), ("run", "ascending")]).column(2))


@dataclass
class Trained:
    """A model of a corpus: model over symbols; top: words with symbols of their own; sizes: tokens and kinds of each class's other words."""

    model: Hmm
    top: dict[bytes, int]
    classes: int
    sizes: dict[int, tuple[int, int]]
    tokens: int
    kinds: int
    ends: int
    rarer: DataFrame
    coded: DataFrame


def within(count: float, total: float, kinds: float) -> float:
    """The share of a word in its class: seen `count` times of `total`, or unseen where that is 0."""
    return (count - DISCOUNT if count else (DISCOUNT * kinds + 1) / (kinds + 1)) / (total + 1)


def train(docs: DataFrame, *, states: int = 8, words: int = 40_000, classes: int = 2048, rounds: int = 3, sample: int = 3000, length: int = 512, first_rounds: int = 15) -> Trained:
    """Learn from the rows of docs (doc_id, text) whose crc32(doc_id as text) mod 10 is not 0; see score_documents."""
    held = F.coalesce(crc_text("doc_id") % 10 == 0, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, "text")
    vocabulary = stage_table(count_words(rows.filter(~held).select("text"), classes), "words")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    real = vocabulary.filter(F.octet_length("word") > 0)
    ends = n - (real.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    # Words are taken by bins of their counts, so that neither a sort nor ties send more than `words` of them to the driver.
    binned = real.withColumn("bin", F.floor(F.log(F.col("c").cast("double")) * 64))
    sizes = sorted(((r["bin"], r["k"]) for r in binned.filter(F.col("c") >= LEAST).groupBy("bin").agg(F.count("*").alias("k")).collect()), reverse=True)
    cut, taken = None, 0
    for at, k in sizes:
        taken += k
        if taken > words:
            break
        cut = at
    often = F.lit(False) if cut is None else (F.col("bin") >= cut) & (F.col("c") >= LEAST)
    frequent = sorted(((bytes(r["word"]), r["c"]) for r in binned.filter(often).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))
    top = {w: i for i, (w, _) in enumerate(frequent)}
    rarer = binned.filter(~often).drop("bin")
    by_class = {r["class"]: (r["c"], r["v"]) for r in rarer.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    shares = np.zeros(len(top) + classes + 1)
    shares[: len(top)] = [c for _, c in frequent]
    for b, (c, _) in by_class.items():
        shares[len(top) + b] = c
    shares[-1] = ends
    share = (shares + 0.1) / (shares + 0.1).sum()
    logs = np.zeros(len(shares))
    logs[: len(top)] = np.log10(shares[: len(top)] + 0.1)
    logs[-1] = math.log10(ends + 0.1)
    coded = stage_table(encode(rows, top, logs.tolist(), classes), "symbols")
    learn = coded.filter("not held_out").select("symbols")
    model = first_model(*drawn_runs(coded.filter("not held_out"), min(1.0, sample * length / max(1, n)), length), share, states, first_rounds)
    for _ in range(rounds):
        model = baum_welch(learn, model, share)
    return Trained(model, top, classes, by_class, n, v, ends, rarer, coded)


def score_documents(docs: DataFrame, **options: int) -> DataFrame:
    """Score every whole text; rows whose crc32(doc_id as text) mod 10 is 0 are not learned from.

    Options, with their defaults in train: states; words and classes, how many words have symbols of their own
    and into how many classes the others go; rounds, Baum-Welch rounds over the whole corpus. They start from
    a model of about `sample` runs of `length` tokens, drawn from all runs of all texts, after first_rounds there.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is
    its end alone. Repeated rows are counted and scored each. A null doc_id is learned from. With nothing to
    learn from, every symbol is equally likely. An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = train(docs, **options)
    coded, classes, n, ends = known.coded, known.classes, known.tokens, known.ends
    scale = math.log10(n + 0.1 * (known.kinds + 1))
    shared = spark.sparkContext.broadcast(known.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = np.zeros(batch.num_rows)
            for at, end in token_slices(np.asarray(batch.column(3)), SLICE):
                path[at:end] = shared.value.forward(*unpacked(batch.column(6).slice(at, end - at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(path)], names=["row", "doc_id", "held_out", "n_tokens", "base", "known", "path"])

    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "base", "known", "symbols").mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, base double, known long, path double")
    size = spark.createDataFrame([(b, *known.sizes.get(b, (0, 0))) for b in range(classes)], "class int, total long, kinds long")
    parts = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = parts.join(known.rarer.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    met = met.withColumn("class", F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(classes)).cast("int")).join(F.broadcast(size), "class")
    part = F.when(F.col("c") > 0, F.col("c") - DISCOUNT).otherwise((DISCOUNT * F.col("kinds") + 1) / (F.col("kinds") + 1)) / (F.col("total") + 1)
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(part)).alias("rare_path"))
    out = scored.join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # The end is known unless nothing was learned.
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") - F.lit(0 if ends else 1) + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("path") + zero("rare_path")).alias("score"),
    )
