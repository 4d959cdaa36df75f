"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from the words in it, and the
document's score is the noisy-or of its sentences and of a small prior, 1 - (1 - prior) * prod(1 - p).
Weights are learned from document labels alone, so a label's credit goes to the sentences that explain it;
those can then be pointed out.

Evidence only adds: weights are not negative, and a sentence without evidence has probability 0, so that
no text becomes toxic by its length. p is the logistic score's part above that of no evidence. Features
are words and their beginnings, which also catch inflected forms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import crc_text, drop_table, lean, stage_table

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
STEMS = (4, 5, 6)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


PRIOR = 0.1  # the highest score of a text without evidence


@dataclass(frozen=True)
class Model:
    """bias: the logistic score of no evidence; prior: the score of a document without any."""

    bias: float
    prior: float
    weights: dict[str, float]


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.none = softplus(model.bias)

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            get = self.model.weights.get
            found = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, -log(1 - p)) of each sentence with evidence, in code points of the text."""
        out = []
        for m in SENTENCE.finditer(text):
            z = sum(map(self.word, WORD.findall(m[0].lower())))
            if z:
                out.append((m.start(), m.end(), softplus(self.model.bias + z) - self.none))
        return out

    def score(self, text: str) -> tuple[float, tuple[int, int, float] | None, int]:
        """Noisy-or of the prior and all sentences, the worst sentence with evidence, and how many have 0.5 or more."""
        known, word = self.known, self.word
        if not any(known[w] if w in known else word(w) for w in set(WORD.findall(text.lower()))):
            return self.model.prior, None, 0
        found = self.sentences(text)
        total = -math.log1p(-self.model.prior) + sum(x for *_, x in found)
        worst = max(found, key=lambda x: x[2], default=None)
        return -math.expm1(-total), worst and (*worst[:2], -math.expm1(-worst[2])), sum(x >= math.log(2) for *_, x in found)


#: A document for training: how many sentences have each list of feature numbers.
Bag = dict[tuple[int, ...], int]


def bag_of(text: str, ids: dict[str, int]) -> Bag:
    found = Counter()
    for s in SENTENCE.findall(text):
        hits = tuple(sorted(ids[f] for w in WORD.findall(s.lower()) for f in features(w) if f in ids))
        if hits:
            found[hits] += 1
    return found


def evident(text: str) -> set[str]:
    """The features of a text."""
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


def fit(texts: list[str], labels: list[int], **options: float) -> Model:
    """fit_bags over texts at hand."""
    least = options.pop("least", 3)
    seen = (Counter(), Counter())
    for t, label in zip(texts, labels, strict=True):
        seen[int(label)].update(evident(t))
    pos, neg = sum(labels), len(labels) - sum(labels)
    keep = sorted(f for f, k in seen[1].items() if neg and k >= least and k / pos > 2 * (seen[0][f] + 0.5) / neg)
    ids = {f: i for i, f in enumerate(keep)}
    return fit_bags([bag_of(t, ids) for t in texts], labels, keep, **options)


def gradient(bags: tuple[np.ndarray, ...], y: np.ndarray, each: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float, float]:
    """Weighted log-likelihood of the labels under the noisy-or, and its slopes by weights, bias and -log(1 - prior).

    bags: document and number of each sentence with evidence; then sentence and feature of each hit.
    prior: -log(1 - the prior probability).
    """
    doc, times, r, c = bags
    n = len(y)
    z = b + np.bincount(r, w[c], len(doc))
    soft = lambda x: np.logaddexp(0.0, x)
    total = prior + np.bincount(doc, times * (soft(z) - soft(b)), n)
    value = float((each * np.where(y == 1, np.log(-np.expm1(-total)), -total)).sum())
    # d loglik / d total: positives exp(-t)/(1-exp(-t)), negatives -1; d total / d z = logistic(z).
    slope = np.clip(each * np.where(y == 1, np.exp(-total) / -np.expm1(-total), -1.0), -50, 50)
    p, p0 = 1 / (1 + np.exp(-np.clip(z, -60, 60))), 1 / (1 + math.exp(-b))
    at = slope[doc] * times
    return value, np.bincount(c, (at * p)[r], len(w)), float((at * (p - p0)).sum()), float(slope.sum())


def arrays(bags: list[Bag]) -> tuple[np.ndarray, ...]:
    doc = np.array([d for d, found in enumerate(bags) for _ in found], np.int64)
    times = np.array([k for found in bags for k in found.values()], float)
    hits = [h for found in bags for h in found]
    r = np.repeat(np.arange(len(hits)), [len(h) for h in hits]).astype(np.int64)
    return doc, times, r, np.array([f for h in hits for f in h], np.int64)


def fit_bags(bags: list[Bag], labels: list[int], keep: list[str], *, steps: int = 400, rate: float = 0.3, sparse: float = 2e-4) -> Model:
    """Learn the weights of the features `keep` by projected gradient steps on the likelihood of the document labels.

    Without positive or negative documents only the prior is set.
    """
    y = np.array(labels, float)
    n, pos = len(y), y.sum()
    if n == 0 or pos == 0 or pos == n:
        return Model(-6.0, min(PRIOR, float(pos + 0.5) / (n + 1)), {})
    data = arrays(bags)
    w, b, prior = np.zeros(len(keep)), -6.0, 0.02
    most = -math.log1p(-PRIOR)
    # Both classes weigh the same, whatever their shares in the sample.
    each = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos)) * n
    memory_w, memory_b, memory_p = np.zeros(len(keep)), 0.0, 0.0
    for _ in range(steps):
        _, gw, gb, gp = gradient(data, y, each, w, b, prior)
        gw, gb, gp = gw / n - sparse, gb / n, gp / n
        memory_w = 0.95 * memory_w + 0.05 * gw**2
        memory_b = 0.95 * memory_b + 0.05 * gb**2
        memory_p = 0.95 * memory_p + 0.05 * gp**2
        w = np.maximum(0, w + rate * gw / (np.sqrt(memory_w) + 1e-6) * 0.3)
        b = min(-3.0, b + rate * gb / (math.sqrt(memory_b) + 1e-6) * 0.1)
        prior = min(most, max(1e-4, prior + rate * gp / (math.sqrt(memory_p) + 1e-6) * 0.01))
    return Model(float(b), float(-math.expm1(-prior)), {f: float(w[i]) for i, f in enumerate(keep) if w[i] > 1e-3})


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, least: int = 3, most: int = 50_000) -> Model:
    """Fit on a bounded sample of labelled rows: at most `sample` of each class, by a hash of doc_id.

    docs: doc_id, text. labels: doc_id, toxic. Rows held out, crc32(doc_id as text) mod 5 = 0, and null
    labels are not used; of repeated labels of a document the highest counts, of its texts the least. Features
    in at least `least` positive documents that are twice as common there are kept, at most `most` of them;
    others could get no weight. Texts stay in Spark: the driver gets those features and, of each document,
    how many sentences have which of them. A null text is empty; without labelled rows the prior alone is set.
    """
    mine = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_text("doc_id") % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for want in (0, 1):
        some = mine.filter((F.col("toxic") > 0) == bool(want)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = stage_table(chosen.groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"), F.min("text").alias("text")), "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for y, t in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200), strict=True):
                    found[y].update(evident(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([*found[0], *found[1]], pa.string()), pa.array([*found[0].values(), *[0] * len(found[1])], pa.int64()), pa.array([*[0] * len(found[0]), *found[1].values()], pa.int64())], names=["feature", "neg", "pos"])

    sizes = rows.agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).first()
    pos, neg = sizes["pos"], sizes["neg"]
    keep: list[str] = []
    if pos and neg:
        counts = rows.select("y", "text").mapInArrow(lean(seen), "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        apart = counts.filter((F.col("pos") >= least) & (F.col("pos") / pos > 2 * (F.col("neg") + 0.5) / neg))
        keep = sorted(r["feature"] for r in apart.orderBy(F.desc("pos"), "feature").limit(most).collect())
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(keep)})

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bags = [bag_of(t.as_py(), shared.value) for t in part.column(2)]
                hits = pa.array([list(found) for found in bags], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hits, pa.array([list(found.values()) for found in bags], pa.list_(pa.int64()))], names=["doc_id", "y", "hits", "times"])

    made = rows.select("doc_id", "y", "text").mapInArrow(lean(bagged), "doc_id long, y boolean, hits array<array<int>>, times array<long>").collect()
    made.sort(key=lambda row: row["doc_id"])
    drop_table(rows)
    return fit_bags([{tuple(h): k for h, k in zip(r["hits"], r["times"], strict=True)} for r in made], [int(r["y"]) for r in made], keep)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, then the worst sentence (start, stop, score) and how many offend.

    A text without evidence, null and empty ones too, has the prior as its score, however long it is. Repeated rows each give a row, null ids too; an empty
    table gives none. The model, of a size bounded by the training sample, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py() or "") for t in batch.column(2)]
            scores = np.array([x[0] for x in found], float)
            worst = [x[1] or (None, None, None) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([x[0] for x in worst], pa.int64()), pa.array([x[1] for x in worst], pa.int64()), pa.array([x[2] for x in worst], pa.float64()), pa.array([x[2] for x in found], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_stop", "worst_score", "n_offending"],
            )

    held = F.coalesce(crc_text("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, F.col("text")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, worst_start long, worst_stop long, worst_score double, n_offending long")


def drop_toxic(docs: DataFrame, model: Model, *, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose score is below limit; texts without evidence have the prior, at most PRIOR, and stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "")[0] < limit for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
