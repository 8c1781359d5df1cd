"""Mixing sources to target weights by soft membership.

A softmax regression over hashed words and a few marks of style, fitted on a bounded sample of
the labelled table, gives each document a posterior over the domains, the classes of that
table. Projected-gradient least squares then fits a rate per document within [0, max_rate], so
that the expected tokens of each domain, the sum of rate x tokens x posterior, match their
targets. The projection is lazy: the gradients add up in one number per domain, and the rate of a
document is 1 less its tokens' share of them, cut to the range, which also is the rate nearest to 1.
So a step needs one row of sums over all documents, and rates are never gathered or stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm import blocks
from fluxprint.llm.common import join_ids
from fluxprint.session import materialize

SAMPLE = 8192            # labelled documents that the classifier is fitted on
WORDS = 1 << 16
STYLE = 5
EPOCHS = 60
MOST_DOMAINS = 32
STEPS = 40
CLOSE = 1e-4             # relative miss of the targets at which the fit ends
# Target weights of the registered query and the pipeline: mostly good and clean text.
TARGETS = {"q1t0": 0.96, "q1t1": 0.02, "q0t0": 0.02}


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of the words, word counts, and style marks per document."""
    _, _, hashes, first = blocks.words(data, at)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    pair = np.unique(doc * WORDS + (hashes >> np.uint64(48)).astype(np.int64))
    marks = np.zeros((len(count), STYLE))
    size = np.maximum(np.diff(at), 1)
    kinds = np.zeros((STYLE - 1, 256), bool)
    kinds[0, 65:91] = True
    kinds[1, [*b"#$%&*|~^"]] = True
    kinds[2, [*b"!?"]] = True
    kinds[3, 48:58] = True
    for k in range(STYLE - 1):
        total = np.concatenate(([0], np.cumsum(kinds[k][data])))
        marks[:, k] = np.minimum(10 * (total[at[1:]] - total[at[:-1]]) / size, 2)
    marks[:, STYLE - 1] = 1
    return pair // WORDS, pair % WORDS, count, marks


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _logits(doc: np.ndarray, bucket: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = marks @ weights[WORDS:]
    for k in range(weights.shape[1]):
        out[:, k] += np.bincount(doc, weights[bucket, k], len(marks))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Domains in order and the weights. Labels with a null are left out; of repeated ones the greatest counts."""
    named = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))).alias("domain"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, data, at in blocks.slices(batch.column(1)):
                doc, bucket, _, marks = features(data, at)
                cut = np.searchsorted(doc, np.arange(len(marks) + 1))
                yield pa.RecordBatch.from_pydict({
                    "domain": names[lo:lo + len(marks)], "words": [bucket[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:])],
                    "marks": [m.tobytes() for m in marks]})

    got = rows.mapInArrow(scan, "domain string, words binary, marks binary").collect()  # at most `sample` rows
    got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    domains = sorted({r[0] for r in got})
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    weights = np.zeros((WORDS + STYLE, max(len(domains), 1)))
    if len(domains) < 2:
        return domains, weights
    lists = [np.frombuffer(r[1], np.uint16).astype(np.int64) for r in got]
    doc, bucket = np.repeat(np.arange(len(got)), [len(x) for x in lists]), np.concatenate(lists)
    marks = np.array([np.frombuffer(r[2]) for r in got])
    truth = np.array([domains.index(r[0]) for r in got])
    square = np.full(weights.shape, 1e-6)
    for _ in range(EPOCHS):
        miss = _softmax(_logits(doc, bucket, marks, weights))
        miss[np.arange(len(got)), truth] -= 1
        slope = np.concatenate((np.stack([np.bincount(bucket, miss[doc, k], WORDS) for k in range(len(domains))], 1), marks.T @ miss))
        slope = slope / len(got) + 1e-5 * weights
        square += slope * slope
        weights -= 0.3 * slope / np.sqrt(square)
    return domains, weights


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, tokens, posterior): one row per document; a text without words has no tokens and the posterior of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                doc, bucket, count, marks = features(data, at)
                p = _softmax(_logits(doc, bucket, marks, weights))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count), pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))],
                    names=["doc_id", "tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, tokens bigint, posterior array<double>")


def _rows(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Tokens x posterior, shaped documents x domains."""
    return batch.column(1).to_numpy()[:, None] * batch.column(2).flatten().to_numpy().reshape(-1, k)


def _rates(a: np.ndarray, pull: np.ndarray, max_rate: float) -> np.ndarray:
    return np.clip(1 - a @ pull, 0, max_rate)


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = 1.0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies) of each document, ``posterior`` in the order of the domains' names.

    The weights are held against the domain that has the greatest: its tokens set the total,
    less 2 %. A domain with fewer tokens than its share (at ``max_rate``) is asked for what it has, and
    domains without a target for none. ``copies`` is the rate rounded up or down by a hash of the id, so that its
    expectation is the rate. Without labels all rates are 1; documents without words keep rate 1.
    """
    domains, weights = fit(docs, labels, sample)
    k = weights.shape[1]
    table = materialize(posteriors(docs, (domains, weights)), "posteriors")
    pull = np.zeros(k)
    if domains:
        a = [F.col("tokens") * F.col("posterior")[i] for i in range(k)]
        sums = table.agg(*[F.sum(x) for x in a], *[F.sum(a[i] * a[j]) for i in range(k) for j in range(k)]).first()
        have = np.array([x or 0.0 for x in sums[:k]])
        gram = np.array([x or 0.0 for x in sums[k:]]).reshape(k, k)
        pull = descend(table, have, gram, goals(domains, have, targets or TARGETS, max_rate), max_rate)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _rates(_rows(batch, k), pull, max_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    return table.mapInArrow(apply, "doc_id bigint, tokens bigint, posterior array<double>, rate double") \
        .withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def goals(domains: list[str], have: np.ndarray, targets: dict[str, float], max_rate: float) -> np.ndarray:
    share = np.array([targets.get(d, 0.0) for d in domains])
    if not share.any() or not have[share.argmax()]:
        return have.copy()
    main = share.argmax()
    return np.minimum(share / share[main] * have[main] * min(0.98, max_rate), 0.98 * max_rate * have)


def descend(table: DataFrame, have: np.ndarray, gram: np.ndarray, goal: np.ndarray, max_rate: float) -> np.ndarray:
    """The sum of the gradient steps, one number per domain.

    A step is measured by the inverse Gram matrix of the documents whose rates can still move, with a
    hundredth of that of all, and halved where it would not lessen the miss.
    """
    k = len(have)
    inverse = lambda m: np.linalg.pinv(m, rcond=1e-12, hermitian=True)
    norm = inverse(gram)
    pull, now, moving = np.zeros(k), have, gram
    step = inverse(gram) @ (now - goal)
    for _ in range(STEPS):
        if np.abs(now - goal).max() <= CLOSE * max(goal.max(), 1.0):
            break

        def total(batches: Iterator[pa.RecordBatch], pull: np.ndarray = pull + step) -> Iterator[pa.RecordBatch]:
            part, square = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                rows = _rows(batch, k)
                rate = _rates(rows, pull, max_rate)
                part += rate @ rows
                free = rows[(rate > 0) & (rate < max_rate)]
                square += free.T @ free
            yield pa.RecordBatch.from_pydict({f"t{i}": [x] for i, x in enumerate([*part, *square.ravel()])})

        width = k + k * k
        sums = table.mapInArrow(total, ", ".join(f"t{i} double" for i in range(width))).agg(*[F.sum(f"t{i}") for i in range(width)]).first()
        there = np.array([x or 0.0 for x in sums[:k]])
        if (there - goal) @ norm @ (there - goal) < (now - goal) @ norm @ (now - goal):
            pull, now, moving = pull + step, there, np.array([x or 0.0 for x in sums[k:]]).reshape(k, k)
            step = inverse(moving + 0.01 * gram) @ (now - goal)
        else:
            step = step / 2
    return pull


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents that the rates keep, all columns as they are; at rates within 1 a document comes once or not."""
    out = materialize(rates(docs, labels, targets).filter("copies = 0 and doc_id is not null").select("doc_id").distinct(), "left-out")
    return join_ids(docs, out, "left_anti").select(*docs.columns)
