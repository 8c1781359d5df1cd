"""Quality classifier: interpolated modified Kneser-Ney over the bytes of trusted text.

Counts of all n-grams of trusted documents are summed per n-gram; lower orders count the
distinct left neighbours; discounts come from the counts of counts. Documents are scored by
joins between shards of n-grams: each scan partition (a block) asks for the distinct n-grams
of its own documents, the probabilities of all that were asked for are joined to the counts of
every order, and the answers meet the block's texts, sent compressed, in one task that sums
them per document. What is asked grows with the corpus, the answer of a block does not.

``docs`` is scanned three times and must be a stored table, so that its partitions hold the
same rows each time; an n-gram without an answer is an error, never a silent zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm import blocks
from fluxprint.llm.common import join_ids
from fluxprint.session import materialize

ORDER = 4                # bytes; 7 at most, as an n-gram is one long
PRIOR_BYTES = 64         # weight of the language's median in the score of a document
HIGH = 0.95              # quantile of the trusted scores of a language ...
REACH = 3.0              # ... whose distance from the median, so many times, is still accepted
LEAST_TRUSTED = 30       # trusted documents below which a language has no limit
FOLD_BYTES = 1 << 18     # of text that are n-grams at once; the arrays of one fold are some 50 times as large
MOST_KEYS = 1 << 20      # distinct n-grams that a task holds before it sends them on


def ngrams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; zero bytes stand before a document."""
    n, pad = len(data), order - 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(n) + pad * (doc + 1)
    wide = np.zeros(n + pad * (len(at) - 1), np.int64)
    wide[place] = data
    out = np.zeros(n, np.int64)
    for j in range(order):
        out = (out << 8) | wide[place - pad + j]
    return out


def pieces(data: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The n-grams of a slice in turn; a document of more than FOLD_BYTES goes in pieces that reach back into it."""
    if len(at) != 2 or len(data) <= FOLD_BYTES:
        yield ngrams(data, at, order)
        return
    for lo in range(0, len(data), FOLD_BYTES):
        start = max(0, lo - order + 1)
        piece = data[start:lo + FOLD_BYTES]
        yield ngrams(piece, np.array([0, len(piece)]), order)[lo - start:]


def _run_lengths(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums of ``n`` (their number if not given); without ``n`` the keys are sorted in place."""
    if n is None:
        keys.sort()
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[heads], np.diff(np.append(heads, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(n, heads)


def folded(batches: Iterator[pa.RecordBatch], column: int, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams of all batches with their counts; one comes again only after MOST_KEYS distinct ones were sent on."""
    held, fresh = [], 0
    merged = lambda: _run_lengths(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
    for batch in batches:
        for _, _, data, at in blocks.slices(batch.column(column), FOLD_BYTES):
            for grams in pieces(data, at, order):
                if not len(grams):
                    continue
                held.append(_run_lengths(grams))
                fresh += len(held[-1][0])
                if fresh > max(FOLD_BYTES, len(held[0][0])):
                    held, fresh = [merged()], 0
                    if len(held[0][0]) > MOST_KEYS:
                        yield held.pop()
        pa.default_memory_pool().release_unused()
    if held:
        yield merged()


def counts(trusted: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Tables (gram, n) of orders 1 to ``order``: occurrences at the top, distinct left neighbours below."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, total in folded(batches, 0, order):
            yield pa.RecordBatch.from_pydict({"gram": known, "n": total})

    top = trusted.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    tables = [materialize(top, "ngrams")]
    for m in range(order - 1, 0, -1):
        below = tables[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * m) - 1).alias("gram")).agg(F.count("*").alias("n"))
        tables.insert(0, materialize(below, "ngrams"))
    return tables


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more; half the count where the counts of counts say nothing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    least = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) if a and b else k / 2
    return least(1, n1, n2), least(2, n2, n3), least(3, n3, n4)


def log_probabilities(asked: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(gram, logp) of each asked gram: the joins of one order after the other, up from single bytes."""
    out = None
    for m, table in enumerate(tables, 1):
        mask = (1 << 8 * m) - 1
        d1, d2, d3 = discounts(*table.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())
        context = table.groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("s"), F.sum(F.expr(f"case n when 1 then {d1}D when 2 then {d2}D else {d3}D end")).alias("held"))
        grams = asked.select(F.col("gram").bitwiseAND(mask).alias("gram")).distinct().withColumns(
            {"context": F.shiftright("gram", 8), "lower": F.col("gram").bitwiseAND(mask >> 8)})
        if out is None:
            below = grams.withColumn("p0", F.lit(1 / 256))
        else:
            below = grams.join(out.select(F.col("gram").alias("lower"), F.col("p").alias("p0")), "lower")
        joined = below.join(table, "gram", "left").join(context, "context", "left")
        own = F.expr(f"coalesce(n - case n when 1 then {d1}D when 2 then {d2}D else {d3}D end, 0D)")
        p = F.when(F.col("s").isNull(), F.col("p0")).otherwise((own + F.col("held") * F.col("p0")) / F.col("s"))
        out = materialize(joined.select("gram", p.alias("p")), "probabilities")
    return out.select("gram", F.ln("p").cast("float").alias("logp"))


def asked_for(docs: DataFrame, order: int) -> DataFrame:
    """(block, gram): the n-grams of each scan partition, a few times at most."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            block = first.column(1)[0].as_py()
            for known, _ in folded(chain((first,), batches), 0, order):
                yield pa.RecordBatch.from_pydict({"block": np.full(len(known), block, np.int32), "gram": known})

    return docs.select("text", F.spark_partition_id()).mapInArrow(ask, "block int, gram bigint")


def packed(docs: DataFrame) -> DataFrame:
    """(block, ids, langs, sizes, texts): the documents of each scan partition, some FOLD_BYTES compressed together."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(2), FOLD_BYTES):
                yield pa.RecordBatch.from_pydict({
                    "block": batch.column(3).slice(lo, 1), "ids": pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    "langs": pa.array([batch.column(1).slice(lo, hi - lo).to_pylist()], pa.list_(pa.string())),
                    "sizes": pa.array([np.diff(at).tolist()], pa.list_(pa.int64())), "texts": [press.compress(np.ascontiguousarray(data))]})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), "text", F.spark_partition_id()).mapInArrow(
        pack, "block int, ids array<bigint>, langs array<string>, sizes array<bigint>, texts binary")


class Lookup:
    """Open-addressed table from n-gram to log-probability, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            if (self.keys[slot[wrong]] == -1).any():
                raise LookupError("an n-gram has no answer: the partitions of docs changed between scans")
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


SCORED = "doc_id bigint, lang string, n_bytes bigint, nll double"


def scored(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, nll): negative log-likelihood of each document under the model of the trusted ones."""
    tables = counts(trusted, order)
    asked = materialize(asked_for(docs, order), "asked")
    answers = asked.join(materialize(log_probabilities(asked.select("gram").distinct(), tables), "logp"), "gram")
    none = {"ids": "array<bigint>", "langs": "array<string>", "sizes": "array<bigint>", "texts": "binary"}
    answers = answers.select("block", F.lit(0).alias("kind"), "gram", "logp", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    texts = packed(docs).select("block", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("float").alias("logp"), *none)
    n = max(1, asked.select("block").distinct().count())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, block, held, table = zstandard.ZstdDecompressor(), None, [], None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(of))):
                if hi == lo:
                    continue
                if of[lo] != block:
                    block, held, table = of[lo], [], None
                if kind[lo] == 0:
                    held.append((batch.column(2).slice(lo, hi - lo).to_numpy(), batch.column(3).slice(lo, hi - lo).to_numpy()))
                    continue
                if table is None:
                    table = Lookup(*[np.concatenate([h[i] for h in held]) if held else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.float32))])
                    held = []
                for i in range(lo, hi):
                    size = np.array(batch.column(6)[i].as_py(), np.int64)
                    at = np.concatenate(([0], np.cumsum(size)))
                    data = np.frombuffer(press.decompress(batch.column(7)[i].as_py(), max_output_size=int(at[-1]) or 1), np.uint8)
                    if len(size) == 1:
                        nll = np.array([-sum(float(table(g).sum(dtype=np.float64)) for g in pieces(data, at, order))])
                    else:
                        total = np.concatenate(([0.0], np.cumsum(table(ngrams(data, at, order)), dtype=np.float64)))
                        nll = total[at[:-1]] - total[at[1:]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(4)[i].values, batch.column(5)[i].values, pa.array(size), pa.array(nll)],
                        names=["doc_id", "lang", "n_bytes", "nll"])

    return answers.union(texts).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(score, SCORED)


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, score, threshold, rejected), one row per document.

    Trusted are documents labelled quality 1. The score is the mean negative log-probability of a
    byte, drawn to the median of its language by ``PRIOR_BYTES`` bytes, as short texts say little.
    A language's threshold lies REACH times the distance of its median and HIGH quantile above the
    median; null is a language of its own. A language with fewer than LEAST_TRUSTED trusted documents
    has no threshold and loses no text, as the limits of other languages, whose bytes the model
    knows, say nothing of it. Null and empty texts have no perplexity and are rejected everywhere.
    """
    trusted = materialize(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")
    raw = materialize(scored(docs, join_ids(docs.select("doc_id", "text"), trusted, "left_semi"), order), "nll")
    known = raw.join(trusted.withColumn("trust", F.lit(True)), "doc_id", "left").withColumn("mean", F.expr("nll / nullif(n_bytes, 0)"))
    known = materialize(known.select("doc_id", "lang", "n_bytes", "mean", F.coalesce("trust", F.lit(False)).alias("trust")), "nll-trust")
    middle = _by_language(known, F.col("mean"), [0.5])
    full = _with_language(known, middle).withColumn(
        "score", (F.col("mean") * F.col("n_bytes") + F.coalesce(F.col("q")[0], F.col("mean")) * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)).drop("q")
    full = materialize(full, "nll-score")
    limit = _with_language(full, _by_language(full, F.col("score"), [0.5, HIGH]))
    threshold = F.col("q")[0] + REACH * (F.col("q")[1] - F.col("q")[0])
    return limit.select("doc_id", "lang", "n_bytes", F.exp("mean").alias("perplexity"), "score", threshold.alias("threshold"),
                        (F.col("n_bytes").eqNullSafe(0) | F.coalesce(F.col("score") > threshold, F.lit(False))).alias("rejected"))


def _by_language(rows: DataFrame, value, quantiles: list[float]) -> DataFrame:
    """(language, q) from trusted rows of each language that has enough; exact on values folded to 4 digits before they meet."""
    folded_ = rows.filter("trust and n_bytes > 0").groupBy("lang", F.round(value, 4).alias("v")).agg(F.count("*").alias("n"))
    each = folded_.groupBy("lang").agg(F.sum("n").alias("trusted"), F.percentile("v", quantiles, F.col("n")).alias("q"))
    return materialize(each.filter(F.col("trusted") >= LEAST_TRUSTED).select(F.col("lang").alias("language"), "q"), "quantiles")


def _with_language(rows: DataFrame, limits: DataFrame) -> DataFrame:
    return rows.join(limits, rows["lang"].eqNullSafe(limits["language"]), "left").drop("language")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not rejected, all columns as they are; rows with a null id stay."""
    bad = materialize(judged(docs, labels).filter("rejected and doc_id is not null").select("doc_id").distinct(), "rejected")
    return join_ids(docs, bad, "left_anti").select(*docs.columns)
