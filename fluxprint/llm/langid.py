"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up, per language and bucket, how often an n-gram of letters occurs in all
training texts; a partition counts into one array per language and sends its non-zero
buckets, which Spark sums. Scoring broadcasts the matrix of log-probabilities, whose size is
set by its parameters, and adds up its rows over the n-grams of each text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MOST_LANGUAGES = 1024          # matrix of 64 MB at most; more languages are refused
SLICE_CHARS = 1 << 18
UNKNOWN = "und"


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, lower-cased, runs of other characters as one 0; and each text's offsets.

    A text begins with a 0 after the 0 that ends the one before, so that n-grams see where words
    begin and end and never reach into another text.
    """
    whole = "\n".join(texts).lower()
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, back = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(p).isalpha() for p in known], bool)
    flag = is_letter[back]
    symbols = np.where(flag, points, 0)
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    symbols = np.append(symbols, np.uint32(0))
    keep = flag_or_first(symbols)
    count = np.concatenate(([0], np.cumsum(keep)))
    at = count[at]
    return np.insert(symbols[keep], at[:-1], 0), at + np.arange(len(at))


def flag_or_first(symbols: np.ndarray) -> np.ndarray:
    """Letters, and the first of each run of zeros."""
    keep = symbols != 0
    keep[1:] |= keep[:-1]
    return keep


def grams(symbols: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each symbol; n-grams reach back over the start as zeros."""
    h = np.full(len(symbols), order, np.uint64)
    padded = np.concatenate((np.zeros(order - 1, np.uint32), symbols)).astype(np.uint64)
    for j in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[j:j + len(symbols)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row numbers, texts) of about SLICE_CHARS characters; longer texts are cut at that length.

    A cut text is counted piece by piece; only the few n-grams over a cut differ from the whole.
    """
    rows, held, weight = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        for lo in range(0, max(len(t), 1), SLICE_CHARS):
            part = t[lo:lo + SLICE_CHARS]
            rows.append(i)
            held.append(part)
            weight += len(part) + 1
            if weight >= SLICE_CHARS:
                yield np.array(rows), held
                rows, held, weight = [], [], 0
    if rows:
        yield np.array(rows), held


def counts(rows: DataFrame, text: str, lang: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows; null texts count nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows_, held in pieces(texts):
                symbols, at = letters(held)
                of = np.array([langs[i] for i in rows_], object)
                for name in set(of):
                    mine = np.repeat(of == name, np.diff(at))
                    sums = total.setdefault(name, np.zeros(buckets, np.int64))
                    for order in ORDERS:
                        ids = grams(symbols, order, buckets)
                        sums += np.bincount(ids[mine & (symbols != 0)], minlength=buckets)
        for name, sums in total.items():
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(hit), "bucket": hit.astype(np.int32), "n": sums[hit]})

    return rows.select(text, lang).mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities, shaped buckets x languages; equal priors, add-one smoothing."""
    table = counts(rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang, buckets)
    folded = table.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))  # one row of `buckets` pairs per language
    names, columns = [], []
    for row in folded.limit(MOST_LANGUAGES + 1).toLocalIterator():
        if len(names) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        c = np.ones(buckets)
        for bucket, n in row["c"]:
            c[bucket] += n
        names.append(row["lang"])
        columns.append(np.log(c) - np.log(c.sum()))
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], np.ascontiguousarray(np.array([columns[i] for i in order], np.float32).reshape(len(names), buckets).T)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior of the prediction.

    A null text or one without a letter is ``und`` with score 0, as is every text if no language
    was learned; equal posteriors go to the first name in order. Columns named lang_pred or
    score are replaced, all others pass through.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    spot = kept.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        buckets, k = logs.shape
        for batch in batches:
            texts = batch.column(spot).to_pylist()
            total, seen = np.zeros((len(texts), max(k, 1))), np.zeros(len(texts), np.int64)
            for rows, held in pieces(texts) if k else ():
                symbols, at = letters(held)
                is_letter = symbols != 0
                part = np.zeros((len(rows), k))
                for order in ORDERS:
                    weights = logs[grams(symbols, order, buckets)]
                    weights[~is_letter] = 0
                    part += np.add.reduceat(weights, at[:-1], axis=0, dtype=np.float64) if len(symbols) else 0
                np.add.at(total, rows, part)
                np.add.at(seen, rows, np.add.reduceat(is_letter.astype(np.int64), at[:-1]))
            best = total.argmax(1)
            top = total[np.arange(len(texts)), best]
            posterior = 1 / np.exp(total - top[:, None]).sum(1)
            fine = (seen > 0) & (k > 0)
            out = [names[b] if f else UNKNOWN for b, f in zip(best, fine)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(out, pa.string()), pa.array(np.where(fine, posterior, 0.0))],
                                             names=kept + ["lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in kept]).schema.fields)
    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(score, fields + ", lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One row in five, by its id alone; a null id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
