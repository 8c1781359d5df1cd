"""Importance resampling towards a target text collection, with bit-sliced weights.

Features are runs of one to three words, hashed into buckets by CRC-32. A bucket's gain tells
how much more often the target holds it than the corpus does. A document's weight is the sum of
the gains over its features. It is computed in bit slices: the document's bucket counts are cut
into planes of one bit per bucket, plane i holding bit i of all counts; the gains, in two's
complement, into planes as well. Then the weight is the sum over all pairs of planes of
popcount(AND) times a power of two, the gains' top plane counting negative. All of it is exact
in integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.llm.blocks import utf8
from fluxprint.session import materialize

BUCKETS = 10_000
ORDERS = 3
SLICE = 1 << 18                # bytes of text that one step of a kernel looks at
SLICE_ROWS = 64
TABLED = 64                    # word lengths with a shift table of their own
DRAWN_PERCENT = 5
FEWEST_WORDS = 20
SEED = 42

# A-Z lower-cased, digits and all bytes over 127 kept, everything else 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)

_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_BYTE = _byte_table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _BYTE[(register ^ np.asarray(byte, np.uint32)) & np.uint32(255)] ^ (register >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """What a register becomes after 0 to TABLED zero bytes, by each of its four bytes: the map is linear."""
    now = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(TABLED):
        now = _step(now, 0)
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_tables().ravel()


def _by_tables(crc: np.ndarray, table: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    out = table[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= table[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 values as they enter that of a string with ``length`` more bytes."""
    out = _by_tables(crc, _SHIFT, np.minimum(length, TABLED) * 1024)
    left = length - np.minimum(length, TABLED)
    power, table = 0, _SHIFT[1024:2048]
    while (left >> power).any():                  # words over TABLED bytes: by squaring
        has = ((left >> power) & 1).astype(bool)
        out[has] = _by_tables(out[has], table)
        table = _by_tables(table, table)
        power += 1
    return out


def word_crcs(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte over all words at once, longest first."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], length[order]
    crc = np.full(len(order), _ALL, np.uint32)
    for j in range(min(int(left[0]), TABLED) if len(left) else 0):
        m = int(np.searchsorted(-left, -j, "left"))       # words of more than j bytes
        crc[:m] = _step(crc[:m], sym[at[:m] + j])
    crc ^= _ALL
    for i in np.flatnonzero(left > TABLED):
        crc[i] = zlib.crc32(sym[at[i] + TABLED:at[i] + left[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(sym: np.ndarray, at: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, CRC-32) of each run of one to three words, and the number of words of each document.

    ``sym`` are folded bytes, ``at`` the documents' offsets. Runs that end within the first
    ``known`` words are left out, and so are these words.
    """
    n, docs = len(sym), len(at) - 1
    inside = sym != 0
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    edge = np.concatenate(([True], ~inside, [True]))
    starts = np.flatnonzero(inside & (cut[:-1] | edge[:-2]))
    ends = np.flatnonzero(inside & (cut[1:] | edge[2:])) + 1
    count = np.diff(np.searchsorted(starts, at))
    doc = np.repeat(np.arange(docs), count)
    crc, length = word_crcs(sym, starts, ends), ends - starts
    found_doc, found = [doc[known:]], [crc[known:]]
    run = crc
    for k in range(1, ORDERS):
        if len(crc) <= k:
            break
        # the run before, a space, and the next word; runs over a document's end are dropped
        spaced = _step(run[:-1] ^ _ALL, 32) ^ _ALL
        run = shifted(spaced, length[k:]) ^ crc[k:]
        whole = doc[:-k] == doc[k:]
        if known:
            whole &= np.arange(k, len(doc)) >= known
        found_doc.append(doc[k:][whole])
        found.append(run[whole])
    count[:1] -= min(known, int(count[0])) if docs else 0
    return np.concatenate(found_doc), np.concatenate(found), count


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, folded bytes, offsets, known words) of up to SLICE_ROWS texts and about SLICE bytes.

    A longer text comes in pieces that end with a word; the next piece begins with the last two
    words of the one before, which it says are known.
    """
    data, at = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, n)
        if at[hi] - at[lo] <= SLICE:
            yield lo, _FOLD[data[at[lo]:at[hi]]], at[lo:hi + 1] - at[lo], 0
        else:
            start, end, known = int(at[lo]), int(at[hi]), 0
            fresh = start
            while fresh < end:
                stop = min(fresh + SLICE, end)
                while stop < end and _FOLD[data[stop]] and _FOLD[data[stop - 1]]:
                    ahead = np.flatnonzero(_FOLD[data[stop:stop + SLICE]] == 0)
                    stop = stop + int(ahead[0]) if len(ahead) else min(stop + SLICE, end)
                sym = _FOLD[data[start:stop]]
                yield lo, sym, np.array([0, len(sym)]), known
                begins = np.flatnonzero((sym != 0) & np.concatenate(([True], sym[:-1] == 0)))
                known = min(ORDERS - 1, len(begins))
                start += int(begins[-known]) if known else len(sym)
                fresh = stop
        lo = hi


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket. What comes to the driver are BUCKETS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, sym, at, known in pieces(batch.column(0)):
                total += np.bincount(features(sym, at, known)[1] % BUCKETS, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": hit.astype(np.int32), "n": total[hit]})

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    above, below = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * above / ((s + 1.0) * below))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit i of all values as row i, packed into words of 64 buckets; the last axis of ``values`` is that of buckets."""
    lanes = -(-values.shape[-1] // 64) * 8
    out = np.zeros((bits, *values.shape[:-1], lanes), np.uint8)
    for i in range(bits):
        packed = np.packbits(((values >> values.dtype.type(i)) & values.dtype.type(1)).astype(bool), axis=-1)
        out[i, ..., :packed.shape[-1]] = packed
    return out.view(np.uint64)


def weighed(counts: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """Sum of count times gain for each row of ``counts``, by AND and popcount of their planes."""
    most = int(counts.max(initial=0))
    small = counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint64)
    total, top = np.zeros(len(counts), np.int64), len(gain_planes) - 1
    for i, held in enumerate(planes(small, most.bit_length())):
        for j, gain in enumerate(gain_planes):
            common = np.bitwise_count(held & gain).sum(-1, dtype=np.int64) << (i + j)
            total += -common if j == top else common
    return total


def weights(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(planes(gain, int(np.abs(gain).max(initial=0)).bit_length() + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = shared.value
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for lo, sym, at, known in pieces(batch.column(1)):
                doc, crc, words = features(sym, at, known)
                rows = len(at) - 1
                counts = np.bincount(doc * BUCKETS + crc % BUCKETS, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
                out[0, lo:lo + rows] += words
                out[1, lo:lo + rows] += np.bincount(doc, minlength=rows)
                out[2, lo:lo + rows] += weighed(counts, signed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    return rows.mapInArrow(weigh, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths that the id alone decides; a null id draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scores: DataFrame, drawn: int) -> DataFrame:
    """``scores`` with ``rank`` 1 to ``drawn`` by falling ``score``, ties to the smaller ``doc_id``, else null.

    Rows are dealt out by ranges of their order and stored; ranks add a range's start to the place
    within it, so no task sorts all rows. Ranges beyond the last drawn one are not sorted at all.
    """
    spark = scores.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = materialize(scores.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "dealt-scores")
    sizes = dict(dealt.filter("eligible").groupBy("range").count().collect())     # one number per partition
    before, starts = 0, {}
    for p in sorted(sizes):
        if before < drawn:
            starts[p] = before
        before += sizes[p]
    lead = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("range")] if starts else F.lit(None).cast("int")
    near = dealt.withColumn("lead", lead)
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("lead")
    first = near.filter("eligible and lead is not null").withColumn("rank", place.cast("bigint"))
    rest = near.filter("not eligible or lead is null").withColumn("rank", F.lit(None).cast("bigint"))
    return first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).drop("lead", "range")


def resampled(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", percent: int = DRAWN_PERCENT,
              fewest_words: int = FEWEST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with ``n_words, n_features, weight, score, rank``; the rank is null for those not drawn.

    Drawn are the highest scores, ``percent`` of the documents with ``fewest_words`` words or more.
    A null or empty text has no features and weight 0. Repeated rows are documents of their own with
    equal scores; which of them is drawn first is open. An empty table gives an empty result, an
    empty target all corpus features the same falling gain. Other columns are left behind.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scores = materialize(weights(docs, gain, id, text).withColumns(
        {"score": F.col("weight") + noise(F.col("doc_id"), seed), "eligible": F.col("n_words") >= fewest_words}), "scores")
    drawn = percent * scores.filter("eligible").count() // 100
    return ranked(scores, drawn).drop("eligible")
