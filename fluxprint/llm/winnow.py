"""Document fingerprints by winnowing, and the likeness of neighbouring documents.

The k-grams of a text's bytes are hashed by a rolling hash; of each window of ``WINDOW``
consecutive k-grams the smallest hash is chosen, the rightmost of equal ones. What two texts
share over ``GRAM + WINDOW - 1`` bytes or more therefore puts a common hash into both
fingerprints, whatever stands around it; the positions tell where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.llm.blocks import mix

GRAM = 20
WINDOW = 45
SLICE = 1 << 18
SLICES_PER_PARTITION = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _ODD_INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_POWER, _INVERSE = _powers(2 * SLICE)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """32-bit hash of the ``k`` bytes from each position on: sums of rolling powers, shifted back to position 0."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWER[:len(data)], out=total[1:])
    n = len(data) - k + 1
    return mix((total[k:] - total[:n]) * _INVERSE[:n]) >> np.uint64(32)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width`` keys, by runs of doubled length."""
    now, reach = keys, 1
    while reach < width:
        more = min(reach, width - reach)
        now = np.minimum(now[:len(now) - more], now[more:])
        reach += more
    return now


def fingerprint(data: np.ndarray, k: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Chosen k-grams in order of position, each as hash * 2^32 + position.

    A text with fewer k-grams than a window has its smallest one, a text of under ``k`` bytes the
    hash of all of it, an empty text none.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    found, last, windows = [], np.uint64(0), max(1, n - k + 1 - window + 1)
    for lo in range(0, windows, SLICE):
        hi = min(lo + SLICE, windows)
        end = min(hi + window - 1 + k - 1, n)
        hashes = grams(data[lo:end], k)
        # a later position has the smaller low half, so that it wins among equal hashes
        keys = hashes << np.uint64(32) | (_LOW - np.arange(lo, lo + len(hashes), dtype=np.uint64))
        least = sliding_least(keys, min(window, len(keys)))
        found.append(least[np.concatenate(([least[0] != last], least[1:] != least[:-1]))])
        last = least[-1]
    out = np.concatenate(found)
    return out & ~_LOW | (_LOW - (out & _LOW))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the chosen hashes of two fingerprints that both have; 1 for two empty ones."""
    x, y = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 1.0


def digest(marks: np.ndarray) -> str:
    """16 hexadecimal digits per chosen k-gram: 8 of its hash, 8 of its position in bytes."""
    return marks.astype(">u8").tobytes().hex()


def in_slices(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``slice, extra, doc_id, raw``: documents cut into slices of falling ids, each with the row that follows it.

    The cuts are ids at even shares of the table, ``SLICES_PER_PARTITION`` for each shuffle
    partition. The first row of a slice is copied to the end of the slice before it, and the very
    first row to the end of the last, with ``extra`` set; so every row has its next row in its
    slice. Rows of equal ids stand in the order of their texts, null ids after all others.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * SLICES_PER_PARTITION
    key = F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    cuts, top = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, 100 * parts), F.max("k")).first()
    bounds = sorted(set(cuts or []) - {top}, reverse=True)
    at = slice_of(F.col("_key"), bounds)
    first = F.when(F.col("_key") == F.lit(top).cast("bigint"), F.lit(len(bounds))).when(
        F.col("_slice") > 0, F.when(F.col("_key") == F.element_at(F.lit(bounds), F.greatest(F.col("_slice"), F.lit(1))), F.col("_slice") - 1)) \
        if bounds else F.when(F.col("_key") == F.lit(top).cast("bigint"), F.lit(0))
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), key.alias("_key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("raw")) \
        .withColumn("_slice", at).withColumn("_copy", first)
    own = F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("_copy").alias("slice"), F.lit(True).alias("extra"))
    dealt = rows.select("doc_id", "_key", "raw", F.explode(F.when(F.col("_copy").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_s"))
    return dealt.select("_s.slice", "_s.extra", "doc_id", "_key", "raw").repartition(max(1, parts // SLICES_PER_PARTITION), "slice") \
        .sortWithinPartitions("slice", "extra", F.col("_key").desc(), "raw").drop("_key")


def slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of the falling ``bounds`` are at or above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when(
        (lo + s <= len(bounds)) & (F.element_at(held, F.least(lo + s, F.lit(len(bounds)))) >= key), lo + s).otherwise(lo))


def edited(own: np.ndarray, following: np.ndarray) -> tuple[int, np.ndarray]:
    """Code points of ``own``, and its bytes with the last half of them replaced by the first ones of ``following``."""
    begins = np.flatnonzero((own & 0xC0) != 0x80)
    n = len(begins)
    moved = n // 2
    head = own[:begins[n - moved]] if moved else own
    other = np.flatnonzero((following & 0xC0) != 0x80) if moved else begins
    tail = following[:other[moved]] if moved and len(other) > moved else following if moved else following[:0]
    return n, np.concatenate((head, tail))


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of an edited form, and their likeness and that to the next document.

    The next document is the one with the next smaller id, for the smallest the one with the
    largest; the edited form ends in the next document's first code points, as many as the half
    that they replace, or all. Columns: ``doc_id, n_chars, edited_sha256, marks, edited_marks,
    near_edited, near_next``, marks as arrays of hash * 2^32 + position
    (64 bits as Spark's signed long). A null text is empty; two
    empty fingerprints are alike. A table of one row is its own next; an empty table gives no rows.
    Columns besides the two are left behind.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                     # slice, id, bytes and fingerprint of the row before
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "marks", "edited_marks", "near_edited", "near_next")}
            for i in range(len(batch)):
                where, extra = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                marks = fingerprint(own)
                if held is not None and held[0] == where:
                    n, form = edited(held[2], own)
                    changed = fingerprint(form)
                    row = (held[1], n, hashlib.sha256(form).hexdigest(), held[3].view(np.int64), changed.view(np.int64), likeness(held[3], changed), likeness(held[3], marks))
                    for c, value in zip(out, row):
                        out[c].append(value)
                # a copied row ends its slice; copies after it belong to rows of the same id
                held = None if extra else (where, batch.column(2)[i], own.copy(), marks)
            if out["doc_id"]:
                types = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in v] if c == "doc_id" else v, t) for (c, v), t in zip(out.items(), types)], names=list(out))

    rows = in_slices(docs, id, text)
    return rows.mapInArrow(compare, f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars bigint, edited_sha256 string, marks array<bigint>, "
                                    "edited_marks array<bigint>, near_edited double, near_next double")


def digests(marks: Column) -> Column:
    """:func:`digest` of a column of marks."""
    return F.array_join(F.transform(marks, lambda m: F.lower(F.lpad(F.hex(m), 16, "0"))), "")
