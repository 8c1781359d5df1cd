"""Benchmark decontamination by template canonicalisation.

Words become tokens: a run of numbers is one NUMBER, a run of capitalised words one NAME, a
unit word after a number a UNIT, every other word itself. Windows of ``WINDOW`` tokens of
documents and benchmark items are equal if their templates are, whatever fills the slots. A
document holds an item if at one alignment it has at least ``COVERAGE`` of the item's windows
and the slots agree: each filling of the item stands for one filling of the document. So a
question whose numbers or names were exchanged is found, and a chance match of templates with
mixed fillings is not.

Only windows whose hash occurs in the benchmark leave the scan. The benchmark's hashes are
broadcast in slices of at most ``MOST_WINDOWS``; a larger benchmark takes one scan per slice.
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

WINDOW = 5
LEAST_LITERALS = 2
COVERAGE = 0.8
MOST_WINDOWS = 1 << 22

# Unit words, lower-case.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "g", "kg", "mg", "lb", "pounds", "ton", "tons", "ml", "l",
         "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "v", "w", "kw",
         "hz", "mb", "gb")

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3


def unit_hashes() -> np.ndarray:
    text = " ".join(UNITS).encode()
    data = np.frombuffer(text, np.uint8)
    return np.sort(blocks.words(data, np.array([0, len(data)]))[2])


def tokens(data: np.ndarray, at: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, filling hash and template hash of each token, and the first token of each document (with an end)."""
    starts, ends, hashes, first = blocks.words(data, at)
    if not len(starts):
        return np.zeros(0, np.int8), hashes, hashes, first
    lead = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    kind = np.where((lead >= 48) & (lead <= 57), NUMBER, np.where(upper, NAME, LITERAL)).astype(np.int8)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    after_number = np.concatenate(([False], (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])))
    spot = np.searchsorted(units, hashes)
    is_unit = units[np.minimum(spot, len(units) - 1)] == hashes
    kind[after_number & is_unit & (kind != NUMBER)] = UNIT
    joins = np.concatenate(([False], (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))))
    heads = np.flatnonzero(~joins)
    # the filling of a run: its words in order
    place = np.arange(len(joins)) - np.repeat(heads, np.diff(np.append(heads, len(joins))))
    filling = np.add.reduceat(blocks.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), heads)
    kind = kind[heads]
    template = np.where(kind == LITERAL, hashes[heads], kind.astype(np.uint64))
    return kind, filling, template, np.searchsorted(heads, first)


def windows(data: np.ndarray, at: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, position, window hash, start token) of all windows with enough literals, and (kind, filling) of the tokens."""
    kind, filling, template, first = tokens(data, at, units)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes = blocks.runs(template, WINDOW)
    literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    n = len(hashes)
    start = np.flatnonzero((doc[:n] == doc[WINDOW - 1:]) & (literal[WINDOW:] - literal[:-WINDOW] >= LEAST_LITERALS)) if n else np.zeros(0, np.int64)
    return doc[start], start - first[doc[start]], hashes[start].view(np.int64), start, kind, filling


FOUND = "window bigint, position int, slots array<bigint>"


def _slots(start: np.ndarray, kind: np.ndarray, filling: np.ndarray) -> pa.Array:
    """Per window the fillings of its tokens, 0 for literals."""
    grid = start[:, None] + np.arange(WINDOW)
    values = np.where(kind[grid] == LITERAL, np.uint64(0), filling[grid]).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, WINDOW, dtype=np.int32), pa.array(values.ravel(), pa.int64()))


def cut(df: DataFrame, key: str, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, window, position, slots) of the windows of each row, or only of those whose hash is wanted."""
    units = unit_hashes()
    held = None
    if wanted is not None:
        seen = np.zeros(1 << 22, bool)
        seen[wanted & ((1 << 22) - 1)] = True
        held = df.sparkSession.sparkContext.broadcast((wanted, np.packbits(seen)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = (None, None) if held is None else (held.value[0], np.unpackbits(held.value[1]).view(bool))
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                doc, position, hashes, start, kind, filling = windows(data, at, units)
                if table is not None:
                    hit = np.flatnonzero(bits[hashes & ((1 << 22) - 1)])
                    hit = hit[table[np.minimum(np.searchsorted(table, hashes[hit]), len(table) - 1)] == hashes[hit]] if len(table) else hit[:0]
                    doc, position, hashes, start = doc[hit], position[hit], hashes[hit], start[hit]
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(hashes), pa.array(position.astype(np.int32)),
                         _slots(start, kind, filling)], names=[key, "window", "position", "slots"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text)).mapInArrow(scan, f"{key} bigint, {FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, slots, reparameterised): a row per document and item it holds.

    Null and empty texts hold nothing, and items of fewer than ``WINDOW`` tokens or without a window
    of ``LEAST_LITERALS`` literals cannot be judged. Repeated rows of an id count as one.
    Of several alignments the fullest is told. ``reparameterised`` says that a filling differs.
    """
    asked = materialize(cut(benchmark, "item_id", "text"), "template-windows")
    hashes = asked.select("window").distinct()
    parts = max(1, -(-hashes.count() // most_windows))
    hits = None
    for part in range(parts):
        mine = hashes.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        wanted = np.sort(np.array([r[0] for r in mine.toLocalIterator()], np.int64))
        found = cut(docs, "doc_id", "text", wanted)
        hits = found if hits is None else hits.union(found)
    size = asked.groupBy("item_id").agg(F.countDistinct("position").alias("item_windows"))
    ours = asked.select("item_id", "window", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    aligned = hits.join(ours, "window").withColumn("shift", F.col("position") - F.col("item_position"))
    # the sets are bounded by the length of an item
    pairs = F.array_distinct(F.flatten(F.collect_set(F.expr("filter(arrays_zip(item_slots, slots), s -> s.item_slots <> 0)"))))
    at = aligned.groupBy("doc_id", "item_id", "shift").agg(F.size(F.collect_set("item_position")).alias("windows"), pairs.alias("pairs"))
    judged = at.join(size, at["item_id"].eqNullSafe(size["item_id"])).drop(size["item_id"]).withColumns({
        "coverage": F.col("windows") / F.col("item_windows"),
        "slots": F.expr("size(array_distinct(transform(pairs, p -> p.item_slots)))")})
    good = judged.filter((F.col("coverage") >= COVERAGE) & (F.size("pairs") == F.col("slots")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "windows", "item_windows", "coverage", "slots", F.expr("exists(pairs, p -> p.item_slots <> p.slots)").alias("reparameterised"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, all columns as they are; rows with a null id stay."""
    bad = materialize(leaks(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct(), "leaking")
    return join_ids(docs, bad, "left_anti").select(*docs.columns)
