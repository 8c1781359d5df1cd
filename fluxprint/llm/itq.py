"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Principal axes and a rotation that balances the binary codes are learned from a bounded sample;
every vector is coded. A table per chunk of the code holds all vectors under their chunk; a
vector looks up its own chunk and all within PROBE_BITS of it, so two codes that differ in at
most TABLES * (PROBE_BITS + 1) - 1 bits always meet, and most of those that differ in more.
What meets within MOST_BITS is compared by the cosine of the original vectors in doubles.

Equal vectors are folded first, so that a vector repeated by a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm.common import components
from fluxprint.session import materialize

COSINE = 0.95
SAMPLE = 8192
ROTATIONS = 40
BITS = 64
TABLES = 4
PROBE_BITS = 1
MOST_BITS = 14            # of 64 that may differ: at cosine 0.95 about 6.5 do, with a deviation of 2.5


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the matrix from vectors to code values: principal axes, then the rotation that fits their signs best."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    width = sample.shape[1]
    _, _, axes = np.linalg.svd(np.cov((sample - mean).T) if len(sample) > 1 else np.eye(width))
    basis = axes[:min(bits, width)].T
    if width < bits:  # fewer axes than bits: further random directions
        basis = np.hstack((basis, np.random.default_rng(1).standard_normal((width, bits - width))))
    reduced = (sample - mean) @ basis
    turn, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((bits, bits)))
    for _ in range(rounds if len(sample) else 0):
        left, _, right = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced)
        turn = (left @ right).T
    return mean, basis @ turn


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): double vectors without null or non-finite components and not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.expr("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    return vectors.select(F.col("vec_id").cast("bigint"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine)


def coded(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, matrix = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch.column(0)), -1)
            x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            bits = (x - mean) @ matrix >= 0
            code = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code)], names=["vec_id", "v", "code"])

    return rows.mapInArrow(scan, "vec_id bigint, v array<double>, code bigint")


def candidates(codes: DataFrame) -> DataFrame:
    """Pairs (a < b) of (vec_id, code) rows that meet in a table and differ in MOST_BITS at most."""
    width = BITS // TABLES
    chunk = lambda t: f"(shiftrightunsigned(code, {t * width}) & {(1 << width) - 1})"
    masks = [0] + [1 << i for i in range(width)]
    if PROBE_BITS > 1:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    tables = ", ".join(f"struct({t} as t, {chunk(t)} as c)" for t in range(TABLES))
    held = codes.select("vec_id", "code", F.expr(f"explode(array({tables})) as k")).select("k.t", "k.c", F.col("vec_id").alias("b"), F.col("code").alias("code_b"))
    flips = ", ".join(f"{m}L" for m in masks)
    asking = codes.select("vec_id", "code", F.expr(f"explode(array({tables})) as k")) \
        .select("vec_id", "code", "k.t", F.expr(f"explode(transform(array({flips}), m -> k.c ^ m)) as c")) \
        .select("t", "c", F.col("vec_id").alias("a"), F.col("code").alias("code_a"))
    near = asking.join(held, ["t", "c"]).filter(f"a < b and bit_count(code_a ^ code_b) <= {MOST_BITS}")
    return near.select("a", "b").distinct()


def cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch.column(0)):
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch.column(0)), -1) for i in (2, 3))
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], names=["a", "b", "cosine"]).filter(pa.array(cos >= COSINE))

    both = pairs.join(rows.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a") \
        .join(rows.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")
    return both.mapInArrow(scan, "a bigint, b bigint, cosine double")


def near_vectors(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector id.

    Null, zero and non-finite vectors and those with null components link with nothing, nor do vectors of
    different lengths. Equal vectors are links of each other. Rows with a null id are left out; of repeated rows of
    an id the first vector in order counts.
    """
    ids = vectors.select(F.col("vec_id").cast("bigint")).filter("vec_id is not null").distinct()
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    keyed = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
    keyed = materialize(keyed.select(F.col("first").alias("vec_id"), "v", "members"), "vectors")
    links = None
    for (width,) in keyed.select(F.size("v")).distinct().collect():  # one model per length of vectors
        same = keyed.filter(F.size("v") == width)
        picked = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
        grid = np.array([np.asarray(v) for v in picked], np.float64).reshape(-1, width)
        grid = grid / np.abs(grid).max(1, keepdims=True)
        codes = materialize(coded(same.select("vec_id", "v"), learn(grid / np.linalg.norm(grid, axis=1, keepdims=True))), "codes")
        found = cosines(candidates(codes.select("vec_id", "code")), codes)
        links = found if links is None else links.union(found)
    if links is None:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = materialize(links.select("a", "b"), "links")
    part = components(links)
    weight = keyed.select("vec_id", "members")
    sides = links.select(F.col("a").alias("vec_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = sides.join(weight.withColumnRenamed("vec_id", "other"), "other").groupBy("vec_id").agg(F.sum("members").alias("others"))
    folded = keyed.join(degree, "vec_id", "left").join(part, F.col("vec_id") == F.col("node"), "left").select(
        "v", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    at = rows.join(folded, "v").select("vec_id", "n_links", "component_id")
    return ids.join(at, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                                                 F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
