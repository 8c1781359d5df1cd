"""What several corpus operators share: tables, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.session import configure, materialize

# A side of id rows is broadcast up to this many rows (32 MB of longs); beyond it the join shuffles.
BROADCAST_IDS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """The text as UTF-8, null as nothing."""
    return F.coalesce(text.cast("binary"), F.lit("").cast("binary"))


def join_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` joined with a stored table of keys, without moving the texts if the keys are few.

    ``ids`` is counted first: at most ``limit`` rows are broadcast, more are joined by a shuffle.
    Null keys match nothing: ``left_anti`` keeps their rows, ``left_semi`` drops them.
    """
    few = ids.count() <= limit
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


# A graph of up to this many links (16 MB of pairs of longs) is worked on in one task a round, without a shuffle.
FEW_LINKS = 1_000_000


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components as (node, component), component = smallest node; nodes without an edge are absent.

    ``edges`` has long columns ``a`` and ``b``. Large-star and small-star rounds until nothing changes;
    every round is one grouped minimum and one join, pre-aggregated, and is written to the shared folder.
    The links are counted each round: up to FEW_LINKS of them are one partition, more are dealt out.
    """
    now = materialize(edges.filter("a <> b").selectExpr("greatest(a, b) as hi", "least(a, b) as lo").distinct(), "links")
    last, count = None, now.count()
    for _ in range(most_rounds):
        if count <= FEW_LINKS:
            now = now.coalesce(1)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go to its minimum
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.expr("explode(array(struct(hi as hi, m as lo), struct(lo as hi, m as lo))) as e")) \
            .select("e.*").filter("hi <> lo").distinct()
        now = materialize(small, "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last, count = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    star = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.union(now.select("lo", "lo").distinct())
