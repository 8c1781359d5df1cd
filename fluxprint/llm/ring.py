"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. A row falls into the cell of its key's hash and belongs to the
first virtual node at or after it; the rows between two virtual nodes form an arc. A shard
takes rows of its own arcs while it has room, in ring order; the rest continues clockwise to
the next virtual node whose shard has room. As this needs only the *number* of rows per cell,
the walk is planned from at most ``CELLS`` counts, whatever the number of rows, and each row
then finds its shard by its rank within its arc.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16


def nodes(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and shard of each virtual node, in ring order; a taken cell passes the node on to the next free one."""
    if not 0 < shards * vnodes <= CELLS // 2:
        raise ValueError(f"shards * vnodes must be within 1 and {CELLS // 2}")
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    cells = np.array(sorted(taken))
    return cells, np.array([taken[c] for c in cells])


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    """Rows that each shard may hold; without slack they add up to ``rows``, so that all shards end full."""
    if slack:
        return np.full(shards, int(np.ceil(rows / shards * (1 + slack))))
    return rows // shards + (np.arange(shards) < rows % shards)


def walk(arc_rows: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of each run of rows that stays together."""
    room, used, out, left = room.copy(), np.zeros(len(room), np.int64), [], []

    def give(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, int(room[shard]))
        if n > 0:
            out.append((arc, lo, lo + n, shard, int(used[shard])))
            room[shard] -= n
            used[shard] += n
        return lo + n

    for a in range(len(owner)):
        at = give(a, 0, int(arc_rows[a]), int(owner[a]))
        if at < arc_rows[a]:
            left.append((a, at, int(arc_rows[a])))
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for piece in left:
        waiting.setdefault((piece[0] + 1) % len(owner), []).append(piece)
    for step in range(2 * len(owner) + 1):
        a = step % len(owner)
        for arc, lo, hi in waiting.pop(a, []):
            lo = give(arc, lo, hi, int(owner[a]))
            if lo < hi:
                waiting.setdefault((a + 1) % len(owner), []).append((arc, lo, hi))
    assert not waiting, "the shards together hold all rows"
    return out


def bounded_ring(df: DataFrame, key: str = "doc_id", tie: str = "text", shards: int = 24, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within the shard).

    Without slack, shards differ by one row at most. With slack e, no shard holds more than
    (1 + e) times the mean, and fewer rows move when the number of shards changes.
    Null keys are spread over the ring by text and position in the input. Equal keys share a
    cell; among equal rows any may take either slot. An empty table gives an empty result;
    columns of the input that are named shard or slot are replaced.
    """
    spot = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(
        F.xxhash64(F.col(tie), F.monotonically_increasing_id()))
    cell = F.shiftrightunsigned(spot, 48).cast("int")
    counts = np.zeros(CELLS, np.int64)
    for c, n in df.select(cell.alias("c")).groupBy("c").count().collect():  # CELLS rows at most
        counts[c] = n
    at, owner = nodes(shards, vnodes)
    arc = np.searchsorted(at, np.arange(CELLS)) % len(at)
    order = np.lexsort((np.arange(CELLS), np.where(np.arange(CELLS) > at[-1], 0, 1), arc))  # the last arc's cells begin before cell 0
    before = np.zeros(CELLS, np.int64)
    running = np.cumsum(counts[order]) - counts[order]
    arc_rows = np.bincount(arc, counts, len(at)).astype(np.int64)
    before[order] = running - (np.cumsum(arc_rows) - arc_rows)[arc[order]]
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for a, lo, hi, shard, slot in walk(arc_rows, owner, capacities(int(counts.sum()), shards, slack)):
        runs.setdefault(a, []).append((lo, hi, shard, slot))
    plan = pd.DataFrame({"_cell": np.arange(CELLS), "_before": before, "_runs": [runs.get(a, []) for a in arc]})[counts > 0]
    table = df.sparkSession.createDataFrame(
        plan, "_cell int, _before bigint, _runs array<struct<lo: bigint, hi: bigint, shard: int, slot: bigint>>")
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct("*").alias("_row"), cell.alias("_cell"), spot.alias("_spot"), F.xxhash64(tie).alias("_tie"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_cell").orderBy("_spot", f"_row.{key}", "_tie")))
    placed = ranked.join(F.broadcast(table), "_cell").withColumn("_rank", F.col("_before") + F.col("_n") - 1) \
        .withColumn("_run", F.expr("filter(_runs, r -> _rank >= r.lo and _rank < r.hi)[0]"))
    return placed.select(*kept, F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_rank") - F.col("_run.lo")).alias("slot"))
