"""Causal per-window device features from interval telemetry and an inventory.

A feature that was not observed is NULL: the table has no separate mask. All
features of an unavailable window are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.functions.ordered import growing, unfolded
from fluxprint.functions.scalars import service_category, signed_log_ratio
from fluxprint.operators import identity
from fluxprint.schemas import Clock

KEYS = ["device", "window_start"]
EPOCH = ["device", "epoch"]

# Features that an idle but observed window has as zero; all others are NULL.
ZERO_WHEN_IDLE = [
    "tx_ip_bytes", "rx_ip_bytes", "tx_packets", "rx_packets", "active_flows", "initiated_flows", "inbound_flows",
    "unique_destinations", "unique_destination_ports", "log_tx_rx_ratio", "local_tx_ip_bytes", "external_tx_ip_bytes",
    "local_rx_ip_bytes", "external_rx_ip_bytes", "flow_burst_max_10s", "stream_count_1h", "stream_max_starts_1h",
    "unique_initiators", "unique_inbound_ports", "outgoing_local_peer_count", "incoming_local_peer_count",
    "initiator_fanout_context"]


@dataclass(frozen=True)
class Minutes:
    """Endpoint view and dense grid of one set of captures."""

    view: DataFrame
    grid: DataFrame
    clock: Clock


def window_over(minutes: Minutes, first: int, last: int, keys: Sequence[str] = EPOCH):
    """Frame counted in windows relative to the current one."""
    step = minutes.clock.window
    return Window.partitionBy(*keys).orderBy("window_start").rangeBetween(first * step, last * step)


# F17, G1
def dense_grid(devices: DataFrame, start: int, end: int, outages: DataFrame, clock: Clock, spans: DataFrame | None = None) -> DataFrame:
    """Every device in every window, its availability and its memory epoch.

    ``spans`` are what makes up the devices' identities (see ``identity.identity_marks``). A changed
    identity ends the epoch, and begins another ``lifetime``, whose memory knows nothing of the last one.
    """
    step = clock.window
    cells = devices.select("device", "device_type", F.explode(
        F.sequence(F.lit(start).cast("bigint"), F.lit(end - step).cast("bigint"), F.lit(step).cast("bigint"))).alias("window_start"))
    dark = outages.select("device", F.explode(F.sequence(
        (F.floor(F.col("start") / step) * step).cast("bigint"), (F.floor((F.col("end") - 1) / step) * step).cast("bigint"),
        F.lit(step).cast("bigint"))).alias("window_start")).distinct()
    marked = (cells.join(growing(dark.withColumn("_dark", F.lit(True))), KEYS, "left")
              .withColumn("available", F.col("_dark").isNull()).drop("_dark"))
    if spans is None:
        return ordered.availability_epochs(marked, ["device"], "window_start", step).withColumn("lifetime", F.lit(0).cast("bigint"))
    marks = identity.identity_marks(spans, step).withColumn("window_start", F.greatest("window_start", F.lit(start).cast("bigint")))
    marks = marks.groupBy(*KEYS).agg(F.bit_xor("mark").alias("_mark"))
    upto = Window.partitionBy("device").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    told = marked.join(growing(marks), KEYS, "left").withColumn("_identity", F.coalesce(F.bit_xor("_mark").over(upto), F.lit(0)))
    lived = ordered.availability_epochs(told, ["device"], "window_start", step, identity="_identity")
    before = F.lag("_identity").over(Window.partitionBy("device").orderBy("window_start"))
    changed = F.coalesce(before != F.col("_identity"), F.lit(False)).cast("int")
    return lived.withColumn("_changed", changed).withColumn("lifetime", F.sum("_changed").over(upto)).drop("_mark", "_identity", "_changed")


def endpoint_view(flows: DataFrame, *kept: str) -> DataFrame:
    """Each interval row once per resolved end, in one pass over the rows.

    A row whose two ends are the same device is seen from its origin only. ``kept`` names more
    columns that pass through.
    """
    def side(originated: bool) -> Column:
        me, other = ("orig", "resp") if originated else ("resp", "orig")
        return F.struct(
            F.col(f"{me}_device").alias("device"), F.lit(originated).alias("originated"),
            F.col(f"{other}_device").alias("peer_device"), F.col(f"{other}_h").alias("peer_address"),
            F.col(f"{me}_ip_bytes").alias("tx_bytes"), F.col(f"{other}_ip_bytes").alias("rx_bytes"),
            F.col(f"{me}_pkts").alias("tx_pkts"), F.col(f"{other}_pkts").alias("rx_pkts"))

    received = F.when(~F.col("resp_device").eqNullSafe(F.col("orig_device")), side(False))
    ends = F.filter(F.array(side(True), received), lambda e: e["device"].isNotNull())
    rows = flows.select("window_start", "uid", "proto", F.col("resp_p").alias("port"), "flow_start", "new_flow",
                        F.col("observed_duration").alias("duration"), "established", "failed", *kept, F.explode(ends).alias("e"))
    return rows.select("window_start", "uid", "proto", "port", "flow_start", "new_flow", "duration", "established",
                       "failed", *kept, "e.*").withColumn("local", F.col("peer_device").isNotNull())


def on_grid(minutes: Minutes, *tables: DataFrame) -> DataFrame:
    """Join per-cell tables to the grid; idle counts are zero, dark cells NULL."""
    joined = reduce(lambda acc, t: acc.join(unfolded(t), KEYS, "left"), tables, minutes.grid)
    base = minutes.grid.columns
    out = []
    for c in joined.columns:
        if c in base:
            out.append(F.col(c))
            continue
        value = F.coalesce(F.col(c), F.lit(0)) if c in ZERO_WHEN_IDLE else F.col(c)
        out.append(F.when(F.col("available"), value).alias(c))
    return joined.select(*out)


def share_of_rows(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


# F1, F3, F5
def volume(minutes: Minutes) -> DataFrame:
    """All sums and fractions of a cell from one partial aggregate."""
    orig, new, local = F.col("originated"), F.col("new_flow"), F.col("local")
    tx, rx = F.sum("tx_bytes"), F.sum("rx_bytes")
    service = service_category(F.col("proto"), F.col("port"))
    decided = orig & (F.col("proto") == "tcp") & (F.col("failed") | F.col("established"))
    initiated = F.count_if(orig & new)

    def when_sum(condition: Column, c: str) -> Column:
        return F.sum(F.when(condition, F.col(c)).otherwise(0))

    return minutes.view.groupBy(*KEYS).agg(
        tx.alias("tx_ip_bytes"), rx.alias("rx_ip_bytes"), F.sum("tx_pkts").alias("tx_packets"),
        F.sum("rx_pkts").alias("rx_packets"), F.count(F.lit(1)).alias("active_flows"),
        initiated.alias("initiated_flows"), F.count_if(~orig & new).alias("inbound_flows"),
        *[share_of_rows(F.col("proto") == p).alias(f"{p}_fraction") for p in ("tcp", "udp", "icmp")],
        F.avg(F.when(decided, F.col("failed").cast("double"))).alias("tcp_failed_fraction"),
        F.avg("duration").alias("mean_observed_flow_duration"),
        signed_log_ratio(tx, rx).alias("log_tx_rx_ratio"),
        when_sum(local, "tx_bytes").alias("local_tx_ip_bytes"), when_sum(~local, "tx_bytes").alias("external_tx_ip_bytes"),
        when_sum(local, "rx_bytes").alias("local_rx_ip_bytes"), when_sum(~local, "rx_bytes").alias("external_rx_ip_bytes"),
        share_of_rows(~local).alias("external_flow_fraction"),
        *[share_of_rows(service == s).alias(f"{s}_flow_fraction") for s in ("web", "tls", "dns")],
        share_of_rows(service.startswith("other_")).alias("other_service_flow_fraction"),
        stats.ratio(tx, initiated).alias("tx_bytes_per_initiated_flow"))


# F3
def median_duration(minutes: Minutes) -> DataFrame:
    """A cell may hold any number of flows, so this is the distributed median.

    Cells are many and mostly small, so one level of refinement is enough.
    """
    return stats.quantiles(minutes.view, KEYS, "duration", {"median_observed_flow_duration": 0.5}).drop("n")


# F2
def destination_ports(minutes: Minutes) -> DataFrame:
    mine = minutes.view.filter(F.col("originated") & F.col("proto").isin("tcp", "udp") & F.col("port").isNotNull())
    per_port = mine.groupBy(*KEYS, "proto", "port").agg(F.count(F.lit(1)).alias("n"))
    return per_port.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_destination_ports"),
                                       stats.entropy_of_counts(F.col("n")).alias("destination_port_entropy"))


# F2, F4, G4
def destinations(minutes: Minutes, memory: DataFrame | None = None) -> DataFrame:
    """Distinct destinations, and the share of rows towards unseen ones.

    Only available windows enter the memory. An outage does not clear it, a changed identity does.
    ``memory`` holds what earlier windows outside this table have seen, as
    ``device, peer_address, first_seen``.
    """
    per_peer = (minutes.view.filter("originated").groupBy(*KEYS, "peer_address").agg(F.count(F.lit(1)).alias("n"))
                .join(unfolded(minutes.grid).select(*KEYS, "available", "lifetime"), KEYS))
    first = F.min(F.when(F.col("available"), F.col("window_start"))).over(Window.partitionBy("device", "lifetime", "peer_address"))
    if memory is not None:
        per_peer = per_peer.join(growing(memory), ["device", "peer_address"], "left")
        first = F.least(first, F.col("first_seen"))
    marked = per_peer.withColumn("new", first.isNull() | (first >= F.col("window_start")))
    return marked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("unique_destinations"),
        (F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)) / F.sum("n")).alias("new_destination_fraction"))


def starts(minutes: Minutes) -> DataFrame:
    """New flows that a device opened in available windows, with their epoch."""
    return (minutes.view.filter(F.col("originated") & F.col("new_flow"))
            .join(unfolded(minutes.grid).filter("available").select(*KEYS, "epoch"), KEYS)
            .select(*KEYS, "epoch", "flow_start", F.col("peer_address").alias("peer"), "proto", "port"))


def window_gaps(minutes: Minutes, extra: Sequence[str] = ()) -> DataFrame:
    """Positive gaps between starts of a device (or of one of its streams).

    A gap belongs to the window of its later start; the earlier one may lie in
    any window of the same epoch.
    """
    keys = [*EPOCH, *extra]
    step = minutes.clock.window
    points = ordered.consecutive_points(starts(minutes), keys, "flow_start", minutes.clock.burst_slot)
    return points.select(*keys, (F.floor(F.col("flow_start") / step) * step).cast("bigint").alias("window_start"),
                         "flow_start", "n", "prev_t", (F.col("flow_start") - F.col("prev_t")).alias("gap"))


def variation(n: Column, total: Column, squares: Column) -> Column:
    """Population coefficient of variation from a count, a sum and a sum of squares."""
    mean = total / n
    return F.when((n > 1) & (mean > 0), F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean)


# F6
def gap_features(minutes: Minutes) -> DataFrame:
    """Gaps of a window's starts, the last earlier start within the horizon included."""
    horizon = minutes.clock.long * minutes.clock.window
    near = F.col("prev_t") >= F.col("window_start") - horizon
    gap = F.when(near, F.col("gap"))
    mean = F.avg(gap)
    return window_gaps(minutes).groupBy(*KEYS).agg(
        mean.alias("flow_gap_mean"),
        F.when((F.count(gap) > 1) & (mean > 0), F.stddev_pop(gap) / mean).alias("flow_gap_cv"),
        F.min(gap).alias("flow_gap_min"))


# F7
def bursts(minutes: Minutes) -> DataFrame:
    slot = F.floor((F.col("flow_start") - F.col("window_start")) / F.lit(minutes.clock.burst_slot))
    per_slot = starts(minutes).groupBy(*KEYS, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return per_slot.groupBy(*KEYS).agg(F.max("n").alias("flow_burst_max_10s"))


# F8
def rolling_means(minutes: Minutes, cells: DataFrame) -> DataFrame:
    """Means over strictly earlier windows of the epoch, and the change against them."""
    short = window_over(minutes, -minutes.clock.short, -1)
    long = window_over(minutes, -minutes.clock.long, -1)
    tx, flows = F.col("tx_ip_bytes"), F.col("active_flows")
    usable = cells.filter("available")
    means = usable.select(*KEYS, tx, F.avg(tx).over(short).alias("rolling_tx_mean_5m"),
                          F.avg(tx).over(long).alias("rolling_tx_mean_15m"),
                          F.avg(flows).over(short).alias("rolling_flows_mean_5m"))
    return means.select(
        *KEYS, "rolling_tx_mean_5m", "rolling_tx_mean_15m", "rolling_flows_mean_5m",
        signed_log_ratio(tx, F.col("rolling_tx_mean_5m")).alias("log_tx_change_5m"),
        signed_log_ratio(tx, F.col("rolling_tx_mean_15m")).alias("log_tx_change_15m"))


# F9
def rolling_gap_variation(minutes: Minutes) -> DataFrame:
    """Variation of all gaps whose two starts lie in the long horizon.

    Sums of per-window gap moments slide over the grid. Only the earliest gap in
    a frame can reach back across the frame's edge, so that one is taken off
    again and no start is ever joined with another.
    """
    horizon = minutes.clock.long * minutes.clock.window
    per = window_gaps(minutes).groupBy(*EPOCH, "window_start").agg(
        F.count("gap").alias("_n"), F.sum("gap").alias("_s"), F.sum(F.col("gap") * F.col("gap")).alias("_q"),
        F.min(F.struct("flow_start", "prev_t", "gap")).alias("_head"))
    rows = minutes.grid.filter("available").select(*KEYS, "epoch").join(unfolded(per), [*EPOCH, "window_start"], "left")
    frame = window_over(minutes, -minutes.clock.long, 0)
    slid = rows.select(
        *KEYS, *[F.sum(c).over(frame).alias(c) for c in ("_n", "_s", "_q")],
        F.first("_head", ignorenulls=True).over(frame).alias("_head"))
    crossing = F.col("_head.prev_t") < F.col("window_start") - horizon
    g = F.when(crossing, F.col("_head.gap")).otherwise(0.0)
    return slid.select(*KEYS, variation(
        F.col("_n") - F.when(crossing, 1).otherwise(0), F.col("_s") - g, F.col("_q") - g * g).alias("rolling_gap_cv_15m"))


# F10
def stream_features(minutes: Minutes) -> DataFrame:
    """Regularity of each (peer, proto, port) stream over the stream horizon.

    Starts are folded per stream and window first. What a stream looks like within the horizon
    changes only when a folded row enters it or, a horizon later, leaves it; between two such turns
    it stands still. A stretch is cut into the few dyadic nodes that make it up, and a window asks
    the nodes it lies in, one per level: no row is repeated for each window that can see it.
    """
    clock, step = minutes.clock, minutes.clock.window
    stream, horizon, levels = ["peer", "proto", "port"], clock.stream * step, (clock.stream + 1).bit_length()
    per = window_gaps(minutes, stream).groupBy(*EPOCH, *stream, "window_start").agg(
        F.sum("n").alias("_starts"), F.count("gap").alias("_n"), F.sum("gap").alias("_s"),
        F.sum(F.col("gap") * F.col("gap")).alias("_q"), F.min(F.struct("flow_start", "prev_t", "gap")).alias("_head"))
    turn = F.explode(F.array(F.struct(F.col("window_start").alias("at"), F.lit(True).alias("enters")),
                             F.struct((F.col("window_start") + horizon + step).alias("at"), F.lit(False).alias("enters"))))
    turns = per.withColumn("_turn", turn)
    only = lambda c: F.when(F.col("_turn.enters"), F.col(c))
    sums = ["_starts", "_n", "_s", "_q"]
    folded = turns.groupBy(*EPOCH, *stream, F.col("_turn.at").alias("window_start")).agg(*[F.sum(only(c)).alias(c) for c in sums], F.min(only("_head")).alias("_head"))
    order = Window.partitionBy(*EPOCH, *stream).orderBy("window_start")
    frame = order.rangeBetween(-horizon, 0)
    one = folded.select(*KEYS, "epoch", *[F.sum(c).over(frame).alias(c) for c in sums], F.min("_head").over(frame).alias("_head"),
                        F.lead("window_start").over(order).alias("_next")).filter("_starts > 0")
    crossing = F.col("_head.prev_t") < F.col("window_start") - horizon
    g = F.when(crossing, F.col("_head.gap")).otherwise(0.0)
    n = F.col("_n") - F.when(crossing, 1).otherwise(0)
    cv = F.when(n >= 4, variation(n, F.coalesce("_s", F.lit(0.0)) - g, F.coalesce("_q", F.lit(0.0)) - g * g))
    nodes = ordered.cover(F.col("window_start") / step, F.col("_next") / step, levels)
    stretches = one.select(*EPOCH, "_starts", cv.alias("_cv"), F.col("_head.flow_start").alias("_first"), F.explode(nodes).alias("_node"))
    held = stretches.groupBy(*EPOCH, "_node").agg(
        F.count(F.lit(1)).alias("_streams"), F.max("_starts").alias("_most"), F.sum("_starts").alias("_all"), F.min("_cv").alias("_least"),
        F.count_if(F.col("_cv") < 0.1).alias("_even"), F.count("_cv").alias("_told"), F.min("_first").alias("_first"))
    asked = minutes.grid.filter("available").select(*KEYS, "epoch", F.explode(ordered.nodes_over(F.col("window_start") / step, levels)).alias("_node"))
    return unfolded(asked).join(held, [*EPOCH, "_node"]).groupBy(*KEYS).agg(
        F.sum("_streams").alias("stream_count_1h"), F.max("_most").alias("stream_max_starts_1h"), F.min("_least").alias("stream_min_gap_cv_1h"),
        (F.sum("_even") / F.nullif(F.sum("_told"), F.lit(0))).alias("stream_periodic_fraction_1h"),
        (F.col("window_start") + step - F.min("_first")).alias("stream_max_age_seconds_1h"),
        (F.max("_most") / F.sum("_all")).alias("stream_top_start_fraction_1h"))


def inbound_outcome(minutes: Minutes) -> tuple[DataFrame, DataFrame]:
    """What a window alone tells of the rows that reach a device: outcome and row count, and distinct ports."""
    inbound = minutes.view.filter(~F.col("originated"))
    decided = (F.col("proto") == "tcp") & (F.col("failed") | F.col("established"))
    outcome = inbound.groupBy(*KEYS).agg(
        F.avg(F.when(decided, F.col("failed").cast("double"))).alias("inbound_failed_fraction"),
        F.count(F.lit(1)).alias("_rows"))
    ports = (inbound.filter(F.col("proto").isin("tcp", "udp") & F.col("port").isNotNull())
             .groupBy(*KEYS, "proto", "port").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_inbound_ports")))
    return outcome, ports


# F11
def receiver(minutes: Minutes, cells: DataFrame) -> DataFrame:
    """What reaches a device; its memory of initiators ends with the epoch."""
    inbound = minutes.view.filter(~F.col("originated"))
    outcome, ports = inbound_outcome(minutes)
    per_peer = inbound.groupBy(*KEYS, "peer_address").agg(F.count(F.lit(1)).alias("n")).join(
        unfolded(minutes.grid).filter("available").select(*KEYS, "epoch"), KEYS)
    first = F.min("window_start").over(Window.partitionBy(*EPOCH, "peer_address"))
    peers = (per_peer.withColumn("_new", first == F.col("window_start")).groupBy(*KEYS)
             .agg(F.count(F.lit(1)).alias("unique_initiators"),
                  F.avg(F.col("_new").cast("double")).alias("new_initiator_fraction")))
    mean = F.avg("inbound_flows").over(window_over(minutes, -minutes.clock.short, -1))
    change = cells.filter("available").select(
        *KEYS, "active_flows", signed_log_ratio(F.col("inbound_flows"), mean).alias("inbound_flows_change_5m"))
    joined = reduce(lambda acc, t: acc.join(unfolded(t), KEYS, "left"), (outcome, peers, ports), change)
    return joined.select(
        *KEYS, "unique_initiators", "new_initiator_fraction", "unique_inbound_ports", "inbound_failed_fraction",
        F.when(F.col("active_flows") > 0, F.coalesce("_rows", F.lit(0)) / F.col("active_flows")).alias("inbound_flow_fraction"),
        "inbound_flows_change_5m")


PEER_SERVICE = ["device", "direction", "peer", "proto", "port"]


def peer_services(minutes: Minutes) -> DataFrame:
    """Rows per window, direction and (peer, proto, port); the peer is a device if known."""
    direction = F.when(F.col("originated"), "out").otherwise("in")
    return minutes.view.groupBy(
        "window_start", "device", direction.alias("direction"),
        F.coalesce("peer_device", "peer_address").alias("peer"), "proto",
        F.coalesce("port", F.lit(-1)).alias("port")).agg(F.count(F.lit(1)).alias("n"))


def flow_profile(peer_rows: DataFrame) -> DataFrame:
    """Frozen counts per device, direction and peer service."""
    return peer_rows.groupBy(*PEER_SERVICE).agg(F.sum("n").alias("seen"))


def external_baseline(cells: DataFrame) -> DataFrame:
    return cells.filter("available").groupBy("device").agg(F.avg("external_tx_ip_bytes").alias("baseline"))


# F12
def peer_service_novelty(peer_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Share of rows with an unseen peer service, and their mean surprise."""
    totals = counts.groupBy("device", "direction").agg(F.sum("seen").alias("_total"), F.count(F.lit(1)).alias("_keys"))
    rows = peer_rows.join(growing(totals.filter(F.col("_total") > 0)), ["device", "direction"]).join(unfolded(counts), PEER_SERVICE, "left")
    surprise = -F.log((F.coalesce("seen", F.lit(0)) + 1) / (F.col("_total") + F.col("_keys") + 1))

    def mean(value: Column, direction: str) -> Column:
        mine = F.col("direction") == direction
        return F.sum(F.when(mine, F.col("n") * value)) / F.sum(F.when(mine, F.col("n")))

    unseen = F.col("seen").isNull().cast("double")
    return rows.groupBy(*KEYS).agg(
        mean(unseen, "in").alias("inbound_peer_service_novel_fraction"),
        mean(unseen, "out").alias("outbound_peer_service_novel_fraction"),
        mean(surprise, "in").alias("inbound_peer_service_rarity"),
        mean(surprise, "out").alias("outbound_peer_service_rarity"))


# F13, F14
def sustained_change(minutes: Minutes, cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long-horizon external volume against the baseline, and inbound change.

    The opening traffic counts only with a full run of earlier windows.
    """
    frame = window_over(minutes, -minutes.clock.long, -1)
    orig_external = minutes.view.filter(F.col("originated") & ~F.col("local")).groupBy(*KEYS).agg(
        F.sum("tx_bytes").alias("_tx"))
    rows = cells.filter("available").select(*KEYS, "epoch", "inbound_flows").join(unfolded(orig_external), KEYS, "left")
    seen = rows.select(*KEYS, "inbound_flows", F.count(F.lit(1)).over(frame).alias("_n"),
                       F.avg(F.coalesce("_tx", F.lit(0))).over(frame).alias("_mean_tx"),
                       F.avg("inbound_flows").over(frame).alias("_mean_in")).join(growing(baseline), "device", "left")
    return seen.select(
        *KEYS, F.when(F.col("_n") == minutes.clock.long, signed_log_ratio(F.col("_mean_tx"), F.col("baseline")))
        .alias("sustained_external_tx_excess_15m"),
        signed_log_ratio(F.col("inbound_flows"), F.col("_mean_in")).alias("inbound_flows_change_15m"))


# F14
def inbound_concentration(minutes: Minutes, peer_rows: DataFrame) -> DataFrame:
    """Share of the busiest inbound peer service over the short horizon before."""
    step = minutes.clock.window
    cells = unfolded(minutes.grid).filter("available").select(*KEYS, "epoch")
    per = peer_rows.filter(F.col("direction") == "in").join(cells, KEYS)
    later = per.withColumn("window_start", F.explode(F.sequence(
        F.col("window_start") + step, F.col("window_start") + minutes.clock.short * step, F.lit(step).cast("bigint"))))
    sums = later.groupBy(*EPOCH, "window_start", "peer", "proto", "port").agg(F.sum("n").alias("n"))
    return (sums.join(cells, [*EPOCH, "window_start"], "left_semi").groupBy(*KEYS)
            .agg((F.max("n") / F.sum("n")).alias("inbound_peer_service_concentration_5m")))


# F15
def external_excess(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    usable = cells.filter(F.col("available") & (F.col("active_flows") > 0)).join(growing(baseline), "device", "left")
    return usable.select(*KEYS, signed_log_ratio(F.col("external_tx_ip_bytes"), F.col("baseline"))
                         .alias("external_tx_excess_1m"))


def feature_table(minutes: Minutes, counts: DataFrame | None = None, baseline: DataFrame | None = None,
                  edges: DataFrame | None = None, keep=lambda df, name: df) -> DataFrame:
    """All features on the dense grid.

    ``counts`` and ``baseline`` are the frozen flow profile; without them the
    profile features are left out. ``keep`` may store the cells, which feed
    several later steps, and each table, so that the disk holds the shuffles of one table at a time.
    """
    from fluxprint.operators import graph

    cells = keep(on_grid(minutes, volume(minutes)), "cells")
    makers = [lambda: median_duration(minutes), lambda: destination_ports(minutes), lambda: destinations(minutes), lambda: gap_features(minutes),
              lambda: bursts(minutes), lambda: rolling_means(minutes, cells), lambda: rolling_gap_variation(minutes), lambda: stream_features(minutes),
              lambda: receiver(minutes, cells)]
    if counts is not None and baseline is not None:
        peer_rows = peer_services(minutes)
        makers += [lambda: peer_service_novelty(peer_rows, counts), lambda: sustained_change(minutes, cells, baseline),
                   lambda: inbound_concentration(minutes, peer_rows), lambda: external_excess(cells, baseline)]
    if edges is not None:
        makers.append(lambda: graph.local_degrees(edges))
    rest = on_grid(minutes, *[keep(make(), "features") for make in makers])
    new = [c for c in rest.columns if c not in minutes.grid.columns]
    return unfolded(cells).join(rest.select(*KEYS, *new), KEYS)
