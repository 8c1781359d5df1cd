"""Device-window features, edges and history over telemetry made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.operators import device_features as D
from fluxprint.operators import graph, history, identity
from fluxprint.plans import adapters as A
from fluxprint.plans.registry import ORACLES, query, r
from fluxprint.schemas import DEVICE_TYPES, SERVICES, Clock
from fluxprint.session import materialize, release

CLOCK = Clock(window=A.WINDOW)
W, CUT = A.WINDOW, A.TRAIN_END
KEYS = ["device", "window_start"]


def category(proto: str, port: str) -> str:
    return (f"CASE WHEN {port} = 53 THEN 'dns' WHEN {port} IN (80, 8080, 9090) THEN 'web' "
            f"WHEN {port} IN (443, 8443) THEN 'tls' WHEN {port} = 123 THEN 'ntp' WHEN {port} IN (1900, 5353) THEN 'discovery' "
            f"WHEN {port} IN (1883, 8883, 5683) THEN 'messaging' WHEN {proto} = 'udp' THEN 'other_udp' ELSE 'other_tcp' END")


CTES = A.TELEMETRY_SQL + f""",
res AS (
  SELECT tele.*, coalesce(a.device, CASE WHEN did % 7 = 3 THEN 'd' || did END) AS od, b.device AS rd
  FROM tele LEFT JOIN lease a ON a.ip = orig_h AND a.ls <= ws AND ws < a.le
  LEFT JOIN lease b ON b.ip = resp_h AND b.ls <= ws AND ws < b.le),
v AS (
  SELECT ws, uid, od AS device, true AS o, rd AS peer, resp_h AS pa, ob AS tx, rb AS rx, op AS txp, rp AS rxp,
         proto, resp_p, t, nf, dur, est, failed, {category('proto', 'resp_p')} AS cat FROM res WHERE od IS NOT NULL
  UNION ALL
  SELECT ws, uid, rd, false, od, orig_h, rb, ob, rp, op, proto, resp_p, t, nf, dur, est, failed,
         {category('proto', 'resp_p')} FROM res WHERE rd IS NOT NULL AND rd IS DISTINCT FROM od),
grid0 AS (
  SELECT device, device_type, ws::BIGINT AS ws,
         NOT EXISTS (SELECT 1 FROM outage WHERE outage.device = dev.device AND s < g.ws + {W} AND e > g.ws) AS available,
         (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM idspan i WHERE i.device = dev.device AND s < g.ws + {W} AND e > g.ws) AS ident
  FROM dev CROSS JOIN range({A.START}, {A.END}, {W}) g(ws)),
grid1 AS (SELECT *, coalesce(lag(ident) OVER (PARTITION BY device ORDER BY ws) <> ident, false) AS moved,
    coalesce(NOT lag(available) OVER (PARTITION BY device ORDER BY ws), false) AS dark FROM grid0),
grid AS (
  SELECT device, device_type, ws, available, sum((moved OR dark)::INT) OVER (PARTITION BY device ORDER BY ws)::BIGINT AS epoch,
    sum(moved::INT) OVER (PARTITION BY device ORDER BY ws)::BIGINT AS life FROM grid1),
vol AS (
  SELECT device, ws, sum(tx)::BIGINT AS tx_ip_bytes, sum(rx)::BIGINT AS rx_ip_bytes, sum(txp)::BIGINT AS tx_packets,
    sum(rxp)::BIGINT AS rx_packets, count(*) AS active_flows, count(*) FILTER (WHERE o AND nf) AS initiated_flows,
    count(*) FILTER (WHERE NOT o AND nf) AS inbound_flows, avg((proto = 'tcp')::INT) AS tcp_fraction,
    avg((proto = 'udp')::INT) AS udp_fraction, avg((proto = 'icmp')::INT) AS icmp_fraction,
    avg(failed::INT) FILTER (WHERE o AND proto = 'tcp' AND (failed OR est)) AS tcp_failed_fraction,
    avg(dur) AS mean_observed_flow_duration, quantile_cont(dur, 0.5) AS median_observed_flow_duration,
    ln(1 + sum(tx)) - ln(1 + sum(rx)) AS log_tx_rx_ratio,
    coalesce(sum(tx) FILTER (WHERE peer IS NOT NULL), 0)::BIGINT AS local_tx_ip_bytes,
    coalesce(sum(tx) FILTER (WHERE peer IS NULL), 0)::BIGINT AS external_tx_ip_bytes,
    coalesce(sum(rx) FILTER (WHERE peer IS NOT NULL), 0)::BIGINT AS local_rx_ip_bytes,
    coalesce(sum(rx) FILTER (WHERE peer IS NULL), 0)::BIGINT AS external_rx_ip_bytes,
    avg((peer IS NULL)::INT) AS external_flow_fraction, avg((cat = 'web')::INT) AS web_flow_fraction,
    avg((cat = 'tls')::INT) AS tls_flow_fraction, avg((cat = 'dns')::INT) AS dns_flow_fraction,
    avg((cat IN ('other_tcp', 'other_udp'))::INT) AS other_service_flow_fraction,
    CASE WHEN count(*) FILTER (WHERE o AND nf) > 0 THEN sum(tx) / (count(*) FILTER (WHERE o AND nf))::DOUBLE END
      AS tx_bytes_per_initiated_flow
  FROM v GROUP BY ALL),
cells AS (
  SELECT g.device, g.ws, g.device_type, epoch, coalesce(tx_ip_bytes, 0) AS tx_ip_bytes, coalesce(active_flows, 0) AS active_flows,
    coalesce(initiated_flows, 0) AS initiated_flows, coalesce(inbound_flows, 0) AS inbound_flows,
    coalesce(external_tx_ip_bytes, 0) AS external_tx_ip_bytes, mean_observed_flow_duration, external_flow_fraction
  FROM grid g LEFT JOIN vol USING (device, ws) WHERE available),
st AS (SELECT v.device, v.ws, epoch, t, pa, proto, resp_p FROM v JOIN grid g ON g.device = v.device AND g.ws = v.ws
       WHERE o AND nf AND available),
pw AS (
  SELECT ws, device, CASE WHEN o THEN 'out' ELSE 'in' END AS direction, coalesce(peer, pa) AS peer, proto, resp_p AS port,
         count(*) AS n FROM v GROUP BY ALL),
prof AS (SELECT device, direction, peer, proto, port, sum(n) AS c FROM pw WHERE ws < {CUT} GROUP BY ALL),
tot AS (SELECT device, direction, sum(c) AS total, count(*) AS keys FROM prof GROUP BY ALL),
base AS (SELECT device, avg(external_tx_ip_bytes) AS baseline FROM cells WHERE ws < {CUT} GROUP BY ALL),
ed0 AS (
  SELECT *, coalesce(od, 'external_service:' || {category('proto', 'resp_p')}) AS source,
    CASE WHEN rd IS NOT NULL AND rd IS DISTINCT FROM od THEN rd ELSE 'external_service:' || {category('proto', 'resp_p')} END
      AS target, {category('proto', 'resp_p')} AS cat FROM res WHERE od IS NOT NULL OR rd IS NOT NULL),
ed1 AS (
  SELECT ws, source, target, sum(ob + rb)::BIGINT AS ip_bytes, sum(op + rp)::BIGINT AS packets, count(*) AS flow_count,
    count(*) FILTER (WHERE proto = 'tcp') AS tcp_flows, count(*) FILTER (WHERE proto = 'udp') AS udp_flows,
    count(*) FILTER (WHERE proto = 'icmp') AS icmp_flows, bool_or(est OR (proto <> 'tcp' AND rp > 0)) AS confirmed,
    {', '.join(f"bool_or(cat = '{s}') AS service_{s}" for s in SERVICES)}
  FROM ed0 GROUP BY ALL),
ed AS (
  SELECT * EXCLUDE (sl, tl) FROM (SELECT *, ws = min(ws) OVER (PARTITION BY source, target, sl, tl) AS new_edge FROM (
    SELECT ed1.*, gs.life AS sl, gt.life AS tl FROM ed1 LEFT JOIN grid gs ON gs.device = source AND gs.ws = ed1.ws
    LEFT JOIN grid gt ON gt.device = target AND gt.ws = ed1.ws)) e
  WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.ws = e.ws AND NOT available AND (g.device = source OR g.device = target))),
led AS (SELECT * FROM ed WHERE NOT starts_with(source, 'external_service:') AND NOT starts_with(target, 'external_service:'))"""


def sql(body: str) -> str:
    return f"WITH {CTES}\n{body}"


def rounded(columns: list[str]) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def resolved(spark: SparkSession, sf: str, telemetry: DataFrame | None = None, inventory: DataFrame | None = None,
             known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Telemetry with its devices; the inventory, which several steps read, is stored first."""
    inventory = materialize(A.devices(spark, sf), "inventory") if inventory is None else inventory
    return identity.resolve_flow(A.telemetry(spark, sf) if telemetry is None else telemetry, A.leases(spark, sf, inventory), inventory, known=known)


def stored_owners(spark: SparkSession, sf: str, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners of addresses and MACs, stored for streams that read them in each micro-batch."""
    segments, macs = identity.owners_over_time(A.leases(spark, sf, inventory), inventory)
    return materialize(segments, "segments"), materialize(macs, "macs")


def grid(spark: SparkSession, sf: str, inventory: DataFrame | None = None) -> DataFrame:
    inventory = materialize(A.devices(spark, sf), "inventory") if inventory is None else inventory
    return D.dense_grid(inventory, A.START, A.END, A.outages(spark, sf, inventory), CLOCK, A.identity_spans(spark, sf, inventory))


def minutes(spark: SparkSession, sf: str, keep=lambda df, name: df) -> D.Minutes:
    """View and grid; ``keep`` stores them for features that read them several times."""
    inventory = materialize(A.devices(spark, sf), "inventory")
    return D.Minutes(keep(D.endpoint_view(resolved(spark, sf, inventory=inventory)), "view"), keep(grid(spark, sf, inventory), "grid"), CLOCK)


def cells(m: D.Minutes) -> DataFrame:
    return D.on_grid(m, D.volume(m))


def available(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter("available").select(*KEYS, *columns)


def stored_flows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Telemetry with its devices, and the grid, each stored once.

    A plan that holds them several times over costs the driver memory for every exchange in it; what is
    made from the stored tables is a small plan.
    """
    inventory = materialize(A.devices(spark, sf), "inventory")
    return materialize(resolved(spark, sf, inventory=inventory), "flows"), materialize(grid(spark, sf, inventory), "grid")


def alone(df: DataFrame, name: str) -> DataFrame:
    """Stored, and what was written to make it let go."""
    spark, stored = df.sparkSession, materialize(df, name)
    del df
    release(spark)
    return stored


def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(*stored_flows(spark, sf))


@query("c1_identity_resolution", sql("""SELECT uid, ws AS window_start, od AS orig_device, rd AS resp_device FROM res"""))
def _(spark, sf):
    return resolved(spark, sf).select("uid", "window_start", "orig_device", "resp_device")


@query("f17_dense_grid", sql("SELECT device, device_type, ws AS window_start, available FROM grid"))
def _(spark, sf):
    return grid(spark, sf).drop("epoch", "lifetime")


@query("g1_availability_epochs", sql("SELECT device, ws AS window_start, available, epoch, life AS lifetime FROM grid"))
def _(spark, sf):
    return grid(spark, sf).drop("device_type")


F1 = ["tx_ip_bytes", "rx_ip_bytes", "tx_packets", "rx_packets", "active_flows", "initiated_flows", "inbound_flows"]


@query("f1_volume", sql(f"""SELECT g.device, g.ws AS window_start, {', '.join(f'coalesce({c}, 0) AS {c}' for c in F1)}
  FROM grid g LEFT JOIN vol USING (device, ws) WHERE available"""))
def _(spark, sf):
    return available(cells(minutes(spark, sf)), *F1)


@query("f2_destinations_ports", sql(f"""SELECT g.device, g.ws AS window_start, coalesce(ud, 0) AS unique_destinations,
  coalesce(up, 0) AS unique_destination_ports, {r('ent')} AS destination_port_entropy
  FROM grid g
  LEFT JOIN (SELECT device, ws, count(DISTINCT pa) AS ud, count(DISTINCT (proto, resp_p)) AS up FROM v WHERE o GROUP BY ALL)
    USING (device, ws)
  LEFT JOIN (SELECT device, ws, -sum(p * log2(p)) AS ent FROM (
    SELECT device, ws, count(*) / sum(count(*)) OVER (PARTITION BY device, ws)::DOUBLE AS p FROM v WHERE o
    GROUP BY device, ws, proto, resp_p) GROUP BY ALL) USING (device, ws)
  WHERE available"""))
def _(spark, sf):
    m = minutes(spark, sf, materialize)
    return available(D.on_grid(m, D.destinations(m), D.destination_ports(m)), "unique_destinations",
                     "unique_destination_ports", "destination_port_entropy")


F3 = ["tcp_fraction", "udp_fraction", "icmp_fraction", "tcp_failed_fraction", "mean_observed_flow_duration"]


@query("f3_fractions", sql(f"""SELECT g.device, g.ws AS window_start, {rounded(F3)},
  {r('coalesce(log_tx_rx_ratio, 0)')} AS log_tx_rx_ratio FROM grid g LEFT JOIN vol USING (device, ws) WHERE available"""))
def _(spark, sf):
    return available(cells(minutes(spark, sf)), *F3, "log_tx_rx_ratio")


@query("f3_median_duration", sql(f"""SELECT device, ws AS window_start, {rounded(['median_observed_flow_duration'])} FROM vol"""))
def _(spark, sf):
    return D.median_duration(minutes(spark, sf, materialize))


@query("f4_new_destinations", sql(f"""SELECT device, ws AS window_start, {r('avg(nw)')} AS new_destination_fraction FROM (
    SELECT v.device, v.ws, available, CASE WHEN min(CASE WHEN available THEN v.ws END) OVER (PARTITION BY v.device, life, pa ORDER BY v.ws
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1.0 ELSE 0.0 END AS nw
    FROM v JOIN grid g ON g.device = v.device AND g.ws = v.ws WHERE o) WHERE available GROUP BY ALL"""))
def _(spark, sf):
    m = minutes(spark, sf, materialize)
    return available(D.on_grid(m, D.destinations(m)), "new_destination_fraction").filter(
        "new_destination_fraction is not null")


F5 = ["local_tx_ip_bytes", "external_tx_ip_bytes", "local_rx_ip_bytes", "external_rx_ip_bytes"]
F5R = ["external_flow_fraction", "web_flow_fraction", "tls_flow_fraction", "dns_flow_fraction", "other_service_flow_fraction",
       "tx_bytes_per_initiated_flow"]


@query("f5_local_external", sql(f"""SELECT g.device, g.ws AS window_start, {', '.join(f'coalesce({c}, 0) AS {c}' for c in F5)},
  {rounded(F5R)} FROM grid g LEFT JOIN vol USING (device, ws) WHERE available"""))
def _(spark, sf):
    return available(cells(minutes(spark, sf)), *F5, *F5R)


@query("f6_gap_features", sql(f"""SELECT device, ws AS window_start, {r('avg(g)', 3)} AS flow_gap_mean,
  CASE WHEN count(g) > 1 THEN {r('stddev_pop(g) / avg(g)', 3)} END AS flow_gap_cv, {r('min(g)', 3)} AS flow_gap_min
  FROM (SELECT device, ws, CASE WHEN p >= ws - {15 * W} AND t > p THEN t - p END AS g FROM (
    SELECT device, ws, t, lag(t) OVER (PARTITION BY device, epoch ORDER BY t) AS p FROM st)) GROUP BY ALL"""), digits=3)
def _(spark, sf):
    return D.gap_features(minutes(spark, sf, materialize))


@query("f7_bursts", sql(f"""SELECT device, ws AS window_start, max(n) AS flow_burst_max_10s FROM (
  SELECT device, ws, floor((t - ws) / {W // 6}) AS slot, count(*) AS n FROM st GROUP BY ALL) GROUP BY ALL"""))
def _(spark, sf):
    return D.bursts(minutes(spark, sf))


F8 = ["rolling_tx_mean_5m", "rolling_tx_mean_15m", "rolling_flows_mean_5m", "log_tx_change_5m", "log_tx_change_15m"]


@query("f8_rolling_means", sql(f"""SELECT device, ws AS window_start, {r('m5', 3)} AS rolling_tx_mean_5m,
  {r('m15', 3)} AS rolling_tx_mean_15m, {r('f5', 3)} AS rolling_flows_mean_5m,
  {r('ln(1 + tx_ip_bytes) - ln(1 + m5)', 3)} AS log_tx_change_5m,
  {r('ln(1 + tx_ip_bytes) - ln(1 + m15)', 3)} AS log_tx_change_15m FROM (
    SELECT a.device, a.ws, a.tx_ip_bytes, avg(b.tx_ip_bytes) FILTER (WHERE b.ws >= a.ws - {5 * W}) AS m5,
      avg(b.tx_ip_bytes) AS m15, avg(b.active_flows) FILTER (WHERE b.ws >= a.ws - {5 * W}) AS f5
    FROM cells a LEFT JOIN cells b ON b.device = a.device AND b.epoch = a.epoch AND b.ws < a.ws AND b.ws >= a.ws - {15 * W}
    GROUP BY ALL)"""), digits=3)
def _(spark, sf):
    m = minutes(spark, sf)
    return D.rolling_means(m, cells(m))


@query("f9_rolling_gap_variation", sql(f"""SELECT g.device, g.ws AS window_start, {r('cv', 4)} AS rolling_gap_cv_15m
  FROM grid g LEFT JOIN (
    SELECT device, ws, CASE WHEN count(*) > 1 THEN stddev_pop(gap) / avg(gap) END AS cv FROM (
      SELECT g.device, g.ws, t - lag(t) OVER (PARTITION BY g.device, g.ws ORDER BY t) AS gap
      FROM grid g JOIN st ON st.device = g.device AND st.epoch = g.epoch AND t >= g.ws - {15 * W} AND t < g.ws + {W}
      WHERE available) WHERE gap > 0 GROUP BY ALL) USING (device, ws) WHERE available"""), digits=4)
def _(spark, sf):
    return D.rolling_gap_variation(minutes(spark, sf, materialize))


@query("f10_streams", sql(f"""SELECT device, ws AS window_start, count(*) AS stream_count_1h, max(n) AS stream_max_starts_1h,
  {r('min(cv)', 4)} AS stream_min_gap_cv_1h, {r('avg((cv < 0.1)::INT)', 4)} AS stream_periodic_fraction_1h,
  {r(f'max(ws + {W} - first_t)', 4)} AS stream_max_age_seconds_1h,
  {r('max(n) / sum(n)::DOUBLE', 4)} AS stream_top_start_fraction_1h FROM (
    SELECT device, ws, pa, proto, resp_p, count(*) AS n, min(t) AS first_t,
      CASE WHEN count(gap) FILTER (WHERE gap > 0) >= 4 THEN
        stddev_pop(gap) FILTER (WHERE gap > 0) / avg(gap) FILTER (WHERE gap > 0) END AS cv
    FROM (SELECT g.device, g.ws, pa, proto, resp_p, t,
            t - lag(t) OVER (PARTITION BY g.device, g.ws, pa, proto, resp_p ORDER BY t) AS gap
          FROM grid g JOIN st ON st.device = g.device AND st.epoch = g.epoch AND t >= g.ws - {60 * W} AND t < g.ws + {W}
          WHERE available) GROUP BY ALL) GROUP BY ALL"""), digits=4)
def _(spark, sf):
    return D.stream_features(minutes(spark, sf, materialize))


F11 = ["unique_initiators", "unique_inbound_ports"]
F11R = ["new_initiator_fraction", "inbound_failed_fraction", "inbound_flow_fraction", "inbound_flows_change_5m"]


@query("f11_receiver", sql(f"""SELECT c.device, c.ws AS window_start, coalesce(ui, 0) AS unique_initiators,
  coalesce(up, 0) AS unique_inbound_ports, {r('nif')} AS new_initiator_fraction, {r('ff')} AS inbound_failed_fraction,
  CASE WHEN active_flows > 0 THEN {r('coalesce(n, 0) / active_flows::DOUBLE')} END AS inbound_flow_fraction,
  {r('ln(1 + inbound_flows) - ln(1 + m)')} AS inbound_flows_change_5m
  FROM (SELECT *, avg(inbound_flows) OVER (PARTITION BY device, epoch ORDER BY ws ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m
        FROM cells) c
  LEFT JOIN (SELECT device, ws, count(DISTINCT pa) AS ui, count(DISTINCT (proto, resp_p)) AS up, count(*) AS n,
      avg(failed::INT) FILTER (WHERE proto = 'tcp' AND (failed OR est)) AS ff FROM v WHERE NOT o GROUP BY ALL) USING (device, ws)
  LEFT JOIN (SELECT device, ws, avg((ws = f)::INT) AS nif FROM (
      SELECT DISTINCT v.device, v.ws, pa, min(v.ws) OVER (PARTITION BY v.device, epoch, pa) AS f
      FROM v JOIN grid g ON g.device = v.device AND g.ws = v.ws WHERE NOT o AND available) GROUP BY ALL) USING (device, ws)"""))
def _(spark, sf):
    m = minutes(spark, sf)
    return available(D.on_grid(m, D.receiver(m, cells(m))), *F11, *F11R)


def profile_tables(m: D.Minutes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Peer-service rows, and the counts and baseline frozen on the training part."""
    rows = D.peer_services(m)
    return rows, D.flow_profile(rows.filter(F.col("window_start") < CUT)), D.external_baseline(
        cells(m).filter(F.col("window_start") < CUT))


@query("f12_peer_service_novelty", sql(f"""SELECT device, ws AS window_start,
  {', '.join(f"{r(f'sum(n * u) FILTER (WHERE direction = {q!r}) / sum(n) FILTER (WHERE direction = {q!r})')} AS {name}"
    for q, name in (('in', 'inbound_peer_service_novel_fraction'), ('out', 'outbound_peer_service_novel_fraction')))},
  {', '.join(f"{r(f'sum(n * s) FILTER (WHERE direction = {q!r}) / sum(n) FILTER (WHERE direction = {q!r})')} AS {name}"
    for q, name in (('in', 'inbound_peer_service_rarity'), ('out', 'outbound_peer_service_rarity')))}
  FROM (SELECT pw.*, CASE WHEN c IS NULL THEN 1.0::DOUBLE ELSE 0 END AS u,
          -ln((coalesce(c, 0) + 1) / (total + keys + 1)::DOUBLE) AS s
        FROM pw JOIN tot USING (device, direction) LEFT JOIN prof USING (device, direction, peer, proto, port)) GROUP BY ALL"""))
def _(spark, sf):
    rows, counts, _base = profile_tables(minutes(spark, sf))
    return D.peer_service_novelty(rows, counts)


@query("f13_sustained_excess", sql(f"""SELECT device, ws AS window_start,
  CASE WHEN n = 15 THEN {r('ln(1 + mtx) - ln(1 + baseline)')} END AS sustained_external_tx_excess_15m,
  {r('ln(1 + inbound_flows) - ln(1 + mi)')} AS inbound_flows_change_15m FROM (
    SELECT c.device, c.ws, inbound_flows, count(*) OVER p AS n, avg(coalesce(etx, 0)) OVER p AS mtx, avg(inbound_flows) OVER p AS mi
    FROM cells c LEFT JOIN (SELECT device, ws, sum(tx) AS etx FROM v WHERE o AND peer IS NULL GROUP BY ALL) USING (device, ws)
    WINDOW p AS (PARTITION BY c.device, epoch ORDER BY c.ws ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))
  LEFT JOIN base USING (device)"""))
def _(spark, sf):
    m = minutes(spark, sf)
    return D.sustained_change(m, cells(m), profile_tables(m)[2])


@query("f14_inbound_concentration", sql(f"""SELECT device, ws AS window_start, {r('max(n) / sum(n)::DOUBLE')} AS
  inbound_peer_service_concentration_5m FROM (
    SELECT g.device, g.ws, peer, proto, port, sum(n) AS n
    FROM grid g JOIN pw ON pw.device = g.device AND pw.ws < g.ws AND pw.ws >= g.ws - {5 * W} AND direction = 'in'
    JOIN grid h ON h.device = pw.device AND h.ws = pw.ws AND h.epoch = g.epoch AND h.available
    WHERE g.available GROUP BY ALL) GROUP BY ALL"""))
def _(spark, sf):
    m = minutes(spark, sf, materialize)
    return D.inbound_concentration(m, D.peer_services(m))


@query("f15_external_excess", sql(f"""SELECT device, ws AS window_start, {r('ln(1 + external_tx_ip_bytes) - ln(1 + baseline)')}
  AS external_tx_excess_1m FROM cells LEFT JOIN base USING (device) WHERE active_flows > 0"""))
def _(spark, sf):
    m = minutes(spark, sf)
    return D.external_excess(cells(m), profile_tables(m)[2])


@query("f15_peer_degrees", sql("""SELECT n.device, n.ws AS window_start, coalesce(o, 0) AS outgoing_local_peer_count,
  coalesce(i, 0) AS incoming_local_peer_count, greatest(coalesce(o, 0), coalesce(mx, 0)) AS initiator_fanout_context
  FROM (SELECT source AS device, ws FROM led UNION SELECT target, ws FROM led) n
  LEFT JOIN (SELECT source AS device, ws, count(*) AS o FROM led GROUP BY ALL) USING (device, ws)
  LEFT JOIN (SELECT l.target AS device, l.ws, count(*) AS i, max(x.o) AS mx FROM led l
    JOIN (SELECT source, ws, count(*) AS o FROM led GROUP BY ALL) x ON x.source = l.source AND x.ws = l.ws GROUP BY ALL)
    USING (device, ws)"""))
def _(spark, sf):
    return graph.local_degrees(edge_rows(spark, sf))


@query("f16_edges", sql("SELECT * EXCLUDE (ws), ws AS window_start FROM ed"))
def _(spark, sf):
    return edge_rows(spark, sf)


@query("f16_edge_ports", sql("SELECT DISTINCT ws AS window_start, source, target, proto || '/' || resp_p AS port FROM ed0"))
def _(spark, sf):
    return graph.edge_ports(resolved(spark, sf))


MODEL_COLUMNS = ["tx_ip_bytes", "active_flows", "mean_observed_flow_duration", "external_flow_fraction"]
LOG_COLUMNS = ["tx_ip_bytes", "active_flows", "mean_observed_flow_duration"]


def moved(c: str, prefix: str = "") -> str:
    return f"ln(1 + {prefix}{c})" if c in LOG_COLUMNS else f"{prefix}{c}"


@query("f18_model_input", sql(f"""SELECT c.device, c.ws AS window_start,
  {', '.join(f"{r(f'coalesce(asinh(({moved(c, 'c.')} - m_{c}) / s_{c}), 0)')} AS x_{c}" for c in MODEL_COLUMNS)},
  {', '.join(f'(c.{c} IS NOT NULL)::INT AS valid_{c}' for c in MODEL_COLUMNS)},
  {r('sin(2 * pi() * (c.ws % 86400) / 86400)')} AS time_sin, {r('cos(2 * pi() * (c.ws % 86400) / 86400)')} AS time_cos,
  {', '.join(f"(device_type = '{t}')::INT AS type_{t}" for t in [*DEVICE_TYPES, 'external_service'])}
  FROM cells c JOIN (SELECT device_type, {', '.join(f'avg({moved(c)}) AS m_{c}, stddev_pop({moved(c)}) AS s_{c}'
    for c in MODEL_COLUMNS)} FROM cells WHERE ws < {CUT} GROUP BY ALL) USING (device_type)"""))
def _(spark, sf):
    rows = cells(minutes(spark, sf)).filter("available")
    table = history.normaliser(rows.filter(F.col("window_start") < CUT), MODEL_COLUMNS, LOG_COLUMNS)
    return history.model_input(rows, table, MODEL_COLUMNS, LOG_COLUMNS)


@query("f19_edge_descriptor", sql(f"""SELECT ws AS window_start, source, target, {r('ln(1 + ip_bytes)')} AS log_ip_bytes,
  {r('ln(1 + packets)')} AS log_packets, {r('ln(1 + flow_count)')} AS log_flow_count,
  {', '.join(f'service_{s}::INT AS service_{s}' for s in SERVICES)} FROM ed"""))
def _(spark, sf):
    return graph.edge_descriptor(edge_rows(spark, sf))


@query("f20_neighbour_messages", sql(f"""SELECT coalesce(i.device, o.device) AS device, coalesce(i.ws, o.ws) AS window_start,
  in_sum_active_flows, in_sum_ip_bytes, {r('in_mean_active_flows')} AS in_mean_active_flows, {r('in_mean_ip_bytes')} AS in_mean_ip_bytes,
  in_count, out_sum_active_flows, out_sum_ip_bytes, {r('out_mean_active_flows')} AS out_mean_active_flows,
  {r('out_mean_ip_bytes')} AS out_mean_ip_bytes, out_count
  FROM (SELECT target AS device, ed.ws, sum(active_flows)::BIGINT AS in_sum_active_flows, avg(active_flows) AS in_mean_active_flows,
          sum(ip_bytes)::BIGINT AS in_sum_ip_bytes, avg(ip_bytes) AS in_mean_ip_bytes, count(*) AS in_count
        FROM ed JOIN cells c ON c.device = source AND c.ws = ed.ws GROUP BY ALL) i
  FULL JOIN (SELECT source AS device, ed.ws, sum(active_flows)::BIGINT AS out_sum_active_flows, avg(active_flows) AS out_mean_active_flows,
          sum(ip_bytes)::BIGINT AS out_sum_ip_bytes, avg(ip_bytes) AS out_mean_ip_bytes, count(*) AS out_count
        FROM ed JOIN cells c ON c.device = target AND c.ws = ed.ws GROUP BY ALL) o ON o.device = i.device AND o.ws = i.ws"""))
def _(spark, sf):
    flows, dense = stored_flows(spark, sf)
    nodes = cells(D.Minutes(D.endpoint_view(flows), dense, CLOCK)).filter("available").select(*KEYS, "active_flows")
    return graph.neighbour_messages(graph.edges(flows, dense), nodes, ["active_flows"], ["ip_bytes"])


@query("f21_undirected", sql("""SELECT ws AS window_start, source AS a, target AS b FROM ed
  UNION SELECT ws, target, source FROM ed"""))
def _(spark, sf):
    return graph.undirected(edge_rows(spark, sf))


# Each feature's own query, and how it rounds, make up the whole table.
PARTS = ["f1_volume", "f2_destinations_ports", "f3_fractions", "f3_median_duration", "f4_new_destinations", "f5_local_external", "f6_gap_features", "f7_bursts",
         "f8_rolling_means", "f9_rolling_gap_variation", "f10_streams", "f11_receiver", "f12_peer_service_novelty", "f13_sustained_excess",
         "f14_inbound_concentration", "f15_external_excess", "f15_peer_degrees"]
DEGREES = ["outgoing_local_peer_count", "incoming_local_peer_count", "initiator_fanout_context"]
PROFILE = [f"{d}_peer_service_{k}" for d in ("inbound", "outbound") for k in ("novel_fraction", "rarity")] + [
    "sustained_external_tx_excess_15m", "inbound_flows_change_15m", "inbound_peer_service_concentration_5m", "external_tx_excess_1m"]
DIGITS = dict.fromkeys(["flow_gap_mean", "flow_gap_cv", "flow_gap_min", *F8], 3) | dict.fromkeys(
    ["rolling_gap_cv_15m", "stream_min_gap_cv_1h", "stream_periodic_fraction_1h", "stream_max_age_seconds_1h", "stream_top_start_fraction_1h"], 4)
ALL_FEATURES = [*F1, "unique_destinations", "unique_destination_ports", "destination_port_entropy", *F3, "log_tx_rx_ratio", "median_observed_flow_duration",
                "new_destination_fraction", *F5, *F5R, "flow_gap_mean", "flow_gap_cv", "flow_gap_min", "flow_burst_max_10s", *F8, "rolling_gap_cv_15m",
                "stream_count_1h", "stream_max_starts_1h", "stream_min_gap_cv_1h", "stream_periodic_fraction_1h", "stream_max_age_seconds_1h",
                "stream_top_start_fraction_1h", *F11, *F11R, *PROFILE, *DEGREES]


def whole_table_sql(columns: list[str]) -> str:
    """The features' own SQL side by side; counts of an idle window are zero, a dark window has nothing."""
    bodies = [ORACLES[name].removeprefix(f"WITH {CTES}\n") for name in PARTS]
    filled = [f"CASE WHEN available THEN {f'coalesce({c}, 0)' if c in D.ZERO_WHEN_IDLE else c} END AS {c}" for c in columns]
    joins = "\n".join(f"LEFT JOIN ({body}) p{i} ON p{i}.device = g.device AND p{i}.window_start = g.ws" for i, body in enumerate(bodies))
    return sql(f"SELECT g.device, g.ws AS window_start, available, {', '.join(filled)} FROM grid g {joins}")


@query("f_feature_table", whole_table_sql(ALL_FEATURES), DIGITS)
def _(spark, sf):
    """One table of features after the other is stored, and its shuffles are let go; flows are resolved once for view and edges."""
    flows, dense = stored_flows(spark, sf)
    release(spark)
    m = D.Minutes(alone(D.endpoint_view(flows), "view"), dense, CLOCK)
    _rows, counts, base = profile_tables(m)
    counts, base = alone(counts, "counts"), alone(base, "baseline")
    table = D.feature_table(m, counts, base, graph.edges(flows, dense), alone)
    return table.select(*KEYS, "available", *ALL_FEATURES)


@query("g2_history_stack", sql(f"""SELECT c.device, c.ws AS window_start, coalesce(h, '') AS history FROM cells c LEFT JOIN (
  SELECT a.device, a.ws, string_agg(b.ws || ':' || b.active_flows, ',' ORDER BY b.ws) AS h
  FROM cells a JOIN cells b ON b.device = a.device AND b.epoch = a.epoch AND b.ws < a.ws AND b.ws >= a.ws - {15 * W}
  GROUP BY ALL) USING (device, ws)"""))
def _(spark, sf):
    stack = history.history_stack(cells(minutes(spark, sf)), ["active_flows"], CLOCK)
    text = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["window_start"], h["active_flows"])), ",")
    return stack.select(*KEYS, text.alias("history"))


@query("g3_history_status", sql(f"""SELECT device, ws AS window_start, least(n, 15)::INTEGER AS prior_windows, n = 0 AS cold,
  ws - s AS observed_age_seconds, n >= 15 AND ws - s >= {60 * W} AS fully_warmed FROM (
    SELECT device, ws, row_number() OVER (PARTITION BY device, epoch ORDER BY ws) - 1 AS n,
      min(ws) OVER (PARTITION BY device, epoch) AS s FROM grid WHERE available)"""))
def _(spark, sf):
    return history.history_status(grid(spark, sf), CLOCK)


@query("g4_first_seen", sql("""SELECT device, ws AS window_start, epoch, pa AS peer,
  ws = min(ws) OVER (PARTITION BY device, pa) AS first_ever, ws = min(ws) OVER (PARTITION BY device, epoch, pa) AS first_in_epoch
  FROM (SELECT DISTINCT device, ws, epoch, pa FROM st)"""))
def _(spark, sf):
    seen = D.starts(minutes(spark, sf, materialize)).select(*KEYS, "epoch", "peer").distinct()
    return seen.select("*", history.first_seen(seen, ["device", "peer"]).alias("first_ever"),
                       history.first_seen(seen, ["device", "epoch", "peer"]).alias("first_in_epoch"))


@query("g7_operating_context", sql("""SELECT device, ws AS window_start,
  CASE WHEN n < 3 THEN 'cold' WHEN n < 6 THEN 'settling' ELSE 'warm' END || '|load=' ||
  CASE WHEN a IS NULL THEN 'unknown' WHEN a = 0 THEN 'quiet' WHEN a <= 4 THEN 'light' ELSE 'busy' END || '|direction=' ||
  CASE WHEN o IS NULL OR i IS NULL THEN 'unknown' WHEN o + i = 0 THEN 'quiet' WHEN i > 2 * o THEN 'receive'
       WHEN o > 2 * i THEN 'send' ELSE 'mixed' END AS context
  FROM (SELECT device, ws, row_number() OVER (PARTITION BY device, epoch ORDER BY ws) - 1 AS n,
      median(active_flows) OVER p AS a, median(initiated_flows) OVER p AS o, median(inbound_flows) OVER p AS i FROM cells
    WINDOW p AS (PARTITION BY device, epoch ORDER BY ws ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""))
def _(spark, sf):
    return history.operating_context(cells(minutes(spark, sf)), CLOCK)


@query("g8_service_context", sql("""SELECT ws AS window_start, device, CASE WHEN l THEN 'local+' ELSE '' END ||
  CASE WHEN e IS NOT NULL THEN e WHEN l THEN 'local' ELSE 'none' END AS context FROM (
    SELECT ws, source AS device, bool_or(NOT starts_with(target, 'external_service:')) AS l,
      string_agg(DISTINCT CASE WHEN starts_with(target, 'external_service:') THEN replace(target, 'external_service:', '') END, '+'
        ORDER BY CASE WHEN starts_with(target, 'external_service:') THEN replace(target, 'external_service:', '') END) AS e
    FROM ed GROUP BY ALL)"""))
def _(spark, sf):
    return graph.service_context(edge_rows(spark, sf))
