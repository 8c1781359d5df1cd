"""Behaviour windows, frozen profile and deviation score over the event table."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.functions import stats
from fluxprint.operators import deviation, profile, windows
from fluxprint.plans import adapters as A
from fluxprint.plans.registry import query, r
from fluxprint.session import materialize
from fluxprint.schemas import BASELINE_FEATURES, COMPONENTS, LINEAR_FEATURES

W, CUT = A.WINDOW, A.TRAIN_END
KEYS = ["device", "window_start"]

FEATURE_SQL = "\n  UNION ALL ".join(
    f"SELECT device, '{f}' AS feature, {f}::DOUBLE AS v FROM w WHERE ws < {CUT} AND {f} IS NOT NULL"
    for f in BASELINE_FEATURES)
LINEAR_SQL = ", ".join(f"'{f}'" for f in LINEAR_FEATURES)
ENDPOINTS_SQL = """
  SELECT device, CASE WHEN own THEN 'destination_ips' ELSE 'source_ips' END AS kind,
         CASE WHEN own THEN resp_h ELSE orig_h END AS value FROM dirs
  UNION ALL SELECT device, CASE WHEN own THEN 'destination_ports' ELSE 'listening_ports' END, proto || '/' || resp_p FROM dirs
  UNION ALL SELECT device, 'domains', q FROM dns WHERE t < {cut}
  UNION ALL SELECT device, 'tls_server_names', 'h' || (k % 7) || '.example.net' FROM conn WHERE event_type = 'view' AND t < {cut}
""".format(cut=CUT)

CTES = A.EVENTS_SQL + f""",
flows AS (SELECT * FROM conn WHERE event_type <> 'signup'),
dns AS (SELECT device, t, ws, 'h' || (k % 20) || '.example.net' AS q FROM conn WHERE event_type = 'signup'),
gaps AS (
  SELECT device, ws, CASE WHEN count(g) >= 2 THEN var_pop(g) END AS interflow_gap_variance
  FROM (SELECT device, ws, t - lag(t) OVER (PARTITION BY device, ws ORDER BY t) AS g FROM flows) GROUP BY ALL),
fw AS (
  SELECT device, ws, count(*) AS flow_count, count(DISTINCT resp_h) AS unique_destinations, sum(ob)::BIGINT AS orig_bytes,
         sum(rb)::BIGINT AS resp_bytes, (sum(op) + sum(rp))::BIGINT AS packets_total,
         count(*) FILTER (WHERE conn_state = 'S0') / count(*)::DOUBLE AS tcp_failed_ratio
  FROM flows GROUP BY ALL),
dq AS (SELECT device, ws, q, count(*) AS n FROM dns GROUP BY ALL),
dw AS (
  SELECT device, ws, count(*) AS unique_domains, -sum(p * log2(p)) AS domain_entropy
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY device, ws)::DOUBLE AS p FROM dq) GROUP BY ALL),
w AS (
  SELECT device, ws, ((ws % 86400) // 3600)::INTEGER AS hour_of_day, coalesce(flow_count, 0) AS flow_count,
         coalesce(unique_destinations, 0) AS unique_destinations, coalesce(unique_domains, 0) AS unique_domains,
         coalesce(orig_bytes, 0) AS orig_bytes, coalesce(resp_bytes, 0) AS resp_bytes,
         coalesce(orig_bytes + resp_bytes, 0) AS bytes_total, coalesce(packets_total, 0) AS packets_total,
         coalesce(domain_entropy, 0.0) AS domain_entropy, interflow_gap_variance, tcp_failed_ratio
  FROM fw FULL JOIN dw USING (device, ws) LEFT JOIN gaps USING (device, ws)),
sh AS (
  SELECT device, ws, service, n, n / sum(n) OVER (PARTITION BY device, ws)::DOUBLE AS share
  FROM (SELECT device, ws, coalesce(service, 'unknown') AS service, count(*) AS n FROM flows GROUP BY ALL)),
we AS (
  SELECT DISTINCT device, ws, 'destination' AS kind, resp_h AS value FROM flows
  UNION SELECT device, ws, 'port', proto || '/' || resp_p FROM flows
  UNION SELECT device, ws, 'domain', q FROM dns),
long AS ({FEATURE_SQL}),
sp AS (
  SELECT device, feature, v, feature NOT IN ({LINEAR_SQL}) AND min(v) OVER (PARTITION BY device, feature) >= 0 AS lg
  FROM long),
sp2 AS (SELECT *, CASE WHEN lg THEN ln(1 + v) ELSE v END AS s FROM sp),
bd AS (
  SELECT device, feature, count(*) AS n, bool_or(lg) AS lg, quantile_cont(s, 0.5) AS med,
         (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) / 1.349 AS sg
  FROM sp2 GROUP BY ALL),
kept AS (
  SELECT sp2.*, n, sg, med FROM sp2 JOIN bd USING (device, feature)
  WHERE NOT sg > 0 OR abs(s - med) <= 3 * sg + 1e-12),
rs AS (
  SELECT device, feature, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
         avg(v) AS mean, min(v) AS min, max(v) AS max,
         list_sort(list(v))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95,
         list_sort(list(v))[round_even(0.99::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p99,
         any_value(n) AS windows_observed, any_value(n) - count(*) AS windows_excluded,
         any_value(CASE WHEN sg > 0 THEN CASE WHEN lg THEN exp(med - 3 * sg) - 1 ELSE med - 3 * sg END END) AS low_bound,
         any_value(CASE WHEN sg > 0 THEN CASE WHEN lg THEN exp(med + 3 * sg) - 1 ELSE med + 3 * sg END END) AS high_bound,
         CASE WHEN any_value(lg) THEN 'log1p' ELSE 'linear' END AS trim_space
  FROM kept GROUP BY ALL),
tw AS (SELECT device, count(*) AS nw FROM w WHERE ws < {CUT} GROUP BY ALL),
sv AS (
  SELECT device, service, sum(share) / any_value(nw) AS mean_share, count(*) AS windows_present,
         count(*) / any_value(nw)::DOUBLE AS window_share
  FROM sh JOIN tw USING (device) WHERE ws < {CUT} GROUP BY ALL),
dirs AS (
  SELECT device, true AS own, orig_h, resp_h, resp_p, proto FROM flows WHERE t < {CUT}
  UNION ALL SELECT k - 40, false, orig_h, resp_h, resp_p, proto FROM flows WHERE k >= 40 AND t < {CUT}),
ep AS (SELECT device, kind, value, count(*) AS n FROM ({ENDPOINTS_SQL}) GROUP BY ALL),
known AS (
  SELECT DISTINCT device, CASE WHEN kind = 'destination_ips' THEN 'destination'
      WHEN kind IN ('domains', 'tls_server_names') THEN 'domain' ELSE 'port' END AS kind, value
  FROM ep WHERE kind <> 'source_ips'),
un AS (
  SELECT we.*, NOT EXISTS (SELECT 1 FROM known kn WHERE kn.device = we.device AND kn.kind = we.kind
                           AND kn.value = we.value) AS unseen FROM we),
us AS (
  SELECT device, ws,
    coalesce(avg(unseen::INT) FILTER (WHERE kind = 'destination'), 0) AS new_destinations,
    coalesce(avg(unseen::INT) FILTER (WHERE kind = 'domain'), 0) AS new_domains,
    coalesce(avg(unseen::INT) FILTER (WHERE kind = 'port'), 0) AS new_ports
  FROM un GROUP BY ALL),
bs AS (SELECT device, service, mean_share / sum(mean_share) OVER (PARTITION BY device) AS b FROM sv),
grid_services AS (SELECT device, ws, service FROM sh UNION SELECT w.device, ws, service FROM w JOIN bs USING (device)),
dr AS (
  SELECT device, ws, round(0.5 * sum(abs(coalesce(share, 0) - coalesce(b, 0))), 12) AS protocol_drift
  FROM grid_services LEFT JOIN sh USING (device, ws, service) LEFT JOIN bs USING (device, service)
  WHERE device IN (SELECT device FROM bs) GROUP BY ALL),
fz AS (
  SELECT w.device, ws, f.feature, CASE WHEN f.feature = 'bytes_total' THEN bytes_total ELSE flow_count END::DOUBLE AS v,
         CASE WHEN trim_space = 'log1p' THEN ln(1 + median) ELSE median END AS m,
         CASE WHEN trim_space = 'log1p' THEN ln(1 + max) ELSE max END AS mx,
         (CASE WHEN trim_space = 'log1p' THEN ln(1 + q3) - ln(1 + q1) ELSE q3 - q1 END) / 1.349 AS spread,
         trim_space
  FROM w, (VALUES ('bytes_total'), ('flow_count')) f(feature)
  LEFT JOIN rs ON rs.device = w.device AND rs.feature = f.feature),
fy AS (SELECT *, CASE WHEN trim_space = 'log1p' THEN ln(1 + v) ELSE v END AS c FROM fz),
fx AS (
  SELECT device, ws, feature, CASE WHEN m IS NULL OR c <= m THEN 0 WHEN spread <= 0 THEN
      CASE WHEN c <= mx OR mx <= 0 THEN 0 ELSE 6.0 * c / mx END ELSE (c - m) / spread END AS z FROM fy),
sq AS (
  SELECT device, ws, max(z / (z + 6)) FILTER (WHERE feature = 'bytes_total') AS volume,
         max(z / (z + 6)) FILTER (WHERE feature = 'flow_count') AS flow_rate
  FROM fx GROUP BY ALL),
raw AS (
  SELECT w.device, w.ws, coalesce(new_destinations, 0) AS new_destinations, coalesce(new_domains, 0) AS new_domains,
         coalesce(new_ports, 0) AS new_ports, coalesce(protocol_drift, 0) AS protocol_drift,
         CASE WHEN w.tcp_failed_ratio > f.p99 AND f.p99 < 1 THEN (w.tcp_failed_ratio - f.p99) / (1 - f.p99) ELSE 0 END
           AS failed_conns, volume, flow_rate
  FROM w LEFT JOIN us USING (device, ws) LEFT JOIN dr USING (device, ws) LEFT JOIN sq USING (device, ws)
  LEFT JOIN rs f ON f.device = w.device AND f.feature = 'tcp_failed_ratio'),
cl AS (
  UNPIVOT (SELECT device, ws, {', '.join(f'{c}::DOUBLE AS {c}' for c in COMPONENTS)} FROM raw) ON {', '.join(COMPONENTS)}
  INTO NAME component VALUE v),
cal AS (
  SELECT device, component,
    list_sort(list(v))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p50,
    list_sort(list(v))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95,
    list_sort(list(v))[round_even(0.99::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p99
  FROM cl WHERE ws < {CUT} GROUP BY ALL),
cc AS (
  SELECT cl.device, ws, component, CASE WHEN p99 IS NULL THEN v
    ELSE greatest(0, least(1, (v - least(p99, 0.99)) / (1 - least(p99, 0.99)))) END AS v, p99 IS NOT NULL AS calibrated
  FROM cl LEFT JOIN cal USING (device, component)),
sc AS (
  SELECT device, ws, 1 - product(1 - v) AS deviation_score, bool_and(calibrated) AS calibrated,
    {', '.join(f"max(v) FILTER (WHERE component = '{c}') AS {c}" for c in COMPONENTS)}
  FROM cc GROUP BY ALL),
top AS (
  SELECT *, CASE {' '.join(f"WHEN {c} = mxc AND mxc > 0 THEN '{c}'" for c in COMPONENTS)} END AS top_component
  FROM (SELECT *, greatest({', '.join(COMPONENTS)}) AS mxc FROM sc))"""



def _rows(rows) -> str:
    """Literal rows of text and numbers, in SQL."""
    text = lambda v: "NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows) + ")"


CHANGES = deviation.SCENARIOS
CHANGED = ["flow_count", "tcp_failed_ratio", "bytes_total"]
INJECTED_SQL = f""",
numbers AS (SELECT * FROM {_rows((s, *[x["numbers"].get(c) for c in CHANGED]) for s, x in CHANGES.items())}
  x(scenario, {', '.join(CHANGED)})),
planted AS (SELECT * FROM {_rows((s, kind, v) for s, x in CHANGES.items() for kind in ('destination', 'port', 'domain')
                                 for v in x.get(kind + 's', []))} x(scenario, kind, value)),
forced AS (SELECT * FROM {_rows((s, k, v) for s, x in CHANGES.items() for k, v in x.get('services', {}).items())}
  x(scenario, service, share)),
middle AS (SELECT device, quantile_cont(flow_count::DOUBLE, 0.5) AS med FROM w WHERE ws < {CUT} GROUP BY device),
typ AS (
  SELECT device, ws FROM (
    SELECT device, ws, row_number() OVER (PARTITION BY device ORDER BY abs(flow_count - med), ws) AS i
    FROM w JOIN middle USING (device) WHERE ws < {CUT}) WHERE i = 1),
pairs AS (SELECT device, ws, scenario FROM typ CROSS JOIN numbers),
iw AS (
  SELECT device, scenario, {', '.join(f'coalesce(n.{c}, w.{c}::DOUBLE) AS {c}' for c in CHANGED)}
  FROM pairs JOIN w USING (device, ws) JOIN numbers n USING (scenario)),
iu AS (
  SELECT device, scenario, x.kind, NOT EXISTS (
    SELECT 1 FROM known kn WHERE kn.device = x.device AND kn.kind = x.kind AND kn.value = x.value) AS unseen
  FROM (
    SELECT device, scenario, kind, value FROM pairs JOIN we USING (device, ws)
    WHERE (scenario, kind) NOT IN (SELECT scenario, kind FROM planted)
    UNION ALL SELECT device, scenario, kind, value FROM pairs JOIN planted USING (scenario)) x),
ius AS (
  SELECT device, scenario, {', '.join(f"coalesce(avg(unseen::INT) FILTER (WHERE kind = '{k}'), 0) AS new_{k}s"
                                      for k in ('destination', 'domain', 'port'))} FROM iu GROUP BY ALL),
im AS (
  SELECT device, scenario, service, share FROM pairs JOIN sh USING (device, ws)
  WHERE scenario NOT IN (SELECT scenario FROM forced)
  UNION ALL SELECT device, scenario, service, share FROM pairs JOIN forced USING (scenario)),
idr AS (
  SELECT device, scenario, round(0.5 * sum(abs(coalesce(share, 0) - coalesce(b, 0))), 12) AS protocol_drift
  FROM (SELECT device, scenario, service FROM im UNION SELECT device, scenario, service FROM pairs JOIN bs USING (device))
  LEFT JOIN im USING (device, scenario, service) LEFT JOIN bs USING (device, service)
  WHERE device IN (SELECT device FROM bs) GROUP BY ALL),
iz AS (
  SELECT iw.device, scenario, f.feature, mx, m, spread, CASE WHEN trim_space = 'log1p' THEN ln(1 + v) ELSE v END AS c
  FROM (UNPIVOT (SELECT device, scenario, bytes_total, flow_count FROM iw) ON bytes_total, flow_count
        INTO NAME feature VALUE v) iw
  LEFT JOIN (SELECT DISTINCT device, feature, m, mx, spread, trim_space FROM fz) f
    ON f.device = iw.device AND f.feature = iw.feature),
iq AS (
  SELECT device, scenario, max(z / (z + 6)) FILTER (WHERE feature = 'bytes_total') AS volume,
         max(z / (z + 6)) FILTER (WHERE feature = 'flow_count') AS flow_rate
  FROM (SELECT device, scenario, feature, CASE WHEN m IS NULL OR c <= m THEN 0 WHEN spread <= 0 THEN
          CASE WHEN c <= mx OR mx <= 0 THEN 0 ELSE 6.0 * c / mx END ELSE (c - m) / spread END AS z FROM iz)
  GROUP BY ALL),
iraw AS (
  SELECT device, scenario, coalesce(new_destinations, 0) AS new_destinations, coalesce(new_domains, 0) AS new_domains,
         coalesce(new_ports, 0) AS new_ports, coalesce(protocol_drift, 0) AS protocol_drift, CASE
           WHEN iw.tcp_failed_ratio > f.p99 AND f.p99 < 1 THEN (iw.tcp_failed_ratio - f.p99) / (1 - f.p99) ELSE 0 END
           AS failed_conns, coalesce(volume, 0) AS volume, coalesce(flow_rate, 0) AS flow_rate
  FROM iw LEFT JOIN ius USING (device, scenario) LEFT JOIN idr USING (device, scenario) LEFT JOIN iq USING (device, scenario)
  LEFT JOIN (SELECT device, p99 FROM rs WHERE feature = 'tcp_failed_ratio') f USING (device)),
icl AS (
  UNPIVOT (SELECT device, scenario, {', '.join(f'{c}::DOUBLE AS {c}' for c in COMPONENTS)} FROM iraw)
  ON {', '.join(COMPONENTS)} INTO NAME component VALUE v),
isc AS (
  SELECT device, scenario, 1 - product(1 - x) AS deviation_score, max(x) AS mxc,
    {', '.join(f"max(x) FILTER (WHERE component = '{c}') AS {c}" for c in COMPONENTS)}
  FROM (SELECT device, scenario, component, CASE WHEN p99 IS NULL THEN v
          ELSE greatest(0, least(1, (v - least(p99, 0.99)) / (1 - least(p99, 0.99)))) END AS x
        FROM icl LEFT JOIN cal USING (device, component)) GROUP BY ALL)"""


def sql(body: str) -> str:
    return f"WITH {CTES}\n{body}"


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, service shares and window endpoints of every device."""
    f, d = A.flows(spark, sf), A.dns_queries(spark, sf)
    return windows.behaviour_windows(f, d, W), windows.service_shares(f, W), windows.window_endpoints(f, d, W)


def training(rows: DataFrame) -> DataFrame:
    column = "window_start" if "window_start" in rows.columns else "ts"
    return rows.filter(F.col(column) < CUT)


def known_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return profile.endpoint_counts(A.both_directions(training(A.flows(spark, sf))), training(A.dns_queries(spark, sf)),
                                   training(A.tls_names(spark, sf)))


def fitted(spark: SparkSession, sf: str) -> tuple[profile.Profile, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Calibrated profile, all scored windows, and the stored window tables.

    Windows, service shares, endpoints and raw components each feed several
    later steps, so they are written once.
    """
    tables = tuple(materialize(x, n) for x, n in zip(inputs(spark, sf), ("windows", "shares", "endpoints")))
    w, s, e = tables
    built = profile.build_profile(training(w), training(s), materialize(known_endpoints(spark, sf), "known"))
    p, scores = deviation.fit_and_score(built, w, s, e, F.col("window_start") < CUT, materialize)
    return p, scores, tables


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf)[1]


@query("b3_window_buckets", f"""WITH {A.EVENTS_SQL}
SELECT ws AS window_start, ((ws % 86400) // 3600)::INTEGER AS hour_of_day, count(*) AS n FROM conn GROUP BY ALL""")
def _(spark, sf):
    c = windows.with_window(A.connections(spark, sf), W)
    return c.groupBy("window_start", windows.utc_hour(F.col("window_start")).alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("n"))


@query("d1_window_volume", sql(f"""SELECT device, ws AS window_start, flow_count, unique_destinations, orig_bytes,
  resp_bytes, packets_total, {r('tcp_failed_ratio')} AS tcp_failed_ratio, orig_bytes + resp_bytes AS bytes_total FROM fw"""))
def _(spark, sf):
    return windows.volume_features(A.flows(spark, sf), W)


@query("d2_domain_entropy", sql(f"""SELECT device, ws AS window_start, unique_domains,
  {r('domain_entropy')} AS domain_entropy FROM dw"""))
def _(spark, sf):
    return windows.domain_features(A.dns_queries(spark, sf), W)


@query("d3_service_share", sql(f"SELECT device, ws AS window_start, service, n AS flows, {r('share')} AS share FROM sh"))
def _(spark, sf):
    return windows.service_shares(A.flows(spark, sf), W)


@query("d4_gap_variance", sql(f"""SELECT device, ws AS window_start,
  {r('interflow_gap_variance', 2)} AS interflow_gap_variance FROM gaps"""), digits=2)
def _(spark, sf):
    return windows.gap_variance(A.flows(spark, sf), W)


@query("d5_failed_ratio", f"""WITH {A.EVENTS_SQL}
SELECT device, CASE WHEN count(*) FILTER (WHERE proto = 'tcp') > 0 THEN
  {r("count(*) FILTER (WHERE conn_state = 'S0' AND proto = 'tcp') / count(*) FILTER (WHERE proto = 'tcp')::DOUBLE")} END
  AS tcp_failed_ratio FROM conn GROUP BY device""")
def _(spark, sf):
    tcp = F.col("proto") == "tcp"
    return A.connections(spark, sf).groupBy("device").agg(stats.ratio(
        F.count_if(tcp & F.col("conn_state").isin(windows.FAILED_STATES)), F.count_if(tcp)).alias("tcp_failed_ratio"))


@query("d6_behaviour_windows", sql(f"""SELECT device, ws AS window_start, {W}::INTEGER AS window_seconds, hour_of_day,
  flow_count, unique_destinations, unique_domains, bytes_total, orig_bytes, resp_bytes, packets_total,
  {r('domain_entropy', 2)} AS domain_entropy, {r('interflow_gap_variance', 2)} AS interflow_gap_variance,
  {r('tcp_failed_ratio', 2)} AS tcp_failed_ratio FROM w"""), digits=2)
def _(spark, sf):
    return inputs(spark, sf)[0]


@query("d7_nearest_rank", sql(f"""SELECT device,
  list_sort(list(bytes_total))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p50,
  list_sort(list(bytes_total))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95,
  list_sort(list(bytes_total))[round_even(0.99::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p99,
  max(bytes_total) AS max, count(*) AS n FROM w GROUP BY device"""))
def _(spark, sf):
    return stats.percentiles_nearest(inputs(spark, sf)[0], ["device"], "bytes_total",
                                     {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("d8_quartiles", f"""WITH {A.EVENTS_SQL}
SELECT event_type, count(*) AS n, {r('quantile_cont(value, 0.25)')} AS q1, {r('quantile_cont(value, 0.5)')} AS median,
  {r('quantile_cont(value, 0.75)')} AS q3 FROM conn GROUP BY event_type""")
def _(spark, sf):
    # groups over raw rows have no bound, so this takes the distributed form
    return stats.quantiles(A.connections(spark, sf), ["event_type"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})


@query("d9_robust_stats", sql(f"""SELECT device, feature, {', '.join(f'{r(c, 3)} AS {c}' for c in
  ['median', 'q1', 'q3', 'mean', 'min', 'max', 'p95', 'p99'])}, {r('q3 - q1', 3)} AS iqr,
  {r('low_bound', 1)} AS low_bound, {r('high_bound', 1)} AS high_bound,
  windows_observed, windows_excluded, trim_space FROM rs"""), digits=3)
def _(spark, sf):
    table = profile.robust_stats(training(inputs(spark, sf)[0]))
    # bounds grow to ten digits, so they are compared with fewer decimals
    return table.withColumns({c: F.round(c, 1) for c in ("low_bound", "high_bound")})


@query("d10_service_summary", sql(f"""SELECT device, service, {r('mean_share')} AS mean_share, windows_present,
  {r('window_share')} AS window_share FROM sv"""))
def _(spark, sf):
    w, s, _e = inputs(spark, sf)
    return profile.service_summary(training(w), training(s))


@query("d11_active_hours", sql(f"""SELECT d.device, h.hour::INTEGER AS hour, coalesce(flows, 0) AS flows,
  {r('coalesce(flows, 0) / greatest(tf, 1)::DOUBLE')} AS flow_share, coalesce(nw, 0) AS windows,
  {r('coalesce(nw, 0) / tn::DOUBLE')} AS window_share
  FROM (SELECT device, sum(flow_count)::BIGINT AS tf, count(*) AS tn FROM w WHERE ws < {CUT} GROUP BY ALL) d
  CROSS JOIN range(24) h(hour)
  LEFT JOIN (SELECT device, hour_of_day AS hour, sum(flow_count)::BIGINT AS flows, count(*) AS nw FROM w
             WHERE ws < {CUT} GROUP BY ALL) x ON x.device = d.device AND x.hour = h.hour"""))
def _(spark, sf):
    return profile.active_hours(training(inputs(spark, sf)[0]))


@query("d12_endpoints", sql("SELECT device, kind, value, n FROM ep"))
def _(spark, sf):
    return known_endpoints(spark, sf)


@query("d12_endpoint_totals", sql("""SELECT device, kind, count(*) AS distinct_values, sum(n)::BIGINT AS "rows"
  FROM ep GROUP BY ALL"""))
def _(spark, sf):
    return profile.endpoint_totals(known_endpoints(spark, sf))


@query("d13_observation", sql(f"""SELECT device, count(*) AS active_windows, sum(flow_count)::BIGINT AS flows,
  min(ws) AS first_window, max(ws) AS last_window, {r('(max(ws) - min(ws)) / 86400.0::DOUBLE')} AS span_days
  FROM w WHERE ws < {CUT} GROUP BY device"""))
def _(spark, sf):
    return profile.observation_summary(training(inputs(spark, sf)[0]))


@query("d14_component_calibration", sql(f"""SELECT device, component, {r('p50')} AS p50, {r('p95')} AS p95,
  {r('p99')} AS p99 FROM cal"""))
def _(spark, sf):
    return fitted(spark, sf)[0].calibration


@query("d15_baseline_scores", sql(f"""SELECT device, {', '.join(
    r(f'list_sort(list(deviation_score))[round_even({f}::DOUBLE * (count(*) - 1), 0)::BIGINT + 1]') + f' AS {n}'
    for n, f in [('p50', 0.5), ('p95', 0.95), ('p99', 0.99)])},
  {r('max(deviation_score)')} AS max, count(*) AS windows FROM top WHERE ws < {CUT} GROUP BY device"""))
def _(spark, sf):
    return fitted(spark, sf)[0].baseline_scores


@query("c14_unseen_endpoints", sql("SELECT device, ws AS window_start, kind, value, unseen FROM un"))
def _(spark, sf):
    return deviation.unseen_endpoints(inputs(spark, sf)[2], known_endpoints(spark, sf))


@query("c14_unseen_evidence", sql("""SELECT device, ws AS window_start, kind,
  array_to_string(list_slice(list_sort(list(value)), 1, 20), ' ') AS evidence FROM un WHERE unseen GROUP BY ALL"""))
def _(spark, sf):
    flagged = deviation.unseen_endpoints(inputs(spark, sf)[2], known_endpoints(spark, sf))
    return deviation.unseen_evidence(flagged).withColumn("evidence", F.array_join("evidence", " "))


@query("e1_robust_z", sql(f"""SELECT device, ws AS window_start, max({r('z')}) FILTER (WHERE feature = 'bytes_total')
  AS volume_z, max({r('z')}) FILTER (WHERE feature = 'flow_count') AS flow_z FROM fx GROUP BY ALL"""))
def _(spark, sf):
    w = inputs(spark, sf)[0]
    wide = deviation.wide_stats(profile.robust_stats(training(w)), ["bytes_total", "flow_count"])
    return w.join(wide, "device", "left").select(
        *KEYS, deviation.robust_z(F.col("bytes_total"), "bytes_total").alias("volume_z"),
        deviation.robust_z(F.col("flow_count"), "flow_count").alias("flow_z"))


@query("e2_squash", sql(f"SELECT device, ws AS window_start, {r('volume')} AS volume, {r('flow_rate')} AS flow_rate FROM sq"))
def _(spark, sf):
    w = inputs(spark, sf)[0]
    wide = deviation.wide_stats(profile.robust_stats(training(w)), ["bytes_total", "flow_count"])
    return w.join(wide, "device", "left").select(
        *KEYS, deviation.squash(deviation.robust_z(F.col("bytes_total"), "bytes_total")).alias("volume"),
        deviation.squash(deviation.robust_z(F.col("flow_count"), "flow_count")).alias("flow_rate"))


@query("e3_service_drift", sql(f"""SELECT w.device, w.ws AS window_start, {r('coalesce(protocol_drift, 0)')} AS protocol_drift
  FROM w LEFT JOIN dr USING (device, ws)"""))
def _(spark, sf):
    w, s, _e = inputs(spark, sf)
    return deviation.service_drift(w, s, profile.service_summary(training(w), training(s)))


@query("e4_failed_excess", sql(f"SELECT device, ws AS window_start, {r('failed_conns')} AS failed_conns FROM raw"))
def _(spark, sf):
    w = inputs(spark, sf)[0]
    wide = deviation.wide_stats(profile.robust_stats(training(w), ["tcp_failed_ratio"]), ["tcp_failed_ratio"])
    return w.join(wide, "device", "left").select(
        *KEYS, deviation.failed_excess(F.col("tcp_failed_ratio")).alias("failed_conns"))


@query("e5_raw_components", sql(f"""SELECT device, ws AS window_start,
  {', '.join(f'{r(c)} AS {c}' for c in COMPONENTS)} FROM raw"""))
def _(spark, sf):
    w, s, e = inputs(spark, sf)
    p = profile.build_profile(training(w), training(s), known_endpoints(spark, sf))
    return deviation.raw_components(p, w, s, e)


@query("e6_calibrated_components", sql(f"""SELECT device, ws AS window_start,
  {', '.join(f'{r(c)} AS {c}' for c in COMPONENTS)} FROM top"""))
def _(spark, sf):
    return scored(spark, sf).select(*KEYS, *COMPONENTS)


@query("e7_noisy_or", sql(f"""SELECT device, ws AS window_start,
  {r('1 - (' + ' * '.join(f'(1 - {c})' for c in COMPONENTS) + ')')} AS raw_score FROM raw"""))
def _(spark, sf):
    w, s, e = inputs(spark, sf)
    p = profile.build_profile(training(w), training(s), known_endpoints(spark, sf))
    return deviation.raw_components(p, w, s, e).select(
        *KEYS, deviation.noisy_or([F.col(c) for c in COMPONENTS]).alias("raw_score"))


@query("e8_deviation_score", sql(f"""SELECT device, ws AS window_start, {r('deviation_score')} AS deviation_score,
  top_component, calibrated FROM top WHERE ws >= {CUT}"""))
def _(spark, sf):
    return (scored(spark, sf).filter(F.col("window_start") >= CUT)
            .select(*KEYS, "deviation_score", "top_component", "calibrated").orderBy(F.desc("deviation_score"), *KEYS))


@query("e9_score_summary", sql(f"""SELECT device, count(*) AS windows,
  {r('list_sort(list(deviation_score))[count(*) // 2 + 1]')} AS median,
  {r('list_sort(list(deviation_score))[floor(0.99::DOUBLE * (count(*) - 1))::BIGINT + 1]')} AS p99,
  {r('max(deviation_score)')} AS max, count(*) FILTER (WHERE deviation_score > 0.5) AS flagged,
  {r('count(*) FILTER (WHERE deviation_score > 0.5) / count(*)::DOUBLE')} AS flagged_share
  FROM top WHERE ws >= {CUT} GROUP BY device"""))
def _(spark, sf):
    return deviation.score_summary(scored(spark, sf).filter(F.col("window_start") >= CUT))


@query("e9_top_windows", sql(f"""SELECT device, ws AS window_start, {r('deviation_score')} AS deviation_score,
  position::INTEGER AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY device ORDER BY round(deviation_score, 9) DESC, ws) AS position FROM top WHERE ws >= {CUT})
  WHERE position <= 5"""))
def _(spark, sf):
    late = scored(spark, sf).filter(F.col("window_start") >= CUT).withColumn(
        "deviation_score", F.round("deviation_score", 9))
    return deviation.top_windows(late, 5).select(*KEYS, "deviation_score", "position")


@query("e10_injected_changes", f"""WITH {CTES}{INJECTED_SQL}
SELECT device::VARCHAR AS device, scenario, {r('deviation_score')} AS deviation_score,
  CASE {' '.join(f"WHEN {c} = mxc AND mxc > 0 THEN '{c}'" for c in COMPONENTS)} END AS top_component,
  deviation_score > 0.5 AS detected,
  CASE scenario {' '.join(f"WHEN '{s}' THEN " + ' OR '.join(f'{c} > 0' for c in x['expected'])
                          for s, x in CHANGES.items())} END AS expected_driver FROM isc""")
def _(spark, sf):
    p, _scores, (w, s, e) = fitted(spark, sf)
    changed = deviation.injected_changes(deviation.typical_windows(training(w)), s, e)
    return deviation.injection_verdicts(deviation.score_windows(deviation.for_scenarios(p), *changed))
