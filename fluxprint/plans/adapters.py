"""The driver's tables as the library's canonical inputs.

Operators never mention ``user_id`` or ``props``; this module is the only place
that knows how an event table becomes flow telemetry, and it states each mapping
twice: as DataFrame code and, for the oracle, as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.schemas import DEVICE_TYPES
from fluxprint.session import configure

DAY = 86_400
START = 1_704_067_200            # first day of the event table, UTC
END = START + 30 * DAY
TRAIN_END = START + 21 * DAY     # the profile is frozen on the first 70 %
WINDOW = 21_600                  # the table is sparse, so windows are six hours
MAC_CHANGE = START + 12 * DAY + 3600   # one in thirteen devices gets another MAC, within a window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def address(device: str) -> str:
    """A private IPv4 address per device number."""
    return (f"concat_ws('.', '10', cast(floor({device} / 65536) % 256 as string), cast(floor({device} / 256) % 256 as string), "
            f"cast({device} % 256 as string))")


def hardware_address(device: str) -> str:
    return f"regexp_replace(lpad(lower(hex({device})), 12, '0'), '(..)(?!$)', '$1:')"


def connections(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Every event as one connection; ``raw`` may be a stream of the same table."""
    events = table(spark, sf_dir, "events") if raw is None else raw
    base = events.selectExpr(
        "event_id", "user_id as device", "event_type", "value", "unix_micros(cast(ts as timestamp)) / 1000000.0D as ts",
        "cast(get_json_object(props, '$.k') as bigint) as k", "cast(round(value * 100) as bigint) as cents")
    return base.selectExpr(
        "event_id", "concat('C', event_id) as uid", "device", "ts", "k", "event_type", f"{address('device')} as orig_h",
        f"case when k < 40 then concat('203.0.113.', k % 2) else {address('(k - 40)')} end as resp_h",
        "cast(40000 + event_id % 20000 as int) as orig_p",
        "case when event_type in ('click', 'view') then 443 when event_type = 'purchase' then 8080 when event_type = 'error' then 22 "
        "else 53 end as resp_p", "if(event_type = 'signup', 'udp', 'tcp') as proto",
        "case when event_type = 'click' then 'ssl' when event_type in ('view', 'purchase') then 'http' when event_type = 'signup' then 'dns' end as service",
        "if(event_type = 'error', 'S0', 'SF') as conn_state", "cents as orig_bytes", "cast(floor(cents / 3) as bigint) as resp_bytes",
        "cast(1 + floor(cents / 1000) as bigint) as orig_pkts", "cast(floor(cents / 2000) as bigint) as resp_pkts", "value",
        f"{hardware_address('device')} as orig_mac")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections(spark, sf_dir).filter("event_type <> 'signup'")


def dns_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections(spark, sf_dir).filter("event_type = 'signup'").selectExpr(
        "device", "ts", "concat('h', k % 20, '.example.net') as query")


def tls_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections(spark, sf_dir).filter("event_type = 'view'").selectExpr(
        "device", "ts", "concat('h', k % 7, '.example.net') as name")


def both_directions(flow_rows: DataFrame) -> DataFrame:
    """Flows as seen by the opener and, for inventory peers, by the receiver; one pass."""
    ends = "if(k >= 40, array(named_struct('d', device, 'i', true), named_struct('d', k - 40, 'i', false)), array(named_struct('d', device, 'i', true)))"
    return flow_rows.withColumn("_e", F.expr(f"explode({ends})")).withColumns(
        {"device": F.col("_e.d"), "initiated": F.col("_e.i")}).drop("_e")


def telemetry(spark: SparkSession, sf_dir: str, window: int = WINDOW, raw: DataFrame | None = None) -> DataFrame:
    """Interval telemetry: one row per connection and window."""
    return connections(spark, sf_dir, raw).selectExpr(
        f"cast(floor(ts / {window}) * {window} as bigint) as window_start", "uid", "orig_h", "resp_h", "orig_p", "resp_p", "proto",
        "ts as flow_start", "orig_bytes as orig_ip_bytes", "resp_bytes as resp_ip_bytes", "orig_pkts", "resp_pkts",
        "value / 100 as observed_duration", "proto = 'tcp' and event_type <> 'error' and k % 5 <> 0 as established",
        "event_type = 'error' as failed", "proto = 'tcp' as tcp_syn_observed", "k % 11 <> 0 as new_flow", "orig_mac",
        "cast(null as string) as resp_mac")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: every user is a device; its kind follows its number."""
    ids = table(spark, sf_dir, "events").selectExpr("user_id as id").distinct()
    kinds = ", ".join(f"'{t}'" for t in DEVICE_TYPES)
    return ids.selectExpr("concat('d', id) as device", "id", f"element_at(array({kinds}), cast(id % {len(DEVICE_TYPES)} as int) + 1) as device_type",
                          f"{hardware_address('id')} as mac")


def leases(spark: SparkSession, sf_dir: str, inventory: DataFrame | None = None) -> DataFrame:
    """Address leases: one in seven ends half way, one in seven has only its MAC; ``inventory`` are the devices if they are stored."""
    known = devices(spark, sf_dir) if inventory is None else inventory
    return known.filter("id % 7 <> 3").selectExpr(
        "device", f"{address('id')} as ip", f"cast({START} as bigint) as lease_start",
        f"cast(if(id % 7 = 0, {START + 15 * DAY}, {END}) as bigint) as lease_end")


def identity_spans(spark: SparkSession, sf_dir: str, inventory: DataFrame | None = None) -> DataFrame:
    """What makes up a device: its address while leased, and its MAC, which one in thirteen devices changes."""
    known = devices(spark, sf_dir) if inventory is None else inventory
    macs = known.select("device", F.expr(f"""explode(if(id % 13 = 5,
        array(named_struct('v', mac, 'start', {START}, 'end', {MAC_CHANGE}), named_struct('v', concat(mac, ':b'), 'start', {MAC_CHANGE}, 'end', null)),
        array(named_struct('v', mac, 'start', {START}, 'end', null)))) as m"""))
    held = macs.select("device", F.concat(F.lit("mac:"), F.col("m.v")).alias("value"), F.col("m.start").cast("double").alias("start"), F.col("m.end").cast("double").alias("end"))
    return held.unionByName(leases(spark, sf_dir, inventory).select("device", F.concat(F.lit("ip:"), F.col("ip")).alias("value"), F.col("lease_start").cast("double").alias("start"),
                                                         F.col("lease_end").cast("double").alias("end")))


def outages(spark: SparkSession, sf_dir: str, inventory: DataFrame | None = None) -> DataFrame:
    """One in ten devices is dark for a day; the sensor is dark for six hours."""
    dark = f"""explode(filter(array(
        if(id % 10 = 4, named_struct('start', {START + 10 * DAY}, 'end', {START + 11 * DAY}), null),
        named_struct('start', {START + 20 * DAY}, 'end', {START + 20 * DAY + WINDOW})), x -> x is not null)) as o"""
    known = devices(spark, sf_dir) if inventory is None else inventory
    return known.selectExpr("device", dark).selectExpr("device", "o.start as start", "o.end as end")


# The same mappings for the oracle.
EVENTS_SQL = f"""
ev AS (
  SELECT event_id, 'C' || event_id AS uid, user_id AS device, epoch_us(ts)::DOUBLE / 1000000 AS t,
         regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, event_type, value,
         round(value * 100)::BIGINT AS cents
  FROM events),
conn AS (
  SELECT event_id, uid, device, t, k, event_type, value,
         '10.' || ((device // 65536) % 256) || '.' || ((device // 256) % 256) || '.' || (device % 256) AS orig_h,
         CASE WHEN k < 40 THEN '203.0.113.' || (k % 2)
              ELSE '10.' || (((k - 40) // 65536) % 256) || '.' || (((k - 40) // 256) % 256) || '.' || ((k - 40) % 256)
         END AS resp_h,
         (40000 + event_id % 20000)::INTEGER AS orig_p,
         CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080 WHEN 'error' THEN 22
              ELSE 53 END AS resp_p,
         CASE WHEN event_type = 'signup' THEN 'udp' ELSE 'tcp' END AS proto,
         CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'http'
              WHEN 'signup' THEN 'dns' END AS service,
         CASE WHEN event_type = 'error' THEN 'S0' ELSE 'SF' END AS conn_state,
         cents AS ob, (cents // 3)::BIGINT AS rb, (1 + cents // 1000)::BIGINT AS op, (cents // 2000)::BIGINT AS rp,
         (floor(t / {WINDOW}) * {WINDOW})::BIGINT AS ws
  FROM ev)"""

TELEMETRY_SQL = EVENTS_SQL + f""",
tele AS (
  SELECT ws, uid, orig_h, resp_h, orig_p, resp_p, proto, t, ob, rb, op, rp, value / 100 AS dur,
         (proto = 'tcp' AND event_type <> 'error' AND k % 5 <> 0) AS est, event_type = 'error' AS failed,
         k % 11 <> 0 AS nf, device AS did
  FROM conn),
dev AS (
  SELECT DISTINCT user_id AS id, 'd' || user_id AS device,
         (['hub','speaker','light','plug','camera','doorbell','motion_sensor','printer','environmental_sensor',
           'scale','unknown'])[user_id % 11 + 1] AS device_type
  FROM events),
lease AS (
  SELECT device, '10.' || ((id // 65536) % 256) || '.' || ((id // 256) % 256) || '.' || (id % 256) AS ip,
         {START} AS ls, CASE WHEN id % 7 = 0 THEN {START + 15 * DAY} ELSE {END} END AS le
  FROM dev WHERE id % 7 <> 3),
idspan AS (
  SELECT device, 'ip:' || ip AS v, ls AS s, le AS e FROM lease
  UNION ALL SELECT device, 'mac:' || id, {START}, CASE WHEN id % 13 = 5 THEN {MAC_CHANGE} ELSE {2**53} END FROM dev
  UNION ALL SELECT device, 'mac:' || id || ':b', {MAC_CHANGE}, {2**53} FROM dev WHERE id % 13 = 5),
outage AS (
  SELECT device, {START + 10 * DAY} AS s, {START + 11 * DAY} AS e FROM dev WHERE id % 10 = 4
  UNION ALL SELECT device, {START + 20 * DAY}, {START + 20 * DAY + WINDOW} FROM dev)"""
