"""Permissions, evidence, decisions and matching joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.functions.scalars import bucket_start, digest
from fluxprint.operators import decisions, evidence, identity, matching, policy
from fluxprint.plans import adapters as A
from fluxprint.plans import devices as V
from fluxprint.plans.registry import query, r
from fluxprint.schemas import IDENTITY
from fluxprint.session import materialize

W = A.WINDOW
LEARNED = A.START + 10 * A.DAY       # permissions are what was seen on TLS until then
TTL = 6 * 3600


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    return A.leases(spark, sf, materialize(A.devices(spark, sf), "inventory")).select("device", "ip", F.col("lease_start").alias("valid_from"), F.col("lease_end").alias("valid_until"))


def bound_flows(spark: SparkSession, sf: str) -> DataFrame:
    """New flows with their bound ends, stored, as permissions, rules and outcomes all read them."""
    return materialize(policy.bind_ends(A.telemetry(spark, sf).withColumn("sensor_id", F.lit("s1")), bindings(spark, sf)), "bound")


def permissions(spark: SparkSession, sf: str, bound: DataFrame | None = None) -> DataFrame:
    seen = bound_flows(spark, sf) if bound is None else bound
    return (seen.filter((F.col("window_start") < LEARNED) & (F.col("resp_p") == 443))
            .filter(F.col("initiator").isNotNull() & F.col("responder").isNotNull())
            .select("initiator", "responder", "proto", F.col("resp_p").alias("service_port"), F.lit("learned").alias("reason")).distinct())


def external_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = A.devices(spark, sf)
    by_net = d.filter(F.col("id") % 2 == 0).select(
        (F.col("id") * 2).cast("int").alias("ordinal"), F.col("device").alias("initiator"), F.lit("tcp").alias("proto"),
        F.lit(443).alias("service_port"), F.lit("203.0.113.0/32").alias("network"), F.lit(None).cast("string").alias("fqdn"),
        F.lit("vendor network").alias("reason"))
    by_name = d.select(
        (F.col("id") * 2 + 1).cast("int").alias("ordinal"), F.col("device").alias("initiator"), F.lit("tcp").alias("proto"),
        F.lit(8080).alias("service_port"), F.lit(None).cast("string").alias("network"), F.lit("Svc1.example.net.").alias("fqdn"),
        F.lit("vendor name").alias("reason"))
    return by_net.unionByName(by_name)


def name_evidence(spark: SparkSession, sf: str) -> DataFrame:
    dns = A.connections(spark, sf).filter(F.col("event_type") == "signup")
    return dns.select(
        F.lit("s1").alias("sensor_id"), F.concat(F.lit("svc"), (F.col("k") % 3).cast("string"), F.lit(".example.net")).alias("name"),
        F.concat(F.lit("203.0.113."), (F.col("k") % 2).cast("string")).alias("address"), F.col("ts").alias("valid_from"),
        (F.col("ts") + F.when(F.col("k") % 4 == 0, F.lit(TTL)).otherwise(F.lit(60))).alias("valid_until"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    bound = bound_flows(spark, sf)
    return policy.evaluate_bound(bound, permissions(spark, sf, bound), external_rules(spark, sf), materialize(name_evidence(spark, sf), "names"), W / 6)


def proposed(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals, stored, as runs, cooldowns and overrides read them several times."""
    return materialize(decisions.proposals(materialize(outcomes(spark, sf), "outcomes"), scores(spark, sf)), "proposals")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence per window and device, from the mean value and the error share."""
    c = A.connections(spark, sf).withColumn("window_start", bucket_start(F.col("ts"), W))
    g = c.groupBy("window_start", F.concat(F.lit("d"), F.col("device").cast("string")).alias("device")).agg(
        F.round(F.avg("value") / 50, 6).alias("_a"), F.avg((F.col("event_type") == "error").cast("double")).alias("_b"),
        F.count(F.lit(1)).alias("_n"))
    b = F.when(F.col("_n") > 1, F.round("_b", 6))
    return g.select("window_start", "device", F.lit("ok").alias("status"), F.col("_a").alias("behavioral_score"),
                    (F.col("_a") > 1.5).alias("behavioral_flag"), b.alias("link_anomaly"), (b > 0.4).alias("link_flag"))


CTES = V.CTES + f""",
bound AS (
  SELECT tele.*, a.device AS init, b.device AS resp FROM tele LEFT JOIN lease a ON a.ip = orig_h AND a.ls <= ws AND ws < a.le
  LEFT JOIN lease b ON b.ip = resp_h AND b.ls <= ws AND ws < b.le WHERE nf),
perm AS (SELECT DISTINCT init, resp, proto, resp_p FROM bound WHERE ws < {LEARNED} AND resp_p = 443 AND init IS NOT NULL AND resp IS NOT NULL),
nev AS (SELECT 'svc' || (k % 3) || '.example.net' AS name, '203.0.113.' || (k % 2) AS address, t AS vf,
          t + CASE WHEN k % 4 = 0 THEN {TTL} ELSE 60 END AS vu FROM conn WHERE event_type = 'signup'),
outc AS (
  SELECT uid, ws, t, orig_h, resp_h, proto, resp_p, init, resp,
    init IS NOT NULL AND resp IS NULL AND resp_p = 443 AND proto = 'tcp' AND resp_h = '203.0.113.0' AND did % 2 = 0 AS net,
    init IS NOT NULL AND resp IS NULL AND resp_p = 8080 AND proto = 'tcp' AND EXISTS (
      SELECT 1 FROM nev WHERE name = 'svc1.example.net' AND address = resp_h AND vf <= t AND t < vu) AS nam,
    EXISTS (SELECT 1 FROM perm p WHERE p.init = bound.init AND p.resp = bound.resp AND p.proto = bound.proto AND p.resp_p = bound.resp_p) AS pm
  FROM bound),
outcome AS (
  SELECT uid AS flow_uid, ws AS window_start, t AS observed_at, orig_h AS initiator_ip, resp_h AS responder_ip, proto,
    resp_p AS service_port, init AS initiator_device_id, resp AS responder_device_id,
    CASE WHEN init IS NULL THEN 'unknown_device' WHEN resp IS NULL THEN CASE WHEN net OR nam THEN 'allowed' ELSE 'unknown_policy' END
         WHEN pm THEN 'allowed' ELSE 'denied' END AS permission,
    CASE WHEN init IS NULL THEN 'initiator_not_in_inventory' WHEN resp IS NULL THEN CASE WHEN net THEN 'vendor network'
           WHEN nam THEN 'vendor name' ELSE 'no_verified_external_name_or_network_permission' END
         WHEN pm THEN 'learned' ELSE 'no_matching_permission' END AS reason
  FROM outc),
score AS (
  SELECT ws AS window_start, 'd' || device AS device, 'ok' AS status, round(avg(value) / 50, 6) AS behavioral_score,
    round(avg(value) / 50, 6) > 1.5 AS behavioral_flag,
    CASE WHEN count(*) > 1 THEN round(avg((event_type = 'error')::INT), 6) END AS link_anomaly,
    CASE WHEN count(*) > 1 THEN round(avg((event_type = 'error')::INT), 6) > 0.4 END AS link_flag
  FROM conn GROUP BY ALL),
prop AS (
  SELECT o.window_start, initiator_device_id AS target_device_id, proto AS scope_proto, responder_ip AS scope_ip,
    service_port AS scope_port, flow_uid, CASE WHEN link_flag THEN 'block' ELSE 'alert' END AS tier,
    CASE WHEN link_flag THEN 'forbidden_exchange_with_link_anomaly' ELSE 'forbidden_exchange' END AS reason
  FROM outcome o LEFT JOIN score s ON s.window_start = o.window_start AND s.device = initiator_device_id WHERE permission = 'denied'
  UNION ALL
  SELECT window_start, device, NULL, NULL, NULL, NULL, 'alert', 'behavioral_anomaly_requires_flow_attribution' FROM score s
  WHERE behavioral_flag AND NOT EXISTS (SELECT 1 FROM outcome o WHERE permission = 'denied' AND o.window_start = s.window_start
    AND initiator_device_id = s.device)),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY target_device_id, scope_proto, scope_ip, scope_port, tier, anchor ORDER BY window_start)::INTEGER
      AS consecutive_windows,
    window_start - lag(window_start) OVER (PARTITION BY target_device_id, scope_proto, scope_ip, scope_port, tier ORDER BY window_start) AS since
  FROM (SELECT *, window_start - {W} * row_number() OVER (
          PARTITION BY target_device_id, scope_proto, scope_ip, scope_port, tier ORDER BY window_start) AS anchor
        FROM (SELECT DISTINCT target_device_id, scope_proto, scope_ip, scope_port, tier, window_start FROM prop)))"""


def sql(body: str) -> str:
    return f"WITH {CTES}\n{body}"


@query("c2_as_of_binding", sql("SELECT uid, ws AS window_start, init AS initiator, resp AS responder FROM bound"))
def _(spark, sf):
    return policy.bind_ends(A.telemetry(spark, sf), bindings(spark, sf)).select("uid", "window_start", "initiator", "responder")


@query("c3_clipped_inventory", sql(f"""SELECT g.device, g.ws AS window_start, count(ip) AS live_leases,
  min(CASE WHEN ip IS NOT NULL THEN greatest(ls, g.ws) END) AS first_clip, max(CASE WHEN ip IS NOT NULL THEN least(le, g.ws + {W}) END) AS last_clip,
  bool_or(ip IS NULL OR (ls > g.ws AND ls < g.ws + {W}) OR (le > g.ws AND le < g.ws + {W})) AS unavailable
  FROM grid g LEFT JOIN (SELECT device, ip, ls + 3600 AS ls, le FROM lease) l ON l.device = g.device AND ls < g.ws + {W} AND le > g.ws
  GROUP BY ALL"""))
def _(spark, sf):
    moved = A.leases(spark, sf).withColumn("lease_start", F.col("lease_start") + 3600)
    clipped = identity.clipped_inventory(V.grid(spark, sf).select("device", "window_start"), moved, W)
    return identity.inventory_status(clipped)


@query("c4_device_addresses", f"WITH {A.EVENTS_SQL} SELECT DISTINCT device, orig_h AS ip FROM conn")
def _(spark, sf):
    return identity.addresses_of(A.connections(spark, sf))


@query("c4_dns_stream", f"""WITH {A.EVENTS_SQL} SELECT device, {r('t')} AS ts, 'name' || (k % 9) || '.example.org' AS query
  FROM conn WHERE event_type = 'signup' AND k % 5 NOT IN (0, 1)""")
def _(spark, sf):
    c = A.connections(spark, sf)
    suffix = F.when(F.col("k") % 5 == 0, ".local").when(F.col("k") % 5 == 1, ".in-addr.arpa").otherwise(".Example.ORG")
    log = c.filter(F.col("event_type") == "signup").select(
        "orig_h", "ts", F.concat(F.lit("Name"), (F.col("k") % 9).cast("string"), suffix).alias("query"))
    return identity.dns_stream(log, identity.addresses_of(c))


@query("c5_certificate_names", f"""WITH {A.EVENTS_SQL}
  SELECT device, 'api' || (k % 6) || '.example.com' AS name FROM conn WHERE event_type = 'view' AND k % 3 <> 0
  UNION ALL SELECT DISTINCT device, 'cdn' || (k % 12) || '.example.net' FROM conn WHERE event_type = 'view' AND (k % 12) % 4 <> 0""")
def _(spark, sf):
    c = A.connections(spark, sf)
    views = c.filter(F.col("event_type") == "view")
    k = F.col("k")
    ssl = views.select("orig_h", F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("API"), (k % 6).cast("string"), F.lit(".example.com")))
                       .alias("server_name"), F.concat(F.lit("F"), (k % 12).cast("string"), F.lit(",CA1")).alias("cert_chain_fuids"))
    n = F.substr("id", F.lit(2)).cast("int")
    x509 = ssl.select(F.explode(F.split("cert_chain_fuids", ",")).alias("id")).distinct().withColumn("certificate.subject", F.when(
        F.col("id") == "CA1", "CN=Example Class 3 CA - G4,O=Example").when(n % 4 == 0, "O=None").otherwise(
        F.concat(F.lit("O=Example, CN=*.CDN"), n.cast("string"), F.lit(".example.net"))))
    return identity.tls_names(ssl, x509, identity.addresses_of(c))


@query("c6_permission_outcome", sql(f"SELECT * EXCLUDE (observed_at), {r('observed_at')} AS observed_at FROM outcome"))
def _(spark, sf):
    return outcomes(spark, sf)


@query("c7_external_permission", sql("""SELECT uid, ws AS window_start, CASE WHEN net THEN 'vendor network' ELSE 'vendor name' END
  AS external_reason FROM outc WHERE net OR nam"""))
def _(spark, sf):
    bound = bound_flows(spark, sf)
    leaving = bound.filter(F.col("initiator").isNotNull() & F.col("responder").isNull())
    return policy.external_matches(leaving, external_rules(spark, sf), materialize(name_evidence(spark, sf), "names"), W / 6).drop("ordinal")


@query("c8_name_evidence", f"""WITH {A.EVENTS_SQL}
  SELECT DISTINCT 's1' AS sensor_id, 'svc' || (k % 3) AS name, '203.0.113.' || (k % 2) AS address, {r('t')} AS valid_from,
    {r('t + CASE WHEN k % 4 = 0 THEN 600 ELSE 86400 END')} AS valid_until
  FROM conn WHERE event_type = 'signup' AND k % 7 <> 0 AND t < {A.TRAIN_END}
    AND t + CASE WHEN k % 4 = 0 THEN 600 ELSE 86400 END > {A.TRAIN_END - W}""")
def _(spark, sf):
    k = F.col("k")
    ttl = F.when(k % 7 == 0, 0).when(k % 4 == 0, 600).otherwise(86400)
    answers = A.connections(spark, sf).filter(F.col("event_type") == "signup").select(
        F.lit("s1").alias("sensor_id"), "ts", F.concat(F.lit("svc"), (k % 3).cast("string")).alias("query"),
        F.array(F.lit("alias.example.net"), F.concat(F.lit("203.0.113."), (k % 2).cast("string"))).alias("answers"),
        F.array(F.lit(5.0), ttl.cast("double")).alias("ttls"))
    return identity.name_evidence(answers, F.lit(A.TRAIN_END - W), F.lit(A.TRAIN_END))


OBSERVED = f"""
obs AS (
  SELECT 'r' || (device % 3) AS run_id, 's1' AS session_id, 'n' || device AS sensor_id, 'v1' AS inventory_version, ws AS window_start,
    ws + {W} AS window_end, 'live' AS observation_kind, bool_or(event_type = 'click') AS has_b,
    bool_or(event_type = 'view') AS has_p, max(k) < 80 AS fresh, NOT bool_or(event_type = 'error') AS ok
  FROM conn GROUP BY ALL)"""


def observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows per sensor, and the two evidence branches that exist for some of them."""
    kind = F.col("event_type")
    g = A.connections(spark, sf).groupBy("device", bucket_start(F.col("ts"), W).alias("window_start")).agg(
        F.bool_or(kind == "click").alias("has_b"), F.bool_or(kind == "view").alias("has_p"), (F.max("k") < 80).alias("fresh"),
        (~F.bool_or(kind == "error")).alias("available"))
    rows = g.select(
        F.concat(F.lit("r"), (F.col("device") % 3).cast("string")).alias("run_id"), F.lit("s1").alias("session_id"),
        F.concat(F.lit("n"), F.col("device").cast("string")).alias("sensor_id"), F.lit("v1").alias("inventory_version"), "window_start",
        (F.col("window_start") + W).alias("window_end"), F.lit("live").alias("observation_kind"), "has_b", "has_p", "fresh", "available")
    return (rows.select(*IDENTITY), rows.filter("has_b").select(*IDENTITY, "fresh"),
            rows.filter("has_p").select(*IDENTITY, "available"))


@query("c9_evidence_join", f"""WITH {A.EVENTS_SQL}, {OBSERVED}
  SELECT run_id, session_id, sensor_id, inventory_version, window_start, window_end, observation_kind,
    CASE WHEN has_b AND fresh THEN 'available' WHEN has_b THEN 'stale' ELSE 'unavailable' END AS behaviour_status,
    CASE WHEN has_p AND ok THEN 'available' ELSE 'unavailable' END AS policy_status,
    NOT (has_b AND fresh) OR NOT (has_p AND ok) AS partial FROM obs""")
def _(spark, sf):
    return evidence.join_branches(*observations(spark, sf)).drop("join_id")


PAGES = """
pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), ''), 'other') AS device,
        starts_with(url, 'https') AS secure FROM pages),
fd AS (SELECT DISTINCT device, 'domain' AS kind, host[strpos(host, '.') + 1:] AS fact FROM pg WHERE NOT secure),
fp AS (SELECT DISTINCT device, 'port' AS kind, 'tcp/' || (page_id % 50) AS fact FROM pg WHERE NOT secure),
fn AS (SELECT DISTINCT device, 'network' AS kind, '10.' || (page_id % 20) || '.0.0/16' AS fact FROM pg WHERE NOT secure),
onm AS (SELECT DISTINCT device, host AS name FROM pg WHERE secure),
opt AS (SELECT DISTINCT device, 'tcp/' || (page_id % 40) AS port FROM pg WHERE secure),
oad AS (SELECT DISTINCT device, CASE WHEN page_id % 3 = 1 THEN '10.' || (page_id % 30) || '.1.1' ELSE '8.8.' || (page_id % 30) || '.1' END AS address
        FROM pg WHERE secure),
rel AS (SELECT DISTINCT d.device, fact AS domain, name FROM fd d JOIN onm o ON o.device = d.device AND (fact = name
        OR ends_with(name, '.' || fact) OR ends_with(fact, '.' || name))),
mt AS (
  SELECT device, kind, fact, EXISTS (SELECT 1 FROM rel WHERE rel.device = fd.device AND domain = fact) AS matched FROM fd
  UNION ALL SELECT device, kind, fact, EXISTS (SELECT 1 FROM opt WHERE opt.device = fp.device AND port = fact) FROM fp
  UNION ALL SELECT device, kind, fact, EXISTS (SELECT 1 FROM oad WHERE oad.device = fn.device
    AND starts_with(address, replace(fact, '.0.0/16', '.'))) FROM fn),
rd AS (
  SELECT device, count(*) AS checkable, count(*) FILTER (WHERE matched) AS matched,
    count(*) FILTER (WHERE kind = 'domain') AS domain_total, count(*) FILTER (WHERE kind = 'domain' AND matched) AS domain_matched,
    count(*) FILTER (WHERE kind = 'port') AS port_total, count(*) FILTER (WHERE kind = 'port' AND matched) AS port_matched,
    count(*) FILTER (WHERE kind = 'network') AS network_total, count(*) FILTER (WHERE kind = 'network' AND matched) AS network_matched,
    count(*) FILTER (WHERE matched) / count(*)::DOUBLE AS fidelity
  FROM mt GROUP BY ALL)"""


def page_endpoints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts from plain pages, observed names, ports and addresses from secure ones; the device is the language path, or ``other``."""
    p = A.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.expr(r"coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1), ''), 'other')").alias("device"),
        F.col("url").startswith("https").alias("secure"))
    n = F.col("page_id")
    facts = p.filter(~F.col("secure")).select("device", F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), F.expr("substring(host, instr(host, '.') + 1)").alias("fact")),
        F.struct(F.lit("port").alias("kind"), F.concat(F.lit("tcp/"), (n % 50).cast("string")).alias("fact")),
        F.struct(F.lit("network").alias("kind"), F.concat(F.lit("10."), (n % 20).cast("string"), F.lit(".0.0/16")).alias("fact")),
    )).alias("f")).select("device", "f.kind", "f.fact")
    seen = p.filter("secure")
    address = F.when(n % 3 == 1, F.concat(F.lit("10."), (n % 30).cast("string"), F.lit(".1.1"))).otherwise(
        F.concat(F.lit("8.8."), (n % 30).cast("string"), F.lit(".1")))
    return (facts, seen.select("device", F.col("host").alias("name")),
            seen.select("device", F.concat(F.lit("tcp/"), (n % 40).cast("string")).alias("port")), seen.select("device", address.alias("address")))


@query("c10_related_names", f"WITH {PAGES} SELECT * FROM rel")
def _(spark, sf):
    facts, names, _ports, _addresses = page_endpoints(spark, sf)
    return matching.related_names(facts.filter("kind = 'domain'").select("device", F.col("fact").alias("domain")), names, ["device"])


@query("b16_in_networks", f"""WITH {PAGES} SELECT DISTINCT oad.device, address, fact AS network FROM oad JOIN fn ON fn.device = oad.device
  AND starts_with(address, replace(fact, '.0.0/16', '.'))""")
def _(spark, sf):
    facts, _names, _ports, addresses = page_endpoints(spark, sf)
    return matching.in_networks(addresses, facts.filter("kind = 'network'").select("device", F.col("fact").alias("network")), ["device"])


@query("b16_private_addresses", f"""WITH {PAGES} SELECT device, bool_or(starts_with(address, '10.')) AS device_talks_on_lan FROM oad GROUP BY ALL""")
def _(spark, sf):
    return policy.talks_on_lan(page_endpoints(spark, sf)[3])


@query("i5_matched_facts", f"WITH {PAGES} SELECT * FROM mt")
def _(spark, sf):
    return policy.match_facts(*page_endpoints(spark, sf))


@query("i5_recall_by_device", f"WITH {PAGES} SELECT * EXCLUDE (fidelity), {r('fidelity')} AS fidelity FROM rd")
def _(spark, sf):
    return policy.recall_by_device(policy.match_facts(*page_endpoints(spark, sf)))


@query("i5_recall_overall", f"""WITH {PAGES} SELECT count(fidelity) AS devices, sum(matched)::BIGINT AS matched,
  sum(checkable)::BIGINT AS checkable, {r('sum(matched) / sum(checkable)')} AS fidelity_micro, {r('avg(fidelity)')} AS fidelity_macro FROM rd""")
def _(spark, sf):
    return policy.recall_overall(policy.recall_by_device(policy.match_facts(*page_endpoints(spark, sf))))


@query("i5_beyond_policy", f"""WITH {PAGES}
  SELECT device, 'domain' AS kind, name AS value FROM onm WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.device = onm.device AND rel.name = onm.name)
  UNION ALL SELECT device, 'port', port FROM opt WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.device = opt.device AND fact = port)""")
def _(spark, sf):
    facts, names, ports, _addresses = page_endpoints(spark, sf)
    return policy.beyond_policy(facts, names, ports)


@query("c11_band_match", f"""WITH {A.EVENTS_SQL}
  SELECT event_id, EXISTS (SELECT 1 FROM conn b WHERE b.event_type = 'purchase' AND b.device = a.device AND abs(b.t - a.t) <= 7200) AS found
  FROM conn a WHERE event_type = 'click'""")
def _(spark, sf):
    c = A.connections(spark, sf).select("event_id", "device", "ts", "event_type")
    return matching.band_match(c.filter("event_type = 'click'"), c.filter("event_type = 'purchase'"), ["device"], "ts", "ts",
                               7200.0, "event_id").select("event_id", "found")


LABELS = f"""
lb AS (SELECT event_id AS label_id, device, floor(t)::BIGINT AS s, floor(t)::BIGINT + {2 * A.DAY} AS e, (value > 50)::INT AS label, k, value FROM conn
       WHERE event_type = 'purchase'),
gw AS (SELECT d.device, g.ws::BIGINT AS ws FROM (SELECT DISTINCT device FROM conn) d, range({A.START}, {A.END + 3 * A.DAY}, {W}) g(ws))"""


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    start = F.floor("ts").cast("bigint")
    return A.connections(spark, sf).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("label_id"), "device", start.alias("start"), (start + 2 * A.DAY).alias("end"),
        (F.col("value") > 50).cast("int").alias("label"), "k", "value")


@query("c12_window_labels", f"""WITH {A.EVENTS_SQL}, {LABELS}
  SELECT gw.device, ws AS window_start, CASE WHEN count(DISTINCT label) = 1 AND bool_or(s <= ws AND e >= ws + {W}) THEN max(label) ELSE -1 END AS label
  FROM gw JOIN lb ON lb.device = gw.device AND s < ws + {W} AND e > ws GROUP BY ALL""")
def _(spark, sf):
    return matching.window_labels(label_rows(spark, sf), W)


@query("c12_target_labels", f"""WITH {A.EVENTS_SQL}, {LABELS},
  nest AS (SELECT label_id, s + 3 * 3600 AS s, s + {A.DAY} AS e FROM lb WHERE k % 2 = 0)
  SELECT device, ws AS window_start, CASE WHEN bool_or(has) THEN CASE WHEN bool_or(nf) THEN 1 WHEN bool_or(np) THEN -1 ELSE 0 END
    WHEN count(DISTINCT label) = 1 THEN max(label) ELSE -1 END AS label
  FROM (SELECT gw.device, ws, label, n.label_id IS NOT NULL AS has, coalesce(n.s <= ws AND n.e >= ws + {W}, false) AS nf,
          coalesce(n.s < ws + {W} AND n.e > ws, false) AS np
        FROM gw JOIN lb ON lb.device = gw.device AND lb.s <= ws AND lb.e >= ws + {W} LEFT JOIN nest n USING (label_id)) GROUP BY ALL""")
def _(spark, sf):
    rows = label_rows(spark, sf)
    nested = rows.filter(F.col("k") % 2 == 0).select("label_id", (F.col("start") + 3 * 3600).alias("start"), (F.col("start") + A.DAY).alias("end"))
    return matching.target_labels(rows, nested, W)


@query("c13_threshold_fallback", f"""WITH {A.EVENTS_SQL},
  g AS (SELECT device, event_type, count(*) AS n, avg(value) AS v FROM conn GROUP BY ALL),
  c AS (SELECT device, event_type, v AS threshold FROM g WHERE n >= 15),
  d AS (SELECT device, avg(value) AS threshold FROM conn WHERE device % 2 = 0 GROUP BY ALL),
  t AS (SELECT device % 11 AS kind, avg(value) AS threshold FROM conn WHERE device % 11 < 8 GROUP BY ALL)
  SELECT g.device, g.event_type, {r('coalesce(c.threshold, d.threshold, t.threshold, (SELECT avg(value) FROM conn))')} AS threshold,
    CASE WHEN c.threshold IS NOT NULL THEN 'context' WHEN d.threshold IS NOT NULL THEN 'device' WHEN t.threshold IS NOT NULL THEN 'type'
      ELSE 'global' END AS scope
  FROM g LEFT JOIN c USING (device, event_type) LEFT JOIN d ON d.device = g.device LEFT JOIN t ON t.kind = g.device % 11""")
def _(spark, sf):
    c = A.connections(spark, sf).withColumn("kind", F.col("device") % 11)
    g = c.groupBy("device", "event_type", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("threshold"))
    mean = F.avg("value").alias("threshold")
    levels = [("context", ["device", "event_type"], g.filter("n >= 15")),
              ("device", ["device"], c.filter(F.col("device") % 2 == 0).groupBy("device").agg(mean)),
              ("type", ["kind"], c.filter("kind < 8").groupBy("kind").agg(mean)), ("global", [], c.agg(mean))]
    return matching.with_fallback(g.select("device", "event_type", "kind"), levels, "threshold").drop("kind")


@query("c18_proposals", sql("SELECT * FROM prop"))
def _(spark, sf):
    return proposed(spark, sf)


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    d = A.devices(spark, sf)
    own = d.filter(F.col("id") % 4 == 0).select(
        (F.col("id") + 1).cast("int").alias("ordinal"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("override_id"),
        F.lit("suppress").alias("action"), F.col("device").alias("target_device_id"),
        F.lit(float(A.START + 20 * A.DAY)).alias("expires_at"))
    return own.unionByName(d.filter("id = 0").select(
        F.lit(0).alias("ordinal"), F.lit("all").alias("override_id"), F.lit("suppress").alias("action"),
        F.lit(None).cast("string").alias("target_device_id"), F.lit(float(A.START + 12 * A.DAY)).alias("expires_at")))


@query("c19_overrides", sql(f"""SELECT target_device_id, window_start, flow_uid, CASE WHEN window_start + {W} < {A.START + 12 * A.DAY} THEN 'all'
  WHEN window_start + {W} < {A.START + 20 * A.DAY} AND target_device_id[2:]::INT % 4 = 0 THEN 'o' || target_device_id[2:] END AS override_id
  FROM prop WHERE (SELECT count(*) FROM dev WHERE id = 0) > 0"""))
def _(spark, sf):
    rows = proposed(spark, sf)
    return decisions.apply_overrides(rows, overrides(spark, sf), F.col("window_start") + W).select(
        "target_device_id", "window_start", "flow_uid", "override_id")


SCOPE = "target_device_id, scope_proto, scope_ip, scope_port, tier"


@query("g5_consecutive_windows", sql(f"SELECT {SCOPE}, window_start, consecutive_windows FROM runs"))
def _(spark, sf):
    return decisions.consecutive_windows(proposed(spark, sf), W).drop("first_uid")


@query("g6_cooldown", sql(f"""SELECT p.target_device_id, p.scope_ip, p.scope_port, p.window_start, p.flow_uid, consecutive_windows,
  coalesce(p.rn = 1 AND since < {3 * W}, false) AS cooldown_active,
  CASE WHEN p.tier = 'alert' AND reason = 'forbidden_exchange' AND consecutive_windows >= 2 THEN 'block' ELSE p.tier END AS tier,
  CASE WHEN p.tier = 'alert' AND reason = 'forbidden_exchange' AND consecutive_windows >= 2 THEN 'repeated_forbidden_exchange' ELSE reason END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY {SCOPE}, window_start ORDER BY flow_uid) AS rn FROM prop) p
  JOIN runs r ON r.target_device_id = p.target_device_id AND r.window_start = p.window_start AND r.tier = p.tier
    AND r.scope_proto IS NOT DISTINCT FROM p.scope_proto AND r.scope_ip IS NOT DISTINCT FROM p.scope_ip
    AND r.scope_port IS NOT DISTINCT FROM p.scope_port"""))
def _(spark, sf):
    rows = proposed(spark, sf)
    return decisions.apply_cooldown(rows, W, 3 * W, escalate_after=2).select(
        "target_device_id", "scope_ip", "scope_port", "window_start", "flow_uid", "consecutive_windows", "cooldown_active", "tier", "reason")


@query("c20_evidence_checks", sql("""WITH inv AS (SELECT DISTINCT window_start, device FROM score WHERE device[2:]::INT % 9 <> 0),
  evd AS (SELECT *, 1 AS c FROM score WHERE device[2:]::INT % 8 <> 0 UNION ALL SELECT *, 1 FROM score WHERE device[2:]::INT % 10 = 1)
  SELECT window_start, device, 'missing_device' AS rule FROM inv WHERE NOT EXISTS (SELECT 1 FROM evd e WHERE e.device = inv.device
    AND e.window_start = inv.window_start)
  UNION ALL SELECT DISTINCT window_start, device, 'unknown_device' FROM evd WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.device = evd.device
    AND i.window_start = evd.window_start)
  UNION ALL SELECT window_start, device, 'repeated_device' FROM evd GROUP BY ALL HAVING count(*) > 1""".replace(
    "WITH inv AS", ", inv AS", 1)))
def _(spark, sf):
    s = scores(spark, sf)
    n = F.substr("device", F.lit(2)).cast("int")
    given = s.filter(n % 8 != 0).unionByName(s.filter(n % 10 == 1))
    return evidence.evidence_violations(s.filter(n % 9 != 0), given)


@query("b10_digests", f"""WITH {A.EVENTS_SQL}, {OBSERVED}
  SELECT sensor_id, window_start, sha256('{{"inventory_version":"v1","run_id":"' || run_id || '","sensor_id":"' || sensor_id
    || '","window_start":' || window_start || '}}') AS id FROM obs""")
def _(spark, sf):
    w = observations(spark, sf)[0]
    return w.select("sensor_id", "window_start", digest("run_id", "sensor_id", "inventory_version", "window_start").alias("id"))


DOCUMENT = ('{{"ietf-access-control-list:access-lists":{{"acl":[{{"name":"from","aces":{{"ace":['
            '{{"matches":{{"ipv4":{{"protocol":17,"ietf-acldns:dst-dnsname":"Host{0}.Example.com"}},"udp":{{"destination-port":{{"operator":"eq","port":{1}}}}}}}}},'
            '{{"matches":{{"ipv4":{{"protocol":6,"destination-ipv4-network":"10.{2}.0.0/16"}},"l4":{{"source-port":{{"port":"{1}"}}}}}}}},'
            '{{"matches":{{"eth":"x","ietf-mud:mud":{{"local-networks":[null],"controller":"urn:x"}}}}}}]}}}}]}}}}')


@query("j1_document_facts", """WITH c AS (SELECT c_custkey AS id FROM customer)
  SELECT id AS document_id, 'domain' AS kind, 'host' || id || '.example.com' AS fact, 1::BIGINT AS n FROM c
  UNION ALL SELECT id, 'network', '10.' || (id % 200) || '.0.0/16', 1 FROM c
  UNION ALL SELECT id, 'port', 'udp/' || (1000 + id % 100), 1 FROM c UNION ALL SELECT id, 'port', 'tcp/' || (1000 + id % 100), 1 FROM c
  UNION ALL SELECT id, 'permission', 'local-networks', 1 FROM c UNION ALL SELECT id, 'permission', 'controller', 1 FROM c""")
def _(spark, sf):
    key = F.col("c_custkey")
    text = F.format_string(DOCUMENT.format("%1$s", "%2$s", "%3$s"), key.cast("string"), (1000 + key % 100).cast("string"),
                           (key % 200).cast("string"))
    return policy.document_facts(A.table(spark, sf, "customer").select(key.alias("document_id"), text.alias("text")))
