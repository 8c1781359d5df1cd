"""Permissions: documents to facts, flows to outcomes, profiles to recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions.scalars import (ipv4_number, ipv6_digits, is_private_ipv4, is_private_ipv6, network_parts, network_parts_6,
                                         truncate_ipv4, truncate_ipv6)
from fluxprint.operators import identity, matching


# C6
def bind_ends(flows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Initiator and responder device of each new flow, as bound at its window; both ends are looked up together."""
    new = flows.filter("new_flow")
    ts = "window_start"
    bound = identity.at_instant(identity.both_ends(new, ts), bindings.select("ip", "valid_from", "valid_until", "device"), ["ip"], ts, "valid_from", "valid_until", ["device"])
    for side, out in (("orig_h", "initiator"), ("resp_h", "responder")):
        new = new.join(bound.select(F.col("ip").alias(side), ts, F.col("device").alias(out)), [side, ts], "left")
    return new.select(*flows.columns, "initiator", "responder")


RULE_KEY = ["initiator", "proto", "resp_p"]


def first_network_rule(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule, in policy order, whose network holds the address, per distinct ``(RULE_KEY, resp_h)``.

    Rules of one prefix are folded to their first; an address then meets at most one row for each
    prefix length that the rules of its key use, not each rule.
    """
    network, address = F.col("network"), F.col("resp_h")
    points = asked.select(*RULE_KEY, "resp_h").distinct()

    def family(parts: tuple[Column, Column], value: Column, truncate: Callable[[Column, Column], Column]) -> DataFrame:
        nets = rules.select(*RULE_KEY, parts[0].alias("_base"), parts[1].alias("_bits"), "rule").filter("_base is not null").groupBy(*RULE_KEY, "_base", "_bits").agg(F.min("rule").alias("rule"))
        lengths = nets.select(*RULE_KEY, "_bits").distinct()        # 129 per key at most
        keys = points.withColumn("_n", value).filter("_n is not null").join(lengths, RULE_KEY).withColumn("_base", truncate(F.col("_n"), F.col("_bits")))
        return keys.join(nets, [*RULE_KEY, "_base", "_bits"]).select(*RULE_KEY, "resp_h", "rule")

    both = family(network_parts(network), ipv4_number(address), truncate_ipv4).unionByName(
        family(network_parts_6(network), ipv6_digits(address), truncate_ipv6))
    return both.groupBy(*RULE_KEY, "resp_h").agg(F.min("rule").alias("by_network"))


# C7
def external_matches(flows: DataFrame, rules: DataFrame, names: DataFrame, slice_seconds: float) -> DataFrame:
    """First external rule in policy order for flows that leave the inventory.

    A network rule holds for an address, so it is looked up per distinct address. A name rule
    needs evidence of the same sensor for that name and address at the flow's start: a flow meets
    the names that its address has had and that a rule of its key names.
    """
    plain = lambda c: F.lower(F.rtrim(F.col(c), F.lit(".")))
    r = rules.select("initiator", "proto", F.col("service_port").alias("resp_p"), "network", plain("fqdn").alias("fqdn"), F.struct("ordinal", "reason").alias("rule"))
    by_network = first_network_rule(flows, r.filter("network is not null"))
    evidence = names.select("sensor_id", plain("name").alias("fqdn"), F.col("address").alias("resp_h"), "valid_from", "valid_until")
    named = r.filter("fqdn is not null").groupBy(*RULE_KEY, "fqdn").agg(F.min("rule").alias("rule"))
    had = evidence.select("sensor_id", "resp_h", "fqdn").distinct()
    wanted = flows.select(*RULE_KEY, "sensor_id", "resp_h").distinct().join(had, ["sensor_id", "resp_h"]).join(named, [*RULE_KEY, "fqdn"])
    cand = flows.select("uid", "window_start", "flow_start", *RULE_KEY, "sensor_id", "resp_h").join(wanted, [*RULE_KEY, "sensor_id", "resp_h"])
    held = matching.latest_until(cand, evidence, ["sensor_id", "fqdn", "resp_h"], "flow_start", "valid_from", "valid_until", slice_seconds)
    by_name = held.filter(F.col("flow_start") < F.col("_until")).groupBy("uid", "window_start").agg(F.min("rule").alias("by_name"))
    rows = flows.select("uid", "window_start", *RULE_KEY, "resp_h").join(by_network, [*RULE_KEY, "resp_h"], "left").join(by_name, ["uid", "window_start"], "left")
    first = F.least("by_network", "by_name")
    return rows.select("uid", "window_start", first["ordinal"].alias("ordinal"), first["reason"].alias("external_reason")).filter("ordinal is not null").groupBy(
        "uid", "window_start").agg(F.min("ordinal").alias("ordinal"), F.min_by("external_reason", "ordinal").alias("external_reason"))


# C6
def evaluate(flows: DataFrame, bindings: DataFrame, permissions: DataFrame, rules: DataFrame, names: DataFrame,
             slice_seconds: float = 3600) -> DataFrame:
    """Outcome of every new flow: allowed, denied, unknown policy or unknown device."""
    return evaluate_bound(bind_ends(flows, bindings), permissions, rules, names, slice_seconds)


def evaluate_bound(bound: DataFrame, permissions: DataFrame, rules: DataFrame, names: DataFrame, slice_seconds: float = 3600) -> DataFrame:
    """:func:`evaluate` for flows whose ends are bound already; they are read several times, so they should be stored."""
    leaving = bound.filter(F.col("initiator").isNotNull() & F.col("responder").isNull())
    external = external_matches(leaving, rules, names, slice_seconds)
    inside = permissions.select("initiator", "responder", "proto", F.col("service_port").alias("resp_p"),
                                F.col("reason").alias("rule_reason"), F.lit(True).alias("_rule"))
    rows = bound.join(inside, ["initiator", "responder", "proto", "resp_p"], "left").join(
        external, ["uid", "window_start"], "left")
    unknown, outside = F.col("initiator").isNull(), F.col("responder").isNull()
    outcome = (F.when(unknown, "unknown_device")
               .when(outside, F.when(F.col("ordinal").isNotNull(), "allowed").otherwise("unknown_policy"))
               .when(F.col("_rule"), "allowed").otherwise("denied"))
    reason = (F.when(unknown, "initiator_not_in_inventory")
              .when(outside, F.coalesce("external_reason", F.lit("no_verified_external_name_or_network_permission")))
              .when(F.col("_rule"), F.col("rule_reason")).otherwise("no_matching_permission"))
    return rows.select(
        F.col("uid").alias("flow_uid"), "window_start", F.col("flow_start").alias("observed_at"),
        F.col("orig_h").alias("initiator_ip"), F.col("resp_h").alias("responder_ip"), "proto",
        F.col("resp_p").alias("service_port"), F.col("initiator").alias("initiator_device_id"),
        F.col("responder").alias("responder_device_id"), outcome.alias("permission"), reason.alias("reason"))


# I4
def permission_oracle(flows: DataFrame, owners: DataFrame, permissions: DataFrame) -> DataFrame:
    """Plain policy lookup without leases or evidence, to check the outcomes against."""
    o = owners.select(F.col("ip").alias("orig_h"), F.col("device").alias("initiator"))
    t = owners.select(F.col("ip").alias("resp_h"), F.col("device").alias("responder"))
    rule = permissions.select("initiator", "responder", "proto", F.col("service_port").alias("resp_p"),
                              F.lit(True).alias("_rule"))
    rows = (flows.join(o, "orig_h", "left").join(t, "resp_h", "left")
            .join(rule, ["initiator", "responder", "proto", "resp_p"], "left"))
    expected = (F.when(F.col("initiator").isNull(), "outside_household_origin")
                .when(F.col("responder").isNull(), "unsupported_external_policy")
                .when(F.col("_rule"), "allowed").otherwise("denied"))
    return rows.withColumn("expected", expected).drop("_rule")


# A7, J1
# Where a permission document keeps its rules, the keys that carry
# facts, and the protocol numbers that have a name.
ACL_PATH = "$['ietf-access-control-list:access-lists'].acl"
NETWORK_KEYS = ["destination-ipv4-network", "source-ipv4-network", "destination-ipv6-network", "source-ipv6-network"]
PERMISSION_KEYS = ["local-networks", "controller"]
PORT_KEYS = ["destination-port", "source-port"]
PROTOCOL_NAMES = {1: "icmp", 6: "tcp", 17: "udp"}


def document_matches(documents: DataFrame) -> DataFrame:
    """One row per match field of ``(document_id, text)``; keys are data, so variants.

    An entry's own IP protocol is read from its IPv6 layer first, then IPv4.
    """
    spark = documents.sparkSession
    parsed = documents.select("document_id", F.parse_json("text").alias("doc"))
    entries = spark.sql(f"""
        SELECT d.document_id, acl.pos AS acl_pos, ace.pos AS ace_pos, variant_get(ace.value, '$.matches', 'variant') AS matches
        FROM {{parsed}} AS d,
             LATERAL variant_explode(variant_get(d.doc, "{ACL_PATH}", 'variant')) AS acl,
             LATERAL variant_explode(variant_get(acl.value, '$.aces.ace', 'variant')) AS ace
    """, parsed=parsed)
    numbered = entries.withColumn("ip_protocol", F.coalesce(
        *[F.try_variant_get("matches", f"$.{layer}.protocol", "int") for layer in ("ipv6", "ipv4")]))
    return spark.sql("""
        SELECT e.document_id, acl_pos, ace_pos, ip_protocol, layer.key AS layer, field.key AS field,
               field.value AS value
        FROM {numbered} AS e,
             LATERAL variant_explode(e.matches) AS layer,
             LATERAL variant_explode(CASE WHEN schema_of_variant(layer.value) LIKE 'OBJECT%' THEN layer.value END) AS field
    """, numbered=numbered)


def document_facts(documents: DataFrame) -> DataFrame:
    """Facts ``(document_id, kind, fact, n)``: domains, ports, networks, permission counts."""
    m = document_matches(documents)
    text = F.try_variant_get("value", "$", "string")
    port = F.try_variant_get("value", "$.port", "string")
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    proto = F.when(F.col("layer").isin("tcp", "udp"), F.col("layer")).otherwise(
        F.coalesce(F.try_element_at(names, F.col("ip_protocol")), F.col("layer")))
    field = F.col("field")
    kind = (F.when(field.contains("dnsname"), "domain").when(field.isin(NETWORK_KEYS), "network")
            .when(field.isin(PERMISSION_KEYS), "permission").when(field.isin(PORT_KEYS) & port.isNotNull(), "port"))
    fact = (F.when(kind == "domain", F.lower(text)).when(kind == "network", text).when(kind == "permission", field)
            .when(kind == "port", F.concat_ws("/", proto, port)))
    rows = m.select("document_id", kind.alias("kind"), fact.alias("fact")).filter("kind is not null")
    # documents unfold to many facts, so these are dealt out before any task folds all of its split
    keys = ["document_id", "kind", "fact"]
    counted = rows.repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # only permissions are counted; the other kinds are sets
    return counted.withColumn("n", F.when(F.col("kind") == "permission", F.col("n")).otherwise(1))


# I5
def match_facts(facts: DataFrame, names: DataFrame, ports: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each checkable fact of a device with ``matched``.

    ``facts`` is ``(device, kind, fact)``; the observed tables are keyed by device.
    """
    kinds = {k: facts.filter(F.col("kind") == k).select("device", F.col("fact").alias(c)).distinct()
             for k, c in (("domain", "domain"), ("port", "port"), ("network", "network"))}
    hit_d = matching.related_names(kinds["domain"], names, ["device"]).select(
        "device", F.lit("domain").alias("kind"), F.col("domain").alias("fact"))
    hit_p = kinds["port"].join(ports.select("device", "port").distinct(), ["device", "port"], "left_semi").select(
        "device", F.lit("port").alias("kind"), F.col("port").alias("fact"))
    hit_n = matching.in_networks(addresses, kinds["network"], ["device"]).select(
        "device", F.lit("network").alias("kind"), F.col("network").alias("fact"))
    hits = hit_d.unionByName(hit_p).unionByName(hit_n).distinct().withColumn("matched", F.lit(True))
    checkable = facts.filter(F.col("kind").isin("domain", "port", "network")).select("device", "kind", "fact").distinct()
    return checkable.join(hits, ["device", "kind", "fact"], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def recall_by_device(matched: DataFrame) -> DataFrame:
    def count(kind: str | None, only_matched: bool) -> Column:
        c = F.lit(True) if kind is None else F.col("kind") == kind
        return F.count_if(c & F.col("matched") if only_matched else c)

    per_kind = [x for k in ("domain", "port", "network") for x in (
        count(k, False).alias(f"{k}_total"), count(k, True).alias(f"{k}_matched"))]
    return matched.groupBy("device").agg(
        count(None, False).alias("checkable"), count(None, True).alias("matched"), *per_kind,
        (count(None, True) / count(None, False)).alias("fidelity"))


def recall_overall(by_device: DataFrame) -> DataFrame:
    return by_device.agg(
        F.count("fidelity").alias("devices"), F.sum("matched").alias("matched"), F.sum("checkable").alias("checkable"),
        (F.sum("matched") / F.sum("checkable")).alias("fidelity_micro"), F.avg("fidelity").alias("fidelity_macro"))


def beyond_policy(facts: DataFrame, names: DataFrame, ports: DataFrame) -> DataFrame:
    """Observed names and ports that no fact of the device explains."""
    d = facts.filter(F.col("kind") == "domain").select("device", F.col("fact").alias("domain"))
    p = facts.filter(F.col("kind") == "port").select("device", F.col("fact").alias("port"))
    explained = matching.related_names(d, names, ["device"]).select("device", "name")
    extra_n = names.select("device", "name").distinct().join(explained, ["device", "name"], "left_anti")
    extra_p = ports.select("device", "port").distinct().join(p, ["device", "port"], "left_anti")
    return extra_n.select("device", F.lit("domain").alias("kind"), F.col("name").alias("value")).unionByName(
        extra_p.select("device", F.lit("port").alias("kind"), F.col("port").alias("value")))


def talks_on_lan(addresses: DataFrame) -> DataFrame:
    """Whether a device was seen with a private address of either family."""
    distinct = addresses.select("device", "address").distinct()
    v6 = distinct.filter(F.col("address").contains(":")).withColumn("lan", is_private_ipv6(F.col("address")))
    v4 = distinct.filter(~F.col("address").contains(":")).withColumn("lan", is_private_ipv4(F.col("address")))
    return v4.unionByName(v6).groupBy("device").agg(F.bool_or("lan").alias("device_talks_on_lan"))
