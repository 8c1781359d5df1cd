import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxprint.operators import decisions, identity, matching, policy, validation

LEASE = "device string, ip string, lease_start long, lease_end long"


def test_leases_win_over_macs_and_end_exclusively(spark):
    leases = spark.createDataFrame([("a", "1.1.1.1", 0, 100), ("b", "1.1.1.1", 100, None)], LEASE)
    devices = spark.createDataFrame([("a", "AA"), ("b", "bb"), ("c", "CC")], "device string, mac string")
    rows = spark.createDataFrame([(99, "1.1.1.1", "cc"), (100, "1.1.1.1", None), (5, "9.9.9.9", "cc"), (5, "9.9.9.9", "aa"), (5, "9.9.9.9", None)],
                                 "window_start long, orig_h string, orig_mac string").withColumns({"resp_h": F.lit("8.8.8.8"), "resp_mac": F.lit(None).cast("string")})
    got = sorted((r["window_start"], r["orig_h"], r["orig_mac"] or "", r["orig_device"]) for r in identity.resolve_flow(rows, leases, devices).collect())
    assert [g[3] for g in got] == [None, None, "c", "a", "b"]


def test_two_owners_at_once_are_an_error_only_then(spark):
    leases = spark.createDataFrame([("a", "1.1.1.1", 0, 100), ("b", "1.1.1.1", 50, 200), ("a", "1.1.1.1", 90, 95)], LEASE)
    seg = identity.ownership_segments(leases)
    fine = spark.createDataFrame([(10, "1.1.1.1"), (150, "1.1.1.1")], "t long, ip_ string")
    assert {r["t"]: r["d"] for r in identity.resolve(fine, seg, None, "ip_", None, "t", "d").collect()} == {10: "a", 150: "b"}
    with pytest.raises(PySparkException):
        identity.resolve(spark.createDataFrame([(60, "1.1.1.1")], "t long, ip_ string"), seg, None, "ip_", None, "t", "d").collect()
    assert validation.ambiguous_ownership(leases).select("from", "until").first() == (50.0, 100.0)


def test_latest_until_matches_brute_force(spark):
    rng = random.Random(2)
    spans = [("hot" if rng.random() < .6 else f"k{rng.randrange(9)}", rng.randrange(1000), 0) for _ in range(600)]
    spans = [(k, float(a), float(a + rng.choice([5, 60, 400]))) for k, a, _ in spans]
    points = [(i, "hot" if rng.random() < .5 else f"k{rng.randrange(9)}", float(rng.randrange(1200))) for i in range(800)]
    got = matching.latest_until(spark.createDataFrame(points, "id long, k string, t double"), spark.createDataFrame(spans, "k string, s double, e double"),
                                ["k"], "t", "s", "e", 50.0).collect()
    assert len(got) == len(points)
    for r in got:
        want = any(k == r["k"] and s <= r["t"] < e for k, s, e in spans)
        assert (r["_until"] is not None and r["t"] < r["_until"]) == want


def test_band_match_matches_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.uniform(-50, 500)) for i in range(300)]
    right = [(rng.choice("ab"), rng.uniform(-50, 500)) for _ in range(40)]
    got = matching.band_match(spark.createDataFrame(left, "id long, k string, t double"), spark.createDataFrame(right, "k string, u double"), ["k"], "t", "u", 3.0, "id")
    for r in got.collect():
        assert r["found"] == any(k == r["k"] and abs(u - r["t"]) <= 3.0 for k, u in right)


def test_networks_and_names(spark):
    nets = spark.createDataFrame([("10.0.0.0/8",), ("0.0.0.0/0",), ("10.1.2.3/32",), ("bad",), ("fd00::1/8",)], "network string").withColumn("d", F.lit(1))
    ips = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("junk",), ("FD00:0::5",), ("fe80::1",)], "address string").withColumn("d", F.lit(1))
    got = {(r["address"], r["network"]) for r in matching.in_networks(ips, nets, ["d"]).collect()}
    assert got == {("10.1.2.3", "10.0.0.0/8"), ("10.1.2.3", "0.0.0.0/0"), ("10.1.2.3", "10.1.2.3/32"), ("8.8.8.8", "0.0.0.0/0"),
                   ("FD00:0::5", "fd00::1/8")}
    facts = spark.createDataFrame([("d", "example.com"), ("d", "deep.api.example.org")], "device string, domain string")
    seen = spark.createDataFrame([("d", "a.example.com"), ("d", "example.org"), ("d", "badexample.com"), ("e", "example.com")], "device string, name string")
    assert {(r["domain"], r["name"]) for r in matching.related_names(facts, seen, ["device"]).collect()} == {
        ("example.com", "a.example.com"), ("deep.api.example.org", "example.org")}


def test_external_rules_first_in_order_and_exclusive_end(spark):
    flows = spark.createDataFrame([("u1", 60, 61.0, "a", "203.0.113.5", "tcp", 443), ("u2", 60, 59.0, "a", "203.0.113.5", "tcp", 443),
                                   ("u3", 60, 61.0, "a", "fd00::5", "tcp", 443), ("u4", 60, 99.0, "a", "203.0.113.6", "tcp", 443)],
                                  "uid string, window_start long, flow_start double, initiator string, resp_h string, proto string, resp_p int").withColumn("sensor_id", F.lit("s"))
    rules = spark.createDataFrame([(0, "a", "tcp", 443, "fd00::/8", None, "v6"), (1, "a", "tcp", 443, None, "X.Example.net.", "name"),
                                   (2, "a", "tcp", 443, "203.0.113.6/32", None, "net")],
                                  "ordinal int, initiator string, proto string, service_port int, network string, fqdn string, reason string")
    names = spark.createDataFrame([("s", "x.example.NET", "203.0.113.5", 60.0, 62.0), ("s", "x.example.net", "203.0.113.6", 60.0, 99.0)],
                                  "sensor_id string, name string, address string, valid_from double, valid_until double")
    got = {r["uid"]: r["external_reason"] for r in policy.external_matches(flows, rules, names, 10.0).collect()}
    assert got == {"u1": "name", "u3": "v6", "u4": "net"}


def test_cooldown_escalation_and_replay(spark):
    p = "window_start long, target_device_id string, scope_proto string, scope_ip string, scope_port int, tier string, reason string, flow_uid string"
    rows = [(w, "d", "tcp", "1.1.1.1", 80, "alert", "forbidden_exchange", f"u{w}{i}") for w in (0, 60, 120, 300) for i in (0, 1)]
    got = decisions.apply_cooldown(spark.createDataFrame(rows, p), 60, 120, escalate_after=3).orderBy("window_start", "flow_uid").collect()
    assert [r["consecutive_windows"] for r in got] == [1, 1, 2, 2, 3, 3, 1, 1]
    assert [r["cooldown_active"] for r in got] == [False, False, True, False, True, False, False, False]
    assert [r["tier"] for r in got] == ["alert"] * 4 + ["block"] * 2 + ["alert"] * 2
    assert len({r["scope_key"] for r in got}) == 1


def test_override_first_unexpired(spark):
    rows = spark.createDataFrame([("d", 10), ("e", 10), ("d", 50)], "target_device_id string, window_start long")
    over = spark.createDataFrame([(0, "all", "suppress", None, 20.0), (1, "own", "suppress", "d", 40.0)],
                                 "ordinal int, override_id string, action string, target_device_id string, expires_at double")
    got = sorted((r["target_device_id"], r["window_start"], r["override_id"]) for r in decisions.apply_overrides(rows, over, F.col("window_start")).collect())
    assert got == [("d", 10, "all"), ("d", 50, None), ("e", 10, "all")]
