"""Lookups by order, prefix and running minimum: right answers, and output that stays near the input."""

import random

import pytest
from pyspark.sql import functions as F

from fluxprint.functions import ordered
from fluxprint.operators import decisions, identity, policy


def joined_rows(df):
    """Rows that the joins of a plan put out, by running it: the largest ``number of output rows`` of a join."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name:
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found, default=0)


def test_one_address_with_ten_thousand_leases(spark):
    leases = spark.range(10_000).selectExpr("concat('d', id % 50) as device", "concat('10.0.0.', if(id < 0, 2, 1)) as ip", "id * 60 as lease_start", "id * 60 + 50 as lease_end")
    flows = spark.range(20_000).selectExpr("concat('10.0.0.', if(id < 0, 2, 1)) as orig_h", "concat('9.9.9.', id % 7) as resp_h", "concat('m', id) as orig_mac", "concat('n', id) as resp_mac", "id * 30 as window_start")
    devices = spark.range(50).selectExpr("concat('d', id) as device", "cast(null as string) as mac")
    got = identity.resolve_flow(flows, leases, devices)
    assert joined_rows(got) <= 3 * 40_000
    wrong = got.filter(~F.col("orig_device").eqNullSafe(F.when(F.col("window_start") % 60 < 50, F.concat(F.lit("d"), (F.floor(F.col("window_start") / 60) % 50).cast("string")))))
    assert got.count() == 20_000 and wrong.count() == 0


def test_owners_against_every_lease(spark):
    rng = random.Random(5)
    leases = [(f"d{rng.randrange(3)}", f"ip{rng.randrange(2)}", s, rng.choice([None, s + rng.randrange(1, 30)])) for s in (rng.randrange(100) for _ in range(14))]
    segments = identity.ownership_segments(spark.createDataFrame(leases, "device string, ip string, lease_start long, lease_end long"))
    asked = spark.createDataFrame([(f"ip{i}", t) for i in range(2) for t in range(-5, 140)], "ip string, t long")
    got = {(r.ip, r.t): (r.owner, r.owners) for r in identity.at_instant(asked, segments, ["ip"], "t", "segment_start", "segment_end", ["owner", "owners"], 25.0).collect()}
    want = {}
    for i in range(2):
        for t in range(-5, 140):
            live = {d for d, ip, s, e in leases if ip == f"ip{i}" and s <= t and (e is None or t < e)}
            if live:
                want[f"ip{i}", t] = (live.pop(), 1) if len(live) == 1 else ("contested", len(live))
    assert got == want


def test_contested_address_is_an_error_where_it_is_seen(spark):
    leases = spark.createDataFrame([("a", "x", 0, 10), ("b", "x", 5, 20)], "device string, ip string, lease_start long, lease_end long")
    devices = spark.createDataFrame([("a", None), ("b", None)], "device string, mac string")

    def flows(t):
        return spark.createDataFrame([("x", "y", None, None, t)], "orig_h string, resp_h string, orig_mac string, resp_mac string, window_start long")

    assert identity.resolve_flow(flows(12), leases, devices).first()["orig_device"] == "b"
    with pytest.raises(Exception, match="ambiguous owner of x"):
        identity.resolve_flow(flows(7), leases, devices).collect()


def test_bindings_and_their_gaps(spark):
    bindings = spark.createDataFrame([("k", 0.0, 10.0, "p"), ("k", 20.0, None, "q"), ("z", 0.0, 1.0, "r")], "key string, valid_from double, valid_until double, port string")
    rows = spark.createDataFrame([("k", t, n) for t in (-1.0, 0.0, 10.0, 20.0, 1e6) for n in (1, 2)] + [(None, 5.0, 3)], "key string, t double, n int")
    got = sorted(((r.t, r.n, r.bound_port) for r in identity.as_of_binding(rows, bindings, ["key"], "t", ["port"]).collect()), key=str)
    want = sorted([(t, n, p) for t, p in ((-1.0, None), (0.0, "p"), (10.0, None), (20.0, "q"), (1e6, "q")) for n in (1, 2)] + [(5.0, 3, None)], key=str)
    assert got == want


def test_leases_meet_only_the_windows_they_touch(spark):
    grid = spark.range(200).selectExpr("'d' as device", "id * 60 as window_start")
    leases = spark.createDataFrame([("d", "a", -1000, 90), ("d", "b", 120, 180), ("d", "c", 11_000, None), ("e", "x", 0, None)], "device string, ip string, lease_start long, lease_end long")
    clipped = identity.clipped_inventory(grid, leases, 60)
    got = {(r.window_start, r.ip): (r.clip_start, r.clip_end, r._moved) for r in clipped.filter("ip is not null").collect()}
    assert {k: v for k, v in got.items() if k[1] != "c"} == {(0, "a"): (0, 60, False), (60, "a"): (60, 90, True), (120, "b"): (120, 180, False)}
    assert min(w for w, ip in got if ip == "c") == 10_980 and got[10_980, "c"] == (11_000, 11_040, True) and got[11_940, "c"] == (11_940, 12_000, False)
    assert clipped.filter("ip is null").count() == 200 - len(got)


def test_a_thousand_rules_of_one_initiator(spark):
    rules = [(i, "d", "tcp", 443, f"10.{i % 250}.{i // 250}.0/24", None, f"net{i}") for i in range(1, 996)]
    rules += [(0, "d", "tcp", 443, "10.7.0.0/16", None, "wide"), (996, "d", "tcp", 443, "0.0.0.0/0", None, "all"), (997, "d", "tcp", 443, "fd00::/8", None, "v6"),
              (2000, "d", "tcp", 443, None, "Api.Example.", "name"), (1500, "d", "tcp", 443, None, "other.example", "other")]
    schema = "ordinal int, initiator string, proto string, service_port int, network string, fqdn string, reason string"
    flows = spark.range(4000).selectExpr("concat('u', id) as uid", "0L as window_start", "'d' as initiator", "'tcp' as proto", "443 as resp_p",
                                         "case when id = 1 then 'fd00::1' when id = 2 then 'fe80::1' else concat('10.', id % 250, '.', id % 9, '.1') end as resp_h", "'s' as sensor_id", "cast(id as double) as flow_start")
    names = spark.createDataFrame([("s", "api.example", "fe80::1", 0.0, 100.0), ("s", "api.example", "10.1.1.1", 0.0, 1e9), ("s", "other.example", "fe80::1", 50.0, 100.0)],
                                  "sensor_id string, name string, address string, valid_from double, valid_until double")
    out = policy.external_matches(flows, spark.createDataFrame(rules, schema), names, 3600.0)
    assert joined_rows(out) <= 3 * 4000
    got = {r.uid: (r.ordinal, r.external_reason) for r in out.collect()}
    assert len(got) == 4000 and got["u1"] == (997, "v6") and got["u2"] == (2000, "name")
    for i in range(3, 4000):
        n = i % 250 + 250 * (i % 9)
        want = (0, "wide") if i % 250 == 7 and i % 9 == 0 else min([(n, f"net{n}")] if 0 < n < 996 else [], default=(996, "all"))
        if i % 250 == 7:
            want = (0, "wide")
        assert got[f"u{i}"] == want, i


def test_a_hundred_thousand_global_overrides(spark):
    many = spark.range(100_000).selectExpr("cast(id as int) as ordinal", "concat('g', id) as override_id", "'suppress' as action", "cast(null as string) as target_device_id",
                                           "cast((id * 7919) % 100000 as double) as expires_at")
    own = spark.createDataFrame([(-5, "own-late", "suppress", "d1", 200_000.0), (-9, "own-soon", "suppress", "d1", 50.0), (-99, "allow", "allow", "d1", 1e9)], many.schema)
    rows = spark.createDataFrame([(d, float(t)) for d in ("d1", "d2", None) for t in (0, 49, 50, 50_000, 99_998, 99_999, 150_000, 200_000)], "target_device_id string, at double")
    got = {(r.target_device_id, r["at"]): r.override_id for r in decisions.apply_overrides(rows, many.unionByName(own), F.col("at"), 1000.0).collect()}
    plain = [((i * 7919) % 100_000, i) for i in range(100_000)]
    for (d, t), found in got.items():
        live = [(i, f"g{i}") for e, i in plain if e > t] + ([(o, n) for o, n, e in ((-5, "own-late", 200_000), (-9, "own-soon", 50)) if e > t] if d == "d1" else [])
        assert found == (min(live)[1] if live else None), (d, t)
    assert len(got) == 24


def test_dyadic_nodes_cover_a_range_once(spark):
    rng = random.Random(8)
    ranges = [(a, a + n) for a, n in ((rng.randrange(-70, 70), rng.randrange(0, 62)) for _ in range(300))]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", ordered.cover(F.col("a"), F.col("b"), 6).alias("c"))
    for r in df.collect():
        assert sorted(x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level)) == list(range(r.a, r.b)) and len(r.c) <= 10
    one = spark.range(1).select(ordered.nodes_over(F.lit(-13), 3).alias("n")).first()["n"]
    assert [(n.level, n.node) for n in one] == [(0, -13), (1, -7), (2, -4)]
