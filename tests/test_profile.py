import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.operators import deviation, profile, windows


def test_window_literal(spark):
    flows = spark.createDataFrame(
        [("d", 100.0, "203.0.113.9", 443, "tcp", "ssl", "SF", 50, 100, 1, 2)],
        "device string, ts double, resp_h string, resp_p int, proto string, service string, conn_state string, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long")
    dns = spark.createDataFrame([("d", 100.0, "a.example.com"), ("d", 300.0, "a.example.com")], "device string, ts double, query string")
    rows = {r["window_start"]: r for r in windows.behaviour_windows(flows, dns, 60).collect()}
    assert rows[60]["bytes_total"] == 150 and rows[60]["packets_total"] == 3
    assert rows[60]["interflow_gap_variance"] is None and rows[60]["tcp_failed_ratio"] == 0.0 and rows[60]["domain_entropy"] == 0.0
    assert rows[300]["flow_count"] == 0 and rows[300]["unique_domains"] == 1 and rows[300]["tcp_failed_ratio"] is None
    ends = {(r["kind"], r["value"]) for r in windows.window_endpoints(flows, dns, 60).filter("window_start = 60").collect()}
    assert ends == {("destination", "203.0.113.9"), ("port", "tcp/443"), ("domain", "a.example.com")}
    assert windows.service_map(windows.service_shares(flows, 60)).first()["service_distribution"] == {"ssl": 1.0}


def test_gaps_keep_zeros_and_split_hot_keys(spark):
    rng = random.Random(1)
    # one key holds half of the rows, many of them at equal instants
    rows = [("hot", float(rng.randrange(400))) for _ in range(2000)] + [(f"k{i % 50}", rng.uniform(0, 400)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t double")
    got = {r["k"]: r for r in ordered.gap_moments(df, ["k"], "t", 7.0).collect()}
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        assert got[k]["gaps"] == len(gaps)
        assert got[k]["gap_variance"] == pytest.approx(statistics.pvariance(gaps), rel=1e-9)
    three = spark.createDataFrame([("a", 5.0)] * 3 + [("b", 1.0), ("b", 2.0)], "k string, t double")
    assert {r["k"]: r["gap_variance"] for r in ordered.gap_moments(three, ["k"], "t", 10.0).collect()} == {"a": 0.0, "b": None}


def test_order_statistics_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.exp(rng.normal(0, 4, 6000)), "neg": rng.normal(0, 1, 501), "const": np.full(9, 2.5), "one": np.array([7.0]),
              None: np.round(rng.normal(0, 2, 300))}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in stats.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        assert [got[k][c] for c in "abc"] == pytest.approx(list(np.quantile(vs, [0.25, 0.5, 0.99])), rel=1e-12)


def statement(values, log):
    """Trimmed statistics, said independently in plain Python."""
    xs = sorted(v for v in values if v is not None)
    log = log and xs[0] >= 0
    sp = [math.log1p(x) for x in xs] if log else xs
    q = np.quantile(sp, [0.25, 0.5, 0.75])
    sigma = (q[2] - q[0]) / 1.349
    kept = [x for x, s in zip(xs, sp) if sigma <= 0 or q[1] - 3 * sigma <= s <= q[1] + 3 * sigma]
    kq = np.quantile(kept, [0.25, 0.5, 0.75])
    return dict(median=kq[1], q1=kq[0], q3=kq[2], mean=statistics.fmean(kept), min=kept[0], max=kept[-1],
                p95=kept[round(0.95 * (len(kept) - 1))], p99=kept[round(0.99 * (len(kept) - 1))], windows_excluded=len(xs) - len(kept))


def test_robust_stats_match_a_plain_statement(spark):
    rng = random.Random(5)
    groups = {"heavy": [rng.lognormvariate(3, 2) for _ in range(200)] + [1e12], "one": [4.0], "two": [1.0, 9.0], "flat": [3.0] * 7,
              "nulls": [None, 1.0, 2.0, None, 50.0], "negative": [-1.0, 2.0, 3.0, 400.0, 5.0, 2.5, 2.7, 3.1]}
    df = spark.createDataFrame([(k, v, v) for k, vs in groups.items() for v in vs], "device string, bytes_total double, domain_entropy double")
    got = {(r["device"], r["feature"]): r for r in profile.robust_stats(df, ["bytes_total", "domain_entropy"]).collect()}
    for k, vs in groups.items():
        for feature, log in (("bytes_total", True), ("domain_entropy", False)):
            for name, want in statement(vs, log).items():
                assert got[k, feature][name] == pytest.approx(want, rel=1e-9), (k, feature, name)


def test_unseen_port_scores_one(spark):
    ends = spark.createDataFrame([("d", 0, "port", "tcp/9999")], "device string, window_start long, kind string, value string")
    known = spark.createDataFrame([("d", "destination_ports", "tcp/80", 3)], "device string, kind string, value string, n long")
    flagged = deviation.unseen_endpoints(ends, known)
    row = deviation.unseen_shares(flagged).first()
    assert (row["new_ports"], row["new_destinations"]) == (1.0, 0.0)
    assert deviation.unseen_evidence(flagged).first()["evidence"] == ["tcp/9999"]


def test_robust_z_and_scores(spark):
    df = spark.createDataFrame([(5.0, 2.0, 2.0, 2.0, 4.0, "linear"), (1.0, 2.0, 1.0, 3.0, 4.0, "linear"), (8.0, 2.0, 1.0, 3.0, 4.0, "linear"),
                                (None, 2.0, 1.0, 3.0, 4.0, "linear")], "v double, f_median double, f_q1 double, f_q3 double, f_max double, f_trim_space string")
    got = [r[0] for r in df.select(deviation.robust_z(F.col("v"), "f")).collect()]
    assert got[0] == pytest.approx(7.5) and got[1] == 0.0 and got[2] == pytest.approx(6 / (2 / 1.349)) and got[3] == 0.0
    one = spark.createDataFrame([(0.5, 0.5, 0.0)], "a double, b double, c double")
    assert one.select(deviation.noisy_or([F.col(c) for c in "abc"])).first()[0] == pytest.approx(0.75)
    assert one.select(deviation.top_component(["a", "b", "c"])).first()[0] == "a"
    assert one.select(deviation.calibrated(F.lit(1.0), F.lit(1.0))).first()[0] == pytest.approx(1.0)
