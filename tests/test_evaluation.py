import pytest
from pyspark.sql import functions as F

from fluxprint.operators import evaluation, evidence, residuals, rollups

D = "label int, flag boolean"


def test_unscored_positives_are_misses(spark):
    r = evaluation.detection(spark.createDataFrame([(1, True), (1, None), (0, False), (0, None)], D)).first()
    assert (r["population_recall"], r["coverage"], r["TN"], r["population_f1"]) == (0.5, 0.5, 1, pytest.approx(2 / 3))
    lone = evaluation.detection(spark.createDataFrame([(0, False)], D)).first()
    assert lone["precision"] is None and lone["population_recall"] is None
    with pytest.raises(Exception):
        evaluation.detection(spark.createDataFrame([(2, True)], D)).collect()


def test_published_counts(spark):
    rows = [(1, True, 3824), (0, True, 13), (0, False, 9543), (1, False, 9)]
    df = spark.createDataFrame(rows, "label int, flag boolean, n int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = evaluation.detection(df).first()
    assert [round(r[c], 5) for c in ("precision", "population_recall", "population_f1", "fpr")] == [0.99661, 0.99765, 0.99713, 0.00136]


def test_policy_confusion(spark):
    r = evaluation.policy_confusion(spark.createDataFrame([("denied", "unknown_device"), ("allowed", "denied"), ("other", "denied")], "expected string, actual string")).first()
    assert (r["unavailable_forbidden"], r["FP"], r["unsupported"], r["eligible"]) == (1, 1, 1, 2)


def test_flags_are_strict(spark):
    df = spark.createDataFrame([("a", 1.0, False, 1.0), ("b", 1.0, True, 1.0), ("c", None, True, 1.0), ("d", 2.0, True, None), ("e", 2.0, None, 1.0)],
                               "device string, s double, f boolean, t double")
    got = {r["device"]: r["error"] for r in residuals.flag_errors(df, [("a", "s", "f", "t")], ["device"]).collect()}
    assert got == {"b": "strict_cutoff_mismatch", "c": "flag_without_score", "d": "invalid_score_or_threshold", "e": "strict_cutoff_mismatch"}


def test_top_k_mean(spark):
    df = spark.createDataFrame([([1.0, 5.0, None, 3.0, 4.0],), ([None],), ([2.0],)], "z array<double>")
    assert [r[0] for r in df.select(residuals.top_k_mean(F.col("z"))).collect()] == [4.0, None, 2.0]


def test_sensor_health_never_healthy_on_null(spark):
    df = spark.createDataFrame([(True, True, True, 0, []), (True, True, True, None, ["x"])],
                               "complete boolean, sensor_healthy boolean, clock_synchronized boolean, capture_drops long, unavailable_device_ids array<string>")
    a, b = evidence.sensor_health(df).collect()
    assert a["sensor"] == "healthy" and b["sensor"] == "unhealthy"
    assert b["issues"] == ["capture_drops_or_unavailable", "device_identity_unavailable"]


def test_current_alerts_are_never_cut(spark):
    rows = [(i, i >= 5, f"a{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "window_start long, current boolean, id string")
    assert rollups.limited_alerts(df, 3, "id").count() == 5
    assert {r["id"] for r in rollups.limited_alerts(df, 7, "id").collect()} == {f"a{i}" for i in range(3, 10)}
