"""Recounts of labelled records; an unavailable observation is never benign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions.stats import ratio


def _grouped(rows: DataFrame, by: Sequence[str], aggregates: list[Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


# I1
def detection(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion with unscored and excluded rows kept apart.

    Unscored positives count as misses in recall and F1 but enter neither
    precision nor the false positive rate. A label outside {0, 1} is an error.
    """
    label = F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(
        F.raise_error(F.lit("truth must be a binary label")).cast("int"))
    used = F.coalesce("eligible", F.lit(True)) if "eligible" in rows.columns else F.lit(True)
    marked = rows.select(*by, used.alias("_used"), F.when(used, label).alias("_y"), F.col("flag").alias("_f"))
    y, f, on = F.col("_y") == 1, F.col("_f"), F.col("_used")
    counts = _grouped(marked, by, [
        F.count_if(on & y & f).alias("TP"), F.count_if(on & ~y & f).alias("FP"), F.count_if(on & ~y & ~f).alias("TN"),
        F.count_if(on & y & ~f).alias("FN"), F.count_if(on & y & f.isNull()).alias("unscored_positive"),
        F.count_if(on & ~y & f.isNull()).alias("unscored_negative"), F.count_if(on).alias("population"),
        F.count_if(~on).alias("excluded")])
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    missed = F.col("unscored_positive")
    return counts.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn + missed).alias("population_recall"),
        ratio(2 * tp, 2 * tp + fp + fn + missed).alias("population_f1"), ratio(fp, fp + tn).alias("fpr"),
        ratio(tp + fp + tn + fn, F.col("population")).alias("coverage"))


# I2
def policy_confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``expected`` against ``actual`` permission; denied is the positive class."""
    e, a = F.col("expected"), F.col("actual")
    known = F.coalesce(e.isin("allowed", "denied"), F.lit(False))
    decided = F.coalesce(a.isin("allowed", "denied"), F.lit(False))
    both = known & decided
    counts = _grouped(rows, by, [
        F.count_if(both & (e == "denied") & (a == "denied")).alias("TP"),
        F.count_if(both & (e == "allowed") & (a == "denied")).alias("FP"),
        F.count_if(both & (e == "allowed") & (a == "allowed")).alias("TN"),
        F.count_if(both & (e == "denied") & (a == "allowed")).alias("FN"),
        F.count_if(known).alias("eligible"), F.count_if(~known).alias("unsupported"),
        F.count_if(known & ~decided & (e == "denied")).alias("unavailable_forbidden"),
        F.count_if(known & ~decided & (e == "allowed")).alias("unavailable_permitted"),
        F.count(F.lit(1)).alias("records")])
    scored = F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")
    return counts.select("*", ratio(scored, F.col("records")).alias("binary_coverage_of_all_records"),
                         ratio(F.col("TP") + F.col("TN"), scored).alias("agreement_on_scored_records"))


# I3
def response_confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    need, did, on = F.col("required"), F.col("proposed"), F.coalesce("eligible", F.lit(True))
    return _grouped(rows, by, [
        F.count_if(on & need & did).alias("TP"), F.count_if(on & ~need & did).alias("FP"),
        F.count_if(on & ~need & ~did).alias("TN"), F.count_if(on & need & ~did).alias("FN"),
        F.count_if(on & did.isNull()).alias("unavailable"), F.count_if(~on).alias("excluded"),
        F.count_if(on).alias("population")])


# I6
def truth_windows(planned: DataFrame, actors: DataFrame, window: int, start: int, end: int) -> DataFrame:
    """Label per device and window from planned events and what was seen of them.

    ``planned`` holds ``run_id, t, actor, target, relational, found``; ``actors``
    holds ``run_id, actor, attack_start, relational``. A planned but unseen window
    is unknown (-1), and so is an actor's window after the attack began without
    any planned event. ``relational`` runs also label the actor's relationships.
    """
    minute = (F.floor(F.col("t") / window) * window).cast("bigint")
    ends = planned.select("run_id", minute.alias("window_start"), "actor", "relational", "found",
                          F.explode(F.filter(F.array("actor", "target"), lambda d: d.isNotNull())).alias("device"))
    seen = ends.groupBy("run_id", "device", "window_start").agg(
        F.bool_or("found").alias("_found"), F.bool_or(F.col("device") == F.col("actor")).alias("_actor"),
        F.bool_or(F.col("relational") & (F.col("device") == F.col("actor"))).alias("_rel"))
    value = F.when(F.col("_found"), 1).otherwise(-1)
    known = seen.select(
        "run_id", "device", "window_start", value.alias("behavior_label"),
        F.when(F.col("_rel"), value).otherwise(0).alias("relationship_label"),
        F.when(F.col("_actor"), "actor").otherwise("victim").alias("role"))
    silent = actors.select("run_id", F.col("actor").alias("device"), "relational", F.explode(F.sequence(
        (F.lit(start) + F.col("attack_start")).cast("bigint"), F.lit(end - window).cast("bigint"),
        F.lit(window).cast("bigint"))).alias("window_start")).join(known, ["run_id", "device", "window_start"], "left_anti")
    return known.unionByName(silent.select(
        "run_id", "device", "window_start", F.lit(-1).alias("behavior_label"),
        F.when(F.col("relational"), -1).otherwise(0).alias("relationship_label"), F.lit("actor").alias("role")))


def observed_fraction(planned: DataFrame, by: Sequence[str] = ("run_id",), floor: float = 0.99) -> DataFrame:
    total, seen = F.count(F.lit(1)), F.count_if("found")
    return planned.groupBy(*by).agg(total.alias("planned"), seen.alias("observed"), (seen / total).alias("observed_fraction"),
                                    (seen / total >= floor).alias("passed"))
