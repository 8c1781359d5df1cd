"""Residual scores, strict flags, and checks of recorded flags and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions.ordered import growing


# H1
def top_k_mean(values: Column, k: int = 3) -> Column:
    """Mean of the ``k`` largest valid entries of an array column; NULL without any.

    The array is one row's own vector, so nothing is collected across rows.
    """
    valid = F.filter(values, lambda v: v.isNotNull())
    top = F.slice(F.sort_array(valid, asc=False), 1, k)
    return F.when(F.size(valid) > 0, F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top))


def scaled_residuals(observed: Column, expected: Column, scale: Column) -> Column:
    return F.transform(F.arrays_zip(observed.alias("o"), expected.alias("e"), scale.alias("s")),
                       lambda r: F.abs(r["o"] - r["e"]) / r["s"])


# H2
def normalised_maximum(components: Sequence[str], scales: Sequence[str]) -> Column:
    """Largest component after scaling; missing components are skipped."""
    scaled = [F.col(c) / F.col(s) for c, s in zip(components, scales)]
    return F.greatest(*scaled) if len(scaled) > 1 else scaled[0]


# H3
def source_scores(relationships: DataFrame, nodes: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """A node's score is its highest outgoing one; NULL when it opened none."""
    best = relationships.groupBy(*keys).agg(F.max(score).alias(score))
    return nodes.join(growing(best), list(keys), "left")


# H4
def strict_flag(score: Column, threshold: Column) -> Column:
    """Above the threshold, not at it; no score gives no flag."""
    return score > threshold


def node_status(active: Column, available: Column) -> Column:
    return F.when(~available, "unavailable").when(~active, "inactive").otherwise("ok")


def unscored_reason(score: Column, reason: str) -> Column:
    return F.when(score.isNull(), reason)


# H5
def flag_errors(rows: DataFrame, heads: Sequence[tuple[str, str, str, str]], keys: Sequence[str]) -> DataFrame:
    """Recorded flags that their score and threshold do not support.

    ``heads`` lists ``(name, score, flag, threshold)``; one pass over the rows.
    """
    checks = []
    for name, score, flag, threshold in heads:
        s, f, t = F.col(score), F.col(flag), F.col(threshold)
        odd = t.isNull() | F.isnan(s) | F.isnan(t) | (F.abs(s) == float("inf")) | (F.abs(t) == float("inf"))
        error = (F.when(s.isNull(), F.when(f.isNotNull(), "flag_without_score"))
                 .when(odd, "invalid_score_or_threshold").when(~f.eqNullSafe(s > t), "strict_cutoff_mismatch"))
        checks.append(F.struct(F.lit(name).alias("head"), error.alias("error")))
    return (rows.select(*keys, F.explode(F.array(*checks)).alias("_c")).select(*keys, "_c.head", "_c.error")
            .filter(F.col("error").isNotNull()))


# H6
def parity(expected: DataFrame, actual: DataFrame, keys: Sequence[str], heads: Sequence[tuple[str, str]],
           tolerance: float = 1e-4) -> DataFrame:
    """Keys, statuses, flags and scores compared row by row; differing rows only."""
    fields = ["status", *[c for pair in heads for c in pair]]
    e = expected.select(*keys, *[F.col(c).alias("e_" + c) for c in fields], F.lit(True).alias("_e"))
    a = actual.select(*keys, *[F.col(c).alias("a_" + c) for c in fields], F.lit(True).alias("_a"))
    both = e.join(a, list(keys), "full")

    def differs(c: str) -> Column:
        return ~F.col("e_" + c).eqNullSafe(F.col("a_" + c))

    rules = [F.when(F.col("_a").isNull(), "missing"), F.when(F.col("_e").isNull(), "unexpected")]
    paired = F.col("_a") & F.col("_e")
    rules.append(F.when(paired & differs("status"), "status"))
    for score, flag in heads:
        es, as_ = F.col("e_" + score), F.col("a_" + score)
        rules.append(F.when(paired & differs(flag), flag))
        rules.append(F.when(paired & (es.isNull() != as_.isNull()), score + "_availability"))
        rules.append(F.when(paired & (F.abs(es - as_) > tolerance), score))
    return both.select(*keys, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("difference"))


def largest_error(expected: DataFrame, actual: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    pairs = expected.alias("e").join(actual.alias("a"), list(keys))
    return pairs.agg(F.count(F.lit(1)).alias("records"), *[
        F.max(F.abs(F.col(f"e.{s}") - F.col(f"a.{s}"))).alias(f"max_error_{s}") for s in scores])


def violations(rows: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Broken rules per row, long; a NULL condition is not a violation."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda n: n.isNotNull())
    return rows.select(*keys, F.explode(names).alias("rule"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
