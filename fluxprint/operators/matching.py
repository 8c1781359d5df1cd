"""Joins that are not plain equality, each planned as an equality join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions.scalars import ipv4_number, ipv6_digits, network_parts, network_parts_6, truncate_ipv4, truncate_ipv6


# C11
def band_match(left: DataFrame, right: DataFrame, on: Sequence[str], left_t: str, right_t: str, within: float,
               left_id: str) -> DataFrame:
    """Left rows with ``found``: a right row of the same key lies within ``within`` seconds.

    The right side is cut into time cells as long as the tolerance and keeps
    only its first and last instant per cell. A left row asks its own cell and
    the two beside it, so a key's rows are spread over cells and no pairs of
    raw rows are formed.
    """
    cell = F.floor(F.col(right_t) / F.lit(within)).cast("bigint")
    marks = right.groupBy(*on, cell.alias("_cell")).agg(F.min(right_t).alias("_first"), F.max(right_t).alias("_last"))
    own = F.floor(F.col(left_t) / F.lit(within)).cast("bigint")
    asked = left.withColumn("_own", own).withColumn("_cell", F.explode(F.array(own - 1, own, own + 1)))
    t, tol = F.col(left_t), F.lit(within)
    # Before: its last instant is nearest. After: its first is. Inside: any instant of
    # the cell is within the tolerance, because the cell is no longer than that.
    near = (F.when(F.col("_cell") < F.col("_own"), t - F.col("_last") <= tol)
            .when(F.col("_cell") > F.col("_own"), F.col("_first") - t <= tol).otherwise(F.col("_first").isNotNull()))
    hits = asked.join(marks, [*on, "_cell"]).filter(near).select(left_id).distinct()
    return left.join(hits.withColumn("found", F.lit(True)), left_id, "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def latest_until(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, start: str, end: str,
                 slice_seconds: float) -> DataFrame:
    """Points with ``_until``: the latest end among spans of the key begun by then.

    A point is covered when ``t < _until``. Running maxima are taken inside
    ``(key, slice)`` and one maximum per slice is carried over, so no point is
    paired with every span that could cover it.
    """
    flagged = points.withColumn("_t", F.col(t).cast("double")).withColumn("_end", F.lit(None).cast("double"))
    marks = spans.select(*keys, F.col(start).cast("double").alias("_t"), F.col(end).cast("double").alias("_end"))
    both = (flagged.withColumn("_point", F.lit(1)).unionByName(marks.withColumn("_point", F.lit(0)), allowMissingColumns=True)
            .withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_seconds))))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # points come along in the summary, as their slice may hold no span
    carried = (both.groupBy(*keys, "_slice").agg(F.max("_end").alias("_m"))
               .select(*keys, "_slice", F.max("_m").over(earlier).alias("_carried")))
    placed = both.withColumn("_running", F.max("_end").over(inside)).filter("_point = 1")
    joined = placed.join(carried, [*keys, "_slice"])
    return joined.withColumn("_until", F.greatest("_running", "_carried")).drop(
        "_t", "_end", "_point", "_slice", "_running", "_carried")


# B16, C10
def in_networks(addresses: DataFrame, networks: DataFrame, on: Sequence[str]) -> DataFrame:
    """``(on, address, network)`` for every address inside a network of its key.

    Each distinct address is looked up once per prefix length that its key's networks
    have, so a range test becomes an equality join; malformed text matches nothing.
    """
    wanted = networks.select(*on, "network").distinct()
    ips = addresses.select(*on, "address").distinct()

    def family(parts: tuple[Column, Column], value: Column, truncate: Callable[[Column, Column], Column]) -> DataFrame:
        nets = wanted.select(*on, "network", parts[0].alias("_base"), parts[1].alias("_bits")).filter("_base is not null")
        lengths = nets.select(*on, "_bits").distinct()   # 129 per key at most
        keys = ips.withColumn("_n", value).filter("_n is not null").join(lengths, list(on)).withColumn("_base", truncate(F.col("_n"), F.col("_bits")))
        return keys.join(nets, [*on, "_base", "_bits"]).select(*on, "address", "network")

    address, network = F.col("address"), F.col("network")
    return family(network_parts(network), ipv4_number(address), truncate_ipv4).unionByName(
        family(network_parts_6(network), ipv6_digits(address), truncate_ipv6))


def suffixes(name: Column) -> Column:
    """The name and every dotted suffix of it; as many as it has labels."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


# C10
def related_names(facts: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct ``(on, domain, name)`` that are equal, or one a sub-domain of the other.

    Both directions are equality joins on exploded suffixes.
    """
    f, o = facts.select(*on, "domain").distinct(), observed.select(*on, "name").distinct()
    below = o.withColumn("domain", F.explode(suffixes(F.col("name")))).join(f, [*on, "domain"])
    above = f.withColumn("name", F.explode(suffixes(F.col("domain")))).join(o, [*on, "name"])
    return below.select(*on, "domain", "name").unionByName(above.select(*on, "domain", "name")).distinct()


# C12
def window_labels(labels: DataFrame, window: int, keys: Sequence[str] = ("device",)) -> DataFrame:
    """Label of each touched window: contained = its label, otherwise unknown (-1).

    A label is exploded to the windows it touches, which are its result rows, so
    the interval join is an equality on the window. Windows that no label
    touches are absent, and unknown too.
    """
    lo = (F.floor(F.col("start") / window) * window).cast("bigint")
    hi = ((F.ceil(F.col("end") / window) - 1) * window).cast("bigint")
    touched = labels.filter(F.col("end") > F.col("start")).withColumn(
        "window_start", F.explode(F.sequence(lo, hi, F.lit(window).cast("bigint"))))
    full = (F.col("start") <= F.col("window_start")) & (F.col("end") >= F.col("window_start") + window)
    agg = touched.groupBy(*keys, "window_start").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.bool_or(full).alias("_full"))
    known = F.col("_full") & (F.col("_lo") == F.col("_hi"))
    return agg.select(*keys, "window_start", F.when(known, F.col("_lo")).otherwise(-1).alias("label"))


def target_labels(labels: DataFrame, intervals: DataFrame, window: int) -> DataFrame:
    """Label of a window from nested intervals where its label rows have any.

    ``intervals`` are keyed ``label_id``. A contained interval is 1, a touching
    one -1, else 0; windows whose labels have no intervals keep the plain label
    when it is unanimous.
    """
    step = F.lit(window).cast("bigint")
    lo = (F.ceil(F.col("start") / window) * window).cast("bigint")
    hi = ((F.floor(F.col("end") / window) - 1) * window).cast("bigint")
    inner = labels.filter(lo <= hi).withColumn("window_start", F.explode(F.sequence(lo, hi, step)))
    ilo = (F.floor(F.col("i_start") / window) * window).cast("bigint")
    ihi = ((F.ceil(F.col("i_end") / window) - 1) * window).cast("bigint")
    nested = intervals.select("label_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    hits = (nested.filter(F.col("i_end") > F.col("i_start"))
            .withColumn("window_start", F.explode(F.sequence(ilo, ihi, step)))
            .groupBy("label_id", "window_start").agg(F.bool_or(
                (F.col("i_start") <= F.col("window_start")) & (F.col("i_end") >= F.col("window_start") + window)).alias("_full")))
    has = nested.select("label_id").distinct().withColumn("_has", F.lit(True))
    rows = inner.join(has, "label_id", "left").join(hits, ["label_id", "window_start"], "left")
    agg = rows.groupBy("device", "window_start").agg(
        F.bool_or("_has").alias("_has"), F.bool_or("_full").alias("_full"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    nested_value = F.when(F.col("_full"), 1).when(F.col("_full").isNotNull(), -1).otherwise(0)
    plain = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(-1)
    return agg.select("device", "window_start", F.when(F.col("_has"), nested_value).otherwise(plain).alias("label"))


# C13
def with_fallback(rows: DataFrame, levels: Sequence[tuple[str, Sequence[str], DataFrame]], value: str) -> DataFrame:
    """First value found going through ``levels``, with the name of its scope.

    Each level is ``(scope, keys, table)``; a level without keys is a single row.
    """
    out, found, scope = rows, [], None
    for i, (name, keys, table) in enumerate(levels):
        column = f"_v{i}"
        if keys:
            side = table.select(*keys, F.col(value).alias(column))
            out = out.join(side, list(keys), "left")
        else:
            # one row by contract: a scalar subquery, not a join of rows with rows
            out = out.withColumn(column, table.select(value).scalar())
        found.append(F.col(column))
        hit = F.col(column).isNotNull()
        scope = F.when(hit, name) if scope is None else scope.when(hit, name)
    return out.withColumn(value, F.coalesce(*found)).withColumn("scope", scope).drop(*[f"_v{i}" for i in range(len(levels))])
