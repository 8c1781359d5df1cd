"""Header-driven TSV logs and JSON lines as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxprint.functions.scalars import null_if_unset, touches_mac
from fluxprint.schemas import CONN_SCHEMA

LINES = T.StructType([T.StructField("file", T.StringType()), T.StructField("split", T.LongType()), T.StructField("position", T.LongType()),
                      T.StructField("value", T.StringType())])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, position, value`` of text files; a missing path has no lines.

    ``split`` is where the part of the file that a task read begins, and ``position`` grows
    along the lines of a split. The files must not change between two uses of the lines.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LINES)
    # a task's own numbering starts anew in its upper bits, so only the lower ones count
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       inside.alias("position"), "value")


def _along_file(splits: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` over the splits of a file before each one; there is one row a split."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(name, value.over(before))


# A1
def header_records(lines: DataFrame) -> DataFrame:
    """``file, record`` of a TSV log, ``record`` a map by the header above the line.

    A split knows its own headers and the last one of the splits before it, carried over by one
    row a split, so lines meet headers within their split and a large file is many keys.
    Records before any header, and other comment lines, are dropped. A short line lacks its
    last fields.
    """
    header = F.when(F.col("value").startswith("#fields"), F.struct(
        "position", F.expr("slice(split(value, '\\t'), 2, size(split(value, '\\t')))").alias("fields")))
    splits = lines.groupBy("file", "split").agg(F.sort_array(F.collect_list(header), asc=False).alias("_own"))
    carried = _along_file(splits, "_carried", F.last(F.get("_own", F.lit(0))["fields"], ignorenulls=True))
    heads = carried.filter((F.size("_own") > 0) | F.col("_carried").isNotNull())
    rows = lines.filter(~F.col("value").startswith("#")).join(heads, ["file", "split"])
    above = F.filter("_own", lambda h: h["position"] < F.col("position"))
    found = rows.withColumn("_fields", F.coalesce(F.get(above, F.lit(0))["fields"], F.col("_carried"))).filter("_fields is not null")
    values = F.split("value", "\t")
    n = F.least(F.size("_fields"), F.size(values))
    record = F.map_from_arrays(F.slice("_fields", F.lit(1), n), F.slice(values, F.lit(1), n))
    return found.select("file", record.alias("record"))


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return header_records(read_lines(spark, path))


def typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` from the record map; unset and unparsable are NULL."""
    def column(field: T.StructField) -> Column:
        raw = null_if_unset(F.try_element_at("record", F.lit(field.name)))
        return raw.try_cast(field.dataType).alias(field.name)

    return records.select("file", *[column(f) for f in schema.fields])


# A2
def connections(records: DataFrame, mac: str | None = None, initiated_only: bool = True) -> DataFrame:
    """Typed connection rows, of one device if a MAC is given.

    The filter reads the raw map, so other devices' rows are never converted.
    """
    raw = records.select("*", F.try_element_at("record", F.lit("orig_l2_addr")).alias("orig_l2_addr"),
                         F.try_element_at("record", F.lit("resp_l2_addr")).alias("resp_l2_addr"))
    return typed(raw.filter(touches_mac(mac, initiated_only=initiated_only)).select("file", "record"), CONN_SCHEMA)


# A3
def numbered(some: DataFrame, lines: DataFrame) -> DataFrame:
    """``some`` of the lines with ``line``, their number in the file from 1, from the counts of the splits before."""
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("_n"), F.min("position").alias("_first"))
    starts = _along_file(splits, "_before", F.sum("_n")).drop("_n")
    line = F.coalesce("_before", F.lit(0)) + F.col("position") - F.col("_first") + 1
    return some.join(starts, ["file", "split"]).withColumn("line", line).drop("_before", "_first")


def _parsed(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, Column]:
    body = lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return body.withColumn("j", F.from_json("value", with_bad)), F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()


def json_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the bad lines with their file and number; blank and ``#`` lines are skipped."""
    parsed, bad = _parsed(lines, schema)
    good = parsed.filter(~bad).select("file", *[f"j.{f.name}" for f in schema.fields])
    return good, numbered(parsed.filter(bad), lines).select("file", "line", "value")


def strict_json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """As :func:`json_lines`, but a bad line fails the query with its file and number."""
    parsed, bad = _parsed(lines, schema)
    error = F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(":"), F.col("line").cast("string")))
    checked = numbered(parsed, lines).withColumn("j", F.when(bad, error.cast(parsed.schema["j"].dataType)).otherwise(F.col("j")))
    return checked.select("file", *[f"j.{f.name}" for f in schema.fields])
