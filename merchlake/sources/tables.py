"""Sources and sinks: captured pages, stored datasets, baselines, gated output, run summaries."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlake.operators.compare import earliest, latest
from merchlake.operators.quality import gate

#: One row for each fetch: what was asked, where it landed, what came back.
CAPTURES = T.StructType([
    T.StructField(n, t) for n, t in [
        ("seq", T.LongType()), ("label", T.StringType()), ("market", T.StringType()), ("url", T.StringType()), ("final_url", T.StringType()),
        ("lookup_key", T.StringType()), ("page", T.IntegerType()), ("ok", T.BooleanType()), ("html", T.StringType()), ("status_code", T.IntegerType()),
        ("received_at", T.TimestampType()), ("attempts", T.IntegerType()), ("proxy_tier", T.StringType()), ("page_type", T.StringType()),
        ("location_applied", T.BooleanType()), ("resolved_postal_code", T.StringType()), ("reason", T.StringType()), ("message", T.StringType()),
        ("blocked", T.BooleanType()), ("not_found", T.BooleanType()),
    ]
])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only on a single machine where that is unset."""
    context = spark.sparkContext
    if not (folder := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="merchlake-"))
        folder = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_captures(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Captured pages under the fixed schema; missing columns are null, so older captures still read."""
    return spark.read.schema(CAPTURES).format(form).load(path)


def read_dataset(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return spark.read.format(form).load(path)


def read_baseline(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], form: str = "json") -> DataFrame:
    """The last successful row of each key of an earlier run, read under the current schema."""
    rows = spark.read.schema(schema).format(form).load(path)
    known = rows.where(F.col("status") == "SUCCESS")
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return latest(known, keys, order)


def write_bucketed_baseline(records: DataFrame, name: str, keys: tuple[str, ...] = ("marketplace", "item"), buckets: int = 64) -> None:
    """Keep records as a table bucketed and sorted by keys and place (the postal code, or "default"), which monitoring joins without moving it."""
    placed = records.withColumn("place", F.coalesce(F.nullif(F.trim("location.resolvedPostalCode"), F.lit("")), F.lit("default")))
    placed.write.mode("overwrite").bucketBy(buckets, keys[0], *keys[1:], "place").sortBy(keys[0], *keys[1:], "place").saveAsTable(name)


def read_untyped_baseline(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """keys and `record` (VARIANT): the last successful record of each key of stored JSON lines, whatever schema each of them was written under.

    Lines that are no JSON, and records without one of the keys, are left out.
    """
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("record")).where(F.try_variant_get("record", "$.status", "string") == "SUCCESS")
    rows = rows.select(*[F.try_variant_get("record", f"$.{k}", "string").alias(k) for k in keys], F.try_variant_get("record", f"$.{order}", "string").alias("__order"), F.to_json("record").alias("__text"))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    last = rows.groupBy(*keys).agg(F.max_by("__text", F.struct("__order", "__text")).alias("__text"))
    return last.select(*keys, F.parse_json("__text").alias("record"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_records(records: DataFrame, path: str, rules: dict[str, Column], keys: list[str], order: list[str], form: str = "parquet") -> DataFrame:
    """Append the first row of each key that keeps the rules and is not at path yet; returns the rows that break them, as failures.

    The job commits as a whole: a failed append leaves nothing behind, so a retry is no duplicate.
    """
    spark = records.sparkSession
    good, bad = gate(records, rules)
    first = earliest(good, keys, order)
    if _exists(spark, path):
        there = spark.read.schema(records.schema).format(form).load(path).select(*keys)
        first = first.join(there, keys, "left_anti")
    first.write.format(form).mode("append").save(path)
    return bad


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of a run's summary, as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def export(records: DataFrame, path: str, form: str = "json") -> None:
    """json, csv (nested columns as JSON text) or parquet."""
    if form == "csv":
        nested = [f.name for f in records.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        records = records.withColumns({c: F.to_json(c) for c in nested})
        records.write.mode("overwrite").option("header", True).csv(path)
    else:
        records.write.mode("overwrite").format(form).save(path)


def over_limit(rows: DataFrame, limit: int) -> str | None:
    """A notice if a stored dataset has more rows than the limit; counts no more than one row beyond it."""
    return f"only the first {limit} rows are read" if rows.limit(limit + 1).count() > limit else None
