"""Structured Streaming forms of the operators: keyed dedupe, fetch health, changes per key, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merchlake.operators import compare
from merchlake.operators.ledger import ABORT_RATE, DEGRADED_RATE, LEAST_OUTCOMES, WINDOW
from merchlake.sources.tables import delete

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def first_rows(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten after the watermark, so state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_outcomes(stream: DataFrame, time: str, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Outcomes and blocked ones by event-time window; rows later than the watermark are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("outcomes"), F.count_if("blocked").alias("blocked"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "outcomes", "blocked")


def session_outcomes(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Outcomes by key and session."""
    counted = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("outcomes"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "outcomes")


def health(stream: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """run, outcomes so far, block rate over the last WINDOW outcomes and the state it means, after each batch.

    The state of a run is its last WINDOW outcomes and a count: a fixed size, however long the stream.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, bits = state.get if state.exists else (0, "")
        rows = pd.concat(frames).sort_values(order)
        bits = (bits + "".join("1" if b else "0" for b in rows["blocked"]))[-WINDOW:]
        seen += len(rows)
        state.update((seen, bits))
        rate = bits.count("1") / len(bits)
        name = "HEALTHY" if seen < LEAST_OUTCOMES else "ABORT" if rate >= ABORT_RATE else "DEGRADED" if rate >= DEGRADED_RATE else "HEALTHY"
        yield pd.DataFrame({"run": [key[0]], "outcomes": [seen], "block_rate": [rate], "state": [name]})

    kept = stream.select(F.col(run).cast("string").alias("run"), F.col(order).cast("long").alias(order), "blocked")
    return kept.groupBy("run").applyInPandasWithState(step, "run string, outcomes long, block_rate double, state string", "seen long, bits string", "update", GroupStateTimeout.NoTimeout)


def changes_by_key(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, before, after for each change of a value; the state of a key is its last value."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values("at")
        out = []
        for v in rows["value"]:
            if last is not None and v != last:
                out.append((name[0], last, v))
            last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "before", "after"])

    kept = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col(value).cast("string").alias("value"))
    return kept.groupBy("key").applyInPandasWithState(step, "key string, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append"):
    """Process what there is now and stop: the form of a scheduled recurring check."""
    return stream.writeStream.format(form).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _flat(field: str) -> str:
    return field.replace(".", "_")


class RecordComparison:
    """Records of a stream against the last one of their key, in micro-batches that may be repeated.

    Batch n reads the last records that stood after the batch before it (folder/state/batch=<number>), writes its changes to folder/changes/batch=n and the
    last records to folder/state/batch=n, each as a whole in place of what a failed or repeated run of the batch left there. So a batch has one outcome however
    often it runs. Records of one key within a batch follow each other by `order`. States before the last two are deleted. Of a record only what a comparison
    reads (compare.COMPARED) is moved and kept, as `seen`; states of whole records are read too.
    """

    def __init__(self, folder: str, keys: tuple[str, ...], order: str):
        self.folder, self.keys, self.order = folder.rstrip("/"), keys, order

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        states = self._states(spark)
        before = max((n for n in states if n < number), default=None)
        rows = self._seen(batch).withColumn("__new", F.lit(True))
        if before is not None:
            kept = spark.read.parquet(f"{self.folder}/state/batch={before}")
            kept = kept.select(*rows.columns[:-1]) if "seen" in kept.columns else self._seen(kept)
            rows = rows.unionByName(kept.withColumn("__new", F.lit(False)))
        # the number of parts is given, as adaptive execution would join parts by their packed size until a few tasks compare all
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *self.keys)
        along = Window.partitionBy(*self.keys).orderBy("__new", self.order)
        last = rows.withColumn("__more", F.lead("__new").over(along)).where(F.col("__more").isNull()).drop("__new", "__more")
        rows = rows.withColumn("__old", F.lag("seen").over(along)).where("__new")
        had = F.col("__old").isNotNull()
        told = compare.product_changes(rows, *[lambda f, side=side: F.col(side)[_flat(f)] for side in ("seen", "__old")], had).select(*self.keys, self.order, had.alias("compared"), F.col("__found").alias("changes"), F.col("__warned").alias("warnings"))
        # as one method the comparison is longer than what the JVM compiles (8,000 bytes) and would run interpreted; Spark cuts it up if told so
        limit = spark.conf.get(METHOD_LIMIT)
        spark.conf.set(METHOD_LIMIT, 8000)
        try:
            told.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        finally:
            spark.conf.set(METHOD_LIMIT, limit)
        last.write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")
        for n in states:
            if before is not None and n < before:
                delete(spark, f"{self.folder}/state/batch={n}")

    def _seen(self, records: DataFrame) -> DataFrame:
        """Keys, order and what a comparison reads of records."""
        return records.select(*self.keys, self.order, F.struct(*[F.col(f).alias(_flat(f)) for f in compare.COMPARED]).alias("seen"))

    def _states(self, spark) -> list[int]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # a state counts once its writer has finished
        return [int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(place) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(place) else []

    def changes(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/changes")


def compare_records(stream: DataFrame, comparison: RecordComparison, checkpoint: str):
    """Start the comparison of a stream of records; it processes what there is and stops."""
    return stream.writeStream.foreachBatch(comparison).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
