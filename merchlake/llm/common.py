"""Shared helpers of the training-data operators: tables, written stages, text in numpy."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at at once (more only for one longer text).
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 8 << 20
#: Blocks of eight bytes that are hashed at once.
BLOCKS_AT_ONCE = 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one of our own only on a single machine where that is unset."""
    global _own_scratch
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _own_scratch = _own_scratch or tempfile.mkdtemp(prefix="merchlake-")
    return _own_scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: one pass, lineage cut, its shuffle files freed.

    A lost executor costs only a reread of the written files. `discard` deletes them by name, `release` once no DataFrame reads them.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._merchlake_path = path
    # every plan over this table, however derived, holds this one listing of its files
    files = table._jdf.queryExecution().analyzed().relation().location()
    _written(spark)[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(files)
    return table


def _written(spark: SparkSession) -> dict:
    """Path to a weak reference to the listing of each table that materialize wrote in this session and that stands."""
    return spark.__dict__.setdefault("_merchlake_written", {})


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _written(spark).pop(path, None)


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables that materialize wrote, once nothing reads them any more."""
    for table in tables:
        if path := getattr(table, "_merchlake_path", None):
            _delete(table.sparkSession, path)
            table._merchlake_path = None


def release(spark: SparkSession) -> int:
    """Delete the tables of materialize that no DataFrame can read any more; returns how many.

    A table stays for as long as a DataFrame over it, or over anything made of it, is held by anyone in this session. The driver's
    garbage is collected first; what it has not let go yet waits for the next call. An RDD or iterator alone does not hold a table.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    gone = [path for path, files in _written(spark).items() if files.get() is None]
    for path in gone:
        _delete(spark, path)
    return len(gone)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with batches of bounded bytes, as rows may hold long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def running_total(df: DataFrame, order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """Inclusive running totals over the whole of df in the order given, without a global window.

    df is range-partitioned on `order` (unique together) and written; totals of the partitions, one
    row each, give every partition its offset. `values` maps a new column to the column it sums.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    totals = cut.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in values.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__o_{k}") for k in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumns({k: F.col(f"__o_{k}") + F.sum(v).over(inside) for k, v in values.items()})
        .drop("__part", *[f"__o_{k}" for k in values])
    )


# ---------------------------------------------------------------- text in numpy

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (nulls: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches, text: str = "text", most: int = SLICE_BYTES):
    """Record batches cut so that each holds about `most` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, off: np.ndarray, no_word: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that no_word doesn't mark; [^\\x20\\x09-\\x0D]+), and the index of each row's first word (one more at the end)."""
    n = len(data)
    sep = no_word[data]
    edge = np.ones(n + 1, bool)
    edge[1:] = sep if n else edge[1:]
    edge[off] = True  # a row begins anew
    starts = np.flatnonzero(~sep & edge[:n])
    after = np.ones(n + 1, bool)
    after[:n] = sep
    after[off] = True
    ends = np.flatnonzero(~sep & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[starts:ends], equal for equal bytes wherever they stand.

    Blocks of eight bytes are scrambled together with their place in the span and added up, so no arrangement of
    blocks is alike by construction, as it would be in a polynomial.
    """
    view, length = eights(data), ends - starts
    blocks = np.maximum(1, -(-length // 8))
    done = np.cumsum(blocks)
    if len(done) and done[-1] > 2 * BLOCKS_AT_ONCE:  # spans may overlap, so their bytes may be many times the data's
        cuts = np.flatnonzero(np.diff(done // BLOCKS_AT_ONCE)) + 1
        return np.concatenate([_spans(view, s, n, b) for s, n, b in zip(*(np.split(x, cuts) for x in (starts, length, blocks)))])
    return _spans(view, starts, length, blocks)


def _spans(view: np.ndarray, starts: np.ndarray, length: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    if len(length) and int(length.max()) > 8:
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        left = np.minimum(np.repeat(length, blocks) - 8 * place, 8)
        h = mix((view[np.repeat(starts, blocks) + 8 * place] & _TAIL[left]) + place.astype(np.uint64) * _P)
        h = np.add.reduceat(h, first)
    else:
        h = mix(view[starts] & _TAIL[length])
    return mix(h + length.astype(np.uint64) * _P)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which of the byte spans data[starts:ends] are the same bytes as data[others:other_ends]."""
    length = ends - starts
    same = length == other_ends - others
    if not len(same):
        return same
    view, blocks = eights(data), np.maximum(1, -(-np.where(same, length, 0) // 8))
    first = np.cumsum(blocks) - blocks
    place = 8 * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    left = _TAIL[np.clip(np.repeat(np.where(same, length, 0), blocks) - place, 0, 8)]
    alike = ((view[np.repeat(starts, blocks) + place] ^ view[np.repeat(others, blocks) + place]) & left) == 0
    return same & np.logical_and.reduceat(alike, first)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings data[i:i+k]; k is a multiple of 8, 64 at most."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block = mix(eights(data).copy())
    h = block[:n].copy()
    for j in range(8, k, 8):
        h *= _P
        h += block[j : j + n]
    return mix(h)


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of items[i:i+k] for each i where k items are left."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):  # few items, each scrambled already
        h *= _P
        h += items[j : j + n]
    return mix(h)


def sequence_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the sequences items[starts:ends] of scrambled items (one at least), each together with its place."""
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    h = mix(items[np.repeat(starts, length) + place] + place.astype(np.uint64) * _P)
    return mix(np.add.reduceat(h, first) + length.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)


def anchored(h: np.ndarray, off: np.ndarray, width: int, k: int):
    """Cut texts at their anchors. h: hashes of the k-grams that start at each item, off: where texts begin, in items.

    The anchor of a window of `width` items is the least hash of its k-grams, the leftmost of equal ones; a piece is a run of windows of one
    text with the anchor at one place. Returns each piece's anchor hash, text, first item, number of windows and the anchor's distance.
    Equal windows have equal anchors, wherever they stand.
    """
    n = int(off[-1])
    windows = n - width + 1
    if windows <= 0:
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 4
    bits = np.uint64(max(22, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, size = width - k + 1, 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[:windows], key[w - size : w - size + windows])
    at = (key & low).astype(np.int64)
    row = row_of(off).astype(np.int32)
    ok = row[:windows] == row[width - 1 :]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    a = np.flatnonzero(new)
    b = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
    return [h[at[a]], row[a].astype(np.int64), a, b - a + 1, at[a] - a]


def row_of(first: np.ndarray) -> np.ndarray:
    """For offsets first[0..n], the row of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def word_count(text):
    """Column: number of [^\\x20\\x09-\\x0D]+ in text, by replacing each word with one letter (null: 0)."""
    short = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(short, " \t\n\x0b\f\r", "")).cast("long")


# ---------------------------------------------------------------- rows and packed columns


def identified(docs: DataFrame, name: str, keep: list[str] = []) -> DataFrame:
    """docs(doc_id, text) with __row, unique, and __ord, which orders documents (null doc_ids last); columns `keep` as __keep_<name>.

    Both are doc_id where that is unique and never null; else the rows are written once with numbers.
    """
    rows = docs.select("doc_id", "text", *[F.col(c).alias(f"__keep_{c}") for c in keep])
    seen = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    if seen[0] == seen[1]:
        return rows.withColumns({"__row": order, "__ord": order})
    return materialize(rows.withColumns({"__row": F.monotonically_increasing_id(), "__ord": order}), name)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
