"""Sharding by histogram sort.

Keys are hash-random but keep equal texts side by side: the high bits hash the text, the low bits the
doc_id. A splitter does not part a group of equal texts, unless that group alone is a large share of a shard. Splitters between shards are found by counting exact bytes below candidate boundaries: each
round splits only the key ranges that hold a splitter into finer ones and sums the bytes of each, until
every splitter is within tolerance. Then the rows go to their shards in one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import materialize

KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 10, 7
#: Low bits of a key, which tell the rows of one text apart; a group of equal texts above this share of a shard's bytes is parted.
ROW_BITS, GROUP_SHARE = 32, 0.1
SLOT_ROWS = 50_000


def shard_key(text, doc_id):
    """Column: 31 bits of the text's hash above 32 bits of the doc_id's."""
    high = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0x7FFFFFFF)
    low = F.xxhash64(doc_id).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(high, ROW_BITS).bitwiseOR(low)


def splitters(keyed: DataFrame, n_shards: int, tolerance: float, group_share: float = GROUP_SHARE) -> list[int]:
    """Keys that cut keyed(__key, size) into n_shards ranges of near equal bytes (first keys of shards 1..).

    A boundary is refined until its bytes are off by no more than tolerance of a shard, or its range is one text of
    no more than group_share of a shard (it then goes to the nearer side), or one key. Only sums come to the driver: (n_shards - 1) * 2**NEXT_BITS rows a round at most.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * j / n_shards for j in range(1, n_shards)]
    slack, group = tolerance * total / n_shards, group_share * total / n_shards
    #: open ranges: prefix of the key at the present shift -> bytes below it
    found, ranges, shift = {}, {0: 0}, KEY_BITS
    waiting = {j: 0 for j in range(len(targets))}
    while waiting and total:
        finer = max(0, shift - (FIRST_BITS if shift == KEY_BITS else NEXT_BITS))
        rows = keyed if shift == KEY_BITS else keyed.where(F.shiftright("__key", shift).isin(sorted(ranges)))
        sums = rows.groupBy(F.shiftright("__key", finer).alias("p")).agg(F.sum("size").alias("b")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for p, b in sorted((r["p"], r["b"]) for r in sums):
            by.setdefault(p >> (shift - finer), []).append((p, b))
        below: dict[int, int] = {}
        for j, at in list(waiting.items()):
            low = ranges[at]
            for p, b in by[at]:
                if low + b >= targets[j] or p == by[at][-1][0]:
                    near, far = targets[j] - low, low + b - targets[j]
                    if min(near, far) <= slack or finer == 0 or (finer == ROW_BITS and b <= group):
                        found[j] = (p if near <= far else p + 1) << finer
                        del waiting[j]
                    else:
                        waiting[j], below[p] = p, low
                    break
                low += b
        ranges, shift = below, finer
    return [found.get(j, 1 << KEY_BITS) for j in range(len(targets))]


def shard_of(key, cuts: list[int]):
    """Column: the shard of a key."""
    most = (1 << KEY_BITS) - 1
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts if c <= most), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text).

    size is the UTF-8 bytes of the text (null: none) plus 8. Shards have near equal bytes (law `bytes`); equal
    texts share a shard, unless their group holds more than GROUP_SHARE of a shard's bytes, and then neighbouring shards.
    Slots count from 0 without gaps in each shard. Rows with equal doc_id and text may be swapped, and are neighbours;
    null doc_ids hash as null, null and empty texts are one group. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = materialize(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), shard_key(F.col("text"), F.col("doc_id")).alias("__key")),
        "shard-keys",
    )
    cuts = splitters(keyed, n_shards, tolerance)
    blocks = max(1, -(-keyed.count() // (n_shards * SLOT_ROWS)))
    dealt = keyed.withColumns({"shard": shard_of(F.col("__key"), cuts), "__block": F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).cast("int")})
    counts = dealt.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__block").orderBy("__key", "doc_id", "size", "text_crc32")
    placed = dealt.withColumn("__row", F.row_number().over(inside)).join(offsets, ["shard", "__block"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__offset") + F.col("__row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, tolerance: float = 0.001, files_per_shard: int = 1) -> list[int]:
    """Write docs to path/shard=N, each row exchanged once; returns the splitters."""
    key = shard_key(F.col("text"), F.col("doc_id"))
    sized = docs.select((F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).alias("size"), key.alias("__key"))
    cuts = splitters(materialize(sized, "shard-keys"), n_shards, tolerance)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    placed = docs.withColumn("shard", shard_of(key, cuts)).repartition(n_shards * files_per_shard, "shard", part)
    placed.write.partitionBy("shard").parquet(path)
    return cuts
