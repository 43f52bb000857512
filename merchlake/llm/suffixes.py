"""Suffix-array dedup of byte strings.

Which suffixes must be sorted together: of the hashes of all ANCHOR-byte strings in a window of `width` bytes the least is
the window's anchor, so equal windows have equal anchors. Consecutive windows of a text with one anchor at one place are a piece of it.
Pieces are rows; anchors that occur once go, equal pieces are one (all but the first occurrence are removed whole), and
the different pieces of an anchor stay open. These go, as bytes, by anchor to tasks of about PART_BYTES each,
where their suffixes are sorted in two stages: those smaller than their successor
directly, the rest induced by scanning the buckets of first bytes. Neighbours in that order with a common prefix of
`width` bytes are equal windows, and all but the first of them are removed.

An anchor with very many different pieces is parted: its windows hold either the bytes before it or those behind it, so each half
goes by the anchor together with these. What is still a large group then goes window by window, each a row, and
Spark takes the first of equal ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm import common
from merchlake.llm.common import discard, identified, in_arrow, materialize, shuffle_width

WIDTH, ANCHOR = 100, 32
#: Different pieces of one anchor (or part of one) that are sorted in one task, and bytes of pieces for a task.
HOT_PIECES, PART_BYTES = 4096, 2 << 20


def _pieces(width: int, k: int):
    """Pieces of texts. Columns: row, ord, text."""

    def run(batches):
        for batch in common.slices(batches):
            data, off = common.utf8(batch.column(2))
            anchor, of, at, n, far = common.anchored(common.gram_hashes(data, k), off, width, k)
            piece = common.span_hashes(data, at, at + n + width - 1) if len(at) else anchor
            rows, orders = (np.asarray(batch.column(i), np.int64)[of] for i in (0, 1))
            made = (anchor.view(np.int64), piece.view(np.int64), rows, orders, (at - off[of]).astype(np.int32), n.astype(np.int32), far.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["anchor", "piece", "row", "ord", "a", "n", "far"])

    return run


def _cut(width: int, k: int):
    """The bytes of the open pieces, in two halves where the anchor is hot. Columns: row, text, pieces."""
    side = (width - k) // 2

    def run(batches):
        for batch in common.slices(batches):
            data, off = common.utf8(batch.column(1))
            lists = batch.column(2)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            anchor, order, a, n, far, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "ord", "a", "n", "far", "hot"))
            begin = off[owner] + a
            # of a hot piece the first `early` windows hold `side` bytes before the anchor, the others those behind it
            early = np.clip(far.astype(np.int64) - side + 1, 0, n)
            place = begin + far
            keys, first, count, source = [], [], [], []
            cold = np.flatnonzero(~hot)
            for at, skip, number, start in ((np.flatnonzero(hot & (early > 0)), 0, early, place - side), (np.flatnonzero(hot & (early < n)), early, n - early, place)):
                if len(at):
                    keys.append(common.mix(common.span_hashes(data, start[at], start[at] + side + k) + np.uint64(1)))
                    source.append(at)
                    first.append(np.broadcast_to(skip, len(n))[at])
                    count.append(number[at])
            source = np.concatenate([cold, *source])
            key = np.concatenate([anchor[cold].view(np.uint64), *keys]).view(np.int64)
            first, count = np.concatenate([np.zeros(len(cold), np.int64), *first]), np.concatenate([n[cold], *count])
            raw, at = data.tobytes(), begin[source] + first
            bodies = [raw[x : x + c + width - 1] for x, c in zip(at.tolist(), count.tolist())]
            made = (key, order[source], np.asarray(batch.column(0), np.int64)[owner[source]], (a[source] + first).astype(np.int32), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in made), pa.array(bodies, pa.binary())], names=["key", "ord", "row", "a", "n", "body"])

    return run


def _windows(width: int):
    """Each window of the pieces by two hashes of its bytes. Columns: ord, row, a, n, body."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            data, off = common.utf8(batch.column(4))
            n = np.asarray(batch.column(3), np.int64)
            of = np.repeat(np.arange(batch.num_rows), n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = off[of] + step
            hashes = common.span_hashes(data, at, at + width), common.span_hashes(data ^ np.uint8(0xA5), at, at + width)
            made = (*(h.view(np.int64) for h in hashes), np.asarray(batch.column(0), np.int64)[of], np.asarray(batch.column(1), np.int64)[of], (np.asarray(batch.column(2), np.int64)[of] + step).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["h", "g", "ord", "row", "a"])

    return run


def _merged(row, start, count):
    """Intervals of windows, sorted and joined where they touch."""
    by = np.lexsort((start, row))
    row, start, count = row[by], start[by], count[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + count[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], (np.maximum.reduceat(start + count, at) if len(at) else start) - start[at]


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the first `depth` symbols (below 512) of their suffixes, and the 7-symbol blocks at each position.

    Two stages: suffixes smaller than their successors are sorted directly, block by block while they tie; the
    others follow from scanning the buckets of first symbols upwards, each found suffix putting its predecessor next in line.
    """
    n = len(symbols)
    s = symbols.astype(np.int64)
    blocks = np.zeros(n + depth + 7, np.uint64)
    for j in range(7):
        blocks[:n] <<= np.uint64(9)
        blocks[: n - j] |= s[j:].astype(np.uint64)
    step = np.sign(np.append(s[1:], -1) - s)
    # equal neighbours are of the kind of the next unequal pair
    turn = np.where(step != 0, np.arange(n), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = step[turn] > 0
    direct = np.flatnonzero(smaller)
    order = direct[np.argsort(blocks[direct], kind="stable")]
    group = np.concatenate([[0], np.cumsum(blocks[order][1:] != blocks[order][:-1])]) if len(order) else np.zeros(0, np.int64)
    for r in range(7, depth, 7):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = blocks[order[tied] + r]
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key = key[by]
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (key[1:] != key[:-1]) & (group[tied][1:] == group[tied][:-1])
        group = group + np.cumsum(split)
        # a tie's first member keeps apart from what stands before it
    ahead = s[order]
    cuts = np.searchsorted(ahead, np.arange(514))
    waiting: list[list[np.ndarray]] = [[] for _ in range(513)]
    waiting[s[n - 1]].append(np.array([n - 1]))  # the last suffix has an empty successor
    out = []

    def before(found):
        prior = found[found > 0] - 1
        return prior[~smaller[prior]]

    for c in np.unique(s).tolist():
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        induced = []
        while len(wave):
            induced.append(wave)
            prior = before(wave)
            wave = prior[s[prior] == c]
        bucket = np.concatenate([*induced, order[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        prior = before(bucket)
        prior = prior[s[prior] > c]
        by = np.argsort(s[prior].astype(np.uint16), kind="stable")
        prior = prior[by]
        for part in np.split(prior, np.flatnonzero(np.diff(s[prior])) + 1):
            if len(part):
                waiting[s[part[0]]].append(part)
    return np.concatenate(out), blocks


def _sort(width: int):
    """Windows of a task's pieces that are equal to an earlier one."""

    def run(table: pa.Table) -> pa.Table:
        order, row, a, n = (table.column(c).to_numpy().astype(np.int64) for c in ("ord", "row", "a", "n"))
        data, _ = common.utf8(table.column("body"))
        length = n + width - 1
        begin = np.cumsum(length + 1) - (length + 1)  # a 0 ends each piece
        symbols = np.zeros(int((length + 1).sum()), np.uint16)
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(length)), length)] = data.astype(np.uint16) + 1
        sorted_at, blocks = suffix_order(symbols, width)
        piece = np.repeat(np.arange(len(n)), length + 1)
        inside = np.arange(len(symbols)) - begin[piece]
        at = sorted_at[inside[sorted_at] < n[piece[sorted_at]]]  # suffixes that begin a window
        equal = np.ones(max(0, len(at) - 1), bool)
        for r in [*range(0, width - 7, 7), width - 7]:  # common prefixes of neighbours, block by block
            equal &= blocks[at[1:] + r] == blocks[at[:-1] + r]
        run_of = np.concatenate([[0], np.cumsum(~equal)]) if len(at) else np.zeros(0, np.int64)
        p, place = piece[at], a[piece[at]] + inside[at]
        by = np.lexsort((place, row[p], order[p], run_of))
        again = np.zeros(len(at), bool)
        again[1:] = run_of[by][1:] == run_of[by][:-1]
        p, place = p[by][again], place[by][again]
        r, start, count = _merged(row[p], place, np.ones(len(p), np.int64))
        return pa.table({"row": r.astype(np.int64), "a": start.astype(np.int32), "n": count.astype(np.int32)})

    return run


def _remove(width: int, with_text: bool):
    def run(batches):
        for batch in common.slices(batches):
            out = []
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw, kept, at, runs = (text or "").encode(), [], 0, 0
                for a, n in sorted((s["a"], s["n"]) for s in spans or ()):
                    runs += a > at or not runs
                    kept.append(raw[at : max(at, a)])
                    at = max(at, a + n + width - 1)
                kept.append(raw[at:])
                left = b"".join(kept)
                row = [doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()]
                out.append((*row, left) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def repeated_windows(rows: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """row, a, n: runs of windows of rows(__row, __ord, text) that also start earlier, in order of (__ord, __row, place); they may touch."""
    schema = "anchor long, piece long, row long, ord long, a int, n int, far int"
    pieces = materialize(in_arrow(rows.select("__row", "__ord", "text"), _pieces(width, anchor), schema), "suffix-pieces")
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    shared = materialize(shared, "suffix-shared")  # so that the join reads two plain shuffles, whose skewed partitions Spark can split
    held = materialize(pieces.join(shared.hint("shuffle_hash"), "anchor", "left_semi"), "suffix-held")
    discard(pieces, shared)
    first = F.min(F.struct("ord", "row", "a")).alias("src")
    distinct = materialize(held.groupBy("anchor", "piece").agg(first, F.min("n").alias("n"), F.min("far").alias("far")), "suffix-distinct")
    found = held.join(distinct.select("anchor", "piece", "src"), ["anchor", "piece"]).where(F.struct("ord", "row", "a") > F.col("src")).select("row", "a", "n")
    gone = materialize(found, "suffix-gone")
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", (F.col("c") > HOT_PIECES).alias("hot"))
    listed = distinct.join(kinds, "anchor").groupBy(F.col("src.row").alias("__r")).agg(F.collect_list(F.struct("anchor", F.col("src.ord").alias("ord"), F.col("src.a").alias("a"), "n", "far", "hot")).alias("pieces"))  # of one document
    texts = rows.join(listed, rows["__row"] == listed["__r"]).select("__row", "text", "pieces")
    cut = materialize(in_arrow(texts, _cut(width, anchor), "key long, ord long, row long, a int, n int, body binary"), "suffix-open")
    discard(held, distinct)
    groups = cut.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("body")).alias("bytes"))
    large = groups.where(F.col("c") > HOT_PIECES).select("key")
    parts = max(shuffle_width(rows.sparkSession), -(-(cut.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // PART_BYTES))
    small = cut.join(large, "key", "left_anti").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    equal = materialize(small.groupBy("part").applyInArrow(_sort(width), "row long, a int, n int"), "suffix-equal")
    single = in_arrow(cut.join(large, "key", "left_semi").select("ord", "row", "a", "n", "body"), _windows(width), "h long, g long, ord long, row long, a int")
    single = materialize(single, "suffix-windows")
    firsts = single.groupBy("h", "g").agg(F.min(F.struct("ord", "row", "a")).alias("src"))
    again = materialize(single.join(firsts, ["h", "g"]).where(F.struct("ord", "row", "a") > F.col("src")).select("row", "a", F.lit(1).alias("n")), "suffix-again")
    discard(cut, single)
    return gone.unionByName(equal).unionByName(again)


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, if with_text) for every row of docs(doc_id, text).

    A byte of a text's UTF-8 form (null: empty) goes if a `width`-byte string that covers it also starts earlier: in a row of
    smaller doc_id (null last; of rows of one doc_id the one read first) or in the same row. n_spans
    counts maximal removed runs. Strings shorter than width never match; texts of any length are read whole. Other columns are ignored; an empty
    table gives no rows. Pieces are told apart by two 64-bit hashes together. anchor: bytes of an anchor, a multiple of 8.
    """
    rows = identified(docs, "suffix-rows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_windows(rows, width, anchor).groupBy("row").agg(F.collect_list(F.struct("a", "n")).alias("spans"))  # of one document
    joined = rows.join(gone, rows["__row"] == gone["row"], "left").select("doc_id", "text", "spans")
    return in_arrow(joined, _remove(width, with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))


#: The same rows in DuckDB: windows as hexadecimal strings, the first place of each by a window function.
SUFFIXES_SQL = """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 200] AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
runs AS (  -- windows less than their width apart cover one run of bytes
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again))
  GROUP BY doc_id, g),
edges AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone, count(*) AS n FROM runs GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, n + 1), lambda k:
    h[2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1:2 * (CASE WHEN k = n THEN len(h) // 2 ELSE starts[k + 1] END)]), '') END)) AS kept_sha256
FROM texts t LEFT JOIN edges USING (doc_id)
"""
