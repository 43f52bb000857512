"""Ranked lexical search: MaxScore over shards of documents, for queries in blocks.

A first pass counts documents, terms and the documents of each query term; a second one cuts the documents into shards, makes the
posting lists of the query terms in each and ranks every query over them. In a shard a query's lists are sorted by their upper bounds.
Only the essential ones, those with which a document could still enter the best, bring candidates in; the others are probed for
those candidates, and only while a candidate's score and the bounds of the lists not yet probed can qualify. The thresholds go
from shard to shard of a task; the tasks' best rows meet in two levels of windows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import LOWER, in_arrow, row_of, same_spans, slices, span_hashes, utf8, word_bounds

TOP = 20
#: Bytes of text of a shard (more only for one longer text), and of the queries of a block.
SHARD_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Groups of tasks whose best rows meet first.
SALTS = 64
#: What a term is made of: ASCII letters and digits, and all that is beyond ASCII.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_NO_TERM = np.zeros(256, bool)
_NO_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_TO_LOWER = {c: c + 32 for c in range(65, 91)}
_LAST = np.int64(2**63 - 1)


class Queries:
    """A block of queries: distinct terms by hash, and each query's terms with their repeats."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        words = [TERM.findall((t or "").translate(_TO_LOWER)) for _, t in items]
        terms = sorted({w.encode() for ws in words for w in ws})
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - [len(t) for t in terms]
        hashes = span_hashes(self.data, starts, ends) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.starts, self.ends = hashes[order], starts[order], ends[order]
        # terms of one hash are told apart by their bytes; the loop in `find` runs as often as the largest such group
        self.alike = int(np.unique(hashes, return_counts=True)[1].max()) if terms else 0
        place = {terms[k]: n for n, k in enumerate(order)}
        self.terms = [np.unique(np.array([place[w.encode()] for w in ws], np.int64), return_counts=True) for ws in words]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans of data are query terms, and which terms they are."""
        h = span_hashes(data, starts, ends)
        first = np.searchsorted(self.hashes, h)
        found = np.full(len(h), -1, np.int64)
        for step in range(self.alike):
            at = np.minimum(first + step, len(self.hashes) - 1)
            maybe = np.flatnonzero((self.hashes[at] == h) & (found < 0))
            both = np.concatenate([data, self.data])
            same = same_spans(both, starts[maybe], ends[maybe], self.starts[at[maybe]] + len(data), self.ends[at[maybe]] + len(data))
            found[maybe[same]] = at[maybe[same]]
        hits = np.flatnonzero(found >= 0)
        return hits, found[hits]


def _postings(part: pa.RecordBatch, queries: Queries):
    """Of the rows of a batch: number of terms of each row; then row, query term and occurrences, by row."""
    data, off = utf8(part.column(part.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, off, _NO_TERM)
    hits, term = queries.find(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    key = row_of(first)[hits] * max(1, len(queries.hashes)) + term
    key, count = np.unique(key, return_counts=True)
    return np.diff(first), key // max(1, len(queries.hashes)), key % max(1, len(queries.hashes)), count


def _statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents of each query term (no more rows than those reach the driver)."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(len(queries.hashes), np.int64)
        for part in slices(batches):
            lengths, _, term, _ = _postings(part, queries)
            n, total, df = n + int((lengths > 0).sum()), total + int(lengths.sum()), df + np.bincount(term, minlength=len(df))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *there.tolist()], pa.int64()), "n": pa.array([n, total, *df[there].tolist()], pa.int64())})

    df, sums = np.zeros(len(queries.hashes), np.int64), {-2: 0, -1: 0}
    for term, n in in_arrow(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if term < 0:
            sums[term] = n
        else:
            df[term] = n
    return sums[-2], sums[-1], df


class Best:
    """The best rows of a query so far: scores falling, then doc_ids rising (nulls as the largest number, marked)."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a further document must reach."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((null, doc, -score))[: self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def rank_shard(best: Best, terms: np.ndarray, repeats: np.ndarray, lists: list, bounds: np.ndarray, doc: np.ndarray, null: np.ndarray) -> int:
    """MaxScore of one query over one shard, into best; returns how many documents were scored.

    lists[t] are the rows of term t, rising, and what the term gives each; bounds[t] the most that it gives.
    """
    most = bounds[terms] * repeats
    order = np.argsort(most, kind="stable")
    terms, repeats, most = terms[order], repeats[order], most[order]
    ahead = np.cumsum(most)  # of a list and all below it: what a document that is in no higher list can reach
    seen, scored = np.zeros(len(doc), bool), 0
    for j in range(len(terms) - 1, -1, -1):
        least = best.least()
        if ahead[j] < least:
            break  # this list and all below it are not essential any more
        rows, gives = lists[terms[j]]
        new = ~seen[rows]
        rows, score = rows[new], gives[new] * repeats[j]
        seen[rows] = True
        for k in range(j - 1, -1, -1):
            can = score + ahead[k] >= least
            if not can.all():
                rows, score = rows[can], score[can]
            if not len(rows):
                break
            other, more = lists[terms[k]]
            if len(other):
                at = np.minimum(np.searchsorted(other, rows), len(other) - 1)
                score = score + np.where(other[at] == rows, more[at], 0) * repeats[k]
        can = score >= least
        scored += len(rows)
        if can.any():
            best.add(score[can], doc[rows[can]], null[rows[can]])
    return scored


def _rank(batches, queries: Queries, n_docs: int, n_terms: int, weights: np.ndarray, top: int, shard_bytes: int):
    best, parts, held = [Best(top) for _ in queries.ids], [], 0

    def shard():
        lengths, rows, terms, counts, doc, null = (np.concatenate(x) for x in zip(*parts))
        length = 75 + (25 * lengths * n_docs) // n_terms
        gives = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * length[rows]))
        order = np.argsort(terms, kind="stable")
        rows, gives = rows[order], gives[order]
        cuts = np.searchsorted(terms[order], np.arange(len(queries.hashes) + 1))
        lists = [(rows[a:b], gives[a:b]) for a, b in zip(cuts, cuts[1:])]
        bounds = np.array([int(g.max()) if len(g) else 0 for _, g in lists], np.int64)
        for found, (t, repeats) in zip(best, queries.terms):
            if len(t):
                rank_shard(found, t, repeats, lists, bounds, doc, null)

    n = 0
    for part in slices(batches):
        lengths, rows, terms, counts = _postings(part, queries)
        ids = part.column(part.schema.get_field_index("doc_id"))
        null = np.asarray(ids.is_null())
        doc = np.where(null, _LAST, np.asarray(ids.fill_null(0), np.int64))
        parts.append((lengths, rows + n, terms, counts, doc, null))
        n, held = n + len(lengths), held + part.nbytes
        if held >= shard_bytes:
            shard()
            parts, n, held = [], 0, 0
    if parts:
        shard()
    task = TaskContext.get().partitionId()
    for q, found in enumerate(best):
        if k := len(found.score):
            yield pa.RecordBatch.from_pydict({"query": pa.array([q] * k, pa.int32()), "task": pa.array([task] * k, pa.int32()), "item_id": pa.array([queries.ids[q]] * k, pa.int64()), "doc_id": pa.array(found.doc, pa.int64(), mask=found.null), "score": pa.array(found.score, pa.int64())})


def _best_of_block(docs: DataFrame, queries: Queries, top: int, shard_bytes: int) -> DataFrame:
    """item_id, rank, doc_id, score for the queries of one block."""
    schema = "query int, task int, item_id long, doc_id long, score long"
    n_docs, n_terms, df = _statistics(docs, queries)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights))  # a block of queries is of bounded size
    found = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda batches: _rank(batches, shared.value[0], n_docs, n_terms, shared.value[1], top, shard_bytes), schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("salt", F.pmod("task", F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= top)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    return near.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of docs(doc_id, text) for each row of items(item_id, text).

    Terms are maximal runs of ASCII letters and digits and of all beyond ASCII, A-Z lower-cased. A term weighs
    floor(1000 * ln((2N + 2) / (2df + 1))) and gives a document weight * (10**9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, for each of its repeats in
    the item. Only scores above 0 count; equal ones go by doc_id, null ones last. Null and empty texts hold no terms: such items get no
    rows, such documents are counted nowhere. Repeated documents rank one by one, repeated items are items each. Items are read in
    blocks of about query_bytes, so neither the driver nor a task ever holds more of them; every block passes over all documents. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        queries = Queries([tuple(r) for r in block.collect()])
        if len(queries.hashes):
            out = out.unionByName(_best_of_block(docs, queries, top, shard_bytes))
    return out


SEARCH_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
found AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), totals),
gives AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))) AS g
  FROM found JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scored AS (SELECT item_id, doc_id, CAST(sum(repeats * g) AS BIGINT) AS score FROM asked JOIN gives USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
