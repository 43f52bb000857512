"""Ranked search against a plain version that scores every document in whole numbers."""

import math
import re
from collections import Counter

import brute
import numpy as np
import pytest

from merchlake.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, items, top=20):
    terms = [(i, TERM.findall(brute.lower(t))) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    counts = [(i, len(w), Counter(w)) for i, w in terms]
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(brute.lower(text)))
        scored = []
        for i, n, tf in counts:
            m = 75 + 25 * n * n_docs // max(total, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, r in asked.items() if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark, documents, odd_rows):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(10**6 + r[0], r[1]) for r in odd_rows]
    docs += [(None, "mit license words"), (None, "mit license words"), (5, "mit license words"), (5, "mit license words")] + [(2 * 10**6 + k, "tie tie broken") for k in range(30)]
    found = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    asked = found + [(None, "MIT License"), (7, "license"), (7, "license"), (900, None), (901, " -- "), (902, "nowhere0"), (903, "tie"), (904, "the the THE of Ünïcode ünïcode"), (905, " ".join(t or "" for _, t in docs[:40]))]
    return docs, asked


@pytest.mark.parametrize("shard_bytes,query_bytes", [(search.SHARD_BYTES, search.QUERY_BYTES), (20_000, 2_000)])
def test_ranks_are_those_of_all_scores(spark, tables, shard_bytes, query_bytes):
    docs, asked = tables
    d = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, score string, query string").repartition(5)
    b = spark.createDataFrame([(*r, "clash") for r in asked], "item_id long, text string, rank string")
    assert sorted((tuple(r) for r in search.search_documents(d, b, shard_bytes=shard_bytes, query_bytes=query_bytes).collect()), key=str) == plain(docs, asked)


def test_lists_that_cannot_qualify_bring_no_candidates():
    """Two thousand documents hold only a common term; twenty hold a rare one too, and the common list is only probed."""
    rare, common = np.arange(20), np.arange(2_000)
    lists = [(common, np.full(2_000, 5, np.int64)), (rare, np.full(20, 100, np.int64))]
    best = search.Best(20)
    scored = search.rank_shard(best, np.array([0, 1]), np.array([1, 1]), lists, np.array([5, 100]), np.arange(2_000), np.zeros(2_000, bool))
    assert scored == 20 and best.score.tolist() == [105] * 20 and best.doc.tolist() == list(range(20))


def test_terms_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(search, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    queries = search.Queries([(1, "one two three"), (2, "three")])
    data = np.frombuffer(b"two none three on one", np.uint8)
    hits, terms = queries.find(data, np.array([0, 4, 9, 15, 18]), np.array([3, 8, 14, 17, 21]))
    assert hits.tolist() == [0, 2, 4] and [bytes(queries.data[queries.starts[t] : queries.ends[t]]) for t in terms] == [b"two", b"three", b"one"]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search_documents(empty, items).collect() == []
    assert search.search_documents(spark.createDataFrame([(1, "word")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert search.search_documents(spark.createDataFrame([(1, None), (2, "- -")], "doc_id long, text string"), items).collect() == []
