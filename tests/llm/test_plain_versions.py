"""Sharding and toxicity scores against plain versions in Python."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlake.llm import common, sharding, toxicity

MASK = 2**64 - 1


def plain_cuts(rows, n_shards, share):
    """First keys of shards 1.. over rows (key, size) sorted by key: a cut is at the nearer border of the group of equal texts that holds its
    target, or of the one key if that group is above `share` of a shard."""
    total = sum(s for _, s in rows)

    def nearer(rows, low, target, name):
        """The border of the group (by name) in which the target falls: its name, bytes below it, and whether the cut stands behind it."""
        groups = {}
        for k, s in rows:
            groups[name(k)] = groups.get(name(k), 0) + s
        for g, b in sorted(groups.items()):
            if low + b >= target or g == max(groups):
                return g, low, b, target - low > low + b - target
            low += b

    cuts = []
    for j in range(1, n_shards):
        target = total * j / n_shards
        text, low, b, behind = nearer(rows, 0, target, lambda k: k >> sharding.ROW_BITS)
        if b > share * total / n_shards and min(target - low, low + b - target) > 0:
            key, low, b, behind = nearer([(k, s) for k, s in rows if k >> sharding.ROW_BITS == text], low, target, lambda k: k)
            cuts.append(key + behind)
        else:
            cuts.append((text + behind) << sharding.ROW_BITS)
    return cuts


@pytest.mark.parametrize("copies", [0, 300])
def test_shards_are_those_of_a_sort(spark, documents, copies):
    docs = documents.select("doc_id", "text").unionByName(spark.range(copies).select((F.col("id") + 10**6).alias("doc_id"), F.lit("one text of many rows").alias("text")))
    keyed = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), sharding.shard_key(F.col("text"), F.col("doc_id")).alias("key")).collect()
    cuts = plain_cuts(sorted((r.key, r["size"]) for r in keyed), 24, sharding.GROUP_SHARE)
    want = {r.doc_id: sum(c <= r.key for c in cuts) for r in keyed}
    got = sharding.shard_documents(docs, 24, tolerance=0.0).collect()
    assert {r.doc_id: r.shard for r in got} == want
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(v == s for v in want.values())))


def plain_score(text, model):
    """Mean weight of the features of each block of words, the highest block through the logistic curve."""
    words = [w.encode() for w in brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    blocks = -(-len(words) // toxicity.BLOCK)
    held = [set() for _ in range(blocks)]
    for i, w in enumerate(words):
        held[i * blocks // len(words)].add(w)
    best = []
    for block in held:
        buckets = []
        for w in block:
            whole = common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
            buckets.append(int(whole[0]) >> 48)
            padded = b" " + w + b" "
            for n in toxicity.GRAMS:
                for at in range(len(padded) - n + 1):
                    h = (n + sum(padded[at + j] * int(toxicity._WEIGHTS[j]) for j in range(n))) & MASK
                    h ^= h >> 29
                    buckets.append(((h * 0xBF58476D1CE4E5B9) & MASK) >> 48)
        best.append(sum(float(model.weights[b]) for b in buckets) / max(len(buckets), toxicity.PAD) + model.bias)
    return 1 / (1 + np.exp(-(model.scale * max(best, default=model.bias) + model.shift)))


def test_toxicity_scores_are_those_of_bags(spark, documents, odd_rows):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(documents, labels)
    rows = [(r.doc_id, r.text) for r in documents.limit(40).collect()] + [(10**6 + r[0], r[1]) for r in odd_rows if r[0] != 7] + [(5, "Mixed CASE mixed case, twice twice"), (6, "ünï çödé " * 60)]
    got = {r.doc_id: r["__score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows[40:], "doc_id long, text string").unionByName(spark.createDataFrame([(2 * 10**6 + k, t) for k, (_, t) in enumerate(rows[:40])], "doc_id long, text string")), model).collect()}
    want = {i: plain_score(t, model) for i, t in rows[40:]} | {2 * 10**6 + k: plain_score(t, model) for k, (_, t) in enumerate(rows[:40])}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
