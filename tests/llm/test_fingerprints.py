"""Threshold-scaled fingerprints against a plain version."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from merchlake.llm import fingerprints

LIMIT = 16**15 // 4


def plain_sketch(text):
    w = brute.words(text)
    grams = [w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
    hashes = {int(hashlib.md5(" ".join(g).encode()).hexdigest()[:15], 16) for g in grams}
    return {h for h in hashes if h < LIMIT} or {min(hashes)} if hashes else set()


def plain(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, ...) of every row."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    told = lambda s: "".join(f"{h:015x}" for h in sorted(s))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    inside = lambda a, b: len(a & b) / len(a) if a else 1.0
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        part = len(t) // 4
        edited = t[: len(t) - part] + other[:part]
        a, b, c = map(plain_sketch, (t, edited, other))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), near(a, b), near(a, c), inside(a, b), inside(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [3, 512])
def test_fingerprints(spark, documents, odd_rows, block_rows):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()] + [(10**6 + r[0], r[1]) for r in odd_rows if r[0] != 7] + [(2**62 + 7, "far 𝄞 away " * 9)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, block string, copy string").repartition(4)
    assert sorted((tuple(r) for r in fingerprints.fingerprint_documents(docs, block_rows=block_rows).collect()), key=str) == plain(rows)


def test_repeated_rows_and_no_ids(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(1, "other words here"), (None, "x y z"), (None, None), (None, "x y z"), (2, ""), (3, " "), (-4, "first of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block_rows in (2, 512):
        assert sorted((tuple(r) for r in fingerprints.fingerprint_documents(docs, block_rows=block_rows).collect()), key=str) == plain(rows)


def test_one_row_and_none(spark, empty):
    assert [tuple(r) for r in fingerprints.fingerprint_documents(spark.createDataFrame([(9, "one two three")], "doc_id long, text string")).collect()] == plain([(9, "one two three")])
    assert fingerprints.fingerprint_documents(empty).collect() == []


def test_sketches_merge_and_tell_containment(spark):
    """A union's sketch is made of sketches alone; a short text within one a hundred times as long is found in it."""
    short, long = " ".join(f"s{i}" for i in range(300)), " ".join(f"l{i}" for i in range(30_000))
    row = spark.createDataFrame([(short, f"{long} {short}", long)], "s string, both string, l string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in ("s", "both", "l")])
    row = row.withColumn("merged", fingerprints.merge_sketches(F.col("s"), F.col("l")))
    got = row.select("s", "both", "l", "merged", fingerprints.containment(F.col("s"), F.col("both")).alias("inside"), fingerprints.containment(F.col("s"), F.col("l")).alias("apart"), fingerprints.likeness(F.col("s"), F.col("both")).alias("near")).first()
    assert got.inside == 1.0 and got.apart == 0.0 and got.near < 0.02
    seam = plain_sketch(" ".join(long.split()[-4:] + short.split()[:4]))
    assert set(got.both) - set(got.merged) <= seam and set(got.merged) <= set(got.both)
    assert abs(len(got.both) / 30_296 - 0.25) < 0.01


def test_native(spark, documents):
    plan = fingerprints.fingerprint_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and plan.count("Window ") <= 2
