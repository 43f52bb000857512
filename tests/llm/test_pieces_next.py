"""Segmentations after the best: ids, scores and texts."""

import numpy as np
import pytest

from merchlake.llm import pieces


@pytest.mark.parametrize("n_best", [2, 4])
def test_next_segmentations(spark, documents, n_best):
    texts = ["hello", "the cat", "é▁x", "a", "日本 naïve", "x" * 40, "", None, "mentaux \x01ab  the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(documents.selectExpr("doc_id + 1000 AS doc_id", "substr(text, 1, 400) AS text").limit(60))
    lattice = pieces.Lattice(*pieces.load_pieces(), 64)
    spelt = {i: p for p, (i, _) in lattice.pieces.items()} | {i: bytes([b]) for b, i in enumerate(lattice.by_byte)}
    rows = pieces.encode_pieces(docs, n_best=n_best, verify=True).collect()
    assert len(rows) == docs.count() and sum(len(r.next_ids) for r in rows) >= 60
    for r in rows:
        assert r.decodes and len(r.next_ids) == len(r.next_scores)
        each = [r.ids, *r.next_ids]
        assert len({tuple(x) for x in each}) == len(each)
        for ids, score in zip(r.next_ids, r.next_scores):
            assert b"".join(spelt[i] for i in ids) == (" " + r.text).encode() and abs(sum(lattice.scores[i] for i in ids) - score) < 1e-6
        assert list(r.next_scores) == sorted(r.next_scores, reverse=True)
        if 0 < len(r.text or "") < 9:  # one heap over the whole text gives the same scores
            found = lattice.segment([(" " + r.text).encode()])[0]
            assert np.allclose([s for s, _ in found[1:n_best]], r.next_scores)


def test_query_returns_the_second(spark):
    from merchlake.llm.entries import QUERIES

    rows = QUERIES["op4_pieces"](spark, "/root/testdata/sf0.001").where("next_score is not null").collect()
    assert rows and all(r.next_ids and r.next_ids != r.ids and r.decodes for r in rows)
