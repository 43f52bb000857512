"""Stages of the pipeline against plain versions."""

from collections import Counter, defaultdict

import brute


def kept_by_five_words(rows, num=80, den=100):
    sets = {i: brute.shingles(t, 5) for i, t in rows}
    groups, posts = brute.Groups(sets), defaultdict(list)
    for i, s in sets.items():
        for j, o in Counter(j for g in s for j in posts[g]).items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                groups.join(i, j)
        for g in s:
            posts[g].append(i)
    return sorted(i for i in sets if groups.find(i) == i)


def test_near_copies_of_five_words(spark, documents):
    import corpus_pipeline as p

    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    planted = []
    for k, (size, edits) in enumerate([(1000, 18), (1000, 20), (1000, 22), (1000, 23), (400, 7), (400, 8), (400, 9), (4, 1)]):
        plain = [f"p{k}w{i}" for i in range(size)]
        changed = list(plain)
        for e in range(edits):  # scattered, at least six words from each other and from the ends
            changed[(2 * e + 1) * size // (2 * edits)] = f"p{k}x{e}"
        planted += [(10**6 + 2 * k, " ".join(plain)), (10**6 + 2 * k + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string")
    got = sorted(r.doc_id for r in p.keep_one_of_near_copies(spark, docs, "").collect())
    assert got == kept_by_five_words(rows + planted)
    gone = [k for k in range(8) if 10**6 + 2 * k + 1 not in got]
    assert gone == [0, 1, 2, 4, 5]


def test_encoding_finds_the_next_segmentation_too(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "a few words of a text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in p.encode(spark, docs, "").collect()}
    assert len(got[1].next_ids) == len(got[1].next_scores) == 1 and got[1].next_scores[0] <= got[1].score and got[1].next_ids[0] != got[1].ids
    assert got[1].decodes and (got[2].n_pieces, got[2].next_ids) == (0, [])
