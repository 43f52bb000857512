import numpy as np
import brute
from pyspark.sql import functions as F

from merchlake.llm import embeddings
from merchlake.llm.components import connected_components
from merchlake.llm.entries import ORACLES, QUERIES


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        base = rng.normal(size=24)
        for _ in range(1 + (i % 5 == 0) * 3):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=24) * 0.1], i % 3))
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 0), (5002, rows[0][1], 1), (5003, None, 0), (5004, [0.0] * 24, 0), (5005, [float("nan")] * 24, 0), (5006, rows[0][1], None), (5007, [1.0, None], 0), (5008, [], 0), (5009, [1.0, 2.0], 0), (5010, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, leaf=60).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, groups = {i: 0 for i, *_ in rows}, brute.Groups([i for i, *_ in rows])
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    assert all(got[i].n_links <= n for i, n in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values())
    assert got[5001].component_id == 0 and got[5002].component_id == 5002 and got[5009].n_links == 1 and got[5003].kept
    assert sum(r.component_id == groups.find(i) for i, r in got.items()) >= 0.97 * len(rows)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_recall_of_deep_forests(spark):
    """Eight levels and more in two rounds, pairs just above the threshold, a cluster larger than a leaf, vectors that no split parts."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.935 * base[:300] + np.sqrt(1 - 0.935**2) * off[:300]
    tight = base[500] + rng.normal(size=(120, 32)) * 0.02
    scaled = base[600] * np.arange(1, 101)[:, None]
    every = np.concatenate([base, near, tight, scaled]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(every)], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, leaf=24).collect()}
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    links = close.sum(1)
    assert all(got[i].n_links <= n for i, n in enumerate(links))
    assert sum(got[3000 + i].n_links > 0 for i in range(300)) >= 0.9 * 300
    assert sum(r.n_links for r in got.values()) >= 0.9 * links.sum()
    leaves = embeddings.forest_leaves(table.where("vec_id < 3300").selectExpr("vec_id AS node", "0L AS gid", "embedding"), 0.93, leaf=24)
    sizes = [r["count"] for r in leaves.groupBy("key").count().collect()]
    assert max(sizes) <= 24 and sum(n * n for n in sizes) < 0.5 * 3300**2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    groups = brute.Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    assert got == {x: groups.find(x) for x in groups.up if x != 7}


def test_lazy_results_outlive_other_pipelines(spark, documents):
    """A result that is held keeps the tables it reads while the stages of two pipelines take turns in the session."""
    import corpus_pipeline as p
    from merchlake.llm import common, mixing

    sf = "/root/testdata/sf0.001"
    docs = documents.limit(60)
    held = mixing.mix_sources(docs)
    taken = sorted(map(str, held.select("doc_id", "taken").collect()))
    left, right = docs, docs
    for _, stage in p.STAGES[:-1]:
        left, right = stage(spark, left, sf), stage(spark, right, sf)
        left = common.materialize(left, "left")
        right = common.materialize(right, "right")
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))
    assert sorted(map(str, held.select("doc_id", "taken").collect())) == taken
    before = len(common._written(spark))
    del held, left, right
    for _ in range(4):
        spark.range(9).groupBy("id").count().collect()
        common.release(spark)
    assert len(common._written(spark)) < before


def test_pipeline_and_names(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "n-gram jaccard join", "substring dedup", "mixing sources", "piece encoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kinds, before = docs.columns, [f.dataType for f in docs.schema], docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        docs = p.materialize(stage(spark, docs, sf), "test")
        if k < 4:
            assert docs.columns == columns and [f.dataType for f in docs.schema] == kinds
        if k == 1:
            shared = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])
            assert all(i == c for i, (_, c) in shared.items())
        if k == 2:
            assert sum(n for _, n, _ in brute.substrings([(r.doc_id, r.text) for r in docs.collect()]).values()) < 0.02 * sum(len(brute.words(r.text)) for r in docs.collect())
    assert 0.5 * before < docs.select("doc_id").distinct().count() <= before and "ids" in docs.columns
    assert sum(n.startswith("op") for n in QUERIES) == 14 and set(ORACLES) <= set(QUERIES)
    assert p.run(spark, sf).count() == docs.count()
