"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors of a label are one node; the nodes of a label (and length) are a group. A group above `leaf` nodes is split by
several trees, each a recursion of random splits: a level has a random direction, a tree node a cut near the middle of its
projections, and vectors next to the cut go to both sides. A round of Spark splits all open groups by up to LEVELS levels: cuts are
fitted on a sample of each group, and every group is dealt to as many tasks as its rows need. What is still
above `leaf` is a group of the next round, so leaves are bounded whatever the label's size. A group that is one dense
cluster is not split, as most of its pairs link: it is compared whole, in pairs of blocks.

Nodes are compared only within leaves, in double precision. A pair that shares several leaves counts in the first of
them, which the leaves' lists on both sides tell, so a leaf returns sums and a spanning forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import discard, materialize, shuffle_width
from merchlake.llm.components import connected_components
from merchlake.llm.jaccard import forest

#: Trees, nodes that a leaf holds at most, and the share of a tree node's sample on each side of a cut that goes to both sides.
TREES, LEAF, SPILL = 8, 500, 0.04
#: Levels of a round, rows that a group's cuts are fitted on, rows of a group that a task routes.
LEVELS, SAMPLE, ROUTE_ROWS = 6, 4096, 20_000
#: A group with more than this share of linking pairs in its sample is dense.
DENSE = 0.05


def _vectors(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, of norm 1."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    data = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def _directions(seed: int, depth: int, width: int) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=(depth, width))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def fit_tree(data: np.ndarray, depth: int, seed: int, spill: float) -> np.ndarray:
    """(lowest, highest) projection that goes to both sides, by tree node in heap order."""
    p = data @ _directions(seed, depth, data.shape[1]).T
    rng = np.random.default_rng(seed + 1)
    cuts = np.zeros((2**depth - 1, 2))
    members = {0: np.arange(len(data))}
    for k in range(2**depth - 1):
        level, at = (k + 1).bit_length() - 1, members.pop(k)
        if len(at):
            share = rng.uniform(0.45, 0.55)  # a random split near the middle keeps trees apart
            cuts[k] = np.quantile(p[at, level], [share - spill, share + spill])
        if level + 1 < depth:
            members[2 * k + 1], members[2 * k + 2] = (at[side] for side in _sides(p[at, level], *cuts[k]))
    return cuts


def _sides(p, low, high):
    """Which go left and which go right; where low and high are one, none goes to both."""
    left = p <= high
    return left, (p > low) | ~left


def leaves_of(data: np.ndarray, cuts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row comes to."""
    depth = (len(cuts) + 1).bit_length() - 1
    p = data @ _directions(seed, depth, data.shape[1]).T
    row, at = np.arange(len(data)), np.zeros(len(data), np.int64)
    for level in range(depth):
        left, right = _sides(p[row, level], cuts[at, 0], cuts[at, 1])
        row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return row, at - len(cuts)


def _fit(least: float, leaf: int, spill: float):
    """Trees of a group from its sample. Columns: gid, key, total, trees, embedding."""

    def run(table: pa.Table) -> pa.Table:
        gid, key, total, trees = (table.column(c)[0].as_py() for c in ("gid", "key", "total", "trees"))
        data = _vectors(table.column("embedding"))
        some = data[:512]
        close = (some @ some.T >= least).sum() - len(some)
        depth = min(LEVELS, int(np.ceil(np.log2(total / leaf))))
        out = {"seed": [], "cuts": []}
        if close <= DENSE * len(some) * (len(some) - 1):
            rng = np.random.default_rng(key & (2**63 - 1))
            out["seed"] = rng.integers(0, 2**62, trees).tolist()
            out["cuts"] = [fit_tree(data, depth, s, spill).ravel().tolist() for s in out["seed"]]
        n = len(out["seed"])
        return pa.table({"gid": pa.array([gid] * n, pa.int64()), "key": pa.array([key] * n, pa.int64()), "total": pa.array([total] * n, pa.int64()), "seed": pa.array(out["seed"], pa.int64()), "cuts": pa.array(out["cuts"], pa.list_(pa.float64()))})

    return run


def _child_keys(key: int, seeds: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    from merchlake.llm.common import mix

    return mix(mix(np.uint64(key % 2**64) + seeds.astype(np.uint64)) + leaves.astype(np.uint64)).view(np.int64)


def _route(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part of a group's rows to the leaves of its trees."""
    node, key, out = left.column("node").to_numpy(), left.column("key"), ([], [])
    if left.num_rows:
        data = _vectors(left.column("embedding"))
        for seed, cuts in zip(right.column("seed").to_pylist(), right.column("cuts").to_pylist()):
            row, leaf = leaves_of(data, np.array(cuts).reshape(-1, 2), seed)
            out[0].append(row)
            out[1].append(_child_keys(key[0].as_py(), np.full(len(row), seed), leaf))
    row = np.concatenate([np.zeros(0, np.int64), *out[0]])
    return pa.table({"node": pa.array(node[row], pa.int64()), "gid": left.column("gid").take(pa.array(row)), "key": pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]])), "embedding": left.column("embedding").take(pa.array(row))})


def _compare(least: float):
    """Sums of links and a spanning forest of a task's leaves (or pairs of blocks of a leaf)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("gid", "ascending"), ("key", "ascending"), ("side", "ascending"), ("node", "ascending")])
        task, gid, side, node, many = (table.column(c).to_numpy() for c in ("task", "gid", "side", "node", "many"))
        embedding, leaves, key = table.column("embedding").combine_chunks(), table.column("leaves").combine_chunks(), table.column("key").to_numpy()
        flat, begin = leaves.flatten().to_numpy(), leaves.offsets.to_numpy()
        made = {"node": [], "links": [], "root": []}
        for part in np.split(np.arange(len(task)), np.flatnonzero((np.diff(task) != 0) | (np.diff(gid) != 0) | (np.diff(key) != 0)) + 1):
            a, b = part[0], part[-1] + 1
            if b - a < 2 or side[a] == side[b - 1] != 2:  # one side of a pair of blocks only
                continue
            vectors = _vectors(embedding.slice(a, b - a))
            # leaves before this one
            own = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
            earlier = flat[begin[a] : begin[b]]
            before = earlier < key[a]
            columns, inverse = np.unique(earlier[before], return_inverse=True)
            seen = np.zeros((b - a, max(1, len(columns))), np.float32)
            seen[own[before], inverse] = 1
            cut = int((side[a:b] != 1).sum())
            other = np.arange(cut, b - a) if cut < b - a else np.arange(b - a)
            links, ends = np.zeros(b - a, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for x in range(0, cut, 1024):
                mine = np.arange(x, min(cut, x + 1024))
                close = (vectors[mine] @ vectors[other].T >= least) & (mine[:, None] != other)
                i, j = np.nonzero(close)
                ok = (seen[mine[i]] * seen[other[j]]).sum(1) == 0 if len(i) < 50_000 else ~(seen[mine] @ seen[other].T > 0)[i, j]
                i, j = mine[i[ok]], other[j[ok]]
                np.add.at(links, i, many[a:b][j])
                if cut < b - a:
                    np.add.at(links, j, many[a:b][i])
                ends.append((i, j))
            root = forest(b - a, *(np.concatenate(e) for e in zip(*ends)))
            some = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
            for k, v in zip(made, (node[a:b][some], links[some], node[a:b][root[some]])):
                made[k].append(v)
        return pa.table({k: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for k, v in made.items()})

    return run


def forest_leaves(nodes: DataFrame, least: float, leaf: int = LEAF, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """(node, gid, key) for every leaf that a row of nodes(node, gid, embedding) comes to; gid is the group, of one label and length.

    Leaves hold `leaf` nodes at most, but for dense groups and for such as no split makes smaller.
    """
    placed, done, round_ = materialize(nodes.select("node", "gid", F.col("gid").alias("key"), "embedding"), "embedding-placed"), [], 0
    before = None
    while True:
        counts = placed.groupBy("gid", "key").agg(F.count(F.lit(1)).alias("total"))
        open_ = counts.where(F.col("total") > leaf)
        if before is not None:  # only children that are smaller than what they came from
            open_ = open_.where(F.col("total") < 0.9 * before)
        largest = open_.agg(F.max("total")).first()[0]
        if largest is None:
            return reduce_union([*done, placed.select("node", "gid", "key")])
        sampled = placed.join(open_, ["gid", "key"]).where(F.pmod(F.xxhash64("node", "key"), F.lit(1 << 20)) < F.ceil(F.lit(SAMPLE << 20) / F.col("total")))
        sampled = sampled.withColumn("trees", F.lit(trees if round_ == 0 else 1))
        fitted = materialize(sampled.groupBy("gid", "key").applyInArrow(_fit(least, leaf, spill), "gid long, key long, total long, seed long, cuts array<double>"), "embedding-trees")
        split = fitted.select("gid", "key", "total").distinct().withColumn("parts", F.ceil(F.col("total") / ROUTE_ROWS).cast("int"))
        done.append(placed.join(split.select("gid", "key"), ["gid", "key"], "left_anti").select("node", "gid", "key"))
        rows = placed.join(split.select("gid", "key", "parts"), ["gid", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        planted = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / ROUTE_ROWS).cast("int") - 1)))
        kind = placed.schema["embedding"].dataType.simpleString()
        routed = rows.groupBy("gid", "key", "part").cogroup(planted.groupBy("gid", "key", "part")).applyInArrow(_route, f"node long, gid long, key long, embedding {kind}")
        placed, before, round_ = materialize(routed, "embedding-placed"), largest, round_ + 1


def reduce_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def near_duplicates(table: DataFrame, least: float = 0.93, leaf: int = LEAF, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table(vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is `least` or more. Vectors that are null, empty or zero, hold null or
    non-finite numbers or have no label link with nothing; vectors of other lengths are never alike. n_links counts the linked
    rows, copies and repeated rows too. component_id is the smallest vec_id reachable, kept tells whether
    it is the row's own (a null vec_id: only if alone). Links are found with high recall, none below `least`; groups of up to `leaf`
    different vectors are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    sane = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(sane, F.lit(False)) & F.col("label").isNotNull()
    rows = table.select("vec_id", "label", "embedding").withColumn("good", good)
    # a node is named by the place of one of its rows, so no two of them are alike
    numbered = rows.where("good").withColumn("row", F.monotonically_increasing_id())
    nodes = numbered.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"), F.min("row").alias("node"))
    nodes = materialize(nodes, "embedding-nodes")
    length = F.size("embedding")
    groups = nodes.groupBy("label", length.alias("length")).agg(F.min("node").alias("gid"))
    grouped = nodes.select("node", "label", length.alias("length"), "embedding").join(groups, ["label", "length"]).select("node", "gid", "embedding")
    leaves = materialize(forest_leaves(grouped, least, leaf, trees, spill), "embedding-leaves")
    lists = leaves.groupBy("node").agg(F.collect_list("key").alias("leaves"))  # a bounded number for each vector
    sizes = leaves.groupBy("gid", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.when(F.col("size") > 2 * leaf, F.ceil(F.col("size") / leaf)).otherwise(1).cast("int"))
    dealt = leaves.join(sizes, ["gid", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    own = F.col("own")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("t", F.explode(pairs)).select("node", "gid", "key", F.xxhash64("gid", "key", "t.i", "t.j").alias("task"), "t.side")
    volume = leaves.count()
    parts = max(shuffle_width(table.sparkSession), -(-volume // (4 * leaf)))  # small leaves share a group
    full = dealt.join(nodes.select("node", "many", "embedding").join(lists, "node"), "node").withColumn("group", F.pmod(F.xxhash64("task"), F.lit(parts)))
    # a task holds vectors of one length only
    found = full.withColumn("length", length).groupBy("group", "length").applyInArrow(_compare(least), "node long, links long, root long")
    found = materialize(found, "embedding-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = materialize(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "embedding-links"), "embedding-roots")
    discard(leaves)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(lowest, "root").join(counts, "node", "left")
    named = named.select(F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), "component", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("__links"))
    joined = rows.join(named, F.col("good") & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same rows in DuckDB: every pair of a label compared; it is what the forest's recall is held against.
EMBEDDINGS_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
