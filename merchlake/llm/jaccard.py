"""N-gram Jaccard join by blocked products of the document by n-gram incidence matrix.

Documents of equal sets are one node. A set is cut into segments by ranges of its n-grams' hashes, one more segment than two
linked sets of such sizes may differ in n-grams, so linked sets have a segment in common (their
sizes bound the difference). A few spare segments more let all sets leave out their empty segments, which unrelated sets
would share. Nodes that share a segment form candidate clusters. Within a cluster the incidence
matrix is multiplied block by block: overlap counts add up over blocks of columns, and after each the pairs whose
count plus what is left cannot reach the bound of their sizes are discarded. A product returns only a
spanning forest of the links it finds, never the pairs. Clusters above BLOCK_ROWS nodes or BLOCK_GRAMS n-grams are cut into blocks of rows,
each pair of blocks a task of its own; before that they are narrowed to nodes that share an n-gram which is rare in the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm import common
from merchlake.llm.common import discard, identified, in_arrow, materialize, shuffle_width
from merchlake.llm.components import connected_components

N = 3
#: A block of the matrix: rows and n-grams that it holds at most (one row more if that alone has more), columns taken at a time.
BLOCK_ROWS, BLOCK_GRAMS, BLOCK_COLUMNS = 400, 1_000_000, 4096
#: A column that meets more than one pair in so many is multiplied densely; other columns by so many pairs at a time.
DENSE, SPARSE_PAIRS = 16, 1 << 20


def size_classes(most: int, num: int, den: int) -> np.ndarray:
    """Upper ends of the classes of set sizes: sizes that may link lie in one class or two neighbouring ones."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return np.array(ends)


def shingle_sets(col: pa.Array, n: int):
    """Sorted distinct hashes of each text's n-word shingles, end to end, and where each text's begin."""
    data, off = common.utf8(col)
    data = common.LOWER[data]
    starts, ends, first = common.word_bounds(data, off)
    words = common.span_hashes(data, starts, ends)
    row = common.row_of(first)
    shingles = common.window_hashes(words, n)
    whole = np.flatnonzero(row[: len(shingles)] == row[n - 1 :]) if len(shingles) else np.zeros(0, np.int64)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))  # fewer words than a shingle: the whole sequence is one
    h, r = [shingles[whole]], [row[whole]]
    for k in range(1, n):
        rows = short[counts[short] == k]
        if len(rows):
            at = first[rows]
            total = np.full(len(rows), k, np.uint64)
            for j in range(k):
                total = common.mix(total) + words[at + j]
            h.append(common.mix(total))
            r.append(rows)
    h, r = np.concatenate(h), np.concatenate(r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(len(off)))


def _signatures(n: int, num: int, den: int):
    slack_num, slack_den = den - num, den + num  # linked sets differ in at most (a + b) * slack of their n-grams

    def run(batches):
        for batch in common.slices(batches):
            h, first = shingle_sets(batch.column(2), n)
            sizes = np.diff(first)
            ends = size_classes(int(sizes.max(initial=1)) * den // num + 1, num, den)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h), dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h ^ common._P), dtype=np.uint64)])
            prints = [common.mix((t[first[1:]] - t[first[:-1]]) + sizes.astype(np.uint64)) for t in (total, other)]
            low, high = np.searchsorted(ends, sizes), np.searchsorted(ends, np.maximum(sizes * den // num, sizes))
            row = common.row_of(first)
            signs = [[] for _ in sizes]
            for step in (0, 1):
                rows = np.flatnonzero((sizes > 0) & (low + step <= high))
                if not len(rows):
                    continue
                cls = (low + step)[rows]
                segments = 2 * ends[cls] * slack_num // slack_den + 1
                # `spare` more of them agree; a set with no more empty segments than that needs not sign those
                spare = 2 + segments * slack_num // slack_den
                segments += spare
                base = np.cumsum(segments) - segments
                wide = np.zeros(len(sizes), np.int64)
                wide[rows] = segments
                start = np.full(len(sizes), -1, np.int64)
                start[rows] = base
                mine = np.flatnonzero(start[row] >= 0)
                place = start[row[mine]] + ((h[mine] >> np.uint64(32)) * wide[row[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(place, np.arange(segments.sum() + 1))
                at = np.append(mine, len(h))  # places go up with rows and hashes; the last is the end of the slice
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h[mine]), dtype=np.uint64)]) if len(at) else total
                value = sums[cuts[1:]] - sums[cuts[:-1]]
                salt = np.repeat(cls, segments).astype(np.uint64) * np.uint64(1 << 20) + (np.arange(segments.sum()) - np.repeat(base, segments)).astype(np.uint64)
                value = common.mix(value + common.mix(salt + np.diff(cuts).astype(np.uint64) * common._P)).view(np.int64)
                blank = np.diff(cuts) == 0
                blanks = np.add.reduceat(blank.astype(np.int64), base)
                signed = ~blank | np.repeat(blanks > spare, segments)
                for r, part, use in zip(rows, np.split(value, base[1:]), np.split(signed, base[1:])):
                    signs[r].append(part[use])
            signs = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in signs]
            counts = np.array([len(s) for s in signs])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(signs) if len(signs) else np.zeros(0, np.int64)))],
                names=["__row", "doc_id", "n_shingles", "print", "check", "signs"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in common.slices(batches):
            h, first = shingle_sets(batch.column(batch.schema.get_field_index("text")), n)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            k = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != k), sets], names=[*(x for x in batch.schema.names if x != "text"), "grams"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int):
    """(i, j) of the pairs with |A and B| * den >= |A or B| * num, by a sparse product over blocks of columns (right None: left with itself).

    A column that only one side or one row holds has no part in the product. Columns of few entries are multiplied entry
    by entry, those that many rows hold as a dense block.
    """
    sides = (left, left if right is None else right)
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    need = num / (num + den) * (sizes[0][:, None] + sizes[1][None, :]) - 1e-3  # in whole numbers, checked exactly below
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *left, *(right or [])]), return_inverse=True)
    cut, wide = int(sizes[0].sum()), int(inverse.max(initial=-1)) + 1
    at = [inverse[:cut], inverse[:cut] if right is None else inverse[cut:]]
    held = [np.bincount(c, minlength=wide) for c in at]
    work = held[0] * held[1]
    shared = work > 1 if right is None else work > 0
    # columns by the work they make: the light ones first, so that the dense blocks meet fewer pairs
    columns = np.flatnonzero(shared)
    columns = columns[np.argsort(work[columns], kind="stable")]
    number = np.full(wide, -1)
    number[columns] = np.arange(len(columns))
    work = work[columns]
    entries = []
    for c, size in zip(at, sizes):
        r, c = np.repeat(np.arange(len(size)), size), number[c]
        r, c = r[c >= 0], c[c >= 0]
        by = np.argsort(c, kind="stable")
        entries.append((r[by], c[by]))
    begin = [np.searchsorted(c, np.arange(len(columns) + 1)) for _, c in entries]
    rest = [np.bincount(r, minlength=len(size)) for (r, _), size in zip(entries, sizes)]
    count = np.zeros(need.shape, np.float32)
    alive = [np.arange(len(size)) for size in sizes]
    light = int(np.searchsorted(work, max(2, need.size // DENSE)))
    cuts, done = [0], np.concatenate([[0], np.cumsum(work)])
    while cuts[-1] < len(columns):
        x = cuts[-1]
        y = int(np.searchsorted(done, done[x] + SPARSE_PAIRS, "right")) - 1 if x < light else x + BLOCK_COLUMNS
        cuts.append(min(max(x + 1, y), light if x < light else len(columns)))
    for x, y in zip(cuts, cuts[1:]):
        (i, c), (j, _) = ((e[0][b[x] : b[y]], e[1][b[x] : b[y]]) for e, b in zip(entries, begin))
        if y <= light:
            partners = begin[1][c + 1] - begin[1][c]
            first = np.cumsum(partners) - partners
            pick = np.arange(int(partners.sum())) + np.repeat(begin[1][c] - begin[1][x] - first, partners)
            count += np.bincount(np.repeat(i, partners) * need.shape[1] + j[pick], minlength=need.size).reshape(need.shape)
        else:
            block = [np.zeros((len(size), y - x), np.float32) for size in sizes]
            for m, (r, c), b in zip(block, entries, begin):
                m[r[b[x] : b[y]], c[b[x] : b[y]] - x] = 1
            count[np.ix_(*alive)] += block[0][alive[0]] @ block[1][alive[1]].T
        rest = [n - np.bincount(r, minlength=len(n)) for n, r in zip(rest, (i, j))]
        # a pair lives while its count and the lesser of what is left of both reach the bound
        ok = count[np.ix_(*alive)] + np.minimum(rest[0][alive[0]][:, None], rest[1][alive[1]][None, :]) >= need[np.ix_(*alive)]
        alive = [alive[0][ok.any(1)], alive[1][ok.any(0)]]
        if not len(alive[0]):
            return none
    i, j = np.nonzero(count[np.ix_(*alive)] >= need[np.ix_(*alive)])
    i, j = alive[0][i], alive[1][j]
    both = np.where((i == j) & (right is None), sizes[0][i], count[i, j].astype(np.int64))
    exact = den * both >= num * (sizes[0][i] + sizes[1][j] - both)
    return i[exact], j[exact]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n items by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        root = new[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, cuts = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _product(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        cluster, side, node = (table.column(c).to_numpy() for c in ("cluster", "side", "node"))
        grams = _lists(table.column("grams"))
        order = np.lexsort((node, side, cluster))
        made = [], []
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            halves = [part[side[part] == s] for s in (0, 1)]
            sets = [[grams[k] for k in half] for half in halves]
            i, j = overlaps(sets[0], sets[1] or None, num, den)
            j = j + len(halves[0]) * bool(sets[1])
            nodes = node[np.concatenate(halves)]
            root = forest(len(nodes), i, j)
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            made[0].append(nodes[moved])
            made[1].append(nodes[root[moved]])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for k, v in zip("ab", made)})

    return run


def _blocks(rows, grams):
    """Column: number of blocks for so many rows and grams."""
    return F.ceil(F.greatest(F.coalesce(rows, F.lit(0)) / BLOCK_ROWS, F.coalesce(grams, F.lit(0)) / BLOCK_GRAMS)).cast("int")


def _narrowed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Clusters (node, root) within those of sets(cluster, node, grams): nodes that share one of their first n-grams, rare ones first.

    Of n n-grams at least n * num / den are shared with whatever links, so linked sets meet in their first n - ceil(n * num / den) + 1, in any order
    that is one for the whole cluster. In order of how many nodes of the cluster hold them, those of a passage that many unrelated documents have come last.
    """
    each = sets.select("cluster", "node", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    counts = materialize(each.groupBy("cluster", "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-shared")
    # n-grams of one node alone come first of all and meet nothing
    held = each.join(counts, ["cluster", "g"]).groupBy("cluster", "node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "g"))).alias("s"))
    first = held.withColumn("first", F.expr(f"size(s) - ((n * {num} + {den} - 1) div {den}) + 1").cast("int")).where("first > 0")
    signs = materialize(first.select("cluster", "node", F.explode(F.slice("s", F.lit(1), F.col("first"))).alias("x")).select("cluster", "node", "x.g"), "jaccard-prefixes")
    pivots = signs.groupBy("cluster", "g").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pivots = materialize(pivots.select("cluster", "g", "b"), "jaccard-pivots")  # a plain shuffle for the join
    near = materialize(signs.join(pivots, ["cluster", "g"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "jaccard-near")
    discard(counts, signs, pivots)
    found = materialize(connected_components(near, "jaccard-narrow"), "jaccard-narrow")
    discard(near)
    return found


def _large_tasks(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of sets(cluster, node, grams) the rows of the products that are needed (task, cluster, side, node, grams), and the links to pivots.

    A pivot is multiplied with its cluster first. What links to it need not be compared among itself.
    """
    held = sets.select("cluster", "node", F.explode("grams").alias("g")).groupBy("cluster", "g").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    alone = held.where("c = 1").groupBy("cluster", "node").agg(F.count(F.lit(1)).alias("alone"))
    known = sets.select("cluster", "node", F.size("grams").alias("n")).join(alone, ["cluster", "node"], "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    known = materialize(known, "jaccard-known")
    pivots = known.groupBy("cluster").agg(F.min_by("node", F.struct("alone", "node")).alias("pivot"), F.min("n").alias("smallest"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    # the least overlap that links to the smallest partner there may be
    able = (num + den) * (F.col("n") - F.col("alone")) >= num * (F.col("n") + F.greatest(F.col("smallest"), F.ceil(F.col("n") * num / den)))
    left = known.join(pivots, "cluster").where(able).select("node", "n", "pivot", "blocks")
    kept = materialize(left.join(sets.select("cluster", "node", "grams"), "node"), "jaccard-kept")
    members = kept.where("node <> pivot").select(F.xxhash64("cluster", F.pmod(F.xxhash64("node"), "blocks").cast("int")).alias("task"), "cluster", F.lit(1).alias("side"), "node", "grams")
    center = kept.where("node = pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    center = center.select(F.xxhash64("cluster", "block").alias("task"), "cluster", F.lit(0).alias("side"), "node", "grams")
    star = materialize(center.unionByName(members).groupBy("task").applyInArrow(_product(num, den), "a long, b long"), "jaccard-star")
    near = star.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("near", F.lit(True))
    joined = kept.join(near, "node", "left").withColumn("near", F.coalesce("near", F.col("node") == F.col("pivot")))
    sums = [_blocks(F.count_if(x), F.sum(F.when(x, F.col("n")))).alias(name) for name, x in (("nears", F.col("near")), ("fars", ~F.col("near")))]
    blocks = joined.drop("blocks").join(joined.groupBy("cluster").agg(*sums), "cluster").where("fars > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))).cast("int")
    blocks = blocks.withColumn("own", own)

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def pair(i, j, kind, side):
        return F.struct(F.xxhash64(F.lit(kind), F.col("cluster"), i, j).alias("task"), side.alias("side"))

    mine = F.col("own")
    far_near = F.transform(upto(F.col("nears")), lambda j: pair(mine, j, "near", F.lit(0)))
    far_far = F.transform(upto(F.col("fars")), lambda j: pair(F.least(mine, j), F.greatest(mine, j), "far", F.when(mine <= j, 0).otherwise(1)))
    near_far = F.transform(upto(F.col("fars")), lambda i: pair(i, mine, "near", F.lit(1)))
    tasks = blocks.withColumn("t", F.explode(F.when(F.col("near"), near_far).otherwise(F.concat(far_near, far_far))))
    return tasks.select("t.task", "cluster", "t.side", "node", "grams"), star


def jaccard_components(docs: DataFrame, n: int = N, num: int = 90, den: int = 100, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text), and __row, __first (the row that stays).

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+; a set holds a text's distinct n-word shingles (with fewer words
    the whole sequence as one; null and blank texts: nothing, linked with nothing). Rows link when den * |A and B| >= num *
    |A or B|. component_id is the smallest doc_id reachable (a null doc_id only where there is no other); repeated rows
    link like any others. __first marks one row of each component: of least doc_id, then of least __row. Sets are told apart by
    two 64-bit sums of their scrambled shingles together. Other columns are ignored; an empty table gives no rows. rows: what `identified`
    made of docs, if it is at hand.
    """
    rows = identified(docs, "jaccard-rows") if rows is None else rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = in_arrow(rows.select("__row", "doc_id", "text"), _signatures(n, num, den), f"__row long, doc_id {kind}, n_shingles long, print long, check long, signs array<bigint>")
    full = materialize(signed, "jaccard-signs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("__row").alias("row")))
    nodes = full.where("n_shingles > 0").groupBy("print", "check").agg(least.alias("least"), F.first("signs").alias("signs"), F.min("n_shingles").alias("n"))
    lists = materialize(nodes.withColumn("node", F.col("least.row")), "jaccard-lists")
    # the signatures are the bulk of all: each step is written, so that no two shuffles of them stand on disk at once
    signed, nodes = materialize(full.drop("signs"), "jaccard-rows"), materialize(lists.drop("signs"), "jaccard-nodes")
    discard(full)
    flat = lists.select("node", F.explode("signs").alias("sign"))
    pivots = materialize(flat.groupBy("sign").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sign", "b"), "jaccard-pivots")
    near = materialize(flat.join(pivots, "sign").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "jaccard-near")
    discard(lists, pivots)
    clusters = materialize(connected_components(near, "jaccard-clusters"), "jaccard-clusters")
    discard(near)
    sized = clusters.join(nodes.select("node", "n"), "node")
    sizes = sized.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams"))
    placed = clusters.join(sizes.select("root", ((F.col("size") > BLOCK_ROWS) | (F.col("grams") > BLOCK_GRAMS)).alias("large")), "root")
    wanted = placed.select(F.col("node").alias("__row"), F.col("root").alias("cluster"), "large")
    texts = rows.select("__row", "text").join(wanted, "__row").select("cluster", "large", F.col("__row").alias("node"), "text")
    sets = materialize(in_arrow(texts, _sets(n), "cluster long, large boolean, node long, grams array<bigint>"), "jaccard-sets")
    small, large = sets.where("not large").drop("large"), sets.where("large").drop("large")
    if large.limit(1).count():
        inner = _narrowed(large, num, den)
        sized = large.select("node", "grams").join(inner, "node").withColumnRenamed("root", "cluster")
        sizes = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("grams")).alias("total"))
        sized = sized.join(sizes.select("cluster", ((F.col("size") > BLOCK_ROWS) | (F.col("total") > BLOCK_GRAMS)).alias("large")), "cluster")
        narrow = materialize(sized.select("cluster", "node", "grams", "large"), "jaccard-narrowed")
        small, large = small.unionByName(narrow.where("not large").drop("large")), narrow.where("large").drop("large")
    # small clusters share a task
    grams = small.agg(F.sum(F.size("grams"))).first()[0] or 0
    spread = F.lit(max(shuffle_width(docs.sparkSession), -(-grams // BLOCK_GRAMS)))
    small = small.select(F.pmod(F.xxhash64("cluster"), spread).alias("task"), "cluster", F.lit(0).alias("side"), "node", "grams")
    tasks, star = _large_tasks(large, num, den)
    links = small.unionByName(tasks).groupBy("task").applyInArrow(_product(num, den), "a long, b long").unionByName(star)
    links = materialize(links, "jaccard-links")
    discard(sets, star)
    found = materialize(connected_components(links, "jaccard-links"), "jaccard-found")
    discard(links, clusters)
    named = nodes.join(found, "node", "left").select("print", "check", F.coalesce("root", "node").alias("root"), "least")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(first, "root").select(F.col("print").alias("__print"), F.col("check").alias("__check"), "first")
    joined = signed.join(named, (F.col("print") == F.col("__print")) & (F.col("check") == F.col("__check")) & (F.col("n_shingles") > 0), "left")
    alone = F.col("first").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc")).alias("component_id"), "__row", (alone | (F.col("__row") == F.col("first.row"))).alias("__first"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The row of each component of jaccard_components(docs) that comes first; columns as in docs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = identified(docs, "jaccard-rows", others)
    first = jaccard_components(docs, rows=rows, **options).where("__first").select("__row")
    kept = rows.join(first, "__row", "left_semi")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"__keep_{c}").alias(c) for c in docs.columns])


#: The same rows in DuckDB: overlaps by a join on shingles, reachability by recursion.
JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS grams
  FROM texts),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.least, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
