"""Substring dedup by de Bruijn compaction.

Each window of k words is an edge between its first and its last k-1 words. Consecutive windows of a text that have one anchor (the
least hash of their GRAM-word strings) are cut out as a piece, a path of edges that is sent as one row. Anchors that only one document has
hold no repeated edge and go. Equal pieces are one; where an anchor has several different pieces their edges are told apart.
Then Spark builds the graph of the repeated edges: degrees of the nodes by aggregation, runs of edges that follow each other in their source
over nodes that do not branch, and the runs joined over such nodes by pointer doubling, which gives every edge its place on a path. Where a document holds
edges of one path in sequence, it repeats a stretch of the path; the path's rows say where the words of that stretch stand first. Every span is held
against those coordinates, word by word, in the join with the texts; windows of a span that differs from its source (two windows share a 64-bit
hash) are looked up by their words in all texts.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm import common
from merchlake.llm.common import discard, identified, in_arrow, materialize

K, GRAM = 13, 4
#: Hashes of unsettled windows that go to all tasks at a time.
LOOKUP_HASHES = 500_000

def _windows(batch: pa.RecordBatch, k: int, bits: int):
    """Hash, row of the batch and place of each window of k words of one text; column 2 holds the texts."""
    data, off = common.utf8(batch.column(2))
    starts, ends, first = common.word_bounds(data, off)
    hashes = common.window_hashes(common.span_hashes(data, starts, ends), k)
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = common.row_of(first)
    whole = np.flatnonzero(of[: len(hashes)] == of[k - 1 :])
    return hashes[whole] & np.uint64(2**64 - 2 ** (64 - bits)), of[whole], whole - first[of[whole]]


def _pieces(k: int):
    """Pieces of texts. Columns: row, ord, text."""

    def run(batches):
        for batch in common.slices(batches):
            data, off = common.utf8(batch.column(2))
            starts, ends, first = common.word_bounds(data, off)
            words = common.span_hashes(data, starts, ends)
            gram = min(GRAM, k)
            anchor, of, at, n, _ = common.anchored(common.window_hashes(words, gram), first, k, gram)
            piece = common.sequence_hashes(words, at, at + n + k - 1)
            rows, orders = (np.asarray(batch.column(i), np.int64)[of] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor.view(np.int64), piece.view(np.int64), rows, orders, (at - first[of]).astype(np.int32), n.astype(np.int32))], names=["anchor", "piece", "row", "ord", "start", "n"])

    return run


_EDGE = ("piece", "off", "n", "edge", "head", "tail", "row", "at")


def _edges(k: int, bits: int):
    """Edges of pieces at their sources: a piece that is alone at its anchor is one compacted edge. Columns: row, text, pieces."""

    def run(batches):
        mask = np.uint64(2**64 - 2 ** (64 - bits))
        for batch in common.slices(batches):
            data, off = common.utf8(batch.column(1))
            starts, ends, first = common.word_bounds(data, off)
            words = common.span_hashes(data, starts, ends)
            windows, nodes = common.window_hashes(words, k) & mask, common.window_hashes(words, max(1, k - 1))
            lists = batch.column(2)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            piece, start, n, alone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("piece", "start", "n", "alone"))
            count = np.where(alone, 1, n).astype(np.int64)
            source = np.repeat(np.arange(len(piece)), count)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(alone, n, 1)[source].astype(np.int64)
            at = start[source] + step
            here = first[owner[source]] + at
            # two pieces that share a hash are told apart later, so an edge alone needs no more than its piece's hash
            edge = np.where(alone[source], piece[source], windows[here].view(np.int64))
            row = np.asarray(batch.column(0), np.int64)[owner[source]]
            made = (piece[source], step.astype(np.int32), length.astype(np.int32), edge, nodes[here].view(np.int64), nodes[here + length].view(np.int64), row, at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=list(_EDGE))

    return run


_CHECK = pa.struct([("row", pa.int64()), ("start", pa.int32()), ("src", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
_CHECK_SQL = "array<struct<row:bigint,start:int,src:bigint,at:int,n:int,digest:binary>>"


def _digest(words) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _remove(k: int, with_text: bool):
    """Words not covered by a path, and digests of the words of every path at both its ends. Columns: row, doc_id, text, spans, others."""

    def run(batches):
        for batch in common.slices(batches):
            out = []
            for row, doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = (text or "").encode().split()
                gone, checks = [], []
                for s in spans or ():
                    # as a target the path stands at start, as a source at its own coordinates
                    here = s["start"] if s["target"] else s["at"]
                    if s["src"] is not None:
                        checks.append({**{c: s[c] for c in ("src", "at", "n")}, "row": row if s["target"] else None, "start": s["start"], "digest": _digest(words[here : here + s["n"] + k - 1])})
                    if s["target"]:
                        gone.append((here, here + s["n"] + k - 1))
                kept, at = [], 0
                for a, b in sorted(gone):
                    kept += words[at : max(at, a)]
                    at = max(at, b)
                kept += words[at:]
                left = b" ".join(kept)
                out.append((row, doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), *([left.decode() if gone else text] if with_text else []), checks))
            names = ["__row", "doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []), "checks"]
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else []), pa.list_(_CHECK)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), kinds)), *batch.columns[4:]], names=[*names, *batch.schema.names[4:]])

    return run


def _spell(k: int, bits: int):
    """Hash and digest of each window of the unsettled paths. Columns: row, ord, text, spans."""

    def run(batches):
        for batch in common.slices(batches):
            hashes, of, pos = _windows(batch, k, bits)
            by = {(int(r), int(p)): int(h) for h, r, p in zip(hashes.view(np.int64), of, pos)}
            out = []
            for i, (row, order, text, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                words = (text or "").encode().split()
                out += [(row, order, p, by[i, p], _digest(words[p : p + k])) for s in spans for p in range(s["start"], s["start"] + s["n"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["row", "ord", "pos", "hash", "digest"])

    return run


def _find(shared, k: int, bits: int):
    """Digest and order of every window whose hash is asked for. Columns: row, ord, text."""

    def run(batches):
        wanted = np.sort(np.array(shared.value, np.int64))
        for batch in common.slices(batches):
            hashes, of, pos = _windows(batch, k, bits)
            hit = np.flatnonzero(np.isin(hashes.view(np.int64), wanted))
            text, orders, words = batch.column(2), batch.column(1).to_pylist(), {}
            out = []
            for i, p in zip(of[hit].tolist(), pos[hit].tolist()):
                if i not in words:
                    words = {i: text[i].as_py().encode().split()}  # hits come row by row
                out.append((_digest(words[i][p : p + k]), orders[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 2, (pa.binary(), pa.int64()))], names=["digest", "ord"])

    return run


def _compacted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nonbranching paths of the graph of edges(edge, n, ord, head, tail, row, at): placed(edge, ord, path, pos) and runs(path, off, windows, ord, src, at).

    Edges that follow each other in their source over a node of one edge in and one out are a run (a window over the
    edges of one document). Runs that meet in such a node are one path: pointers to the run before are doubled, with the windows that lie between, in as many
    rounds as the logarithm of a path's runs. So an edge stands at a position of its path, counted in windows, and a path's rows tell
    which stretch of it has its words at which place of which document. A path is named by its first run.
    """
    ends = edges.select(F.col("tail").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")).unionByName(edges.select(F.col("head").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")))
    plain = ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).where("into = 1 AND out = 1").select(F.col("node").alias("head"), F.lit(True).alias("plain"))
    own = Window.partitionBy("row").orderBy("at")
    follows = F.coalesce(F.col("plain") & (F.lag(F.col("at") + F.col("n")).over(own) == F.col("at")), F.lit(False))
    marked = edges.join(plain, "head", "left").withColumn("__new", ~follows)
    begun = marked.withColumn("run", F.last(F.when(F.col("__new"), F.col("at")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    begun = materialize(begun.drop("__new"), "path-runs")
    name = F.struct("row", "run")
    runs = begun.groupBy("row", "run").agg(F.min_by("head", "at").alias("head"), F.min_by("plain", "at").alias("plain"), F.max_by("tail", "at").alias("tail"), F.sum("n").alias("windows"), F.min("ord").alias("ord"))
    runs = materialize(runs, "path-stretches")
    befores = runs.select(F.col("tail").alias("head"), name.alias("before"), F.col("windows").alias("dist"))
    left = materialize(runs.where("plain").select(name.alias("id"), "head").join(befores, "head").where("id <> before").select("id", "before", "dist"), "path-pointers")
    rounds, open_ = 0, left.count()
    while open_ and rounds < 40:  # what still moves then stands in a ring, which has no first run; each of its runs then is a path of its own
        jump = left.select(F.col("id").alias("before"), F.col("before").alias("further"), F.col("dist").alias("more"))
        step = left.join(jump, "before", "left").select("id", F.coalesce("further", "before").alias("before"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("further").isNotNull().alias("moved"))
        left, old = materialize(step, "path-pointers"), left
        discard(old)
        still = left.where("moved").count()
        left, rounds, open_ = left.drop("moved"), rounds + 1, still if still != open_ else 0
    roots = left.select(F.col("id.row").alias("row"), F.col("id.run").alias("run"), F.col("before").alias("root"), "dist")
    named = materialize(runs.join(roots, ["row", "run"], "left").select("row", "run", F.coalesce("root", name).alias("path"), F.coalesce("dist", F.lit(0)).alias("off"), "windows", "ord"), "path-named")
    discard(runs)
    placed = begun.select("edge", "row", "run", "at").join(named, ["row", "run"]).select("edge", "ord", "path", (F.col("off") + F.col("at") - F.col("run")).alias("pos"))
    return placed, named.select("path", "off", "windows", "ord", F.col("row").alias("src"), F.col("run").alias("at"))


def repeated_paths(rows: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """Spans of rows(__row, __ord, text): row, start, n edges, src row, at (the position there), path.

    Where a row holds edges of one path at positions that follow each other, that is a stretch of the path; the path's own rows, joined to it by path and
    position, tell in which row src of smaller __ord, and where there, the words of it stand. Every edge of a span also starts, by its hash, in src.
    """
    schema = "anchor long, piece long, row long, ord long, start int, n int"
    pieces = materialize(in_arrow(rows.select("__row", "__ord", "text"), _pieces(k), schema), "path-pieces")
    shared = pieces.groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "path-shared")  # so that the join reads two plain shuffles, whose skewed partitions Spark can split
    held = materialize(pieces.join(shared.hint("shuffle_hash"), "anchor", "left_semi"), "path-held")
    discard(pieces, shared)
    first = F.min(F.struct("ord", "row", "start")).alias("src")
    distinct = held.groupBy("piece").agg(first, F.max("ord").alias("hi"), F.min("anchor").alias("anchor"), F.min("n").alias("n"))
    distinct = materialize(distinct, "path-distinct")
    company = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("anchor", F.lit(True).alias("alone"))
    listed = distinct.join(company, "anchor", "left").groupBy(F.col("src.row").alias("__r")).agg(F.collect_list(F.struct("piece", F.col("src.start").alias("start"), "n", F.coalesce("alone", F.lit(False)).alias("alone"))).alias("pieces"))
    texts = rows.join(listed, rows["__row"] == listed["__r"]).select("__row", "text", "pieces")
    parts = materialize(in_arrow(texts, _edges(k, bits), "piece long, off int, n int, edge long, head long, tail long, row long, at int"), "path-parts")
    known = parts.join(distinct.select("piece", F.col("src.ord").alias("ord"), "hi"), "piece")
    edges = known.groupBy("edge").agg(F.min(F.struct("ord", "row", "at", "n", "head", "tail")).alias("e"), F.max("hi").alias("hi")).where("e.ord < hi")
    edges = materialize(edges.select("edge", "e.*"), "path-edges")
    placed, runs = _compacted(edges)
    placed = materialize(placed, "path-placed")
    # what each piece holds, a row for each of its few edges
    within = parts.select("piece", "off", "n", "edge").join(placed, "edge").groupBy("piece").agg(F.collect_list(F.struct("off", "n", "ord", "path", "pos")).alias("parts"))
    within = materialize(within, "path-within")  # a plain shuffle for the join, whose skewed partitions Spark can split
    found = held.select("piece", "row", "ord", "start").join(within, "piece").withColumn("p", F.explode(F.filter("parts", lambda p: p["ord"] < F.col("ord"))))
    steps = found.select("row", (F.col("start") + F.col("p.off")).alias("start"), F.col("p.n").alias("n"), F.col("p.path").alias("path"), F.col("p.pos").alias("pos"))
    own = Window.partitionBy("row").orderBy("start")
    goes_on = (F.lag(F.col("start") + F.col("n")).over(own) == F.col("start")) & (F.lag("path").over(own) == F.col("path")) & (F.lag(F.col("pos") + F.col("n")).over(own) == F.col("pos"))
    cut = steps.withColumn("__new", ~F.coalesce(goes_on, F.lit(False)))
    cut = cut.withColumn("__span", F.last(F.when(F.col("__new"), F.col("start")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = cut.groupBy("row", "__span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min_by("path", "start").alias("path"), F.min("pos").alias("pos"))
    stretches = materialize(stretches.drop("__span"), "path-found")
    first, last = F.greatest("pos", "off"), F.least(F.col("pos") + F.col("n"), F.col("off") + F.col("windows"))
    joined = stretches.join(runs.drop("ord"), "path").where((F.col("off") < F.col("pos") + F.col("n")) & (F.col("pos") < F.col("off") + F.col("windows")))
    spans = joined.select("row", (F.col("start") + first - F.col("pos")).cast("int").alias("start"), (last - first).cast("int").alias("n"), "src", (F.col("at") + first - F.col("off")).cast("int").alias("at"), "path")
    spans = materialize(spans, "paths")
    discard(held, distinct, parts, edges, placed, within, stretches)
    return spans


def _settle_by_words(rows: DataFrame, unsettled: DataFrame, k: int, bits: int) -> DataFrame:
    """(row, start, n = 1) of the windows of unsettled(row, start, n) that start in a row of smaller __ord, by their words."""
    spark = rows.sparkSession
    asked = unsettled.groupBy(F.col("row").alias("__r")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = rows.join(asked, rows["__row"] == asked["__r"]).select("__row", "__ord", "text", "spans")
    windows = materialize(in_arrow(texts, _spell(k, bits), "row long, ord long, pos int, hash long, digest binary"), "unsettled-windows")
    hashes = windows.select("hash").distinct()
    blocks = -(-hashes.count() // LOOKUP_HASHES)
    found = []
    for b in range(blocks):  # hashes that collide are few; in blocks they may be any number
        some = [r[0] for r in hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(some)
        first = in_arrow(rows.select("__row", "__ord", "text"), _find(shared, k, bits), "digest binary, ord long").groupBy("digest").agg(F.min("ord").alias("first"))
        found.append(materialize(windows.join(first, "digest").where("ord > first").select("row", F.col("pos").alias("start"), F.lit(1).alias("n")), "settled-windows"))
    return reduce(DataFrame.unionByName, found)


def dedup_substrings(docs: DataFrame, k: int = K, with_text: bool = False, keep: list[str] | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, if with_text) for every row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ (null or empty text: none). A word goes if a window of k words that covers it
    also starts in a row of smaller doc_id (null: after all others); rows of equal doc_id don't
    remove from one another. kept is the text as it is where nothing goes, else the kept words joined by spaces.
    Columns named in `keep` come along as __keep_<name>, others are ignored; an empty table gives no rows. bits: of a
    window's hash; with fewer, more windows are settled by their words.
    """
    rows = identified(docs, "substring-rows", keep or [])
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [f"__keep_{c}" for c in keep or []]
    types = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in more)
    kind = f"__row long, doc_id {kind}, n_words long, n_removed long, kept_sha256 string, {'kept string,' if with_text else ''} checks {_CHECK_SQL}{types}"

    def removed(rows: DataFrame, spans: DataFrame) -> DataFrame:
        listed = spans.groupBy("__r").agg(F.collect_list("s").alias("spans"))
        joined = rows.join(listed, rows["__row"] == listed["__r"], "left").select("__row", "doc_id", "text", "spans", *more)
        return in_arrow(joined, _remove(k, with_text), kind)

    paths = repeated_paths(rows, k, bits)
    ends = paths.select(F.col("row").alias("__r"), F.struct(F.lit(True).alias("target"), "start", "n", "src", "at").alias("s"))
    # a source is asked once for each of its intervals, however many documents copy it
    origin = paths.select(F.col("src").alias("__r"), F.struct(F.lit(False).alias("target"), F.lit(0).alias("start"), "n", "src", "at").alias("s")).distinct()
    done = materialize(removed(rows, ends.unionByName(origin)), "substring-kept")
    checks = done.select(F.explode("checks").alias("c")).select("c.*")
    differ = checks.groupBy("src", "at", "n").agg((F.min("digest") != F.max("digest")).alias("differ")).where("differ")
    if differ.limit(1).count():
        source = checks.where("row IS NULL").select("src", "at", "n", F.col("digest").alias("own"))
        unsettled = materialize(checks.where("row IS NOT NULL").join(source, ["src", "at", "n"]).where("digest <> own").select("row", "start", "n"), "unsettled")
        again = unsettled.select("row").distinct()
        good = paths.select("row", "start", "n").join(again, "row", "left_semi").join(unsettled, ["row", "start", "n"], "left_anti")
        spans = good.unionByName(_settle_by_words(rows, unsettled, k, bits))
        nothing = [F.lit(None).cast("long").alias("src"), F.lit(None).cast("int").alias("at")]
        spans = spans.select(F.col("row").alias("__r"), F.struct(F.lit(True).alias("target"), "start", "n", *nothing).alias("s"))
        mended = removed(rows.join(again.withColumnRenamed("row", "__row"), "__row", "left_semi"), spans)
        done = done.join(again.withColumnRenamed("row", "__row"), "__row", "left_anti").unionByName(mended)
    return done.drop("__row", "checks")


def strip_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, ...) without their repeated words, columns as they are; n_chars, if there, follows the text.

    A row that loses all of its words goes; one that loses none is left as it is.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = dedup_substrings(docs, with_text=True, keep=others, **options)
    left = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    columns = {c: F.col(f"__keep_{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB: windows as strings, the least document of each by a window function.
SUBSTRINGS_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM texts)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM repeated)),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.j) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM texts) w
  ANTI JOIN gone USING (doc_id, j) GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
