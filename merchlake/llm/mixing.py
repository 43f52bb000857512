"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within its source documents are cut into ranges of that key
(a range holds a bounded number of rows, so a hot source is spread over as many tasks as it needs),
prefix sums of word counts run inside each range and are offset by the ranges before it, and the
source is cut at its exact budget. A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import materialize, running_total, word_count

RANGE_ROWS = 4_096


def source_budgets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source of sizes(source, size): source, n_rows, source_size, target, budget.

    Sources in code-point order (null last) weigh `weights` in turn and share the total of all sizes.
    A target stops at max_repeats times its source's size; what is above is reshared by weight. Sorted
    by size over weight the full sources come first, so the common level is found in one pass.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumns({"__null": F.col("source").isNull(), "__one": F.lit(1).cast("long")})
    ranked = running_total(per, ["__null", "source"], {"__rank": "__one"}, "mix-rank")
    turn = ((F.col("__rank") - 1) % len(weights)).cast("int")
    ranked = ranked.withColumn("__weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn + 1))
    ranked = ranked.withColumns({"__cap": F.lit(max_repeats).cast("long") * F.col("source_size"), "__fill": F.lit(max_repeats).cast("double") * F.col("source_size") / F.col("__weight")})
    filled = running_total(ranked, ["__fill", "__rank"], {"__caps": "__cap", "__weights": "__weight"}, "mix-fill")
    everything, all_weights = filled.agg(F.sum("source_size")).scalar(), filled.agg(F.sum("__weight")).scalar()
    level = (everything - (F.col("__caps") - F.col("__cap"))).cast("double") / (all_weights - (F.col("__weights") - F.col("__weight"))).cast("double")
    filled = filled.withColumn("__level", level)
    open_ = F.col("__cap") > F.col("__weight") * F.col("__level")
    # the first source that its share doesn't fill sets the level of all after it
    first = filled.agg(F.min(F.when(open_, F.struct("__fill", "__rank", "__level")))).scalar()
    filled = filled.withColumn("__first", first)
    capped = F.col("__first").isNull() | (F.col("__fill") < F.col("__first.__fill")) | ((F.col("__fill") == F.col("__first.__fill")) & (F.col("__rank") < F.col("__first.__rank")))
    out = filled.withColumn("target", F.when(capped, F.col("__cap").cast("double")).otherwise(F.col("__weight") * F.col("__first.__level")))
    budget = F.least(F.col("__cap"), F.floor(F.col("target") + 0.5).cast("long"))
    return out.select("source", "n_rows", "source_size", "target", budget.alias("budget"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, text, source).

    size counts [^\\x20\\x09-\\x0D]+ (null or empty text: 0). taken is the number of words the mix takes,
    repeats counted; a source takes exactly its rounded target. Null sources form one source, null doc_ids share
    one key; repeated rows are kept apart; ties of the key are ordered by doc_id and size. An
    empty table gives an empty result; other columns are ignored.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("__key")), "mix-sizes")
    per = materialize(source_budgets(sizes, weights, max_repeats), "mix-budgets")
    there = F.col("source").eqNullSafe(F.col("__s"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / range_rows))
    uniform = F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / float(2**32)
    rows = sizes.join(per.withColumnRenamed("source", "__s"), there).drop("__s")
    rows = rows.withColumn("__range", F.floor(uniform * ranges).cast("int"))
    totals = rows.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__inside", F.sum("size").over(inside))
    summed = summed.join(offsets, there & (F.col("__range") == F.col("__r")))
    before = F.col("__offset") + F.col("__inside") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return summed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each epoch that takes it, the last one cut at the budget.

    A whole copy keeps its text as it is; a cut one holds its first words joined by single spaces, and
    n_chars follows if there is such a column. A row of no words has nothing to take and goes.
    """
    taken = mix_sources(docs, **options)
    keys = {"__d": F.col("doc_id"), "__s": F.col("source"), "__n": F.col("size")}
    # equal (doc_id, source, size) rows share a list of their takings, dealt out by row number
    per = taken.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("__takings"))
    sized = docs.withColumn("__size", word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n"))
    same = Window.partitionBy("doc_id", "source", "__size").orderBy("text")
    joined = sized.join(per, on)
    nth = F.when(F.size("__takings") == 1, F.lit(1)).otherwise(F.row_number().over(same))
    joined = joined.withColumn("__taken", F.element_at("__takings", nth))
    full, part = F.expr("__taken div __size"), F.expr("__taken % __size")
    copies = F.when(F.col("__size") > 0, F.concat(F.array_repeat(F.col("__size"), full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))))
    rows = joined.withColumn("__take", F.explode(copies))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("__take") == F.col("__size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("__take").cast("int")), " "))
    out = {"text": text}
    rows = rows.withColumns(out)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__take") < F.col("__size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM per),
weighed AS (SELECT *, (r - 1) % 3 + 1 AS w, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / ((r - 1) % 3 + 1) AS fill FROM ranked),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM weighed WINDOW before AS (ORDER BY fill, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT fill AS f, r AS fr, level AS l FROM filled WHERE cap > w * level ORDER BY fill, r LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN f IS NULL OR fill < f OR (fill = f AND r < fr) THEN CAST(cap AS DOUBLE) ELSE w * l END AS target, cap
  FROM filled LEFT JOIN first ON TRUE),
budgets AS (SELECT *, least(cap, CAST(floor(target + 0.5) AS BIGINT)) AS budget FROM targets),
rows AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before_
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before_)) END AS BIGINT) AS taken
FROM rows
"""
