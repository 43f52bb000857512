"""Quality rules: text measures, and perplexity under a character n-gram model of the corpus itself.

Texts are dealt to slices of about SLICE_TEXT bytes. A slice counts its ORDER-grams of code points (letters lower-cased, digits as one,
runs of white space as one); Spark adds the counts up and makes of them a modified Kneser-Ney model: every order is a
table of n-grams, joined to its contexts and to the order below. The model grows with the corpus and is never in one place: each slice asks
for the n-grams that it holds, and the answers come back to its texts, where they stand as sorted arrays of
hashes with log probabilities. Each language has a band of
log perplexity around its documents' median, in units of their spread; documents outside of it are rejected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm import common
from merchlake.llm.common import discard, materialize

ORDER = 5
#: Bytes of text in a slice, and that a worker looks at at once.
SLICE_TEXT, STEP_TEXT = 16 << 20, 1 << 20
#: Rounds in which the slices are scored, so that only a part of the texts and answers is moved, and on disk, at a time.
ROUNDS = 2
#: Borders of a language's band: this many spreads (half of the range between quartiles) below and above its median.
BELOW, ABOVE = 8.0, 8.0
#: Documents of fewer symbols say too little to be rejected by perplexity.
MIN_SYMBOLS = 100
_WHITE = np.array([0, 9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029], np.uint32)


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, each with ORDER - 1 spaces in front, and where each begins (one more at the end)."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[np.isin(points, _WHITE)] = 32
    points[(points >= 48) & (points < 58)] = 48
    first = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[first[first < len(points)]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
    pad = ORDER - 1
    begin = np.concatenate([[0], np.cumsum(sizes + pad)])
    out = np.full(begin[-1], 32, np.uint32)
    out[np.arange(int(sizes.sum())) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes)] = points[keep]
    return out, begin


def _grams(points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ORDER-gram that starts at each place where one of one text does, and its text."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = common.window_hashes(common.mix(points.astype(np.uint64)), ORDER)
    row = common.row_of(begin)
    whole = np.flatnonzero(row[: len(hashes)] == row[ORDER - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[whole], whole


def _steps(table: pa.Table):
    """Parts of a slice's texts of about STEP_TEXT bytes."""
    for batch in table.combine_chunks().to_batches():
        yield from common.slices([batch], most=STEP_TEXT)


def _count(table: pa.Table) -> pa.Table:
    """ORDER-grams of a slice with their number."""
    seen, counts, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)
    for batch in _steps(table):
        points, begin = _symbols(batch.column(batch.schema.get_field_index("text")).to_pylist())
        hashes, at = _grams(points, begin)
        keys, where, n = np.unique(hashes, return_index=True, return_counts=True)
        own = points[at[where][:, None] + np.arange(ORDER)]
        seen, where, inverse = np.unique(np.concatenate([seen, keys]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(seen)).astype(np.int64)
        grams = np.concatenate([grams, own])[where]
    text = np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel()
    return pa.table({"slice": pa.array(np.full(len(seen), table.column("slice")[0].as_py(), np.int64)), "gram": pa.array(text, pa.string()), "n": pa.array(counts)})


def _discounts(level: DataFrame) -> list[float]:
    """What is taken from counts of 0, 1, 2, 3 and more, from the numbers of n-grams that occur once to four times."""
    n = [max(1, x or 0) for x in level.agg(*[F.count_if(F.col("n") == k) for k in range(1, 5)]).first()]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]


def _taken(n: Column, d: list[float]) -> Column:
    return F.when(n >= 3, d[3]).when(n == 2, d[2]).otherwise(d[1])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p for every gram of counts(gram, n), strings of `order` characters: p is the probability of the last after the others.

    Modified Kneser-Ney: the highest order counts occurrences, the lower ones the distinct characters seen in front. Each order is
    interpolated with the one below it, the lowest with an even share for every character and one unknown.
    """
    levels = {order: counts.select("gram", "n")}
    for k in range(order - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"quality-order-{k}")
    lower, kinds = None, levels[1].count()
    for k in range(1, order + 1):
        d = _discounts(levels[k])
        parts = levels[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"), _taken(F.col("n"), d).alias("d"))
        contexts = parts.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("lost"))
        joined = parts.join(contexts, "context")
        shorter = F.lit(1.0 / (kinds + 1)) if lower is None else F.col("q")
        if lower is not None:
            joined = joined.join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest")
        made = joined.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("lost") / F.col("total") * shorter).alias("p"))
        before, lower = lower, materialize(made, f"quality-model-{k}")
        discard(before)
    discard(*(levels[k] for k in range(1, order)))
    return lower


_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True


def text_measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, first = common.word_bounds(data, off)
    rows = len(off) - 1

    def by_row(flags, at):
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[at])

    out = {"n_words": np.diff(first)}
    out["word_chars"] = by_row(~common._SEP[data] & ((data & 0xC0) != 0x80), off)
    out["n_symbols"] = by_row(_SYMBOL_BYTES[data], off)
    row = common.row_of(first)
    # lines: from a text's start or after \n, up to \n or the text's end
    n = len(data)
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    begin[1:] |= data == 10
    line_starts = np.flatnonzero(begin[:n])
    stop = np.append(line_starts[1:], n)
    line_ends = np.where((stop > line_starts) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if n else stop
    words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[words > 0], line_ends[words > 0]
    line_row = np.searchsorted(off, line_starts, "right") - 1
    key = common.mix(common.span_hashes(data, line_starts, line_ends) + (line_row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, head = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[head] = False
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    # 3-word windows found twice or more in one text
    window = common.window_hashes(common.span_hashes(data, starts, ends), 3)
    covered = np.zeros(len(starts), bool)
    whole = np.flatnonzero(row[: len(window)] == row[2:]) if len(window) else np.zeros(0, np.int64)
    key = common.mix(window[whole] + (row[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    often = whole[counts[inverse] > 1]
    for j in range(3):
        covered[often + j] = True
    out["n_repeat_words"] = by_row(covered, first)
    return out


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Measures and log perplexity of a slice's texts, from the probabilities of its n-grams."""
    grams = np.array(answers.column("gram").to_pylist(), f"<U{ORDER}")
    keys = common.window_hashes(common.mix(grams.view(np.uint32).astype(np.uint64)), ORDER)[::ORDER] if len(grams) else np.zeros(0, np.uint64)
    by = np.argsort(keys)
    keys, logs = keys[by], np.log(answers.column("p").to_numpy())[by]
    out = []
    for batch in _steps(texts):
        col = batch.column(batch.schema.get_field_index("text"))
        points, begin = _symbols(col.to_pylist())
        hashes, _ = _grams(points, begin)
        n = np.maximum(np.diff(begin) - (ORDER - 1), 0)
        total = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, hashes)] if len(hashes) else [])])
        ends = np.concatenate([[0], np.cumsum(n)])
        score = np.where(n > 0, -(total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1), 0.0)
        columns = {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "lang": batch.column(batch.schema.get_field_index("lang"))}
        columns |= {k: pa.array(m.astype(np.int64)) for k, m in text_measures(*common.utf8(col)).items()}
        out.append(pa.table(columns | {"n_model": pa.array(n.astype(np.int64)), "log_perplexity": pa.array(np.round(score, 9))}))
    return pa.concat_tables(out)


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_model")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the measures, n_model and log_perplexity of every row of docs(doc_id, text, lang)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # dealt by doc_id and text, which are the same whenever the rows are read, so that a slice meets its own n-grams again
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // SLICE_TEXT))))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", place.alias("slice"))
    held = materialize(rows.select("text", "slice").groupBy("slice").applyInArrow(_count, "slice long, gram string, n long"), "quality-grams")
    counts = materialize(held.groupBy("gram").agg(F.sum("n").alias("n")), "quality-counts")
    model = kneser_ney(counts)
    discard(counts)
    answers = materialize(held.select("slice", "gram").join(model, "gram"), "quality-answers")
    discard(held, model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in LONGS)}, log_perplexity double"
    parts = []
    for k in range(ROUNDS):
        texts, told = (t.where(F.col("slice") % ROUNDS == k).groupBy("slice") for t in (rows, answers))
        parts.append(materialize(texts.cogroup(told).applyInArrow(_score, schema), f"quality-scores-{k}"))
    discard(answers)
    return reduce(DataFrame.unionByName, parts)


def score_quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, the measures, log_perplexity, base_failed and kept for every row of docs(doc_id, text, lang).

    base_failed: fewer than 50 words, or 100 * n_repeat_words > 50 * n_words. kept is false for those, and for documents of
    MIN_SYMBOLS symbols or more outside of their language's band. Bands come from the documents that pass the base
    rules (null lang is a language of its own; without any such document all pass). Null and empty texts have
    no words and fail; texts of any length are read whole. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    scored = measured(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = scored.where(~F.col("base_failed") & (F.col("n_model") >= MIN_SYMBOLS))
    quarters = judged.groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 2, F.lit(1e-3))
    bands = quarters.select(F.col("lang").alias("__lang"), (F.col("q")[1] - below * spread).alias("__low"), (F.col("q")[1] + above * spread).alias("__high"))
    joined = scored.join(bands, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("__low"), F.col("__high")), F.lit(True)) | (F.col("n_model") < MIN_SYMBOLS)
    return joined.select("doc_id", *LONGS[:-1], "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")
