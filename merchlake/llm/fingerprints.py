"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the range of hashes, whatever the length of the text. So the sketch of a
union is made of the sketches alone (`merge_sketches`), and the share of one sketch in another estimates containment even where
one text is a thousand times as long as the other. The least hash stays too, so that no text of words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import materialize, running_total

#: Words of a shingle; one in SCALE of all hashes is kept.
WIDTH, SCALE = 5, 4
#: Hexadecimal digits of a hash: the first ones of MD5, so that hashes are positive longs.
DIGITS = 15
#: Documents of a block, inside which the next document is looked up, and the most blocks that there are.
BLOCK_ROWS, MAX_BLOCKS = 512, 1 << 16


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted distinct hashes (longs) of the text's shingles that lie below 1 / scale of their range, and the least one.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A text of fewer words than width is one shingle; one of none has an empty sketch.
    """
    below = f"{-(-(16**DIGITS) // scale):0{DIGITS}x}" if scale > 1 else "g"

    def hashed(shingle: Column) -> Column:
        return F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)

    def shingles(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: hashed(F.array_join(F.slice(words, i, width), " ")))
        one = F.array(hashed(F.array_join(words, " ")))
        return F.when(F.size(words) >= width, many).when(F.size(words) > 0, one).otherwise(F.array().cast("array<string>"))

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < below)
        least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
        return _let(low, lambda x: F.when(F.size(x) > 0, x).otherwise(least))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    numbers = F.transform(_let(_let(words, shingles), kept), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.array_sort(F.array_distinct(numbers))


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches."""
    limit = -(-(16**DIGITS) // scale)

    def kept(both: Column) -> Column:
        low = F.filter(both, lambda h: h < limit)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))

    return _let(F.array_sort(F.array_union(a, b)), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two texts from their sketches (0 to 1); two texts without words are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has (0 to 1); a text without words is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def as_text(hashes: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal digits, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def _keyed(docs: DataFrame, unique: bool) -> DataFrame:
    """doc_id, text and a unique long __key in the order of doc_id (null last, equal ones by text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if unique:
        return rows.withColumn("__key", F.col("doc_id"))
    rows = rows.withColumns({"__null": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__digest": F.sha2("text", 256), "__row": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")})
    numbered = running_total(materialize(rows, "fingerprint-rows"), ["__null", "__id", "__digest", "__row"], {"__key": "__one"}, "fingerprint-order")
    return materialize(numbered.select("doc_id", "text", "__key"), "fingerprint-keys")


def _numbers(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(key: Column, firsts: list[int]) -> Column:
    """How many of the sorted `firsts` are at or below key, by halving."""
    steps = [F.lit(1 << k) for k in range(len(firsts).bit_length() - 1, -1, -1)]
    array = _numbers(firsts)
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))


def _block_starts(keys: DataFrame, n_rows: int, block_rows: int) -> list[int]:
    """The first keys of ranges of about block_rows rows: at most MAX_BLOCKS numbers reach the driver.

    The ranges' bounds come from a part of the keys (they only deal out the work), their first keys from all of them.
    """
    blocks = min(MAX_BLOCKS, -(-n_rows // block_rows))
    least = keys.agg(F.min("__key")).first()[0]
    if blocks < 2:
        return [least]
    part = F.when(F.pmod(F.xxhash64("__key"), F.lit(max(1, n_rows // (64 * blocks)))) == 0, F.col("__key"))
    shares = F.split(F.lit(",".join(f"{k / blocks:.9f}" for k in range(1, blocks))), ",").cast("array<double>")
    cuts = keys.agg(F.percentile_approx(part, shares, F.lit(16 * blocks))).first()[0] or []
    bounds = sorted({least, *(c for c in cuts if c > least)})
    return sorted(r[0] for r in keys.groupBy(_place(F.col("__key"), bounds)).agg(F.min("__key").alias("first")).select("first").collect())


def with_next(docs: DataFrame, columns: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text and the columns (expressions over text) of each row, and the same of the next one as next_<name>.

    The next row is that of the next doc_id, after the last that of the first. Texts are moved once, to blocks of neighbouring rows; the
    first row of each block goes to the block before it too.
    """
    seen = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    rows = _keyed(docs, seen[0] == seen[1])
    firsts = _block_starts(rows.select("__key"), seen[0], block_rows) if seen[0] else [0]
    rows = rows.withColumns({**columns, "__at": _place(F.col("__key"), firsts)})
    here = F.struct(F.col("__at").alias("block"), F.lit(False).alias("copy"))
    before = F.struct(F.when(F.col("__at") == 1, F.lit(len(firsts))).otherwise(F.col("__at") - 1).alias("block"), F.lit(True).alias("copy"))
    leads = F.get(_numbers(firsts), F.col("__at") - 1) == F.col("__key")
    dealt = rows.withColumn("__to", F.explode(F.when(leads, F.array(here, before)).otherwise(F.array(here)))).select("*", "__to.block", "__to.copy").drop("__at", "__to")
    order = Window.partitionBy("block").orderBy("copy", "__key")
    names = ["text", *columns]
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).where(~F.col("copy")).select("doc_id", *names, *[f"next_{c}" for c in names])


def fingerprint_documents(docs: DataFrame, width: int = WIDTH, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the containments for every row of docs(doc_id, text).

    The edited text is the text with its last n_chars div 4 code points replaced by the first as many (or all) of the next document's.
    near_* are Jaccard estimates, inside_* the estimated shares of the document's shingles that the other has. Null texts are empty; an empty
    text has the fingerprint '' and is like any other without words (1.0). Equal doc_ids follow each other by the digest of their text, null ones come last;
    repeated rows are kept apart. A single row is its own next one; an empty table gives no rows. Other columns are ignored.
    """
    both = with_next(docs, {"__sketch": sketch(F.col("text"), width, scale)}, block_rows)
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substring("next_text", F.lit(1), part))
    both = both.withColumn("__edited", edited)
    marks = both.select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
        # all that is made of the three sketches, each made once
        _let(sketch(F.col("__edited"), width, scale), lambda e: F.struct(
            as_text(F.col("__sketch")).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
            likeness(F.col("__sketch"), e).alias("near_edited"), likeness(F.col("__sketch"), F.col("next___sketch")).alias("near_next"),
            containment(F.col("__sketch"), e).alias("inside_edited"), containment(F.col("__sketch"), F.col("next___sketch")).alias("inside_next"),
        )).alias("__marks"),
    )
    return marks.select("doc_id", "n_chars", "edited_sha256", "__marks.*")


FINGERPRINTS_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text
  FROM documents),
edits AS (SELECT *, substring(text, 1, n_chars - n_chars // 4) || substring(next_text, 1, n_chars // 4) AS edited FROM plain),
texts AS (SELECT doc_id, 1 AS k, text AS t FROM edits UNION ALL SELECT doc_id, 2, edited FROM edits UNION ALL SELECT doc_id, 3, next_text FROM edits),
words AS (SELECT doc_id, k, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
hashes AS (
  SELECT doc_id, k, CASE WHEN len(w) = 0 THEN [] ELSE
    list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: substring(md5(array_to_string(w[i:i + 4], ' ')), 1, 15)) END AS h
  FROM words),
sketches AS (
  SELECT doc_id, k, list_sort(list_distinct(CASE WHEN len(list_filter(h, lambda x: x < '400000000000000')) > 0 THEN list_filter(h, lambda x: x < '400000000000000')
         WHEN len(h) > 0 THEN [list_min(h)] ELSE h END)) AS s
  FROM hashes)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
       CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) END AS near_edited,
       CASE WHEN len(a.s) + len(c.s) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.s, c.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, c.s))) END AS near_next,
       CASE WHEN len(a.s) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(a.s) END AS inside_edited,
       CASE WHEN len(a.s) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.s, c.s)) AS DOUBLE) / len(a.s) END AS inside_next
FROM edits e JOIN sketches a ON a.doc_id = e.doc_id AND a.k = 1 JOIN sketches b ON b.doc_id = e.doc_id AND b.k = 2 JOIN sketches c ON c.doc_id = e.doc_id AND c.k = 3
"""
