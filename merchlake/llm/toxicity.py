"""Toxicity by a subword-bag classifier.

A word is the bag of its character n-grams (bytes, with its borders) and itself, hashed to buckets; a bucket has
an embedding; a text falls into blocks of about 48 words, a block is the average of its embeddings (a word counts once
in a block; short blocks are filled up with an empty piece), and a linear softmax reads it. Embeddings
and softmax are trained jointly in numpy on a bounded sample of labelled documents, so a misspelling that
was never seen shares most vectors with the word it comes from. Since a toxic document is mostly clean words, a document
counts as its most toxic block, in training (multiple-instance learning) as in scoring.

Averaging and softmax are linear, so for scoring the model folds into one number a bucket.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm import common

GRAMS, BUCKETS, DIM, BLOCK = (3, 4, 5), 1 << 16, 8, 48
#: Bags of fewer features (some 36 words) are filled up to this many with a piece whose embedding is zero.
PAD = 384
#: Bounds of the training sample: documents of each class, and blocks of one.
TRAIN_PER_CLASS, TRAIN_BLOCKS = 1500, 256
_WEIGHTS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)


def _padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with a space at both ends of each, and where each begins."""
    rows = np.arange(len(off) - 1)
    text = np.ones(len(data) + 2 * len(rows), bool)
    text[off[:-1] + 2 * rows] = False
    text[off[1:] + 2 * rows + 1] = False
    out = np.full(len(text), 32, np.uint8)
    out[text] = data
    return out, off + 2 * np.arange(len(off))


def _features(data: np.ndarray, off: np.ndarray):
    """Block of each word, each text's first block (one more at the end), and a generator of (buckets, word index).

    A text falls into the least number of blocks of at most BLOCK words, as even as can be; of a word that a block holds
    several times only the first yields buckets.
    """
    data, off = _padded(common.LOWER[data], off)
    starts, ends, first = common.word_bounds(data, off)
    counts = np.diff(first)
    first_block = np.concatenate([[0], np.cumsum(-(-counts // BLOCK))])
    row = common.row_of(first)
    block = first_block[row] + (np.arange(len(row)) - first[row]) * np.diff(first_block)[row] // counts[row]
    whole = common.span_hashes(data, starts, ends)
    once = np.zeros(len(whole), bool)
    once[np.unique(common.mix(whole + block.astype(np.uint64) * common._P), return_index=True)[1]] = True
    sep = common._SEP[data]
    data = np.where(sep, np.uint8(32), data)
    seps = np.zeros(len(data) + 1, np.int32)
    np.cumsum(sep, out=seps[1:])
    word = np.zeros(len(data), np.int32)
    word[starts] = 1
    word = np.cumsum(word, dtype=np.int32) - 1
    shift = np.uint64(64 - 16)

    def grams():
        at = np.flatnonzero(once)
        yield whole[at] >> shift, at
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            at = np.flatnonzero(seps[n - 1 : n - 1 + m] == seps[1 : 1 + m])  # no border inside
            of = word[at + 1]
            keep = once[of]
            at, of = at[keep], of[keep]
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h += data[at + j].astype(np.uint64) * _WEIGHTS[j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield h >> shift, of

    return block, first_block, grams


def _bags(batches, most: int):
    """doc_id, label and the blocks (at most so many, evenly apart) of each training text: buckets with repeats."""
    for batch in common.slices(batches):
        block, first_block, grams = _features(*common.utf8(batch.column(2)))
        parts = [(b.astype(np.uint16), block[w]) for b, w in grams()]
        ids, of = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(of, kind="stable")
        ids, cuts = ids[order], np.searchsorted(of[order], np.arange(first_block[-1] + 1))
        out = []
        for i in range(batch.num_rows):
            a, b = first_block[i], first_block[i + 1]
            mine = a + np.arange(b - a) if b - a <= most else a + np.arange(most) * (b - a) // most
            out.append(((cuts[mine + 1] - cuts[mine]).astype(np.int32).tobytes(), b"".join(ids[cuts[k] : cuts[k + 1]].tobytes() for k in mine)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "label", "lengths", "ids"])


class Model:
    """weights: one float for each bucket; bias, and the scale and shift that turn a text's best block into a logit."""

    def __init__(self, weights, bias, scale, shift):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift


def _segment_means(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, cuts[:-1], axis=0) / np.maximum(np.diff(cuts), PAD).reshape(-1, *[1] * (values.ndim - 1))


def fit(labels: np.ndarray, lengths: list[np.ndarray], ids: np.ndarray, share: float = 0.5, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Of each text its label and its blocks' lengths, of all blocks the bucket ids end to end; share: of toxic texts, as they come.

    Texts have a block at least. With one class only, all scores are that class's share.
    """
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 4.0 if len(labels) and labels[0] else -4.0)
    rng = np.random.default_rng(seed)
    cuts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    of = np.concatenate([[0], np.cumsum([len(x) for x in lengths])])  # text -> first block
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full_like(x, 1e-6) for x in (embed, soft, bias)]

    def step(blocks, want, weight):
        lengths = cuts[blocks + 1] - cuts[blocks]
        at = np.repeat(cuts[blocks] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        used, inside = np.unique(ids[at], return_inverse=True)
        mean = _segment_means(embed[used][inside], np.concatenate([[0], np.cumsum(lengths)]))
        logits = mean @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(want)), want] -= 1
        p *= (weight / weight.sum())[:, None]
        back = (p @ soft.T) / np.maximum(lengths, PAD)[:, None]
        spread = np.repeat(back, lengths, axis=0)
        grad = np.stack([np.bincount(inside, spread[:, d], len(used)) for d in range(DIM)], 1)
        for x, s, g, rows in ((embed, sums[0], grad, used), (soft, sums[1], mean.T @ p, slice(None)), (bias, sums[2], p.sum(0), slice(None))):
            s[rows] += g * g
            x[rows] -= rate * g / np.sqrt(s[rows])

    # every fifth text only calibrates: texts that were learnt from stand further apart than others
    learn = np.flatnonzero(np.arange(len(labels)) % 5 != 4)
    if len(set(labels[learn].tolist())) < 2 or len(set(np.delete(labels, learn).tolist())) < 2:
        learn = np.arange(len(labels))
    apart = np.setdiff1d(np.arange(len(labels)), learn) if len(learn) < len(labels) else learn
    known = labels[learn]

    def block_logits():
        folded, parts = embed @ (soft[:, 1] - soft[:, 0]), []
        for a in range(0, len(cuts) - 1, 2048):  # some blocks at a time, as the driver has little memory
            own = cuts[a : a + 2049]
            parts.append(_segment_means(folded[ids[own[0] : own[-1]]], own - own[0]))
        return np.concatenate(parts) + (bias[1] - bias[0])

    def best(logits):
        top = np.maximum.reduceat(logits, of[:-1])
        return top, np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(of[:-1], of[1:])])

    for epoch in range(epochs):
        other = (of[:-1] + (rng.random(len(labels)) * np.diff(of)).astype(int))[learn]
        if epoch < 2:  # no idea yet which blocks are toxic: any block bears its text's label
            blocks, want = other, known
        else:
            top = best(block_logits())[1][learn]
            blocks = np.concatenate([top, other[known == 0]])
            want = np.concatenate([known, np.zeros((known == 0).sum(), int)])
        weight = np.where(want == 1, 0.5 / max(1, (want == 1).sum()), 0.5 / max(1, (want == 0).sum()))
        for part in np.array_split(rng.permutation(len(blocks)), max(1, len(blocks) // 64)):
            step(blocks[part], want[part], weight[part])
    top, labels = best(block_logits())[0][apart], labels[apart]
    # a logistic fit of the label on the best block, classes weighed as they come
    weight = np.where(labels == 1, share / (labels == 1).sum(), (1 - share) / (labels == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        g, h = weight * (p - labels), np.maximum(weight * p * (1 - p), 1e-9)
        grad = np.array([(g * top).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * top * top).sum() + 1e-3, (h * top).sum()], [(h * top).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
    return Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), a, b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, blocks: int = TRAIN_BLOCKS, folds: int = 5) -> Model:
    """Fit on at most per_class documents of each class, those of least md5(doc_id), out of the learning folds.

    The learning folds are the doc_ids whose crc32 (as text) modulo `folds` is not 0. Of a text at most `blocks` blocks teach,
    evenly apart (256 are a text of 12,288 words). The sample is bounded by both, so it may
    be broadcast to find its texts and its bags may come to the driver. Labels of documents that docs lacks take no place in it.
    """
    name = F.col("doc_id").cast("string")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(name.cast("binary")) % folds != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("__y")).withColumn("__h", F.md5(name.cast("binary")))
    known = known.join(docs.where("text rlike '[^ \\t\\n\\x0B\\f\\r]'").select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    sample = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy("__h").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    found = docs.join(F.broadcast(sample.select(F.col("doc_id"), "__y")), "doc_id").select("doc_id", F.col("__y").cast("int").alias("label"), "text")
    bags = common.in_arrow(found, partial(_bags, most=blocks), "doc_id long, label int, lengths binary, ids binary")
    rows = bags.where("length(lengths) > 0").toArrow()
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("lengths", "ascending")]).to_pylist()
    lengths = [np.frombuffer(rows.column("lengths")[k].as_buffer(), np.int32).copy() for k in order]
    ids, at = np.empty(sum(int(x.sum()) for x in lengths), np.uint16), 0
    for k in order:  # one copy at a time: the driver has little memory
        part = np.frombuffer(rows.column("ids")[k].as_buffer(), np.uint16)
        ids[at : at + len(part)], at = part, at + len(part)
    labels = rows.column("label").to_numpy()[order]
    del rows  # the copies suffice
    pa.default_memory_pool().release_unused()
    return fit(labels, lengths, ids, share)


def _scorer(shared, keep: list[str], below: float | None):
    def run(batches):
        weights, bias, scale, shift = shared.value
        for batch in common.slices(batches):
            block, first_block, grams = _features(*common.utf8(batch.column(batch.schema.get_field_index("text"))))
            total, count = np.zeros(first_block[-1]), np.zeros(first_block[-1])
            for b, w in grams():
                total += np.bincount(block[w], weights[b], len(total))
                count += np.bincount(block[w], minlength=len(total))
            logits = total / np.maximum(count, PAD) + bias
            top = np.full(batch.num_rows, bias)
            full = np.flatnonzero(np.diff(first_block))
            if len(full):
                top[full] = np.maximum.reduceat(logits, first_block[full])
            score = 1 / (1 + np.exp(-np.clip(scale * top + shift, -500, 500)))
            out = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(score)], names=[*keep, "__score"])
            yield out if below is None else out.filter(pa.array(score < below))

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"], below: float | None = None) -> DataFrame:
    """The columns `keep` and __score (0 to 1) for every row, or for those of scores under `below`; null and empty texts get the score of a block of nothing."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.scale, model.shift))  # BUCKETS floats
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    return common.in_arrow(rows, _scorer(shared, keep, below), f"{schema}, __score double")


def detect_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text); labels(doc_id, toxic) teach.

    held_out: crc32 of the doc_id as text is 0 modulo 5, or there is no doc_id; such labels are never learnt from.
    Labels other than 0 and 1 are ignored, of several for a document the highest holds. Null and blank texts get the score of
    a block of nothing; repeated rows and equal texts get equal scores; long texts are scored whole. Other columns are ignored. Without any
    label of a class all scores are those of the other; an empty table gives no rows.
    """
    scored = score_toxicity(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
