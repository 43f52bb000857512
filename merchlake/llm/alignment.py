"""Alignment of two tokenizers over a corpus: tokens that end together, and how often each pair does so.

Documents are encoded in slices. A slice keeps what its documents link and sends one partial count for each pair, a 64-bit key packed from
both ids. The partial counts are sorted by key over ranges and runs of a key are summed. The totals go back to the slices that
asked, sorted again; there they lie in a memory map, in which each document's keys are looked up by binary search.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import in_arrow, materialize, shuffle_width, slices

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of a slice (more only for one longer text).
SLICE = 16 << 20
#: Units of text whose encoding a task remembers, and their characters, before it starts anew.
STORE_UNITS, STORE_CHARS = 200_000, 16 << 20
#: Where both tokenizers surely end a token: before a single space between two characters that are no white space to either.
CUT = re.compile("(?<=[!-~À-ÿ]) (?=[!-~À-ÿ])")
#: How the byte-level tokenizer cuts a text before it merges (fixed value of its public format).
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(a, b):
    """64-bit keys of pairs of ids; the pairs of one B id lie together."""
    return (b << 32) | a


def byte_level_ranks(text: str) -> dict[bytes, int]:
    """Bytes of each ordinary token of a byte-level tokenizer file, with its id (ids follow the order of the merges)."""
    told = json.loads(text)
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*kept}))}
    special = {t["content"] for t in told["added_tokens"] if t["special"]}
    return {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}


class Aligner:
    """Units of text with their tokens, groups and links; a text's tokens are those of its units end to end."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = self.b.id_to_piece
        self.a_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_said, self.b_said = _said(len(self.a_bytes), ",|"), _said(len(self.b_bytes), ",;")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = array("q")  # tokens of A, of B, groups, whether the bytes are those of the text; four a unit
        self.keys, self.offsets = array("q"), array("q", [0])
        self.chars = 0

    def learn(self, units: list[str]) -> None:
        """Encode units, each of which holds a character at least, and keep what they link; all of them at once."""
        whole = [f" {unit}" for unit in units]
        a, b = _Tokens([self.a.encode_ordinary(w) for w in whole], self.a_bytes), _Tokens(self.b.encode(units, num_threads=1), self.b_bytes)
        told = [w.encode() for w in whole]
        same = np.array([x == w == y for x, w, y in zip(a.spelt, told, b.spelt)], bool)
        first = np.cumsum([0, *map(len, told)])[:-1]
        ids_a, end_a, unit_a = a.of(same, first)
        ids_b, end_b, _ = b.of(same, first)
        # a unit that is spelt alike ends with a token of both, so no group reaches into the next
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        tail_a, tail_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        count = np.bincount(unit_a[tail_a], minlength=len(units))
        # a group's tokens of A stand behind those of B of the groups before it, its tokens of B behind those of A of its own
        said = np.empty(len(ids_a) + len(ids_b), object)
        said[np.arange(len(ids_a)) + np.append(0, tail_b + 1)[np.cumsum(last_a) - last_a]] = self.a_said[last_a.astype(np.int8), ids_a]
        said[np.arange(len(ids_b)) + (tail_a + 1)[np.cumsum(last_b) - last_b]] = self.b_said[last_b.astype(np.int8), ids_b]
        ends = np.cumsum(np.where(same, a.number + b.number, 0))
        said = said.tolist()
        self.place.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups.extend("".join(said[x:y])[:-1] for x, y in zip([0, *ends.tolist()], ends.tolist()))
        self.chars += sum(map(len, units))
        self.sums.frombytes(np.stack([a.number, b.number, count, same], 1).astype(np.int64).tobytes())
        self.offsets.frombytes((len(self.keys) + np.cumsum(count)).astype(np.int64).tobytes())
        self.keys.frombytes(pack(ids_a[tail_a], ids_b[tail_b]).tobytes())

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sums (A, B, groups) and digest of its groups; then text, key and occurrences of the links, by text and key."""
        cut = [CUT.split(t) if t else [] for t in texts]
        if new := list({u for us in cut for u in us if u not in self.place}):
            self.learn(new)
        at = [[self.place[u] for u in us] for us in cut]
        first = np.cumsum([0, *map(len, at)])
        units = np.fromiter((u for us in at for u in us), np.int64, int(first[-1]))
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        sums = np.frombuffer(self.sums, np.int64).reshape(-1, 4)[units]
        bad = np.bincount(owner, 1 - sums[:, 3], len(texts)) > 0
        totals = np.stack([np.where(bad, 0, np.bincount(owner, sums[:, k], len(texts))) for k in range(3)], 1).astype(np.int64)
        said = ["" if b or not us else hashlib.sha256(";".join([self.groups[u] for u in us]).encode()).hexdigest() for b, us in zip(bad, at)]
        offsets = np.frombuffer(self.offsets, np.int64)
        units, owner = units[~bad[owner]], owner[~bad[owner]]
        count = (offsets[1:] - offsets[:-1])[units]
        keys = np.frombuffer(self.keys, np.int64)[np.repeat(offsets[units] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        owner, keys, n = _summed(np.repeat(owner, count), keys, np.ones(len(keys), np.int64))
        if len(self.groups) > STORE_UNITS or self.chars > STORE_CHARS:
            self.clear()
        return totals, said, owner, keys, n


def _said(size: int, marks: str) -> np.ndarray:
    """Each id below size with each of the marks behind it, a row a mark."""
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in marks], object).reshape(len(marks), size)


class _Tokens:
    """Tokens of units, end to end: how many a unit has, and the bytes that they spell."""

    def __init__(self, ids: list[list[int]], spelling: list[bytes]):
        self.number = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.number.sum()))
        spelt = [spelling[i] for i in self.ids.tolist()]
        self.sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        ends = np.append(0, np.cumsum(self.number)).tolist()
        self.spelt = [b"".join(spelt[x:y]) for x, y in zip(ends, ends[1:])]

    def of(self, kept: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens of the units kept, the byte at which each ends, where its unit begins at first[unit], and their units."""
        unit = np.repeat(np.arange(len(kept)), self.number)
        at, begin = np.cumsum(self.sizes), np.cumsum(self.number) - self.number
        base = np.append(0, at)[begin]
        keep = kept[unit]
        unit = unit[keep]
        return self.ids[keep], at[keep] - base[unit] + first[unit], unit


def _summed(owner: np.ndarray, keys: np.ndarray, n: np.ndarray):
    """Sums of n over equal (owner, key), in their order."""
    if not len(keys):
        return owner, keys, n
    order = np.lexsort((keys, owner))
    owner, keys, n = owner[order], keys[order], n[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
    return owner[at], keys[at], np.add.reduceat(n, at)


def _partial(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


ENCODED = "slice long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys binary, counts binary, key long, n long"


def _encode(batches, aligner: Aligner, slice_bytes: int):
    """A row for each document (key: null), then one for each distinct pair of the slice."""
    task, number, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []

    def ended():
        keys, n = _partial(parts)
        return _rows(slice=np.full(len(keys), task | number), key=keys, n=n)

    for part in slices(batches):
        totals, said, owner, keys, n = aligner.texts(part.column(part.schema.get_field_index("text")).to_pylist())
        cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
        yield _rows(
            slice=np.full(part.num_rows, task | number), doc_id=part.column(part.schema.get_field_index("doc_id")), n_a=totals[:, 0], n_b=totals[:, 1], n_groups=totals[:, 2], groups_sha256=said,
            keys=[keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], counts=[n[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])],
        )
        parts, held = [_partial([*parts, (keys, n)])], held + part.nbytes
        if held >= slice_bytes:
            yield ended()
            number, held, parts = number + 1, 0, []
    if parts:
        yield ended()


def _rows(**columns) -> pa.RecordBatch:
    """A batch of the schema ENCODED; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [c.split() for c in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in kinds], names=[c for c, _ in kinds])


def _total_runs(batches):
    """Rows (slice, key, n) sorted by key: each with the sum of n over all rows of its key. A run holds one row a slice."""
    held: list[pa.RecordBatch] = []

    def summed(table: pa.Table, keep_last: bool):
        key, n = (table.column(c).to_numpy() for c in ("key", "n"))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        whole = int(at[-1]) if keep_last else len(key)
        at = at[at < whole]
        done = None
        if len(at):
            total = np.repeat(np.add.reduceat(n[:whole], at), np.diff(np.append(at, whole)))
            done = pa.RecordBatch.from_arrays([pa.array(table.column("slice").to_numpy()[:whole]), pa.array(key[:whole]), pa.array(total)], names=["slice", "key", "total"])
        return done, table.slice(whole).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and batch.column(1)[-1] == held[0].column(1)[0]:
            held.append(batch)  # all of one key still
            continue
        done, held = summed(pa.Table.from_batches([*held, batch]), True)
        if done is not None:
            yield done
    if held:
        yield summed(pa.Table.from_batches(held), False)[0]


class Shard:
    """Sorted keys with their numbers in a memory map over a file without a name, which ends with the task."""

    def __init__(self):
        self.file, self.map = tempfile.TemporaryFile(), None

    def append(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        np.stack([keys, numbers], 1).astype(np.int64).tofile(self.file)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.map is None:
            self.file.flush()
            self.map = np.memmap(self.file, np.int64, "r").reshape(-1, 2)
        return self.map[np.searchsorted(self.map[:, 0], keys), 1]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(batches):
    """Rows of slices: first the slice's totals by key (twice the total, and one if it is its B id's highest), then its documents."""
    now, shard = None, None
    for batch in batches:
        columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        of, key, number = np.asarray(columns["slice"]), columns["key"], columns["n"]
        is_doc = np.asarray(key.is_null())
        turns = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (is_doc[1:] != is_doc[:-1]))) if len(of) else []
        for a, b in zip(turns, [*turns[1:], len(of)]):
            if of[a] != now:
                now, shard = of[a], Shard()
            if not is_doc[a]:
                shard.append(np.asarray(key.slice(a, b - a)), np.asarray(number.slice(a, b - a)))
                continue
            links, best, total = [], [], []
            for keys, counts in zip(columns["keys"].slice(a, b - a).to_pylist(), columns["counts"].slice(a, b - a).to_pylist()):
                told, n = shard.find(np.frombuffer(keys, np.int64)) if keys else np.zeros(0, np.int64), np.frombuffer(counts, np.int32).astype(np.int64)
                links.append(int(n.sum()))
                best.append(int(n[(told & 1) == 1].sum()))
                total.append(int((n * (told >> 1)).sum()))
            kept = {c: columns[c].slice(a, b - a) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            made = kept | {c: pa.array(v, pa.int64()) for c, v in (("n_links", links), ("n_best", best), ("count_sum", total))}
            yield pa.RecordBatch.from_arrays([made[c.split()[0]] for c in ALIGNED.split(", ")], names=[c.split()[0] for c in ALIGNED.split(", ")])


def _encoded(docs: DataFrame, a_file: str, b_file: str, slice_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        shared = spark.sparkContext.broadcast((byte_level_ranks(a.read()), b.read()))  # two vocabularies
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(in_arrow(rows, lambda batches: _encode(batches, Aligner(*shared.value), slice_bytes), ENCODED), "alignment-encoded")


def _totals(encoded: DataFrame) -> DataFrame:
    """slice, key, total: for each slice the corpus-wide count of each pair that it holds, sorted by key over ranges."""
    spark = encoded.sparkSession
    partial = encoded.where("key is not null").select("slice", "key", "n")
    ranged = partial.repartitionByRange(shuffle_width(spark), "key").sortWithinPartitions("key")
    return materialize(in_arrow(ranged, _total_runs, "slice long, key long, total long"), "alignment-totals")


def count_pairs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, slice_bytes: int = SLICE) -> DataFrame:
    """a_id, b_id, n: how many links of docs(doc_id, text) hold each pair of ids; one row a pair."""
    totals = _totals(_encoded(docs, a_file, b_file, slice_bytes))
    return totals.select("key", "total").distinct().select(F.col("key").bitwiseAND(0xFFFFFFFF).alias("a_id"), F.shiftright("key", 32).alias("b_id"), F.col("total").alias("n"))


def align_tokenizers(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text).

    A encodes a space and the text, B the text; byte offsets where tokens of both end cut them into groups, and the two tokens that end there are a
    link. n_best counts the links whose pair is as frequent in the corpus as any of its B id, count_sum adds up their pairs' counts. A text
    that is null, empty, or not spelt by its tokens has zeros and ''. Every row counts, repeated ones too; null doc_ids stay null.
    An empty table gives no rows; other columns are ignored. Only what a slice's own documents hold is in a task at once, and the
    highest counts, one for each id of B's vocabulary, are broadcast.
    """
    encoded = _encoded(docs, a_file, b_file, slice_bytes)
    totals = _totals(encoded)
    best = totals.groupBy(F.shiftright("key", 32).alias("b")).agg(F.max("total").alias("most"))
    told = totals.join(F.broadcast(best), F.shiftright("key", 32) == F.col("b"))  # a row an id of B
    answers = told.select("slice", "key", (F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")).alias("n"))
    documents = encoded.where("key is null")
    both = documents.unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition(shuffle_width(docs.sparkSession), "slice").sortWithinPartitions("slice", F.asc_nulls_last("key"))
    return in_arrow(dealt, _look_up, ALIGNED)
