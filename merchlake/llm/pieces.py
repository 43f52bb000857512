"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The lattice of a text falls into units: where two neighbouring bytes stand together in no piece, no piece
reaches over. Over a unit a forward Viterbi pass gives every node the score of its best prefix; the backward
A* search starts at the unit's end and uses those scores as its heuristic. They are exact, so paths come out in order of
their score and no node off the best path is opened before that path is out. The search runs over many units in step: each has
its queue, and every step opens the best node of each; units of thousands of bytes have a heap of their own. A unit is searched
once by a task and known by its bytes afterwards. The
N best of a text are the N best sums over its units, and the ids of each are put together from its units' paths.

Pieces and scores come from a public model file whose path is a parameter; spaces stand for the model's
word mark. A character that no piece is gives its bytes, each a byte piece, so decoding returns the text exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEPT_UNITS = 200_000
#: Longer units are searched with a heap; of the others so many queue places are held at a time.
HEAP_BYTES, QUEUE_PLACES = 1024, 1 << 20
#: Bytes of text in a step; the lattice takes some hundred times the bytes of its new units.
SLICE_BYTES = 1 << 20
FALLBACK = 10.0


def load_pieces(path: str = MODEL) -> tuple[dict[bytes, tuple[int, float]], list[int], float]:
    """Pieces as bytes (id and score; the word mark as a space), the ids of the 256 byte pieces, their score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, by_byte = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            by_byte[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i).replace("▁", " ").encode()] = (i, model.get_score(i))
    normal = [s for _, s in pieces.values() if s > -1e6]
    return pieces, by_byte, min(normal) - FALLBACK


class Lattice:
    """Piece lookup and segmentation of units (byte strings)."""

    def __init__(self, pieces, by_byte, byte_score, n_best: int):
        self.pieces, self.by_byte, self.byte_score, self.n_best = pieces, by_byte, byte_score, n_best
        self.longest = max(map(len, pieces))
        keys = [np.frombuffer(p, np.uint8) for p in pieces]
        data = np.concatenate(keys)
        ends = np.cumsum([len(k) for k in keys])
        hashes = common.span_hashes(data, ends - [len(k) for k in keys], ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.numbers = np.array([pieces[p][0] for p in pieces])[order]
        self.scores = np.zeros(max(max(self.numbers), max(by_byte)) + 1)
        for i, s in pieces.values():
            self.scores[i] = s
        self.scores[by_byte] = byte_score
        self.together = np.zeros((256, 256), bool)  # bytes that are neighbours in a piece
        inner = np.ones(len(data), bool)
        inner[ends - [len(k) for k in keys]] = False
        at = np.flatnonzero(inner)
        self.together[data[at - 1], data[at]] = True
        # a first look by 20 bits keeps most byte strings out of the search
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units of all rows, and each row's first unit."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = ~self.together[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        begin[off] = True
        starts = np.flatnonzero(begin[:n])
        return starts, np.append(starts[1:], n), np.searchsorted(starts, off)

    def edges(self, data: np.ndarray, first: np.ndarray, lengths: np.ndarray):
        """(unit, start, end, id) of every lattice edge of the units, which stand end to end in data; in order of unit, end, start."""
        of = np.repeat(np.arange(len(lengths)), lengths)
        begin = first[of]
        end = begin + lengths[of]
        place = np.flatnonzero((data & 0xC0) != 0x80)  # pieces begin and end between characters
        width = np.diff(np.append(place, len(data)))
        alone = np.zeros(len(place), bool)
        found = []
        for n in range(1, self.longest + 1):
            fits = np.flatnonzero(place + n <= end[place])
            if not len(fits):
                break
            at = place[fits]
            h = common.span_hashes(data, at, at + n)
            hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            ok = self.hashes[slot] == h[hit]
            hit, slot = hit[ok], slot[ok]
            at = at[hit]
            alone[fits[hit]] |= width[fits[hit]] == n
            found.append((of[at], at - begin[at], at + n - begin[at], self.numbers[slot]))
        # bytes of characters that are no piece by themselves
        at = np.flatnonzero(~np.repeat(alone, width))
        found.append((of[at], at - begin[at], at + 1 - begin[at], np.asarray(self.by_byte)[data[at]]))
        u, a, b, i = (np.concatenate(x) for x in zip(*found))
        order = np.argsort((first[u] + u + b) * (self.longest + 1) + (b - a))
        return u[order], a[order], b[order], i[order]

    def _forward(self, data, first, lengths):
        """Edges, their scores, each unit's first node and every node's best score from its unit's start."""
        u, a, b, i = self.edges(data, first, lengths)
        score = self.scores[i]
        base = first + np.arange(len(first))
        best = np.full(int((lengths + 1).sum()), -np.inf)
        best[base] = 0.0
        by_end = np.argsort(b.astype(np.uint16) if b.max() < 65536 else b, kind="stable")
        cuts = np.searchsorted(b[by_end], np.arange(1, int(b.max()) + 2))
        start, end = base[u] + a, base[u] + b
        for k in range(len(cuts) - 1):
            e = by_end[cuts[k] : cuts[k + 1]]
            way, to = best[start[e]] + score[e], end[e]
            new = np.flatnonzero(np.diff(to, prepend=-1))  # edges into a node stand together
            best[to[new]] = np.maximum.reduceat(way, new)
        return u, a, b, i, score, base, best, start, end

    def search(self, data, first, lengths):
        """The n_best paths of each unit, best first: how many each unit has, their scores, their numbers of ids, the ids end to end."""
        u, a, b, i, score, base, best, start, end = self._forward(data, first, lengths)
        edge_of = np.searchsorted(end, np.arange(len(best) + 1))  # edges into a node
        found = []  # of paths: unit, score, number of ids, ids
        short = np.flatnonzero(lengths <= HEAP_BYTES)
        short = short[np.argsort(lengths[short], kind="stable")]
        room = np.cumsum(8 * lengths[short] * self.n_best)
        for part in np.split(short, np.flatnonzero(np.diff(room // QUEUE_PLACES)) + 1):
            if len(part):
                found.append(self._in_step(part, lengths, i, score, base, best, start, edge_of))
        cut = np.searchsorted(u, np.arange(len(lengths) + 1))
        for k in np.flatnonzero(lengths > HEAP_BYTES).tolist():
            p, q, at = cut[k], cut[k + 1], base[k]
            paths = self._backward(int(lengths[k]), *(x[p:q].tolist() for x in (a, b, i, score)), best[at : at + lengths[k] + 1].tolist())
            found.append((np.full(len(paths), k), np.array([s for s, _ in paths]), np.array([len(ids) for _, ids in paths]), np.concatenate([np.array(ids, np.int64) for _, ids in paths])))
        unit, scores, count, ids = (np.concatenate(x) for x in zip(*found))
        begin = np.cumsum(count) - count
        order = np.argsort(unit, kind="stable")
        unit, scores, count = unit[order], scores[order], count[order]
        to = np.cumsum(count) - count
        ids = ids[np.arange(count.sum()) + np.repeat(begin[order] - to, count)]
        return np.bincount(unit, minlength=len(lengths)), scores, count, ids

    def _in_step(self, units, lengths, ids, score, base, best, start, edge_of):
        """A* over all units in step; each step takes the best open node of every unit, the one that was put in first if several are."""
        n = len(units)
        goal = base[units] + lengths[units]
        # what was ever put into a queue: its node, the score of the way to it, the entry it came from, the edge taken
        node, way, parent, edge = goal, np.zeros(n), np.full(n, -1), np.full(n, -1)
        queue, entry = np.full((n, 8), -np.inf), np.zeros((n, 8), np.int64)
        queue[:, 0], entry[:, 0] = best[goal], np.arange(n)
        fill, got = np.ones(n, np.int64), np.zeros(n, np.int64)
        active, out = np.arange(n), []
        while len(active):
            slot = np.argmax(queue[active], axis=1)
            bound = queue[active, slot]
            open_ = bound > -np.inf
            active, slot, bound = active[open_], slot[open_], bound[open_]
            taken = entry[active, slot]
            queue[active, slot] = -np.inf
            done = node[taken] == base[units[active]]
            if done.any():
                out.append((active[done], bound[done], taken[done]))
                got[active[done]] += 1
            on, taken = active[~done], taken[~done]
            count = edge_of[node[taken] + 1] - edge_of[node[taken]]
            at = np.cumsum(count) - count
            of = np.repeat(np.arange(len(on)), count)
            e = np.arange(count.sum()) + np.repeat(edge_of[node[taken]] - at, count)
            far = way[taken][of] + score[e]
            most = int((fill[on] + count).max(initial=0))
            if most > queue.shape[1]:
                wider = max(most, 2 * queue.shape[1]) - queue.shape[1]
                queue, entry = np.pad(queue, ((0, 0), (0, wider)), constant_values=-np.inf), np.pad(entry, ((0, 0), (0, wider)))
            place = fill[on][of] + np.arange(len(e)) - at[of]
            queue[on[of], place] = far + best[start[e]]
            entry[on[of], place] = len(node) + np.arange(len(e))
            fill[on] += count
            node, way, parent, edge = (np.concatenate(x) for x in ((node, start[e]), (way, far), (parent, taken[of]), (edge, e)))
            active = active[got[active] < self.n_best]
        who, scores, last = (np.concatenate(x) for x in zip(*out))
        # the ids of a path, from its start: an entry's edge stands in front of its parent's
        walk, at = [], np.arange(len(last))
        while len(at):
            some = parent[last] >= 0
            at, last = at[some], last[some]
            walk.append((at, ids[edge[last]]))
            last = parent[last]
        path = np.concatenate([x for x, _ in walk])
        step = np.concatenate([np.full(len(x), k) for k, (x, _) in enumerate(walk)])
        return units[who], scores, np.bincount(path, minlength=len(who)), np.concatenate([x for _, x in walk])[np.lexsort((step, path))]

    def segment(self, units: list[bytes]) -> list[list[tuple[float, list[int]]]]:
        """The n_best segmentations (score, ids) of each unit, best first."""
        lengths = np.array([len(x) for x in units])
        paths, scores, counts, ids = self.search(np.frombuffer(b"".join(units), np.uint8), np.cumsum(lengths) - lengths, lengths)
        each = list(zip(scores.tolist(), (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1]))))
        cut = np.concatenate([[0], np.cumsum(paths)]).tolist()
        return [each[a:b] for a, b in zip(cut, cut[1:])]

    def _backward(self, length, starts, ends, ids, scores, best):
        """A* from the end of a unit: the way so far plus the exact score of what is left in front."""
        into = [[] for _ in range(length + 1)]
        for a, b, i, s in zip(starts, ends, ids, scores):
            into[b].append((a, i, s))
        found, serial = [], 0
        heap = [(-best[length], 0, length, 0.0, ())]
        while heap and len(found) < self.n_best:
            bound, _, node, way, tail = heapq.heappop(heap)
            if node == 0:
                path = []
                while tail:
                    path.append(tail[0])
                    tail = tail[1]
                found.append((-bound, path))
                continue
            for a, i, s in into[node]:
                if best[a] > -np.inf:
                    serial += 1
                    heapq.heappush(heap, (-(way + s + best[a]), serial, a, way + s, (i, tail)))
        return found


class _Known:
    """Units seen by a task: bytes to number; by number the paths, best first; by path its score and its ids."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.first, self.paths, self.begin, self.count = (np.zeros(0, np.int64) for _ in range(4))
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int32)

    def add(self, units: list[bytes], paths, scores, counts, ids):
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.first = np.concatenate([self.first, len(self.score) + np.cumsum(paths) - paths])
        self.paths = np.concatenate([self.paths, paths])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
        self.count, self.score, self.ids = np.concatenate([self.count, counts]), np.concatenate([self.score, scores]), np.concatenate([self.ids, ids.astype(np.int32)])

    def losses(self, k: int) -> list[float]:
        """By how much each path of a unit after the best falls short of it."""
        a, n = self.first[k], self.paths[k]
        return (self.score[a] - self.score[a + 1 : a + n]).tolist()

    def path(self, k: int, nth: int) -> np.ndarray:
        p = self.first[k] + nth
        return self.ids[self.begin[p] : self.begin[p] + self.count[p]]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct unit and the number of every unit among those. Units stand end to end; hashes only propose, bytes decide."""
    _, where, inverse = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths, like = ends - starts, where[inverse]
    if np.array_equal(lengths, lengths[like]) and np.array_equal(data[np.arange(len(data)) + np.repeat(starts[like] - starts, lengths)], data):
        return where, inverse
    raw, seen, number = data.tobytes(), {}, []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        number.append(seen.setdefault(raw[a:b], (len(seen), k))[0])
    return np.array([k for _, k in seen.values()]), np.array(number)


def _texts_of(pieces, by_byte) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, and by id where each begins and how long it is."""
    text = {i: p for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(by_byte)}
    each = [text.get(i, b"") for i in range(max(text) + 1)]
    lengths = np.array([len(t) for t in each])
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(lengths) - lengths, lengths


def _spell(texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the pieces end to end, and where each piece's begin (one more at the end)."""
    flat, begin, lengths = texts
    n = lengths[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], n)], total


def _encode(shared, n_best: int, verify: bool = False):
    def run(batches):
        lattice, known = Lattice(*shared.value, n_best), _Known()
        texts = _texts_of(*shared.value[:2])
        for batch in common.slices(batches, "__marked", SLICE_BYTES):
            data, off = common.utf8(batch.column(batch.schema.get_field_index("__marked")))
            starts, ends, first = lattice.split(data, off)
            if len(known.number) > KEPT_UNITS:
                known = _Known()
            where, inverse = _distinct(data, starts, ends)
            raw = data.tobytes()
            keys = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            new = [x for x in keys if x not in known.number]
            if new:
                lengths = np.array([len(x) for x in new])
                known.add(new, *lattice.search(np.frombuffer(b"".join(new), np.uint8), np.cumsum(lengths) - lengths, lengths))
            slot = np.array([known.number[x] for x in keys], np.int64)
            top = known.first[slot]  # each unit's best path
            count = known.count[top][inverse]
            total = np.concatenate([[0], np.cumsum(count)])
            at = np.arange(total[-1]) + np.repeat(known.begin[top][inverse] - total[:-1], count)
            offsets = total[first]
            best = np.concatenate([[0.0], np.cumsum(known.score[top][inverse])])
            scores = best[first[1:]] - best[first[:-1]]
            out = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(known.ids[at])), pa.array(np.diff(offsets)), pa.array(scores)]
            names = [*batch.schema.names[:-1], "ids", "n_pieces", "score"]
            if n_best > 1:
                more = known.paths[slot] > 1
                near = np.full(len(slot), np.inf)
                near[more] = known.score[top[more]] - known.score[top[more] + 1]
                near, ids = near[inverse], known.ids[at]
                nth, others, owner, of_text = [], [], [], np.zeros(batch.num_rows + 1, np.int64)
                for r, (a, b, s) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), scores.tolist())):
                    most = near[a:b]
                    own = np.argpartition(most, n_best - 2)[: n_best - 1] if len(most) >= n_best else np.arange(len(most))
                    own = a + np.sort(own)
                    found = _text_choices([known.losses(int(slot[inverse[u]])) for u in own], n_best)
                    nth.append([s - g for g, _ in found])
                    for _, choice in found:
                        path, done = [], total[a]
                        for u, which in zip(own.tolist(), choice):
                            if which:
                                path += [ids[done : total[u]], known.path(int(slot[inverse[u]]), which)]
                                done = total[u + 1]
                        others.append(np.concatenate([*path, ids[done : total[b]]]))
                        owner.append(r)
                    of_text[r + 1] = len(others)
                flat = np.concatenate(others) if others else np.zeros(0, np.int32)
                other_ends = np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(other_ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                out += [pa.array(nth, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), lists)]
                names += ["next_scores", "next_ids"]
            if verify:
                spelt, total = _spell(texts, known.ids[at])
                ends = total[offsets]
                same = np.array_equal(ends, off) and np.array_equal(spelt, data)
                good = np.full(batch.num_rows, True) if same else np.array([bytes(spelt[a:b]) == bytes(data[c:d]) for a, b, c, d in zip(ends, ends[1:], off, off[1:])])
                if n_best > 1:  # the others too
                    spelt, ends = _spell(texts, flat)
                    ends = ends[other_ends]
                    for r, a, b in zip(owner, ends.tolist(), ends[1:].tolist()):
                        good[r] &= np.array_equal(spelt[a:b], data[off[r] : off[r + 1]])
                out.append(pa.array(good))
                names.append("decodes")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _text_choices(unit_gaps: list[list[float]], n_best: int) -> list[tuple[float, tuple[int, ...]]]:
    """Least n_best - 1 losses against the best text, with the segmentation that each unit has there (0: its best)."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for gaps in unit_gaps:
        sums = heapq.nsmallest(n_best, [(s + g, (*c, k)) for s, c in sums for k, g in enumerate([0.0, *gaps])])
    return sums[1:]


def encode_pieces(docs: DataFrame, n_best: int = 1, model: str = MODEL, verify: bool = False, keep: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those named in keep), with ids array<int>, n_pieces long, score double; with n_best > 1 next_scores array<double>, next_ids array<array<int>>.

    verify adds decodes: whether the ids (and all next_ids) spell the text again, compared where they are made.

    ids segment the whole text best; next_scores and next_ids are the scores and ids of the segmentations after it (fewer if
    the lattice has fewer). A space stands before the text, as the model wants it. Null and empty texts have no pieces and score 0,
    texts of any length are encoded whole. Of paths of equal scores the one found first comes first, alike in every run.
    Rows are kept as they are, repeated ones too; columns of docs with these names are replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))  # the model's vocabulary
    kept = (docs if keep is None else docs.select(*keep)).drop("ids", "n_pieces", "score", "next_scores", "next_ids", "decodes")
    names = kept.columns
    rows = docs.withColumn("__marked", F.when(F.length("text") > 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.lit(""))).select(*names, "__marked")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    more = ", next_scores array<double>, next_ids array<array<int>>" if n_best > 1 else ""
    more += ", decodes boolean" if verify else ""
    return common.in_arrow(rows, _encode(shared, n_best, verify), f"{schema}, ids array<int>, n_pieces long, score double{more}")


def _decode(shared):
    def run(batches):
        texts = _texts_of(*shared.value[:2])
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                ids = batch.column(batch.schema.get_field_index("ids"))
                spelt, total = _spell(texts, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                counts = np.array([len(x) if x.is_valid else 0 for x in ids])
                ends = total[np.concatenate([[0], np.cumsum(counts)])]
                raw = spelt.tobytes()
                out = [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]  # without the space in front
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode_pieces(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of coded(ids array<int>) and decoded string: exactly the text that was encoded (null: empty)."""
    shared = coded.sparkSession.sparkContext.broadcast(load_pieces(model))
    kept = coded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return common.in_arrow(kept, _decode(shared), f"{schema}, decoded string")


#: What a lossless round trip returns.
DECODED_SQL = """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS decoded_sha256
FROM documents
"""
