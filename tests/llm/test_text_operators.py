"""Operators on documents against plain versions, on a small table, an odd one and an empty one."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlake.llm import jaccard, licences, mixing, pieces, quality, sharding, substrings, suffixes, toxicity


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_substrings(request, which):
    docs = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    assert got == brute.substrings(pairs(docs))


def test_substrings_repeated_rows_and_nulls(spark, odd_rows):
    text = odd_rows[3][1]
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(docs).collect())
    n = len(text.split())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, n)]


def test_substrings_come_from_the_paths(spark, documents, monkeypatch):
    """Stretches of several documents make one path, spans are read off its rows, and without the compaction the result is wrong."""
    a, b, c = ([f"{n}{i}" for i in range(40)] for n in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(b[5:] + c)), (3, " ".join(a + b + c)), (4, " ".join(c + a)), (5, " ".join(b[10:] + c[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.substrings(rows)
    run = lambda d: {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(d).collect()}
    assert run(docs) == want
    paths = substrings.repeated_paths(docs.select(F.col("doc_id").alias("__row"), F.col("doc_id").alias("__ord"), "text")).collect()
    assert {(p.row, p.src) for p in paths} >= {(2, 1), (3, 1), (3, 2), (5, 1), (5, 2)} and len({p.path for p in paths if p.row == 3}) < sum(p.row == 3 for p in paths)
    kept = substrings._compacted

    def flat(edges):
        placed, runs = kept(edges)
        return placed.withColumns({"path": F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).alias("run")), "pos": F.lit(0).cast("long")}), runs

    monkeypatch.setattr(substrings, "_compacted", flat)
    assert run(docs) != want


def test_strip_repeats_keeps_columns(odd):
    got = {r.doc_id: r for r in substrings.strip_repeats(odd).collect()}
    assert 5 not in got and got[4].text == [t for i, t in pairs(odd) if i == 4][0] and got[9].text == "other begin other end" and got[9].size == "clash" and got[9].n_chars == len(got[9].text)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_suffixes(request, which):
    docs = request.getfixturevalue(which)
    rows = [(i, t) for i, t in pairs(docs) if len(t or "") < 30_000]
    docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 30_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_suffixes(docs).collect()}
    assert got == brute.suffixes(rows)


def test_suffixes_split_hot_anchors(spark, monkeypatch):
    import random

    rng = random.Random(5)
    core = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(150))) + core[rng.randrange(40) : 120 + rng.randrange(40)] + str(i) * 30) for i in range(60)]
    monkeypatch.setattr(suffixes, "HOT_PIECES", 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.suffixes(rows)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for t in range(24):
        x = rng.integers(1, [3, 5, 257][t % 3], rng.integers(1, 300))
        x = np.concatenate([x, [0], x, [0]]) if t % 2 else x
        order, _ = suffixes.suffix_order(x.astype(np.uint16), 100)
        want = sorted(range(len(x)), key=lambda i: tuple(x[i : i + 100]))
        assert sorted(order) == list(range(len(x)))
        assert all(tuple(x[a : a + 100]) == tuple(x[b : b + 100]) for a, b in zip(order, want))


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_jaccard(request, which):
    docs = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute.jaccard(pairs(docs))


def test_jaccard_blocks_and_edges(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(90):  # copies at all distances, in clusters of several blocks
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[: 40 + i])) for i in range(25)]
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard, "BLOCK_COLUMNS", 64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_keep_first_with_repeated_rows(spark, odd_rows):
    text = odd_rows[3][1]
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, None, "d"), (3, None, "d")], "doc_id long, text string, __x string")
    got = jaccard.keep_first(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 3]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mixing(request, which):
    docs = request.getfixturevalue(which)
    rows = mixing.mix_sources(docs, range_rows=7).collect()
    assert sorted((r.doc_id, r["size"]) for r in rows) == sorted((i, len(brute.words(t))) for i, t in pairs(docs))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total, names = sum(r["size"] for r in rows), sorted(by, key=lambda s: (s is None, s))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    full = set()
    while True:  # targets by repeated resharing
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        target = 3 * sizes[s] if s in full else share[s]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == sizes[s] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 3 * r["size"] for r in by[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect())) or which == "odd"


def test_mix_applied(odd):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(odd).collect()}
    got = {}
    for r in mixing.apply_mix(odd).select("doc_id", "text", "n_chars", "size").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
        assert r["size"] == "clash" and r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}


def test_sharding(documents, odd):
    for docs, shards in ((documents, 24), (odd, 3)):
        rows = sharding.shard_documents(docs, shards).collect()
        text = dict(pairs(docs))
        assert sorted(r.doc_id for r in rows) == sorted(text)
        assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    rows = sharding.shard_documents(documents, 4).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_sharding_keeps_equal_texts_together(spark):
    texts = [f"text {i} " + "word " * (i % 7) for i in range(400)]
    rows = [(k, texts[k % 400]) for k in range(1200)] + [(5000 + k, "hot copy") for k in range(1500)] + [(None, None), (None, None), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 24).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"hot copy")
    assert len(got) == len(rows) and all(len(s) == 1 for c, s in by.items() if c != hot)
    assert max(by[hot]) - min(by[hot]) + 1 == len(by[hot]) > 1  # above a tenth of a shard: neighbouring shards
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.35 * sum(sizes) / 24


def test_quality_scores_in_rounds(spark, monkeypatch):
    """No round of scoring moves all texts, every text is scored in one, and the rounds don't show in the scores."""
    docs = spark.createDataFrame([(i, f"text {i} says {i * 7919 % 1000} things of w{i % 13}. " * 3, "en") for i in range(300)], "doc_id long, text string, lang string")
    monkeypatch.setattr(quality, "SLICE_TEXT", 500)
    written, write = [], quality.materialize

    def seen(df, name):
        made = write(df, name)
        written.extend([{r.doc_id for r in made.collect()}] if name.startswith("quality-scores") else [])
        return made

    monkeypatch.setattr(quality, "materialize", seen)
    scores = {r.doc_id: r for r in quality.measured(docs).collect()}
    assert len(written) > 1 and max(map(len, written)) < 200
    assert sum(map(len, written)) == len(scores) == 300
    monkeypatch.setattr(quality, "ROUNDS", 1)
    assert {r.doc_id: r for r in quality.measured(docs).collect()} == scores


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_quality_base(request, which):
    docs = request.getfixturevalue(which)
    rows = quality.score_quality(docs).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: brute.quality(t) for i, t in pairs(docs)}
    assert not any(r.kept and r.base_failed for r in rows)


def plain_kneser_ney(texts, order):
    """Probabilities of every gram by the textbook, with dictionaries."""
    from collections import Counter, defaultdict

    top = Counter(p[i : i + order] for t in texts for p in [" " * (order - 1) + t] for i in range(len(p) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    lower = defaultdict(lambda: 1 / (len(levels[1]) + 1))
    for k in range(1, order + 1):
        n = [max(1, sum(v == x for v in levels[k].values())) for x in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, *(min(j, max(0.05, j - (j + 1) * y * n[j] / n[j - 1])) for j in (1, 2, 3))]
        total, lost = Counter(), Counter()
        for g, v in levels[k].items():
            total[g[:-1]] += v
            lost[g[:-1]] += d[min(v, 3)]
        lower = {g: (v - d[min(v, 3)]) / total[g[:-1]] + lost[g[:-1]] / total[g[:-1]] * (lower[g[1:]] if k > 1 else lower[g]) for g, v in levels[k].items()}
    return lower


def test_perplexity_against_the_textbook(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_TEXT", 200)
    texts = ["the cat sat on the mat", "a cat and a hat", "tom the cat", "Привет мир, привет кот", "日本語のテキスト", "x", "the   Cat\n77 sat"] * 3
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    seen = [" ".join("".join("0" if c.isdigit() else c for c in t.lower()).split()) for t in texts]
    p = plain_kneser_ney(seen, quality.ORDER)
    for r in quality.measured(docs).collect():
        padded = " " * (quality.ORDER - 1) + seen[r.doc_id]
        want = -sum(np.log(p[padded[i : i + quality.ORDER]]) for i in range(len(seen[r.doc_id]))) / len(seen[r.doc_id])
        assert r.log_perplexity == pytest.approx(want, abs=1e-6) and r.n_model == len(seen[r.doc_id])


def test_salad_goes_and_prose_stays(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice(["ka", "to", "mi", "re", "su", "no"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)), "xx") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice("qzxjvwkpfy") for _ in range(5)) for _ in range(120)), "xx") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(5))
    assert quality.score_quality(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string").limit(0)).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_licences(request, which):
    docs = request.getfixturevalue(which)
    rows = licences.scan_licences(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: brute.licences(t) for i, t in pairs(docs)}
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_templates(spark):
    texts = ["foo Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction bar",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "permission granted free", "Licensed under CC BY-NC 4.0.",
             "mit license mit license"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (None, texts[3])], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.labels, r.n_base) for r in licences.scan_licences(docs).collect())
    assert got == [(False, 0, "bsd", 0), (False, 0, "mit", 0), (False, 1, "bsd", 0), (False, 2, "", 0), (False, 3, "cc-by,cc-by-nc-4.0", 1), (False, 4, "mit", 2), (True, 0, "cc-by,cc-by-nc-4.0", 1)]


def test_pieces_round_trip(documents, odd):
    for docs in (documents, odd):
        coded = pieces.encode_pieces(docs, n_best=2, verify=True)
        rows = pieces.decode_pieces(coded).select("doc_id", "text", "decoded", "decodes", "n_pieces", "next_scores", F.col("score").cast("double").alias("s")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.decoded == (r.text or "") and r.decodes and (r.n_pieces > 0) == bool(r.text)
            assert all(x <= r.s for x in r.next_scores or [])


def test_pieces_against_all_paths():
    lattice = pieces.Lattice(*pieces.load_pieces(), 4)
    for unit in [b" hello", b"  the", " é▁x".encode(), b" \x01ab", b" mentaux", b"a", "日本".encode()]:
        data = np.frombuffer(unit, np.uint8)
        edges = {}
        for _, a, b, i in zip(*lattice.edges(data, np.array([0]), np.array([len(unit)]))):
            edges.setdefault(int(a), []).append((int(b), int(i)))
        found = []

        def walk(p, s, path):
            if p == len(unit):
                found.append((s, path))
            for q, i in edges.get(p, []):
                walk(q, s + lattice.scores[i], [*path, i])

        walk(0, 0.0, [])
        found.sort(key=lambda x: -x[0])
        best = lattice.segment([unit])[0]
        assert [round(s, 6) for s, _ in best] == [round(s, 6) for s, _ in found[:4]] and best[0][1] == found[0][1]
        assert best[0][0] == pytest.approx(found[0][0])
        heap = lattice._backward(len(unit), *zip(*[(a, b, i, lattice.scores[i]) for a, es in sorted(edges.items()) for b, i in es]), lattice._forward(data, np.array([0]), np.array([len(unit)]))[6].tolist())
        assert [round(s, 6) for s, _ in heap] == [round(s, 6) for s, _ in best] and heap[0][1] == best[0][1]


def thue_morse(pair, doublings):
    a, b = pair
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("pair", ["ab", "xy"])
def test_texts_that_polynomials_cannot_tell_apart(spark, pair):
    made = [w for n in (10, 11) for w in thue_morse(pair, n)]
    docs = spark.createDataFrame([*enumerate(made), *((10 + i, w + "\n" + v) for i, (w, v) in enumerate([(made[0], made[1]), (made[2], made[3])]))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in pieces.encode_pieces(docs, verify=True).collect()}
    assert all(r.decodes for r in got.values()) and len({tuple(r.ids) for r in got.values()}) == 6
    rows = pairs(docs.withColumn("lang", F.lit("en")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == brute.jaccard(rows)
    assert {r.doc_id: r.n_dup_lines for r in quality.score_quality(docs.withColumn("lang", F.lit("en"))).collect()} == {i: 0 for i, _ in rows}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_suffixes(docs).collect()} == brute.suffixes(rows)


def test_toxicity_learns(spark):
    import random

    rng = random.Random(1)
    plain, bad = [f"word{i}" for i in range(60)], ["horrid", "nasty", "vilely"]
    rows, labels = [], []
    for i in range(900):
        w, y = [rng.choice(plain) for _ in range(rng.randrange(20, 200))], i % 4 == 0
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "x", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    rows += [(2000, None), (2001, ""), (2002, "horrids"), (None, "word1")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect_toxicity(docs, known).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right >= 0.95 * len(held)
    assert got[2002].predicted == 1 and got[2000].score == got[2001].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.detect_toxicity(documents, none).collect()} == {0}


def test_empty_tables(spark, empty):
    assert substrings.dedup_substrings(empty).count() == 0
    assert suffixes.dedup_suffixes(empty).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert sharding.shard_documents(empty, 24).count() == 0
    assert quality.score_quality(empty).count() == 0
    assert licences.scan_licences(empty).count() == 0
    assert pieces.encode_pieces(empty, n_best=2).count() == 0
    assert toxicity.detect_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_substrings_settle_collisions_by_words(documents, odd):
    for docs, bits in ((documents, 14), (odd, 6)):
        docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 30_000)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs, bits=bits).collect()}
        assert got == brute.substrings(pairs(docs))
