"""Cross-tokenizer alignment against a plain version that encodes whole texts."""

import cProfile
import hashlib
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
from tokenizers import Tokenizer

from merchlake.llm import alignment

LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(20_000))
ODD = [
    None, "", " ", "  ", "a", " a  b ", "tabs\tand\nlines \n x", "<|endoftext|> <s> </s> <unk> <0x41>", "already ▁ marked", "naïve ünïcode 𝄞 \x00 nul", "x" * 3000, "é  b",
    "don't we'll  they've 12 345", "العربية 漢字 かな", "a　 b ​ c", LONG, "same same same", "same same same",
]


def plain(rows):
    """Every text encoded whole by the libraries themselves, tokens met by their byte ends."""
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in kept} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in kept)}
    found = []
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        left = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(left) == b"".join(right) == (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = [*accumulate(map(len, left))], [*accumulate(map(len, right))]
        shared = sorted({*ends_a} & {*ends_b})
        of_a, of_b = dict(zip(ends_a, x)), dict(zip(ends_b, y))
        links = [(of_a[e], of_b[e]) for e in shared]
        in_a, in_b = iter(zip(ends_a, x)), iter(zip(ends_b, y))
        groups = [",".join(_until(in_a, e)) + "|" + ",".join(_until(in_b, e)) for e in shared]
        found.append((doc_id, x, y, groups, links))
    counts = Counter(p for *_, links in found for p in links)
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    rows = [
        (i, len(x), len(y), len(g), len(p), sum(counts[q] == most[q[1]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for i, x, y, g, p in found
    ]
    return rows, counts


def _until(pairs, end):
    out = []
    for e, i in pairs:
        out.append(str(i))
        if e == end:
            return out
    return out


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, "one without an id"), (7, "a second seven"), (7, "a second seven")]


@pytest.mark.parametrize("slice_bytes", [alignment.SLICE, 5_000])
def test_alignment_is_that_of_whole_texts(spark, rows, slice_bytes):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, key string, slice string").repartition(5)
    want, counts = plain(rows)
    got = [tuple(r) for r in alignment.align_tokenizers(docs, slice_bytes=slice_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if slice_bytes < 10_000:
        pairs = {(r.a_id, r.b_id): r.n for r in alignment.count_pairs(docs, slice_bytes=slice_bytes).collect()}
        assert pairs == counts


def test_store_of_units_may_be_small(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    want = sorted(map(str, alignment.align_tokenizers(docs).collect()))
    monkeypatch.setattr(alignment, "STORE_UNITS", 5)
    assert sorted(map(str, alignment.align_tokenizers(docs, slice_bytes=1).collect())) == want


def test_no_documents(spark, empty):
    assert alignment.align_tokenizers(empty).collect() == [] and alignment.count_pairs(empty).collect() == []


def test_units_are_learnt_together():
    """Each unit as if it were learnt alone, those that its tokens don't spell too, and few calls a unit: its tokens are not gone through one by one."""
    with open(alignment.A_FILE, encoding="utf-8") as a, open(alignment.B_FILE, "rb") as b:
        vocabularies = alignment.byte_level_ranks(a.read()), b.read()
    together, alone = alignment.Aligner(*vocabularies), alignment.Aligner(*vocabularies)
    units = [f"word{i} unlikelihood" if i % 3 else f"{i}▁x" for i in range(999)]
    calls = cProfile.Profile()
    calls.runcall(together.learn, units)
    for unit in units:
        alone.learn([unit])
    assert (together.place, together.groups, together.sums, together.keys, together.offsets) == (alone.place, alone.groups, alone.sums, alone.keys, alone.offsets)
    assert {together.sums[4 * k + 3] for k in range(999)} == {0, 1}
    assert sum(x.callcount for x in calls.getstats()) < 25 * len(units)
