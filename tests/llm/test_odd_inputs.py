"""Repeated rows, null doc_ids, very long texts, clashing columns and empty tables, for the operators and the whole pipeline."""

import brute
import pytest
from pyspark.sql import functions as F

from merchlake.llm import common, jaccard, licences, mixing, pieces, quality, sharding, substrings, suffixes, toxicity


LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
COPY = "One exact copy of a text that has enough words to be found by all of the windows that there are in it today, and bytes"


@pytest.fixture(scope="module")
def crowd(spark):
    """Rows that repeat, rows without a doc_id, one very long text, columns named like those inside operators."""
    rows = [(1, COPY, "en", "a"), (1, COPY, "en", "a"), (1, COPY, "en", "a"), (None, COPY + " x", "en", "a"), (None, None, None, None), (None, None, None, None), (2, LONG, "en", "b"), (3, "", "de", "b"), (4, PASSAGE, "de", None), (None, PASSAGE + " end", "de", None)]
    names = ["gram", "slice", "key", "piece", "anchor", "label", "text_crc32", "__score", "run", "path"]
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix_sources(d), "toxicity": lambda s, d: toxicity.detect_toxicity(d, labels(s)), "substrings": lambda s, d: substrings.dedup_substrings(d), "pieces": lambda s, d: pieces.encode_pieces(d, n_best=2, verify=True, keep=["doc_id"]),
    "suffixes": lambda s, d: suffixes.dedup_suffixes(d), "jaccard": lambda s, d: jaccard.jaccard_components(d), "sharding": lambda s, d: sharding.shard_documents(d, 3), "quality": lambda s, d: quality.score_quality(d), "licences": lambda s, d: licences.scan_licences(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_is_answered(spark, crowd, name):
    run = OPERATORS[name]
    rows = [r.asDict() for r in run(spark, crowd).collect()]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r.doc_id) for r in crowd.collect())
    alike = [r for r in rows if r["doc_id"] == 1]
    if name == "sharding":
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3)) and len({r["shard"] for r in alike}) == 1
    elif name == "mixing":
        for s in (None, "a", "b"):
            assert abs(sum(r["taken"] for r in rows if r["source"] == s) - next(r["target"] for r in rows if r["source"] == s)) <= 0.5
    elif name == "suffixes":  # of repeated rows the one read first keeps its text
        assert sorted(r["n_removed"] for r in alike) == [0, len(COPY.encode()), len(COPY.encode())]
    elif name != "jaccard":
        assert len({str({k: v for k, v in r.items()}) for r in alike}) == 1
    else:
        assert {r["component_id"] for r in alike} == {1} and sum(r["__first"] for r in alike) == 1
    assert run(spark, crowd.limit(0)).count() == 0


def plain_strip(rows):
    """Texts without the 13-word windows that a smaller document has; what loses all words goes."""
    first, each, out = {}, {i: brute.words(t) for i, t in rows}, {}
    for i in sorted(each):
        for p in range(len(each[i]) - 12):
            first.setdefault(tuple(each[i][p : p + 13]), i)
    for i, t in rows:
        w, gone = each[i], set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def test_pipeline_against_plain_stages(spark, odd, documents, tmp_path):
    import corpus_pipeline as p
    from test_pipeline_stages import kept_by_five_words

    docs = odd.withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    known = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    pairs = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    stages = dict(p.STAGES)

    def done(name, d):
        return common.materialize(stages[name](spark, d, str(tmp_path)), "stage")

    calm = done("toxicity", docs)
    bad = {r.doc_id for r in toxicity.detect_toxicity(docs, known).where("predicted = 1").collect()}
    assert sorted(pairs(calm), key=str) == sorted((x for x in pairs(docs) if x[0] not in bad), key=str) and calm.columns == docs.columns
    single = done("n-gram jaccard join", calm)
    assert sorted(i for i, _ in pairs(single)) == kept_by_five_words(pairs(calm))
    stripped = done("substring dedup", single)
    assert dict(pairs(stripped)) == plain_strip(pairs(single))
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(stripped).collect() if r.taken}
    mixed = done("mixing sources", stripped)
    words = {}
    for i, t in pairs(mixed):
        words[i] = words.get(i, 0) + len(brute.words(t))
    assert words == taken and mixed.columns == docs.columns
    coded = done("piece encoding", mixed)
    assert pieces.decode_pieces(coded).where("decoded <> text").count() == 0 and coded.count() == mixed.count()
    assert sorted(pairs(p.run(spark, str(tmp_path))), key=str) == sorted(pairs(mixed), key=str)


def test_pipeline_over_nothing(spark, documents, tmp_path):
    import corpus_pipeline as p

    documents.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
