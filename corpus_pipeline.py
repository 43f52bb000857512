"""The corpus pipeline: toxicity, near copies, repeated passages, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`. A stage begins by releasing the tables that no DataFrame reads any
more, among them what the stage before it wrote on its way; results that the caller still holds keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merchlake.llm import jaccard, mixing, pieces, substrings, toxicity
from merchlake.llm.common import materialize, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not call toxic."""
    release(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, docs.columns, below=0.5).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard 0.8 or more) the one of smallest doc_id; blank ones stay."""
    release(spark)
    return jaccard.keep_first(docs, n=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that a smaller document has; what loses all of its words goes."""
    release(spark)
    return substrings.strip_repeats(docs)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the last one cut at the budget."""
    release(spark)
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids and scores of their best segmentation and of the next one, held against the text."""
    release(spark)
    return pieces.encode_pieces(docs, n_best=2, verify=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_by_source),
    ("piece encoding", encode),
]

#: A trained classifier and a tokenizer's lattice are nothing that SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
