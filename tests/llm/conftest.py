import pytest

LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
COPY = "One exact copy of a text that has enough words to be found by all of the windows that there are in it today"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, blanks, copies, a passage, repeated rows, a very long text, ties."""
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, COPY, "en", "b"), (5, COPY, "en", "b"), (6, COPY + " more", "en", "c"),
        (7, LONG, "en", "hot"), (8, "start " + PASSAGE + " end", "fr", "hot"), (9, "other begin " + PASSAGE + " other end", "fr", "hot"), (10, "x", "de", None),
        (11, "x", "de", "é"), (12, "Released under the MIT License. The MIT license. GNU General Public License; cc BY", "en", "z"), (13, "aaaa " * 300, "en", "z"),
        (14, "naïve ünïcode ▁ piece \x00 nul 𝄞 end", "fr", "z"), (15, PASSAGE + "\n" + PASSAGE, "en", "z"), (16, "tab\tsep\vform\fret\rnew\nline", "en", "b"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with columns whose names clash with what operators use inside."""
    more = ["size", "target", "node", "n", "row", "hits", "score", "shard", "spans", "ids", "root"]
    rows = [(*r, len(r[1] or ""), *["clash"] * len(more)) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in more)).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
