import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with further columns whose names operators use for their own results."""
    def made(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA).repartition(3)
    return made


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, LONG), (7, LONG + " end"),
         (8, "don't <|endoftext|> stop"), (9, "Straße ΟΔΟΣ İx ½ naïve 日本語"), (10, "a b c d"), (None, "no id here")]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture(scope="session")
def sample_rows(spark):
    from tickloom.llm.common import table
    return [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
