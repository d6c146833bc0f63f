import os

import pytest

from tests.conftest import sf_dir, spark  # noqa: F401  the same session and tables


@pytest.fixture(scope="session")
def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path


@pytest.fixture(scope="session")
def rows(spark, sf_dir):  # noqa: F811
    """All documents as (doc_id, text), by id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def query(spark, sf_dir):  # noqa: F811
    from prefmine.llm.queries import QUERIES

    return lambda name: [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


LONG = "Lorem ipsum dolor sit amet. " * 8000  # 224 000 characters
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "A b c d e f."), (6, "A b c d e f."), (None, "no id here."), (7, LONG), (8, "x" * 50_000),
    (9, "é ü 漢字 😀 <|im_end|> <|endoftext|> ▁▁ a  b c"), (10, "| a | b | c\n| d | e | f"), (11, None), (12, "A b c d e f."),
]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in every column, empty, very long and repeated rows, ties, and columns whose names clash."""
    schema = "doc_id long, text string, score double, kept boolean, tokens array<int>, id string, rep long, ids string, n_tokens string, label string"
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in ODD], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
