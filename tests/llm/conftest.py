import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, blanks, copies, repeated rows and columns with clashing names."""

    def make(*texts, first=0):
        rows = [(first + i, t, "x", i) for i, t in enumerate(texts)]
        schema = "doc_id BIGINT, text STRING, kept STRING, `a.b` BIGINT"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_model():
    return public_tokenizers.path("word_bpe_49k.json")
