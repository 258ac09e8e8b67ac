import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def word_model():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in any column, empty and long texts, repeated rows, and columns named like those operators use."""
    long = "word " * 30_000
    rows = [
        (1, "plain text of five words", "en", 0.5, "x"), (1, "plain text of five words", "en", 0.5, "x"), (2, None, "de", None, None),
        (None, "text without an id", None, 1.0, "y"), (None, "text without an id", "en", 1.0, "y"), (3, "", "fr", 2.0, "z"),
        (4, "   \n\t ", "fr", 2.0, "z"), (5, long, "en", 0.0, "long"), (6, "1" * 20_000, None, 0.0, "digits"),
        (7, "É 𝔘 … “ß” 你好   x", "de", 0.0, "signs"),
    ]
    schema = "doc_id long, text string, lang string, score double, key string, fingerprint string, found string"
    return spark.createDataFrame([(*r, "f", "g") for r in rows], schema)
