import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns that clash with names an operator may use
        T.StructField("score", T.StringType()),
        T.StructField("_id", T.StringType()),
    ]
)

HARD_TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "one", "one two three", "Alpha beta gamma delta epsilon zeta", "ALPHA beta gamma delta epsilon zeta",
    "ÉTÉ été", "1234 5678 !!! ###", "日本語 テキスト です", "a<|endoftext|>b <|startoftext|>", "a\x1cb \u00a0 c\u0085d", "don't you'll 's 'T", "word " * 5000,
    "x" * 30000, "the quick brown fox jumps over the lazy dog. " * 20, "\\### Assistant: </turn> ok", "Der Hund und die Katze sind nicht hier, aber das Haus ist groß.",
    "Le chat et le chien ne sont pas dans la maison de mon père.", "İstanbul ΣΑΣ e\u0301 ﬁ", "🙂 👍🏽 emoji",
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and clashing extra columns."""
    rows = [(k, t, "en" if k % 3 else None, "a" if k % 2 else None, None, "s", "i") for k, t in enumerate(HARD_TEXTS)]
    rows += [rows[6], rows[6], (None, "no id here at all", "en", "b", 1, None, None), (None, None, None, None, None, None, None)]
    rows += [(3, "another text under the same id", "fr", "c", 5, "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
