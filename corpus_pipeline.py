"""From documents to token files in stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import fresh_folder, table
from volspark.llm.decontamination import without_contaminated
from volspark.llm.language import UNKNOWN, learn, predict_language
from volspark.llm.mixing import mixed_documents
from volspark.llm.near_dedup import repeats, text_keys, unique_components
from volspark.llm.token_output import read_shards, write_shards
from volspark.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS
from volspark.plans.storage import known_bytes, measured


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no language gets half of the odds for."""
    seen = predict_language(docs.withColumn("_all", F.struct(*docs.columns)).select("_all", "text"), learn(docs), ["_all"])
    return seen.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= 0.5) | ~F.col("ambiguous"))).select("_all.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) the document with the smallest id stays.

    Rows without an id stay.  Where ids repeat, rows equal in id and text become one, and each text of an id is judged on its
    own, so a unique text stays whatever else its id carries.
    """
    key = "doc_id"
    if repeats(docs):
        key = "_key"
        docs = docs.withColumn(key, text_keys(docs))
        docs = docs.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))
    seen = unique_components(docs.select(key, "text"), id_col=key)
    gone, counts = measured(seen.filter(F.col(key).isNotNull() & ~F.col("kept")).select(key).distinct(), "near-gone")
    small = counts["rows"] <= BROADCAST_ROWS and (known_bytes(gone) or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*(c for c in docs.columns if c != "_key"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of ids; a row per document (copies each), read back from them."""
    import public_tokenizers

    path = fresh_folder(spark, "pipeline-shards")
    write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path)


STAGES = [
    ("language id", keep_known_languages),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("token output", write_token_ids),
]

# The learned languages and the tilted rates are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
