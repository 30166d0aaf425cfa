"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, documents, folder of tables) and returns a DataFrame; all but
the last keep the columns of ``documents``, further ones included. Stage results are written
and read again. Texts are read whole, however long. An empty table gives no rows.
"""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from growthgrain.llm import mixing, packing, quality, simhash, substrings
from growthgrain.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on repetition reject go, those with a null or empty text
    among them; each repeated row is judged alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest ``doc_id``; of
    rows with one ``doc_id``, and of a group without any, the one with the smallest hash."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that a document with a smaller ``doc_id`` has go from the others, and
    documents of which nothing is left; a null ``doc_id`` is larger than all."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for; a null source is one of its own."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row for each piece of a document in one; a null ``doc_id`` stays."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprints, seeded hashes and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
