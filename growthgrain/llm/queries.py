"""The operators over the sample tables, as registered queries."""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthgrain.llm import alignment, chats, katz, language, mixing, packing, private, quality, simhash, substrings, syncmers, tries, warc
from growthgrain.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited_pairs(_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), ["doc_id"]).select("row.doc_id", "*").drop("row")


def op3_katz(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    learn = katz.training(F.col("doc_id"))
    return katz.scores(docs, learn, order=3).select(
        "row.doc_id",
        (~katz.training(F.col("row.doc_id"))).alias("held_out"),
        *["n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.held_out(F.col("doc_id"))
    return language.predict(docs, ~held_out).withColumn("held_out", held_out)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents")).select("row.doc_id", "*").drop("row")


def op6_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chats.collapse(_table(spark, folder, "conversations"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    warc.write_archives(_table(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives).drop("url")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), with_ids=False)


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats(_table(spark, folder, "documents")).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(_table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_tries(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_nodes(_table(spark, folder, "conversations"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return alignment.linked(docs).select("row.doc_id", "*").drop("row")


def op13_private(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return private.private_spans(docs).select(
        "row.doc_id",
        *[f"n_{kind}" for kind in private.KINDS],
        F.sha2(private.span_text(F.col("base")), 256).alias("base_sha256"),
        private.span_text(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_syncmers": op1_syncmers,
    "op2_mixing": op2_mixing,
    "op3_katz": op3_katz,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_chats": op6_chats,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_simhash": op10_simhash,
    "op11_tries": op11_tries,
    "op12_alignment": op12_alignment,
    "op13_private": op13_private,
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op5_quality": quality.SQL,
    "op6_chats": chats.SQL,
    "op7_warc": warc.SQL,
    "op9_substrings": substrings.SQL,
    "op11_tries": tries.SQL,
}
