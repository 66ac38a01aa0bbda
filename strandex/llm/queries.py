"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, language, packing, quality, substring_dup, url_filter, warc
from .near_dup import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, num=80, den=100)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


#: Fixed value: both texts of conversation -7.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.read_back(chat.chat_windows(turns.unionByName(more))).withColumnRenamed("conv", "conv_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_by_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The rules of op5.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def fold(n: int):
    """The remainder by n of the CRC-32 of the document's id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op7_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both documents of each pair have a row; first marks the one that holds the passage first."""
    found = substring_dup.repeated_passages(table(spark, sf_dir, "documents"))
    both = F.array(
        F.struct(F.col("id").alias("doc_id"), F.col("leader").alias("other_id"), "start", "end", F.col("leader_start").alias("other_start"), F.col("leader_end").alias("other_end"), F.lit(False).alias("first")),
        F.struct(F.col("leader").alias("doc_id"), F.col("id").alias("other_id"), F.col("leader_start").alias("start"), F.col("leader_end").alias("end"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.lit(True).alias("first")),
    )
    return found.select(F.explode(both).alias("p"), "identity").select("p.*", "identity")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.train(docs, labels, fold(5) != 0))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, fold(3) != 1))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", (fold(3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_fingerprint": op3_fingerprint,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_substring_dup": op7_substring_dup,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dup": op10_minhash_near_dup,
}
