"""Training-corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import decontaminate as decontamination
from strandex.llm import language, near_dup, packing, substring_dup
from strandex.llm.common import scratch, unused
from strandex.runtime import scratch_scope

#: A document is rejected if the evidence for its likeliest language is under this share of a usual text's.
LEAST_EVIDENCE = 0.1
#: The languages that stay; None: all that are learnt.
WANTED: tuple[str, ...] | None = None
#: Near duplicates share at least NEAR of 100 parts of their distinct SHINGLE-word shingles.
SHINGLE, NEAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is learnt and wanted. Those without a letter or with a null text go, and those,
    foreign, scrambled or too short, that no learnt language fits.

    Without any labelled text no language can be learnt, and all with a letter stay. Null ids and repeated rows are
    judged by their texts alone; an empty table stays empty.
    """
    learn = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1
    return language.accepted(docs, language.train(docs, learn), LEAST_EVIDENCE, WANTED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near duplicates.

    Rows that repeat an id are one document for the groups. Of those that stay, equal rows stay once, and rows of other
    texts stay too; rows without an id all stay, and so do null and empty texts.
    """
    with scratch_scope() as keep:
        found = near_dup.near_duplicates(docs, k=SHINGLE, num=NEAR, den=100)
        found = keep(scratch(found.where("id is null or id = component").groupBy("id").agg(F.count("*").alias("rows"))))
    # the same join at every size: the kept ids grow with the input and are never broadcast
    kept = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(found["id"]), "left_semi")
    if found.where("rows > 1 and id is not null").isEmpty():
        return kept
    rest, row = [x for x in docs.columns if x not in ("doc_id", "text")], unused(docs, "_row")
    first = F.min(F.struct(*rest)) if rest else F.lit(None)
    one = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(first.alias(row)).select("doc_id", "text", *([f"{row}.*"] if rest else []))
    return one.select(docs.columns).unionByName(kept.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each repeated passage but at the document of the least id; documents left without a word by that go.

    Rows with a null id or text stay as they are; rows that repeat an id are never compared with each other, and
    each is cut where any of them repeats another document. An empty table stays empty.
    """
    with scratch_scope() as keep:
        found = keep(scratch(substring_dup.repeated_passages(docs)))
    return substring_dup.without_repeats(docs, found)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a word in 20 or more.

    Null and empty texts have no words and stay; null ids and repeated rows are judged by their texts alone. An empty
    benchmark drops nothing.
    """
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is the closing id alone; null ids and repeated rows are
    packed each; an empty table gives no pieces."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express the learnt model of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch_scope() as keep:
            docs = keep(scratch(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
