"""The column functions over streams: each row stands alone, so there is no state and no watermark.

Matches across rows are not looked for. Counts by pattern keep one number a pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandex.operators import multi


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, with the columns of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_matches(stream: DataFrame, patterns: list[str], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, idx) of the rows that hold one of the patterns."""
    found = stream.select(key, multi.first(F.col(text_col), patterns).alias("m")).where("m is not null")
    return found.select(key, F.col("m.start").alias("start"), F.col("m.idx").alias("idx"))


def counts_by_pattern(stream: DataFrame, patterns: list[str], text_col: str = "text") -> DataFrame:
    """(idx, n): how often each pattern has occurred so far."""
    return stream.select(F.explode(multi.every(F.col(text_col), patterns)).alias("m")).groupBy(F.col("m.idx").alias("idx")).agg(F.count("*").alias("n"))


def write_available(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to Parquet files, exactly once for each input file."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
