"""Lines of files, by the octet reader's rule: the separator is a line feed only, and a file has one line more
than it has line feeds, so a final line feed is followed by an empty line.

read_lines() reads a file in one piece, which numbers its lines and gives their offsets; a file must fit in
a task. stream_lines() splits files among tasks at any size, without numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.functions.octets import to_string
from strandex.functions.single import octets
from strandex.runtime import ship


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def exploded(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line_no, line): line_no from 0."""
    return texts.select(key, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def starts(text: Column) -> Column:
    """How many characters, line feeds included, stand before each line: an array, by Arrow batches.

    Running sums of built-in array functions copy the array for each line.
    """
    ship()

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[int]:
            out, at = [0], 0
            while at := t.find("\n", at) + 1:
                out.append(at)
            return out

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(text)


def numbered(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line_no, line, offset): each text's lines by themselves, whether or not its key is another's too. Nothing is shuffled."""
    both = texts.select(key, F.posexplode(F.arrays_zip(split_lines(F.col(text_col)).alias("line"), starts(F.col(text_col)).alias("offset"))).alias("line_no", "l"))
    return both.select(key, F.col("line_no").cast("bigint").alias("line_no"), F.col("l.line").alias("line"), F.col("l.offset").alias("offset"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line, offset): line is text of one character a byte, offset the byte where it starts."""
    files = spark.read.format("binaryFile").load(path).select("path", octets(F.col("content")).alias("text"))
    return numbered(files, "path", "text")


def from_position(lines: DataFrame, offset: int) -> DataFrame:
    """The lines that a reader set to this offset still gives; the first one may be a line's rest."""
    rest = F.greatest(F.lit(offset) - F.col("offset"), F.lit(0)).cast("int")
    ends = F.col("offset") + F.length("line") >= offset
    return lines.where(ends).withColumn("line", F.substring("line", rest + 1, F.length("line"))).withColumn("offset", F.greatest("offset", F.lit(offset).cast("bigint")))


def line_octets(lines: DataFrame) -> DataFrame:
    """lines with line as binary."""
    return lines.withColumn("line", F.encode("line", "ISO-8859-1"))


def line_strings(lines: DataFrame) -> DataFrame:
    """lines as strings through the default substitution: byte 0 becomes a question mark."""
    return lines.withColumn("line", to_string(F.encode("line", "ISO-8859-1")))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of files of any size, split among tasks; a final empty line isn't given."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
