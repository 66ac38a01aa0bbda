"""The column functions over a stream give what they give over a table."""

from strandex.operators import multi
from strandex.plans.queries import PATTERNS
from strandex.streaming import search


def test_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = search.read_stream(spark, str(tmp_path / "in"), docs, files_a_batch=2)
    search.write_available(search.first_matches(stream, PATTERNS), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = search.first_matches(docs, PATTERNS)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()

    q = search.counts_by_pattern(stream, PATTERNS).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in search.counts_by_pattern(docs, PATTERNS).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def test_duplicates(spark):
    assert multi.numbered(["a", "b", "a", ""]) == {"a": 2, "b": 1}
