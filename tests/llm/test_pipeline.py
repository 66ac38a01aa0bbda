"""The pipeline stage by stage against plain computations."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_queries import SF, brute_components, brute_contamination, brute_passages, read


def collect(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.scratch(f(spark, out[-1], SF)))
    return out


def test_language(stages):
    docs, kept = collect(stages[0]), collect(stages[1])
    assert set(kept) <= set(docs)
    assert set(docs) - set(kept) <= {i for i, r in docs.items() if len(re.findall(r"[^\W\d_]", r["text"] or "")) < 20}
    assert all(kept[i] == docs[i] for i in kept)


def test_near(stages):
    docs, kept = collect(stages[1]), collect(stages[2])
    _, part = brute_components([(i, r["text"]) for i, r in docs.items()], 5, 80)
    assert set(kept) == {i for i, p in part.items() if i == p} and all(kept[i] == docs[i] for i in kept)


def test_substring(stages):
    docs, kept = collect(stages[2]), collect(stages[3])
    repeated = brute_passages([(i, r["text"]) for i, r in docs.items()])
    assert not brute_passages([(i, r["text"]) for i, r in kept.items()])
    clean = set(docs) - brute_passages([(i, r["text"]) for i, r in docs.items()], 8)
    assert repeated and all(kept[i] == docs[i] for i in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())


def test_decontaminate(stages):
    docs, kept = collect(stages[3]), collect(stages[4])
    found = brute_contamination([(i, r["text"]) for i, r in docs.items()], read(SF, "benchmark", "item_id", "text"))
    assert set(kept) == {x[0] for x in found if not x[5]} and all(kept[i] == docs[i] for i in kept)


def test_pack(stages):
    pieces, docs = stages[5].collect(), collect(stages[4])
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {p["doc_id"]: p["doc_tokens"] for p in pieces} and set(total) == set(docs)


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() == stages[5].count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_hard_and_empty(spark, hard, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    hard_docs = spark.read.parquet(f"{hard}/documents.parquet")
    docs = hard_docs
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.scratch(f(spark, docs, hard))
        if name != "pack":
            assert docs.columns == before.columns and docs.count() <= before.count()
    assert docs.count() > 0
    for f in (f for name, f in corpus_pipeline.STAGES if name != "pack"):
        assert f(spark, hard_docs, hard).columns == hard_docs.columns
    kept = corpus_pipeline.near_dedup(spark, hard_docs, hard).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(x for x in ids if x is not None) == sorted([*({*range(24), -5} - {1, 2, 8, 10, 11, 18, 23}), 14]) and ids.count(None) == 2
    assert {r["text"] for r in kept if r["doc_id"] == 14} == {"same id first", "same id second"}


#: Texts in none of the languages of the tables.
FOREIGN = {
    -1: "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4,
    -2: "道可道非常道名可名非常名無名天地之始有名萬物之母" * 12,
    -3: "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)),
    -4: "".join(random.Random(2).choice("ABCDEFabcdef0123456789+/xyzXYZ") for _ in range(600)),
    -5: "for(i=0;i<n;i++){x[i]=y[i]*2;} if (a==b) return NULL; /* foo_bar */ " * 6,
    -6: "12.5 33 44 -- 1e5 88 " * 20,
}


def test_language_rejects(spark):
    """Foreign and scrambled texts go, and of the given documents next to none, two languages in one text neither."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = "\n".join(docs.where(F.col("lang") == x).where("length(text) between 900 and 1100").first()["text"] for x in ("en", "fr"))
    planted = docs.limit(1).crossJoin(spark.createDataFrame([*FOREIGN.items(), (-9, both)], "i long, t string"))
    more = planted.select(F.col("i").alias("doc_id"), F.col("t").alias("text"), F.lit(None).cast("string").alias("lang"), "source", F.length("t").cast("long").alias("n_chars"))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more.select(docs.columns)), "").select("doc_id").collect()}
    assert not kept & set(FOREIGN) and -9 in kept and len(kept) >= 0.998 * docs.count()
