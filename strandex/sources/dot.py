"""Tries and suffix trees as Graphviz text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _label(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _graph(parts: list[DataFrame]) -> DataFrame:
    """(line) in order: the frame around the statements of parts."""
    spark = parts[0].sparkSession
    out = spark.createDataFrame([(0, "", "digraph {")], "part int, k string, line string")
    for i, p in enumerate(parts, 1):
        out = out.unionByName(p.select(F.lit(i).alias("part"), F.col("k").cast("string").alias("k"), "line"))
    return out.unionByName(spark.createDataFrame([(len(parts) + 1, "", "}")], out.schema)).orderBy("part", "k", "line").select("line")


def trie_dot(nodes: DataFrame, fails: DataFrame | None = None) -> DataFrame:
    """Lines of a graph: doubled circles are keywords, dashed edges failure links (not those to the root)."""
    name = lambda c: F.concat(F.lit('"'), _label(F.col(c)), F.lit('"'))
    shape = F.when(F.col("mark").isNotNull(), "doublecircle").otherwise("circle")
    states = nodes.select(F.col("prefix").alias("k"), F.concat(F.lit("  "), name("prefix"), F.lit(" [shape="), shape, F.lit("];")).alias("line"))
    edges = nodes.where("depth > 0").select(
        F.col("prefix").alias("k"), F.concat(F.lit("  "), name("parent"), F.lit(" -> "), name("prefix"), F.lit(' [label="'), _label(F.col("label")), F.lit('"];')).alias("line")
    )
    parts = [states, edges]
    if fails is not None:
        parts.append(fails.where("fail <> ''").select(F.col("prefix").alias("k"), F.concat(F.lit("  "), name("prefix"), F.lit(" -> "), name("fail"), F.lit(" [style=dashed];")).alias("line")))
    return _graph(parts)


def suffix_tree_dot(tree: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Lines of a graph of one text's tree; an edge bears its text and bounds, dotted edges are suffix links (node_id, link)."""
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    order = F.lpad(F.col("node_id").cast("string"), 12, "0")
    shape = F.when(F.col("is_leaf"), "box").otherwise("circle")
    states = tree.select(order.alias("k"), F.concat(F.lit("  "), node("node_id"), F.lit(" [shape="), shape, F.lit("];")).alias("line"))
    bounds = F.concat(F.lit(" ["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(")"))
    edges = tree.where("parent_id is not null").select(
        order.alias("k"), F.concat(F.lit("  "), node("parent_id"), F.lit(" -> "), node("node_id"), F.lit(' [label="'), _label(F.col("edge")), bounds, F.lit('"];')).alias("line")
    )
    parts = [states, edges]
    if links is not None:
        line = F.concat(F.lit("  "), node("node_id"), F.lit(" -> "), node("link"), F.lit(" [style=dotted];"))
        parts.append(links.select(F.lpad(F.col("node_id").cast("string"), 12, "0").alias("k"), line.alias("line")))
    return _graph(parts)


def write_dot(graph: DataFrame, path: str) -> None:
    """One text file; a graph that is looked at is small."""
    graph.coalesce(1).write.text(path)


def printed(nodes: DataFrame) -> DataFrame:
    """Rows as JSON lines, for reading by eye."""
    return nodes.select(F.to_json(F.struct(*nodes.columns)).alias("line"))
