"""Many patterns at once: first match, all matches, keyword tries.

A pattern's index is its place in the list; of equal patterns the highest index counts. The first match is the
one that ends first; of those that end together the longest. A literal list of some dozens of patterns becomes
one unrolled expression in the JVM; a pattern table becomes an automaton, broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import single
from strandex.runtime import scratch, ship

#: Characters of patterns in one broadcast automaton; a character takes some 50 bytes there.
BLOCK_CHARS = 1_000_000
#: Texts in one Arrow batch of an automaton pass.
BATCH_ROWS = 512


def numbered(patterns: list[str]) -> dict[str, int]:
    """Pattern -> index; the last of equal ones."""
    return {p: i for i, p in enumerate(patterns) if p}


def first(text: Column, patterns: list[str]) -> Column:
    """Struct (start, idx) of the first match, NULL if there is none. Each pattern is looked for once a text."""
    known = numbered(patterns)
    if not known:
        return F.lit(None).cast("struct<start:bigint,idx:bigint>")
    table = F.array(*(F.struct(F.lit(p).alias("pat"), F.lit(len(p)).alias("size"), F.lit(i).cast("bigint").alias("idx")) for p, i in known.items()))
    found = F.transform(table, lambda k: F.struct(F.call_function("instr", text, k["pat"]).alias("at"), k["size"].alias("size"), k["idx"].alias("idx")))
    ends = F.transform(
        F.filter(found, lambda m: m["at"] > 0),
        lambda m: F.struct((m["at"] + m["size"]).alias("end"), (m["at"] - 1).cast("bigint").alias("start"), m["idx"].alias("idx")),
    )
    best = F.transform(F.array(F.array_min(ends)), lambda m: F.when(m.isNotNull(), F.struct(m["start"].alias("start"), m["idx"].alias("idx"))))
    return F.get(best, F.lit(0))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is in the text."""
    out = F.lit(False)
    for p in numbered(patterns):
        out = out | single.contains(text, p)
    return out


def every(text: Column, patterns: list[str]) -> Column:
    """All matches as structs (start, idx, end), by start and index; those of one pattern don't overlap.

    An automaton in Arrow batches reads each text once; with built-in expressions the cost of a text grows
    with the square of its matches (three times slower on texts with some hundred).
    """
    return _every_udf(lambda known=list(numbered(patterns).items()): known)(text)


def counts(texts: DataFrame, patterns: list[str], text_col: str = "text") -> DataFrame:
    """(idx, n): how often each pattern occurs in all texts, those that occur. One pass, one row a task is shuffled."""
    known = numbered(patterns)
    sums = [F.struct(F.lit(i).cast("bigint").alias("idx"), F.sum(single.count(F.col(text_col), p)).alias("n")) for p, i in known.items()]
    if not sums:
        return texts.sparkSession.createDataFrame([], "idx bigint, n bigint")
    return texts.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("c")).select("c.idx", "c.n").where("n > 0")


def _blocks(patterns: DataFrame, idx: str, pat: str, block_chars: int) -> Iterator[list[tuple[str, int]]]:
    """Distinct patterns with their highest index, in blocks that bound what is broadcast."""
    known = patterns.where(F.length(pat) > 0).groupBy(F.col(pat).alias("pat")).agg(F.max(F.col(idx).cast("bigint")).alias("idx"))
    total = known.agg(F.sum(F.length("pat"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for b in range(blocks):
        yield [(r["pat"], r["idx"]) for r in known.where(F.pmod(F.xxhash64("pat"), F.lit(blocks)) == b).collect()]


def _automaton(found: list[tuple[str, int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, i in found:
        a.add_word(p, (i, len(p)))
    if found:
        a.make_automaton()
    return a


def _first_udf(patterns: Callable[[], list[tuple[str, int]]]) -> Callable:
    kept: list = []
    ship()

    @F.pandas_udf("struct<end:bigint,start:bigint,idx:bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(_automaton(patterns()))
        rows = [(_scan_first(kept[0], t) if t else None) or (None, None, None) for t in texts]
        return pd.DataFrame(rows, columns=["end", "start", "idx"]).astype("Int64")

    return run


def _every_udf(patterns: Callable[[], list[tuple[str, int]]]) -> Callable:
    kept: list = []
    ship()

    @F.pandas_udf("array<struct<start:bigint,idx:bigint,end:bigint>>")
    def run(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(_automaton(patterns()))
        return pd.Series([None if t is None else _scan_every(kept[0], t) for t in texts], dtype=object)

    return run


def _scanned(texts: DataFrame, patterns: DataFrame, text_col: str, idx: str, pat: str, block_chars: int, out: str, udf: Callable, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """texts with the column out: what udf finds for each block of patterns, merged.

    Each block is a pass of its own, and what it found is written before the next one: a worker holds one block's automaton.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found, more = None, f"__{out}"
    for block in _blocks(patterns, idx, pat, block_chars):
        sent = spark.sparkContext.broadcast(block)
        column = udf(lambda b=sent: b.value)(F.col(text_col))
        if found is None:
            found = texts.withColumn(out, column)
        else:
            found = scratch(found).withColumn(more, column).withColumn(out, merge(F.col(out), F.col(more))).drop(more)
    return found


def _scan_first(a, text: str):
    """(end, start, idx) of the match that ends first, the longest of those."""
    best = None
    if len(a):
        for last, (i, n) in a.iter(text):
            if best and last + 1 > best[0]:
                break
            if best is None or n > best[0] - best[1]:
                best = last + 1, last + 1 - n, i
    return best


def _scan_every(a, text: str):
    ends: dict[int, int] = {}
    out = []
    if len(a):
        for last, (i, n) in a.iter(text):
            start = last + 1 - n
            if start >= ends.get(i, 0):
                ends[i] = last + 1
                out.append({"start": start, "idx": i, "end": last + 1})
    return sorted(out, key=lambda m: (m["start"], m["idx"]))


def first_automaton(texts: DataFrame, patterns: DataFrame, text_col: str = "text", idx: str = "idx", pat: str = "pat", out: str = "first", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """texts with the column out: struct (start, idx) of the first match of a table of patterns."""

    def best(x: Column, y: Column) -> Column:
        """The one that ends first; of equal ends the one that starts first."""
        keys = [F.when(m["start"].isNotNull(), F.struct(m["end"].alias("end"), m["start"].alias("start"), m["idx"].alias("idx"))) for m in (x, y)]
        return F.array_min(F.array_compact(F.array(*keys)))

    found = _scanned(texts, patterns, text_col, idx, pat, block_chars, out, _first_udf, best)
    x = F.col(out)
    return found.withColumn(out, F.when(x["start"].isNotNull(), F.struct(x["start"].alias("start"), x["idx"].alias("idx"))))


def every_automaton(texts: DataFrame, patterns: DataFrame, text_col: str = "text", idx: str = "idx", pat: str = "pat", out: str = "found", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """texts with the column out: all matches as structs (start, idx, end), by start and index."""
    return _scanned(texts, patterns, text_col, idx, pat, block_chars, out, _every_udf, lambda x, y: F.array_sort(F.concat(x, y)))


def matching(texts: DataFrame, patterns: list[str], text_col: str = "text", negate: bool = False) -> DataFrame:
    """The rows with any of the patterns, or with none."""
    found = any_of(F.col(text_col), patterns)
    return texts.where(~found if negate else found)


# -- tries: one row for each distinct prefix of a keyword


def trie(patterns: DataFrame, idx: str = "idx", pat: str = "pat") -> DataFrame:
    """(prefix, parent, label, depth, mark): the nodes; the root is the empty prefix with a NULL parent.

    mark is the index of the keyword that ends there, else NULL. An empty pattern table has the root only.
    """
    words = patterns.where(F.col(pat).isNotNull()).groupBy(F.col(pat).alias("word")).agg(F.max(F.col(idx).cast("bigint")).alias("idx"))
    steps = words.where("word <> ''").select("word", "idx", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"))
    nodes = steps.select(F.substring("word", F.lit(1), F.col("n")).alias("prefix"), F.when(F.col("n") == F.length("word"), F.col("idx")).alias("idx"))
    nodes = nodes.groupBy("prefix").agg(F.max("idx").alias("mark"))
    root = patterns.sparkSession.createDataFrame([("", None)], "prefix string, mark bigint")
    depth = F.length("prefix")
    return nodes.unionByName(root).select(
        "prefix",
        F.when(depth > 0, F.substring("prefix", F.lit(1), depth - 1)).alias("parent"),
        F.when(depth > 0, F.substring("prefix", depth, F.lit(1))).alias("label"),
        depth.cast("bigint").alias("depth"),
        "mark",
    )


def empty_trie(spark) -> DataFrame:
    return trie(spark.createDataFrame([], "idx bigint, pat string"))


def find_child(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """at (parent, label) with the child's prefix and mark, NULL where there is none."""
    return at.join(nodes.select("parent", "label", "prefix", "mark"), ["parent", "label"], "left")


def fail_links(nodes: DataFrame) -> DataFrame:
    """(prefix, fail): for each node but the root the longest proper suffix that is a node too.

    Suffixes are looked up by their hash and length, so rows of a few numbers are joined and not texts; what is found is
    compared as text.
    """
    known = nodes.select(F.xxhash64("prefix").alias("h"), F.col("depth").alias("size"), F.col("prefix").alias("suffix"))
    inner = nodes.where("depth > 0").select("prefix", "depth")
    starts = inner.select(F.xxhash64("prefix").alias("node"), "depth", "prefix", F.explode(F.sequence(F.lit(2), F.length("prefix") + 1)).alias("i"))
    asked = starts.select("node", (F.col("depth") + 1 - F.col("i")).alias("size"), F.xxhash64(F.substring("prefix", F.col("i"), F.length("prefix"))).alias("h"), "depth")
    met = asked.join(known.select("h", "size"), ["h", "size"]).select("node", "depth", "size").distinct()
    pairs = inner.withColumn("node", F.xxhash64("prefix")).join(met, ["node", "depth"])
    # the right one has this text; the hashes of others may be equal
    right = pairs.withColumn("suffix", F.substring("prefix", (F.col("depth") - F.col("size") + 1).cast("int"), F.length("prefix"))).join(known.select("suffix"), "suffix", "left_semi")
    return right.groupBy("prefix").agg(F.max_by("suffix", "size").alias("fail"))


def trie_contains(texts: DataFrame, patterns: DataFrame, text_col: str, idx: str = "idx", pat: str = "pat", out: str = "mark") -> DataFrame:
    """texts with the index of the keyword that equals the text, else NULL."""
    known = patterns.where(F.length(pat) > 0).groupBy(F.col(pat).alias("__pat")).agg(F.max(F.col(idx).cast("bigint")).alias(out))
    return texts.join(known, F.col(text_col) == F.col("__pat"), "left").drop("__pat")


def longest_prefix(texts: DataFrame, patterns: DataFrame, text_col: str, pat: str = "pat", out: str = "length") -> DataFrame:
    """texts with the column out: the length of the longest keyword that the text begins with, else NULL.

    For each keyword length there is one equality join on that many characters of the distinct texts, not a comparison of all pairs.
    """
    known = patterns.where(F.length(pat) > 0).select(F.col(pat).alias("__pat")).distinct()
    sizes = sorted(r[0] for r in known.select(F.length("__pat")).distinct().collect())
    rows = texts.select(F.col(text_col).alias("__text")).where("__text is not null").distinct()
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    tries = rows.select("__text", F.explode(F.filter(lengths, lambda n: n <= F.length("__text"))).alias("n"))
    found = tries.join(known, F.substring("__text", F.lit(1), F.col("n")) == F.col("__pat")).groupBy("__text").agg(F.max("n").cast("bigint").alias(out))
    return texts.join(found, F.col(text_col) == F.col("__text"), "left").drop("__text")


#: The names a user may know; all share one meaning.
trie_build = initialize_ac = initialize_tabac = initialize_cw = trie
search_ac = search_compiled_ac = search_cw = first
search_tabac = first_automaton
compute_failure_function = fail_links


def transitions(nodes: DataFrame) -> DataFrame:
    """The tabular automaton: (prefix, label, target) with failure links followed, for all labels of the trie.

    The target of a state and a label is the longest suffix of their text that is a node; the root by default.
    """
    labels = nodes.where("label is not null").select("label").distinct()
    states = nodes.select("prefix", "depth")
    alphabet = labels.agg(F.collect_set("label").alias("labels"))  # one row: the characters of the keywords
    wanted = states.join(F.broadcast(alphabet)).select("prefix", "depth", F.explode("labels").alias("label"))
    text = F.concat("prefix", "label")
    suffixes = wanted.select("prefix", "label", F.explode(F.sequence(F.lit(1), F.col("depth").cast("int") + 1)).alias("i"), text.alias("t"))
    reached = suffixes.select("prefix", "label", F.substring("t", F.col("i"), F.length("t")).alias("target")).join(nodes.select(F.col("prefix").alias("target")), "target")
    best = reached.groupBy("prefix", "label").agg(F.max_by("target", F.length("target")).alias("target"))
    return wanted.join(best, ["prefix", "label"], "left").select("prefix", "label", F.coalesce("target", F.lit("")).alias("target"))


trie_to_tabular_ac = transitions
