"""The registered queries of the text-matching engine: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.functions import octets, regex, single
from strandex.functions.scanf import scanf
from strandex.operators import multi, suffix_tree
from strandex.runtime import shared_folder
from strandex.sources import dot, lines

PATTERNS = ["the", "tion", "and", "ou", "sch", "on", "tio"]
KEYWORDS = ["red", "re", "green", "blue", "widget", "red widget", "yellow gadget", "b"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, **cols: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in cols.items()))


def pattern_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), "idx bigint, pat string")


TEXT = "text"


# -- one pattern


@query
def pos_first(spark, sf_dir):
    return documents(spark, sf_dir, pos=single.position(F.col(TEXT), "tion"))


@query
def pos_by_algorithm(spark, sf_dir):
    """All named algorithms, which have one meaning."""
    names = ["brute", "bm", "bmh", "bmh8", "rk", "kmp", "sor", "ac", "tabac"]
    return documents(spark, sf_dir, **{n: getattr(single, f"string_contains_{n}")("ment", F.col(TEXT)) for n in names})


@query
def pos_prepared(spark, sf_dir):
    index = single.initialize_bm("ing")
    return documents(spark, sf_dir, a=single.search_bm(index, F.col(TEXT)), b=single.search_bmh(index, F.col(TEXT), 10, 200))


@query
def pos_octets(spark, sf_dir):
    data = F.encode(F.col(TEXT), "UTF-8")
    return documents(spark, sf_dir, pos=single.position_octets(data, F.encode(F.lit("é"), "UTF-8")))


@query
def pos_from(spark, sf_dir):
    return documents(spark, sf_dir, pos=single.position_in(F.col(TEXT), "on", 50))


@query
def pos_window(spark, sf_dir):
    return documents(spark, sf_dir, pos=single.position_in(F.col(TEXT), "on", 20, 60))


@query
def pos_pattern_slice(spark, sf_dir):
    return documents(spark, sf_dir, pos=single.position_in(F.col(TEXT), "-tion-", 5, 500, 1, 5))


@query
def pos_by_column(spark, sf_dir):
    """Pattern and text both from columns: the item's first word in its own text, folded by a factory's matcher."""
    find = single.matcher(octets.downcase)
    return table(spark, sf_dir, "benchmark").select("item_id", find(F.col(TEXT), F.element_at(F.split(F.col(TEXT), " "), -1)).alias("pos"))


@query
def contains_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(single.contains(F.col(TEXT), "worthless")).select("doc_id", "lang")


@query
def prefixed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(single.prefixed_with(F.col("url"), "https://www."))
    return pages.select("page_id", "url")


@query
def suffixed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", single.suffixed_with(F.col("url"), ".html").alias("is_html"))


@query
def count_nonoverlap(spark, sf_dir):
    return documents(spark, sf_dir, n=single.count(F.col(TEXT), "on"), aa=single.count(F.col(TEXT), "anan"))


@query
def count_overlap(spark, sf_dir):
    return documents(spark, sf_dir, n=suffix_tree.count_overlapping(F.col(TEXT), "anan"))


@query
def positions_all(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(single.positions(F.col(TEXT), "on")).alias("k", "pos"))
    return found.withColumn("k", F.col("k").cast("bigint"))


@query
def rk_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", single.horner_hash(F.col("p_name"), 8).alias("hash"))


# -- many patterns


@query
def multi_first(spark, sf_dir):
    found = documents(spark, sf_dir, m=multi.first(F.col(TEXT), PATTERNS))
    return found.select("doc_id", F.col("m.start").alias("start"), F.col("m.idx").alias("idx"))


@query
def multi_first_by_algorithm(spark, sf_dir):
    """All named algorithms, which have one meaning."""
    names = ["search_ac", "search_compiled_ac", "search_cw"]
    return documents(spark, sf_dir, **{n: getattr(multi, n)(F.col(TEXT), PATTERNS)["start"] for n in names})


@query
def multi_first_blocks(spark, sf_dir):
    """A pattern table in several blocks, each a pass of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", TEXT)
    found = multi.first_automaton(docs, pattern_table(spark, PATTERNS), block_chars=8)
    return found.select("doc_id", F.col("first.start").alias("start"), F.col("first.idx").alias("idx"))


@query
def multi_first_automaton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", TEXT)
    found = multi.first_automaton(docs, pattern_table(spark, PATTERNS))
    return found.select("doc_id", F.col("first.start").alias("start"), F.col("first.idx").alias("idx"))


@query
def multi_all(spark, sf_dir):
    found = documents(spark, sf_dir, m=multi.every(F.col(TEXT), PATTERNS))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.start", "m.idx", "m.end")


@query
def multi_all_automaton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", TEXT)
    found = multi.every_automaton(docs, pattern_table(spark, PATTERNS))
    return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.start", "m.idx", "m.end")


@query
def multi_benchmark_words(spark, sf_dir):
    """A pattern table from data: every benchmark text, looked for in every document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col(TEXT).alias("pat"))
    docs = table(spark, sf_dir, "documents").select("doc_id", TEXT)
    found = multi.every_automaton(docs, items)
    return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.start", "m.idx")


@query
def multi_count_by_pattern(spark, sf_dir):
    return multi.counts(table(spark, sf_dir, "documents"), PATTERNS)


@query
def multi_any_semi(spark, sf_dir):
    return multi.matching(table(spark, sf_dir, "documents"), ["idiot", "moron", "clown"]).select("doc_id")


@query
def multi_none_anti(spark, sf_dir):
    return multi.matching(table(spark, sf_dir, "documents"), ["the", "que", "und"], negate=True).select("doc_id")


@query
def trie_nodes(spark, sf_dir):
    return multi.trie(pattern_table(spark, KEYWORDS))


@query
def trie_empty(spark, sf_dir):
    return multi.empty_trie(spark)


@query
def trie_printed(spark, sf_dir):
    return dot.printed(multi.trie(pattern_table(spark, KEYWORDS)))


@query
def trie_from_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("pat")).agg(F.min("p_partkey").alias("idx"))
    return multi.trie(names).select("prefix", "parent", "depth", "mark")


@query
def trie_fail_links(spark, sf_dir):
    return multi.fail_links(multi.trie(pattern_table(spark, [*KEYWORDS, "edge", "dg", "get"])))


@query
def trie_transitions(spark, sf_dir):
    return multi.transitions(multi.trie(pattern_table(spark, ["he", "she", "his", "hers"])))


@query
def trie_find_child(spark, sf_dir):
    at = spark.createDataFrame([("", "r"), ("re", "d"), ("re", "x"), ("red", " ")], "parent string, label string")
    return multi.find_child(multi.trie(pattern_table(spark, KEYWORDS)), at)


@query
def trie_contains(spark, sf_dir):
    return multi.trie_contains(table(spark, sf_dir, "part").select("p_partkey", "p_name"), pattern_table(spark, KEYWORDS), "p_name").select("p_partkey", "mark")


@query
def trie_longest_prefix(spark, sf_dir):
    return multi.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_name"), pattern_table(spark, KEYWORDS), "p_name").select("p_partkey", "length")


@query
def trie_walk(spark, sf_dir):
    """Level order and depth-first order of the nodes, as ranks."""
    from pyspark.sql import Window

    nodes = multi.trie(pattern_table(spark, KEYWORDS))
    level, deep = Window.orderBy("depth", "prefix"), Window.orderBy("prefix")
    return nodes.select("prefix", (F.row_number().over(level) - 1).cast("bigint").alias("level_rank"), (F.row_number().over(deep) - 1).cast("bigint").alias("deep_rank"))


@query
def trie_dot(spark, sf_dir):
    nodes = multi.trie(pattern_table(spark, ["he", "she", "his", "hers"]))
    return dot.trie_dot(nodes, multi.fail_links(nodes))


# -- suffix trees


def _names(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return regions.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()


@query
def suffix_tree_leaves(spark, sf_dir):
    return suffix_tree.leaves(suffix_tree.suffix_tree(_names(spark, sf_dir), "name", "name")).select("name", "path")


@query
def suffix_tree_internal(spark, sf_dir):
    return suffix_tree.inner(suffix_tree.suffix_tree(_names(spark, sf_dir), "name", "name")).select("name", "path", "depth")


@query
def suffix_tree_edges(spark, sf_dir):
    tree = suffix_tree.suffix_tree(_names(spark, sf_dir), "name", "name")
    return tree.groupBy("name").agg(F.count("*").alias("nodes"), F.sum(F.length("edge")).cast("bigint").alias("edge_chars"))


@query
def suffix_tree_walk(spark, sf_dir):
    """Ranks of the nodes in pre-order, a walk in each tree."""
    from pyspark.sql import Window

    tree = suffix_tree.walk(suffix_tree.suffix_tree(_names(spark, sf_dir), "name", "name"))
    return tree.select("name", "path", (F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1).cast("bigint").alias("rank"))


@query
def suffix_tree_links(spark, sf_dir):
    tree = suffix_tree.suffix_tree(_names(spark, sf_dir), "name", "name")
    ends = suffix_tree.suffix_links(tree, "name").join(tree.select("name", "node_id", "path"), ["name", "node_id"])
    return ends.join(tree.select("name", F.col("node_id").alias("link"), F.col("path").alias("to")), ["name", "link"]).select("name", "path", "to")


@query
def suffix_tree_equal(spark, sf_dir):
    """A tree made by hand, from nested lists, is the built one; another text's is not."""
    texts = spark.createDataFrame([("cacao",), ("cocoa",)], "t string")
    tree = suffix_tree.suffix_tree(texts, "t", "t")
    made = suffix_tree.from_nested("cacao", [[0, 2, [[2, 5], [4, 5]]], [1, 2, [[2, 5]]]])
    made = suffix_tree.insert(suffix_tree.insert(made, 4, 4, 5), 0, 4, 5)
    own = spark.createDataFrame([("cacao"[b - d : b], leaf) for _, _, _, b, d, leaf in made], "path string, is_leaf boolean")
    a, b = (tree.where(F.col("t") == t) for t in ("cacao", "cocoa"))
    return spark.createDataFrame([(suffix_tree.equal(a, own), suffix_tree.equal(a, b))], "same boolean, other boolean")


# -- regular expressions

URL = "(%a+)://([^/?#]+)([^?#]*)"


@query
def re_find(spark, sf_dir):
    found = documents(spark, sf_dir, m=regex.find(F.col(TEXT), "%u%l+tion%w*"))
    return found.select("doc_id", "m.match", "m.start", "m.end")


@query
def re_find_window(spark, sf_dir):
    found = documents(spark, sf_dir, m=regex.find(F.col(TEXT), "%a+", 30, 60))
    return found.select("doc_id", "m.match", "m.start", "m.end")


@query
def re_match_start(spark, sf_dir):
    return documents(spark, sf_dir, m=regex.match(F.col(TEXT), "%u%l*").getField("match"))


@query
def re_match_exact(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", regex.match(F.col("p_brand"), "Brand#%d|Brand#%d%d", exact=True).getField("match").alias("brand"))


@query
def re_find_all(spark, sf_dir):
    return documents(spark, sf_dir, m=regex.find_all(F.col(TEXT), "%u%l+ing")).select("doc_id", F.posexplode("m").alias("k", "word")).withColumn("k", F.col("k").cast("bigint"))


@query
def re_find_all_groups(spark, sf_dir):
    """Match objects of all matches in a window, from a compiled pattern."""
    tags = regex.all_matches(F.col("html"), regex.compile_re("<(%a+)([^>]*)>"), 5, 2000)
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("k", "m"))
    return found.select("page_id", F.col("k").cast("bigint").alias("k"), "m.match", F.get("m.groups", F.lit(0)).alias("tag"), F.get("m.groups", F.lit(1)).alias("rest"), "m.start", "m.end")


@query
def re_split_window(spark, sf_dir):
    return documents(spark, sf_dir, pieces=F.array_join(regex.split_all(F.col(TEXT), "[%s%n]+", start=10, end=90), "|"))


@query
def re_replace_window(spark, sf_dir):
    return documents(spark, sf_dir, said=F.md5(regex.replace_all(F.col(TEXT), "%a+", "<*>", 10, 90)))


@query
def re_long_loops(spark, sf_dir):
    """A repeated group of varying length, over whole documents."""
    found = documents(spark, sf_dir, m=regex.find(F.col(TEXT), "(?%a+[%s%n])+"))
    return found.select("doc_id", "m.start", "m.end")


@query
def re_groups_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", *(regex.group(F.col("url"), URL, k).alias(n) for k, n in enumerate(("scheme", "host", "path"), 1)))


@query
def re_with_match(spark, sf_dir):
    found = regex.find(F.col("url"), URL)
    return table(spark, sf_dir, "pages").select("page_id", regex.with_match(found, lambda m: F.concat(m["$2"], F.lit(" by "), m["$1"]), F.lit("none")).alias("said"))


@query
def re_boundary(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", regex.count(F.col("html"), "%b<>").alias("tags"))


@query
def re_split_first(spark, sf_dir):
    return documents(spark, sf_dir, s=regex.split(F.col(TEXT), "[.,]%s*")).select("doc_id", "s.head", F.length("s.tail").cast("bigint").alias("tail_chars"))


@query
def re_split_all(spark, sf_dir):
    return documents(spark, sf_dir, n=F.size(regex.split_all(F.col(TEXT), "[%s%n]")).cast("bigint"), m=F.size(regex.split_all(F.col(TEXT), "%p+")).cast("bigint"))


@query
def re_split_coalesce(spark, sf_dir):
    return documents(spark, sf_dir, piece=F.explode(regex.split_all(F.col(TEXT), "[%n.]", coalesce=True)))


@query
def re_replace_all(spark, sf_dir):
    return documents(spark, sf_dir, said=F.md5(regex.replace_all(F.col(TEXT), "%a+ing", "$1\\")))


@query
def re_replace_first(spark, sf_dir):
    return documents(spark, sf_dir, said=F.md5(regex.replace_first(F.col(TEXT), "%a+ing", "<*>")))


@query
def re_rearrange(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", regex.rearrange(F.col("url"), "(%a+)://([^/?#]+)", "$2 $1:").alias("said"))


@query
def re_replace_function(spark, sf_dir):
    """Each word by its length, through a function."""
    put = regex.replace_with("%a+", lambda match, groups, start, end: str(len(match)))
    return table(spark, sf_dir, "part").select("p_partkey", put(F.col("p_name")).alias("said"))


@query
def re_count_lines(spark, sf_dir):
    """Lines that hold a URL or an e-mail address."""
    rows = lines.exploded(table(spark, sf_dir, "documents").select("doc_id", TEXT), "doc_id", TEXT)
    found = rows.where(regex.matches(F.col("line"), "%a+://[^%s]+|[%w.]+@%w+%.%w+"))
    return found.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


# -- scanf


@query
def scanf_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scanf(F.col("p_brand"), "Brand#%d", ["brand"]).alias("s")).select("p_partkey", "s.brand", "s.matched")


@query
def scanf_source(spark, sf_dir):
    return documents(spark, sf_dir, s=scanf(F.col("source"), "src%d%n", ["number", "chars"])).select("doc_id", "s.number", "s.chars", "s.matched")


@query
def scanf_customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scanf(F.col("c_name"), "%[A-Za-z]#%*3c%3d%d", ["word", "high", "low"]).alias("s")).select("c_custkey", "s.word", "s.high", "s.low", "s.matched")


@query
def scanf_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scanf(F.col("o_orderpriority"), "%d-%[A-Z ]", ["level", "name"]).alias("s")).select("o_orderkey", "s.level", "s.name")


@query
def scanf_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scanf(F.col("props"), '{ "%c" : %i }', ["key", "value"]).alias("s")).select("event_id", "s.key", "s.value", "s.matched")


@query
def scanf_float(spark, sf_dir):
    price = F.format_string("%.2f USD", F.col("p_retailprice").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", scanf(price, "%f %s", ["price", "unit"]).alias("s")).select("p_partkey", "s.price", "s.unit")


@query
def scanf_radix(spark, sf_dir):
    text = F.concat(F.lit("0x"), F.hex("p_partkey"), F.lit(" "), F.conv(F.col("p_partkey").cast("string"), 10, 8))
    return table(spark, sf_dir, "part").select("p_partkey", scanf(text, "%x %o", ["hex", "oct"]).alias("s")).select("p_partkey", "s.hex", "s.oct")


@query
def scanf_partial(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scanf(F.col("p_name"), "%[a-z] wid%s", ["colour", "rest"]).alias("s")).select("p_partkey", "s.colour", "s.rest", "s.matched")


# -- octets and lines


@query
def ub_compare_index(spark, sf_dir):
    a, b = F.col("p_name"), F.lit("red widget")
    ops = {"ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
    return table(spark, sf_dir, "part").select("p_partkey", *(octets.compare(op, a, b).alias(n) for n, op in ops.items()))


@query
def ub_compare_slices(spark, sf_dir):
    a, b = F.col("p_name"), F.lit("a red widget")
    ops = {"ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
    return table(spark, sf_dir, "part").select("p_partkey", *(octets.compare(op, a, b, 1, 5, 3, 7).alias(n) for n, op in ops.items()))


@query
def ub_char_order(spark, sf_dir):
    first, last = F.substring("p_name", 1, 1), F.substring("p_name", -1, 1)
    ops = {"eq": "=", "ne": "/=", "lt": "<", "gt": ">", "le": "<=", "ge": ">="}
    return table(spark, sf_dir, "part").select("p_partkey", *(octets.compare_chars(op, first, last, F.lit("t")).alias(n) for n, op in ops.items()))


@query
def ub_equal_slices(spark, sf_dir):
    a = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", octets.equal(a, F.lit("bored"), start1=0, end1=3, start2=2).alias("same"), octets.mismatch(a, F.lit("bored"), 0, 3, 2).alias("at"))


@query
def ub_case(spark, sf_dir):
    return documents(spark, sf_dir, up=F.md5(octets.upcase(F.col(TEXT))), down=F.md5(octets.downcase(F.col(TEXT))))


@query
def ub_capitalize(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", octets.capitalize(F.col("o_orderpriority")).alias("said"))


@query
def ub_chars(spark, sf_dir):
    c = octets.char_at(F.col("p_brand"), 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        c.alias("c"),
        octets.char_code(c).alias("code"),
        octets.is_alpha(c).alias("alpha"),
        octets.is_alphanumeric(c).alias("alnum"),
        octets.digit_value(c).alias("weight"),
        octets.is_upper(F.substring("p_brand", 1, 1)).alias("upper"),
        octets.is_lower(F.substring("p_brand", 1, 1)).alias("lower"),
    )


@query
def ub_translate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", octets.substitution(F.col("p_name"), {"a": "u", "e": "3"}).alias("said"))


@query
def ub_round_trip(spark, sf_dir):
    data = octets.from_string(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", octets.to_string(data).alias("said"), F.hex(octets.from_octets(F.array(F.lit(0), F.lit(97), F.lit(255)))).alias("codes"))


@query
def ub_subseq(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", octets.subseq(F.col("p_name"), 2, 6).alias("said"), octets.trim("r", F.col("p_name"), "left").alias("trimmed"))


@query
def lines_split(spark, sf_dir):
    return lines.exploded(table(spark, sf_dir, "documents").select("doc_id", TEXT), "doc_id", TEXT)


@query
def line_offsets(spark, sf_dir):
    return lines.numbered(table(spark, sf_dir, "documents"), "doc_id", TEXT).select("doc_id", "line_no", "offset")


@query
def lines_from_position(spark, sf_dir):
    return lines.from_position(lines.numbered(table(spark, sf_dir, "documents"), "doc_id", TEXT), 100)


@query
def lines_of_files(spark, sf_dir):
    """Customers written as a file for each segment, three lines each, and read back: octets, numbers and offsets."""
    folder = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    names = table(spark, sf_dir, "customer").select("c_mktsegment", F.concat_ws("\n", F.concat_ws(" ", "c_custkey", "c_name"), F.lit(""), "c_mktsegment").alias("value"))
    names.repartition(3, "c_mktsegment").sortWithinPartitions("value").write.partitionBy("c_mktsegment").text(folder)
    found = lines.line_strings(lines.read_lines(spark, folder))
    part = regex.group(F.col("path"), "c_mktsegment=([^/]+)/", 1)
    return found.groupBy(part.alias("segment")).agg(F.count("*").alias("n"), F.sum(F.length("line") + 1).alias("chars"), F.max("offset").alias("last"), F.count_if(F.col("line") == "").alias("blank"))
