"""Single patterns, windows, counts, many patterns, suffix trees, octets and lines on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandex.functions import octets, single
from strandex.operators import multi, suffix_tree
from strandex.sources import dot, lines

# Fixed values: (expected, needle, haystack).
SINGLE = [
    (0, "", ""), (None, "a", ""), (None, "a", "b"), (0, "a", "a"), (0, "a", "a--"), (1, "a", "-a-"), (2, "a", "--a"), (None, "a", "-b-"),
    (0, "abc", "abcab_"), (1, "abc", "_abcab_"), (2, "abc", "ababc"), (5, "GCAGAGAG", "GCATCGCAGAGAGTATACAGTACG"),
    (14, "abracadabra", "abacadabrabracabracadabrabrabracad"), (8, "rab", "abacadabrabracabracadabrabrabracad"),
    (None, "bcara", "abacadabrabracabracadabrabrabracad"), (23, "rabrabracad", "abacadabrabracabracadabrabrabracad"),
    (0, "abacad", "abacadabrabracabracadabrabrabracad"), (1, "ab", "aab"), (1, "aab", "aaab"), (2, "ababc", "abababc"), (None, "xaaa", "xšaa"), (1, "ї", "aїb"),
]
# Fixed values: (patterns, text, start, idx).
MANY = [
    (["he", "she", "his", "hers"], "she", 0, 1), (["he", "she", "his", "hers"], "_she", 1, 1), (["he", "she", "his", "hers"], "_sh_", None, None),
    (["he", "she", "his", "hers"], "___his", 3, 2), (["he", "she", "his", "hers"], "___h_s", None, None), (["announce", "annual", "annually"], "annual_announce", 0, 1),
    (["atatata", "tatat", "acgatat"], "agatacgatatatac", 4, 2), (["abx", "bcd"], "abZcd", None, None), (["a", "b", "a"], "a", 0, 2), ([], "a", None, None), (["", "b"], "ab", 1, 1),
]
# Text, number of leaves, inner nodes.
TREES = [
    ("banana$", 7, {"a", "ana", "na"}), ("cacao", 5, {"a", "ca"}), ("mississippi", 10, {"i", "issi", "p", "s", "si", "ssi"}), ("cdddcdc", 5, {"cd", "d", "dd"}),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_single(spark):
    df = spark.createDataFrame([(str(e), n, h) for e, n, h in SINGLE], "e string, n string, h string")
    for r in df.select("*", single.position(F.col("h"), F.col("n")).alias("x")).collect():
        assert str(r["x"]) == r["e"], r
    names = [n for n in dir(single) if n.startswith("string_contains_") and not n.endswith("_ub")]
    assert len(names) == 10
    for n in names:
        assert one(spark, getattr(single, n)("ab", F.lit("xxab"))) == 2
    assert one(spark, single.string_contains_brute_ub(F.lit(b"\xff"), F.lit(b"a\xff"))) == 1
    assert one(spark, single.position(F.lit(None).cast("string"), "a")) is None


def test_windows(spark):
    text = F.lit("_abcab_")
    assert one(spark, single.position_in(text, "-abc-", 1, 5, 1, 3)) == 1
    assert one(spark, single.position_in(text, "-abc-", 1, 5)) is None
    assert one(spark, single.position_in(text, "", 3)) == 0
    assert one(spark, single.position_in(text, "ab", 2)) == 4
    assert one(spark, single.position_in(text, "ab", 2, 5)) is None
    assert one(spark, single.search(single.initialize_kmp("ab"), text, 2)) == 4


def test_counts(spark):
    for n, needle, text in [(2, "ab", "ababa"), (1, "aba", "ababa"), (2, "abc", "____abc____abc____ab"), (0, "", "abc"), (3, ".", "a.b..")]:
        assert one(spark, single.count(F.lit(text), needle)) == n
        assert len(one(spark, single.positions(F.lit(text), needle))) == n
    assert one(spark, single.positions(F.lit("ababa"), "ab")) == [0, 2]
    assert one(spark, single.positions(F.lit("x\\Ey\\E"), "\\E")) == [1, 4]
    assert one(spark, suffix_tree.count_overlapping(F.lit("banana"), "ana")) == 2


def test_positions_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.") for _ in range(rng.randrange(40))) for _ in range(200)]
    for p in ("a", "ab", "aa", ".", "aba"):
        for r in strings(spark, [(t,) for t in texts], ["t"]).select("t", single.positions(F.col("t"), p).alias("x")).collect():
            want, at = [], r["t"].find(p)
            while at >= 0:
                want.append(at)
                at = r["t"].find(p, at + len(p))
            assert r["x"] == want


def test_many(spark):
    for patterns, text, start, idx in MANY:
        m = one(spark, multi.first(F.lit(text), patterns))
        assert (m and (m["start"], m["idx"])) == (None if start is None else (start, idx)), (patterns, text)
        table = spark.createDataFrame(list(enumerate(patterns)), "idx bigint, pat string")
        for size in (1_000_000, 3):
            got = multi.first_automaton(strings(spark, [(text,)], ["text"]), table, block_chars=size).first()["first"]
            assert (got and (got["start"], got["idx"])) == (None if start is None else (start, idx)), (patterns, text)


def test_many_random(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(100)]
    patterns = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    rows = strings(spark, [(t,) for t in texts] + [(None,)], ["text"])
    table = spark.createDataFrame(list(enumerate(patterns)), "idx bigint, pat string")
    literal = rows.select("text", multi.every(F.col("text"), patterns).alias("m"), multi.first(F.col("text"), patterns).alias("f"))
    want = {r["text"]: (r["m"], r["f"]) for r in literal.collect()}
    for size in (1_000_000, 5):
        got = multi.first_automaton(multi.every_automaton(rows, table, out="m", block_chars=size), table, out="f", block_chars=size)
        assert {r["text"]: (r["m"], r["f"]) for r in got.collect()} == want


def test_trie(spark):
    words = spark.createDataFrame([(0, "he"), (1, "she"), (2, "his"), (3, "hers"), (4, "he")], "idx bigint, pat string")
    nodes = multi.trie(words)
    marks = {r["prefix"]: r["mark"] for r in nodes.collect()}
    assert marks["he"] == 4 and marks["hers"] == 3 and marks["h"] is None and len(marks) == 10
    fails = {r["prefix"]: r["fail"] for r in multi.fail_links(nodes).collect()}
    assert fails["she"] == "he" and fails["sh"] == "h" and fails["his"] == "s" and fails["h"] == ""
    moves = {(r["prefix"], r["label"]): r["target"] for r in multi.transitions(nodes).collect()}
    assert moves["she", "r"] == "her" and moves["she", "s"] == "s" and moves["", "i"] == "" and len(moves) == 50
    texts = spark.createDataFrame([(0, "hers"), (1, "heres"), (2, ""), (3, "x"), (4, None)], "k bigint, t string")
    assert {r["k"]: r["length"] for r in multi.longest_prefix(texts, words, "t").collect()} == {0: 4, 1: 2, 2: None, 3: None, 4: None}
    assert {r["k"]: r["mark"] for r in multi.trie_contains(texts, words, "t").collect()} == {0: 3, 1: None, 2: None, 3: None, 4: None}
    assert multi.empty_trie(spark).count() == 1
    graph = [r["line"] for r in dot.trie_dot(nodes, multi.fail_links(nodes)).collect()]
    assert graph[0] == "digraph {" and graph[-1] == "}" and '  "he" [shape=doublecircle];' in graph and '  "she" -> "he" [style=dashed];' in graph


def test_repeated_keys(spark):
    """Rows that share a key, or have none, keep their own results."""
    rows = spark.createDataFrame([(1, "hers\nx"), (1, "he"), (None, "his"), (None, "a\n\nb"), (2, None)], "k bigint, t string")
    words = spark.createDataFrame([(0, "he"), (1, "hers"), (2, "his")], "idx bigint, pat string")
    assert {(r["k"], r["t"]): r["length"] for r in multi.longest_prefix(rows, words, "t").collect()} == {(1, "hers\nx"): 4, (1, "he"): 2, (None, "his"): 3, (None, "a\n\nb"): None, (2, None): None}
    found = sorted((repr(r["k"]), r["line"], r["line_no"], r["offset"]) for r in lines.numbered(rows, "k", "t").collect())
    assert found == [("1", "he", 0, 0), ("1", "hers", 0, 0), ("1", "x", 1, 5), ("None", "", 1, 2), ("None", "a", 0, 0), ("None", "b", 2, 3), ("None", "his", 0, 0)]


def test_long_suffix_tree(spark):
    """A run of one letter, whose neighbouring suffixes share almost all, and a text without its nodes spelled."""
    assert len(suffix_tree.build("a" * 20_000)) == 2 and len(suffix_tree.build("a" * 20_000 + "b")) == 40_001
    tree = suffix_tree.suffix_tree(spark.createDataFrame([("ab" * 3000,)], "t string"), "t", "t", spelled=False)
    assert "path" not in tree.columns and tree.count() == 3


def test_suffix_trees(spark):
    rows = spark.createDataFrame([(t,) for t, _, _ in TREES] + [("",), (None,)], "t string")
    tree = suffix_tree.suffix_tree(rows, "t", "t").cache()
    for text, n, inner in TREES:
        own = tree.where(F.col("t") == text)
        assert suffix_tree.leaves(own).count() == n
        assert {r["path"] for r in suffix_tree.inner(own).collect()} == inner
    a, b = (tree.where(F.col("t") == t) for t in ("cacao", "banana$"))
    assert suffix_tree.equal(a, a) and not suffix_tree.equal(a, b)
    assert tree.where("t = ''").count() == 1 and tree.where("t is null").count() == 0
    nested = suffix_tree.from_nested("cacao", [[0, 2, [[2, 5], [4, 5]]], [1, 2, [[2, 5], [4, 5]]], [4, 5]])
    assert {("cacao"[y - d : y], leaf) for _, _, _, y, d, leaf in nested} == {(r["path"], r["is_leaf"]) for r in a.collect()}
    assert [r["line"] for r in dot.suffix_tree_dot(a).collect()][-1] == "}"
    dump = [r["path"] for r in suffix_tree.walk(a).collect()]
    assert dump == sorted(dump)


def test_suffix_tree_random():
    rng = random.Random(7)
    for _ in range(200):
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        occurs = lambda x: [i for i in range(len(t)) if t.startswith(x, i)]
        subs = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        rows = suffix_tree.build(t)
        assert {t[e - d : e] for _, _, _, e, d, leaf in rows if leaf and d} == {t[i:] for i in range(len(t)) if len(occurs(t[i:])) == 1}
        assert {t[e - d : e] for _, _, _, e, d, leaf in rows if not leaf and d} == {x for x in subs if len({t[i + len(x)] for i in occurs(x) if i + len(x) < len(t)}) > 1}


def test_octets(spark):
    lit = F.lit
    assert one(spark, octets.equal(lit("foo"), lit("foo"))) and not one(spark, octets.equal(lit("foo"), lit("Foo")))
    assert one(spark, octets.equal(lit("together"), lit("frog"), start1=1, end1=3, start2=2))
    assert one(spark, octets.equal(lit("abcd"), lit("01234abcd9012"), start2=5, end2=9))
    assert one(spark, octets.compare("<", lit("aaaa"), lit("aaab"))) == 3
    assert one(spark, octets.compare(">=", lit("aaaaa"), lit("aaaa"))) == 4
    assert one(spark, octets.compare("<", lit("b"), lit("a"))) is None and one(spark, octets.compare("<=", lit("ab"), lit("ab"))) == 2
    assert one(spark, octets.compare_folded("<=", lit("AB"), lit("ab"))) == 2
    assert one(spark, octets.substitution(lit("abaca"), {"a": "u"})) == "ubucu"
    assert one(spark, octets.to_string(lit(bytes([0, 97, 0, 97, 0])))) == "?a?a?"
    every = bytes(range(256))
    assert bytes(one(spark, octets.from_string(octets.to_string(lit(every), table={})))) == every
    assert bytes(one(spark, octets.from_octets(F.array(*map(lit, every))))) == every
    assert bytes(one(spark, octets.from_string(lit("š")))) == b"a" and bytes(one(spark, octets.from_string(lit("")))) == b""
    assert one(spark, octets.upcase(lit("aé"))) == "Aé" and one(spark, octets.capitalize(lit("the OLD 3rd-man"))) == "The Old 3rd-Man"
    assert one(spark, octets.digit_value(lit("f"), 16)) == 15 and one(spark, octets.digit_value(lit("f"))) is None
    assert one(spark, octets.digit_char(lit(11), 16)) == "B" and one(spark, octets.code_char(lit(97))) == "a"
    assert one(spark, octets.trim("x", lit("xxaxx"))) == "a" and one(spark, octets.trim("x", lit("xxaxx"), "left")) == "axx"
    assert one(spark, octets.subseq(lit("abc"), 1, 9)) == "bc" and one(spark, octets.char_at(lit("abc"), 3)) is None
    assert one(spark, octets.ascii_char_code(lit("š"))) == 97
    for f, yes, no in [(octets.is_alpha, "a", "1"), (octets.is_alphanumeric, "1", "_"), (octets.is_upper, "A", "a"), (octets.is_lower, "a", "A"), (octets.is_both_case, "q", "-"), (octets.is_graphic, "~", "\t"), (octets.is_standard, "\n", "\t")]:
        assert one(spark, f(lit(yes))) and not one(spark, f(lit(no)))


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"line 1\nline 2\n\nline 4\n")
    found = lines.read_lines(spark, str(tmp_path / "a.txt"))
    rows = [(r["line_no"], r["line"], r["offset"]) for r in found.orderBy("line_no").collect()]
    assert rows == [(0, "line 1", 0), (1, "line 2", 7), (2, "", 14), (3, "line 4", 15), (4, "", 22)]
    assert [r["line"] for r in lines.from_position(found, 9).orderBy("line_no").collect()] == ["ne 2", "", "line 4", ""]
    assert lines.from_position(found, 0).count() == 5
    assert lines.stream_lines(spark, str(tmp_path)).count() == 4


def test_lines_random_bytes(spark, tmp_path):
    data = random.Random(8).randbytes(200_000)
    (tmp_path / "b.bin").write_bytes(data)
    found = lines.read_lines(spark, str(tmp_path)).orderBy("line_no")
    got = [bytes(r["line"]) for r in lines.line_octets(found).collect()]
    assert got == data.split(b"\n")
    text = [r["line"] for r in lines.line_strings(found).collect()]
    assert text == [x.decode("latin-1").replace("\0", "?") for x in data.split(b"\n")]


def test_hash(spark):
    h = 0
    for c in b"red widg":
        h = (h * 256 + c) % 723925871
    assert one(spark, single.horner_hash(F.lit("red widget"), 8)) == h


@pytest.mark.parametrize("text", ["", "a"])
def test_empty_inputs(spark, text):
    assert one(spark, multi.every(F.lit(text), ["b"])) == []
