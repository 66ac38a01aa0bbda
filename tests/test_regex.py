"""The regular-expression dialect."""

import pytest
from pyspark.sql import functions as F

from strandex.functions import regex
from strandex.functions.regex_dialect import compile_re, group_count

# Fixed values: (pattern, text, whole match or None, groups).
CASES = [
    ("a*a*", "aaaaaa", "aaaaaa", []),
    ("(a|b)*c|(a|ab)*c", "xc", "c", ["", ""]),
    ("(a)*", "b", "", [""]),
    ("(..)*(...)*", "abc", "ab", ["ab", ""]),
    ("^a$", "a", "a", []),
    ("abc", "ababc", "abc", []),
    ("ab*bc", "abbbbc", "abbbbc", []),
    ("ab+bc", "abc", None, []),
    ("ab?bc", "abbbbc", None, []),
    ("^abc$", "aabc", None, []),
    ("abc$", "aabc", "abc", []),
    ("^", "abc", "", []),
    ("a.*c", "axyzd", None, []),
    ("a[b-d]", "aac", "ac", []),
    ("a[-b]", "a-", "a-", []),
    ("a[b-]", "a-", "a-", []),
    ("a[^-b]c", "a-c", None, []),
    ("a[^-b]c", "adc", "adc", []),
    ("ab|cd", "abcd", "ab", []),
    ("$*", "-", "", []),
    ("$b", "b", None, []),
    ("a+b+c", "aabbabc", "abc", []),
    ("(a+|b)?", "ab", "a", ["a"]),
    ("(^)*", "-", "", [""]),
    ("([abc])*bcd", "abcd", "abcd", ["a"]),
    ("(abc|)ef", "abcdef", "ef", [""]),
    ("a([bc]*)(c+d)", "abcd", "abcd", ["b", "cd"]),
    ("((a)(b)c)(d)", "abcd", "abcd", ["abc", "a", "b", "d"]),
    ("^a(bc+|b[eh])g|.h$", "abh", "bh", [""]),
    ("(bc+d$|ef*g.|h?i(j|k))", "reffgz", "effgz", ["effgz", ""]),
    ("(bc+d$|ef*g.|h?i(j|k))", "bcdd", None, []),
    ("((((((((((a))))))))))", "a", "a", ["a"] * 10),
    ("%((.*), (.*)%)", "(a, b)", "(a, b)", ["a", "b"]),
    ("[ -~ -~]*", "abc", "abc", []),
    ("(na)x+na", "naxna123", "naxna", ["na"]),
    ("[0-9a-zA-Z&]+", "aAbb123&&*", "aAbb123&&", []),
    ("[0-9]+%.[0-9]*(e[+-]?[0-9]+)", "12.3e-4  k", "12.3e-4", ["e-4"]),
    ("M[ou]'?am+[ae]r .*([AEae]l[- ])?[GKQ]h?[aeu]+([dtz][dhz]?)+af[iy]", "Moammar El Kadhafi", "Moammar El Kadhafi", ["", "dh"]),
    ("a[\\-]?c", "a-c", "a-c", []),
    ("(a+)*", "aaaa", "aaaa", ["aaaa"]),
    # more of the dialect
    ("(a*)*", "-", "", [""]),
    ("a-b", "aaab", "aaab", []),
    ("(a-)", "aaa", "a", ["a"]),
    ("%b()", "f(x(y)z)", "(x(y)", []),
    ("%s+", "a \t\nb", " \t", []),
    ("%S+", " ab ", "ab", []),
    ("%n", "a\r\n", "\r", []),
    ("[^%s%n]+", " \nword ", "word", []),
    ("%u%l+", "aBcd", "Bcd", []),
    ("%x+", "xyz9Fg", "9F", []),
    ("%p+", "a_\\-+b", "-+", []),
    ("%w+", "-é_9-", "é_9", []),
    ("%%", "100%", "%", []),
    (".", "\n", "\n", []),
    ("a^b$c", "a^b$c", "a^b$c", []),
    ("{x}\\", "{x}\\", "{x}\\", []),
    ("(?ab)+(c)", "ababc", "ababc", ["c"]),
    ("[%D]+", "12ab3", "ab", []),
    ("[&&a]+", "x&a&", "&a&", []),
    ("|a", "a", "", []),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cases(spark):
    columns = [regex.find(F.lit(t), p).alias(f"c{i}") for i, (p, t, _, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    for (p, t, whole, groups), m in zip(CASES, row, strict=True):
        assert (m and m["match"]) == whole, (p, t, m)
        if m:
            assert m["groups"] == groups, (p, t, m)
            assert t[m["start"] : m["end"]] == whole, (p, t, m)
            assert group_count(p) == len(groups)


@pytest.mark.parametrize("pattern", ["", ")(", "a**", "a*?", "]", "(abc", "a)", "[a", "%", "*a", "a+?", "[a-%d]", "%b("])
def test_rejected(pattern):
    with pytest.raises(ValueError):
        compile_re(pattern)


def test_long_loops(spark):
    """Repeated groups over long texts, which Java's matcher can't do without its stack."""
    n = 1_000_000
    texts = spark.createDataFrame([(0, "ab" * (n // 2)), (1, "x" + "ab" * 20_000 + "c"), (2, "")], "i int, t string")
    t = F.col("t")
    row = texts.where("i = 0").select(
        *(F.length(regex.find(t, p)["match"]).alias(f"c{k}") for k, p in enumerate(("(a|b)*", "(ab|c)+", "(a*)*", "(%a%a)*", "((a)|(b))+", "(ab?)*"))),
        regex.count(t, "(ba|b)+").alias("n"),
        F.length(regex.replace_all(t, "(ab|c)+", "-")).alias("r"),
        F.length(regex.replace_first(t, "(ab|c)+", "-")).alias("f"),
        F.size(regex.split_all(t, "(ab|c)+")).alias("s"),
        regex.match(t, "(ab|ba)*", exact=True)["end"].alias("m"),
        F.length(regex.rearrange(t, "(ab|c)+", "<$1>")).alias("g"),
    ).first()
    assert tuple(row) == (n, n, 1, n, n, n, 1, 1, 1, 2, n, 4)
    found = [tuple(r) for r in texts.orderBy("i").select(regex.matches(t, "(ab|c)+c"), regex.group(t, "(ab|b)+c", 1), regex.split(t, "(ab|x)+")["tail"]).collect()]
    assert found == [(False, None, ""), (True, "ab", "c"), (False, None, None)]
    assert not compile_re("(a|b)*(%d|%a|x)+(cd)*").long_loops and compile_re("(a|bc)*").long_loops and compile_re("(?a+)-").long_loops


def test_loops_by_both_engines(spark):
    """What runs in Arrow batches gives the cases' results too."""
    columns = [F.get(regex.all_matches(F.lit(t), p), F.lit(0)).alias(f"c{i}") for i, (p, t, _, _) in enumerate(CASES)]
    for (p, t, whole, groups), m in zip(CASES, spark.range(1).select(*columns).first(), strict=True):
        assert (m and m["match"]) == whole and (not m or m["groups"] == groups), (p, t, m)


def test_predicate(spark):
    """matches() looks for less than find() but finds it in the same texts."""
    more = ["a+", "x?a*b-c+|d+$", "a*", "^a+b*$", "(a+)%d*", "z?", "(?a|bc)+d", "[^a]+b"]
    texts = ["", "a", "b", "abc", "bcd", "aad", "xd", "dx", "aab1", "z", "\n"]
    rows = spark.createDataFrame([(t,) for t in [*texts, *(c[1] for c in CASES)]], "t string")
    patterns = [*more, *(c[0] for c in CASES)]
    wrong = rows.select("t", *(regex.matches(F.col("t"), p).eqNullSafe(regex.find(F.col("t"), p).isNotNull()).alias(f"c{i}") for i, p in enumerate(patterns)))
    for r in wrong.collect():
        assert all(r[1:]), (r[0], [p for p, ok in zip(patterns, r[1:], strict=True) if not ok])


def test_windows(spark):
    text = F.lit("k1=v1;k22=v22;x")
    found = one(spark, regex.all_matches(text, compile_re("(%a)(%d+)"), 1, 12, 1))
    assert [(m["match"], m["groups"], m["start"], m["end"]) for m in found] == [("v1", ["v", "1"], 3, 5), ("k22", ["k", "22"], 6, 9), ("v2", ["v", "2"], 10, 12)]
    assert one(spark, regex.find_all(text, "%d+", 2, 8)) == ["1", "2"]
    assert one(spark, regex.split_all(text, "[=;]", start=3, end=13)) == ["v1", "k22", "v22"]
    assert tuple(one(spark, regex.split(text, "=", 3, 13))) == ("v1;k22", "v22")
    assert one(spark, regex.replace_all(text, "%d", "#", 3, 8)) == "k1=v#;k#2=v22;x"
    assert one(spark, regex.replace_first(text, "%d", "#", 3)) == "k1=v#;k22=v22;x"
    assert one(spark, regex.replace_all(text, "(v1|k)+", "#", 1, 8)) == "k1=#;#22=v22;x"
    assert one(spark, regex.all_matches(F.lit(None).cast("string"), "a")) is None


def test_match(spark):
    lit = F.lit
    assert one(spark, regex.match(lit("abc 123"), "%d+")) is None
    assert one(spark, regex.match(lit("abc 123"), "%a+"))["match"] == "abc"
    assert one(spark, regex.match(lit("abc 123"), "%d+", 4))["start"] == 4
    assert one(spark, regex.match(lit("ab"), "a|ab", exact=True))["match"] == "ab"
    assert one(spark, regex.match(lit("abc"), "a|ab", exact=True)) is None
    assert one(spark, regex.match(lit("123abc"), "(%d+)(%a+)"))["groups"] == ["123", "abc"]
    assert one(spark, regex.match(lit("abcd"), "(a(b(c)))(d)"))["groups"] == ["abc", "bc", "c", "d"]
    assert one(spark, regex.find(lit("a1b22"), "%d+", 2))["start"] == 3


def test_find_all_split_replace(spark):
    lit = F.lit
    assert one(spark, regex.find_all(lit("abc 123"), "[^%s]+")) == ["abc", "123"]
    assert one(spark, regex.find_all(lit("baac"), "a*")) == ["", "aa", "", ""]
    assert one(spark, regex.count(lit("a1b22"), "%d")) == 3
    assert tuple(one(spark, regex.split(lit("1,2,3"), ","))) == ("1", "2,3")
    assert tuple(one(spark, regex.split(lit("123"), ","))) == ("123", None)
    assert one(spark, regex.split_all(lit("1,2,,,abc,3,,"), ",", coalesce=True)) == ["1", "2", "abc", "3"]
    assert one(spark, regex.split_all(lit("1,2,3"), ",")) == ["1", "2", "3"] and one(spark, regex.split_all(lit("1"), ",")) == ["1"]
    assert one(spark, regex.replace_first(lit("1 2 3"), "%d+", "*")) == "* 2 3"
    assert one(spark, regex.replace_first(lit("x(1)y(2)"), "(%()(%d)", "$1\\")) == "x$1\\)y(2)"
    assert one(spark, regex.replace_all(lit("1 2 3"), "%d+", "$0\\")) == "$0\\ $0\\ $0\\"
    assert one(spark, regex.rearrange(lit("Lisp In Small Pieces"), "(%a)%a+%s*", "$1.")) == "L.I.S.P."
    assert one(spark, regex.rearrange(lit("abc 123"), "(%a+)(%s+)(%d+)", "$3$2$1", all=False)) == "123 abc"
    assert one(spark, regex.rearrange(lit("a[(]b"), "([[(]+)%]", "<$$|$1>")) == "a<[(]|[(>b"
    texts = spark.createDataFrame([("a bc def",), (None,)], "t string")
    put = regex.replace_with("%a+", lambda m, g, s, e: str(len(m)))
    assert [r[0] for r in texts.select(put("t")).collect()] == ["1 2 3", None]


def test_with_match(spark):
    m = regex.find(F.lit("abc 123"), "(%a+)(%s+)(%d+)")
    assert one(spark, regex.with_match(m, lambda n: F.concat(n["$3"], n["$2"], n["$1"]))) == "123 abc"
    none = regex.find(F.lit("abc"), "%d")
    assert one(spark, regex.with_match(none, lambda n: n["$$"], F.lit("no"))) == "no"
