"""Regular expressions of the percent-class dialect over text columns.

Patterns are translated once on the driver and are constants of the plan; every function takes a pattern or what
compile_re() made of it. Positions are 0-based; groups go by the order of their parentheses, hold their last
repetition, and are empty when unmatched. With start and end only that window of the text is looked at.

Built-in expressions do the work but in two cases, which run in Arrow batches: match objects of all matches, whose
positions no built-in function gives, and patterns that repeat a group of varying length, on which Java's matcher
recurses until a long text ends its stack and with it the executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandex.runtime import ship

from .regex_dialect import Re, compile_re

Pattern = str | Re
_MATCH = "struct<match:string,groups:array<string>,start:bigint,end:bigint>"


def _within(text: Column, start: int, end: int | None) -> Column:
    if not start and end is None:
        return text
    n = F.length(text) if end is None else F.lit(end)
    return F.substring(text, F.lit(start + 1), F.greatest(n - start, F.lit(0)))


def _in_python(java: str):
    """The pattern for the workers' matcher, which keeps its own stack."""
    import regex

    return regex.compile(java.replace("\\z", "\\Z"), regex.V1)


def _found(text: Column, java: str, most: int = 0, shift: int = 0, offset: int = 0) -> Column:
    """The match structs of all matches, or of the first ones, by Arrow batches; offset: where the search begins."""
    ship()

    @F.pandas_udf(f"array<{_MATCH}>")
    def run(texts: pd.Series) -> pd.Series:
        r = _in_python(java)

        def one(t: str) -> list[dict]:
            out = []
            for m in r.finditer(t, offset):
                out.append({"match": m[0], "groups": [g or "" for g in m.groups()], "start": m.start() + shift, "end": m.end() + shift})
                if len(out) == most:
                    break
            return out

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(text)


def _match(text: Column, java: str, re: Re, offset: int = 0) -> Column:
    """The match struct of java's first match in text, NULL if there is none."""
    if re.long_loops:
        return F.get(_found(text, java, 1, offset), F.lit(0))
    whole = F.regexp_extract(text, f"({java})", 1)
    start = F.length(F.regexp_extract(text, f"\\A([\\s\\S]*?)(?:{java})", 1)) + offset
    caught = [F.regexp_extract(text, f"({java})", k + 2) for k in range(re.groups)]
    found = F.struct(
        whole.alias("match"),
        (F.array(*caught) if caught else F.array()).cast("array<string>").alias("groups"),
        start.cast("bigint").alias("start"),
        (start + F.length(whole)).cast("bigint").alias("end"),
    )
    return F.when(text.rlike(java), found)


def find(text: Column, pattern: Pattern, start: int = 0, end: int | None = None) -> Column:
    """The leftmost match, as a struct of match, groups, start and end, or NULL."""
    re = compile_re(pattern)
    return _match(_within(text, start, end), re.java, re, start)


def matches(text: Column, pattern: Pattern) -> Column:
    """Whether the pattern is found anywhere: the predicate form of find()."""
    re = compile_re(pattern)
    return F.size(_found(text, re.anywhere, 1)) > 0 if re.long_loops else text.rlike(re.anywhere)


def match(text: Column, pattern: Pattern, start: int = 0, end: int | None = None, exact: bool = False) -> Column:
    """The match that begins at start; with exact, one that also ends at end, if any parse does."""
    re = compile_re(pattern)
    return _match(_within(text, start, end), f"\\A(?:{re.java})" + "\\z" * exact, re, start)


def all_matches(text: Column, pattern: Pattern, start: int = 0, end: int | None = None, offset: int = 0) -> Column:
    """All matches without overlaps as structs of match, groups, start and end, in order, from start + offset on."""
    return _found(_within(text, start, end), compile_re(pattern).java, 0, start, offset)


def find_all(text: Column, pattern: Pattern, start: int = 0, end: int | None = None) -> Column:
    """All matches without overlaps, as texts in order; an empty match advances by a character."""
    re, text = compile_re(pattern), _within(text, start, end)
    if re.long_loops:
        return F.transform(_found(text, re.java), lambda m: m["match"])
    return F.regexp_extract_all(text, F.lit(f"({re.java})"), F.lit(1))


def count(text: Column, pattern: Pattern) -> Column:
    re = compile_re(pattern)
    n = F.when(text.isNotNull(), F.size(_found(text, re.java))) if re.long_loops else F.regexp_count(text, F.lit(re.java))
    return n.cast("bigint")


def group(text: Column, pattern: Pattern, k: int) -> Column:
    """Group k (from 1; 0 is the match) of the leftmost match; NULL without a match."""
    re = compile_re(pattern)
    if re.long_loops:
        m = _match(text, re.java, re)
        return F.get(m["groups"], F.lit(k - 1)) if k else m["match"]
    return F.when(text.rlike(re.java), F.regexp_extract(text, f"({re.java})", k + 1))


def _pieces(text: Column, java: str, most: int) -> Column:
    """What lies between the matches, by Arrow batches; an empty match at the start divides nothing."""
    ship()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        r = _in_python(java)

        def one(t: str) -> list[str]:
            out, at = [], 0
            for m in r.finditer(t):
                if m.end():
                    out.append(t[at : m.start()])
                    at = m.end()
                    if len(out) == most:
                        break
            return [*out, t[at:]]

        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(text)


def split(text: Column, pattern: Pattern, start: int = 0, end: int | None = None) -> Column:
    """Struct (head, tail) around the first match; without one the head is the text and the tail NULL."""
    re, text = compile_re(pattern), _within(text, start, end)
    parts = _pieces(text, re.java, 1) if re.long_loops else F.split(text, re.java, 2)
    return F.struct(F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("tail"))


def split_all(text: Column, pattern: Pattern, coalesce: bool = False, start: int = 0, end: int | None = None) -> Column:
    """All pieces, the last included; with coalesce without the empty ones."""
    re, text = compile_re(pattern), _within(text, start, end)
    parts = _pieces(text, re.java, 0) if re.long_loops else F.split(text, re.java, -1)
    return F.filter(parts, lambda x: x != "") if coalesce else parts


def _plain(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _around(text: Column, start: int, end: int | None, put: Callable[[Column], Column]) -> Column:
    """text with put() of its window in the window's place."""
    if not start and end is None:
        return put(text)
    parts = [F.substring(text, F.lit(1), F.lit(start)), put(_within(text, start, end))]
    if end is not None:
        parts.append(F.substring(text, F.lit(max(start, end) + 1), F.length(text)))
    return F.concat(*parts)


def replace_all(text: Column, pattern: Pattern, replacement: str, start: int = 0, end: int | None = None) -> Column:
    """Each match replaced by the text as it stands."""
    re = compile_re(pattern)
    if re.long_loops:
        return _around(text, start, end, replace_with(re, lambda m, groups, x, y: replacement))
    return _around(text, start, end, lambda t: F.regexp_replace(t, re.java, _plain(replacement)))


def replace_first(text: Column, pattern: Pattern, replacement: str, start: int = 0, end: int | None = None) -> Column:
    """The leftmost match replaced by the text as it stands."""
    re = compile_re(pattern)
    if re.long_loops:
        return _around(text, start, end, replace_with(re, lambda m, groups, x, y: replacement, all=False))
    java = f"\\A([\\s\\S]*?)(?:{re.java})([\\s\\S]*)\\z"
    return _around(text, start, end, lambda t: F.regexp_replace(t, java, "$1" + _plain(replacement) + f"${re.groups + 2}"))


def rearrange(text: Column, pattern: Pattern, template: str, all: bool = True) -> Column:
    """Matches replaced by a template in which $1 to $9 are groups and $$ is the match."""
    re = compile_re(pattern)
    java, groups = re.java, re.groups
    out, i, pieces = [], 0, []
    while i < len(template):
        two = template[i : i + 2]
        if two == "$$":
            out.append("${g0}")
            pieces.append(0)
        elif two[0] == "$" and two[1:].isdigit():
            if not 1 <= int(two[1]) <= groups:
                raise ValueError(f"no group {two[1]}")
            out.append(f"${{g{two[1]}}}")
            pieces.append(int(two[1]))
        else:
            out.append(_plain(template[i]))
            pieces.append(template[i])
            two = template[i]
        i += len(two)
    if re.long_loops:
        return replace_with(re, lambda m, own, x, y: "".join(p if isinstance(p, str) else own[p - 1] if p else m for p in pieces), all)(text)
    named, k = [], 0
    for part in _parts(java):
        if part == "(":
            k += 1
            part = f"(?<g{k}>"
        named.append(part)
    java, to = f"(?<g0>{''.join(named)})", "".join(out)
    if all:
        return F.regexp_replace(text, java, to)
    return F.regexp_replace(text, f"\\A(?<before>[\\s\\S]*?){java}(?<after>[\\s\\S]*)\\z", "${before}" + to + "${after}")


def _parts(java: str) -> Iterator[str]:
    """The pattern's characters, escapes and sets whole, so that "(" alone opens a captured group."""
    i = 0
    while i < len(java):
        if java[i] == "\\":
            n = 4 if java[i + 1] == "x" else 2
        elif java[i] == "[":
            n, depth = 1, 1
            while depth:
                n += 2 if java[i + n] == "\\" else 1
                depth += {"[": 1, "]": -1}.get(java[i + n - 1], 0) if java[i + n - 2] != "\\" else 0
        elif java.startswith("(?", i):
            n = java.index(":", i) - i + 1 if java[i : i + 3] != "(?!" else 3
        else:
            n = 1
        yield java[i : i + n]
        i += n


def replace_with(pattern: Pattern, function: Callable[[str, list[str], int, int], str], all: bool = True) -> Callable[[Column], Column]:
    """A replacement by any function of (match, groups, start, end), by Arrow batches.

    A template or a text needs no Python on the executors and should be preferred.
    """
    java = compile_re(pattern).java
    ship()

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        r = _in_python(java)

        def one(m) -> str:
            return function(m[0], [g or "" for g in m.groups()], m.start(), m.end())

        return texts.map(lambda t: None if t is None else r.sub(one, t, count=0 if all else 1))

    return run


def match_string(m: Column) -> Column:
    return m["match"]


def match_groups(m: Column) -> Column:
    return m["groups"]


def match_start(m: Column) -> Column:
    return m["start"]


def match_end(m: Column) -> Column:
    return m["end"]


def with_match(m: Column, then: Callable[[dict[str, Column]], Column], no_match: Column | None = None) -> Column:
    """then() of the names $$, $1 to $9, $_ and $* where there is a match, else no_match.

    $_ holds the groups beyond the ninth and $* all groups.
    """
    beyond = F.slice(m["groups"], 10, F.greatest(F.size(m["groups"]) - 9, F.lit(0)))
    names = {"$$": m["match"], "$_": beyond, "$*": m["groups"]} | {f"${k}": F.get(m["groups"], F.lit(k - 1)) for k in range(1, 10)}
    return F.when(m.isNotNull(), then(names)).otherwise(F.lit(None) if no_match is None else no_match)
