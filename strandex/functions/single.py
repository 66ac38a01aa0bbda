"""One pattern in a text column: position, window, containment, counts, prefixes, hashes.

Positions are 0-based code points as BIGINT; NULL means no match, and a NULL input gives NULL. An empty
pattern is found at 0. A literal pattern is a constant of the plan, so the JVM's string search runs
inside generated code and predicates reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base and modulus of the rolling hash.
HASH_BASE, HASH_MODULUS = 256, 723925871


def lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def position(text: Column, pattern: Column | str) -> Column:
    """The first place of pattern in text."""
    return _zero_based(F.call_function("instr", text, lit(pattern)))


def _zero_based(at: Column) -> Column:
    return (F.nullif(at, F.lit(0)) - 1).cast("bigint")


def position_in(text: Column, pattern: Column | str, start: int = 0, end: int | None = None, pattern_start: int = 0, pattern_end: int | None = None) -> Column:
    """The first place, in the whole text, of a slice of pattern within [start, end) of the text.

    The match lies inside the window; an empty slice is found at 0 whatever the window.
    """
    p = lit(pattern)
    if pattern_start or pattern_end is not None:
        n = F.length(p) if pattern_end is None else F.lit(pattern_end)
        p = F.substring(p, F.lit(pattern_start + 1), F.greatest(n - pattern_start, F.lit(0)))
    window = text if end is None else F.substring(text, F.lit(1), F.lit(end))
    return F.when(F.length(p) == 0, F.when(text.isNotNull(), F.lit(0))).otherwise(
        _zero_based(F.call_function("locate", p, window, F.lit(start + 1)))
    ).cast("bigint")


def octets(data: Column) -> Column:
    """Binary as text, one character for each byte."""
    return F.decode(data, "ISO-8859-1")


def position_octets(data: Column, pattern: Column) -> Column:
    """The first place of a binary pattern in binary data."""
    return position(octets(data), octets(pattern))


class Pattern:
    """A pattern to look for in many texts: the counterpart of a prepared index."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def search(self, text: Column, start: int = 0, end: int | None = None) -> Column:
        return position_in(text, self.pattern, start, end)


def matcher(prepare: Callable[[Column], Column] = lambda x: x) -> Callable[[Column, Column], Column]:
    """A search over texts and patterns that are first prepared alike, as case folding or octets."""
    return lambda text, pattern: position(prepare(text), prepare(lit(pattern)))


def contains(text: Column, pattern: Column | str) -> Column:
    """Whether pattern is in text; a literal pattern is pushed down to Parquet."""
    return F.contains(text, lit(pattern))


def count(text: Column, pattern: str) -> Column:
    """How many times pattern occurs, left to right, without overlaps; an empty pattern never."""
    if not pattern:
        return F.when(text.isNotNull(), F.lit(0)).cast("bigint")
    gone = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return (gone / len(pattern)).cast("bigint")


def quoted(pattern: str) -> str:
    """A Java regular expression that matches just this text."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def positions(text: Column, pattern: str) -> Column:
    """All places of pattern in order, without overlaps; an empty pattern has none.

    The text is split once and the pieces' lengths are summed, so the cost follows the text's length.
    """
    if not pattern:
        return F.when(text.isNotNull(), F.array().cast("array<bigint>"))
    n = len(pattern)
    pieces = F.split(text, quoted(pattern), -1)
    start = F.struct(F.lit(-n).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))

    def add(acc: Column, piece: Column) -> Column:
        at = acc["at"] + n + F.length(piece)
        return F.struct(at.alias("at"), F.array_append(acc["found"], at).alias("found"))

    return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, add, lambda acc: acc["found"])


def prefixed_with(text: Column, prefix: Column | str) -> Column:
    return F.startswith(text, lit(prefix))


def suffixed_with(text: Column, suffix: Column | str) -> Column:
    return F.endswith(text, lit(suffix))


def horner_hash(text: Column, length: int) -> Column:
    """The polynomial hash of the first characters' codes, base 256 modulo a prime."""
    codes = F.transform(F.split(F.substring(text, F.lit(1), F.lit(length)), ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: (h * HASH_BASE + x) % HASH_MODULUS)


def _by_name(text_last: Callable) -> Callable[[str, Column], Column]:
    return lambda pattern, text: text_last(text, pattern)


#: The algorithms a user may name. All have one meaning, and the engine's own search carries them out.
string_contains_brute = string_contains_bm = string_contains_bmh = string_contains_bmh8 = _by_name(position)
string_contains_rk = string_contains_kmp = string_contains_sor = _by_name(position)
string_contains_ac = string_contains_tabac = string_contains_cw = _by_name(position)
string_contains_brute_ub = _by_name(position_octets)
initialize_bm = initialize_bmh = initialize_bmh8 = initialize_rk = initialize_kmp = initialize_sor = Pattern


def search(index: Pattern, text: Column, start: int = 0, end: int | None = None) -> Column:
    return index.search(text, start, end)


search_bm = search_bmh = search_bmh8 = search_rk = search_kmp = search_sor = search
