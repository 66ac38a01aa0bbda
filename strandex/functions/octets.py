"""Octet strings: one byte is one character. Bytes compare as unsigned, letters are those of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .single import lit, octets

#: Fixed values.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SUBSTITUTE = "?"


def upcase(text: Column) -> Column:
    """a-z to A-Z; nothing else changes."""
    return F.translate(text, LOWER, UPPER)


def downcase(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def capitalize(text: Column) -> Column:
    """Words of ASCII letters and digits with a leading capital, the rest in lower case."""
    words = F.split(F.regexp_replace(downcase(text), "([A-Za-z0-9]+)", "\u0001$1"), "\u0001", -1)
    first = lambda w: F.concat(upcase(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(first(w))), "")


def char_code(text: Column) -> Column:
    """The code of the first character."""
    return F.ascii(text).cast("bigint")


def ascii_char_code(text: Column) -> Column:
    """The low 8 bits of the first character's code."""
    return F.ascii(text).bitwiseAND(255).cast("bigint")


def code_char(code: Column) -> Column:
    return F.char(code)


def is_alpha(char: Column) -> Column:
    return char.rlike("^[A-Za-z]$")


def is_alphanumeric(char: Column) -> Column:
    return char.rlike("^[A-Za-z0-9]$")


def is_upper(char: Column) -> Column:
    return char.rlike("^[A-Z]$")


def is_lower(char: Column) -> Column:
    return char.rlike("^[a-z]$")


def is_both_case(char: Column) -> Column:
    return is_alpha(char)


def is_graphic(char: Column) -> Column:
    return char.rlike("^[ -~]$")


def is_standard(char: Column) -> Column:
    return char.rlike("^[ -~\n]$")


def digit_value(char: Column, radix: int = 10) -> Column:
    """The digit's weight, or NULL if it is none in this radix (2 to 36)."""
    at = F.call_function("instr", F.lit("0123456789" + LOWER), downcase(char)) - 1
    return F.when((F.length(char) == 1) & (at >= 0) & (at < radix), at).cast("bigint")


def digit_char(weight: Column, radix: int = 10) -> Column:
    return F.when((weight >= 0) & (weight < radix), F.substring(F.lit("0123456789" + UPPER), weight.cast("int") + 1, F.lit(1)))


def char_at(text: Column, index: Column | int) -> Column:
    """The character at a 0-based index, NULL outside."""
    i = lit(index)
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, (i + 1).cast("int"), F.lit(1)))


def subseq(text: Column, start: int, end: int | None = None) -> Column:
    """[start, end), clipped to the text."""
    n = F.length(text) if end is None else F.lit(end)
    return F.substring(text, F.lit(start + 1), F.greatest(n - start, F.lit(0)))


def mismatch(a: Column, b: Column, start1: int = 0, end1: int | None = None, start2: int = 0, end2: int | None = None) -> Column:
    """The index in a of the first difference between two slices, or NULL if they are equal."""
    x, y = subseq(a, start1, end1), subseq(b, start2, end2)
    same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p.eqNullSafe(q))
    at = F.array_position(same, False)
    short = F.least(F.length(x), F.length(y))
    found = F.when(x == y, None).when(short == 0, F.lit(0)).otherwise(at - 1)
    return (found + start1).cast("bigint")


def equal(a: Column, b: Column, **bounds: int) -> Column:
    x, y = subseq(a, bounds.get("start1", 0), bounds.get("end1")), subseq(b, bounds.get("start2", 0), bounds.get("end2"))
    return x == y


def compare(op: str, a: Column, b: Column, start1: int = 0, end1: int | None = None, start2: int = 0, end2: int | None = None) -> Column:
    """For <, >, <=, >= or != of two slices: the index in a of the first difference if the comparison holds, else NULL.

    Equal slices give the end of a's for <= and >=.
    """
    x, y = subseq(a, start1, end1), subseq(b, start2, end2)
    holds = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "!=": x != y}[op]
    at = F.coalesce(mismatch(x, y), F.length(x).cast("bigint"))
    return F.when(holds, at + start1)


def compare_folded(op: str, a: Column, b: Column, **bounds: int) -> Column:
    """compare() without regard to ASCII case."""
    return compare(op, downcase(a), downcase(b), **bounds)


def compare_chars(op: str, a: Column, *more: Column) -> Column:
    """Whether =, /=, <, >, <= or >= holds between each character and the next; /= between all of them."""
    all_of = [a, *more]
    pairs = [(x, y) for i, x in enumerate(all_of) for y in all_of[i + 1 :]] if op == "/=" else list(zip(all_of, more, strict=False))
    out = F.lit(True)
    for x, y in pairs:
        out = out & {"=": x == y, "/=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return out


def trim(bag: str, text: Column, side: str = "both") -> Column:
    """Without the bag's characters at the ends."""
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](text, F.lit(bag))


def substitution(text: Column, table: dict[str, str]) -> Column:
    """Each character by the table; others stay."""
    return F.translate(text, "".join(table), "".join(table.values()))


def to_string(data: Column, start: int = 0, end: int | None = None, table: dict[str, str] | None = None) -> Column:
    """Bytes as text, through a substitution table; by default byte 0 becomes a question mark."""
    return substitution(subseq(octets(data), start, end), {"\0": SUBSTITUTE} if table is None else table)


def from_string(text: Column) -> Column:
    """Text as bytes, the low 8 bits of each character's code."""
    low = F.transform(F.split(text, ""), lambda x: F.when(x == "", "").otherwise(F.lpad(F.hex(F.ascii(x).bitwiseAND(255)), 2, "0")))
    return F.unhex(F.array_join(low, ""))


def from_octets(codes: Column) -> Column:
    """An array of codes 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
