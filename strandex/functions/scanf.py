"""scanf over a text column: a format is compiled on the driver to anchored regular expressions.

Each conversion is one typed field; scanning stops at the first mismatch, fields not reached are NULL, and
`matched` tells whether the whole format was read. Quantifiers are possessive, as scanf never goes back.

| directive | field |
|-|-|
| %d %u | BIGINT, with a sign |
| %i | BIGINT: 0x.. is hexadecimal, 0.. octal |
| %o %x | BIGINT from octal, hexadecimal (0x may lead; 0 without x is 0) |
| %a %e %f %g | DOUBLE; an exponent counts only after a point |
| %s | STRING up to white space, may be empty |
| %c | STRING of one character; with a width ARRAY<STRING> of so many |
| %[..] %[^..] | STRING of characters in or not in the set, not empty |
| %n | BIGINT, the characters read so far |
| %% and others | themselves; white space is any amount of it |

* after % drops the field, a number limits its width. With a width a float is the run of at most so many of a
float's characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex_dialect import literal

#: Fixed value: white space of formats and texts.
SPACE = " \\t\\r\\n\\f"


@dataclass
class Step:
    """One directive: its expression, with a group if it makes a field of this kind."""

    java: str
    kind: str = ""


def _times(least: int, width: int | None) -> str:
    return f"{{{least},{width}}}+" if width else "*+" if not least else "++"


def _signed(digits: str, width: int | None) -> str:
    if not width:
        return f"[+-]?+{digits}++"
    plain = f"{digits}{{1,{width}}}+"
    return f"(?:[+-]{digits}{{1,{width - 1}}}+|{plain})" if width > 1 else plain


def _set(fmt: str, at: int) -> tuple[str, int]:
    """A Java set from the characters after an opening bracket, and where the format goes on."""
    negated = fmt[at : at + 1] == "^"
    at += negated
    out, first = [], at
    while True:
        c = fmt[at : at + 1]
        if not c:
            raise ValueError(f"set is not closed: {fmt!r}")
        if c == "]" and at > first:
            break
        if fmt[at + 1 : at + 2] == "-" and fmt[at + 2 : at + 3] not in ("]", ""):
            end = fmt[at + 2]
            if c <= end:
                out.append(f"{literal(c)}-{literal(end)}")
            at += 3
        else:
            out.append(literal(c))
            at += 1
    return f"[{'^' * negated}{''.join(out)}]", at + 1


def compile_format(fmt: str) -> list[Step]:
    steps, at = [], 0
    while at < len(fmt):
        c = fmt[at]
        at += 1
        if c in " \t\r\n\f":
            steps.append(Step(f"[{SPACE}]*+"))
            continue
        if c != "%":
            steps.append(Step(literal(c)))
            continue
        keep = fmt[at : at + 1] != "*"
        at += not keep
        start = at
        while fmt[at : at + 1].isdigit():
            at += 1
        width = int(fmt[start:at]) if at > start else None
        kind = fmt[at : at + 1]
        at += 1
        if kind and kind in "du":
            java, field = _signed("[0-9]", width), "int"
        elif kind == "i":
            n = _times(1, width)
            java, field = f"(?:0[xX][0-9A-Fa-f]{n}|0[0-7]{_times(0, width)}|{_signed('[0-9]', width)})", "any"
        elif kind == "o":
            java, field = _signed("[0-7]", width), "octal"
        elif kind == "x":
            java, field = f"(?:0[xX][0-9A-Fa-f]{_times(1, width)}|0(?![xX])|{_signed('[0-9A-Fa-f]', width)})", "hex"
        elif kind and kind in "aAeEfFgG":
            exponent = "(?:[eE][+-]?+[0-9]++)?+"
            java = f"[0-9.eE+-]{{1,{width}}}+" if width else f"[+-]?+(?:[0-9]++(?:\\.[0-9]*+{exponent})?+|\\.[0-9]++{exponent})"
            field = "float"
        elif kind and kind in "sS":
            java, field = f"[^{SPACE}]{_times(0, width)}", "text"
        elif kind and kind in "cC":
            java, field = f"[\\s\\S]{{{width or 1}}}", "chars" if width else "text"
        elif kind == "[":
            chars, at = _set(fmt, at)
            java, field = chars + _times(1, width), "text"
        elif kind == "n":
            java, field = "", "count"
        elif kind == "%":
            steps.append(Step("%"))
            continue
        else:
            raise ValueError(f"invalid directive: %{kind}")
        if keep:
            steps.append(Step(f"({java})", field))
        else:
            steps.append(Step(f"(?:{java})?+" if field in ("int", "any", "octal", "hex", "float") else f"(?:{java})"))
    return steps


def _number(x: Column, base: int) -> Column:
    sign = F.when(F.startswith(x, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(x, "^[+-]", "")
    if base == 16:
        digits = F.regexp_replace(digits, "^0[xX]", "")
    return sign * F.conv(digits, base, 10).try_cast("bigint")


def _field(x: Column, kind: str) -> Column:
    if kind == "int":
        return x.try_cast("bigint")
    if kind == "any":
        return F.when(x.rlike("^0[xX]"), _number(x, 16)).when(x.rlike("^0."), _number(x, 8)).otherwise(x.try_cast("bigint"))
    if kind in ("octal", "hex"):
        return _number(x, {"octal": 8, "hex": 16}[kind])
    if kind == "float":
        return x.try_cast("double")
    if kind == "chars":
        return F.split(x, "")
    if kind == "count":
        return F.length(x).cast("bigint")
    return x


def scanf(text: Column, fmt: str, names: list[str] | None = None, start: int = 0, end: int | None = None) -> Column:
    """A struct of the fields (named f1, f2, .. or as given) and matched; NULL for a NULL text."""
    steps = compile_format(fmt)
    if start or end is not None:
        n = F.length(text) if end is None else F.lit(end)
        text = F.substring(text, F.lit(start + 1), F.greatest(n - start, F.lit(0)))
    fields, prefix, groups, ok = [], "\\A", 0, F.lit(True)
    for step in steps:
        if step.kind == "count":
            value, group = f"({prefix})", 1
            reached = prefix
        else:
            prefix += step.java
            if not step.kind:
                continue
            groups += 1
            value, group, reached = prefix, groups, prefix
        raw = _field(F.regexp_extract(text, value, group), step.kind)
        if step.kind == "count" and start:
            raw = raw + start
        if step.kind == "float":
            ok = ok & raw.isNotNull()
        name = names[len(fields)] if names else f"f{len(fields) + 1}"
        fields.append(F.when(text.rlike(reached) & ok, raw).alias(name))
    return F.when(text.isNotNull(), F.struct(*fields, (text.rlike(prefix) & ok).alias("matched")))
