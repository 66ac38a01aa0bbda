"""The percent-class regular-expression dialect, translated to Java's on the driver.

| dialect | meaning |
|-|-|
| . | any character, line ends too |
| ^ first, $ last | start and end of the text; elsewhere ordinary characters |
| x? x* x+ x- | optional, any, some, some but as few as possible |
| a\\|b, ( ), (? ) | choice, group, group without capture |
| %bxy | from x to the nearest y |
| %s %t %n %a %l %u %d %w %x %p | space or tab, tab, line end, letter, lower, upper, digit, word, hex, punctuation; upper case: all others |
| % and another | that character |
| [..] [^..] | sets, with ranges and % classes; - first or last is ordinary; the first ] closes |

Counted repeats, back references and lookaround don't exist; braces and backslashes are ordinary.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

#: What each class holds, as the inside of a Java character set.
CLASSES = {
    "s": " \\t",
    "t": "\\t",
    "n": "\\r\\n",
    "a": "\\p{L}",
    "l": "\\p{Ll}",
    "u": "\\p{Lu}",
    "d": "0-9",
    "w": "\\p{L}\\p{Nd}_",
    "x": "0-9A-Fa-f",
    "p": "`~!@#$%\\^&*()\\-+=\\[\\]{}|;:',./<>?\"",
}
#: Quantifiers.
QUANTIFIERS = {"?": "?", "*": "*", "+": "+", "-": "+?"}

_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ ")


def literal(char: str) -> str:
    """A character outside a set."""
    return char if char in _PLAIN or ord(char) > 127 else f"\\x{ord(char):02x}"


def _class(char: str) -> tuple[str, bool] | None:
    """(contents, complemented) of a class letter."""
    inside = CLASSES.get(char.lower()) if char.isascii() else None
    return (inside, char.isupper()) if inside else None


class Re(NamedTuple):
    """A compiled pattern.

    long_loops: Java would recurse once for each turn of a group's loop, and long texts end its stack. anywhere: what is
    found in the same texts, but without the repeats at the ends, so that no run is scanned once for each of its characters.
    """

    pattern: str
    java: str
    groups: int
    long_loops: bool
    anywhere: str


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups, self.long_loops = pattern, 0, 0, False

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError(f"pattern ends too early: {self.pattern!r}")
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self, depth: int) -> tuple[str, bool]:
        """Alternatives up to a closing parenthesis or the end, and whether all they match has one length without a choice.

        Alternatives of one character each become one set.
        """
        branches: list[list[tuple[str, str]]] = [[]]
        plain: list[list[tuple[str, str]]] = [[]]
        while self.peek() and not (self.peek() == ")" and depth):
            if self.peek() == "|":
                self.take()
                branches.append([])
                plain.append([])
                continue
            atom, kind = self.atom(depth)
            plain[-1].append((atom, self.peek() if self.peek() in QUANTIFIERS else ""))
            if self.peek() in QUANTIFIERS and self.peek():
                self.long_loops |= kind == "free" and self.peek() != "?"
                atom, kind = atom + QUANTIFIERS[self.take()], "varied"
                if self.peek() in QUANTIFIERS and self.peek():
                    raise ValueError(f"two quantifiers in a row: {self.pattern!r}")
            branches[-1].append((atom, kind))
        self.anywhere = "|".join(map(_without_ends, plain))  # of the outermost in the end
        if len(branches) > 1 and all(len(x) == 1 and x[0][1] == "one" for x in branches):
            return f"[{''.join(x[0][0] for x in branches)}]", True
        fixed = len(branches) == 1 and all(kind in ("one", "fixed") for _, kind in branches[0])
        return "|".join("".join(atom for atom, _ in x) for x in branches), fixed

    def atom(self, depth: int) -> tuple[str, str]:
        """An atom and its kind: one character, a fixed length, a free group, or what no loop repeats or varies."""
        first = self.at == 0
        c = self.take()
        if c == "%":
            return self.escaped()
        if c == "[":
            found = self.charset()
            return found, "varied" if found == "(?!)" else "one"
        if c == "(":
            capture = self.peek() != "?"
            if capture:
                self.groups += 1
            else:
                self.take()
            inner, fixed = self.choice(depth + 1)
            if self.peek() != ")":
                raise ValueError(f"group is not closed: {self.pattern!r}")
            self.take()
            return f"({inner})" if capture else f"(?:{inner})", "fixed" if fixed else "free"
        if c == ".":
            return "[\\s\\S]", "one"
        if c == "^" and first:
            return "\\A", "varied"
        if c == "$" and self.at == len(self.pattern):
            return "\\z", "varied"
        if c in ")]?*+-":
            raise ValueError(f"misplaced {c}: {self.pattern!r}")
        return literal(c), "one"

    def escaped(self) -> tuple[str, str]:
        c = self.take()
        if c == "b":
            return f"(?:{literal(self.take())}[\\s\\S]*?{literal(self.take())})", "free"
        found = _class(c)
        return f"[{'^' * found[1]}{found[0]}]" if found else literal(c), "one"

    def charset(self) -> str:
        out, negated = [], self.peek() == "^"
        if negated:
            self.take()
        first = True
        while (c := self.take()) != "]":
            if c == "%":
                c = self.take()
                if found := _class(c):
                    out.append(f"[^{found[0]}]" if found[1] else found[0])
                    first = False
                    continue
            elif c == "-" and not first and self.peek() != "]":
                raise ValueError(f"range without a start: {self.pattern!r}")
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                end = self.take()
                if end == "%":
                    end = self.take()
                    if _class(end):
                        raise ValueError(f"range to a class: {self.pattern!r}")
                # a range that runs backwards holds nothing
                if c <= end:
                    out.append(f"{literal(c)}-{literal(end)}")
            else:
                out.append(literal(c))
            first = False
        inside = "".join(out)
        if not inside:
            return "[\\s\\S]" if negated else "(?!)"
        return f"[{'^' * negated}{inside}]"


def _without_ends(atoms: list[tuple[str, str]]) -> str:
    """Atoms and their quantifiers, without what repeats or may be missing at both ends."""
    atoms = list(atoms)
    for end in (0, -1):
        while atoms and atoms[end][1] in ("?", "*") and atoms[end][1]:
            atoms.pop(end)
        if atoms and atoms[end][1]:
            atoms[end] = atoms[end][0], ""
    return "".join(atom + (QUANTIFIERS[q] if q else "") for atom, q in atoms)


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> Re:
    if not pattern:
        raise ValueError("empty pattern")
    r = _Reader(pattern)
    java, _ = r.choice(0)
    return Re(pattern, java, r.groups, r.long_loops, r.anywhere)


def compile_re(pattern: str | Re) -> Re:
    """The compiled form, which every function takes in place of a pattern; ValueError for what the dialect doesn't allow."""
    return pattern if isinstance(pattern, Re) else _compiled(pattern)


def group_count(pattern: str | Re) -> int:
    return compile_re(pattern).groups
