"""Glob patterns over keys, compiled on the driver to one anchored regular expression.

``*`` and ``**`` are any run, separators included; ``?`` is one character;
``[abc]``, ``[a-z]``, ``[^x]``, ``[!x]`` are sets; ``\\`` takes the next character
as it is. The literal text before the first wildcard is kept apart, so that a
scan can push it down to the file as a prefix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """The pattern is empty or a bracket is left open."""


def _quoted(c: str) -> str:
    return "\\" + c if not c.isalnum() and ord(c) < 128 else c


@dataclass(frozen=True)
class Pattern:
    raw: str
    regex: str
    prefix: str
    is_literal: bool
    has_double_star: bool

    def matches(self, key: str) -> bool:
        return re.fullmatch(self.regex.removeprefix(r"(?s)\A").removesuffix(r"\z"), key, re.S) is not None

    def condition(self, key: Column, byte_wise: bool = False) -> Column:
        """The predicate on a key column. ``byte_wise`` lets ``?`` and sets match bytes instead of characters."""
        if self.is_literal:
            return key == self.prefix
        target = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1") if byte_wise else key
        found = target.rlike(self.regex)
        return key.startswith(self.prefix) & found if self.prefix else found


def _set(pattern: str, i: int) -> tuple[str, int]:
    """Regular expression of the set that opens at i, and where it ends."""
    i += 1
    negated = i < len(pattern) and pattern[i] in "^!"
    i += negated
    members: list[tuple[str, str]] = []
    while i < len(pattern) and pattern[i] != "]":
        escaped = pattern[i] == "\\" and i + 1 < len(pattern)
        i += escaped
        low = pattern[i]
        i += 1
        # An escaped member stands for itself and begins no range.
        if not escaped and i + 1 < len(pattern) and pattern[i] == "-" and pattern[i + 1] != "]":
            high = pattern[i + 1]
            i += 2
            members.append((min(low, high), max(low, high)))
        else:
            members.append((low, low))
    if i >= len(pattern):
        raise PatternError(f"unmatched bracket in {pattern!r}")
    if not members:
        return "." if negated else "(?!)", i + 1
    body = "".join(_quoted(a) if a == z else f"{_quoted(a)}-{_quoted(z)}" for a, z in members)
    return f"[{'^' * negated}{body}]", i + 1


def compile_glob(pattern: str) -> Pattern:
    """Parse a pattern; PatternError if it is empty or has an open bracket."""
    if not pattern:
        raise PatternError("empty pattern")
    out, prefix, i, literal, double = [], [], 0, True, False
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            double |= pattern[i : i + 2] == "**"
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(".*")
            literal = False
        elif c == "?":
            out.append(".")
            literal, i = False, i + 1
        elif c == "[":
            body, i = _set(pattern, i)
            out.append(body)
            literal = False
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(_quoted(c))
            if literal:
                prefix.append(c)
            i += 1
    return Pattern(pattern, rf"(?s)\A{''.join(out)}\z", "".join(prefix), literal, double)


def glob_match(pattern: str, key: str) -> bool:
    """Whether a key matches; PatternError for a bad pattern."""
    return compile_glob(pattern).matches(key)
