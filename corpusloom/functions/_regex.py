"""One pattern language for both engines: Java's regular expressions and Python's ``regex``.

Patterns are written in the common linear-time dialect: Unicode-aware classes, ``(?P<name>...)`` groups,
bracket class names such as ``[[:alpha:]]``, set difference ``[a--b]`` and intersection ``[a&&b]``, and no
look-around or back-references. ``translate`` gives the equivalent for each engine or raises ``ValueError``.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

CLASSES = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9a-zA-Z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "blank": r"\t ",
    "punct": r"!-/:-@\[-`{-~", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7F",
}


class Patterns(NamedTuple):
    java: str
    python: str


def _class(p: str, i: int) -> tuple[str, str, int]:
    """The bracket class that opens at ``p[i]``, for Java and Python, and where it ends."""
    java, python, i = "[", "[", i + 1
    if i < len(p) and p[i] == "^":
        java, python, i = java + "^", python + "^", i + 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return java + "]", python + "]", i + 1
        if p.startswith("[:", i) and (end := p.find(":]", i)) > 0:
            name = p[i + 2 : end]
            negated = name.startswith("^")
            body = CLASSES.get(name.lstrip("^"))
            if body is None:
                raise ValueError(f"unknown class name in pattern: {name}")
            part = f"[{'^' * negated}{body}]"
            java, python, i = java + part, python + part, end + 2
        elif c == "[":
            j, y, i = _class(p, i)
            java, python = java + j, python + y
        elif p.startswith("--", i):
            j, y, i = _rest(p, i + 2)
            return f"{java}&&[^{j}]]", f"{python}--[{y}]]", i
        elif c == "\\":
            if i + 1 >= len(p):
                break
            java, python, i = java + p[i : i + 2], python + p[i : i + 2], i + 2
        else:
            part = "\\]" if c == "]" else c
            java, python, i = java + part, python + part, i + 1
        first = False
    raise ValueError(f"a class isn't closed in pattern: {p}")


def _rest(p: str, i: int) -> tuple[str, str, int]:
    """The right side of a set difference, without its closing bracket."""
    j, y, end = _class("[" + p[i:], 0)
    return j[1:-1], y[1:-1], i + end - 1


@lru_cache(maxsize=512)
def translate(pattern: str) -> Patterns:
    java, python, i = [], [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise ValueError("a pattern can't end in a backslash")
            nxt = pattern[i + 1]
            if nxt.isdigit() or nxt == "k":
                raise ValueError("back-references aren't supported")
            both = pattern[i : i + 2]
            java.append(both)
            python.append("\\Z" if both == "\\z" else both)
            i += 2
        elif c == "[":
            j, y, i = _class(pattern, i)
            java.append(j)
            python.append(y)
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
            raise ValueError("look-around and atomic groups aren't supported")
        elif pattern.startswith("(?P<", i):
            java.append("(?<")
            python.append("(?P<")
            i += 4
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise ValueError("possessive quantifiers aren't supported")
        else:
            java.append(c)
            python.append(c)
            i += 1
    out = Patterns("(?U)" + "".join(java), "(?V1)" + "".join(python))
    try:
        regex.compile(out.python)
    except regex.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return out


@lru_cache(maxsize=512)
def compiled(pattern: str) -> regex.Pattern:
    """The ``regex`` form, compiled once per worker."""
    return regex.compile(translate(pattern).python)


def columns(expr):
    """A column from a name or a column."""
    from pyspark.sql import functions as F

    return F.col(expr) if isinstance(expr, str) else expr
