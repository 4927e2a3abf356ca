"""Glob and regular-expression sets as one Java pattern each, for a single `rlike` literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import ConfigError, Patterns

_SPECIAL = set("\\.[]{}()*+-?^$|&~# \t")


def glob(pattern: str) -> str:
    """A glob as a pattern for the whole text: * any run, ? one character, [..] and [!..] classes, {a,b} choices, backslash quotes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if end < 0:
                raise ConfigError(f"invalid glob: {pattern}")
            body = pattern[i:end]
            negated = body[:1] in ("!", "^")
            body = "".join("\\" + x if x in "\\[]^&" else x for x in (body[1:] if negated else body))
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "}" or (c == "\\" and i == len(pattern)):
            raise ConfigError(f"invalid glob: {pattern}")
        else:
            if c == "\\":
                c = pattern[i]
                i += 1
            out.append("\\" + c if c in _SPECIAL else c)
    if depth:
        raise ConfigError(f"invalid glob: {pattern}")
    return f"(?s:\\A{''.join(out)}\\z)"


def regex(pattern: str) -> str:
    """A regular expression without look-around or back-references, with a `$` that means the very end."""
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ConfigError(f"invalid regex: {pattern}")
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append("\\z" if c == "$" and not inside else c)
        i += 1
    try:
        re.compile("".join(out).replace("\\z", "\\Z"))
    except re.error as e:
        raise ConfigError(f"invalid regex: {pattern}: {e}") from e
    return "(?:" + "".join(out) + ")"


def compile_set(s: Patterns) -> str | None:
    """One alternation, or None for an empty set, which matches nothing."""
    parts = [*map(glob, s.globs), *map(regex, s.regexes)]
    if not parts:
        return None
    return f"(?{'iu' if s.case_insensitive else ''}Ud)(?:{'|'.join(parts)})"


def matches(c: Column, s: Patterns) -> Column:
    p = compile_set(s)
    return F.lit(False) if p is None else F.coalesce(c.rlike(p), F.lit(False))
