"""A vectorised helper for nested text: spans and pieces that brackets and quotes delimit."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "([{", ")]}"


def _tokens(text: str):
    """(position, character) of what is outside string literals; a doubled quote stays inside."""
    i = 0
    while i < len(text):
        if text[i] == '"':
            i += 1
            while i < len(text):
                if text[i] == '"':
                    if text[i + 1 : i + 2] != '"':
                        break
                    i += 1
                i += 1
        else:
            yield i, text[i]
        i += 1


def pieces(text: str | None, sep: str = ",") -> list[str]:
    """Parts of a text between separators at nesting depth 0, trimmed; an unmatched closing bracket ends the text."""
    if text is None:
        return []
    out, depth, start = [], 0, 0
    for i, c in _tokens(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth < 0:
                return [*out, text[start:i].strip()]
        elif c == sep and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


_BRACKETS = re.compile(r'"(?:[^"]|"")*(?:"|$)|[(\[{)\]}]')


def spans(text: str | None, opener: re.Pattern) -> list[str]:
    """Argument texts of the calls that opener (ending in an open bracket) matches outside string literals, in order; calls without an end are left out.

    One pass: open brackets are held on a stack, and a closing one ends the call, if any, that the last of them began.
    """
    text = text or ""
    begins = {m.end() - 1 for m in opener.finditer(text)}
    stack: list[int] = []
    found: dict[int, str] = {}
    if begins:
        for m in _BRACKETS.finditer(text):
            c = m[0]
            if c in _OPEN:
                stack.append(m.start())
            elif c in _CLOSE and stack and (at := stack.pop()) in begins:
                found[at] = text[at + 1 : m.start()]
    return [found[at] for at in sorted(found)]


def split_top(text: Column, sep: str = ",") -> Column:
    """Parts of a text between separators outside brackets and string literals."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, sep))

    return run(text)


def call_arguments(text: Column, functions: list[str]) -> Column:
    """Argument texts of the calls of the named functions, in order, case-insensitive."""
    opener = re.compile(r"\b(?:" + "|".join(map(re.escape, functions)) + r")\s*\(", re.I)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: spans(t, opener))

    return run(text)
