"""Column functions for text: tokens, detokenising, blank tests.

All of them are built-in Spark expressions (codegen, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Token separator: runs of ASCII white space
# (space, tab, line feed, vertical tab, form feed, carriage return).
# The same pattern is used in the DuckDB oracle SQL.
TOKEN_SPLIT = r"[ \t\n\x0B\f\r]+"

# End-of-text marker removed on decode.
END_MARKER = "</s>"


def _python_space_class() -> str:
    """Character class of every code point Python's ``str.strip`` removes,
    built from ``str.isspace`` so blank-line tests agree with a Python reader."""
    ranges = []
    start = prev = None
    for cp in range(0x110000):
        if chr(cp).isspace():
            if start is None:
                start = prev = cp
            elif cp == prev + 1:
                prev = cp
            else:
                ranges.append((start, prev))
                start = prev = cp
    ranges.append((start, prev))
    parts = []
    for a, b in ranges:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "".join(parts)


PY_SPACE_CLASS = _python_space_class()
# A line is usable when it has at least one character Python does not strip.
NON_BLANK = f"[^{PY_SPACE_CLASS}]"


def tokens(text: Column | str) -> Column:
    """``array<string>`` of white-space separated tokens (empty ones dropped)."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, TOKEN_SPLIT), lambda t: t != F.lit(""))


def detokenise(toks: Column | str, marker: str = END_MARKER) -> Column:
    """Join tokens with one space, dropping the end-of-text marker."""
    col = F.col(toks) if isinstance(toks, str) else toks
    return F.concat_ws(" ", F.filter(col, lambda t: t != F.lit(marker)))


def is_non_blank(text: Column | str) -> Column:
    """True when the string has a character that Python's ``strip`` keeps."""
    col = F.col(text) if isinstance(text, str) else text
    return col.rlike(NON_BLANK)


def truthy_string(col: Column) -> Column:
    """Python truthiness of an optional string: not null and not empty."""
    return F.nullif(col, F.lit(""))
