"""Text patterns: blank test and LIKE search."""

from __future__ import annotations

from pyspark.sql import Column

_BLANK = r"(?U)^[\s\x{FEFF}]*$"


def blank(text: Column) -> Column:
    """Whether text is empty or white space only, by Unicode."""
    return text.rlike(_BLANK)


def like_pattern(q: str) -> str:
    r"""%q% with %, _ and \ of q as wildcards and escape, as Spark takes it.

    An escape before an ordinary character stands for that character, and one at the end makes the closing % literal.
    """
    out, i, whole = [], 0, f"%{q}%"
    while i < len(whole):
        c = whole[i]
        if c == "\\" and i + 1 < len(whole):
            i += 1
            c = whole[i] if whole[i] not in "%_\\" else "\\" + whole[i]
        out.append(c)
        i += 1
    return "".join(out)


def matches(text: Column, q: str) -> Column:
    """Case-insensitive LIKE '%q%'."""
    return text.ilike(like_pattern(q))
