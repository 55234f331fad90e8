"""Text expressions with Unicode classes and newline as the only line end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of every pattern: ``.`` stops at newline only, classes are Unicode ones.
FLAGS = "(?dU)"
#: White space as ``str.strip`` sees it (a fixed set), and the line ends ``str.splitlines`` knows besides newline.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def newlines(c: Column) -> Column:
    """Every line end as a newline."""
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))


def decode_utf8(content: Column) -> Column:
    """Bytes as text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def without_last_end(c: Column) -> Column:
    return F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def lines(text: Column) -> Column:
    """Lines of a text whose line ends are newlines; a final one adds no line."""
    return F.split(without_last_end(text), "\n")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def extract(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern that is known to match (an unmatched optional group is an empty string)."""
    return F.regexp_extract(c, FLAGS + pattern, group)


def anchored(pattern: str) -> str:
    """A user's header pattern, tied to the start of a line."""
    return "^(?:" + pattern.removeprefix("^") + ")"


def split_entries(text: Column, header_pattern: str) -> Column:
    """Multi-line entries of a text: each begins at a line that the header matches; what stands before the first is dropped.

    ``text`` has newlines only. An entry's lines are joined by newlines, without the last line end."""
    head = anchored(header_pattern)
    pieces = F.split(text, f"(?m){FLAGS}(?={head})")
    return F.transform(F.filter(pieces, lambda p: matches(p, head)), without_last_end)


def preamble_lines(text: Column, header_pattern: str) -> Column:
    """Number of lines before the first header (all lines, if there is none)."""
    head = anchored(header_pattern)
    first = F.element_at(F.split(text, f"(?m){FLAGS}(?={head})"), 1)
    return F.when((text == "") | matches(text, head), 0).otherwise(F.size(lines(first)))
