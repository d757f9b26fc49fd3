"""Column expressions over file contents: sniff, decode, lines, hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions import fixed, paths

# Every character besides "\n" that ends a line ("\r\n" is one end).
OTHER_LINE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    A named column does not ensure that: Spark copies its expression into every
    filter it pushes down.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looks_binary(content: Column) -> Column:
    """A NUL byte among the first bytes of a binary column."""
    return F.contains(F.substring(content, 1, fixed.SNIFF_BYTES), F.lit(bytearray(b"\x00")))


def decode(content: Column) -> Column:
    """Text of a binary column: UTF-8 where valid, else one char per byte."""
    return F.coalesce(
        F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")
    )


def unify_line_ends(text: Column) -> Column:
    """The text with every line end as ``\n``.

    Plain substring tests tell whether there is anything to do; they cost a
    fraction of a regular expression, and most texts need no more.
    """
    found = paths.any_of(F.contains(text, F.lit(c)) for c in OTHER_LINE_ENDS)
    pattern = r"\r\n|[" + "".join(OTHER_LINE_ENDS) + "]"
    return F.when(found, F.regexp_replace(text, pattern, "\n")).otherwise(text)


def line_body(unified: Column) -> Column:
    """The lines joined by ``\\n``: the text without its last line end."""
    return F.when(
        unified.endswith("\n"),
        F.substring(unified, F.lit(1), F.length(unified) - 1),
    ).otherwise(unified)


def line_count(unified: Column) -> Column:
    """Number of lines, counted without building an array."""
    ends = F.octet_length(unified) - F.octet_length(F.replace(unified, F.lit("\n"), F.lit("")))
    last = F.when((unified == "") | unified.endswith("\n"), 0).otherwise(1)
    return (ends + last).cast("int")


def lines(unified: Column) -> Column:
    """The lines as an array; only for operators that need single lines."""
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(
        F.split(line_body(unified), "\n")
    )


def content_hash(unified: Column) -> Column:
    return F.sha2(line_body(unified), 256)
