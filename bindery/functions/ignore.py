"""Ignore files: one regular expression per file, last matching line wins.

The text of an ignore file becomes one pattern whose alternatives stand in
reverse line order.  Java takes the first alternative that matches, so that is
the last line of the file that applies.  The subject carries a tail, and an
alternative consumes ``+`` when its line ignores and ``+-`` when it re-includes;
the end of the match tells the outcome.  Files of one tree share a pattern, and
``regexp_extract`` keeps the last compiled one; ``scan.with_reason`` clusters rows by tree.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAIL = "\x00+-"


def _segment(seg: str) -> str:
    """Regular expression of one path segment; wildcards stay inside it."""
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "\\" and i + 1 < len(seg):
            i += 1
            out.append(_quote(seg[i]))
        elif ch == "*":
            out.append("[^/\\x00]*")
        elif ch == "?":
            out.append("[^/\\x00]")
        elif ch == "[":
            negate = seg[i + 1 : i + 2] in ("!", "^")
            first = i + 1 + negate
            close = seg.find("]", first + 1)
            if close < 0:
                out.append(r"\[")
            else:
                members = re.sub(r"([\\\[\]^&])", r"\\\1", seg[first:close])
                out.append(("[^/\\x00" if negate else "[") + members + "]")
                i = close
        else:
            out.append(_quote(ch))
        i += 1
    return "".join(out)


def _quote(ch: str) -> str:
    return "\\" + ch if ord(ch) < 128 and not ch.isalnum() and ch not in "_/" else ch


def line_regex(line: str) -> tuple[bool, str] | None:
    """(ignores, regex over the whole path) of one line; None if it has no effect."""
    line = line.lstrip() if line.endswith("\\ ") else line.strip()
    if not line or line.startswith("#") or line == "/":
        return None
    ignores = not line.startswith("!")
    body = line if ignores else line[1:]
    if not body or body == "/":
        return None
    below_only = body.endswith("/")
    segs = body.strip("/").split("/") if body.strip("/") else []
    segs = [s for i, s in enumerate(segs) if s != "**" or i == 0 or segs[i - 1] != "**"]
    if segs == ["**"]:
        # "**/" needs a directory; "**" and "/**" take everything.
        return ignores, "[^\\x00]+/[^\\x00]*" if below_only else "[^\\x00]+"
    if not segs:
        return None
    anchored = body.startswith("/") or "/" in body.rstrip("/")
    out = "" if anchored else "(?:[^\\x00]+/)?"
    glue = False
    for i, seg in enumerate(segs):
        last = i == len(segs) - 1
        if seg == "**" and i == 0:
            out += "(?:[^\\x00]+/)?"
        elif seg == "**" and last:
            return ignores, out + "/[^\\x00]*"
        elif seg == "**":
            out += "(?:/[^\\x00]+)?"
            glue = True
        else:
            out += ("/" if glue else "") + ("[^/\\x00]+" if seg == "*" else _segment(seg))
            glue = True
    return ignores, out + ("/[^\\x00]*" if below_only else "(?:/[^\\x00]*)?")


def file_regex(text: str | None) -> str:
    """One pattern for a whole ignore file, ``""`` when no line has an effect."""
    found = [line_regex(line) for line in (text or "").splitlines()]
    tails = {True: r"\x00\+", False: r"\x00\+-"}
    parts = [regex + tails[ignores] for ignores, regex in reversed([f for f in found if f])]
    return "^(?:" + "|".join(f"(?:{p})" for p in parts) + ")" if parts else ""


@F.pandas_udf(T.StringType())
def ignore_regex(texts: pd.Series) -> pd.Series:
    """Pattern of each ignore-file text: one row per source tree."""

    def regex(value) -> str:
        # Bytes that are not UTF-8 are dropped, as only comments tend to hold them.
        return file_regex(value.decode("utf-8", "ignore") if isinstance(value, bytes) else value)

    return texts.map(regex)


def is_ignored(path: Column, regex: Column) -> Column:
    """Whether an ignore file drops the path; false without an ignore file."""
    match = F.call_function("regexp_extract", F.concat(path, F.lit(TAIL)), regex, F.lit(0))
    return F.when(regex.isNull() | (regex == ""), False).otherwise(match.endswith("+"))
