"""Secret scans: dictionary-primed zstandard novelty.

Candidates are strings that three base patterns find and long strings of key
characters that follow a sensitive word closely, also in a name before ``=``, over line ends
and one after the other (the lines of a key); of those, the parts outside base findings.  Each candidate is
compressed with a dictionary of the code around it and of common identifiers; the
marginal bytes per character are its novelty.  Base findings are always reported;
other candidates only if they are incompressible, with or without digits, and not spelled like
names: short strings cost about a byte a letter whatever they are, so what the letters cost by the
letter pairs of the dictionary tells a rare identifier from a key.  Strings under 16 characters
are candidates of the base patterns only.

Null and empty texts have no spans, an empty table has no rows.  Repeated rows are scanned each for
itself.  Very long texts are scanned whole; a candidate of any length is measured in pieces, each
next to 256 code points on both sides.  Spans count code points, ends exclusive, and are ordered by start, then kind.
Only ``doc_id`` and ``text`` are read; ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|auth|bearer|private|access", re.A | re.I)
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: What stands between the lines of one key.
GAP = re.compile(r"(?:[\s\"'+,]|\\[nr]?)*")
#: Code points before a candidate that may hold the sensitive word, and on each side that prime the compressor.
REACH, AROUND = 48, 256
#: Bytes measured at once: from 64 on the compressor codes single letters, so keys of a small alphabet would look compressible.
PIECE = 48
#: Marginal compressed bytes per character from which a candidate counts as incompressible.
NOVELTY = 0.8
# Words that names in code are made of; they prime the compressor and tell how such names are spelled.
WORDS = (
    "abstract access account action address allow argument array assert attribute balance base batch binary boolean branch buffer "
    "builder cache cancel channel character charset check child clock close collect column complete config context control convert "
    "cookie count current cursor database date delete depth device directory disable dispatch document domain download dynamic element "
    "empty enable encode engine entry enumerate error escape event example exception execute exist expect external factory failure "
    "feature field filter flag follow format frame function handle hash header height host identifier image import initial input insert "
    "instance interface interrupt invalid iterator keyboard language level library limit line link list literal local lock logger "
    "lookup machine manager map match member memory message method module mutex name network node object offset operation parameter "
    "parse pattern platform pointer prefix process property protocol proxy query queue random range reference register replace resource "
    "result return root schema scope script select sequence server service session shutdown signal socket source space special stack "
    "start state status stream string struct suffix switch symbol system table target template text thread unique unknown upload "
    "variable verify virtual worker xml yield zip zone"
)
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key credential "
    "authorization bearer username account client_id client_secret session cookie config setting "
    "default example sample placeholder changeme undefined none null true false function return "
    "import export const static public private protected class object string integer number value "
    "index length buffer request response header content-type application/json https://www. http:// "
    "localhost database connection environment variable process.env os.environ getenv include "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 _test _name _path _file _type"
)
#: Bits per character up to which a candidate is spelled like a name; what a digit and another mark count.
SPELLED, DIGIT, MARK = 5.0, 8.0, 3.0
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("novelty", pa.float64())])
SPAN_SQL = "array<struct<kind:string,start:bigint,stop:bigint,novelty:double>>"


def letter_costs(words: str) -> np.ndarray:
    """Bits of a letter (1 to 26) after another one, as in ``words``; 0 is the end of a word."""
    found = np.full((27, 27), 0.5)
    for word in re.findall("[a-z]+", words):
        places = [0, *(ord(c) - 96 for c in word), 0]
        np.add.at(found, (places[:-1], places[1:]), 1)
    return -np.log2(found / found.sum(axis=1, keepdims=True))


COSTS = letter_costs(f"{WORDS} {IDENTIFIERS}")


def pieces(raw: str) -> list[str]:
    """The pieces of equal length in which a candidate is measured."""
    count = -(-len(raw) // PIECE)
    ends = [i * len(raw) // count for i in range(count + 1)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def spelling(candidate: str) -> float:
    """Bits per character of a candidate read as a name: words of letters, cut at changes of case and other marks.

    Long candidates are measured in pieces of equal length, and the largest value counts.
    """
    return max(map(bits, pieces(candidate)))


def bits(piece: str) -> float:
    found, letters = 0.0, 0
    for part in PART.findall(piece):
        places = [0, *(ord(c) - 96 for c in part.lower()), 0]
        found += COSTS[places[:-1], places[1:]].sum()
        letters += len(part)
    digits = sum(c.isdigit() for c in piece)
    return (found + DIGIT * digits + MARK * (len(piece) - letters - digits)) / len(piece)


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes the candidate adds, per byte, once its surroundings are known.

    Long candidates are measured in pieces of equal length, and the largest value counts.
    """
    primed = zstandard.ZstdCompressionDict(f"{WORDS} {IDENTIFIERS} {around}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
    least = len(packer.compress(b""))
    return max((len(packer.compress(p.encode())) - least) / len(p.encode()) for p in pieces(candidate))


def spans_of(text: str, threshold: float = NOVELTY) -> list[dict]:
    """All spans of one text."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    taken = sorted((a, b, value) for _, a, b, value in found)
    at, last = 0, -REACH - 1
    out = []
    for match in LONG.finditer(text):
        stop = match.end()
        while at < len(taken) and taken[at][1] <= match.start():
            at += 1
        for start, named in values_of(text, *match.span()):
            follows = start - last <= REACH and GAP.fullmatch(text, last, start)
            if not (named or follows or SENSITIVE.search(text, max(0, start - REACH), start)):
                continue
            parts = [(a, b, novelty(text[a:b], around(text, a, b))) for a, b in outside(start, stop, taken, at)]
            if parts := [("novel", *p) for p in parts if p[2] >= threshold and spelling(text[p[0] : p[1]]) > SPELLED]:
                out += parts
                last = stop
                break
    for kind, start, stop, value in found:
        out.append((kind, start, stop, novelty(text[value:stop], around(text, value, stop))))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [dict(zip(("kind", "start", "stop", "novelty"), s, strict=True)) for s in out]


def outside(start: int, stop: int, taken: list[tuple[int, int, int]], at: int) -> list[tuple[int, int]]:
    """The parts of a candidate outside base spans that are long enough; what leads to the name in a span belongs to the name."""
    out = []
    while start < stop:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        a, b, value = taken[at] if at < len(taken) else (stop, stop, stop)
        if min(a, stop) - start >= LEAST and not a < value <= stop:
            out.append((start, min(a, stop)))
        start = b if a < stop else stop
    return out


def values_of(text: str, start: int, stop: int) -> list[tuple[int, bool]]:
    """Where the value of a run of key characters may start, and whether a sensitive name stands right before it.

    A part that holds a sensitive word and ends at an inner ``=`` is a name.
    What follows the first name is tried first, then what follows the last, then the whole run.
    """
    end = start + len(text[start:stop].rstrip("="))
    out, part = [], start
    while (cut := text.find("=", part, end)) >= 0:
        named = SENSITIVE.search(text, part, cut)
        part = cut + 1
        while text[part] == "=":
            part += 1
        if named and stop - part >= LEAST:
            out.append((part, True))
    return [*dict.fromkeys([*out[:1], *out[-1:]]), (start, False)]


def around(text: str, start: int, stop: int) -> str:
    return text[max(0, start - AROUND) : start] + text[stop : stop + AROUND]


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for span in spans_of(text):
        if span["start"] >= done:
            out += [text[done : span["start"]], mark]
        done = max(done, span["stop"])
    return "".join([*out, text[done:]]) if out else text


def spans(text: Column) -> Column:
    """Spans of a text column, as an array of structs."""

    @F.arrow_udf(SPAN_SQL)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array((spans_of(t.as_py() or "") for t in texts), pa.list_(SPAN))

    return scan(text)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` of every document."""
    return docs.select("doc_id", spans(docs["text"]).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets masked; ``n_chars`` follows where there is one."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array((None if (s := t.as_py()) is None else redacted(s) for t in texts), pa.string())

    out = docs.withColumn("text", mask(docs["text"]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
