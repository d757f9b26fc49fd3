import hashlib
import random

from pyspark.sql import functions as F

from bindery.functions import text

V = F.col("v")
ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def samples():
    fixed = ["", "a", "a\n", "a\n\n", "\n", "\n\n", "a\r\nb\rc", "x\r\n\r\n", "a\x1fb", "\ufeffa\nb", "é\u2028ü"]
    fixed += ["a" + e for e in ENDS] + ["a" + e + "b" for e in ENDS] + ["".join(ENDS)]
    rng = random.Random(5)
    pieces = ENDS + ["a", "bc", "é", " ", "\x1f", "😀"]
    return fixed + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(300)]


def test_lines_counts_and_hashes_follow_splitlines(evaluate):
    values = samples()
    unified = text.unify_line_ends(V)
    lines = [v.splitlines() for v in values]
    assert evaluate(values, text.lines(unified)) == lines
    assert evaluate(values, text.line_count(unified)) == [len(x) for x in lines]
    assert evaluate(values, text.line_body(unified)) == ["\n".join(x) for x in lines]
    want = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in lines]
    assert evaluate(values, text.content_hash(unified)) == want


def test_decode_falls_back_to_one_char_per_byte(evaluate):
    raw = [b"abc", "é😀".encode(), b"caf\xe9", b"\xef\xbb\xbfx", b"", b"\xff\x00"]
    want = ["abc", "é😀", "café", "\ufeffx", "", "ÿ\x00"]
    assert evaluate([bytearray(r) for r in raw], text.decode(V), "binary") == want


def test_sniff_looks_at_the_first_bytes_only(evaluate):
    raw = [b"", b"a\x00", b"a" * 4095 + b"\x00", b"a" * 4096 + b"\x00", b"abc"]
    got = evaluate([bytearray(r) for r in raw], text.looks_binary(V), "binary")
    assert got == [False, True, True, False, False]
