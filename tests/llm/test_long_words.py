"""Unbroken words of any length are encoded as the library does."""

import random
import string
import time

import public_tokenizers
import pytest
import sentencepiece

from bindery.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def words(seed):
    rng = random.Random(seed)
    alphabets = [string.ascii_lowercase, "ab", "aA1", string.ascii_letters + string.digits + "+/=", "the", "é漢字かな\U0001f600x", "0123456789"]
    sizes = [pieces.LONG - 1, pieces.LONG, pieces.LONG + 1, 200, 1500]
    out = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in sizes]
    out += [c * n for c in "a=-0é" for n in (*sizes, 4096)]
    parts = "function return private static international tion ing".split()
    out += ["".join(rng.choice(parts) for _ in range(n)) for n in (10, 100, 700)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_long_words_equal_the_library(library, seed):
    found = words(seed)
    rng = random.Random(-seed)
    texts = [*found, " ".join(found), "  ".join(rng.sample(found, 9)) + " short words too", "", "x"]
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    ids, sizes, decoded = model.encode(texts)
    start = 0
    for text, size, back in zip(texts, sizes, decoded, strict=True):
        want = [*library.encode(text), library.eos_id()]
        assert ids[start : start + size].tolist() == want
        assert back == library.decode(want)
        start += size


def test_waiting_merges_equal_the_library(library):
    """As if every rank could be undercut: each word merges one place a round."""
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model.safe[:] = False
    texts = [w[:600] for w in words(9)]
    ids, sizes, _ = model.encode(texts)
    ends = sizes.cumsum()
    assert [ids[e - n : e - 1].tolist() for e, n in zip(ends, sizes, strict=True)] == [library.encode(t) for t in texts]


def test_time_does_not_grow_with_the_square():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    seconds = []
    for size in (20_000, 320_000):
        text = "".join(rng.choice(string.ascii_lowercase) for _ in range(size))
        start = time.process_time()
        model.encode([text])
        seconds.append(time.process_time() - start)
    assert seconds[1] < 64 * seconds[0] + 1  # 16 times the letters; 256 times if squared
