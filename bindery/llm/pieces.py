"""SentencePiece encoding and decoding in vectorised merge rounds.

The words of many texts are laid out as one flat numpy array of symbols.  In each
round every word finds the best rank among its neighbouring pairs (a segmented
minimum) and merges it where it stands leftmost; ranks that no merge can undercut
are merged at all their non-overlapping places of the word at once.  Merged symbols
are compacted away, finished words leave the arrays, and rounds end when no pair is
left.  Long words have many rounds that merge little; theirs go through the ranks in order,
each over the places that hold the rank and their neighbours, with symbols linked and
compacted at the end, so that the work grows with the merges.  Pieces never span a change from text to a word mark, so words are independent
and each distinct word is encoded once per store.

Models: BPE with byte fallback, identity normalisation, a dummy prefix, and word
marks only at the front of a piece; other models are refused.

Null and empty texts have the end id alone and decode to the empty text.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import chunks

MARK = "▁"
NONE = np.int32(1 << 30)
FOREIGN = 1 << 20  # symbols from here on are code points without a piece
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words of more symbols are merged rank by rank.
LONG = 64
#: A worker starts its store of distinct words anew before the chunk after this many.
STORE_WORDS = 100_000


class PairTable:
    """An open-addressed table from symbol pairs to merge ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(4 * max(1, len(ranks))).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = self.key(left, right)
        slots = self.slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            self.keys[slots[free]] = keys[free]  # of several that want a slot, the last gets it
            won = free[self.keys[slots[free]] == keys[free]]
            self.ranks[slots[won]] = ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        slots = self.slot(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            there = self.keys[slots[todo]]
            hit = todo[there == keys[todo]]
            found[hit] = self.ranks[slots[hit]]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return found


class Store(dict):
    """Numbers words in the order they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        found = self[word] = len(self)
        return found


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        normal = {names[i]: i for i in range(size) if not special[i]}
        if any(MARK in p.lstrip(MARK) or p.startswith(2 * MARK) and p.strip(MARK) for p in normal):
            raise ValueError("word marks must stand alone or once at the front of a piece")
        if any(model.is_unused(i) for i in range(size)) or model.unk_id() in self.bytes:
            raise ValueError("the model needs byte fallback and no unused pieces")
        if model.normalize(" ﬁ  x ") != f"{2 * MARK}ﬁ{2 * MARK}x{MARK}":
            raise ValueError("the model must not normalise texts")
        # What an id decodes to: a string, or a byte.
        self.decoded = [names[i].replace(MARK, " ") if not special[i] else "" for i in range(size)]
        self.widths = np.array(list(map(len, self.decoded)))
        self.is_byte = np.isin(np.arange(size), self.bytes)
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        self.runs = {len(p): i for p, i in normal.items() if not p.strip(MARK)}
        self._symbols(normal, size)
        self._pairs(normal, model)
        self._clear()

    def _symbols(self, normal: dict[str, int], size: int) -> None:
        self.symbol = dict(normal)
        for char in sorted(set("".join(normal)) - set(normal)):
            self.symbol[char] = size + len(self.symbol) - len(normal)
        self.of_char = np.arange(0x110000, dtype=np.int32) + FOREIGN
        self.of_char[:128] = self.bytes[:128]
        for piece, i in self.symbol.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.char_of = {i: ord(c) for c, i in self.symbol.items() if i >= size}
        self.size = size

    def _pairs(self, normal: dict[str, int], model) -> None:
        """Ranks order merges by score; runs of marks are joined apart from the rounds."""
        merges = sorted((p for p in normal if len(p) > 1 and p.strip(MARK)), key=lambda p: (-model.get_score(normal[p]), normal[p]))
        if len({model.get_score(normal[p]) for p in merges}) < len(merges):
            raise ValueError("scores of pieces must differ")
        rank = {p: r for r, p in enumerate(merges)}
        self.piece = np.array([normal[p] for p in merges], np.int32)
        safe = np.ones(len(merges) + 1, bool)
        left, right, ranks = [], [], []
        for piece, r in rank.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in self.symbol and b in self.symbol:
                    left.append(self.symbol[a])
                    right.append(self.symbol[b])
                    ranks.append(r)
                    for half in (a, b):
                        if rank.get(half, -1) > r:  # a merge may open a better one
                            safe[rank[half]] = False
        self.safe = safe
        self.table = PairTable(np.array(left), np.array(right), np.array(ranks, np.int32))

    def _clear(self) -> None:
        self.index = Store()
        self.texts: list[str] = []
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    # Encoding ---------------------------------------------------------------

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one word after the other, and how many each has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.of_char[chars]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        names = np.arange(len(words))
        word = np.repeat(names, lengths)
        ranks = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        ranks[inner] = self.table.find(symbols[inner], symbols[inner + 1])
        done_words, done_symbols = [], []
        long = lengths > LONG
        if long.any():
            mask = np.repeat(long, lengths)
            found = self._by_rank(symbols[mask], ranks[mask], word[mask])
            done_words.append(found[0])
            done_symbols.append(found[1])
            symbols, ranks, names, lengths = symbols[~mask], ranks[~mask], names[~long], lengths[~long]
        while len(symbols):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            low = np.minimum.reduceat(ranks, starts)
            live = low < NONE
            if not live.all():
                mask = np.repeat(live, lengths)
                done_words.append(np.repeat(names[~live], lengths[~live]))
                done_symbols.append(symbols[~mask])
                symbols, ranks = symbols[mask], ranks[mask]
                names, lengths, low = names[live], lengths[live], low[live]
                if not len(symbols):
                    break
            word = np.repeat(np.arange(len(names)), lengths)
            at = np.flatnonzero(ranks == low[word])
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            heads = np.flatnonzero(run)
            even = (np.arange(len(at)) - heads[np.cumsum(run) - 1]) % 2 == 0
            at = at[first | (self.safe[ranks[at]] & even)]
            symbols[at] = self.piece[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks, word = symbols[keep], ranks[keep], word[keep]
            lengths = np.bincount(word, minlength=len(names))
            at = at - np.arange(len(at))
            near = np.concatenate((at, at[at > 0] - 1))
            near = near[near + 1 < len(symbols)]
            ranks[at[at + 1 == len(symbols)]] = NONE
            same = word[near] == word[near + 1]
            ranks[near[~same]] = NONE
            near = near[same]
            ranks[near] = self.table.find(symbols[near], symbols[near + 1])
        word = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        symbols = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int32)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def _by_rank(self, symbols: np.ndarray, ranks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and symbols that are left when the best rank of all words is merged again and again.

        Words do not touch each other, so each sees its own merges in order.
        """
        size = len(symbols)
        # One place more stands before the first and behind the last symbol.
        symbols, ranks = np.append(symbols, 0), np.append(ranks, NONE)
        word = np.append(word, -1)
        after = np.minimum(np.arange(1, size + 2), size)
        before = np.append(np.arange(-1, size - 1), size - 1)
        before[0] = size
        alive = np.ones(size + 1, bool)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def file(at: np.ndarray) -> None:
            order = at[np.argsort(ranks[at], kind="stable")]
            found = ranks[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(order)]
            for start, stop, rank in zip(cuts[:-1], cuts[1:], found[cuts[:-1]].tolist(), strict=True):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(queue, rank)
                places[rank].append(order[start:stop])

        some = np.flatnonzero(ranks < NONE)
        if len(some):
            file(some)
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            run = np.ones(len(at), bool)
            run[1:] = after[at[:-1]] != at[1:]
            heads = np.flatnonzero(run)
            even = (np.arange(len(at)) - heads[np.cumsum(run) - 1]) % 2 == 0
            rest, at = at[~even], at[even]
            if not self.safe[rank]:  # a word merges up to the first place that opens a better pair; the others wait
                piece = np.full(len(at), self.piece[rank])
                left, right = before[at], after[after[at]]
                merged = np.concatenate(([False], after[at[:-1]] == left[1:]))
                better = (self.table.find(np.where(merged, piece, symbols[left]), piece) < rank) & (word[left] == word[at])
                better |= (self.table.find(piece, symbols[right]) < rank) & (word[right] == word[at])
                seen = np.cumsum(better) - better
                starts = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
                wait = seen > seen[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
                rest, at = np.concatenate((rest, at[wait])), at[~wait]
            gone = after[at]
            ahead = after[gone]
            symbols[at] = self.piece[rank]
            alive[gone], ranks[gone] = False, NONE
            after[at], before[ahead] = ahead, at
            near = np.concatenate((at, before[at]))
            same = word[near] == word[after[near]]
            ranks[near[~same]] = NONE
            near = near[same]
            ranks[near] = self.table.find(symbols[near], symbols[after[near]])
            near = np.concatenate((near[ranks[near] < NONE], rest[ranks[rest] == rank]))
            if len(near):
                file(near)
        left = np.flatnonzero(alive[:size])
        return word[left], symbols[left]

    def marks(self, count: int) -> list[int]:
        """Ids of a run of word marks: the leftmost pair that makes a piece merges first."""
        out: list[int] = []
        for _ in range(count):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return [self.runs[n] for n in out]

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols; those without a piece become the bytes of their character."""
        out: list[int] = []
        for s in symbols.tolist():
            if s < self.size:
                out.append(s)
            else:
                char = chr(self.char_of[s] if s in self.char_of else s - FOREIGN)
                out += self.bytes[list(char.encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode new words and decode their ids."""
        bodies, before = list(words), {}
        for i, word in enumerate(words):
            if word.startswith(2 * MARK) or word == MARK:
                before[i] = lead = len(word) - len(word.lstrip(MARK))
                bodies[i] = word[lead - 1 :] if lead < len(word) else ""
        symbols, counts = self.merge(bodies)
        ends = np.cumsum(counts)
        odd = set(np.searchsorted(ends, np.flatnonzero(symbols >= self.size), side="right").tolist()) | set(before)
        parts, done = [], 0
        for i in sorted(odd):
            start, stop, lead = int(ends[i] - counts[i]), int(ends[i]), before.get(i, 0)
            part = self.ids_of(symbols[start:stop])
            if lead == len(words[i]):
                part = np.array(self.marks(lead), np.int32)
            elif lead:
                alone = part[0] == self.runs[1]  # a mark that joined no letter joins the run
                run = self.marks(lead if alone else lead - 1)
                part = np.concatenate((np.array(run, np.int32), part[1:] if alone else part))
            parts += [symbols[done:start], part]
            counts[i], done = len(part), stop
        symbols = np.concatenate([*parts, symbols[done:]])
        self.texts += self._decode_words(symbols, counts)
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
        self.flat = np.concatenate((self.flat, symbols.astype(np.int32)))

    def _decode_words(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each word's ids, cut from the text of all; words with bytes apart."""
        text = "".join([self.decoded[i] for i in ids.tolist()])
        ends = np.cumsum(counts)
        cuts = np.concatenate(([0], np.cumsum(self.widths[ids])))[ends].tolist()
        out = [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[ids]), side="right")).tolist():
            out[i] = self.joined(ids[ends[i] - counts[i] : ends[i]].tolist())
        return out

    def joined(self, ids: list[int]) -> str:
        """The text of pieces; bytes that stand together are one UTF-8 string."""
        text = "".join([self.decoded[i] for i in ids])
        if not any(i in self.byte_of for i in ids):
            return text
        parts, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            parts += [raw.decode("utf-8", "replace"), self.decoded[i]]
            raw.clear()
        return "".join([*parts, raw.decode("utf-8", "replace")])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        return self.joined(ids).removeprefix(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, how many each has, and the texts decoded from them."""
        words, ends = [], [0]
        for text in texts:
            if text:
                words += WORDS.findall(MARK + text.replace(" ", MARK))
            ends.append(len(words))
        if len(self.index) > STORE_WORDS:
            self._clear()
        order = list(map(self.index.__getitem__, words))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._learn(new)
        at = np.array(order, np.int64)
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.array(ends)
        total = np.concatenate(([0], np.cumsum(counts)))
        # Positions of all ids in the store, with a gap after each text for the end id.
        places = np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], counts)
        sizes = total[ends[1:]] - total[ends[:-1]]
        ids = np.full(total[-1] + len(texts), self.end, np.int32)
        ids[np.arange(total[-1]) + np.repeat(np.arange(len(texts)), sizes)] = self.flat[places]
        known = self.texts
        decoded = ["".join([known[i] for i in order[a:b]])[1:] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return ids, sizes + 1, decoded


@functools.lru_cache(2)
def model_at(path: str | None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(path)


ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encoded(text: Column, path: str | None = None) -> Column:
    """A struct of the ids of a text, the end id last, and the text decoded from them.

    ``path`` names the model on the executors; by default the public 32k BPE model.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encode(texts: pa.Array) -> pa.Array:
        model = model_at(path)
        ids, sizes, decoded = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], []
        for run in chunks(texts):
            found = model.encode(run)
            ids.append(found[0])
            sizes.append(found[1])
            decoded += found[2]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string())], fields=list(ENCODED))

    return encode(text)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (the end id last) and ``decoded``, the text its ids decode to."""
    found = docs.select("doc_id", encoded(docs["text"], path).alias("_"))
    return found.select("doc_id", "_.ids", "_.decoded")
