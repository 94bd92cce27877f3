"""BPE encoding and decoding with a public vocabulary whose words end in a mark.

The vocabulary file gives normalisation (NFC, white space, lower case), the
pattern of words, byte symbols and ranked merges; its place is a parameter.
A word is a contiguous array: the boundaries of its parts, their numbers and the
rank of each adjacent pair.  The least rank is found by a scan, its boundary deleted and the
two neighbouring ranks refreshed.  That is fastest for short words; a word of
more than ``LONG`` bytes goes through a heap of pairs with the same result, so
time stays near linear.  No word holds a space, so a text is first cut at spaces,
and each task keeps the ids of the pieces and of the words it has met.

Defined cases: null text is empty and has no tokens; special strings of the
vocabulary found in a text become their ids, as in the file's own library;
repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import per_text

#: Words beyond which the pair ranks are kept in a heap.
LONG = 256
#: Words, and pieces between spaces, a task remembers before it starts anew.
REMEMBER = 400_000


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for byte in range(256):
        if byte in plain:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Remembered(dict):
    """Ids by string, made on first sight; strings over ``longest`` are made each time."""

    def __init__(self, make: Callable[[str], Sequence[int]], most: int = REMEMBER, longest: int = LONG) -> None:
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> Sequence[int]:
        made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


class WordBpe:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.symbols = byte_symbols()
        # a number for every string a part can be, so that a pair is one number
        strings = [*self.symbols, *(s + self.end for s in self.symbols), *(x for a, b in self.ranks for x in (a, b, a + b))]
        self.code = {x: k for k, x in enumerate(dict.fromkeys(strings))}
        self.pair_rank = {self.code[a] << 32 | self.code[b]: rank for (a, b), rank in self.ranks.items()}
        self.merged = {rank: self.code[a + b] for (a, b), rank in self.ranks.items()}
        self.none = len(model["merges"])
        self.decimal = {i: str(i) for i in self.names}
        self.words, self.pieces = Remembered(self._word), Remembered(self._piece)

    def merge(self, word: str) -> list[str]:
        """Parts of a word of byte symbols."""
        n = len(word)
        whole = word + self.end
        if n > LONG:
            return self._merge_long(whole, n)
        cuts = [*range(n), len(whole)]
        get, none = self.pair_rank.get, self.none
        codes = [*map(self.code.__getitem__, word[:-1]), self.code[whole[n - 1:]]]
        ranks = [get(a << 32 | b, none) for a, b in zip(codes, codes[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            del cuts[k + 1], codes[k + 1], ranks[k]
            codes[k] = here = self.merged[least]
            if k < len(ranks):
                ranks[k] = get(here << 32 | codes[k + 1], none)
            if k:
                ranks[k - 1] = get(codes[k - 1] << 32 | here, none)
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, whole: str, n: int) -> list[str]:
        """The same for long words: a heap of ranked pairs over linked parts."""
        end = [*range(1, n), len(whole)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        get = self.ranks.get
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else -1
            if b >= 0:
                found = get((whole[a:end[a]], whole[b:end[b]]))
                if found is not None:
                    heapq.heappush(heap, (found, a, end[b]))

        for a in range(n):
            offer(a)
        while heap:
            rank, a, last = heapq.heappop(heap)
            b = after[a] if alive[a] else -1
            if b < 0 or end[b] != last or get((whole[a:end[a]], whole[b:end[b]])) != rank:
                continue
            end[a], after[a], alive[b] = end[b], after[b], False
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [whole[a:end[a]] for a in range(n) if alive[a]]

    def _word(self, word: str) -> tuple[int, ...]:
        symbols, ids = self.symbols, self.ids
        return tuple([ids[p] for p in self.merge("".join([symbols[b] for b in word.encode()])) if p in ids])

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.find(piece))))

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character; white space only separates words."""
        if not text.isascii():
            # the final sigma has no form of its own when characters are lowered one by one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode_ids(self, text: str) -> list[int]:
        """Ids of a text."""
        ids: list[int] = []
        held = self.pieces.__getitem__
        parts = self.cut_special.split(text) if any(s in text for s in self.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(held, self.normal(part).split(" "))))
        return ids

    def digits(self, ids: list[int]) -> str:
        """Ids in decimal, joined by spaces."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids in decimal and names, both joined by spaces."""
        ids = self.encode_ids(text)
        return len(ids), self.digits(ids), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Names of ids, special ones included, joined by spaces; other ids have none."""
        names = list(map(self.names.get, ids))
        return " ".join([n for n in names if n is not None] if None in names else names)


_HELD: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of a file, read once per worker process."""
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def encode_texts(docs: DataFrame, path: str, keep=("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids (array<int>) and decoded text per row."""

    def make():
        bpe = word_bpe(path)

        def compute(texts: list[bytes]):
            ids = [bpe.encode_ids(t.decode()) for t in texts]
            return [list(map(len, ids)), ids, list(map(bpe.decode, ids))]

        return compute

    return per_text(docs, make, [("n_tokens", "bigint"), ("ids", "array<int>"), ("decoded", "string")], keep)


def row_digests(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and digest of what the ids decode to."""
    ids = bpe.encode_ids(text)
    return tuple([len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (bpe.digits(ids), bpe.decode(ids)))])


def encode_digests(docs: DataFrame, path: str, keep=("doc_id",)) -> DataFrame:
    """``keep``, n_tokens and the digests of ids and decoded text per row; the
    lists themselves never leave the task."""

    def make():
        bpe = word_bpe(path)

        def compute(texts: list[bytes]):
            rows = [row_digests(bpe, t.decode()) for t in texts]
            return [[r[k] for r in rows] for k in range(3)]

        return compute

    return per_text(docs, make, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], keep)
