"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

The tree's leaf ``i`` holds the rank of the pair that starts at position ``i``, packed with ``i`` so that the minimum
at the root is the lowest rank and, among equals, the leftmost. A merge changes three leaves (the pair itself, its left
neighbour and its absorbed right half), each in logarithmic time, so a piece of n bytes costs O(n log n) whatever it holds.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablemill.llm.common import map_rows

_NONE = 1 << 62


def merge(piece: bytes, get: Callable[[bytes], int | None], left: dict[bytes, int] | None = None) -> list[bytes]:
    """Split ``piece`` into tokens by always merging the leftmost pair of lowest rank.

    ``get`` gives the rank of a pair by the bytes that it makes, or None. ``left`` says, for vocabularies that list
    their pairs, how long the left half must be. An empty piece gives no token; a single byte gives itself.
    """
    n = len(piece)
    if n < 2:
        return [piece] if n else []
    m = n - 1
    tree = [_NONE] * (2 * m)
    for i in range(m):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[m + i] = r * n + i
    for k in range(m - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    # the token that begins at i ends at stop[i]; before it is the one that begins at before[i]
    stop, before = list(range(1, n + 1)), list(range(-1, m))
    while (low := tree[1]) != _NONE:
        i = low % n
        j = stop[i]
        k = stop[i] = stop[j]
        changed = []
        if j < m:
            changed.append((j, _NONE))
        r = None
        if k < n:
            before[k] = i
            r = get(piece[i : stop[k]])
            if r is not None and left is not None and left[piece[i : stop[k]]] != k - i:
                r = None
        changed.append((i, _NONE if r is None else r * n + i))
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            if r is not None and left is not None and left[piece[h:k]] != i - h:
                r = None
            changed.append((h, _NONE if r is None else r * n + h))
        for leaf, value in changed:
            p = m + leaf
            if tree[p] == value:
                continue
            tree[p] = value
            while p > 1:
                other = tree[p ^ 1]
                p >>= 1
                if other < value:
                    value = other
                if tree[p] == value:
                    break
                tree[p] = value
    out, i = [], 0
    while i < n:
        out.append(piece[i : stop[i]])
        i = stop[i]
    return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Splitter(NamedTuple):
    """A pattern that finds pre-tokens as another library does.

    Libraries follow different Unicode versions. ``exact`` has letter and number classes with the other library's
    members; ``plain`` is the pattern as it was, which is faster and right for texts without ``disputed`` characters.
    ``letters`` and ``numbers`` are the classes' members below U+0250: most texts need no others, and are split by a
    pattern that spells them out.
    """

    plain: str
    exact: str
    disputed: str
    letters: str
    numbers: str

    def finder(self) -> Callable[[str], list[str]]:
        exact, plain = regex.compile(self.exact, regex.V1).findall, regex.compile(self.plain).findall
        disputed = re.compile(f"[{self.disputed}]").search if self.disputed else lambda text: None
        space = r"\t-\r\x20\x85\xa0"

        def spelt(letters: str, numbers: str, space: str) -> str:
            said = self.plain.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
            return said.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")

        narrow, latin = spelt("A-Za-z", "0-9", r"\t-\r\x20"), spelt(self.letters, self.numbers, space)
        # a pattern with classes that aren't known here has no such forms
        odd = re.search(r"\\p|\\w|\\d|\\b|\(\?[^!:=<]", narrow)
        ascii_, small = (plain, plain) if odd else (re.compile(narrow).findall, re.compile(latin).findall)
        large = re.compile("[^\x00-\u024f]").search

        def find(text: str) -> list[str]:
            if text.isascii():
                return ascii_(text)
            if not large(text):
                return small(text)
            return exact(text) if disputed(text) else plain(text)

        return find


def adapt(pattern: str, members: Callable[[str, str], set[str]]) -> Splitter:
    """``pattern`` with classes as of a library whose ``members(cls, text)`` are the characters of ``text`` that it puts in ``cls``."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    exact, disputed, low = pattern, set(), []
    for cls in (r"\p{L}", r"\p{N}"):
        here, there = set(regex.findall(cls, every)), members(cls, every)
        low.append(_ranges([c for c in range(0x80) if regex.match(cls, chr(c))] + sorted(ord(c) for c in there if ord(c) < 0x250)))
        if here != there:
            more, less = _ranges(sorted(map(ord, there - here))), _ranges(sorted(map(ord, here - there)))
            own = f"[{cls}{more}]" if more else cls
            exact = exact.replace(cls, f"[{own}--[{less}]]" if less else own)
            disputed |= here ^ there
    return Splitter(pattern, exact, _ranges(sorted(map(ord, disputed))), *low)


@lru_cache(maxsize=4)
def tiktoken_pattern(pattern: str) -> Splitter:
    """The pattern as the tiktoken library reads it."""
    import tiktoken

    def members(cls: str, text: str) -> set[str]:
        raw = tiktoken.Encoding("probe", pat_str=cls, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return set(bytes(raw.encode_ordinary(text)).decode())

    return adapt(pattern, members)


class Memo(dict):
    """Values of a function of one key, in two generations of bounded size: what is used stays, the rest goes."""

    def __init__(self, make: Callable, most: int = 1 << 18):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.put(key, value)
        else:
            self[key] = value
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


@lru_cache(maxsize=2)
def encoder(path: str, splitter: Splitter) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers; kept for the life of the Python worker."""
    ranks = load_ranks(path)
    find = splitter.finder()

    get = ranks.get

    def encode_piece(piece: str) -> bytes:
        raw = piece.encode()
        whole = get(raw)
        ids = [whole] if whole is not None else [ranks[t] for t in merge(raw, get)]
        return array("I", ids).tobytes()

    memo = Memo(encode_piece)
    return lambda text: b"".join(map(memo.__getitem__, find(text)))


def _decoder(path: str) -> Callable[[bytes | None], bytes]:
    by_id = {i: t for t, i in load_ranks(path).items()}
    return lambda ids: b"".join(map(by_id.__getitem__, array("I", ids or b"")))


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` for every text.

    Each match of ``pattern`` is encoded by itself; characters outside every match give no token. A null or empty text
    gives no ids. Input columns called like an output column are replaced; repeated rows and null ids stay as they are.
    No row leaves its task: there is no shuffle, and a lost task is simply run again. With ``decoded_col`` the ids are
    decoded at once, as by ``bpe_decode`` but in the same Python worker, where a task would else need two.
    """
    own = tiktoken_pattern(pattern)
    out = [(out_col, "binary", pa.binary()), ("n_tokens", "bigint", pa.int64())] + ([(decoded_col, "binary", pa.binary())] if decoded_col else [])

    def make():
        encode = encoder(path, own)
        decode = _decoder(path) if decoded_col else None

        def one(text):
            ids = encode(text or "")
            return (ids, len(ids) // 4, decode(ids)) if decode else (ids, len(ids) // 4)

        return one

    return map_rows(df, make, text_col, out, keep)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary, as ids may cut a character). Null ids give empty bytes; an id outside the vocabulary raises."""

    def make():
        decode = _decoder(path)
        return lambda ids: (decode(ids),)

    return map_rows(df, make, ids_col, [(out_col, "binary", pa.binary())])
