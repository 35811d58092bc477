"""Token counts with a whole-token shortcut, for byte-level BPE tokenizer files in JSON.

Offline, every vocabulary string is merged by itself; those that come out as one token are proven: a pre-token equal to
one of them is one token. Counting then adds one for each such pre-token and merges only the others.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablemill.llm.bpe import Memo, Splitter, adapt, merge
from tablemill.llm.common import map_rows

#: Fixed value: how byte-level tokenizers split text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: By byte: ASCII letters and digits, and the other visible ASCII characters.
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
_MARKS = np.array([0x20 < b < 0x7F for b in range(256)]) & ~_ALNUM
_id = attrgetter("id")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in such files: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _said(path: str) -> dict:
    """A tokenizer file of the kind that is supported."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre = said["model"], said["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or said["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"{path}: only plain byte-level BPE is supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
        raise ValueError(f"{path}: added tokens that look at their neighbours are not supported")
    return said


def _special(said: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in said["added_tokens"]}


class Vocabulary:
    """What a tokenizer file of this kind says: ids and merge ranks in bytes, and special strings."""

    def __init__(self, path: str):
        said = _said(path)
        model = said["model"]
        to_byte = _byte_alphabet()
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {raw(a + b): k for k, (a, b) in enumerate(pairs)}
        self.left = {raw(a + b): len(raw(a)) for a, b in pairs}
        if len(self.ranks) != len(pairs):
            raise ValueError(f"{path}: a token is made by more than one pair")
        self.special = _special(said)

    def split(self, piece: bytes) -> list[bytes]:
        return merge(piece, self.ranks.get, self.left)

    def proven(self) -> set[str]:
        """Vocabulary strings that encode, alone, as one token. Those that aren't whole characters can't be pre-tokens."""
        out = set()
        for token in self.ids:
            if self.split(token) == [token]:
                try:
                    out.add(token.decode())
                except UnicodeDecodeError:
                    continue
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def tokenizers_pattern(pattern: str = BYTE_LEVEL) -> Splitter:
    """The pattern as the tokenizers library reads it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def members(cls: str, text: str) -> set[str]:
        return {c for piece, _ in Split(Regex(f"{cls}+"), "removed", invert=True).pre_tokenize_str(text) for c in piece}

    return adapt(pattern, members)


def special_splitter(special: dict[str, int]) -> Callable[[str], list[str]] | None:
    """Cuts a text at special strings, which stand at the odd places of what it returns; the longest wins where several start."""
    if not special:
        return None
    return regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split


@lru_cache(maxsize=2)
def counter(path: str, splitter: Splitter) -> Callable[[str], int]:
    """Text to number of tokens; kept for the life of the Python worker."""
    vocab = vocabulary(path)
    one = dict.fromkeys(vocab.proven(), 1)
    find = splitter.finder()
    rest = Memo(lambda piece: len(vocab.split(piece.encode())))
    shortcut = one.get
    special, cut = vocab.special, special_splitter(vocab.special)

    def plain(text: str) -> int:
        n = 0
        for piece in find(text):
            n += shortcut(piece) or rest[piece]
        return n

    def count(text: str) -> int:
        if cut is None or not any(s in text for s in special):
            return plain(text)
        pieces = cut(text)
        return len(pieces) // 2 + sum(map(plain, pieces[::2]))

    return count


class LibraryEncoder:
    """Texts to ids as the tokenizers library gives them, whose model is asked for each new pre-token.

    Pre-tokens are encoded independently of each other, so the ids of a text are those of its pre-tokens in order. A
    space between two characters that aren't white space always begins a pre-token, and so does an ASCII mark after an
    ASCII letter or digit. Texts are cut there, all of a batch at once, and each different chunk of the batch is looked
    up once. Texts with other white space beside a space, which may end a pre-token elsewhere, are split as they are.
    """

    def __init__(self, path: str, splitter: Splitter, most: int = 1 << 19):
        from tokenizers import Tokenizer

        # the model belongs to the tokenizer
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.special = _special(_said(path))
        self.cut = special_splitter(self.special)
        self.find = splitter.finder()
        self.letters = "".join(sorted(_byte_alphabet(), key=_byte_alphabet().get))
        self.pieces, self.chunks = Memo(self._piece, most >> 3), Memo(self._chunk, most)
        self.usual = re.compile(f" ?[{splitter.letters}]+").fullmatch

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        return array("I", map(_id, self.tokenize(charmap_decode(piece.encode(), "strict", self.letters)[0]))).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of what stands between two cuts, or None if white space makes one of them doubtful."""
        if self.usual(chunk):
            return self._piece(chunk)
        if chunk[-1].isspace() or chunk[0] == " " and chunk[1].isspace():
            return None
        pieces = self.find(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def _plain(self, texts: list[str]) -> list[bytes]:
        own = [text.encode() for text in texts]
        raw, limits = np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)])
        if not len(raw):
            return own
        begins = raw == ord(" ")
        marks = np.flatnonzero(_MARKS[raw])
        begins[marks[_ALNUM[raw[marks - 1]]]] = True
        begins[limits[:-1][np.diff(limits) > 0]] = True
        at = np.flatnonzero(begins)
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        known = pa.array(map(self.chunks.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())
        spread = pa.DictionaryArray.from_arrays(chunks.indices, known).dictionary_decode()
        _, ends, ids = spread.buffers()
        ids, bounds = memoryview(ids or b""), np.frombuffer(ends, dtype=np.int64)[np.searchsorted(at, limits)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in set((np.searchsorted(limits, at[spread.is_null().to_numpy(zero_copy_only=False)], side="right") - 1).tolist()):
            out[k] = b"".join(map(self.pieces.__getitem__, self.find(texts[k])))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        # plain texts at even places, special strings at odd ones
        cut = [self.cut(text) if self.cut and any(s in text for s in self.special) else [text] for text in texts]
        plain = iter(self._plain([x for parts in cut for x in parts[::2]]))
        return [b"".join([array("I", [self.special[x]]).tobytes() if k % 2 else next(plain) for k, x in enumerate(parts)]) for parts in cut]


@lru_cache(maxsize=2)
def library_encoder(path: str, splitter: Splitter) -> LibraryEncoder:
    """Kept for the life of the Python worker."""
    return LibraryEncoder(path, splitter)


def token_counts(df: DataFrame, path: str, limit: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to every row.

    A null text counts as empty: 0, 0, false. Special strings inside a text are one token each, as in the library.
    Input columns called like these are replaced. No shuffle; each task holds one vocabulary and a bounded memo.
    """
    pattern = tokenizers_pattern()

    def make():
        count = counter(path, pattern)

        def one(text):
            n = count(text) if text else 0
            return len(text.encode()) if text else 0, n, n > limit

        return one

    return map_rows(df, make, text_col, [("n_bytes", "bigint", pa.int64()), ("n_tokens", "bigint", pa.int64()), ("over_limit", "boolean", pa.bool_())], keep)
