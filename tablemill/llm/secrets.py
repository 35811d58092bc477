"""Secret scans: an Aho-Corasick pass finds keywords, expressions anchored at the hits decide, checksums are verified.

No expression searches a text: each is tried only where the automaton saw its keyword. Runs of hexadecimal digits have
no keyword of their own, so a second automaton looks for the shortest such run in the text mapped to character classes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemill.llm.common import map_rows

#: Kinds that count as base, in the order in which they are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """``prefix_`` + 30 characters + 6 base-62 digits that hold the CRC-32 of the 30."""
    body = token.partition("_")[2]
    want = 0
    for c in body[-6:]:
        want = want * 62 + _BASE62.index(c)
    return zlib.crc32(body[:-6].encode()) == want


def is_jwt(token: str) -> bool:
    """The first part must decode to a JSON object that names an algorithm."""
    head = token.partition(".")[0]
    try:
        said = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(said, dict) and "alg" in said


#: kind -> (keywords in lower case, expression tried at a hit, whether a match holds)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
        lambda m: m.end(2) - m.start(2) >= MIN_VALUE,
    ),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= MIN_ACCESS),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: checksum_holds(m[0])),
    "npm": (("npm_",), re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: checksum_holds(m[0])),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"), lambda m: is_jwt(m[0])),
    "pem": (("-----begin ",), re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), lambda m: True),
}
_HEX = re.compile("[0-9a-f]+")
#: What a match of these kinds begins with: one that fails, fails from every place of the same stretch, so the others aren't tried.
_STRETCH = {"jwt": re.compile("eyJ[A-Za-z0-9_-]*")}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_HEX = bytes(ord("0") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))


def scanner() -> Callable[[str], list[tuple[int, int, int]]]:
    """Text to spans (start, place of the kind in KINDS, end), in that order; code points, end exclusive."""
    words = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for w in keywords:
            words.add_word(w, (KINDS.index(kind), len(w), *RULES[kind][1:]))
    words.make_automaton()
    stretches = [_STRETCH.get(kind) for kind in KINDS]
    runs = ahocorasick.Automaton()
    runs.add_word("0" * MIN_HEX, None)
    runs.make_automaton()

    def scan(text: str) -> list[tuple[int, int, int]]:
        flat = text.encode("latin-1", "replace")  # one byte for each character, so that places stay
        spans, past = [], [0] * len(KINDS)
        # every keyword of a kind is where its match begins, so hits sorted by start give leftmost matches
        hits = sorted((last + 1 - size, kind, tried, holds) for last, (kind, size, tried, holds) in words.iter(flat.translate(_LOWER).decode("latin-1")))
        for start, kind, tried, holds in hits:
            if start < past[kind]:
                continue
            if m := tried.match(text, start):
                past[kind] = m.end()
                if holds(m):
                    spans.append((start, kind, m.end()))
            elif stretches[kind] and (m := stretches[kind].match(text, start)):
                past[kind] = m.end()
        kind = KINDS.index("hex")
        for last, _ in runs.iter(flat.translate(_IS_HEX).decode("latin-1")):
            start = last + 1 - MIN_HEX
            if start >= past[kind]:
                past[kind] = _HEX.match(text, start).end()
                spans.append((start, kind, past[kind]))
        return sorted(spans)

    return scan


def secret_spans(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end), to every row.

    Within a kind, matches are leftmost and do not overlap; spans of different kinds may. A match that fails its check
    is dropped but still covers its characters. A null or empty text has no spans. An input column called ``secrets``
    is replaced. No shuffle.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scan = scanner()
        return lambda text: ([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(text)] if text else [],)

    return map_rows(df, make, text_col, [("secrets", "array<struct<kind:string,start:int,end:int>>", spans)], keep)
