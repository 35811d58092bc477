import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablemill.llm import bpe, token_count
from tests.llm.conftest import NASTY

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encode():
    return bpe.encoder(RANKS, bpe.tiktoken_pattern(public_tokenizers.PATTERN))


def naive_merge(piece, get):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranks = [(get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1) if get(parts[i] + parts[i + 1]) is not None]
        if not ranks:
            return parts
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.binary(max_size=40) | st.text("abt he", max_size=60).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_merge_is_leftmost_lowest(piece):
    get = bpe.load_ranks(RANKS).get
    assert bpe.merge(piece, get) == naive_merge(piece, get)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoding_as_the_library(encode, library, text):
    assert list(array("I", encode(text))) == library.encode_ordinary(text)


def test_every_character_class(encode, library):
    for first in range(0, 0x110000, 997):
        text = "".join(chr(c) for c in range(first, first + 40) if not 0xD800 <= c < 0xE000 and c < 0x110000)
        assert list(array("I", encode(f"a{text}1"))) == library.encode_ordinary(f"a{text}1")


def test_long_piece(encode, library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcé漢") for _ in range(30_000))
    assert list(array("I", encode(text))) == library.encode_ordinary(text)


def test_memo_keeps_within_two_generations():
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k, most=3)
    for k in [1, 2, 3, 4, 1, 5, 6, 1]:
        assert memo[k] == k
    assert made == [1, 2, 3, 4, 5, 6]
    assert len(memo) + len(memo.old) <= 6


def test_query_round_trip(spark, small, library):
    from tablemill.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = array("I", library.encode_ordinary(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nasty_rows(spark, nasty):
    out = bpe.bpe_decode(bpe.bpe_encode(nasty, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = out.select("doc_id", "text", "decoded", "n_tokens", "kept").collect()
    assert len(rows) == len(NASTY)
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.kept == 1 and (r.n_tokens == 0) == (not r.text) for r in rows)
    assert bpe.bpe_encode(nasty.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " the", "'ll", "  \n", "é", "\U000323af", "１２", "<|endof"]), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_counts_as_the_library(tokenizer, text):
    pattern = token_count.tokenizers_pattern()
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert token_count.counter(JSON, pattern)(text) == len(want)
    assert [list(array("I", x)) for x in token_count.library_encoder(JSON, pattern)([text, text])] == [want, want]


@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\u00a0", "\u3000", "\x1c", "\u180e", "the", "Word,", "\u00e9t\u00e9", "don't", "12", "a1", "\u6f22\u5b57", "...", "x?", "<|endoftext|>", "\u01c5", "\u0250b"]), max_size=12).map("".join))
@settings(max_examples=600, deadline=None)
def test_words_between_spaces_as_the_library(tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert list(array("I", token_count.library_encoder(JSON, token_count.tokenizers_pattern())([text])[0])) == want


def test_proven_strings_are_single_tokens(tokenizer):
    proven = token_count.vocabulary(JSON).proven()
    some = random.Random(1).sample(sorted(proven), 2000)
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(some, add_special_tokens=False) if len(tokenizer.pre_tokenizer.pre_tokenize_str("".join(map(str, e.tokens)))) <= 1) and len(proven) > 40_000


def test_token_count_query(spark, small, tokenizer):
    from tablemill.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op9_token_counts"](spark, small).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_token_counts_nasty(nasty):
    rows = token_count.token_counts(nasty, JSON, 512).collect()
    assert len(rows) == len(NASTY) and all((r.n_tokens == 0) == (not r.text) for r in rows)
    assert token_count.token_counts(nasty.limit(0), JSON, 512).count() == 0


def test_library_encoder_reads_no_more_than_special_strings(monkeypatch):
    """Ids come from the library's own model, so its worker builds no ranks of ours."""
    monkeypatch.setattr(token_count, "vocabulary", lambda path: pytest.fail("the whole vocabulary was built"))
    encode = token_count.LibraryEncoder(JSON, token_count.tokenizers_pattern())
    library = Tokenizer.from_file(JSON)
    texts = ["", "plain words, and onlyouth ofthhareble; \u00e9t\u00e9 na\u00efve", "a  b\n c <s> </s>x", *(t or "" for _, t, _ in NASTY)]
    assert [list(array("I", ids)) for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_library_encoder_asks_the_model_once_for_each_pre_token(tokenizer):
    encode = token_count.LibraryEncoder(JSON, token_count.tokenizers_pattern())
    asked, model = [], encode.tokenize
    encode.tokenize = lambda piece: asked.append(piece) or model(piece)
    texts = [f"in onlyouth{a} ofthhareble{b}" for a in ("", ",", "###", "&&&", "!?", "'s") for b in ("", ".", "###", "$$$")]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(array("I", ids)) for ids in encode(texts) + encode(texts)] == want + want
    assert len(asked) == len(set(asked)) > 8


@given(st.lists(st.lists(st.sampled_from([" ", " ", "\n", "\t", "\x1c", " ", "the", "Z9", "0", "é", "×", "漢", "'s", "'", ",", "###", "~", "\x7f", "<|endoftext|>", "<|endof"]), max_size=8).map("".join), max_size=8))
@settings(max_examples=600, deadline=None)
def test_batches_of_texts_as_the_library(tokenizer, texts):
    """Texts are cut all at once: none may reach into the next, be it empty or split as it is."""
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(array("I", ids)) for ids in token_count.library_encoder(JSON, token_count.tokenizers_pattern())(texts)] == want
