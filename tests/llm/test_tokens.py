"""Operators 1 and 7 against the public libraries."""
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routelens.llm.op1_byte_bpe import Codec, digests, encode_decode, read_ranks
from routelens.llm.op7_token_counts import Vocabulary, token_counts
from routelens.llm.pretokens import Cutter

from .conftest import ODD

RANKS = P.path("byte_bpe_50k.tiktoken")
CUTTER = Cutter(P.PATTERN)


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'stmdrevl aB1 \n\t .!é漢 \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_pretokens_are_the_patterns(texts):
    import regex
    tokens, at = CUTTER.cut(texts)
    find = regex.compile(P.PATTERN).findall
    assert [tokens[i:j] for i, j in zip(at, at[1:], strict=False)] == [find(t) for t in texts]


def test_other_patterns_go_through_regex():
    tokens, at = Cutter(r"\w+").cut(["a b", "", "cd"])
    assert tokens == ["a", "b", "cd"] and at.tolist() == [0, 2, 2, 3]


def test_merges_as_the_library(codec, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeinorst") for _ in range(n)) for n in (1, 2, 3, 7, 16, 17, 64, 255, 256, 257, 900, 4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(3000)), "a" * 3000, "ab" * 900]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text)
        assert codec.decode(ids, step=7) == text.encode()


def test_digests(make, library):
    got = sorted(map(tuple, digests(make(ODD), RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, text in ODD:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(make):
    assert digests(make([]), RANKS, P.PATTERN).count() == 0
    assert encode_decode(make([]), RANKS, P.PATTERN).columns == ["doc_id", "ids", "decoded"]
    assert token_counts(make([]), P.path("byte_bpe_50k.json")).count() == 0


def test_whole_tokens_are_proven():
    v = Vocabulary(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for token in rng.sample(sorted(v.whole), 300):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if len(t.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert len(t.encode(text, add_special_tokens=False).ids) == 1


def test_counts(make):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_counts(make(ODD), P.path("byte_bpe_50k.json"), limit=5).collect()), key=str)
    want = []
    for i, text in ODD:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 5))
    assert got == sorted(want, key=str)


def test_long_pre_tokens_are_not_remembered():
    import public_tokenizers

    from routelens.llm.op1_byte_bpe import LONGEST, Codec, read_ranks
    from routelens.llm.op7_token_counts import Counter, Vocabulary
    codec = Codec(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    counter = Counter(Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [f"short words {chr(97 + i % 26) * (2000 + i)} and ends" for i in range(60)]
    twice = [codec.encode(texts), codec.encode(texts)]
    assert twice[0] == twice[1] and [codec.decode(x).decode() for x in twice[0]] == texts
    assert counter.count(texts) == counter.count(texts) == [len(x) // 4 for x in twice[0]]
    assert max(map(len, codec.known)) <= LONGEST and all(len(t) <= LONGEST for t in counter.known if t not in counter.whole)
