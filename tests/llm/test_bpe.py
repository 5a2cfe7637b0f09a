import random

import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm.bpe import ByteBpe, load_ranks, read_vocabulary
from lectern.llm.token_counts import CountTree


@pytest.fixture(scope="module")
def pair():
    ranks = load_ranks(read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    return ByteBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["the", " The", "ción", "ß", "'", "'re", "'s", " ", "  ", "\n", "\t", "\r\n", "12", "٣", "é", "漢字", "🙂", "́", "\x85", "\x1c", "​", "\xa0", "...", "_", "<|endoftext|>", "r", "e", "ll"]


def some_text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(n))


def test_matches_tiktoken(pair):
    own, other = pair
    rnd = random.Random(5)
    texts = ["", "a" * 5000, "ab" * 3000, "=" * 999, "\n" * 77, *(some_text(rnd, rnd.randrange(60)) for _ in range(1500))]
    assert list(own.encode_many(texts)) == [" ".join(map(str, other.encode_ordinary(t))) for t in texts]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode() == own.decode_joined(own.encode_joined(text))


def test_every_code_point_splits_alike(pair):
    own, other = pair
    for block in range(0, 0x30000, 0x400):
        text = "".join(f"x{chr(c)}y1{chr(c)} {chr(c)}{chr(c)}." for c in range(block, block + 0x400) if not 0xD800 <= c < 0xE000)
        if own.encode(text) != other.encode_ordinary(text):
            bad = [hex(c) for c in range(block, block + 0x400) if not 0xD800 <= c < 0xE000 and own.encode(f"x{chr(c)}y1{chr(c)} {chr(c)}.") != other.encode_ordinary(f"x{chr(c)}y1{chr(c)} {chr(c)}.")]
            assert not bad, bad


def test_edits_equal_a_full_recount(pair):
    own, _ = pair
    rnd = random.Random(11)
    for _ in range(300):
        text = some_text(rnd, rnd.choice([0, 3, 40, 400]))
        tree = CountTree(text, own)
        for _ in range(rnd.randrange(1, 6)):
            a = rnd.randrange(-2, len(text) + 3)
            b = a + rnd.randrange(0, 30)
            new = some_text(rnd, rnd.randrange(0, 8))
            tree.replace(a, b, new)
            start = max(0, min(a, len(text)))
            text = text[:start] + new + text[max(start, min(b, len(text))) :]
            assert tree.text() == text
            assert [p for leaf in tree.leaves for p, _ in leaf] == own.split(text)
            assert tree.n_tokens == len(own.encode(text))
            assert tree.n_chars == len(text)


def test_an_edit_reencodes_little(pair):
    own, _ = pair
    tree = CountTree("some words of text, " * 5000, own)
    first = tree.encoded
    tree.replace(40_000, 40_005, "else")
    assert tree.encoded - first < 60
