"""The transducer against the tokenizers library, which encodes a text as a whole."""

import random
import struct
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlens.llm import byte_bpe
from tests.llm import helpers

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
PARTS = ["a", "b", "the", " ", "  ", "\n", "ing", "er", "é", "ü", "-", "=", "1", "23", "'s", "'re", "'r", "<|endoftext|>", "<|end", "😀", "\t", "tion", "ion"]


def ids(text, special=True):
    return list(memoryview(byte_bpe.encoded(FILE, special)(text)).cast("I"))


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=60).map("".join)))
@settings(max_examples=300, deadline=None)
def test_ids_and_text(text):
    assert ids(text) == expected(text)
    assert byte_bpe.decoded(FILE)(byte_bpe.encoded(FILE)(text)) == text


@given(st.lists(st.integers(0, 50256), max_size=100))
@settings(max_examples=200, deadline=None)
def test_any_ids_are_decoded(some):
    """Tokens may end within characters, and any of them may follow any other."""
    packed = array("I", some).tobytes()
    assert byte_bpe.decoded(FILE)(packed) == LIBRARY.decode(some, skip_special_tokens=False)


@given(st.lists(st.integers(0, 50256), max_size=40), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_decoder_in_pieces(some, step):
    machine = byte_bpe.TextDecoder(byte_bpe.load(FILE))
    text = "".join(machine.push(some[k : k + step]) for k in range(0, len(some), step)) + machine.finish()
    assert text == LIBRARY.decode(some, skip_special_tokens=False)


@pytest.mark.parametrize("parts", [["a"], ["a", "b"], ["the", "er", "r", "e"], ["=", "-"], [" "], ["in", "g", "gi"], ["1", "0"], ["é"], ["\n", " "]])
def test_endless_words(parts):
    """Words far longer than a window: the transducer's ids are those of the whole word, and it holds little of it."""
    draw = random.Random(len(parts))
    text = "".join(draw.choice(parts) for _ in range(90_000))
    assert ids(text) == expected(text)
    vocabulary = byte_bpe.load(FILE)
    machine = byte_bpe.Transducer(vocabulary)
    for start in range(0, 60_000, 1000):
        list(machine.push(text[start : start + 1000].encode()))
        assert len(machine.held) <= 2 * vocabulary.lookahead + 8 * 128


def test_windows_cut_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 40)
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(PARTS) for _ in range(150))
        assert ids(text) == expected(text)


def test_lookahead_of_small_lists():
    """By hand: without rules a byte is a token; ab needs one byte more; in ab, bc, cd each rule waits for the next."""
    chain = [(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert byte_bpe.sufficient_lookahead([]) == 1
    assert byte_bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    assert byte_bpe.sufficient_lookahead(chain) == 3
    assert byte_bpe.sufficient_lookahead(chain[::-1]) == 1


def test_lookahead_suffices_for_drawn_lists():
    """For random lists of rules over three letters: what follows the lookahead never moves a token's end before it."""
    draw = random.Random(3)
    for _ in range(60):
        made, rules = [b"a", b"b", b"c"], []
        for _ in range(draw.randint(1, 12)):
            pair = draw.choice(made), draw.choice(made)
            if pair[0] + pair[1] not in made:
                rules.append(pair)
                made.append(pair[0] + pair[1])
        number = {word: k for k, word in enumerate(made)}
        ranks = {number[a] << 32 | number[b]: k for k, (a, b) in enumerate(rules)}
        single = [number.get(bytes([b]), 0) for b in range(256)]
        far = byte_bpe.sufficient_lookahead(rules)
        vocabulary = byte_bpe.Vocabulary(made, single, ranks, [number[a + b] for a, b in rules], {}, far)

        def ends(text):
            at, out = 0, set()
            for token in byte_bpe.merged(vocabulary, text):
                at += len(made[token])
                out.add(at)
            return out

        for _ in range(30):
            common = bytes(draw.choice(b"abc") for _ in range(40))
            one, other = (common + bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 12))) for _ in range(2))
            assert {e for e in ends(one) if e < 40 - far} == {e for e in ends(other) if e < 40 - far}
            machine = byte_bpe.Transducer(vocabulary)
            assert [*machine.push(one), *machine.finish()] == byte_bpe.merged(vocabulary, one)


def test_long_merges_are_the_short_ones(monkeypatch):
    vocabulary = byte_bpe.load(FILE)
    draw = random.Random(5)
    for _ in range(200):
        word = "".join(draw.choice(PARTS) for _ in range(12)).encode()
        found = byte_bpe._merged_long(vocabulary, [vocabulary.single[b] for b in word])
        monkeypatch.setattr(byte_bpe, "SHORT", 1000)
        assert found == byte_bpe.merged(vocabulary, word)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    read = byte_bpe.decode(byte_bpe.encode(docs, FILE), FILE)
    rows = read.select("text", "ids", "n_tokens", "decoded").collect()
    assert len(rows) == docs.count()
    for row in rows:
        want = expected(row.text or "")
        assert (bytes(row.ids), row.n_tokens, row.decoded) == (struct.pack(f"<{len(want)}I", *want), len(want), row.text or "")
    assert byte_bpe.decode(byte_bpe.encode(helpers.empty(spark), FILE), FILE).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.load(public_tokenizers.path("word_bpe_49k.json"))
