"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

A merge list decides its tokens left of a place once enough of what follows is known. How much is enough depends on the
list alone (`sufficient_lookahead`): what comes later moves a boundary leftward only through a chain of rules, each of
lower priority than the one before and overlapping it, and the longest such chain is found rule by rule. So the encoder
holds a block of bytes and the lookahead behind it, emits the tokens that are stable, and goes on at their end: its
memory doesn't grow with the text, nor with a word of a million letters. The decoder holds at most three bytes of an
unfinished character.

Texts: null counts as empty, and an empty text has no tokens. Nothing is cut off or dropped, repeated rows and ties are
encoded one by one, an empty table gives an empty one, and columns of the input whose names the operator uses are
replaced.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import small_batches

#: Fixed value: how byte-level BPE splits a text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that a match of WORDS looks at beyond its first one, for its contractions.
AHEAD = 3
#: Code points of a text that are split into words at a time.
WINDOW = 1 << 16
#: Words longer than this are encoded anew each time; of the others a worker keeps the tokens of so many at most.
SHORT, KEPT = 48, 700_000
#: The rank of a pair without a rule.
NONE = 1 << 62


@dataclass(frozen=True)
class Vocabulary:
    """Tokens' bytes by id, ids of single bytes, ranks of rules by left << 32 | right, ids made by rank, added tokens."""

    tokens: list[bytes]
    single: list[int]
    rules: dict[int, int]
    made: list[int]
    added: dict[str, int]
    lookahead: int


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it is printable Latin-1, else the next from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a place that settle whether it is a token's end, whatever comes after them.

    Take two texts that agree up to a place, and the leftmost boundary on which their segmentations differ while rules
    are applied by priority. A rule u, v moves it left to its own middle only if its span ends at that boundary or
    holds it, and the boundary is the middle of a rule x, y of higher priority: so the text before it ends in x, and in
    the part of u v before it. reach has, by rule, how far such a chain can come; a rule's best predecessor is looked
    up by the endings of the two. The result bounds all chains, and so is sufficient if not always the least.
    """
    ends_in: dict[bytes, int] = {}
    equals: dict[bytes, int] = {}
    most = 1
    for left, right in merges:
        whole, middle = left + right, len(left)
        reach = len(right)
        for cut in range(middle + 1, len(whole) + 1):
            before = whole[:cut]
            found = max([ends_in.get(before, 0), *(equals.get(before[k:], 0) for k in range(cut))])
            if found:
                reach = max(reach, found + cut - middle)
        for k in range(middle):
            ends_in[left[k:]] = max(reach, ends_in.get(left[k:], 0))
        equals[left] = max(reach, equals.get(left, 0))
        most = max(most, reach)
    return most


@functools.cache
def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file of byte-level BPE; ValueError for files that say more than is done here."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model, split = read["model"], read["pre_tokenizer"]
    plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    if not plain or read["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError(f"{path} isn't plain byte-level BPE")
    if any(t[k] for t in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that match other than as they are")
    letters = byte_letters()
    ids = {bytes(letters[c] for c in word): k for word, k in model["vocab"].items()}
    added = {t["content"]: t["id"] for t in read["added_tokens"]}
    tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
    for word, k in [*ids.items(), *((c.encode(), k) for c, k in added.items())]:
        tokens[k] = word
    pairs = [tuple(bytes(letters[c] for c in part) for part in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    whole = {bytes([b]) for b in range(256)}
    for left, right in pairs:
        if left not in whole or right not in whole:
            raise ValueError(f"{path} has a rule before the rules that make its parts")
        whole.add(left + right)
    rules = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
    single, made = [ids[bytes([b])] for b in range(256)], [ids[a + b] for a, b in pairs]
    return Vocabulary(tokens, single, rules, made, added, sufficient_lookahead(pairs))


def merged(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """The tokens of data by the rules of highest priority first, and of one rule's places the leftmost first."""
    ids = [vocabulary.single[b] for b in data]
    if len(ids) > SHORT:
        return _merged_long(vocabulary, ids)
    get, made = vocabulary.rules.get, vocabulary.made
    ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
    while ranks:
        rank = min(ranks)
        if rank == NONE:
            break
        at = ranks.index(rank)
        ids[at : at + 2] = [made[rank]]
        del ranks[at]
        if at:
            ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], NONE)
        if at < len(ranks):
            ranks[at] = get(ids[at] << 32 | ids[at + 1], NONE)
    return ids


def _merged_long(vocabulary: Vocabulary, ids: list[int]) -> list[int]:
    """As merged, in n log n: a heap of (rank, place), and links to the places that are still tokens' starts."""
    after, before, n = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)], len(ids)
    heap: list[tuple[int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n:
            rank = vocabulary.rules.get(ids[at] << 32 | ids[after[at]])
            if rank is not None:
                heapq.heappush(heap, (rank, at))

    for at in range(n - 1):
        offer(at)
    while heap:
        rank, at = heapq.heappop(heap)
        if ids[at] < 0 or after[at] >= n or vocabulary.rules.get(ids[at] << 32 | ids[after[at]]) != rank:
            continue
        gone = after[at]
        ids[at], ids[gone], after[at] = vocabulary.made[rank], -1, after[gone]
        if after[at] < n:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [k for k in ids if k >= 0]


class Transducer:
    """Bytes in, ids out as soon as they are stable: push(), then finish() at the end of the word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.block = 4 * vocabulary.lookahead
        self.held = b""

    def push(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.block):
            self.held += data[start : start + self.block]
            if len(self.held) > 2 * self.vocabulary.lookahead:
                end, stable = 0, len(self.held) - self.vocabulary.lookahead
                for token in merged(self.vocabulary, self.held):
                    if end + len(self.vocabulary.tokens[token]) >= stable:
                        break
                    end += len(self.vocabulary.tokens[token])
                    yield token
                self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        yield from merged(self.vocabulary, self.held)
        self.held = b""


class TextDecoder:
    """Ids in, text out as soon as its characters are whole; what is no UTF-8 becomes U+FFFD, one for each maximal part."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Encoder(dict):
    """Packs texts' ids; as a dict it has the packed ids of short words met so far, KEPT at most."""

    def __init__(self, vocabulary: Vocabulary, special: bool):
        super().__init__()
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        found = sorted(vocabulary.added, key=len, reverse=True) if special else []
        self.added = regex.compile("|".join(map(regex.escape, found))) if found else None

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > SHORT:
            transducer = Transducer(self.vocabulary)
            return array("I", chain(transducer.push(data), transducer.finish())).tobytes()
        packed = array("I", merged(self.vocabulary, data)).tobytes()
        if len(self) < KEPT:
            self[word] = packed
        return packed

    def parts(self, text: str) -> Iterator[bytes]:
        """The packed ids of text, part by part."""
        at = 0
        for hit in self.added.finditer(text) if self.added else ():
            yield from self.plain(text, at, hit.start())
            yield array("I", [self.vocabulary.added[hit.group()]]).tobytes()
            at = hit.end()
        yield from self.plain(text, at, len(text))

    def plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Of text[at:end], window by window; words that a window's end may have cut are read again."""
        while end - at > WINDOW:
            stop, words = at + WINDOW, []
            for word in self.words.findall(text, at, stop):
                if at + len(word) >= stop or at + AHEAD > stop:
                    break
                words.append(word)
                at += len(word)
            yield b"".join(map(self.__getitem__, words))
            if not words:
                at = yield from self.endless(text, at, end)
        yield b"".join(map(self.__getitem__, self.words.findall(text, at, end)))

    def endless(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Of the word at a place that is longer than a window, which isn't copied whole; returns its end."""
        stop = self.words.match(text, at, end).end()
        transducer = Transducer(self.vocabulary)
        for start in range(at, stop, WINDOW):
            yield array("I", transducer.push(text[start : min(stop, start + WINDOW)].encode())).tobytes()
        yield array("I", transducer.finish()).tobytes()
        return stop


@functools.cache
def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker, so that words are encoded once."""
    return Encoder(load(path), special)


def encoded(path: str, special: bool = True) -> Callable[[str | None], bytes]:
    """A function from a text to its ids, packed as little-endian unsigned 32-bit integers."""
    packer = encoder(path, special)
    return lambda text: b"".join(packer.parts(text or ""))


def decoded(path: str) -> Callable[[bytes | None], str]:
    """A function from packed ids to their text, in pieces of bounded size."""
    vocabulary = load(path)

    def text(packed: bytes | None) -> str:
        machine, view = TextDecoder(vocabulary), memoryview(packed or b"").cast("I")
        return "".join([*(machine.push(view[k : k + WINDOW]) for k in range(0, len(view), WINDOW)), machine.finish()])

    return text


def encode(docs: DataFrame, path: str, text: str = "text", special: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and n_tokens.

    path: a vocabulary file that every machine has. special: the added tokens' strings inside texts are those tokens,
    else plain text.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(encoded(path, special))

    return docs.withColumn("ids", ids(F.coalesce(F.col(text).cast("string"), F.lit("")))).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded with decoded, the text of its packed ids, added tokens included."""
    small_batches(coded.sparkSession)

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        return packed.map(decoded(path))

    return coded.withColumn("decoded", text(F.col(ids)))
