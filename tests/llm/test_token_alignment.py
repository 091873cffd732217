"""Alignment against a plain version: both libraries' tokens, and all pairs within each group."""

import bisect
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from flowlens.llm import token_alignment
from tests.llm import helpers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RESULT = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def spans(ids, table):
    at, out = 0, []
    for k in ids:
        out.append((at, at + len(table[k]), k))
        at += len(table[k])
    return out


def plain(texts):
    """Of each text its RESULT."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = {k: bytes(letters[c] for c in word) for word, k in library.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.get_piece_size())]
    found, counts = [], Counter()
    for text in texts:
        a, b, whole = library.encode(f" {text}", add_special_tokens=False).ids, model.encode(text or ""), f" {text}".encode()
        if not text or b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            found.append(([], [], [], []))
            continue
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        groups, begun, ends = [], [0, 0], [[t[1] for t in side] for side in (a, b)]
        for cut in sorted({*ends[0]} & {*ends[1]}):
            last = [bisect.bisect_right(e, cut) for e in ends]
            groups.append([side[i:j] for side, i, j in zip((a, b), begun, last)])
            begun = last
        links = [(x[2], y[2]) for p, q in groups for x in p for y in q if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, piece), n in counts.items():
        most[piece] = max(most[piece], n)
    return [
        (
            len(a), len(b), len(groups), len(links), ";".join("|".join(",".join(str(t[2]) for t in side) for side in g) for g in groups),
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
        )
        for a, b, groups, links in found
    ]


def result(df):
    return sorted([tuple(r[c] for c in ["doc_id", *RESULT]) for r in df.collect()], key=str)


TEXTS = [
    "The cat, the hat & naïve 東京 émigrés.", "  two  spaces ", "<|endoftext|> and <0x41> and ▁", "tab\tand\nline\r\n", "ﬁ ligature", "x", " ", "\n\n", "😀😀 👩‍👩‍👧",
    "a" * 300, "The cat, the hat & naïve 東京 émigrés.", None, "", " hard　space", "é combined", "1234567890 3.14",
]


def test_against_plain_version(spark, monkeypatch):
    for block in (6 << 20, 30):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
        found = result(token_alignment.weigh(token_alignment.align(docs, A, B)))
        assert found == sorted([(k, *r) for k, r in enumerate(plain(TEXTS))], key=str)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    found = result(token_alignment.weigh(token_alignment.align(docs, A, B)))
    assert found == sorted([(r.doc_id, *want) for r, want in zip(rows, plain([r.text for r in rows]))], key=str)
    assert token_alignment.weigh(token_alignment.align(helpers.empty(spark), A, B)).count() == 0
