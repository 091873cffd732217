"""Alignment of the tokens of two tokenizers over the same bytes, and how often two tokens meet in the whole corpus.

The ends of both tokenizers' tokens are marked in packed bitsets over the bytes of a block of texts. Bits set in both are
shared cuts, which part a text into groups of tokens; popcounts with a running sum of them by word (rank) turn a cut into
the range of tokens before it. Between two neighbouring bits of either set lies one token of each kind: a link. So links
are expanded from the bits of the union, without comparing tokens with each other.

Counts of linked ids meet in blocks: a task sums the links of some BLOCK bytes of texts into one list of distinct pairs,
which is what is shuffled, joined with the corpus-wide counts, and handed back to the block's documents. A pair that
every document has is one row a block there, and a document's links are positions in its block's list.

Tokenizer A is byte-level BPE (`byte_bpe`, added tokens are plain text), B a sentencepiece model that puts a space before
the text itself; A reads the text with that space. Texts null or empty, and texts whose joined tokens aren't that space
and the text (B's normalisation changed them), have no tokens: zeros and no groups. A text that is longer than a block
is a block of its own and never cut. Repeated rows count as often as they come; rows with the same or a null id are told
apart. Only the id and the text are read, so other columns can't clash. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import byte_bpe
from flowlens.llm.common import small_batches, written

#: Bytes of texts whose links are summed together.
BLOCK = 2 << 20
_A, _B = 32, 0xFFFFFFFF


@functools.cache
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A sentencepiece model and its pieces' bytes by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(model.id_to_piece(k), model.is_byte(k)) for k in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in names]


@functools.cache
def tables(a_path: str, b_path: str) -> tuple[list[np.ndarray], list[str]]:
    """The tokens' sizes in bytes of A and of B by id, and the ids as they are written."""
    sizes = [np.array([len(t) for t in tokens]) for tokens in (byte_bpe.load(a_path).tokens, pieces(b_path)[1])]
    return sizes, names_of(*map(len, sizes))


class Marks:
    """A bitset over bytes, with the number of bits before each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Marks:
        bits = np.zeros(-(-(size + 1) // 64) * 64, dtype=bool)
        bits[places] = True
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def tokens_of(texts: list[str | None], a_path: str, b_path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids by A and by B of each text, none where B's bytes aren't the text's; A's always are."""
    encode = byte_bpe.encoded(a_path, special=False)
    model, b_bytes = pieces(b_path)
    none, out = np.zeros(0, dtype=np.uint32), []
    for text, b in zip(texts, model.encode([t or "" for t in texts], num_threads=1)):
        whole = b" " + (text or "").encode()
        same = text and b"".join(map(b_bytes.__getitem__, b)) == whole
        out.append((np.frombuffer(encode(" " + text), dtype=np.uint32), np.array(b, dtype=np.uint32)) if same else (none, none))
    return out


def aligned(tokens: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict:
    """Links and groups of a block's texts: ids end to end, tokens and bits of each text's end, cuts, links."""
    a, b = (np.concatenate([t[k] for t in tokens]).astype(np.int64) for k in (0, 1))
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    size = int(a_ends[-1]) if len(a_ends) else 0
    a_marks, b_marks = Marks.at(a_ends - 1, size), Marks.at(b_ends - 1, size)
    shared, either = Marks(a_marks.words & b_marks.words), Marks(a_marks.words | b_marks.words)
    cuts, links = shared.select(), either.select()
    a_last = np.cumsum([0, *(len(t[0]) for t in tokens)])
    b_last = np.cumsum([0, *(len(t[1]) for t in tokens)])
    ends = np.concatenate(([0], a_ends))[a_last]
    return {
        "a": a, "b": b, "a_last": a_last, "b_last": b_last,
        "a_cut": a_marks.rank(cuts) + 1, "b_cut": b_marks.rank(cuts) + 1, "n_groups": shared.rank(ends), "n_links": either.rank(ends),
        "links": a[a_marks.rank(links)] << _A | b[b_marks.rank(links)],
    }


def names_of(n_a: int, n_b: int) -> list[str]:
    """Ids as they are written in groups: A's within and at the end of a group's part, then B's."""
    return [f"{k}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for k in range(n)]


def group_texts(found: dict, n_a: int, n_b: int, names: list[str]) -> list[str]:
    """Of each text: `a1,a2|b1;a3|b2,b3`, the ids of its groups in order.

    Each token's place among the written ones is its own number and that of the other tokenizer's tokens before it.
    """
    a, b, a_cut, b_cut = found["a"], found["b"], found["a_cut"], found["b_cut"]
    a_sizes, b_sizes = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + np.repeat(b_cut - b_sizes, a_sizes)] = a
    codes[np.arange(len(b)) + np.repeat(a_cut, b_sizes)] = b + 2 * n_a
    codes[a_cut - 1 + b_cut - b_sizes] += n_a
    codes[b_cut - 1 + a_cut] += n_b
    ends = found["a_last"] + found["b_last"]
    return ["".join(map(names.__getitem__, codes[i:j].tolist()))[:-1] for i, j in zip(ends, ends[1:])]


ROWS = (
    "block string, n_a long, n_b long, n_groups long, n_links long, groups string, slots binary, times binary, "
    "pairs array<long>, counts array<long>"
)


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Two kinds of rows, told apart by pairs: for each row of docs its tokens, groups and links, for each block its pairs.

    Of a row of docs: block, the id, n_a, n_b, n_groups, n_links, groups, and its links as slots (positions in the
    block's pairs) and times (how often), both packed as unsigned 32-bit integers. Of a block: pairs (A's id << 32 | B's
    id, ascending) and their counts. Blocks get new names in each run, so write the result before it is used twice.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), *T.StructType.fromDDL(ROWS).fields])
    arrow = pa.schema([("block", pa.string()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
                       ("slots", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at, texts = 0, batch.column(1).to_pylist()
            for k, one in enumerate(texts):
                size += len(one or "") + 1
                if size >= BLOCK:
                    held.append(batch.slice(at, k + 1 - at))
                    yield from block(held)
                    held, size, at = [], 0, k + 1
            held.append(batch.slice(at))
        if held:
            yield from block(held)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([b.column(0) for b in held])
        if not len(ids):
            return
        sizes, names = tables(a_path, b_path)
        found = aligned(tokens_of([t for b in held for t in b.column(1).to_pylist()], a_path, b_path), *sizes)
        pairs, slot = np.unique(found["links"], return_inverse=True)
        bounds = found["n_links"]
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        own, times = np.unique(owner * max(1, len(pairs)) + slot, return_counts=True)
        first = np.searchsorted(own, np.arange(len(ids) + 1) * max(1, len(pairs)))
        slots, times = (own % max(1, len(pairs))).astype("<u4"), times.astype("<u4")
        name, n = uuid.uuid4().hex, len(ids)
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(first, first[1:])], pa.binary()) for x in (slots, times)]
        whole = [np.diff(found[k]) for k in ("a_last", "b_last", "n_groups", "n_links")]
        columns = [pa.array([name] * n), *map(pa.array, whole), pa.array(group_texts(found, *map(len, sizes), names)), *packed, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
        full = pa.schema([pa.field(id, ids.type), *arrow])
        table = pa.Table.from_arrays([ids, *columns], schema=full)
        yield from table.to_batches(max_chunksize=1000)
        summed = [name, *[None] * 7, pairs, np.bincount(slot, minlength=len(pairs))]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *(pa.array([v], f.type) for v, f in zip(summed, arrow))], schema=full)

    return docs.select(id, F.col(text).cast("string").alias("text")).mapInArrow(rows, schema)


def weigh(rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """Each document of align's rows with n_best and count_sum, by the counts of pairs in the whole corpus.

    rows may have any columns beside those of align but slots, times, pairs and counts, which go.
    count_sum sums over a document's links how many links hold the same pair of ids; n_best counts links whose pair is
    its B id's most frequent one, ties included.
    """
    rows = written(rows, "aligned")
    listed = rows.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    listed = listed.select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("count"))
    totals = written(listed.groupBy("pair").agg(F.sum("count").alias("total")), "pair-totals")
    piece = F.col("pair").bitwiseAND(_B).alias("piece")
    most = totals.groupBy(piece).agg(F.max("total").alias("most"))
    # at most a row for each id of B's vocabulary
    told = totals.withColumn("piece", piece).join(F.broadcast(most), "piece").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = listed.select(F.col("block").alias("in_block"), "pair").join(told, "pair")
    docs = rows.where("pairs is null").drop("pairs", "counts")
    kept = [f for f in docs.schema.fields if f.name not in ("slots", "times")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("pair").to_numpy())
        total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy()[order]
        n_best, sums = [], []
        for slots, times in zip(docs.column("slots").to_pylist(), docs.column("times").to_pylist()):
            slot, n = np.frombuffer(slots, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(n[best[slot]].sum()))
            sums.append(int((total[slot] * n).sum()))
        return docs.drop_columns(["slots", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return docs.groupBy("block").cogroup(back.groupBy("in_block")).applyInArrow(weighed, schema)
