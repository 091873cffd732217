"""Language identification by prediction by partial matching.

For each language, a variable-order byte context tree with escape probabilities (method C: a context seen n times with
d distinct successors escapes with probability d / (n + d)) gives the exact code length of a text; the shortest wins.
The statistics are counted by Spark over a bounded sample of labelled rows, and frozen: a context's costs are then
fixed numbers, so the trees of some languages at a time are flattened into tables by gram (context and byte), and a text
is scored for them at once with array look-ups, longest contexts first. Tables of so many languages each keep what is
sent to the executors in proportion to the number of languages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import held_out, small_batches, written

#: Bytes of context, and rows and bytes of each language (at most, in expectation) that the trees are counted from.
ORDER, SAMPLE_ROWS, SAMPLE_BYTES = 3, 600, 4 << 20
#: Languages that share tables.
TOGETHER = 8
#: Bytes scored at a time.
CHUNK = 1 << 18
UNKNOWN = "und"


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The (order + 1)-byte gram that ends at each byte, as a number; the first bytes have a context of zeros."""
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gram counts by language and order of what this task has read."""
    held: dict[tuple[str, int], pd.Series] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            for order in range(ORDER + 1):
                seen = pd.Series(*np.unique(grams(data, order), return_counts=True)[::-1])
                old = held.get((lang, order))
                held[lang, order] = seen if old is None else old.add(seen, fill_value=0)
    for (lang, order), seen in held.items():
        yield pd.DataFrame({"lang": lang, "ord": order, "gram": seen.index.to_numpy().astype(np.int64), "n": seen.to_numpy().astype(np.int64)})


def count_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, ord, gram, n) over about `rows` labelled rows of each language that aren't held out, fewer if they are long.

    The share of a language's rows that is read is set by a count of them and of their bytes, so the sample is bounded
    at any size; which rows they are follows from a hash of the id.
    """
    small_batches(docs.sparkSession)
    train = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # written, so that the join below knows its size: texts are shuffled only where there are very many languages
    sizes = train.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length(text_col)).alias("bytes"))
    sizes = written(sizes, "languages")
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).join(sizes, "lang")
    chosen = chosen.where((F.col("place") * F.col("count") < rows) & (F.col("place") * F.col("bytes") < SAMPLE_BYTES)).select("lang", "text")
    return chosen.mapInPandas(_counts, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Costs in bits. keys[o] are the known grams of order o, sorted; costs[o] has a row of them for each gram and a
    column for each language. contexts[o] are the known contexts of o bytes; escapes[o] the cost of leaving each."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)
    slots: list[tuple[int, np.ndarray]] = field(default_factory=list)

    @classmethod
    def build(cls, counts: pd.DataFrame, langs: list[str]) -> Trees:
        """The tables from (lang, ord, gram, n); they have at most as many rows as counts."""
        made = cls(langs)
        column = {lang: k for k, lang in enumerate(langs)}
        for order in range(ORDER + 1):
            part = counts[counts["ord"] == order]
            gram, n, lang = part["gram"].to_numpy().astype(np.uint64), part["n"].to_numpy().astype(float), part["lang"].map(column).to_numpy().astype(np.int64)
            keys, row = np.unique(gram, return_inverse=True)
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            seen = np.zeros((len(keys), len(langs)))
            seen[row, lang] = n
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, owner, seen)
            np.add.at(kinds, owner, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                # a context that a language hasn't seen passes on to the next shorter one at no cost
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(seen / (total + kinds)[owner])
            shorter = made._lookup(order - 1, keys & np.uint64((1 << (8 * order)) - 1)) if order else np.full((len(keys), len(langs)), 8.0)
            made.keys.append(keys)
            made.contexts.append(contexts)
            made.escapes.append(escape.astype(np.float32))
            made.costs.append(np.where(seen > 0, direct, escape[owner] + shorter).astype(np.float32))
            made.slots.append(made._index(keys))
        return made

    @staticmethod
    def _index(keys: np.ndarray) -> tuple[int, np.ndarray]:
        """A hash table of one slot a key: the row of the key whose hash it is, or -1; clashes go by binary search."""
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys))))) + 4)
        slots = np.full(1 << bits, -1, dtype=np.int32)
        slots[Trees._hash(keys, bits)] = np.arange(len(keys), dtype=np.int32)
        return bits, slots

    @staticmethod
    def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _find(self, order: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, known) of each gram."""
        keys = self.keys[order]
        if not len(keys):
            return np.zeros(len(gram), dtype=np.int64), np.zeros(len(gram), dtype=bool)
        bits, slots = self.slots[order]
        row = slots[self._hash(gram, bits)]
        known = (row >= 0) & (keys[row] == gram)
        other = np.flatnonzero(~known & (row >= 0))
        if len(other):
            at = np.minimum(np.searchsorted(keys, gram[other]), len(keys) - 1)
            row[other], known[other] = at, keys[at] == gram[other]
        return row, known

    def _lookup(self, order: int, gram: np.ndarray) -> np.ndarray:
        """Costs of grams of an order, a row each: a gram that no language knows escapes to the next shorter one."""
        out = np.empty((len(gram), len(self.langs)))
        row, known = self._find(order, gram)
        out[known] = self.costs[order][row[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            context, left = self.contexts[order], gram[rest] >> np.uint64(8)
            shorter = self._lookup(order - 1, gram[rest] & np.uint64((1 << (8 * order)) - 1)) if order else np.full((len(rest), len(self.langs)), 8.0)
            if len(context):
                at = np.minimum(np.searchsorted(context, left), len(context) - 1)
                shorter = shorter + np.where((context[at] == left)[:, None], self.escapes[order][at], 0.0)
            out[rest] = shorter
        return out

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits that each language's tree needs for the text."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        total = np.zeros(len(self.langs))
        for start in range(0, len(data), CHUNK):
            before = min(ORDER, start)
            gram = grams(data[start - before : start + CHUNK], ORDER)[before:]
            row, known = self._find(ORDER, gram)
            if len(gram) < len(self.keys[ORDER]):
                total += self.costs[ORDER][row[known]].sum(axis=0, dtype=float)
            else:
                total += np.bincount(row[known], minlength=len(self.keys[ORDER])) @ self.costs[ORDER]
            if not known.all():
                total += self._lookup(ORDER, gram[~known]).sum(axis=0, dtype=float)
        return total


@dataclass
class Forest:
    """The trees of all languages, TOGETHER to a table."""

    trees: list[Trees]

    @property
    def langs(self) -> list[str]:
        return [lang for t in self.trees for lang in t.langs]

    def code_lengths(self, text: str) -> np.ndarray:
        return np.concatenate([t.code_lengths(text) for t in self.trees])

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability beside the others, all likely alike beforehand; ties go to the first."""
        if not self.trees or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum())


_READY: dict[str, Forest] = {}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Forest:
    """Counts on the executors; a table's languages at a time reach the driver, bounded by the sample at any size of docs."""
    counts = written(count_grams(docs, id_col, text_col, lang_col, rows), "language-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row for each language
    parts = [langs[k : k + TOGETHER] for k in range(0, len(langs), TOGETHER)]
    return Forest([Trees.build(counts.where(F.col("lang").isin(part)).toPandas(), part) for part in parts])


def language(trees: Forest, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    small_batches(SparkSession.active())
    key, sent = uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast(trees)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = sent.value
        for batch in texts:
            yield pd.DataFrame([_READY[key].predict(t) for t in batch], columns=["lang_pred", "score"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.pandas_udf(predict, kind)(text)


def identify(docs: DataFrame, trees: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Defined cases: null text, and text without a letter, is `und` with score 0, and so is all text where nothing could
    be learned; a null id isn't held out; equal code lengths go to the first language by code point; an empty table
    gives no rows; other columns of docs are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), language(trees, F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
