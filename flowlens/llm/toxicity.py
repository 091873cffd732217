"""Toxicity by a weighted lexicon.

Text is folded first (case, look-alike letters of other scripts, digits and signs that stand for letters), then one
Aho-Corasick automaton finds the lexicon's words and word beginnings together with phrases that excuse them. The
weights found, and the weights per thousand words, go into a logistic function fitted on the same labelled rows that
the lexicon's weights come from: a term's weight is the logarithm of how much likelier it is in toxic documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import held_out, small_batches, written
from flowlens.llm.labelled import labelled_sample

#: Labelled documents of each class that are learned from, in expectation.
PER_CLASS = 4000
#: Lengths of word beginnings that may be terms; a term must be this much likelier in toxic documents.
STEMS, MIN_LOG_ODDS = (4, 5, 6, 7), math.log(30)
THRESHOLD = 0.7

# Plain insults that count even where no label has shown them, phrases that excuse a term, look-alikes.
SEED_TERMS = "idiot idiots moron morons imbecile stupid dumb loser losers scum trash worthless pathetic disgusting vermin scumbag bastard bitch asshole jerk dumbass retard whore slut clown".split()
SEED_WEIGHT = 3.0
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "class clown", "clown fish", "circus clown", "sore loser", "loser bracket", "pond scum", "soap scum", "dumb bell", "dumb waiter"]
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_LOOK_ALIKE = str.maketrans(LOOK_ALIKE)
_STANDS = str.maketrans(STANDS_FOR)
#: Signs in front of a letter, in a word that has a letter before them as well or starts with them.
_SIGNS = re.compile(r"(?<![0-9@$])[0134578@$](?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]{1,3}(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The words of the folded text."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_LOOK_ALIKE)
    return _TOKEN.findall(_SIGNS.sub(lambda m: m[0].translate(_STANDS), text))


def terms(tokens: list[str]) -> set[str]:
    """What may become lexicon terms: ` word ` for a word, ` stem` for the beginning of a longer one."""
    found = set()
    for w in set(tokens):
        if len(w) >= 3:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in STEMS if len(w) > k)
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            (toxic if y else clean).update(terms(fold(text)))
    keys = list(toxic.keys() | clean.keys())
    yield pd.DataFrame({"term": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """term -> weight, from (doc_id, text, y): terms that are far likelier in toxic documents, beyond chance.

    Near copies would lend their words false support, so of documents that share the least hash of their word pairs
    the one with the smallest id counts. All terms that qualify are kept: each is in three toxic documents or more of
    the sample, which bounds what is collected.
    """
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    single = written(sample.withColumn("words", F.split(F.lower("text"), r"\s+")).groupBy(F.array_min(pairs).alias("sketch"), "y").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "y"), "toxic-sample")
    sizes = {r["y"]: r["count"] for r in single.groupBy("y").count().collect()}  # two rows
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = {f" {w} ": SEED_WEIGHT for w in SEED_TERMS}
    if not n_toxic or not n_clean:
        return lexicon
    counts = single.mapInPandas(_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a term of chance is toxic as often as a document; so many toxic documents in a row happen to one term in 2000
    prior = n_toxic / (n_toxic + n_clean)
    least = max(3, math.ceil(math.log(2000) / -math.log(prior)))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    kept = counts.where(F.col("toxic") >= least).withColumn("weight", weight).where(F.col("weight") >= MIN_LOG_ODDS)
    return lexicon | {r["term"]: float(r["weight"]) for r in kept.select("term", "weight").orderBy("term").collect()}


class Matcher:
    """The lexicon and the exceptions in one automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.exceptions = {f" {' '.join(fold(e))} " for e in exceptions}
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0))
        self.automaton.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """The weight found, the places it was found in, and all words.

        A place counts with its heaviest term. Repeats of a word count half as much as one more word, all together,
        so that one line over and over doesn't outweigh different terms.
        """
        tokens = fold(text)
        line = f" {' '.join(tokens)} "
        best: dict[int, float] = {}
        excused = []
        for end, (size, weight) in self.automaton.iter(line):
            start = end - size + 1
            if weight:
                best[start] = max(best.get(start, 0.0), weight)
            else:
                excused.append((start, end))
        excused.sort(reverse=True)
        heaviest: dict[str, list[float]] = {}
        n_hits = reach = 0
        for start in sorted(best):
            while excused and excused[-1][0] <= start:
                reach = max(reach, excused.pop()[1])
            if start >= reach:
                n_hits += 1
                heaviest.setdefault(line[start + 1 : line.index(" ", start + 1)], []).append(best[start])
        return sum(max(w) * (1.5 if len(w) > 1 else 1.0) for w in heaviest.values()), n_hits, len(tokens)


def _features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(1000 * total / n_words) if n_words else 0.0


@dataclass
class Model:
    lexicon: dict[str, float]
    coefficients: tuple[float, float] = (1.0, 1.0)
    intercept: float = -4.0


_READY: dict[str, Matcher] = {}
_FOUND = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])


def toxicity(model: Model, text: Column) -> Column:
    """struct(total, n_hits, n_words, score) of a text column."""
    small_batches(SparkSession.active())
    key, sent = uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast(model)

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Matcher(sent.value.lexicon)
        (a, b), c = sent.value.coefficients, sent.value.intercept
        for batch in texts:
            rows = []
            for t in batch:
                total, hits, n = _READY[key].weigh(t)
                x, y = _features(total, n)
                rows.append((total, hits, n, 1 / (1 + math.exp(-max(-50.0, min(50.0, a * x + b * y + c))))))
            yield pd.DataFrame(rows, columns=["total", "n_hits", "n_words", "score"])

    return F.pandas_udf(score, _FOUND)(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """The lexicon and the logistic function, from a bounded sample of labelled rows that aren't held out.

    Without rows of both classes, the seed lexicon and fixed coefficients are the model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sample = written(labelled_sample(docs, labels, label_col, per_class, id_col, text_col), "toxic-labelled")
    model = Model(learn_lexicon(sample))
    if sample.select("y").distinct().count() < 2:
        return model
    # a lexicon looks too good on the rows it was learned from, so each half is weighed with that of the other
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    parts = [sample.where(half == k).select("y", "weight", toxicity(Model(learn_lexicon(sample.where(half != k))), F.col("text")).alias("f")) for k in (0, 1)]
    found = parts[0].unionByName(parts[1])
    x = F.log1p("f.total"), F.when(F.col("f.n_words") > 0, F.log1p(1000 * F.col("f.total") / F.col("f.n_words"))).otherwise(F.lit(0.0))
    rows = found.select(F.col("y").cast("double").alias("label"), "weight", array_to_vector(F.array(*x)).alias("features"))
    rows = written(rows, "toxic-features")
    fit = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(rows)
    return Model(model.lexicon, tuple(map(float, fit.coefficients.toArray())), float(fit.intercept))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, total, n_hits, n_words.

    Defined cases: null and empty texts have the score of a text without terms; a null id isn't held out; a term in
    an excused phrase doesn't count; a text of any length takes time in proportion to it, near enough; repeated rows
    score alike; an empty table gives no rows; other columns of docs are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), toxicity(model, F.col(text_col)).alias("t"))
    return found.select("doc_id", "held_out", "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.total", "t.n_hits", "t.n_words")
