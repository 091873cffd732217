"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

A document becomes some thirty numbers (shares of kinds of characters, lengths, repetition, compressibility); random
cosines of their standardised values approximate a Gaussian kernel. Each partition of the labelled sample sums its
part of the normal equations, Spark adds the parts, and the driver solves one system whose size is the number of
features. Isotonic steps turn a score into a chance; a ridge looks too good on the rows it was fitted on, so the steps
come from scores, counted in narrow bins, that each half of the sample gets from the ridge of the other half.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import held_out, small_batches, written
from flowlens.llm.labelled import labelled_sample

#: Labelled documents of each class that are learned from (in expectation), random features, kernel width, ridge.
PER_CLASS, FEATURES, GAMMA, RIDGE, SEED = 8000, 300, 0.02, 1e-3, 11
BINS = 400
THRESHOLD = 0.5

_SPACE, _UPPER, _LOWER, _DIGIT, _SENTENCE, _COMMA, _OTHER, _WIDE, _CONTROL = range(9)


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[65:91], kind[97:123], kind[48:58] = _UPPER, _LOWER, _DIGIT
    kind[[ord(c) for c in ".?!"]] = _SENTENCE
    kind[[ord(c) for c in ",;:'\"-()"]] = _COMMA
    kind[128:] = _WIDE
    kind[[k for k in range(32) if k not in (9, 10, 11, 12, 13)] + [127]] = _CONTROL
    return kind


_KIND = _kinds().astype(np.uint8)
_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"last": b".,;:!?", "digit": b"0123456789"}.items()}
_IS["sign"] = np.isin(_KIND, [_SENTENCE, _COMMA, _OTHER, _CONTROL])
_IS["wide"] = _KIND == _WIDE
N_STATISTICS = 30


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text, all of bounded range or logarithms; all zeros where there is no word."""
    import zlib

    out = np.zeros(N_STATISTICS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    data = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    n, n_words = len(raw), len(words)
    space = _KIND[data] == _SPACE
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    has = lambda name: np.logical_or.reduceat(_IS[name][data], starts)  # noqa: E731  of each word
    out[:9] = np.sqrt(np.bincount(_KIND, weights=counts, minlength=9) / n)
    top = counts[33:127].copy()
    top[32:58] = top[64:90] = 0  # punctuation and digits only
    out[9] = np.sqrt(top.max() / n)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[10] = counts[65:91].sum() / max(1, letters)
    sizes = ends - starts + 1
    out[11], out[12], out[13] = np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max())
    out[14] = (sizes <= 2).mean()
    freq = Counter(words)
    common = freq.most_common(3)
    out[15] = np.log(len(freq)) / np.log(n_words) if n_words > 1 else 1.0
    out[16] = common[0][1] / n_words
    out[17] = sum(k for _, k in common) / n_words
    out[18] = sum(map(bytes.__eq__, words, words[1:])) / n_words
    out[19] = sum(map(bytes.__le__, words, words[1:])) / n_words
    pairs = Counter(zip(words, words[1:]))
    out[20] = sum(k for k in pairs.values() if k > 1) / n_words
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(lines)
    out[21] = 1 - len(seen) / len(lines)
    out[22] = np.log1p(n / len(lines))
    out[23] = np.log1p(len(lines)) / 5
    out[24] = np.log1p(n_words) / 5
    out[25] = _IS["last"][data[ends]].mean()
    out[26] = (has("sign") & ~has("wide")).mean()
    out[27] = (_KIND[data[starts]] == _UPPER).mean()
    # compressed in pieces, so that a text of any length needs bounded memory and all of it counts alike
    out[28] = sum(len(zlib.compress(raw[k : k + 65536], 1)) for k in range(0, n, 65536)) / n
    out[29] = has("digit").mean()
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    knots: np.ndarray
    chances: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        standard = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(standard @ self.directions + self.phases)
        return np.hstack([cosines, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        # rounded, as the last bits of a sum depend on how many rows are multiplied at once
        return np.round(self.features(stats) @ self.coefficients, 9)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.chances), 0.0, 1.0)


def isotonic(at: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and chances: the non-decreasing step means of hits / weight over the places at, ends of each step."""
    blocks: list[list[float]] = []
    for x, h, w in zip(at, hits, weight):
        blocks.append([x, x, h, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, end, h, w = blocks.pop()
            blocks[-1][1:] = [end, blocks[-1][2] + h, blocks[-1][3] + w]
    knots = [k for a, b, _, _ in blocks for k in ((a, b) if b > a else (a,))]
    chances = [h / w for a, b, h, w in blocks for _ in range(2 if b > a else 1)]
    return np.array(knots), np.array(chances)


_READY: dict[str, Model] = {}
_ARRAY = T.ArrayType(T.DoubleType())


@F.pandas_udf(_ARRAY)
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(t) for t in batch], dtype=object)


def _normal_parts(model: Model):
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for half, rows in batch.groupby("half"):
                z = model.features(np.stack(rows["stats"].to_list()))
                w = rows["weight"].to_numpy()[:, None]
                total[half] += (z * w).T @ np.hstack([z, rows["y"].to_numpy(dtype=float)[:, None]])
        for half in (0, 1):
            yield pd.DataFrame({"half": half, "i": np.arange(FEATURES + 1), "part": list(total[half])})

    return parts


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    return parts[["half", "i"]].iloc[:1].assign(part=[np.sum(np.stack(parts["part"].to_list()), axis=0)])


def _ridge(sums: np.ndarray) -> np.ndarray:
    """The coefficients that solve the normal equations; without rows, none count."""
    weight = sums[-1, -2]
    return np.linalg.solve(sums[:, :-1] + RIDGE * weight * np.eye(FEATURES + 1), sums[:, -1]) if weight else np.zeros(FEATURES + 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fits on a bounded sample of labelled rows that aren't held out.

    Without labelled rows every text scores 0.5; with rows of one class, that class's label.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    sample = written(sample.select(half, _statistics(F.col("text")).alias("stats"), "y", "weight"), "quality-sample")
    one = F.posexplode("stats").alias("i", "x")
    moments = sample.select(one).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("i").collect()  # a row for each statistic
    if not moments:
        moments = [{"mean": 0.0, "sd": 1.0}] * N_STATISTICS
    random = np.random.default_rng(SEED)
    model = Model(
        np.array([r["mean"] for r in moments]),
        np.array([max(r["sd"], 1e-3) for r in moments]),
        random.normal(0, np.sqrt(2 * GAMMA), (N_STATISTICS, FEATURES)),
        random.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.array([0.0]),
        np.array([0.5]),
    )
    # the sample is bounded, so a few partitions hold it and few parts are added
    parts = sample.coalesce(16).mapInPandas(_normal_parts(model), "half int, i int, part array<double>")
    rows = parts.groupBy("half", "i").applyInPandas(_added, "half int, i int, part array<double>").orderBy("half", "i").collect()
    if not rows:
        return model
    halves = np.array([r["part"] for r in rows]).reshape(2, FEATURES + 1, FEATURES + 2)
    if not halves[:, -1, -2].any():
        return model
    model.coefficients = _ridge(halves.sum(axis=0))
    # a half that has no rows leaves the other to be scored by the ridge of all
    others = [_ridge(halves[1 - k]) if halves[:, -1, -2].all() else model.coefficients for k in (0, 1)]
    return _calibrated(model, [(sample.where(F.col("half") == k), replace(model, coefficients=others[k])) for k in (0, 1)])


def _calibrated(model: Model, scored: list[tuple[DataFrame, Model]]) -> Model:
    """The model with isotonic steps from samples, each scored by a model not fitted on it, in bins; a score far out
    falls into the outermost bin."""
    binned = reduce(DataFrame.unionByName, (rows.select(_raw(other)(F.col("stats")).alias("raw"), "y", "weight") for rows, other in scored))
    place = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    bins = binned.groupBy(place).agg(F.sum(F.col("y") * F.col("weight")).alias("hits"), F.sum("weight").alias("n")).orderBy("bin").collect()  # at most BINS rows
    at = np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins])
    model.knots, model.chances = isotonic(at, np.array([r["hits"] for r in bins]), np.array([r["n"] for r in bins]))
    return model


def _model_udf(model: Model, kind: T.DataType, apply):
    small_batches(SparkSession.active())
    key, sent = uuid.uuid4().hex, SparkSession.active().sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = sent.value
        for batch in batches:
            yield pd.Series(apply(_READY[key], batch), dtype="float64")

    return F.pandas_udf(run, kind)


def _raw(model: Model):
    return _model_udf(model, T.DoubleType(), lambda m, stats: m.raw(np.stack(stats.to_list())) if len(stats) else [])


def quality(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    return _model_udf(model, T.DoubleType(), lambda m, texts: m.score(np.stack([statistics(t) for t in texts])) if len(texts) else [])(text)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Defined cases: null and empty texts share one score, that of a text without words; a null id isn't held out;
    repeated rows score alike; an empty table gives no rows; other columns of docs are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), quality(model, F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
