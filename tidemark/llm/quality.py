"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every whole text is reduced to the statistics of ``STATISTICS``. Random Fourier features approximate a Gaussian kernel over
them; each partition of the labelled rows sums its part of the normal equations, and their sum gives the ridge weights.
Pool-adjacent-violators on rows kept out of the ridge fit turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATISTICS = ("log_words", "word_length", "long_words", "upper", "letters", "digits", "symbols", "bars", "stops", "distinct", "top_word", "repeats", "pairs", "line_words", "line_repeats")
#: Labelled rows that a fit takes at most, spread by a hash of the id; each of them is read whole.
MAX_TRAIN = 60_000
FEATURES, RIDGE, SEED = 256, 1e-2, 17
_KIND = np.zeros(256, "i8")  # of a UTF-8 byte: 0 other punctuation, 1 lower or beyond ASCII, 2 upper, 3 digit, 4 space, 5 line end, 6 bar, 7 sentence mark
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c == "|" else 7 if _c in ".,;:?'\"()-" else 0


def statistics(text: str | None) -> list[float]:
    """Of a whole text; of an empty one, zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), "u1")
    symbols, lower, upper, digits, _, _, bars, stops = np.bincount(_KIND[raw], minlength=8).tolist()
    marks = symbols + lower + upper + digits + bars + stops
    n = len(words)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    return [
        math.log1p(n), chars / n, math.log1p(max(map(len, count))), upper / max(1, lower + upper), (lower + upper) / marks, digits / marks, symbols / marks, bars / marks, stops / marks,
        math.log(len(count)) / math.log(n) if n > 1 else 1.0, max(count.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(pairwise(words))) / max(1, n - 1),
        math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return _fourier((np.clip((x - self.mean) / self.scale, -8, 8)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1) if len(self.knots) else np.full(len(x), 0.5)


def _fourier(z: np.ndarray) -> np.ndarray:
    """cos(z w + b) with w ~ N(0, 2 gamma), gamma = 1 / (2 d): a kernel of unit width a dimension; the last column is 1."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(z.shape[1], FEATURES)) / math.sqrt(z.shape[1])
    b = rng.uniform(0, 2 * math.pi, FEATURES)
    return np.concatenate([np.cos(z @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(z), 1))], 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (the mean score of each pool) and their values. Equal scores are one point."""
    at, where = np.unique(score, return_inverse=True)
    n = np.bincount(where)
    pools: list[list[float]] = []
    for x, w, y in zip(at.tolist(), n.tolist(), np.bincount(where, label).tolist(), strict=True):
        pools.append([x * w, w, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # one row of each class as prior: no pool says 0 or 1 outright, and scores in it can still be told apart
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


def _matrix(batch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten(), "f8").reshape(batch.num_rows, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model:
    """Learn P(quality = 1) from labelled rows whose crc32(doc_id) mod 5 isn't 0; remainder 1 calibrates, 2 to 4 fit.

    Labels that are null or name no document take no part; of several for one document the mean decides, 1 if it is 0.5 or more.
    Rows that share a doc_id each count with its label, rows of null doc_id have none. Texts are read whole, in slices of bounded bytes. Without a
    label every score is 0.5. Runs jobs while it is called: the model is a small object on the driver.
    """
    truth = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    part = common.remainder("doc_id", 5).cast("int")
    truth = common.written(truth.withColumn("part", part).filter("part <> 0"), "labels")
    n = truth.count()
    if n > max_train:
        truth = truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_train / n * (1 << 30)))

    def described(batches):
        for batch in batches:
            for part in common.parts(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64())), part.column(1), part.column(2)], ["x", "y", "part"])

    train = docs.select("doc_id", "text").join(common.small(truth, max_train * 2), "doc_id").select("text", "y", "part")
    train = common.written(train.mapInArrow(common.lean(described), "x array<double>, y double, part int"), "statistics")
    moments = train.select(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(len(STATISTICS)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    d = range(len(STATISTICS))
    mean = np.array([moments[f"m{i}"] or 0.0 for i in d])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in d])
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))

    def sums(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(_matrix(batch, 0))
            a += z.T @ z
            b += z.T @ (2 * np.asarray(batch.column(1), "f8") - 1)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    # max_train bounds the rows, and so 16 partitions of partial sums are enough
    parts = train.filter("part > 1").coalesce(16).mapInArrow(common.lean(sums), "a binary, b binary").collect()
    a = sum((np.frombuffer(p.a) for p in parts), np.zeros((FEATURES + 1) ** 2)).reshape(FEATURES + 1, -1)
    b = sum((np.frombuffer(p.b) for p in parts), np.zeros(FEATURES + 1))
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + ridge, b) if len(parts) else b
    held = train.filter("part = 1").select("x", "y").toPandas()  # a quarter of max_train rows at most
    if len(held):
        model.knots, model.values = isotonic(model.raw(np.array(held.x.tolist())), held.y.to_numpy())
    return model


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """The documents as they are, and column ``name`` of every whole text; null and empty texts, which have the statistics zero, are scored too.
    Rows of one text score alike, whatever their ids; an empty table stays empty. A column of this name that the table already has is replaced."""
    cols = [c for c in docs.columns if c != name]
    text = cols.index("text")

    def scored(batches):
        for batch in batches:
            for part in common.parts(batch, text):
                x = np.array([statistics(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], [*cols, name])

    from pyspark.sql.types import DoubleType, StructType

    thin = docs.select(*cols)
    return thin.mapInArrow(common.lean(scored), StructType([*thin.schema.fields]).add(name, DoubleType()))


THRESHOLD = 0.3


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(common.remainder("doc_id", 5) == 0, F.lit(False))  # a null doc_id has no label to hold out
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
