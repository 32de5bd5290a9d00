"""Quality by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance, the latter shrunk towards the pooled one and towards a multiple of the
identity; a score is the logistic of the difference of the two Mahalanobis log-densities and log-priors. Moments of
all labelled rows are summed where they lie; the driver gets a few hundred numbers. The inverse Cholesky factors are
made once and sent along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches
from .toxicity import held_out

_CODE = np.arange(256)
_SPACE = np.isin(_CODE, [9, 10, 11, 12, 13, 32])
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LETTER = _UPPER | ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_STOP = np.isin(_CODE, list(b".,;:!?'\"()-"))
_CLASSES = np.stack([_SPACE, _UPPER, _LETTER, _DIGIT, _STOP, ~(_SPACE | _LETTER | _DIGIT | _STOP), _CODE == 10]).astype(float)
SIZE = 13


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of shares; all finite."""
    words, n = text.split(), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.sqrt(_CLASSES @ counts / n)
    p = counts[counts > 0] / n
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    m = max(1, len(words))
    return [
        math.log1p(len(text)),
        math.log1p(sum(map(len, words)) / m),
        math.sqrt(len(set(words)) / m),
        float(-(p * np.log2(p)).sum()) if len(text) else 0.0,
        math.sqrt(1 - len(lines) / max(1, sum(lines.values()))) if lines else 0.0,
        math.sqrt(sum(1 for w in words if not w[0] & 0x80 and not chr(w[-1]).isalnum()) / m),
        *shares.tolist(),
    ]


def with_statistics(df: DataFrame, text: str, *carry: str) -> DataFrame:
    """``*carry, x``: the statistics of each whole text; a null text counts as empty."""
    small_batches(df.sparkSession)
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(text).alias("t"))
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics((t or "").encode("utf-8", "replace")) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[:-1], "x"])

    return rows.mapInArrow(run, kinds + "x array<double>").toDF(*carry, "x")


class Discriminant:
    """Class log-densities by cached inverse Cholesky factors."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, classes: list[tuple[float, np.ndarray, np.ndarray]]):
        self.centre, self.scale = centre, scale
        self.classes = []
        for prior, mean, cov in classes:
            inverse = np.linalg.inv(np.linalg.cholesky(cov))
            self.classes.append((prior, mean, inverse, float(np.log(np.diag(inverse)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class for each row."""
        z = (x - self.centre) / self.scale
        logs = [math.log(prior) + half - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for prior, mean, inverse, half in self.classes]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50)))


def shrunk(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_identity: float) -> Discriminant | float:
    """From (n, sum, sum of products) of classes 0 and 1; the share of class 1 where one is missing (0.5: both)."""
    n = {y: m[0] for y, m in moments.items()}
    total = sum(n.values())
    if len(n) < 2 or min(n.values()) < 2:
        return (n.get(1, 0.0) + 0.5) / (total + 1.0)
    centre = sum(m[1] for m in moments.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / total - centre**2, 1e-12))
    size, parts = len(centre), {}
    for y, (k, s, p) in moments.items():
        mean = s / k
        cov = (p / k - np.outer(mean, mean)) / np.outer(scale, scale)
        parts[y] = ((mean - centre) / scale, cov)
    pooled = sum(n[y] * parts[y][1] for y in n) / total
    classes = []
    for y in (0, 1):
        mean, cov = parts[y]
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / size, 1e-3) * np.eye(size)
        classes.append((n[y] / total, mean, cov))
    return Discriminant(centre, scale, classes)


def fit(stats: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", to_pooled: float = 0.2, to_identity: float = 0.05) -> Discriminant | float:
    """Fit on all rows of ``labels`` that ``learn`` accepts, joined to ``key, x``.

    Null keys and labels teach nothing; of a key's several labels the largest counts.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    rows = stats.select(F.col(key).alias("k"), "x").join(known, "k")
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(SIZE)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(SIZE) for j in range(i, SIZE)]
    moments = {}
    for r in rows.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(SIZE)] for i in range(SIZE)])
        moments[int(r["y"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(SIZE)]), p)
    return shrunk(moments, to_pooled, to_identity)


def scored(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """``stats`` with ``score`` in place of ``x``, its last column."""
    small_batches(stats.sparkSession)
    rest = stats.columns[:-1]
    rows = stats.toDF(*(f"c{k}" for k in range(len(rest))), "x")
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, SIZE)
            s = np.full(b.num_rows, model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, kinds + "score double").toDF(*rest, "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id"))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 5, 0))
    return scored(stats, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
