"""Toxicity by compression distance.

Zstandard dictionaries are trained on samples of ordinary and of toxic text, each by itself. A text is cut into windows of
a few words, white space between them made one space; each window is compressed with the ordinary dictionary, and with it
and the toxic one together, and the bytes that the toxic dictionary saves are its evidence. A text's largest savings and
its number of windows give a score by a logistic curve, calibrated on labelled texts that trained neither dictionary.

The ordinary dictionary is trained on the windows of whole ordinary texts, and on their words that share byte grams with
what toxic text adds, which would look like it otherwise. The toxic one is trained on the words of toxic texts that stand
in several distinct contexts there (copies of one text are one context) and significantly less often, word for word, in
ordinary texts: trained on all that toxic texts hold, a dictionary learns what every text holds.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: At most so many labelled texts of each class train the dictionaries and the threshold.
SAMPLE = {1: 3000, 0: 9000}
WORDS, GRAM, LEVEL = 6, 5, 3
MARKS = b".,;:!?'\"()*#%$&|"
#: Bytes of each trained dictionary, and the lengths of the segments and of the strings counted in them (COVER's k and d).
ORDINARY_BYTES, NEAR_BYTES, TOXIC_BYTES = 48 << 10, 32 << 10, 4 << 10
SEGMENT, COUNTED = 64, {"windows": 6, "words": 8}
#: A word that toxic text adds stands in so many contexts there, at so many times the ordinary rate, and with so large a
#: log-likelihood ratio.
CONTEXTS, TIMES, SIGNIFICANT = 3, 5, 18


def windows(text: bytes) -> list[bytes]:
    """Runs of ``WORDS`` words of the whole text; a text without words has one empty window."""
    w = text.lower().split()
    return [b" " + b" ".join(w[i : i + WORDS]) + b" " for i in range(0, len(w), WORDS)] or [b" "]


def contexts(texts: list[bytes], only: set[bytes] | None = None) -> tuple[Counter, int]:
    """In how many distinct contexts (words before and after) each word stands, and how many contexts there are in all.

    With ``only``, no other words are counted; the number in all is the same.
    """
    ids: dict[bytes, int] = {w: k for k, w in enumerate(only or ())}
    every, of = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for t in texts:
        words = t.split()
        every.append(np.fromiter(map(hash, zip([b"", *words], words, [*words[1:], b""], strict=False)), np.int64, len(words)))
        bare = (w.strip(MARKS) for w in words)
        number = (ids.get(w, -1) if only is not None else ids.setdefault(w, len(ids)) if w else -1 for w in bare)
        of.append(np.fromiter(number, np.int32, len(words)))
    stands, of = np.concatenate(every), np.concatenate(of)
    every.clear()
    total = len(np.unique(stands))
    stands, of = stands[of >= 0], of[of >= 0]
    order = np.lexsort((stands, of))
    stands, of = stands[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (stands[1:] != stands[:-1])
    many = np.bincount(of[new], minlength=len(ids)).tolist()
    return Counter({w: many[k] for w, k in ids.items() if many[k]}), total


def added(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words that toxic texts add, most frequent first: by the log-likelihood ratio of their two rates."""
    one, n1 = contexts(toxic)
    one = {w: n for w, n in one.items() if n >= CONTEXTS}
    zero, n0 = contexts(ordinary, set(one))
    out = []
    for w, a in one.items():
        b = zero[w]
        share = (a + b) / (n1 + n0)
        ratio = 2 * (a * math.log(a / (n1 * share)) + (b * math.log(b / (n0 * share)) if b else 0.0))
        if a / n1 > TIMES * b / max(1, n0) and ratio > SIGNIFICANT:
            out.append(w)
    return sorted(out, key=lambda w: (-one[w], w))


class Model:
    """Both dictionaries and the curve; pickles as plain bytes and numbers."""

    def __init__(self, base: bytes, toxic: bytes, weights: list[float]):
        self.base, self.toxic, self.weights = base, toxic, weights
        self._made: tuple | None = None

    def __getstate__(self):
        return self.base, self.toxic, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves, window by window."""
        if self._made is None:
            self._made = tuple(map(_compress, (self.base, self.base + self.toxic)))
        ordinary, toxic = self._made
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])

    def score(self, text: bytes) -> float:
        z = float(np.dot(self.weights, features(self.savings(text))))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _compress(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def features(savings: np.ndarray) -> np.ndarray:
    """1, the two largest savings, and the logarithm of how many windows there are."""
    top = np.sort(savings)[-2:].clip(0)
    return np.array([1.0, float(top[-1]), float(top[0]) if len(top) > 1 else 0.0, math.log1p(len(savings))])


def grams(word: bytes) -> set[bytes]:
    x = b" " + word + b" "
    return {x[i : i + GRAM] for i in range(max(1, len(x) - GRAM + 1))}


def trained(samples: list[bytes], size: int, counted: int) -> bytes:
    """A dictionary of at most ``size`` bytes, trained on the samples; too few for training are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=counted, f=20, split_point=1.0, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed(dict.fromkeys(samples)))[-size:]


def dictionaries(texts: list[tuple[bytes, int]]) -> Model:
    """Both dictionaries from whole texts of both classes."""
    plain, bad = ([t for t, y in texts if y == k] for k in (0, 1))
    known = set(added(bad, plain))
    shared = set().union(*map(grams, known)) if known else set()
    looks_toxic = lru_cache(1 << 16)(lambda w: w not in known and not shared.isdisjoint(grams(w)))
    words = lambda some, wanted: [b" " + x + b" " for t in some for w in t.split() if (x := w.strip(MARKS)) and wanted(x)]
    base = trained([x for t in plain for x in windows(t) if len(x) >= 8], ORDINARY_BYTES, COUNTED["windows"])
    near = trained(words(plain, looks_toxic), NEAR_BYTES, COUNTED["words"])
    return Model(base + near or b" ", trained(words(bad, known.__contains__), TOXIC_BYTES, COUNTED["words"]) or b" ", [0.0] * 4)


#: The parts of training, which need nothing of each other: each half learns for the other, and all texts together.
PARTS = (0, 1, 2)


def flat(texts: list[tuple[bytes, int]]) -> Model:
    """The score is the share of toxic texts, 0 if there are none at all."""
    share = sum(y for _, y in texts) / max(1, len(texts))
    return Model(b" ", b" ", [math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0])


def part(texts: list[tuple[int, bytes, int]], which: int):
    """One part of training from (key, text, label): features and labels of the half that did not learn, or a model.

    Without texts of both classes in both halves there is nothing to tune, and the model is flat.
    """
    ordered = [(t.lower(), y) for _, t, y in sorted(texts, key=lambda x: (x[2], x[0]))]
    halves = [ordered[0::2], ordered[1::2]]
    mixed = all(len({y for _, y in h}) == 2 for h in halves)
    if which == 2:
        return dictionaries(ordered) if mixed else flat(ordered)
    if not mixed:
        return [], []
    model, tune = dictionaries(halves[which]), halves[1 - which]
    return [features(model.savings(t)) for t, _ in tune], [float(y) for _, y in tune]


def combined(parts: list) -> Model:
    """The model of all texts, with the curve that both halves' features give."""
    model, (x, y) = parts[2], (sum((list(p[k]) for p in parts[:2]), []) for k in (0, 1))
    if x:
        model.weights = logistic(np.array(x), np.array(y))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on a bounded sample: of each class the ``SAMPLE`` labelled rows with the lowest hashes of their keys.

    ``learn`` tells of a row of ``labels`` whether it may be learnt from. Null keys and labels teach nothing; of a
    key's several labels the largest counts. All texts go to each of three tasks, one for each
    part of training, which their bounded number keeps small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in SAMPLE.items()]
    sample = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(sample), "k")
    rows = rows.withColumn("part", F.explode(F.array(*map(F.lit, PARTS))))

    def run(table: pa.Table) -> pa.Table:
        texts = [(r["k"], r["t"].encode("utf-8", "replace"), int(r["y"])) for b in table.to_batches() for r in b.to_pylist()]
        which = table.column("part")[0].as_py()
        made = pickle.dumps(part(texts, which))
        texts.clear()
        give_back()
        return pa.table({"part": pa.array([which], pa.int32()), "made": pa.array([made])})

    made = {r["part"]: pickle.loads(r["made"]) for r in rows.groupBy("part").applyInArrow(run, "part int, made binary").collect()}
    return combined([made[k] for k in PARTS]) if made else flat([])


def with_toxicity(df: DataFrame, model: Model, text: str, *carry: str) -> DataFrame:
    """``*carry, score``: the score of each whole text. Null and empty texts have one empty window."""
    small_batches(df.sparkSession)
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(text).alias("t"))
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score((t or "").encode("utf-8", "replace")) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, kinds + "score double").toDF(*carry, "score")


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether the crc32 of the key as text leaves ``fold`` by ``folds``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 3, 1))
    out = with_toxicity(docs, model, "text", "doc_id")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
