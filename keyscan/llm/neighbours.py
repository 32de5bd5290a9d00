"""Nearest neighbours by learned partitions.

On a bounded sample of vectors the driver makes a nearest-neighbour graph, parts it into balanced parts that cut few
edges, and fits a softmax classifier from a vector to its part. Every vector is indexed in its most probable part; a
query goes to its several most probable parts and is reranked there by exact inner products. Equal vectors are one entry
with their smallest ids, as no more of them can come into a result; a part with very many entries is dealt over blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches

#: Vectors that the partition is learnt from, graph neighbours of each, and vectors of the sample in a part: as many parts
#: as the root of all entries' number, but no fewer than of the first size and no more than of the second.
SAMPLE, GRAPH, PART, LEAST_PART = 16_384, 10, 128, 16
#: The recall, measured on the sample, that the number of probed parts is chosen for; sample queries that measure it;
#: and entries of a part in one block.
RECALL, TRIALS, BLOCK = 0.96, 512, 8192
K = 20
#: Pairs of vectors that are multiplied at once.
PAIRS = 1 << 14


def graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """The k nearest others of each row by inner product; fewer rows: fewer."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if k > 0:
            out[at : at + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.15, seed: int = 0) -> np.ndarray:
    """Parts of the graph, none over ``slack`` times the mean size, that few edges leave.

    Starts from halving along main directions; then vertices move to the part most of their neighbours are in, the
    largest gains first, as long as there is room.
    """
    part = np.zeros(len(x), np.int64)
    sizes, queue = [np.arange(len(x))], 1
    while queue < parts:
        sizes.sort(key=len)
        rows = sizes.pop()
        y = x[rows] - x[rows].mean(0)
        v = np.random.default_rng(seed + queue).normal(size=x.shape[1])
        for _ in range(10):
            v = y.T @ (y @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        order = np.argsort(y @ v, kind="stable")
        sizes += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        queue += 1
    for k, rows in enumerate(sizes):
        part[rows] = k
    limit = int(np.ceil(slack * len(x) / parts))
    count = np.bincount(part, minlength=parts)
    for _ in range(rounds if near.shape[1] else 0):
        votes = part[near]
        here = (votes == part[:, None]).sum(1)
        order = np.sort(votes, axis=1)
        run = np.zeros_like(order)
        for k in range(1, order.shape[1]):
            run[:, k] = np.where(order[:, k] == order[:, k - 1], run[:, k - 1] + 1, 0)
        best = order[np.arange(len(x)), run.argmax(1)]
        gain = run.max(1) + 1 - here
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if count[best[i]] < limit:
                count[part[i]] -= 1
                count[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def classifier(x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 60, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights and biases from vectors to parts, by full-batch gradients with momentum from the parts' means."""
    scale = 1 / max(1e-12, float(np.sqrt((x**2).sum(1).mean())))
    x = x * scale
    means = np.stack([x[part == k].mean(0) if (part == k).any() else np.zeros(x.shape[1]) for k in range(parts)])
    w, b = 8 * means, -4 * (means**2).sum(1)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    one = np.eye(parts)[part] if len(x) * parts <= 1 << 24 else None
    for _ in range(rounds):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if one is not None:
            p -= one
        else:
            p[np.arange(len(x)), part] -= 1
        vw = 0.9 * vw - rate * parts * (p.T @ x) / len(x)
        vb = 0.9 * vb - rate * p.sum(0) / len(x)
        w, b = w + vw, b + vb
    return w * scale, b


class Router:
    """The classifier that indexes and routes; a few hundred rows of weights."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        z = x.astype(np.float32) @ self.weights.T + self.bias
        n = min(n, z.shape[1])
        return np.argpartition(-z, n - 1, axis=1)[:, :n]


def fit(x: np.ndarray, parts: int) -> Router:
    """Learn the partition of the rows of ``x``, scaled to unit length, into ``parts``."""
    if parts < 2 or len(x) < 2:
        return Router(np.zeros((1, x.shape[1] if x.ndim == 2 else 1)), np.zeros(1))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return Router(*classifier(x, balanced(unit, graph(unit), parts), parts))


def probes_for(router: Router, x: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest most probable parts that hold ``recall`` of the sample's true nearest neighbours.

    A sample's k nearest lie further off than the k nearest of all, so that this asks for too many parts, not too few.
    """
    parts = len(router.bias)
    if parts < 2 or len(x) < 2:
        return 1
    home = router.top(x, 1)[:, 0]
    trial = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(np.int64)
    s = x[trial] @ x.T
    s[np.arange(len(trial)), trial] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    z = x[trial].astype(np.float32) @ router.weights.T + router.bias
    rank = np.empty(z.shape, np.int64)
    np.put_along_axis(rank, np.argsort(-z, axis=1), np.arange(parts)[None, :], 1)
    needed = np.sort(np.take_along_axis(rank, home[near], 1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` nearest others by inner product in double precision.

    ``is_query`` selects the query rows by their columns. Ties go to the smaller id. Rows with a null id, an invalid
    vector, or a length other than the most common one take no part; of repeated ids with one vector one counts, and an
    id is never its own neighbour. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(F.col(key).isNotNull() & valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (width["d"] if width else 0)).dropDuplicates(["id", "v"]).withColumn("h", F.xxhash64("v"))
    # the k+1 smallest ids of each distinct vector, first among the rows of one salt, then among all
    least = Window.partitionBy("h", "v", "salt").orderBy("id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    entries = some.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    entries = cut(entries.withColumn("e", F.element_at("ids", 1)))
    n = entries.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = entries.where(F.pmod(F.xxhash64("e", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("e").select("v").limit(2 * SAMPLE).toPandas()
    x = np.array(sample["v"].tolist(), np.float64).reshape(len(sample), width["d"] if width else 1)
    parts = max(1, len(x) // PART, min(math.isqrt(n), len(x) // LEAST_PART))
    router = fit(x, parts)
    probed = probes_for(router, x, k, recall)

    def routed(many: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                top = router.top(_matrix(b.column(1)), many)
                at = np.repeat(np.arange(b.num_rows), top.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(top.reshape(-1).astype(np.int32))], [*b.schema.names, "part"])

        return run

    index = cut(entries.select("e", "v").mapInArrow(routed(1), "e long, v array<double>, part int"))
    blocks = cut(index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    asked = rows.where("q").select("h", "v").distinct().join(entries.select("h", "v", "e"), ["h", "v"]).select("e", "v")
    queries = asked.mapInArrow(routed(probed), "e long, v array<double>, part int").join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks").cast("int")))).select("e", "v", "part", "block")
    held = index.join(blocks, "part").withColumn("block", (F.pmod(F.xxhash64("e", F.lit(3)), F.col("blocks")) + 1).cast("int")).select("e", "v", "part", "block")

    def rerank(q: pa.Table, c: pa.Table) -> pa.Table:
        """The nearest entries of one block for the queries that were routed there."""
        names = ("q", "e", "score")
        if not q.num_rows or not c.num_rows:
            return pa.table({m: pa.array([], t) for m, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        qv, cv, ids = _matrix(q.column("v").combine_chunks()), _matrix(c.column("v").combine_chunks()), c.column("e").to_numpy()
        keep = min(len(ids), k + 1)
        longest = np.sqrt((cv**2).sum(1).max())
        out = [[], [], []]
        for at in range(0, len(qv), 256):
            part = qv[at : at + 256]
            rough = part @ cv.T
            least = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
            # all that rounding may have put below it; ties are many at times
            slack = 4 * cv.shape[1] * np.finfo(np.float64).eps * np.sqrt((part**2).sum(1)) * longest
            row, best = np.nonzero(rough >= (least - slack)[:, None])
            # each product again, summed in one fixed order, so that equal vectors score alike wherever they stand
            exact = np.concatenate([(part[row[a : a + PAIRS]] * cv[best[a : a + PAIRS]]).sum(-1) for a in range(0, len(row), PAIRS)])
            order = np.lexsort((ids[best], -exact, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < keep]
            out[0].append(q.column("e").to_numpy()[at : at + 256][row[order]])
            out[1].append(ids[best[order]])
            out[2].append(exact[order])
        return pa.table(dict(zip(names, (np.concatenate(o) for o in out), strict=True)))

    found = queries.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(rerank, "q long, e long, score double")
    # the k+1 best distinct vectors of each distinct query vector, then each query's own view of them
    first = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    best = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("q", "e", "score")
    ids = best.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    second = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = ids.withColumn("n", F.row_number().over(second)).where(F.col("n") <= k + 1)
    lists = short.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id"))).alias("hits"))
    mine = rows.where("q").select("id", "h", "v").join(entries.select("h", "v", F.col("e").alias("q")), ["h", "v"]).select("id", "q").distinct()
    own = mine.join(lists, "q").select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("p", "hit")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
