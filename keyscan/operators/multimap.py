"""One-to-many indexes: edges (key_index, value_index, key, value), their counts, ordered reads, inverse and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut
from .search import Bias, seek, take_while, take_while_by

COLUMNS = ("key_index", "value_index", "key", "value")
ORDER = ("key", "value", "key_index", "value_index")


def edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(*COLUMNS)


def counts(e: DataFrame) -> DataFrame:
    """``key, key_index, n`` for each key."""
    return e.groupBy("key").agg(F.min("key_index").alias("key_index"), F.count("*").alias("n"))


def count_of(e: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe, n``: how many values each probed key has, -1 for an absent one."""
    found = counts(e).select(F.col("key").alias("probe"), "n")
    return probes.join(found, "probe", "left").select("probe", F.coalesce("n", F.lit(-1)).cast("bigint").alias("n"))


def values(e: DataFrame, key: int, test: Column | None = None) -> DataFrame:
    """A key's values in order; with ``test`` up to and with the first that fails."""
    mine = e.where(F.col("key") == key)
    return mine if test is None else take_while(mine, test, *ORDER)


def values_by_index(e: DataFrame, key_index: int, test: Column | None = None) -> DataFrame:
    mine = e.where(F.col("key_index") == key_index)
    return mine if test is None else take_while(mine, test, *ORDER)


def read_from(e: DataFrame, key: int, test: Column) -> DataFrame:
    """From the first row of ``key`` to the end of the index or the first row that fails; nothing if the key is absent."""
    return take_while(e.where(F.col("key") >= key), test, *ORDER) if e.where(F.col("key") == key).take(1) else e.limit(0)


def read_from_index(e: DataFrame, key_index: int, test: Column) -> DataFrame:
    return e.limit(0) if key_index < 0 else take_while(e.where(F.col("key_index") >= key_index), test, *ORDER)


def read_nearest(e: DataFrame, key: int) -> DataFrame:
    """From the key nearest to ``key`` on to the end."""
    found = seek(e.select("key", F.lit(0).cast("bigint").alias("_pos")), key, Bias.NEAREST)
    return e.limit(0) if found is None else e.where(F.col("key") >= found[0])


def take_while_per_key(e: DataFrame, test: Column) -> DataFrame:
    return take_while_by(e, test, "key", "value", "key_index", "value_index")


def value_set(e: DataFrame) -> DataFrame:
    """``key, value`` without repeats."""
    return e.select("key", "value").distinct()


def value_indices(e: DataFrame) -> DataFrame:
    """``key, value_indices``: sorted sets of value ordinals. A set is one row, so this is for keys of bounded degree."""
    return e.groupBy("key").agg(F.array_sort(F.collect_set("value_index")).alias("value_indices"))


def inverse(e: DataFrame) -> DataFrame:
    """Keys and values exchanged; a projection."""
    return e.select(F.col("value_index").alias("key_index"), F.col("key_index").alias("value_index"), F.col("value").alias("key"), F.col("key").alias("value"))


def keys(e: DataFrame) -> DataFrame:
    """``key_index, key`` of each key."""
    return e.select("key_index", "key").distinct()


def size(e: DataFrame) -> DataFrame:
    """``n``: how many edges there are."""
    return e.agg(F.count("*").alias("n"))


def values_by_nearest_index(e: DataFrame, key_index: int, test: Column | None = None) -> DataFrame:
    """The values of the key whose ordinal is nearest to ``key_index``."""
    found = seek(e.select(F.col("key_index").alias("key"), F.lit(0).cast("bigint").alias("_pos")), key_index, Bias.NEAREST)
    return e.limit(0) if found is None else values_by_index(e, found[0], test)


def save(e: DataFrame, path: str, ranges: int = 32) -> None:
    """Keep the edges in order of keys, those of the inverse in order of values, and the counts of both."""
    for name, some in (("edges", edges(e)), ("inverse", inverse(e))):
        some.repartitionByRange(ranges, "key", "value").sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{path}/{name}")
        kept = e.sparkSession.read.parquet(f"{path}/{name}")
        counts(kept).write.mode("overwrite").parquet(f"{path}/{name}_counts")


def load(spark: SparkSession, path: str, inverse: bool = False) -> DataFrame:
    """The kept edges, or those of the inverse; a test of keys reads their ranges only."""
    return spark.read.parquet(f"{path}/{'inverse' if inverse else 'edges'}")


def load_counts(spark: SparkSession, path: str, inverse: bool = False) -> DataFrame:
    """``key, key_index, n`` as kept."""
    return spark.read.parquet(f"{path}/{'inverse' if inverse else 'edges'}_counts")


def extent(e: DataFrame) -> DataFrame:
    """Rows, keys, smallest and largest key; -1 for the latter two if there are none."""
    return e.agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), F.coalesce(F.min("key"), F.lit(-1)).alias("min_key"), F.coalesce(F.max("key"), F.lit(-1)).alias("max_key"))


def closure(e: DataFrame, start: int, stop: Column | None = None, rounds: int | None = None) -> DataFrame:
    """``node, depth``: what is reachable from ``start``, itself only where it lies on a cycle.

    A node for which ``stop`` (a test of ``node``) holds is collected but not followed. Each round joins the frontier to
    the edges and drops what was seen; rounds go on until nothing is new, or to ``rounds``.
    """
    links = e.select(F.col("key").cast("bigint").alias("key"), F.col("value").cast("bigint").alias("node")).distinct()
    spark = e.sparkSession
    frontier = spark.createDataFrame([(start,)], "key bigint")
    seen, depth = None, 0
    while rounds is None or depth < rounds:
        depth += 1
        new = frontier.join(links, "key").select("node").distinct()
        if seen is not None:
            new = new.join(seen.select("node"), "node", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if not new.take(1):
            break
        seen = new if seen is None else seen.unionByName(new)
        follow = new if stop is None else new.where(~F.coalesce(stop, F.lit(False)))
        frontier = follow.select(F.col("node").alias("key"))
    return seen if seen is not None else spark.createDataFrame([], "node bigint, depth int")
