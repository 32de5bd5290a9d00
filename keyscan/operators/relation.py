"""Persisted relations from keys to values: a two-column DataFrame with a row for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import take_while


def put(relation: DataFrame, more: DataFrame) -> DataFrame:
    """Pairs of ``more`` in place of those with the same key; the last write wins."""
    return relation.join(more.select("key").distinct(), "key", "left_anti").unionByName(more)


def remove(relation: DataFrame, keys: DataFrame) -> DataFrame:
    return relation.join(keys.select("key").distinct(), "key", "left_anti")


def clear(relation: DataFrame) -> DataFrame:
    return relation.limit(0)


def get_or_default(relation: DataFrame, probes: DataFrame, default: int) -> DataFrame:
    """``key, value`` for each probed key."""
    return probes.select("key").join(relation, "key", "left").select("key", F.coalesce("value", F.lit(default)).cast("bigint").alias("value"))


def contains(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, value, found`` for each probed pair."""
    known = relation.distinct().withColumn("found", F.lit(True))
    return pairs.join(known, ["key", "value"], "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def contains_key(relation: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(relation.select("key").distinct(), "key", "left_semi")


def by_ordinals(pairs: DataFrame, keys: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of ordinals (key_index, value_index) as the values that two readers, each (_pos, value), have there."""
    left = keys.select(F.col("_pos").alias("key_index"), F.col("value").alias("key"))
    right = others.select(F.col("_pos").alias("value_index"), "value")
    return pairs.select("key_index", "value_index").join(left, "key_index").join(right, "value_index").select("key", "value")


def save(relation: DataFrame, path: str) -> None:
    relation.select("key", "value").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same pairs, as often."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def size(relation: DataFrame) -> DataFrame:
    """``n``: how many pairs there are."""
    return relation.agg(F.count("*").alias("n"))


def walk_while(relation: DataFrame, test: Column) -> DataFrame:
    """Pairs in order of keys, then values, up to and with the first that fails the test."""
    return take_while(relation, test, "key", "value")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n``: how many pairs stand in one of two relations more often than in the other; 0 if they are equal."""
    both = a.select("key", "value", F.lit(1).alias("n")).unionByName(b.select("key", "value", F.lit(-1).alias("n")))
    return both.groupBy("key", "value").agg(F.sum("n").alias("n")).where("n <> 0").agg(F.count("*").alias("n"))


def by_field(rows: DataFrame, field: str) -> DataFrame:
    """The relation from a field's values to the ordinals of their records."""
    return rows.select(F.col(field).alias("key"), F.col("_pos").alias("value"))
