"""Biased search: exact, next, previous and nearest keys, for one probe or for many at once; and inclusive take-while."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordinals import bounds, range_of


class Bias(Enum):
    NONE = "none"
    FORWARD = "forward"
    BACKWARD = "backward"
    NEAREST = "nearest"


def neighbours(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe, below, above``: the (key, _pos) at or below and at or above each probe; null where there is none.

    ``keys``: (key, _pos), of whose equal keys the smallest ordinal counts; ``probes``: (probe), longs without nulls,
    repeats kept. Probes and keys are merged in ranges of keys; what a range has no key for comes from the ranges beside
    it, of which the driver knows the first and last key each. Cost: one sort of both sides, no pairs.
    """
    firsts = keys.where("key is not null").groupBy("key").agg(F.min("_pos").alias("_pos"))
    edges = bounds(firsts, "key")
    ends = {r["p"]: (r["lo"], r["hi"]) for r in firsts.groupBy(range_of(F.col("key"), edges).alias("p")).agg(F.min(F.struct("key", "_pos")).alias("lo"), F.max(F.struct("key", "_pos")).alias("hi")).collect()}
    before, after, last = [], [], None
    for k in range(len(edges) + 1):
        before.append(last)
        last = ends[k][1] if k in ends else last
    last = None
    for k in range(len(edges), -1, -1):
        after.append(last)
        last = ends[k][0] if k in ends else last
    kind = "struct<key:bigint,_pos:bigint>"
    entry = lambda e: F.lit(None).cast(kind) if e is None else F.struct(F.lit(e["key"]).cast("bigint").alias("key"), F.lit(e["_pos"]).cast("bigint").alias("_pos"))
    beside = lambda es: F.element_at(F.array(*map(entry, es)), F.col("part") + 1)
    merged = firsts.select(F.col("key").cast("bigint").alias("k"), F.struct(F.col("key").cast("bigint").alias("key"), F.col("_pos").cast("bigint").alias("_pos")).alias("e"), F.lit(0).alias("asks")).unionByName(
        probes.select(F.col("probe").cast("bigint").alias("k"), F.lit(None).cast(kind).alias("e"), F.lit(1).alias("asks"))
    )
    up = Window.partitionBy("part").orderBy("k", "asks").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.desc("k"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("part", range_of(F.col("k"), edges))
        .withColumn("below", F.last("e", ignorenulls=True).over(up))
        .withColumn("above", F.last("e", ignorenulls=True).over(down))
        .where("asks = 1")
        .select(F.col("k").alias("probe"), F.coalesce("below", beside(before)).alias("below"), F.coalesce("above", beside(after[::-1])).alias("above"))
    )


def pick(found: DataFrame, bias: Bias) -> DataFrame:
    """``probe, key, _pos`` of ``neighbours``' rows: -1 for an ordinal and null for a key where nothing is found.

    Of two keys equally near the lower one counts.
    """
    below, above, probe = F.col("below"), F.col("above"), F.col("probe")
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  distances may exceed a long
    near = F.when(above.isNull() | (wide(probe) - wide(below["key"]) <= wide(above["key"]) - wide(probe)), below).otherwise(above)
    hit = {
        Bias.NONE: F.when(below["key"] == probe, below),
        Bias.FORWARD: above,
        Bias.BACKWARD: below,
        Bias.NEAREST: near,
    }[bias]
    return found.withColumn("hit", hit).select("probe", F.col("hit.key").alias("key"), F.coalesce("hit._pos", F.lit(-1)).cast("bigint").alias("_pos"))


def search(keys: DataFrame, probes: DataFrame, bias: Bias) -> DataFrame:
    return pick(neighbours(keys, probes), bias)


def seek(keys: DataFrame, probe: int, bias: Bias) -> tuple[int, int] | None:
    """(key, ordinal) for one probe; each side is one pushed-down filter and a top-1."""
    k = F.col("key")
    low = keys.where(k <= probe).orderBy(F.desc("key"), "_pos").limit(1).first() if bias is not Bias.FORWARD else None
    if bias is Bias.NONE and low and low["key"] != probe:
        return None
    high = keys.where(k >= probe).orderBy("key", "_pos").limit(1).first() if bias in (Bias.FORWARD, Bias.NEAREST) else None
    if bias is Bias.NEAREST and low and high:
        low = low if probe - low["key"] <= high["key"] - probe else high
    row = low or high
    return (row["key"], row["_pos"]) if row else None


def index_of(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe, _pos``: the first ordinal of each probe's key, or -1; an equi-join."""
    firsts = keys.groupBy(F.col("key").alias("probe")).agg(F.min("_pos").alias("_pos"))
    return probes.join(firsts, "probe", "left").select("probe", F.coalesce("_pos", F.lit(-1)).cast("bigint").alias("_pos"))


def take_while(rows: DataFrame, test: Column, *order: str) -> DataFrame:
    """Rows in order up to and with the first that fails ``test``; all if none fails. A null test is a failure.

    Two scans: the least failing order, then a filter; no running window over everything.
    """
    stop = rows.where(~F.coalesce(test, F.lit(False))).agg(F.min(F.struct(*order)).alias("stop")).first()["stop"]
    if stop is None:
        return rows
    at = F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, stop, strict=True)))
    return rows.where(F.struct(*order) <= at)


def take_while_by(rows: DataFrame, test: Column, group: str, *order: str) -> DataFrame:
    """The same within each value of ``group``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.sum(F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)).over(w)
    return rows.withColumn("__failed", F.coalesce(failed, F.lit(0))).where("__failed = 0").drop("__failed")
