"""Stable ordinals without a global sort in one task, and reads, patches and swaps by ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Bytes of a range that is sorted by itself, and how many ranges a search deals its keys into at most.
RANGE_BYTES, MOST_RANGES = 128 << 20, 512


def ranges_for(df: DataFrame) -> int:
    """As many ranges as the estimated size of the tables behind a DataFrame asks for, one a core at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # larger: not known
    return max(df.sparkSession.sparkContext.defaultParallelism, min(1 << 17, -(-size // RANGE_BYTES)))


def bounds(df: DataFrame, key: str, ranges: int | None = None) -> list[int]:
    """Rising values of a long column that deal its rows into at most ``ranges`` parts of about equal size."""
    ranges = min(MOST_RANGES, ranges or ranges_for(df))
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(key, shares, 20 * ranges)).first()[0] if shares else []
    return sorted({int(v) for v in found or []})


def range_of(key: Column, edges: list[int]) -> Column:
    """The part of a key: how many edges are at most it, by binary search. Null keys come first of all."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < edges[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(among(0, len(edges)))


def with_ordinals(df: DataFrame, key: str, *then: str, ordinal: str = "_pos") -> DataFrame:
    """``df`` with 0-based ordinals in the order of ``key``, then of the columns ``then``.

    The rows are sorted once, range by range, and kept so in the shared folder; a row's ordinal is its place in its range
    after the rows of all lower ones. Rows of one key may fall into several ranges, as ``then`` parts them too. The driver
    sees one count a range. Equal sort columns are numbered in no certain order. Nulls come first; no rows give no rows.
    """
    order = [F.col(c).asc_nulls_first() for c in (key, *then)]
    rows = cut(df.repartitionByRange(ranges_for(df), *order).sortWithinPartitions(*order))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    starts, at = [], 0
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
        starts.append((r["p"], at))
        at += r["count"]
    spark = df.sparkSession
    begins = F.broadcast(spark.createDataFrame(starts, "__part int, __start bigint"))
    numbered = rows.withColumn("__part", part).withColumn("__place", place).join(begins, "__part")
    return numbered.select(*df.columns, (F.col("__start") + F.col("__place")).alias(ordinal))


def scan_from(rows: DataFrame, start: int) -> DataFrame:
    """Records from ordinal ``start`` on."""
    return rows.where(F.col("_pos") >= start)


def get(rows: DataFrame, *ordinals: int) -> DataFrame:
    """The records with these ordinals."""
    return rows.where(F.col("_pos").isin(*ordinals))


def fetch(rows: DataFrame, wanted: DataFrame, ordinal: str = "_pos") -> DataFrame:
    """``wanted`` joined to the records whose ordinals it names; absent ones have nulls."""
    return wanted.join(rows.withColumnRenamed("_pos", ordinal), ordinal, "left")


def patch_records(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """Records of ``patch`` (the same columns) in place of those with the same ordinals."""
    return rows.join(patch.select("_pos"), "_pos", "left_anti").unionByName(patch)


def patch_field(rows: DataFrame, ordinal: int, field: str, value: Column) -> DataFrame:
    """One field of one record replaced."""
    return rows.withColumn(field, F.when(F.col("_pos") == ordinal, value).otherwise(F.col(field)))


def patch_fields(rows: DataFrame, patch: DataFrame, field: str) -> DataFrame:
    """A field replaced wherever ``patch`` (_pos, value) names the record; a null value sets null."""
    given = patch.select("_pos", F.struct("value").alias("__patch"))
    return rows.join(given, "_pos", "left").withColumn(field, F.when(F.col("__patch").isNotNull(), F.col("__patch.value")).otherwise(F.col(field))).drop("__patch")


def bulk_swap(rows: DataFrame, a: int, b: int, count: int = 1) -> DataFrame:
    """``count`` records from ordinal ``a`` on exchanged with those from ``b`` on; only ordinals change."""
    if count < 0 or abs(a - b) < count and a != b:
        raise ValueError("the two stretches overlap")
    p = F.col("_pos")
    moved = F.when((p >= a) & (p < a + count), p + (b - a)).when((p >= b) & (p < b + count), p - (b - a)).otherwise(p)
    return rows.withColumn("_pos", moved)


def facts(rows: DataFrame, record_size: int) -> DataFrame:
    """How many records there are, their size and the bytes of all."""
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(record_size).cast("bigint").alias("record_size"), (F.col("n") * record_size).alias("size_in_bytes"))
