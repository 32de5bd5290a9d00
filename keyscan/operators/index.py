"""Indexes: a primary dataset in canonical order and a range-sorted covering copy for each unique field."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import IndexKind, RecordSchema
from .ordinals import fetch, with_ordinals
from .search import Bias, search


def build(rows: DataFrame, schema: RecordSchema, path: str, ranges: int = 32, strict: bool = False) -> Index:
    """Number the rows in canonical order, however they arrive, and write the primary and its copies over what is there.

    Without a canonical field the rows must bring ``_pos``. ``strict`` raises where a unique field repeats a value.
    """
    names = [f.name for f in schema.fields]
    if schema.canonical:
        rows = with_ordinals(rows.select(*names), schema.canonical.name)
    rows = rows.select("_pos", *names)
    if strict:
        for f in schema.indexed:
            if rows.groupBy(f.name).count().where("count > 1").take(1):
                raise ValueError(f"{f.name} repeats a value")
    rows.repartitionByRange(ranges, "_pos").sortWithinPartitions("_pos").write.mode("overwrite").parquet(f"{path}/primary")
    primary = rows.sparkSession.read.parquet(f"{path}/primary")
    for f in schema.indexed:
        primary.repartitionByRange(ranges, f.name).sortWithinPartitions(f.name, "_pos").write.mode("overwrite").parquet(f"{path}/by_{f.name}")
    rows.sparkSession.createDataFrame([(json.dumps(schema.spec()),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    return Index(rows.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an index is built under a path; its schema is written last."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/schema/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Index:
    """A built index; each copy is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = RecordSchema.parse(json.loads(spark.read.text(f"{path}/schema").first()[0]))
        self._open: dict[str, DataFrame] = {}

    def rows(self, field: str | None = None) -> DataFrame:
        """The primary, or the copy sorted by ``field``; a field without a copy raises."""
        if field is not None and (self.schema.canonical is None or field != self.schema.canonical.name):
            if self.schema.field(field).kind is not IndexKind.UNIQUE:
                raise ValueError(f"{field} is not indexed")
            name = f"by_{field}"
        else:
            name = "primary"
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._open[name]

    def where(self, field: str, test: Column) -> DataFrame:
        """Rows that pass a test of one field, read from the copy that its values are sorted in."""
        return self.rows(field).where(test)

    def keys(self, field: str) -> DataFrame:
        return self.rows(field).select(F.col(field).alias("key"), "_pos")

    def search(self, field: str, probes: DataFrame, bias: Bias) -> DataFrame:
        """``probe, key, _pos``: ordinals in the primary."""
        return search(self.keys(field), probes, bias)

    def find(self, field: str, probes: DataFrame, bias: Bias = Bias.NONE) -> DataFrame:
        """Each probe with the whole record that the search finds; nulls where it finds none."""
        return fetch(self.rows(), self.search(field, probes, bias).drop("key"))

    def find_all(self, field: str, probes: DataFrame) -> DataFrame:
        """Each probe with every record that holds it, from the covering copy; probes that none holds are left out."""
        rows = self.rows(field)
        return probes.join(rows, F.col("probe") == rows[field]).select("probe", *(rows[c] for c in rows.columns))

    def size(self) -> int:
        return self.rows().count()
