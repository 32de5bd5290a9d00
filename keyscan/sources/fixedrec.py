"""``fixedrec``: fixed-width big-endian binary records as a Spark data source.

Record i of a file lies at byte i times the record size; a trailing part of a record does not count. A task reads a range
of whole records of one file through a memory map and yields Arrow batches. Files of a folder follow each other in name
order. Conditions on ``_pos`` narrow the ranges that are read at all. The files must be on a path that every executor
can open.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.values import ValueType
from ..runtime import ship
from .schema import RecordSchema

BATCH, RANGE_BYTES = 1 << 16, 64 << 20
#: Names the files of a folder in order. It is replaced as a whole, so that a reader sees a write entirely or not at all.
MANIFEST = "_files.json"


def _local(path: str) -> str:
    parts = urlparse(path)
    return parts.path if parts.scheme == "file" else path


def _files(path: str) -> list[str]:
    path = _local(path)
    manifest = f"{path}/{MANIFEST}"
    if os.path.exists(manifest):
        with open(manifest) as f:
            return [os.path.join(path, name) for name in json.load(f)]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_"))) if os.path.isdir(path) else [path]


class Range(InputPartition):
    def __init__(self, file: str, first: int, stop: int, base: int):
        self.file, self.first, self.stop, self.base = file, first, stop, base


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: RecordSchema, range_bytes: int):
        self.path, self.record, self.per = path, schema, max(1, range_bytes // schema.size)
        self.lo, self.hi = 0, 1 << 62

    def pushFilters(self, filters):
        """Take conditions on ``_pos``; all others stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("_pos",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            v = int(f.value)
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.lo = max(self.lo, v)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                self.hi = min(self.hi, v + 1)
            if isinstance(f, GreaterThan):
                self.lo = max(self.lo, v + 1)
            if isinstance(f, LessThan):
                self.hi = min(self.hi, v)

    def partitions(self):
        out, base = [], 0
        for file in _files(self.path):
            n = os.path.getsize(file) // self.record.size
            lo, hi = max(0, self.lo - base), min(n, self.hi - base)
            out += [Range(file, a, min(a + self.per, hi), base) for a in range(lo, max(lo, hi), self.per)]
            base += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first >= part.stop:
            return
        rows = np.memmap(part.file, self.record.dtype(), "r", shape=(part.stop,))
        for at in range(part.first, part.stop, BATCH):
            chunk = rows[at : min(at + BATCH, part.stop)]
            columns = [pa.array(np.arange(part.base + at, part.base + at + len(chunk)))]
            for f in self.record.fields:
                v = chunk[f.name]
                if f.type is ValueType.LONG128:
                    columns.append(pa.StructArray.from_arrays([pa.array(v["hi"].astype(np.int64)), pa.array(v["lo"].astype(np.int64))], ["hi", "lo"]))
                else:
                    columns.append(pa.array(v.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["_pos", *(f.name for f in self.record.fields)])


class Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceArrowWriter):
    """Each task writes one file of its own; commit names them in the manifest, in task order, after or instead of what was there."""

    def __init__(self, path: str, schema: RecordSchema, ordinal: str, overwrite: bool = True):
        self.path, self.record, self.ordinal, self.overwrite, self.job = _local(path), schema, ordinal, overwrite, uuid.uuid4().hex

    @staticmethod
    def _whole(column: pa.Array, name: str) -> np.ndarray:
        """A column without nulls, which a record cannot hold."""
        if column.null_count:
            raise ValueError(f"{name} has nulls")
        return column.to_numpy(zero_copy_only=False)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f"{self.path}/part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        with open(name, "wb") as out:
            for b in batches:
                rows = np.zeros(b.num_rows, self.record.dtype())
                for f in self.record.fields:
                    column = b.column(f.name)
                    if f.type is ValueType.LONG128:
                        self._whole(column, f.name)
                        rows[f.name]["hi"], rows[f.name]["lo"] = (self._whole(column.field(k), f.name) for k in (0, 1))
                    else:
                        values = self._whole(column, f.name)
                        rows[f.name] = values
                        if (rows[f.name].astype(np.int64) != values).any():
                            raise ValueError(f"{f.name} has values beyond its type")
                if self.record.header >= 4 and self.ordinal in b.schema.names:
                    raw = rows.view(np.uint8).reshape(len(rows), self.record.size)
                    ordinals = self._whole(b.column(self.ordinal), self.ordinal)
                    if len(ordinals) and not 0 <= ordinals.min() <= ordinals.max() < 1 << 31:
                        raise ValueError("an ordinal does not fit its four bytes")
                    raw[:, :4] = ordinals.astype(">i4").view(np.uint8).reshape(-1, 4)
                out.write(rows.tobytes())
        return Done([name])

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = _files(self.path)
        new = sorted(x for m in messages if m for x in m.files)
        names = [os.path.basename(f) for f in ([] if self.overwrite else old) + new]
        with open(f"{self.path}/{MANIFEST}-{self.job}", "w") as out:
            json.dump(names, out)
        os.replace(out.name, f"{self.path}/{MANIFEST}")
        self._clean(set(names), old if self.overwrite else [])

    def abort(self, messages: list) -> None:
        self._clean(set(), [])

    def _clean(self, kept: set[str], old: list[str]) -> None:
        """Remove what is replaced, and what failed tasks of this job left."""
        mine = [f"{self.path}/{f}" for f in os.listdir(self.path) if f.startswith(f"part-{self.job}-")] if os.path.isdir(self.path) else []
        for f in [*mine, *old]:
            if os.path.basename(f) not in kept and os.path.exists(f):
                os.unlink(f)


class FixedRecords(DataSource):
    """Options: ``path``, ``record`` (``RecordSchema.spec()``), ``rangeBytes`` a task, ``ordinal`` column to store."""

    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def _record(self) -> RecordSchema:
        return RecordSchema.parse(self.options["record"])

    def schema(self) -> str:
        return self._record().ddl()

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._record(), int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._record(), self.options.get("ordinal", "_pos"), overwrite)


def read_records(spark: SparkSession, path: str, schema: RecordSchema, **options) -> DataFrame:
    """``_pos`` and the fields of every record under ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixedrec").option("record", schema.spec()).options(**options).load(path)


def write_records(df: DataFrame, path: str, schema: RecordSchema, mode: str = "overwrite") -> None:
    """Write records in the order of the partitions, instead of what was under ``path`` or, with ``append``, after it.

    A null, a value beyond its field's type, and an ordinal beyond four bytes raise, and leave what was there.
    """
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(FixedRecords)
    df.write.format("fixedrec").option("record", schema.spec()).mode(mode).save(path)
