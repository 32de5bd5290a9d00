"""Record schemas: fields with types, byte offsets and index kinds."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np

from ..functions.values import ValueType


class IndexKind(Enum):
    """``CANONICAL`` orders the records; ``UNIQUE`` fields get a sorted covering copy, repeats allowed."""

    NONE = "none"
    CANONICAL = "canonical"
    UNIQUE = "unique"


@dataclass(frozen=True)
class Field:
    """One field; without an offset it follows the field before it, without a kind its name decides."""

    name: str
    type: ValueType = ValueType.LONG
    kind: IndexKind | None = None
    offset: int | None = None


class RecordSchema:
    """Fields of a fixed-width record, after ``header`` bytes that hold the ordinal (0: no ordinal is stored)."""

    def __init__(self, name: str, fields: list[Field], header: int = 4, size: int | None = None):
        self.name, self.header, at, placed = name, header, header, []
        for f in fields:
            offset = at if f.offset is None else f.offset
            kind = f.kind or (IndexKind.CANONICAL if f.name.upper() in ("OFFSET", "FILE_OFFSET") else IndexKind.NONE)
            placed.append(Field(f.name, f.type, kind, offset))
            at = offset + f.type.width
        self.fields = placed
        self.size = size or max([header, *(f.offset + f.type.width for f in placed)])
        if sum(f.kind is IndexKind.CANONICAL for f in placed) > 1:
            raise ValueError("at most one canonical field")
        if any(f.offset + f.type.width > self.size for f in placed):
            raise ValueError("a field lies beyond the record")

    @property
    def canonical(self) -> Field | None:
        return next((f for f in self.fields if f.kind is IndexKind.CANONICAL), None)

    @property
    def indexed(self) -> list[Field]:
        """Fields that have a covering copy of their own."""
        return [f for f in self.fields if f.kind is IndexKind.UNIQUE]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def dtype(self) -> np.dtype:
        return np.dtype({"names": [f.name for f in self.fields], "formats": [f.type.dtype for f in self.fields], "offsets": [f.offset for f in self.fields], "itemsize": self.size})

    def ddl(self) -> str:
        return "_pos bigint, " + ", ".join(f"`{f.name}` {f.type.spark}" for f in self.fields)

    def spec(self) -> str:
        """As an option of the data source; ``parse`` reads it back."""
        return f"{self.name};{self.header};{self.size};" + ",".join(f"{f.name}:{f.type.name}:{f.kind.name}:{f.offset}" for f in self.fields)

    @classmethod
    def parse(cls, spec: str) -> RecordSchema:
        name, header, size, fields = spec.split(";")
        made = [Field(n, ValueType[t], IndexKind[k], int(o)) for n, t, k, o in (x.split(":") for x in fields.split(",") if x)]
        return cls(name, made, int(header), int(size))


#: One canonical field alone.
OFFSETS_ONLY = RecordSchema("offsets", [Field("file_offset", ValueType.LONG, IndexKind.CANONICAL)])
