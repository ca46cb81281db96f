"""Declared schemas: ordered fields, some of which identify a record."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .kinds import Kind


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    required: bool = True
    identity: bool = False


@dataclass(frozen=True)
class Schema:
    """Immutable; the builder methods return a longer schema. Field names are unique."""

    name: str
    version: int
    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"schema {self.name!r} has a field name twice")
        if not 0 <= self.version < 2**32:
            raise ValueError("a version is a whole number from 0 to 2**32 - 1")

    def with_field(self, field: Field) -> Schema:
        return replace(self, fields=(*self.fields, field))

    def identity(self, name: str, kind: Kind) -> Schema:
        return self.with_field(Field(name, kind, True, True))

    def required(self, name: str, kind: Kind) -> Schema:
        return self.with_field(Field(name, kind))

    def optional(self, name: str, kind: Kind) -> Schema:
        return self.with_field(Field(name, kind, False))

    def identity_fields(self) -> list[Field]:
        return [f for f in self.fields if f.identity]

    def canonical_text(self) -> str:
        """Compact JSON: name, version, fields; each with name, kind, required, identity."""
        fields = [{"name": f.name, "kind": f.kind.to_json(), "required": f.required, "identity": f.identity} for f in self.fields]
        return json.dumps({"name": self.name, "version": self.version, "fields": fields}, separators=(",", ":"), ensure_ascii=False)

    def to_canonical_bytes(self) -> bytes:
        return self.canonical_text().encode()

    def cid(self) -> str:
        return hashlib.sha256(self.to_canonical_bytes()).hexdigest()

    @staticmethod
    def from_json(text: str) -> Schema:
        v = json.loads(text)
        return Schema(v["name"], v["version"], tuple(Field(f["name"], Kind.from_json(f["kind"]), f["required"], f["identity"]) for f in v["fields"]))

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.kind.spark_type(), not f.required) for f in self.fields])


CATALOG_FIELDS = "schema_cid string, ord int, name string, kind string, required boolean, identity boolean"


def schema_table(spark: SparkSession, schemas: list[Schema]) -> DataFrame:
    return spark.createDataFrame([(s.cid(), s.name, s.version) for s in schemas], "schema_cid string, name string, version long")


def field_table(spark: SparkSession, schemas: list[Schema]) -> DataFrame:
    rows = [(s.cid(), i, f.name, f.kind.text(), f.required, f.identity) for s in schemas for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, CATALOG_FIELDS)


def identity_fields(fields: DataFrame) -> DataFrame:
    """Identity fields of a field table, in schema order."""
    return fields.where("identity").orderBy("schema_cid", "ord")
