"""Field kinds: what a value of a record may be."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

PLAIN = ("string", "integer", "float", "bool", "cid")


@dataclass(frozen=True)
class Kind:
    """One of the plain kinds, or "ref" to a schema (by content id), or "list" of an inner kind."""

    name: str
    target: str | None = None
    inner: Kind | None = None

    def __post_init__(self):
        plain = self.name in PLAIN and self.target is None and self.inner is None
        ref = self.name == "ref" and self.target is not None and self.inner is None
        lst = self.name == "list" and self.inner is not None and self.target is None
        if not (plain or ref or lst):
            raise ValueError(f"no such kind: {self.name!r}")

    def to_json(self):
        return {"ref": self.target} if self.name == "ref" else {"list": self.inner.to_json()} if self.name == "list" else self.name

    @staticmethod
    def from_json(v) -> Kind:
        if isinstance(v, str):
            return Kind(v)
        if isinstance(v, dict) and len(v) == 1:
            if "ref" in v:
                return Kind("ref", target=v["ref"])
            if "list" in v:
                return Kind("list", inner=Kind.from_json(v["list"]))
        raise ValueError(f"no such kind: {v!r}")

    def text(self) -> str:
        """The kind as JSON text, as tables hold it."""
        return json.dumps(self.to_json(), separators=(",", ":"), ensure_ascii=False)

    def label(self) -> str:
        """The name in error messages."""
        if self.name == "ref":
            return f"Ref({json.dumps(self.target, ensure_ascii=False)})"
        if self.name == "list":
            return f"List({self.inner.label()})"
        return self.name.capitalize()

    def spark_type(self) -> T.DataType:
        return {"integer": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}.get(self.name) or (T.ArrayType(T.VariantType()) if self.name == "list" else T.StringType())


STRING, INTEGER, FLOAT, BOOL, CID = map(Kind, PLAIN)


def ref(target: str) -> Kind:
    return Kind("ref", target=target)


def list_of(inner: Kind) -> Kind:
    return Kind("list", inner=inner)
