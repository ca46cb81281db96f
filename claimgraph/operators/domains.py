"""Domains: named sets of schemas. domains: (ord BIGINT, name STRING, version BIGINT, schema_cids ARRAY<STRING>)."""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = "ord long, name string, version long, schema_cids array<string>"


@dataclass(frozen=True)
class Domain:
    name: str
    version: int
    schema_cids: tuple[str, ...] = ()

    def with_schema(self, cid: str) -> Domain:
        """With this schema too; the ids stay sorted by their bytes and distinct."""
        keys = [c.encode() for c in self.schema_cids]
        at = bisect_left(keys, cid.encode())
        if at < len(keys) and keys[at] == cid.encode():
            return self
        return Domain(self.name, self.version, (*self.schema_cids[:at], cid, *self.schema_cids[at:]))

    def to_canonical_bytes(self) -> bytes:
        return json.dumps({"name": self.name, "version": self.version, "schema_cids": list(self.schema_cids)}, separators=(",", ":"), ensure_ascii=False).encode()

    def contains(self, cid: str) -> bool:
        return cid in self.schema_cids

    def schema_count(self) -> int:
        return len(self.schema_cids)


def with_schema(ids: Column, cid: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_append(ids, cid)))


def canonical_text() -> Column:
    return F.to_json(F.struct("name", "version", "schema_cids"))


def membership(domains: DataFrame) -> DataFrame:
    """(schema_cid, domain): the domain of each schema; of several, the last by ord."""
    rows = domains.select("ord", "name", F.explode("schema_cids").alias("schema_cid"))
    return rows.groupBy("schema_cid").agg(F.max_by("name", "ord").alias("domain"))
