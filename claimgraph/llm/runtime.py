"""What the operators share: cut lineage in the shared folder, per-process caches, text batches."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..sources.shared import clear, cut, delete, drop_cut, hold, shared_dir, tables  # noqa: F401

WORD = re.compile(r"[^\W_]+")
#: Characters that one vectorised step works on; bounds a worker's memory, never a text's length.
STEP_CHARS = 3_000_000
CACHE_ENTRIES = 300_000
#: Rows of a table that may be sent to every task.
BROADCAST_ROWS = 2_000_000
SALTS = 64


def id_of(df: DataFrame, column: str = "doc_id") -> Column:
    """The column as a 64-bit whole number. Any other kind of id is refused here, before a worker meets it."""
    kind = df.select(column).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}")
    return F.col(column).cast("long").alias(column)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def looked_up(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of the one row of `small` (a table that cut() wrote) that agrees in `on`, nulls being equal.

    A small table goes to every task. One of over BROADCAST_ROWS rows is joined by shuffle, its rows repeated SALTS times,
    so that no task gets all rows of a hot key.
    """
    few = small.count() <= BROADCAST_ROWS
    names = {c: fresh(rows, f"key_{c}") for c in on}
    t = small.withColumnsRenamed(names)
    match = [rows[c].eqNullSafe(t[names[c]]) for c in on]
    if few:
        return rows.join(F.broadcast(t), match, "left").drop(*names.values())
    salt, own = fresh(rows, "salt"), fresh(rows, "own_salt")
    t = t.withColumn(own, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c, k in rows.dtypes if k in ("bigint", "int", "string", "double")]), F.lit(SALTS)).cast("int"))
    match = [left[c].eqNullSafe(t[names[c]]) for c in on] + [left[salt] == t[own]]
    return left.join(t, match, "left").drop(salt, own, *names.values())


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whichever task runs in it."""
    home = sys.modules.setdefault("_claimgraph_process_cache", types.ModuleType("_claimgraph_process_cache"))
    return home.__dict__.setdefault(name, {})


class Filling(dict):
    """A dict that computes what it lacks; emptied when it has grown past CACHE_ENTRIES."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()


class Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def process_filling(name: str, make: Callable) -> Filling:
    """The worker's one dict of this kind: a new name takes the place of what another operator left behind."""
    held = process_cache("fillings")
    if name not in held:
        held.clear()
        held[name] = Filling(make)
    held[name].trim()
    return held[name]


def spans(texts: list[str | None], step: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `step` characters each; a longer text makes a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > step:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def word_lists(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All words of the texts in lower case, and each text's number of words."""
    flat: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            counts[i] = len(w)
            flat += w
    return flat, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs with these lengths: one more than runs."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to a list of batches."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from step(b)

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of runs of values."""
    return pa.ListArray.from_arrays(pa.array(starts_of(counts).astype(np.int32)), pa.array(values, type=kind))
