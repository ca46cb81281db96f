"""Tables in the folder that a cluster's executors share: they cut the lineage of long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("claimgraph_tables", default=None)
_loose: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a local one will do for a local master only (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="claimgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/claimgraph/{name}-{uuid.uuid4().hex}"
    mine = _scope.get()
    (_loose if mine is None else mine).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df.cut_path)
    for held in (_scope.get(), _loose):
        if held and df.cut_path in held:
            held.remove(df.cut_path)


@contextmanager
def tables(spark: SparkSession):
    """A scope whose cut() tables are deleted at its end, but for those that are given to the function it yields.

    Those that are kept are the enclosing scope's; without one they stay until clear().
    """
    outer, mine, kept = _scope.get(), [], []
    token = _scope.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.cut_path)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scope.reset(token)
        (_loose if outer is None else outer).extend(kept)
        for path in set(mine) - set(kept):
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that returned results of this process still read; call it when all of them are written or done with."""
    while _loose:
        delete(spark, _loose.pop())


def hold(path: str) -> None:
    """Let clear() delete this folder too."""
    _loose.append(path)
