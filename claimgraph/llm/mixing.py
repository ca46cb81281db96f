"""Mixing sources to target weights: pivotal dependent rounding of copy numbers, over a distributed reduction tree."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, fresh, id_of, looked_up, tables

#: Target weight of a source: its number of documents to this power.
TEMPERATURE = 0.9
#: Least expected number of copies over all sources, which is the largest one's; the total follows from it. Over 1, so that
#: no document is left out, and not a whole number, so that the largest source is rounded too.
LEAST = 1.25
SEED = 11
#: Fractions are whole numbers of this unit, so that mass moves without rounding errors.
UNIT = 1 << 40
#: Documents of a leaf of the tree, and children of an inner node.
LEAF, FAN = 4096, 64


def draw(*key) -> int:
    """A number from 0 to 2**64 - 1, by hash of the key."""
    return xxhash.xxh3_64_intdigest(repr(key).encode("utf-8", "surrogatepass"))


def pivotal(items: list[tuple[object, int]], key: tuple) -> tuple[dict, tuple[object, int] | None]:
    """Pair fractions (in UNITs) one after the other until each but one at most is 0 or UNIT.

    Of a pair with a + b <= 1, one gets 0 and the other a + b, which wins with probability in proportion to its
    share; else one gets 1 and the other a + b - 1. Expectations stay as they are. Returns decisions 0 or 1 by item,
    and the item left with its fraction.
    """
    done: dict = {}
    held: tuple[object, int] | None = None
    for n, (item, p) in enumerate(items):
        if p in (0, UNIT):
            done[item] = p // UNIT
            continue
        if held is None:
            held = item, p
            continue
        a, b = held[1], p
        u = draw(*key, n)
        if a + b <= UNIT:
            first = u * (a + b) < a << 64
            done[item if first else held[0]] = 0
            held = (held[0] if first else item), a + b
        else:
            first = u * (2 * UNIT - a - b) < (UNIT - b) << 64  # the first of the pair becomes 1
            done[held[0] if first else item] = 1
            held = (item if first else held[0]), a + b - UNIT
        if held[1] in (0, UNIT):
            done[held[0]] = held[1] // UNIT
            held = None
    return done, held


def target_copies(counts: DataFrame, weights: dict[str, float] | None, temperature: float, least: float) -> DataFrame:
    """(source, whole, fraction): the expected copies of each document of a source. counts: (source, n).

    weights: target weights by source (sources that it lacks get none), else n to the power of `temperature`. Copies of
    source s are in proportion to weight/n; the total is set so that the source with the fewest gets `least` each.
    """
    if weights is None:
        w = F.pow("n", F.lit(temperature))
    else:
        w = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in sorted(weights.items(), key=repr)], F.lit(0.0))
    raw = counts.withColumn("x", w / F.col("n"))
    low = raw.where("x > 0").agg(F.min("x")).first()[0] or 1.0
    copies = F.col("x") / F.lit(low) * F.lit(least)
    whole = F.floor(copies)
    out = raw.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    part = F.coalesce(F.round((copies - whole) * F.lit(float(UNIT))), F.lit(0.0)).cast("long")
    return out.select("source", "whole", part.alias("fraction"), "n")


def mix_counts(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, least: float = LEAST, seed: int = SEED
) -> DataFrame:
    """Rows (doc_id, source, copies): how often each document goes into the mix; one row for each pair of ids.

    The copies of a source add up to the expected number, rounded up or down; a document's copies are its source's
    expected copies rounded up or down, up with the probability of the fraction. The result depends on seed, the ids
    and the table's counts, not on partitions. Rows that repeat a (doc_id, source) are one document and share its
    copies. A null source is a source of its own, a null doc_id a document of its source. No rows, no result. Other
    columns, text included, aren't read.
    """
    with tables(docs.sparkSession) as keep:
        units = cut(docs.select(id_of(docs), "source").distinct(), "units")
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        share = cut(target_copies(counts, weights, temperature, least), "targets")
        # A leaf holds about LEAF documents of one source; as many levels above as the largest source takes to end in one node.
        deep = share.agg(F.max("n")).first()[0] or 1
        levels = 0
        while deep > LEAF * FAN**levels:
            levels += 1
        h = F.xxhash64("doc_id", F.lit(seed))
        node = F.pmod(h, F.ceil(F.col("n") / LEAF)).cast("long")
        rows = looked_up(units, share, ["source"]).select("source", node.alias("node"), "doc_id", F.col("fraction").alias("p"), h.alias("h"))
        decided = None
        for level in range(levels + 1):
            step = cut(rows.groupBy("source", "node").applyInArrow(settler(seed, level, level == levels), "source string, node long, doc_id long, p long, done int"), "level")
            some = step.where("done >= 0").select("source", "doc_id", "done")
            decided = some if decided is None else decided.unionByName(some)
            rows = step.where("done < 0").select("source", "node", "doc_id", "p", h.alias("h"))
        out = looked_up(decided, share, ["source"]).select("doc_id", "source", (F.col("whole") + F.col("done")).alias("copies"))
        return keep(cut(out, "copies"))


def settler(seed: int, level: int, root: bool):
    """Pivotal rounding of one node's documents; what is left goes to the node above, at the root it is drawn."""

    def settle(t: pa.Table) -> pa.Table:
        source, at = t.column("source")[0].as_py(), t.column("node")[0].as_py()
        rows = sorted(zip(t.column("h").to_pylist(), t.column("doc_id").to_pylist(), t.column("p").to_pylist()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        done, held = pivotal([(i, p) for _, i, p in rows], (seed, source, level, at))
        if held is not None and root:
            done[held[0]] = int(draw(seed, source, "root") * UNIT < held[1] << 64)
            held = None
        out = [(i, UNIT * d, d) for i, d in done.items()] + ([(held[0], held[1], -1)] if held else [])
        i, p, d = zip(*out)
        return pa.table({"source": pa.array([source] * len(out), pa.string()), "node": pa.array([at // FAN] * len(out), pa.int64()), "doc_id": pa.array(i, pa.int64()), "p": pa.array(p, pa.int64()), "done": pa.array(d, pa.int32())})

    return settle


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as mix_counts() says; all columns stay. No copies, no row.

    Nulls are as there: a null source is a source, a null doc_id a document of its source. Repeated rows are each repeated.
    Texts, empty and long ones too, aren't read. No rows give no rows. Columns that are named like the operator's own stay.
    """
    n, i, id_, source = fresh(docs, "copies"), fresh(docs, "copy"), fresh(docs, "mix_id"), fresh(docs, "mix_source")
    counts = mix_counts(docs, **options).withColumnsRenamed({"doc_id": id_, "source": source, "copies": n})
    on = docs["doc_id"].cast("long").eqNullSafe(counts[id_]) & docs["source"].eqNullSafe(counts[source])
    rows = docs.join(counts.hint("merge"), on).drop(id_, source)  # a row for each document: it has no bound, so it is never broadcast
    return rows.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n, i)
