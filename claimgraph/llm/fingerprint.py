"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .runtime import SALTS, arrow_map, cut, id_of, lists, process_filling, spans, starts_of, tables, word_lists

SHINGLE = 4
K = 128
#: Odd 61-bit multipliers, one for each word of a shingle.
MULTIPLIERS = (2042934207163219283, 1305921832765430917, 1877461932746181239, 1129341902746180453, 1734519028374610183, 1990283746152839467, 1402938475610293847, 2113948571029384751)
MIX = 1442695040888963407
#: Up to this number of items' hashes go to every worker; beyond that they are joined by shuffle, with equal results.
BROADCAST_HASHES = 4_000_000
TWO64 = float(2**64)


def word_hash(word: str) -> int:
    """The first eight bytes of the MD5, little end first."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside a text, and the number for each text; a shorter text is one shingle."""
    starts = starts_of(counts)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    left = np.repeat(starts[1:], counts) - np.arange(len(hashes))  # words from here to the text's end
    total = np.zeros(len(hashes), np.uint64)
    for i in range(n):
        part = padded[i : i + len(hashes)] * np.uint64(MULTIPLIERS[i])
        total += part if i == 0 else np.where(left > i, part, np.uint64(0))
    total ^= total >> np.uint64(32)
    total *= np.uint64(MIX)
    total ^= total >> np.uint64(29)
    first = np.zeros(len(hashes), bool)
    first[starts[:-1][counts > 0]] = True
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    return total[(left >= n) | first], made


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, in order."""
    if len(hashes) > 8 * k:
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def to_signed(h: np.ndarray) -> np.ndarray:
    """Order kept: the unsigned hash less 2**63."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def estimate_column(sketch, k: int):
    """Distinct shingles: the number held while fewer than k, else (k-1)/U of the k-th smallest, U in (0, 1]."""
    last = F.element_at(sketch, -1).cast("double") + F.lit(2.0**63) + F.lit(1.0)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit((k - 1) * TWO64) / last)


def merged(a, b, k: int):
    """The bottom-k sketch of the union of two sketches' sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance_column(a, b, k: int):
    """Share of the union's sketch that both sketches hold; 0 if either is empty."""
    union = merged(a, b, k)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)
    )


def containment_column(a, b, k: int):
    """Estimated share of a's set that b's set holds: of a's hashes up to b's largest kept one, those that b has.

    While b's sketch holds its whole set, all of a's hashes count. 0 where nothing can be compared.
    """
    reach = F.when(F.size(b) < k, F.lit(2**63 - 1)).otherwise(F.element_at(b, -1))
    within = F.filter(a, lambda x: x <= reach)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (F.size(within) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(within, b)) / F.size(within)
    )


def sketches(docs: DataFrame, id_column: str = "doc_id", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, sketch): the k smallest shingle hashes of each row's text, in order, as signed 64-bit numbers."""

    def step(b: pa.RecordBatch) -> list:
        ids, texts = b.column(0), b.column(1).to_pylist()
        out = []
        for lo, hi in spans(texts):
            known = process_filling("md5", word_hash)
            flat, counts = word_lists(texts[lo:hi])
            h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
            grams, made = shingle_hashes(h, counts, shingle)
            at = starts_of(made)
            kept = [bottom(grams[s:e], k) for s, e in zip(at[:-1], at[1:])]
            sizes = np.array([len(x) for x in kept], np.int64)
            values = to_signed(np.concatenate(kept)) if len(kept) else np.zeros(0, np.int64)
            out.append(pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists(values, sizes, pa.int64())], [id_column, "sketch"]))
        return out

    return arrow_map(docs.select(id_of(docs, id_column), "text"), step, f"{id_column} long, sketch array<long>")


def merge_sketches(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch for each key: equal to the sketch of all its texts together.

    A task merges the rows that it has of a key before anything is sent, so that what is sent of a key is k hashes for each
    task; these are merged in SALTS groups a key, and the groups' sketches then. Null and empty sketches add nothing; a
    key with no others has an empty sketch; null keys are a key; repeated rows change nothing; no rows, no result.
    """
    names = list(keys)

    def least(hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes)[:k]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in held], t) for i, t in enumerate(types)]
            rows = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.int64()))], [*names, "sketch"])
            held.clear()
            return rows

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(names))]
            for *key, s in zip(*(b.column(i).to_pylist() for i in range(len(names) + 1))):
                x = np.array(s or [], np.int64)
                was = held.get(tuple(key))
                held[tuple(key)] = least(x if was is None else np.concatenate([was, x]))
            if len(held) > 20_000:
                yield out()
        if held:
            yield out()

    rows = parts.select(*names, "sketch")
    schema = StructType([*[rows.schema[n] for n in names], StructField("sketch", ArrayType(LongType()))])
    rows = rows.mapInArrow(run, schema)
    salted = rows.repartition(*names, F.pmod(F.xxhash64("sketch"), F.lit(SALTS))).mapInArrow(run, schema)
    return salted.groupBy(*names).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch"))


def fingerprints(docs: DataFrame, against: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, sketch, distinct_shingles, resemblance, containment), one for each row of docs.

    resemblance and containment compare a document with the one merged sketch of all texts of `against` (k numbers,
    whatever the tables' sizes). Null, empty and wordless texts have an empty sketch, 0 shingles and 0 shares; a text
    shorter than a shingle is one shingle; a null doc_id stays null; repeated rows are answered each; other columns
    aren't read; an empty `against` has an empty sketch.
    """
    parts = sketches(against.select(F.lit(0).cast("long").alias("doc_id"), "text"), k=k, shingle=shingle)
    whole = [r["h"] for r in parts.select(F.explode("sketch").alias("h")).distinct().orderBy("h").limit(k).collect()]
    own = sketches(docs, k=k, shingle=shingle)
    s, w = F.col("sketch"), F.array(*map(F.lit, whole)).cast("array<long>")
    return own.select(
        "doc_id", "sketch", estimate_column(s, k).alias("distinct_shingles"),
        resemblance_column(s, w, k).alias("resemblance"), containment_column(s, w, k).alias("containment"),
    )


def shingle_sets(docs: DataFrame, id_column: str, shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, text_key, hashes): all distinct shingle hashes of each row's text, in order, as signed 64-bit numbers."""

    def step(b: pa.RecordBatch) -> list:
        ids, keys, texts = b.column(0), b.column(1), b.column(2).to_pylist()
        out = []
        for lo, hi in spans(texts):
            known = process_filling("md5", word_hash)
            flat, counts = word_lists(texts[lo:hi])
            h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
            grams, made = shingle_hashes(h, counts, shingle)
            at = starts_of(made)
            own = [np.unique(grams[s:e]) for s, e in zip(at[:-1], at[1:])]
            sizes = np.array([len(x) for x in own], np.int64)
            out.append(pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), lists(to_signed(np.concatenate(own)), sizes, pa.int64())], [id_column, "text_key", "hashes"]))
        return out

    return arrow_map(docs.select(id_of(docs, id_column), F.xxhash64("text"), "text"), step, f"{id_column} long, text_key long, hashes array<long>")


def fingerprint_pairs(docs: DataFrame, items: DataFrame, item_column: str = "item_id", k: int = K, shingle: int = SHINGLE, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Rows (doc_id, item_id, shared, resemblance, containment, item_containment) of each document and item that share
    a hash of the item's sketch.

    Each item (all rows of one item_column together, so that it may be a group) has a sketch of its own. All shingles of
    a document meet the sketches, not the document's k smallest only. shared: hashes of the item's sketch that the
    document has. item_containment: their share of the sketch; times the item's distinct shingles, an estimate of
    the intersection, from which come containment (over the document's shingles) and resemblance (over the union's). All
    are exact for items of at most k shingles. Pairs have no cap. Null, empty and wordless texts have no pairs; rows
    equal in doc_id and text are answered once; a null doc_id or item stays null.
    """
    with tables(docs.sparkSession) as keep:
        # An item may hold any share of all rows: its shingles are counted by hash first, its sketch is merged from its rows'.
        parts = shingle_sets(items, item_column, shingle)
        every = parts.select(F.col(item_column).alias("item_id"), F.explode("hashes").alias("h")).distinct()
        sizes = every.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
        kept = merge_sketches(sketches(items, item_column, k, shingle).withColumnRenamed(item_column, "item_id"), ["item_id"], k)
        kept = kept.withColumnRenamed("item_id", "own_id")
        wanted = sizes.join(kept, sizes["item_id"].eqNullSafe(kept["own_id"])).select("item_id", "n_item", F.size("sketch").alias("n_kept"), F.explode("sketch").alias("h"))
        wanted = keep(cut(wanted, "items"))
    own = shingle_sets(docs, "doc_id", shingle)
    rows = own.select("doc_id", "text_key", F.size("hashes").alias("n_doc"), F.explode("hashes").alias("h"))
    met = rows.join(F.broadcast(wanted) if wanted.count() <= broadcast_hashes else wanted.hint("merge"), "h")
    pairs = met.groupBy("doc_id", "text_key", "n_doc", "item_id", "n_item", "n_kept").agg(F.count_distinct("h").alias("shared"))
    both = F.least(F.col("shared") / F.col("n_kept") * F.col("n_item"), F.col("n_doc").cast("double"))
    return pairs.select(
        "doc_id", "item_id", "shared", (both / (F.col("n_doc") + F.col("n_item") - both)).alias("resemblance"),
        (both / F.col("n_doc")).alias("containment"), (F.col("shared") / F.col("n_kept")).alias("item_containment"),
    )


def fingerprint_sql(k: int = K, shingle: int = SHINGLE) -> str:
    """The same in DuckDB SQL, the sketch as text."""
    terms = " + ".join(f"(md5_number_upper(w[i + {j}])::UHUGEINT * {m}::UHUGEINT) % {2**64}::UHUGEINT" if j == 0 else f"CASE WHEN i + {j} <= len(w) THEN (md5_number_upper(w[i + {j}])::UHUGEINT * {m}::UHUGEINT) % {2**64}::UHUGEINT ELSE 0::UHUGEINT END" for j, m in enumerate(MULTIPLIERS[:shingle]))
    return f"""
    WITH x AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
        UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
    y AS (SELECT row_number() OVER () AS u, kind, r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+') AS w FROM x),
    z AS (SELECT u, kind, r, (({terms}) % {2**64}::UHUGEINT)::UBIGINT AS a FROM y, unnest(range(1, greatest(len(w) - {shingle - 1}, least(len(w), 1)) + 1)) AS q(i)),
    m1 AS (SELECT u, kind, r, ((xor(a, a >> 32)::UHUGEINT * {MIX}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT AS a FROM z),
    m AS (SELECT DISTINCT kind, r, (xor(a, a >> 29)::HUGEINT - {2**63}::HUGEINT)::BIGINT AS h FROM m1),
    s AS (SELECT kind, r, list(h ORDER BY h)[1:{k}] AS sk FROM m GROUP BY kind, r),
    b AS (SELECT coalesce((SELECT sk FROM s WHERE kind = 1), CAST([] AS BIGINT[])) AS w),
    d AS (SELECT y.doc_id, coalesce(s.sk, CAST([] AS BIGINT[])) AS a, b.w AS b FROM y LEFT JOIN s ON s.kind = 0 AND s.r = y.r, b WHERE y.kind = 0),
    e AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:{k}] AS un,
        CASE WHEN len(b) < {k} THEN a ELSE list_filter(a, lambda v: v <= b[len(b)]) END AS near FROM d)
    SELECT doc_id, array_to_string(a, ',') AS sketch,
      CASE WHEN len(a) < {k} THEN len(a)::DOUBLE ELSE {(k - 1) * TWO64}::DOUBLE / (a[{k}]::DOUBLE + {2.0**63}::DOUBLE + 1.0::DOUBLE) END AS distinct_shingles,
      CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_intersect(a, b), un))::DOUBLE / len(un) END AS resemblance,
      CASE WHEN len(a) = 0 OR len(b) = 0 OR len(near) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(near, b))::DOUBLE / len(near) END AS containment
    FROM e"""
