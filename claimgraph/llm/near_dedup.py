"""Near-duplicate groups: chosen-path set similarity join over minhash positions of word-shingle sets.

Every tree starts with all texts in its root. A node picks BRANCHES positions; a text goes to the child named by the
position and its minwise token there. Children of at most WIDE texts are sent to a task, which branches them on until
LEAF texts are left, and compares those exhaustively by their sketches; wider ones branch by shuffle. Trees are
independent, and as many as the target recall takes. Pairs that look similar are then held against each other by
their whole shingle sets, so that every link is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Numbers, arrow_map, cut, drop_cut, fresh, id_of, process_filling, spans, starts_of, tables, word_lists

THRESHOLD = 0.5
#: Share of the pairs at the threshold itself that the trees are to bring together; pairs above it meet more often.
RECALL = 0.98
SHINGLE = 3
POSITIONS = 96
BRANCHES = 2
#: Levels that the number of trees is reckoned for.
LEVELS = 3
#: Texts of a node that one task takes, and of a node that is compared exhaustively.
WIDE, LEAF = 5000, 500
#: Levels that branch by shuffle, and inside a task; what is left then is compared all the same.
DEPTH, INNER = 12, 6
#: A node whose texts agree in this share of positions on average can't be taken apart, and needn't: one of them links most.
DENSE = 0.7
#: Pairs with estimates so far under the threshold aren't looked at: three standard errors.
MARGIN = 3 * (0.25 / POSITIONS) ** 0.5
#: Texts that one task holds against a text that they may all be copies of.
STAR = 2000
BROADCAST_ROWS = 2_000_000
UNIT = ("doc_id", "text_key")

_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of n words of each text, end to end, and their numbers.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    known = process_filling("xxh3", word_hash)
    flat, counts = word_lists(texts)
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    if not len(h):
        return h, counts
    ends = starts_of(counts)[1:]
    left = np.repeat(ends, counts) - np.arange(len(h))
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = h * _M[0]
    for i in range(1, n):
        total += np.where(left > i, padded[i : i + len(h)] * _M[i % 3] * np.uint64(2 * i + 1), np.uint64(0))
    keep = left >= n
    keep[(ends - counts)[counts > 0]] = True
    row = np.repeat(np.arange(len(counts)), counts)[keep]
    grams = mixed(total)[keep]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.bincount(row[new], minlength=len(counts))


def permutations(t: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**32, t, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, t, dtype=np.uint32)


def minhashes(grams: np.ndarray, counts: np.ndarray, t: int = POSITIONS) -> np.ndarray:
    """One row of t minwise values for each set; no row for an empty set."""
    a, b = permutations(t)
    starts = starts_of(counts[counts > 0])[:-1]
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), t), np.uint32)
    if len(starts):
        for i in range(t):
            x = low * a[i]
            x += b[i]
            x ^= high
            x *= np.uint32(0x85EBCA6B)
            out[:, i] = np.minimum.reduceat(x, starts)
    return out


def trees(threshold: float, recall: float) -> int:
    """Independent trees that bring a pair at the threshold together with this probability.

    The nodes that both texts of the pair are in are a branching process: a child of such a node is one of them with
    the probability `threshold`.
    """
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold and recall are shares")
    q = 1.0
    for _ in range(LEVELS):
        q = 1 - (1 - threshold * q) ** BRANCHES
    n = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(q, 1 - 1e-12))))
    if n * BRANCHES > POSITIONS:
        raise ValueError(f"{n} trees are needed for this recall, {POSITIONS // BRANCHES} are possible")
    return n


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, set_a, set_b, sketch, short): a hash of the text, a 128-bit hash of its whole shingle set, its
    minwise values, their low bytes.

    Rows without doc_id or without a word have no signature.
    """

    def step(b: pa.RecordBatch) -> list:
        ids, keys, texts = b.column(0), b.column(1), b.column(2).to_pylist()
        out = []
        for lo, hi in spans(texts):
            grams, counts = shingle_sets(texts[lo:hi])
            mins = minhashes(grams, counts)
            has = counts > 0
            at = starts_of(counts)
            sets = [xxhash.xxh3_128_intdigest(grams[s:e].tobytes()) for s, e in zip(at[:-1][has], at[1:][has])]
            high = np.array([k >> 64 for k in sets], np.uint64).view(np.int64)
            low = np.array([k & (2**64 - 1) for k in sets], np.uint64).view(np.int64)
            sketch = pa.array([r.tobytes() for r in mins.astype(">u4")], pa.binary())
            short = pa.array([r.tobytes() for r in mins.astype(np.uint8)], pa.binary())
            own = [c.slice(lo, hi - lo).filter(pa.array(has)) for c in (ids, keys)]
            out.append(pa.RecordBatch.from_arrays([*own, pa.array(high), pa.array(low), sketch, short], [*UNIT, "set_a", "set_b", "sketch", "short"]))
        return out

    rows = docs.select(id_of(docs), F.xxhash64("text").alias("text_key"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return arrow_map(rows, step, "doc_id long, text_key long, set_a long, set_b long, sketch binary, short binary")


def token(sketch, at):
    return F.substring(sketch, at * 4 + 1, F.lit(4))


def roots(sketch, n: int) -> list:
    """Paths of the children of n roots; no two of them look at the same position."""
    order = np.random.default_rng(71).permutation(POSITIONS)[: n * BRANCHES]
    return [F.xxhash64(F.lit(int(p)), token(sketch, F.lit(int(p)))) for p in order]


def children(path, sketch) -> list:
    """Paths of the children that a text goes to from the node at `path`."""
    first = F.pmod(F.xxhash64(path, F.lit("first")), F.lit(POSITIONS))
    step = F.pmod(F.xxhash64(path, F.lit("step")), F.lit(POSITIONS // BRANCHES - 1)) + 1
    out = []
    for j in range(BRANCHES):
        at = (F.pmod(first + step * j, F.lit(POSITIONS))).cast("int")
        out.append(F.xxhash64(path, at, token(sketch, at)))
    return out


def sized(rows: DataFrame) -> DataFrame:
    """rows (path, ...) in nodes of two texts at least, with n, their number; counted before rows meet."""
    n = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(n, "path")


def memberships(reps: DataFrame, n_trees: int) -> DataFrame:
    """(path, doc_id, text_key): nodes of at most about WIDE texts each, over all trees. reps: (doc_id, text_key, sketch).

    Only nodes and texts' keys are sent around while nodes are counted; the sketch goes along where a text branches
    again. A node that stays over WIDE although its texts are much alike, or to the end, is cut into blocks, and each
    pair of blocks is a node: all its pairs of texts still meet.
    """
    frontier = reps.select(*UNIT, F.explode(F.array(*roots(F.col("sketch"), n_trees))).alias("path"), F.lit(None).cast("long").alias("parent"))
    done, used = None, []
    for depth in range(DEPTH + 1):
        level = cut(sized(frontier), "nodes")
        used.append(level)
        narrow = level.where(F.col("n") <= WIDE).select("path", *UNIT)
        done = narrow if done is None else done.unionByName(narrow)
        wide = level.where(F.col("n") > WIDE)
        if wide.isEmpty():
            break
        stuck = F.lit(True) if depth == DEPTH else F.coalesce(F.col("n") > DENSE * F.col("parent"), F.lit(False))
        blocks = F.ceil(F.col("n") / (WIDE // 2)).cast("int")
        own = F.pmod(F.xxhash64(*UNIT), blocks).cast("int")
        pairs = wide.where(stuck).withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}).where("own <> other")
        done = done.unionByName(pairs.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), *UNIT))
        nodes = wide.where(~stuck).groupBy(*UNIT).agg(F.collect_list(F.struct("path", "n")).alias("nodes"))  # a text is in a few nodes of each tree
        below = F.flatten(F.transform("nodes", lambda x: F.array(*[F.struct(c.alias("path"), x["n"].alias("parent")) for c in children(x["path"], F.col("sketch"))])))
        frontier = reps.join(nodes, list(UNIT)).select(*UNIT, F.explode(below).alias("c")).select(*UNIT, "c.path", "c.parent")
    out = cut(done, "members")
    for u in used:
        drop_cut(u)
    return out


def inner_leaves(s: np.ndarray, rows: np.ndarray, key: int, depth: int = 0) -> list[np.ndarray]:
    """Rows of each leaf below a node that one task holds; s: the low bytes of their minwise values."""
    n = len(rows)
    if n <= LEAF or depth == INNER:
        return [rows]
    pairs = np.random.default_rng(abs(key)).integers(0, n, (2, 256))
    if np.mean(s[rows[pairs[0]]] == s[rows[pairs[1]]]) > DENSE:
        return [rows]
    out = []
    for j in range(BRANCHES):
        at = xxhash.xxh3_64_intdigest(f"{key} {depth} {j}") % POSITIONS
        v = s[rows, at]
        order = np.argsort(v, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(v[order])) + 1):
            if len(part) > 1:
                out += inner_leaves(s, rows[np.sort(part)], (key * 31 + at * 257 + int(v[part[0]])) % (1 << 61), depth + 1)
    return out


def similar_in_leaf(s: np.ndarray, low: float, high: float) -> tuple[list, np.ndarray]:
    """Links inside a leaf as pairs of row numbers, and the rows that have a partner with an estimate from `low` up.

    Estimates from `high` up join rows into parts, by one link for each row; a row is compared with every row that isn't
    in its part yet.
    """
    n, t = s.shape
    near = np.zeros(n, bool)
    rest, held = np.arange(n), s
    links = []
    while len(rest):
        queue, rest, held = [rest[0]], rest[1:], held[1:]
        while queue and len(rest):
            i = queue.pop()
            e = np.count_nonzero(held == s[i], axis=1) / t
            maybe = e >= low
            if maybe.any():
                near[i] = True
                near[rest[maybe]] = True
                hit = e >= high
                if hit.any():
                    new = rest[hit]
                    links += [(i, j) for j in new]
                    queue += list(new)
                    rest, held = rest[~hit], held[~hit]
    return links, near


def nodes_in(batches, of):
    """of(path, columns) for each run of equal paths in batches whose first column is the path, clustered and sorted."""
    held: list[pa.RecordBatch] = []  # the node that the next batch may go on with

    def done() -> list:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        path = t.column(0).to_numpy()
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]]))
        return of(path, sizes, t)

    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column(0).to_numpy()
        if held and path[0] == held[-1].column(0)[-1].as_py():
            first = int(np.searchsorted(path, path[0], side="right"))
            held.append(batch.slice(0, first))
            if first == len(path):
                continue
            yield from done()
            batch, path = batch.slice(first), path[first:]
        elif held:
            yield from done()
        last = int(np.searchsorted(path, path[-1]))
        if last:
            held.append(batch.slice(0, last))
            yield from done()
        held.append(batch.slice(last))
    if held:
        yield from done()


def bytes_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def compared_nodes(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Links (doc_id, text_key, other_id, other_key), and (doc_id, text_key, path) of each text that has a partner in a node,
    from rows (path, doc_id, text_key, short) that are clustered and sorted by path.

    Neither is as many as pairs: of a text's links in a leaf one is named, and texts are marked, not pairs.
    """

    def of(path: np.ndarray, sizes: np.ndarray, t: pa.Table) -> list:
        s, at = bytes_of(t.column(3)), starts_of(sizes)
        a, b, near = [], [], np.zeros(len(path), bool)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 24)]):
            first = at[:-1][sizes == size]
            j, i = np.tril_indices(size, -1)  # ordered by j, then i
            for few in np.array_split(first, max(1, len(first) * len(i) // 50_000)):
                x, y = (few[:, None] + i).ravel(), (few[:, None] + j).ravel()
                e = np.count_nonzero(s[x] == s[y], axis=1) / s.shape[1]
                near[x[e >= low]] = near[y[e >= low]] = True
                x, y = x[e >= high], y[e >= high]
                y, least = np.unique(y, return_index=True)
                a.append(x[least])
                b.append(y)
        for k in np.flatnonzero(sizes > 24):
            own = s[at[k] : at[k + 1]]
            for leaf in inner_leaves(own, np.arange(len(own)), int(path[at[k]])):
                links, some = similar_in_leaf(own[leaf], low, high)
                near[at[k] + leaf[some]] = True
                if links:
                    p = np.array(links)
                    a.append(at[k] + leaf[p[:, 0]])
                    b.append(at[k] + leaf[p[:, 1]])
        ids, keys = t.column(1).to_numpy(), t.column(2).to_numpy()
        out = []
        names = [*UNIT, "other_id", "other_key", "path"]
        if a and (n := sum(map(len, a))):
            x, y = np.concatenate(a), np.concatenate(b)
            out.append(pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[y], keys[y], ids[x], keys[x])] + [pa.nulls(n, pa.int64())], names))
        if near.any():
            none = pa.nulls(int(near.sum()), pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(keys[near]), none, none, pa.array(path[near])], names))
        return out

    given = rows.select("path", *UNIT, "short")
    return given.mapInArrow(lambda batches: nodes_in(batches, of), "doc_id long, text_key long, other_id long, other_key long, path long")


def candidates(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """What compared_nodes() finds over all trees; reps: (doc_id, text_key, sketch, short)."""
    members = memberships(reps, trees(threshold, recall))
    rows = members.join(reps.select(*UNIT, "short"), list(UNIT)).repartition("path").sortWithinPartitions("path", *UNIT)
    out = cut(compared_nodes(rows, threshold - MARGIN, threshold), "links")
    drop_cut(members)
    return out


def shingles_of(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, text_key, grams): the shingle sets of these texts, as the 32 low bits of their hashes; one row for each."""

    def step(b: pa.RecordBatch) -> list:
        texts = b.column(2).to_pylist()
        out = []
        for lo, hi in spans(texts):
            grams, counts = shingle_sets(texts[lo:hi])
            at, few = starts_of(counts), grams.astype(np.uint32)
            sets = pa.array([np.unique(few[s:e]).tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())
            out.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), sets], [*UNIT, "grams"]))
        return out

    wanted = cut(units.select(*UNIT).distinct(), "wanted")
    rows = docs.select(id_of(docs), F.xxhash64("text").alias("text_key"), "text").where("text IS NOT NULL")
    rows = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, list(UNIT), "left_semi")
    sets = arrow_map(rows, step, "doc_id long, text_key long, grams binary")
    return sets.groupBy(*UNIT).agg(F.first("grams").alias("grams"))


def exact_stars(sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """The links (doc_id, text_key, other_id, other_key) whose sets have at least this Jaccard similarity.

    The set of a text goes once to each of its links, that of the other end once to each STAR links that it has.
    """
    n = links.groupBy("other_id", "other_key").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("chunks"))
    ends = links.join(n, ["other_id", "other_key"]).withColumn("chunk", F.pmod(F.xxhash64(*UNIT), F.col("chunks")).cast("int"))
    ends = ends.join(sets, list(UNIT)).select("other_id", "other_key", "chunk", F.lit(1).alias("role"), *UNIT, "grams")
    centres = n.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    centres = centres.join(sets.withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"}), ["other_id", "other_key"])
    centres = centres.select("other_id", "other_key", "chunk", F.lit(0).alias("role"), F.col("other_id").alias("doc_id"), F.col("other_key").alias("text_key"), "grams")
    rows = centres.unionByName(ends).repartition("other_id", "other_key", "chunk").sortWithinPartitions("other_id", "other_key", "chunk", "role")

    def run(batches):
        whose, centre = None, None
        for b in batches:
            out = []
            for a, k, role, i, j, grams in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6))):
                g = np.frombuffer(grams, np.uint32)
                if role == 0:
                    whose, centre = (a, k), g
                    continue
                if whose != (a, k):
                    raise ValueError("a link's end has no set")
                n, m = len(g), len(centre)
                if min(n, m) >= threshold * max(n, m):
                    shared = len(np.intersect1d(g, centre, assume_unique=True))
                    if shared >= threshold * (n + m - shared):
                        out.append((i, j, a, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [*UNIT, "other_id", "other_key"])

    return rows.mapInArrow(run, "doc_id long, text_key long, other_id long, other_key long")


def exact_nodes(sets: DataFrame, members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(p, q): parts that a pair with this Jaccard similarity of shingle sets links; members: (path, doc_id, text_key, part).

    A text's set is sent once to each node, where texts of different parts are compared until they are linked.
    """
    low = threshold - MARGIN

    def of(path: np.ndarray, sizes: np.ndarray, t: pa.Table) -> list:
        s, at = bytes_of(t.column(3)), starts_of(sizes)
        parts = list(zip(t.column(1).to_pylist(), t.column(2).to_pylist()))
        linked = []
        for x, y in zip(at[:-1], at[1:]):
            names = Numbers()
            own = np.array([names[p] for p in parts[x:y]])  # changes as parts are linked
            grams = [np.frombuffer(g, np.uint32) for g in t.column(4).slice(x, y - x).to_pylist()]
            n = np.array([len(g) for g in grams])
            start = starts_of(n)
            code = np.unique(np.concatenate(grams), return_inverse=True)[1]
            held = np.zeros(code.max() + 1, bool)
            largest = np.bincount(own).argmax()
            for i in np.flatnonzero(own != largest):
                other = np.flatnonzero(own != own[i])
                if not len(other):
                    break
                other = other[np.count_nonzero(s[x + other] == s[x + i], axis=1) / POSITIONS >= low]
                other = other[np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i])]
                if not len(other):
                    continue
                mine = code[start[i] : start[i + 1]]
                held[mine] = True
                if len(other) > 64:
                    shared = np.add.reduceat(held[code].astype(np.int64), start[:-1])[other]
                else:
                    shared = np.array([np.count_nonzero(held[code[start[j] : start[j + 1]]]) for j in other])
                held[mine] = False
                for j in other[shared >= threshold * (n[other] + n[i] - shared)]:
                    if own[i] != own[j]:
                        linked.append((parts[x + i], parts[x + j]))
                        own[own == own[j]] = own[i]
        if not linked:
            return []
        cols = zip(*[(*p, *q) for p, q in linked])
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["p_id", "p_key", "q_id", "q_key"])]

    rows = members.join(reps.select(*UNIT, "short"), list(UNIT)).join(sets, list(UNIT))
    rows = rows.select("path", F.col("part.doc_id").alias("part_id"), F.col("part.text_key").alias("part_key"), "short", "grams").repartition("path").sortWithinPartitions("path", "part_id", "part_key")
    found = rows.mapInArrow(lambda batches: nodes_in(batches, of), "p_id long, p_key long, q_id long, q_key long")
    return found.select(unit("p_id", "p_key").alias("a"), unit("q_id", "q_key").alias("b")).distinct()


def unit(doc_id: str, text_key: str):
    """One text of a document as a value with an order: by doc_id first."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(text_key).alias("text_key"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but roots of the edges (a, b): root is the smallest node that it is connected with.

    Alternating large-star and small-star steps, until they change nothing.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", low).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small, "edges")
        drop_cut(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.cut_path = e.cut_path
            return out
        before = tuple(now)


def grouped(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, root) of texts, each as (doc_id, text_key), that another one makes superfluous; a table in the shared folder."""
    with tables(docs.sparkSession) as keep:
        sig = cut(signatures(docs), "signatures")
        first = sig.groupBy("set_a", "set_b").agg(F.min(unit(*UNIT)).alias("rep"))
        mapped = sig.select("set_a", "set_b", unit(*UNIT).alias("u")).join(first, ["set_a", "set_b"]).where("u <> rep")
        same = cut(mapped.select(F.col("u").alias("a"), F.col("rep").alias("b")).distinct(), "same")
        reps = sig.join(same.select("a.*"), list(UNIT), "left_anti").dropDuplicates(list(UNIT)).select(*UNIT, "sketch", "short")
        reps = cut(reps, "sets")
        drop_cut(sig)
        found = candidates(reps, threshold, recall)
        likely = found.where("path IS NULL").groupBy(*UNIT).agg(F.min(unit("other_id", "other_key")).alias("o")).select(*UNIT, F.col("o.doc_id").alias("other_id"), F.col("o.text_key").alias("other_key"))
        likely = cut(likely, "likely")
        ends = likely.select(*UNIT).unionByName(likely.select(F.col("other_id").alias("doc_id"), F.col("other_key").alias("text_key")))
        sure = exact_stars(cut(shingles_of(docs, ends), "shingles"), likely, threshold)  # read for both ends of a link
        parts = components(sure.select(unit(*UNIT).alias("a"), unit("other_id", "other_key").alias("b")).unionByName(same))
        doubtful = cut(between_parts(found.where("path IS NOT NULL").select("path", *UNIT), parts), "doubtful")
        if not doubtful.isEmpty():
            more = components(exact_nodes(shingles_of(docs, doubtful), doubtful, reps, threshold))
            parts = cut(joined_parts(parts, more), "groups")
        return keep(parts)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, keeper_id): every document that another one makes superfluous, with the one to keep.

    Texts are grouped by being connected through pairs whose sets of word trigrams (lower case; a shorter text is
    one shingle) have a Jaccard similarity of at least `threshold`; every link is verified on whole sets. `recall` is the
    share of pairs at the threshold that the trees bring together. The document with the smallest doc_id of a group is
    kept and has no row. A doc_id on several rows stands for several texts, each of which is in a group of its own
    accord: it has a row for each keeper that its superfluous texts have, other than itself. Rows with a null doc_id,
    and null, empty and wordless texts, are in no group. Other columns aren't read. Long texts count in full. No rows
    give no rows; ties don't arise, as a keeper is smallest by doc_id, then by a hash of the text.
    """
    rows = grouped(docs, threshold, recall)
    return rows.select(F.col("node.doc_id").alias("doc_id"), F.col("root.doc_id").alias("keeper_id")).where("doc_id <> keeper_id").distinct()


def between_parts(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, doc_id, text_key, part) in nodes of two parts at least; pairs inside a part can't change any group.

    A node has WIDE texts at most, so a window over it is bounded.
    """
    own = members.withColumn("node", unit(*UNIT)).join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    node = Window.partitionBy("path")
    mixed_nodes = own.withColumns({"lo": F.min("part").over(node), "hi": F.max("part").over(node)}).where("lo <> hi")
    return mixed_nodes.select("path", *UNIT, "part")


def joined_parts(parts: DataFrame, over: DataFrame) -> DataFrame:
    """(node, root) after linking parts as `over` says; a text that was in no part is one of its own."""
    up = over.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    low = parts.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return low.unionByName(over.select("node", "root"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs without the texts that near_duplicates() finds superfluous; of repeated rows one stays.

    Rows go by doc_id and text: another text of the same doc_id stays if nothing makes it superfluous. Rows that agree in
    both are repeated rows; the one that stays is the least by its other columns as JSON, which may be of any type.
    Rows with a null doc_id stay, as do null, empty and wordless texts (repeated ones once for each doc_id). All columns
    stay; no rows give no rows.
    """
    with tables(docs.sparkSession) as keep:
        gone = keep(cut(grouped(docs, threshold, recall).select("node.*"), "gone"))
        few = gone.count() <= BROADCAST_ROWS
        i, k = fresh(docs, "near_id"), fresh(docs, "near_key")
        gone = gone.withColumnsRenamed({"doc_id": i, "text_key": k})
        keyed = docs.withColumns({i: id_of(docs), k: F.xxhash64("text")})
        kept = keyed.join(F.broadcast(gone) if few else gone, [i, k], "left_anti")
        # Repeated rows: counted by key with map-side sums; of such keys the least row is kept, by map-side minima too.
        twice = cut(kept.where(F.col(i).isNotNull()).groupBy(i, k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(i, k), "repeated")
        if twice.isEmpty():
            return kept.drop(i, k)
        keep(twice)
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        order = F.to_json(F.struct(*rest)) if rest else F.lit(0)
        one = kept.join(twice, [i, k], "left_semi").groupBy(i, k).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
        return kept.join(twice, [i, k], "left_anti").drop(i, k).unionByName(one)
