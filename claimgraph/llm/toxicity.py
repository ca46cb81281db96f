"""Toxic spans by a linear-chain conditional random field over words, with scores from forward-backward marginals."""

from __future__ import annotations

import hashlib
import math
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import WORD, Numbers, arrow_map, fresh, id_of, process_filling, spans, starts_of

#: The bound of the training sample: at most so many labelled documents with toxic = 1, and with toxic = 0.
TRAIN_TOXIC, TRAIN_CLEAN = 800, 1600
THRESHOLD = 0.5
PREFIXES = (3, 4, 5, 6, 7)
#: A word or prefix marks toxic words if chance would put all its contexts into toxic documents this rarely ...
CHANCE = 1e-7
#: ... and at most this share of them is in clean documents.
CLEAN_SHARE = 0.005
ROUNDS, RATE, SHRINK = 60, 0.5, 2e-7
#: Smaller weights count as 0 in the trained field: a word's odds change by a few percent at most.
LEAST_WEIGHT = 0.05
CLIP = 30.0


@dataclass
class Crf:
    """States 0 (clean) and 1 (toxic). weights: of features for state 1; steps: log potentials 0>1, 1>0, 1>1, start 1."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -CLIP
    steps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def key(self) -> str:
        return hashlib.sha256(repr((sorted(self.weights.items()), self.bias)).encode("utf-8", "surrogatepass")).hexdigest()


def features(word: str) -> list[str]:
    return ["=" + word, "$" + word[-3:], *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def word_lines(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All words, the number in each line (a chain of the field), and the number of lines in each text."""
    flat: list[str] = []
    lines: list[int] = []
    per_text = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            before = len(lines)
            for line in t.lower().split("\n"):
                w = WORD.findall(line)
                if w:
                    lines.append(len(w))
                    flat += w
            per_text[i] = len(lines) - before
    return flat, np.array(lines, np.int64), per_text


class Chains:
    """Positions of many chains in the order of their steps, so that one vector step advances all chains."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        first = starts_of(lengths)[:-1][self.order]
        alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        self.at = [first[:n] + t for t, n in enumerate(alive)]

    def odds(self, r: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of state 1 at each position; r: odds by the word alone."""
        a01, a10, a11, start = np.exp(steps)
        f, b = np.empty_like(r), np.ones_like(r)
        for t, at in enumerate(self.at):
            if t == 0:
                f[at] = r[at] * start
            else:
                p = f[at - 1]
                f[at] = r[at] * (a01 + p * a11) / (1 + p * a10)
        for t in range(len(self.at) - 1, 0, -1):
            at = self.at[t]
            q = r[at] * b[at]
            b[at - 1] = (a10 + q * a11) / (1 + q * a01)
        return f, b


def emissions(words: list[str], model: Crf) -> np.ndarray:
    known = process_filling("crf" + model.key(), lambda w: math.exp(min(CLIP, max(-CLIP, model.bias + sum(model.weights.get(x, 0.0) for x in features(w))))))
    return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def marginals(texts: list[str | None], model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word, and the number of words of each text."""
    flat, lengths, per_text = word_lines(texts)
    at = starts_of(lengths)[starts_of(per_text)]
    counts = np.diff(at)
    if not len(flat):
        return np.zeros(0), counts
    f, b = Chains(lengths).odds(emissions(flat, model), model.steps)
    odds = f * b
    return odds / (1 + odds), counts


def aggregate(p: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Document scores, and spans (first word, last word, highest marginal) of words with marginals from `least` up.

    A score is 1 - prod(1 - span) over the spans; without a span, the highest marginal; without words, 0.
    """
    at = starts_of(counts)
    scores = np.zeros(len(counts))
    has = counts > 0
    if len(p):
        scores[has] = np.maximum.reduceat(p, at[:-1][has])
    found: list[list[tuple[int, int, float]]] = [[] for _ in counts]
    hot = np.flatnonzero(p >= least)
    if len(hot):
        doc = np.searchsorted(at, hot, side="right") - 1
        cuts = np.flatnonzero((np.diff(hot) > 1) | (np.diff(doc) > 0)) + 1
        for run, d in zip(np.split(hot, cuts), doc[np.concatenate([[0], cuts])]):
            found[d].append((int(run[0] - at[d]), int(run[-1] - at[d]), float(p[run].max())))
        for d in np.unique(doc):
            scores[d] = 1 - math.prod(1 - x[2] for x in found[d])
    return scores, found


def score_texts(texts: list[str | None], model: Crf, least: float = THRESHOLD) -> tuple[np.ndarray, list]:
    scores, found = np.zeros(len(texts)), []
    for lo, hi in spans(texts):
        scores[lo:hi], own = aggregate(*marginals(texts[lo:hi], model), least)
        found += own
    return scores, found


def char_spans(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Word spans as character offsets of the text as given."""
    low = text.lower()
    words = [m.span() for m in WORD.finditer(low)]
    if len(low) != len(text):  # lower case of a few letters is longer
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        words = [(origin[s], origin[e - 1] + 1) for s, e in words]
    return [(words[a][0], words[b][1], p) for a, b, p in found]


@dataclass
class Tokens:
    """Words of training texts: distinct words, each position's word, chain lengths, whether a position's text is toxic."""

    words: list[str]
    ids: np.ndarray
    lengths: np.ndarray
    in_toxic: np.ndarray
    names: list[str]  # of features
    flat: np.ndarray  # features of all words, end to end
    sizes: np.ndarray  # their number for each word


def tokens_of(texts: list[str], toxic: list[bool]) -> Tokens:
    index, ids, lengths, sides = Numbers(), [], [], []
    for t, side in zip(texts, toxic):
        words, n, _ = word_lines([t])
        ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        lengths.append(n)
        sides.append(np.full(len(words), side))
    names, flat, sizes = Numbers(), array("i"), array("i")
    for w in index:
        own = features(w)
        sizes.append(len(own))
        flat.extend(names[x] for x in own)
    none = [np.zeros(0, np.int32)]
    return Tokens(list(index), np.concatenate(ids or none), np.concatenate(lengths or none), np.concatenate(sides or [np.zeros(0, bool)]), list(names), np.array(flat, np.int32), np.array(sizes, np.int32))


def token_labels(t: Tokens) -> np.ndarray:
    """Labels by distant supervision, one for each position.

    A whole word or a prefix marks toxic words if its distinct contexts (neighbours included, so copies of a text
    don't add up) lie in toxic documents too often for chance. Words so marked in toxic documents are labelled 1.
    """
    if not len(t.ids):
        return np.zeros(0)
    ids = t.ids.astype(np.int64)
    context = (ids * 0x9E3779B1 + np.roll(ids, 1) * 0x85EBCA77 + np.roll(ids, -1) * 0xC2B2AE3D) & ((1 << 38) - 1)
    key = context | (t.in_toxic.astype(np.int64) << 38)
    _, first = np.unique(key, return_index=True)
    hits = [np.bincount(ids[first][t.in_toxic[first] == side], minlength=len(t.words)) for side in (True, False)]
    share = hits[0].sum() / max(1, hits[0].sum() + hits[1].sum())
    least = math.log(1 / CHANCE) / math.log(1 / min(max(share, 1e-9), 0.999))
    a, b = (np.bincount(t.flat, weights=np.repeat(h, t.sizes), minlength=len(t.names)) for h in hits)
    ending = np.fromiter((x[0] == "$" for x in t.names), bool, len(t.names))
    marks = (a >= least) & (b <= CLEAN_SHARE * a) & ~ending
    marked = np.add.reduceat(marks[t.flat].astype(np.int64), starts_of(t.sizes)[:-1]) > 0
    return (marked[t.ids] & t.in_toxic).astype(float)


def gradient(t: Tokens, y: np.ndarray, chains: Chains, first: np.ndarray, pair: np.ndarray, seen: np.ndarray, w: np.ndarray, bias: float, steps: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the mean log likelihood of the labels, by feature weights, bias and steps: what is seen less what is expected."""
    r = np.exp(np.clip(bias + np.add.reduceat(w[t.flat], starts_of(t.sizes)[:-1]), -CLIP, CLIP))[t.ids]
    f, b = chains.odds(r, steps)
    p = f * b / (1 + f * b)
    a01, a10, a11 = np.exp(steps[:3])
    q, g = r[pair] * b[pair], f[pair - 1]
    z = 1 + a01 * q + g * a10 + g * a11 * q
    expected = np.array([(a01 * q / z).sum(), (g * a10 / z).sum(), (g * a11 * q / z).sum(), p[first].sum()])
    by_word = np.bincount(t.ids, weights=y - p, minlength=len(t.words)) / len(y)
    grad = np.bincount(t.flat, weights=np.repeat(by_word, t.sizes), minlength=len(t.names))
    return grad, float(by_word.sum()), (seen - expected) / len(y)


def train(texts: list[str], toxic: list[bool]) -> Crf:
    """Fit the field by gradient ascent on the conditional likelihood, all chains at once; the order of rows is no matter."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))
    t = tokens_of([texts[i] for i in order], [toxic[i] for i in order])
    y = token_labels(t)
    if not y.any():
        return Crf()
    chains = Chains(t.lengths)
    first = np.zeros(len(t.ids), bool)
    first[starts_of(t.lengths)[:-1]] = True
    pair = np.flatnonzero(~first)
    w, bias, steps = np.zeros(len(t.names)), math.log((y.sum() + 1) / (len(y) + 2)), np.zeros(4)
    gw, gb, gs = np.full(len(t.names), 1e-8), 1e-8, np.full(4, 1e-8)
    seen = np.array([(y[pair] * (1 - y[pair - 1])).sum(), ((1 - y[pair]) * y[pair - 1]).sum(), (y[pair] * y[pair - 1]).sum(), y[first].sum()])
    for _ in range(ROUNDS):
        grad, grad_b, grad_s = gradient(t, y, chains, first, pair, seen, w, bias, steps)
        grad = grad - SHRINK * w
        gw += grad**2
        w += RATE * grad / np.sqrt(gw)
        gb += grad_b**2
        bias += RATE * grad_b / math.sqrt(gb)
        gs += grad_s**2
        steps = np.clip(steps + 0.5 * RATE * grad_s / np.sqrt(gs), -5, 5)
    return Crf({t.names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > LEAST_WEIGHT)}, float(bias), tuple(float(x) for x in steps))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TRAIN_TOXIC, clean_rows: int = TRAIN_CLEAN) -> Crf:
    """Train on a bounded sample of labelled documents: those with the smallest hash of doc_id of each class.

    Labels that are null, contradict each other or have no document are passed over.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(id_of(labels)).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    picked = [
        one.where(F.col("hi") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", (F.col("hi") == 1).alias("side"))
        for side, n in ((1, toxic_rows), (0, clean_rows))
    ]
    sample = picked[0].unionByName(picked[1])
    rows = docs.select(id_of(docs), "text").join(F.broadcast(sample), "doc_id").where("text IS NOT NULL").select("text", "side").distinct().collect()
    return train([r[0] for r in rows], [r[1] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, toxic_score, is_toxic, spans), one for each row of docs.

    spans: array of (start_at, end_at, score) in characters, of runs of words whose marginal reaches `threshold`.
    Null, empty and wordless texts score 0 and have no spans; a null doc_id stays null; repeated rows are scored
    each; other columns aren't read; no rows, no result. Without usable toxic labels every score is near 0.
    Lines are chains of their own; texts count in full.
    """
    model = fit(docs, labels)

    def step(b: pa.RecordBatch) -> list:
        texts = b.column(1).to_pylist()
        scores, found = score_texts(texts, model, threshold)
        offsets = [[{"start_at": s, "end_at": e, "score": p} for s, e, p in char_spans(t, f)] if f else [] for t, f in zip(texts, found)]
        kind = pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32()), ("score", pa.float64())]))
        return [pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(scores >= threshold), pa.array(offsets, kind)], ["doc_id", "toxic_score", "is_toxic", "spans"])]

    return arrow_map(
        docs.select(id_of(docs), "text"), step,
        "doc_id long, toxic_score double, is_toxic boolean, spans array<struct<start_at: int, end_at: int, score: double>>",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that toxicity() finds toxic; all columns stay, as do null, empty and wordless texts.

    Rows with a null doc_id are judged too, repeated rows each; long texts count in full; no rows give no rows; columns
    that are named like the operator's own stay.
    """
    model = fit(docs, labels)

    @F.arrow_udf("double")
    def score(a: pa.Array) -> pa.Array:
        return pa.array(score_texts(a.to_pylist(), model, threshold)[0])

    name = fresh(docs, "toxic_score")
    return docs.withColumn(name, score("text")).where(F.col(name) < threshold).drop(name)
