"""SentencePiece sampling: forward filtering, backward sampling over the lattice of pieces; decoding without loss."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Numbers, arrow_map, id_of, lists, spans, starts_of

SEED = 17
#: Characters whose lattices are in memory at once, however long a text is.
LATTICE_CHARS = 800_000
ALPHA = 1.0
#: No piece reaches over these cuts: a space only starts a piece, and no piece has a line feed.
SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Nor over these: a lattice has LONGEST spaces and LONGEST other characters at most.
LONGEST = 4096
BOUNDED = re.compile(rf" {{1,{LONGEST}}}[^ \n]{{0,{LONGEST}}}|[^ \n]{{1,{LONGEST}}}|\n")
BASE = np.uint64(0x9E3779B97F4A7C15)
GOLDEN = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Vocabulary:
    """Pieces by id, spaces in place of the space sign; b"" for control pieces. bytes_at: id of byte 0."""

    pieces: list[bytes]
    words: dict[str, int]
    logp: np.ndarray
    bytes_at: int
    tables: list[tuple[np.ndarray, np.ndarray]]
    byte_logp: float


def load_vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """Read a .model file. Its scores are ranks of merges; a piece of rank r gets probability ~ 1/(r + 2.7)**alpha."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, words, logp, bytes_at = [], {}, np.zeros(sp.get_piece_size()), -1
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(text[3:5], 16)
            bytes_at = i if value == 0 else bytes_at
            pieces.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            plain = text.replace("▁", " ")
            if " " in plain.lstrip(" ") or "\n" in plain:
                raise ValueError(f"piece {text!r} reaches over a cut")
            words[plain] = i
            pieces.append(plain.encode())
            logp[i] = -alpha * np.log(2.7 - sp.get_score(i))
    if bytes_at < 0:
        raise ValueError("the vocabulary has no byte pieces")
    return Vocabulary(pieces, words, logp, bytes_at, prefix_tables(words), float(logp.min()) - 2.0)


def prefix_tables(words: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: sorted hashes of all prefixes of pieces of that length, and the piece's id or -1."""
    by: list[dict[int, int]] = []
    for w, i in words.items():
        h = 0
        for n, c in enumerate(w):
            h = (h * int(BASE) + ord(c) + 1) % 2**64
            if n == len(by):
                by.append({})
            by[n].setdefault(h, -1)
        by[len(w) - 1][h] = i
    out = []
    for d in by:
        keys = np.array(sorted(d), np.uint64)
        out.append((keys, np.array([d[int(k)] for k in keys], np.int64)))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Lattice:
    """Lattices of many segments: a row for each character, column n for the piece of n + 1 characters that ends there.

    piece: its code or -1; cum: probability of this or a shorter piece, given the text up to here; beyond them 2.
    """

    piece: np.ndarray
    cum: np.ndarray
    start: np.ndarray
    lengths: np.ndarray


def lattices(segments: list[str], v: Vocabulary) -> Lattice:
    """Forward filtering, one character of all segments at a time."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    at = starts_of(lengths)
    cp = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rest = np.repeat(at[1:], lengths) - np.arange(len(cp))
    width = len(v.tables)
    piece = np.full((len(cp), width), -1, np.int32)
    idx = np.arange(len(cp))
    h = np.zeros(len(cp), np.uint64)
    for n, (keys, ids) in enumerate(v.tables):
        if not len(idx):
            break
        h = h * BASE + cp[idx + n] + np.uint64(1)
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[k] == h
        idx, h = idx[ok], h[ok]
        piece[idx + n, n] = ids[k[ok]]
        more = rest[idx] > n + 1
        idx, h = idx[more], h[more]
    lone = np.flatnonzero(piece[:, 0] < 0)  # characters without a piece of their own are spelled in bytes
    piece[lone, 0] = cp[lone].astype(np.int32) + len(v.pieces)
    logp = np.concatenate([v.logp, [v.byte_logp, -np.inf]])  # -1 is no piece, the last
    alpha = np.zeros(len(cp))
    cum = np.full((len(cp), width), 2, np.float32)
    order = np.argsort(-lengths, kind="stable")
    first = at[:-1][order]
    alive = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    for p, n in enumerate(alive):
        rows = first[:n] + p
        cols = min(p + 1, width)
        x = alpha[rows[:, None] - np.arange(1, cols + 1)]
        if p < width:
            x[:, p] = 0.0
        x += logp[np.minimum(piece[rows, :cols], len(v.pieces))]
        top = x.max(axis=1)
        x -= top[:, None]
        np.exp(x, out=x)
        np.cumsum(x, axis=1, out=x)
        total = x[:, -1].copy()
        alpha[rows] = top + np.log(total)
        x /= total[:, None]
        cum[rows, :cols] = x
    return Lattice(piece, cum, at[:-1], lengths)


def sample(lat: Lattice, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of a path for each occurrence: piece codes in the order of the text, and their numbers."""
    occ = np.argsort(which, kind="stable")  # equal segments together, for the cache
    start = lat.start[which[occ]]
    row, seed = start + lat.lengths[which[occ]] - 1, seeds[occ]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(which), np.int64)
    step = np.zeros(1, np.uint64)
    while len(row):
        step += GOLDEN
        u = ((mix(seed + step) >> np.uint64(11)).astype(np.float64) * (2.0**-53 * (1 - 2.0**-20))).astype(np.float32)
        col = np.count_nonzero(lat.cum[row] <= u[:, None], axis=1)
        taken.append((occ, lat.piece[row, col]))
        count[occ] += 1
        row -= col + 1
        live = row >= start
        if not live.all():
            row, start, seed, occ = row[live], start[live], seed[live], occ[live]
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for s, (o, p) in enumerate(taken):
        out[ends[o] - 1 - s] = p
    return out, count


def encode_texts(texts: list[str | None], keys: np.ndarray, v: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts end to end, and the number of each; keys: one 64-bit number for each row."""
    found, per_text = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            own = BOUNDED.findall(" " + t)
            per_text[i] = len(own)
            found += own
    if not found:
        return np.zeros(0, np.int32), per_text
    ordinal = np.arange(len(found)) - np.repeat(starts_of(per_text)[:-1], per_text)
    seeds = mix(mix(keys.astype(np.uint64) + np.uint64(seed))[np.repeat(np.arange(len(texts)), per_text)] + ordinal.astype(np.uint64) * BASE)
    group = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // LATTICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(found)]
    made = []
    for lo, hi in zip(cuts, cuts[1:]):
        index = Numbers()
        which = np.fromiter(map(index.__getitem__, found[lo:hi]), np.int64, hi - lo)
        made.append(sample(lattices(list(index), v), which, seeds[lo:hi]))
    codes, count = (np.concatenate(x) for x in zip(*made))
    size = len(v.pieces)
    per = np.add.reduceat(count, starts_of(per_text)[:-1][per_text > 0])
    counts = np.zeros(len(texts), np.int64)
    counts[per_text > 0] = per
    wide = codes >= size
    if wide.any():
        cp = codes[wide] - size
        width = np.ones(len(codes), np.int64)
        width[wide] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        ends = np.cumsum(counts)
        total = starts_of(width)
        counts = np.diff(np.concatenate([[0], total[ends]]))
        out = np.repeat(codes, width)
        raw = np.frombuffer("".join(map(chr, cp)).encode("utf-8", "surrogatepass"), np.uint8)
        out[np.repeat(wide, width)] = raw.astype(np.int64) + v.bytes_at
        codes = out
    return codes.astype(np.int32), counts


def decode_ids(ids, pieces: list[bytes]) -> str:
    """The text of piece ids: bytes of all pieces, less the space that encoding puts first."""
    return b"".join([pieces[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Rows (doc_id, pieces, n_pieces, lossless), one for each row of docs: a sampled segmentation of the whole text.

    The sample depends on seed, doc_id and text alone: repeated rows get the same one, partitions don't matter. A null
    doc_id counts as a key of its own. A null text has null pieces, no count and a null lossless; an empty text has no
    pieces. lossless: the pieces, decoded, are the text again. Other columns aren't read; no rows, no result.
    """
    v = load_vocabulary(path or default_path(), alpha)

    def step(b: pa.RecordBatch) -> list:
        texts = b.column(2).to_pylist()
        keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        out = []
        for lo, hi in spans(texts, LATTICE_CHARS):
            some = texts[lo:hi]
            ids, counts = encode_texts(some, keys[lo:hi], v, seed)
            at = starts_of(counts)
            whole = b"".join([v.pieces[i] for i in ids.tolist()])
            same = whole == "".join([" " + t for t in some if t]).encode("utf-8", "surrogatepass")
            ok = [None if t is None else same or decode_ids(ids[s:e].tolist(), v.pieces) == t for t, s, e in zip(some, at[:-1], at[1:])]
            null = pa.array([t is None for t in some])
            pieces = lists(ids, counts, pa.int32())
            n = pa.array(counts.astype(np.int32))
            if null.true_count:
                pieces = pa.compute.if_else(null, pa.scalar(None, pieces.type), pieces)
                n = pa.compute.if_else(null, pa.scalar(None, n.type), n)
            out.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pieces, n, pa.array(ok, pa.bool_())], ["doc_id", "pieces", "n_pieces", "lossless"]))
        return out

    rows = docs.select(id_of(docs), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), "text")
    return arrow_map(rows, step, "doc_id long, pieces array<int>, n_pieces int, lossless boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, pieces): the texts that encode() was given.

    Null pieces give a null text, no pieces an empty one; a null doc_id stays null; repeated rows are decoded each; other
    columns aren't read; no rows, no result.
    """
    pieces = load_vocabulary(path or default_path()).pieces

    def step(b: pa.RecordBatch) -> list:
        texts = [None if p is None else decode_ids(p, pieces) for p in b.column(1).to_pylist()]
        return [pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])]

    return arrow_map(encoded.select(F.col("doc_id").cast("long"), "pieces"), step, "doc_id long, text string")
