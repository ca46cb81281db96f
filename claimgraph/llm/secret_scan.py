"""Secret scan: sliding-window Shannon entropy of candidate strings, per character class, with an allow list."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, fresh, id_of

MIN_LENGTH = 16
WINDOW = 16
#: Names before "=", words before "_" and "-" aren't part of a candidate.
CANDIDATE = f"[A-Za-z0-9+/]{{{MIN_LENGTH},}}={{0,2}}"
SEPARATORS = "[+/=]"
#: What a dictionary, an identifier or a counter looks like: words in camel case, capitals, with a short number behind, numbers.
WORDLIKE = r"([a-z]{2,})?([A-Z][a-z]+)*[0-9]{0,4}|[a-z][0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+"
#: Entropy in bits that some window must reach. A class is the first whose pattern the whole candidate matches.
CLASSES = (
    ("hex", r"[0-9a-f]+|[0-9A-F]+", 2.5),
    ("upper", r"[0-9A-Z]+", 3.0),
    ("letters", r"[A-Za-z]+", 3.5),
    ("alnum", r"[0-9A-Za-z]+", 3.2),
    ("base64", r"[0-9A-Za-z+/=]+", 3.5),
)
#: Candidates that match one of these as a whole are never reported.
ALLOW = (
    r"[0-9]+",  # bare numbers are no secrets: card or telephone numbers are for a scan for personal data
    r".*EXAMPLE.*",  # documented sample keys
)
#: Neither are those behind this: digests that name themselves.
DIGEST = r"(sha|SHA|md|MD)-?[0-9]{1,3}[-_=:]$"
LOOK_BACK = 10
MASK = "<SECRET>"


def max_window_entropy(s: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy (bits) of the characters in any window; a shorter string is one window.

    Counts change by one character in and one out at each step; the sum of n·log2 n is kept along.
    """
    w = min(window, len(s))
    if not w:
        return 0.0
    logs = [0.0, *(n * math.log2(n) for n in range(1, w + 1))]
    count: dict[str, int] = {}
    held = 0.0
    least = math.inf
    for i, c in enumerate(s):
        if i >= w:
            out = s[i - w]
            n = count[out]
            held += logs[n - 1] - logs[n]
            count[out] = n - 1
        n = count.get(c, 0)
        held += logs[n + 1] - logs[n]
        count[c] = n + 1
        if i >= w - 1:
            least = min(least, held)
    return math.log2(w) - least / w


class Rules:
    def __init__(self, window: int, allow: tuple[str, ...]):
        self.window = window
        self.candidate, self.wordlike, self.digest, self.separators = map(re.compile, (CANDIDATE, WORDLIKE, DIGEST, SEPARATORS))
        self.word, self.classes, self.allow = re.compile("[A-Za-z]{3}"), [(n, re.compile(p), e) for n, p, e in CLASSES], [re.compile(a) for a in allow]

    def units(self, piece: str) -> list[tuple[int, str]]:
        """(offset, text): the parts between separators if one is a word, as in paths and addresses; else the piece itself."""
        parts = self.separators.split(piece)
        if not any(self.wordlike.fullmatch(p) and self.word.search(p) for p in parts):
            return [(0, piece)]
        out, at = [], 0
        for p in parts:
            out.append((at, p))
            at += len(p) + 1
        return out


def secrets_in(text: str, rules: Rules) -> list[tuple[int, int, str, float]]:
    """(start, end, class, entropy) of each secret in the text, in order; offsets count characters."""
    out = []
    for m in rules.candidate.finditer(text):
        for offset, s in rules.units(m.group()):
            at = m.start() + offset
            if len(s) < MIN_LENGTH or any(a.fullmatch(s) for a in rules.allow) or rules.digest.search(text[max(0, at - LOOK_BACK) : at]):
                continue
            if all(rules.wordlike.fullmatch(p) for p in rules.separators.split(s)):
                continue
            for name, pattern, least in rules.classes:
                if pattern.fullmatch(s):
                    e = max_window_entropy(s, rules.window)
                    if e >= least - 1e-9:
                        out.append((at, at + len(s), name, e))
                    break
    return out


def secret_scan(docs: DataFrame, window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Rows (doc_id, start_at, end_at, class, entropy), one for each secret found; offsets count characters.

    The JVM drops texts without a candidate before Python sees any. Null, empty and candidate-free texts give no
    rows; a null doc_id stays null; repeated rows give repeated results; other columns aren't read; an empty
    table gives no rows. Long candidates are scanned in full, in time linear in their length.
    """
    rules = Rules(window, allow)

    def step(b: pa.RecordBatch) -> list:
        out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in secrets_in(t, rules)]
        if not out:
            return []
        i, s, e, k, h = zip(*out)
        return [pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(k), pa.array(h, pa.float64())], ["doc_id", "start_at", "end_at", "class", "entropy"])]

    return arrow_map(
        docs.select(id_of(docs), "text").where(F.col("text").rlike(CANDIDATE)), step,
        "doc_id long, start_at int, end_at int, class string, entropy double",
    )


def redact_secrets(docs: DataFrame, window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with every secret in text replaced by MASK and n_chars, where there is one, made to fit.

    All rows and columns stay, repeated rows each, null and empty texts as they are; a text without secrets isn't touched.
    Long texts are scanned in full. No rows give no rows. Columns that are named like the operator's own stay as they are.
    """
    rules = Rules(window, allow)

    def redact(t: str | None) -> str | None:
        if t is None:
            return None
        found = secrets_in(t, rules)
        if not found:
            return None
        parts, at = [], 0
        for s, e, _, _ in found:
            parts += [t[at:s], MASK]
            at = e
        return "".join([*parts, t[at:]])

    @F.arrow_udf("string")
    def masked(a: pa.Array) -> pa.Array:
        return pa.array([redact(t) for t in a.to_pylist()], pa.string())

    new = fresh(docs, "redacted")
    hit = F.col("text").rlike(CANDIDATE)
    out = docs.withColumn(new, masked(F.when(hit, F.col("text"))))
    put = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(put).drop(new)


def secret_sql() -> str:
    """The same in DuckDB SQL."""
    whole = lambda p: f"regexp_full_match(s, '{p}')"
    kinds = " ".join(f"WHEN {whole(p)} THEN '{n}'" for n, p, _ in CLASSES)
    least = " ".join(f"WHEN '{n}' THEN {e}" for n, _, e in CLASSES)
    wordy = lambda x: f"list_bool_and(list_transform(string_split_regex({x}, '{SEPARATORS}'), lambda p: regexp_full_match(p, '{WORDLIKE}')))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '{CANDIDATE}') AS m,
        string_split_regex(text, '{CANDIDATE}') AS g FROM documents WHERE regexp_matches(text, '{CANDIDATE}')),
    c AS (SELECT r, doc_id, text, k, m[k] AS piece, string_split_regex(m[k], '{SEPARATORS}') AS parts,
        list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))) - length(m[k]) AS begin_at
      FROM d, unnest(range(1, len(m) + 1)) AS x(k)),
    w AS (SELECT *, len(list_filter(parts, lambda p: regexp_full_match(p, '{WORDLIKE}') AND regexp_matches(p, '[A-Za-z]{{3}}'))) > 0 AS path FROM c),
    u AS (SELECT doc_id, text, piece AS s, CAST(begin_at AS INTEGER) AS start_at FROM w WHERE NOT path UNION ALL
      SELECT doc_id, text, parts[i], CAST(begin_at + i - 1 + coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0) AS INTEGER)
      FROM w, unnest(range(1, len(parts) + 1)) AS x(i) WHERE path),
    n AS (SELECT * FROM u WHERE length(s) >= {MIN_LENGTH} AND NOT ({" OR ".join(whole(a) for a in ALLOW)}) AND NOT {wordy("s")}
      AND NOT regexp_matches(substr(text, greatest(start_at - {LOOK_BACK}, 0) + 1, least(start_at, {LOOK_BACK})), '{DIGEST}')),
    h AS (SELECT *, CASE {kinds} END AS class,
        list_max(list_transform(range(1, greatest(1, length(s) - {WINDOW} + 1) + 1),
          lambda i: list_aggregate(string_split(substr(s, i, {WINDOW}), ''), 'entropy'))) AS entropy FROM n)
    SELECT doc_id, start_at, CAST(start_at + length(s) AS INTEGER) AS end_at, class, round(entropy, 9) AS entropy
    FROM h WHERE entropy >= CASE class {least} END - 1e-9"""
