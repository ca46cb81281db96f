"""Preference formatting: the common turns of a chosen and a rejected conversation once, then both completions, masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, tables

END = "<|end|>"
TRAINED = "assistant"


def filled(turns):
    """Turns without nulls: a null role is "unknown", a null text empty, a null turn both; a null array has none."""
    one = lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.coalesce(F.transform(turns, one), F.array().cast("array<struct<role: string, text: string>>"))


def rendered(turn):
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END + "\n"))


def text_of(turns):
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns):
    """Character ranges "start-end" of the completion that are trained on: TRAINED turns' texts with their end marks."""
    sizes = F.transform(turns, lambda t: F.length(rendered(t)))

    def span(i):
        t = F.element_at(turns, i)
        start = F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda a, n: a + n) + F.length(t["role"]) + 5
        return F.when(t["role"] == TRAINED, F.concat(start.cast("string"), F.lit("-"), (start + F.length(t["text"]) + len(END)).cast("string")))

    n = F.size(turns)
    spans = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), span)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(spans, lambda s: s.isNotNull()), ",")


def common_turns(a, b):
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, n).otherwise(first - 1)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Rows (conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) from (conv_id, chosen, rejected).

    chosen and rejected are arrays of (role, text). Equal conversations express no preference and give no row; if one
    is a prefix of the other, its completion is empty. Empty arrays are conversations without turns, as are null ones.
    Inside them a null role is "unknown", a null text empty and a null turn a turn of both; none is left out. A null
    conv_id stays null; repeated pairs are answered each; other columns aren't read; long texts count in full.
    """
    rows = pairs.select("conv_id", filled("chosen").alias("a"), filled("rejected").alias("b"))
    rows = rows.withColumn("n", common_turns(F.col("a"), F.col("b"))).where((F.col("n") < F.size("a")) | (F.col("n") < F.size("b")))
    tail = lambda x: F.slice(F.col(x), F.col("n") + 1, F.size(x))
    rows = rows.select("conv_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), tail("a").alias("a"), tail("b").alias("b"))
    return rows.select(
        "conv_id", F.col("n").alias("n_common"), text_of(F.col("p")).alias("prompt"), text_of(F.col("a")).alias("chosen"), text_of(F.col("b")).alias("rejected"),
        mask_of(F.col("a")).alias("chosen_mask"), mask_of(F.col("b")).alias("rejected_mask"),
    )


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (role, text) by turn. Rows of a null conv_id belong to no conversation and go;
    rows repeated in all four columns count once; a null role is "unknown", a null text empty; null turns come first,
    equal ones by role and text."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def next_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, next_id) for distinct conv_ids: the next one in order, and the first after the last.

    Ranges of ids are ordered in a task each; only each range's first id, one row for each shuffle partition, meets in one.
    """
    ids = cut(rows.select("conv_id").repartitionByRange("conv_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ids.groupBy("part").agg(F.min("conv_id").alias("first"))
    everything = Window.orderBy("part")
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(everything), F.min("first").over(whole)).alias("after"))
    following = F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id"))
    return ids.join(F.broadcast(after), "part").select("conv_id", F.coalesce(following, "after").alias("next_id"))


def mismatched_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation in full, and the same up to one of its assistant turns with another
    conversation's last reply in that turn's place, a reply to something else.

    The turn is the (conv_id mod n)-th of its n assistant turns, so that conversations fork early and late; the other
    conversation is the next one by conv_id that has a reply, for the last one the first. Every conversation with an
    assistant turn gives a pair; others have no reply that could be preferred, and give none. A single one is its own
    partner. Nulls, repeated rows and long texts are as conversation_turns() says; no rows give no pairs.
    """
    with tables(conversations.sparkSession) as keep:
        is_reply = lambda t: t["role"] == TRAINED
        rows = conversation_turns(conversations).withColumn("replies", F.filter(F.transform("turns", lambda t, i: F.when(is_reply(t), i + 1)), lambda i: i.isNotNull())).where(F.size("replies") > 0)
        rows = keep(cut(rows, "turns"))
        nexts = keep(cut(next_ids(rows), "nexts"))
    fork = F.element_at("replies", (F.pmod(F.col("conv_id"), F.size("replies")) + 1).cast("int"))
    own = rows.select("conv_id", F.col("turns").alias("chosen"), F.slice("turns", F.lit(1), fork - 1).alias("start")).join(nexts, "conv_id")
    other = rows.select(F.col("conv_id").alias("next_id"), F.element_at("turns", F.element_at("replies", -1)).alias("reply"))
    return own.join(other, "next_id").select("conv_id", "chosen", F.concat("start", F.array("reply")).alias("rejected"))


def preference_sql() -> str:
    """format_preferences(mismatched_replies(conversations)) in DuckDB SQL."""
    one = lambda t: f"'<|' || {t}.role || '|>' || chr(10) || {t}.text || '{END}' || chr(10)"
    text = lambda x: f"coalesce(list_aggregate(list_transform({x}, lambda t: {one('t')}), 'string_agg', ''), '')"

    def mask(x: str) -> str:
        before = f"coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: length({one('t')}))), 0)"
        start = f"{before} + length({x}[i].role) + 5"
        span = f"CASE WHEN {x}[i].role = '{TRAINED}' THEN CAST({start} AS BIGINT) || '-' || CAST({start} + length({x}[i].text) + {len(END)} AS BIGINT) END"
        return f"coalesce(list_aggregate(list_filter(list_transform(range(1, len({x}) + 1), lambda i: {span}), lambda s: s IS NOT NULL), 'string_agg', ','), '')"

    return f"""
    WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS w FROM r GROUP BY conv_id),
    l AS (SELECT conv_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i].role = '{TRAINED}') AS e FROM t),
    c AS (SELECT conv_id, w AS a, w[e[len(e)]] AS reply, w[1:e[((conv_id % len(e)) + len(e)) % len(e) + 1] - 1] AS start,
        coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM l WHERE len(e) > 0),
    p AS (SELECT c.conv_id, c.a, list_concat(c.start, [d.reply]) AS b FROM c JOIN c AS d ON d.conv_id = c.next_id),
    n AS (SELECT *, list_max([i for i in range(0, least(len(a), len(b)) + 1) if a[1:i] = b[1:i]]) AS n FROM p),
    s AS (SELECT conv_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM n WHERE n < len(a) OR n < len(b))
    SELECT conv_id, CAST(n AS INTEGER) AS n_common, {text('p')} AS prompt, {text('a')} AS chosen, {text('b')} AS rejected,
      {mask('a')} AS chosen_mask, {mask('b')} AS rejected_mask FROM s"""
