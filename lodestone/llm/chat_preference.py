"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

``format_preferences`` takes one row per turn with a pair id, a side
(``chosen`` or ``rejected``), a turn number, a role and a text. For each pair
it finds the longest common prefix of turns (same role and same text at the
same place), renders that prefix once as ``prompt`` and the rest of each side
as its completion. ``*_mask`` lists the character spans of the completion
that count in a loss: the texts of assistant turns with their end mark.

Defined cases: turns are ordered by (turn, role, text), nulls first; rows that
repeat pair, side, turn, role and text count once; a null role renders as an
empty role and a null text as an empty text, but null and empty are different
turns for the common prefix; a pair with one side only has an empty prompt
and an empty completion for the missing side; rows with a null pair id or any
other side are left out; an empty table gives no rows. Columns beside the five
named ones are ignored, so clashing names cannot matter. A conversation is
gathered in one row, as its rendering is one string; repeated rows go
before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

HEAD, MID, END = "<|", "|>\n", "<|end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def _render(turns: Column) -> Column:
    blank = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), F.coalesce(t["role"], blank), F.lit(MID), F.coalesce(t["text"], blank), F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans ``start-end`` (characters, end exclusive) of assistant texts and end marks, comma-joined."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(F.coalesce(t["role"], F.lit(""))) + len(HEAD) + len(MID)
        end = head + F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        span = F.concat(head.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(F.coalesce(t["role"], F.lit("")) != "assistant", acc["spans"]).when(acc["spans"] == "", span).otherwise(F.concat(acc["spans"], F.lit(","), span))
        return F.struct(end.cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_sides(sides: DataFrame) -> DataFrame:
    """One row per row of (pair_id, chosen, rejected), both arrays of (turn, role, text) in order: see ``format_preferences``."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(
        F.slice("chosen", 1, shorter),
        F.slice("rejected", 1, shorter),
        lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]),
    )
    cut = F.array_position(same, F.lit(False))
    n = F.when(cut == 0, shorter).otherwise(cut - 1).cast("int")
    split = sides.withColumn("n", n)
    tail = {s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in ("chosen", "rejected")}
    return split.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        _render(F.slice("chosen", 1, F.col("n"))).alias("prompt"),
        _render(tail["chosen"]).alias("chosen"),
        _render(tail["rejected"]).alias("rejected"),
        _mask(tail["chosen"]).alias("chosen_mask"),
        _mask(tail["rejected"]).alias("rejected_mask"),
        F.size(tail["chosen"]).cast("bigint").alias("n_chosen_turns"),
        F.size(tail["rejected"]).cast("bigint").alias("n_rejected_turns"),
    )


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, n_chosen_turns, n_rejected_turns."""
    rows = turns.select(F.col(pair).alias("pair_id"), F.col(side).alias("side"), F.struct(F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("item"))
    rows = rows.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    # sets, so that repeated rows go on the map side and turns move once
    sides = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("item")))).alias(s) for s in ("chosen", "rejected")])
    return format_sides(sides)


def sides_from_conversations(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: (pair_id, chosen, rejected).

    Chosen: the conversation as it is. Rejected: the same turns up to its last
    assistant turn, whose text is replaced by that of the last assistant turn
    of the conversation with the next id (conv_id + 1), where there is one;
    without one, the rejected side ends before that turn. Conversations
    without an assistant turn get a rejected side equal to the chosen one.

    Turns are moved once, to their conversation; only last answers move again.
    """
    item = F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text")
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").alias("pair_id")).agg(F.sort_array(F.collect_set(item)).alias("chosen"))
    # the largest (turn, text): repeated turn numbers take the larger text, nulls before any text
    last = F.array_max(F.transform(F.filter("chosen", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text"))))
    whole = whole.withColumn("last", last)
    other = whole.where(F.col("last").isNotNull()).select((F.col("pair_id") - 1).alias("pair_id"), F.lit(True).alias("found"), F.col("last.text").alias("other_text"))
    joined = whole.join(other, "pair_id", "left")
    before = F.filter("chosen", lambda t: t["turn"] < F.col("last.turn"))
    answer = F.array(F.struct(F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other_text").alias("text")))
    rejected = F.when(F.col("last.turn").isNull(), F.col("chosen")).when(F.col("found"), F.concat(before, answer)).otherwise(before)
    return joined.select("pair_id", "chosen", rejected.alias("rejected"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_sides(sides_from_conversations(read_table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
la AS (
  SELECT conv_id, turn AS last_turn, text AS last_text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS k
    FROM t WHERE role = 'assistant') WHERE k = 1),
l AS (
  SELECT a.conv_id, a.last_turn, b.conv_id IS NOT NULL AS found, b.last_text AS other_text
  FROM la a LEFT JOIN la b ON b.conv_id = a.conv_id + 1),
s AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'rejected', t.turn, t.role, t.text FROM t LEFT JOIN l USING (conv_id)
  WHERE l.conv_id IS NULL OR l.last_turn IS NULL OR t.turn < l.last_turn
  UNION ALL
  SELECT conv_id, 'rejected', last_turn, 'assistant', other_text FROM l WHERE found AND last_turn IS NOT NULL),
n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM (SELECT DISTINCT * FROM s)),
p AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
    min(CASE WHEN c.pair_id IS NULL OR r.pair_id IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
        THEN coalesce(c.k, r.k) END) AS cut, count(*) AS longest
  FROM (SELECT * FROM n WHERE side = 'chosen') c FULL JOIN (SELECT * FROM n WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.k = r.k
  GROUP BY 1),
m AS (
  SELECT n.*, coalesce(p.cut - 1, p.longest) AS np,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece
  FROM n JOIN p USING (pair_id)),
o AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, side, k > np ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM m)
SELECT pair_id, max(np)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'chosen' AND k <= np), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'chosen' AND k > np), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'rejected' AND k > np), '') AS rejected,
  coalesce(string_agg((upto - length(coalesce(text, '')) - 8)::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY k) FILTER (side = 'chosen' AND k > np AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((upto - length(coalesce(text, '')) - 8)::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY k) FILTER (side = 'rejected' AND k > np AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (side = 'chosen' AND k > np) AS n_chosen_turns,
  count(*) FILTER (side = 'rejected' AND k > np) AS n_rejected_turns
FROM o GROUP BY pair_id
"""
