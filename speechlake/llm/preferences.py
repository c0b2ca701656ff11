"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once as the prompt; what follows is rendered per side, with
the character spans that training may learn from (assistant text and its end
mark). Everything is column functions over the two lists of turns.

Defined results: a null role or text is empty; turns of one number are ordered
by role and text, a null number comes first; equal conversations give empty
completions; a conversation that has fewer than two answers gives no pair of
its own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.let import let
from speechlake.llm.common import query, table
from speechlake.sources.scratch import stored

# The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation its ordered (role, text)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), text("role"), text("text"))))
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, plain).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both begin with."""
    both = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, both), F.slice(rejected, 1, both), lambda a, b: a == b)
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, both).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    shown = F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(f"{CLOSE}\n")))
    return F.array_join(shown, "")


def learnt_spans(turns: Column) -> Column:
    """``start, end`` of what is learnt in the rendered turns."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(turn["text"]) + len(CLOSE)
        spans = F.when(
            turn["role"] == LEARNT, F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end")))
        ).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """Replaces ``chosen`` and ``rejected`` (lists of role and text) by
    ``n_common, prompt`` and, per side, the completion and its learnt spans."""

    def shape(n: Column) -> Column:
        rest = lambda c: F.slice(F.col(c), n + 1, F.size(c))
        return F.struct(
            n.alias("n_common"),
            rendered(F.slice(F.col("chosen"), F.lit(1), n)).alias("prompt"),
            rendered(rest("chosen")).alias("chosen_text"),
            learnt_spans(rest("chosen")).alias("chosen_spans"),
            rendered(rest("rejected")).alias("rejected_text"),
            learnt_spans(rest("rejected")).alias("rejected_spans"),
        )

    made = let(common_turns(F.col("chosen"), F.col("rejected")), shape)
    return pairs.withColumn("_made", made).drop("chosen", "rejected").select("*", "_made.*").drop("_made")


def stale_pairs(convs: DataFrame) -> DataFrame:
    """A conversation and itself with the first answer given again as the last."""
    turns = F.col("turns")
    places = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.get(turns, i - 1)["role"] == LEARNT)

    def again(at: Column) -> Column:
        last, first = F.element_at(at, -1), F.element_at(at, 1)
        return F.transform(turns, lambda t, i: F.when(i == last - 1, F.get(turns, first - 1)).otherwise(t))

    two = convs.withColumn("_at", places).where(F.size("_at") >= 2)
    return two.select(
        F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.lit("stale").alias("kind"), turns.alias("chosen"), again(F.col("_at")).alias("rejected")
    )


def opening_pairs(convs: DataFrame) -> DataFrame:
    """Conversations that open alike: the one with most turns (of several the
    smallest id) is preferred to each other one."""
    opening = F.get("turns", F.lit(0))
    known = stored(convs.where("conv_id IS NOT NULL").select("conv_id", F.size("turns").alias("n"), opening.alias("opening")), "openings")
    best = known.groupBy("opening").agg(F.max(F.struct("n", (-F.col("conv_id")).alias("id"))).alias("best"), F.count("*").alias("members"))
    best = stored(best.where("members > 1").select("opening", (-F.col("best.id")).alias("chosen_id")), "preferred")
    others = stored(known.join(best, "opening").where("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id")), "other-pairs")
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    pairs = others.join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")
    return pairs.select("chosen_id", "rejected_id", F.lit("opening").alias("kind"), "chosen", "rejected")


_TURNS = "'<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)"


def _sql_spans(side: str) -> str:
    before = f"coalesce(list_sum(list_transform({side}[n + 1:i - 1], lambda t: length({_TURNS}))), 0)"
    head = f"length('<|im_start|>' || {side}[i].role || chr(10))"
    span = f"CAST({before} + {head} AS INT) || ':' || CAST({before} + {head} + length({side}[i].text) + 10 AS INT)"
    at = f"list_filter(range(n + 1, len({side}) + 1), lambda i: {side}[i].role = 'assistant')"
    return f"array_to_string(list_transform({at}, lambda i: {span}), ',')"


OP5_SQL = f"""
WITH convs AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id
), answers AS (
  SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS places FROM convs
), stale AS (
  SELECT conv_id AS chosen_id, conv_id AS rejected_id, 'stale' AS kind, turns AS chosen,
         list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN i = places[-1] THEN turns[places[1]] ELSE turns[i] END) AS rejected
  FROM answers WHERE len(places) >= 2
), ranked AS (
  SELECT conv_id, turns, first_value(conv_id) OVER (PARTITION BY turns[1] ORDER BY len(turns) DESC, conv_id) AS best
  FROM convs WHERE conv_id IS NOT NULL
), opening AS (
  SELECT r.best AS chosen_id, r.conv_id AS rejected_id, 'opening' AS kind, c.turns AS chosen, r.turns AS rejected
  FROM ranked r JOIN convs c ON r.best = c.conv_id WHERE r.conv_id <> r.best
), pairs AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1,
                     least(len(chosen), len(rejected))) AS n
  FROM (SELECT * FROM stale UNION ALL SELECT * FROM opening)
)
SELECT chosen_id, rejected_id, kind, CAST(n AS INT) AS n_common,
       array_to_string(list_transform(chosen[1:n], lambda t: {_TURNS}), '') AS prompt,
       array_to_string(list_transform(chosen[n + 1:], lambda t: {_TURNS}), '') AS chosen_text,
       array_to_string(list_transform(rejected[n + 1:], lambda t: {_TURNS}), '') AS rejected_text,
       {_sql_spans("chosen")} AS chosen_spans, {_sql_spans("rejected")} AS rejected_spans
FROM pairs
"""


@query("op5_preference_formatting", OP5_SQL)
def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = stored(conversations(table(spark, sf_dir, "conversations")), "conversations")
    made = formatted(stale_pairs(convs).union(opening_pairs(convs)))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return made.withColumn("chosen_spans", joined("chosen_spans")).withColumn("rejected_spans", joined("rejected_spans"))
