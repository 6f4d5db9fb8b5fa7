"""Preference formatting of chat conversations.

A chosen and a rejected conversation are compared turn by turn. Their longest common prefix is
rendered once, as the prompt; what follows in each is its completion, rendered with a mask that
covers the assistant's words only. Turns are compared in a join on (pair, turn), and only what a
pair renders is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.common import cut, running, table

#: Fixed values of the chat format.
OPEN, MIDDLE, CLOSE, SPEAKER = "<|", "|>\n", "<|end|>\n", "assistant"
#: Parts that answers are ranked in.
RANKED_IN = 512


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def _rendered(turns: Column) -> Column:
    """Turns (structs of turn, role, text, in order) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """[start, past) in characters of what is learnt from in the rendered turns: the assistant's words and the mark that ends them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,past:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t["role"]))
        past = begin + F.length(t["text"]) + len(CLOSE)
        return F.struct(past.alias("at"), F.when(t["role"] == SPEAKER, F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), past.alias("past"))))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id") -> DataFrame:
    """One row per pair: ``pair_col``, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask.

    Both tables have ``pair_col``, turn, role, text. Null roles and texts count as empty. Turns that
    are repeated (same pair and turn) are ordered by role and text and compared in that order.
    A prefix never takes in a whole side's last turn when the other goes on with nothing: an empty
    completion is an empty string. Pairs that are on one side only have no prompt in common and an
    empty completion on the other side; a null pair is dropped. Extra columns are ignored.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        place = F.row_number().over(Window.partitionBy("pair").orderBy("turn", "role", "text"))
        return rows.select("pair", place.alias("place"), F.struct("turn", "role", "text").alias(name))

    met = side(chosen, "c").join(side(rejected, "r"), ["pair", "place"], "full")
    differs = ~(F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text")))
    turns = F.array_sort(F.collect_list(F.struct("place", "c", "r")))
    grouped = met.groupBy("pair").agg(F.min(F.when(differs, F.col("place"))).alias("first"), turns.alias("turns"))
    first = F.coalesce(F.col("first"), F.size("turns") + 1)
    before = F.transform(F.filter("turns", lambda t: t["place"] < first), lambda t: t["c"])

    def rest(name: str) -> Column:
        return F.transform(F.filter("turns", lambda t: (t["place"] >= first) & t[name].isNotNull()), lambda t: t[name])

    parted = grouped.select("pair", (first - 1).cast("int").alias("prompt_turns"), before.alias("before"), rest("c").alias("c"), rest("r").alias("r"))
    return parted.select(F.col("pair").alias(pair_col), _rendered(F.col("before")).alias("prompt"), "prompt_turns", _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def mismatched(conversations: DataFrame) -> DataFrame:
    """Rejected counterparts: each conversation with its last assistant turn answered by another conversation's last answer.

    Different answers are ranked by the least conversation that ends in them, and each is replaced by the next
    one, the last by the first: a counterpart never has the answer itself. Where all answers are one, or a
    conversation has no assistant turn, there is no counterpart. ``conv_id`` is an integer; null ones are left out.

    Answers are told apart and ranked by their digests. A text is fetched once, from the conversation that stands for it.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    spoken = turns.where(F.col("role") == SPEAKER)
    last = cut(spoken.select("conv_id", "turn", F.sha2("text", 256).alias("digest"), F.col("text").alias("__text")).groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("digest", F.struct("turn", "__text")).alias("digest")))
    answers = cut(last.groupBy("digest").agg(F.min("conv_id").alias("least")))
    steps, n = answers.agg(F.percentile_approx("least", [i / RANKED_IN for i in range(1, RANKED_IN)]), F.count("*")).first()
    part = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sorted(set(steps or []))]), lambda x: x < F.col("least")))
    ranked = cut(running(answers, [], part, ["least"], {"rank": "1"}))
    other = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("before"), F.col("digest").alias("other"), F.col("least").alias("source"))
    swaps = ranked.join(other, ranked["rank"] == other["before"]).select("digest", "other", "source").where("digest <> other")
    swapped = last.join(swaps, "digest").select("conv_id", "last", "source")
    said = last.join(answers, (last["conv_id"] == answers["least"]) & (last["digest"] == answers["digest"]), "left_semi").select(F.col("conv_id").alias("source"), F.col("last").alias("turn"))
    texts = spoken.withColumnRenamed("conv_id", "source").join(said, ["source", "turn"]).groupBy("source").agg(F.max("text").alias("other"))
    answered = swapped.join(texts, "source").select("conv_id", "last", "other")
    return turns.join(answered, "conv_id").select("conv_id", "turn", "role", F.when((F.col("turn") == F.col("last")) & (F.col("role") == SPEAKER), F.col("other")).otherwise(F.col("text")).alias("text"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with an answer, each against its counterpart; masks as text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rejected = mismatched(turns)
    chosen = turns.join(rejected.select("conv_id").distinct(), "conv_id", "left_semi")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["past"].cast("string"))), " ")
    out = format_pairs(chosen, rejected)
    return out.select("conv_id", "prompt", "prompt_turns", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


_R = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM t WHERE role = '{SPEAKER}' GROUP BY conv_id),
a AS (SELECT answer, min(conv_id) AS least FROM l GROUP BY answer),
b AS (SELECT answer, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other FROM a WINDOW w AS (ORDER BY least)),
n AS (SELECT conv_id, last, other FROM l JOIN b USING (answer) WHERE answer <> other),
s AS (SELECT t.conv_id, turn, role, text AS c, CASE WHEN turn = last AND role = '{SPEAKER}' THEN other ELSE text END AS r FROM t JOIN n USING (conv_id)),
f AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE c <> r), max(turn) + 1) AS first FROM s GROUP BY conv_id),
o AS (SELECT s.*, first, coalesce(sum(CASE WHEN turn >= first THEN 5 + length(role) + length(c) + 8 END) OVER w, 0) AS ce, coalesce(sum(CASE WHEN turn >= first THEN 5 + length(role) + length(r) + 8 END) OVER w, 0) AS re FROM s JOIN f USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id,
 coalesce(string_agg({_R.replace('text', 'c')}, '' ORDER BY turn) FILTER (WHERE turn < first), '') AS prompt,
 CAST(count(*) FILTER (WHERE turn < first) AS INTEGER) AS prompt_turns,
 coalesce(string_agg({_R.replace('text', 'c')}, '' ORDER BY turn) FILTER (WHERE turn >= first), '') AS chosen,
 coalesce(string_agg({_R.replace('text', 'r')}, '' ORDER BY turn) FILTER (WHERE turn >= first), '') AS rejected,
 coalesce(string_agg((ce - length(c) - 8) || '-' || ce, ' ' ORDER BY turn) FILTER (WHERE turn >= first AND role = '{SPEAKER}'), '') AS chosen_mask,
 coalesce(string_agg((re - length(r) - 8) || '-' || re, ' ' ORDER BY turn) FILTER (WHERE turn >= first AND role = '{SPEAKER}'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
