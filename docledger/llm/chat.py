"""Preference formatting of chosen and rejected conversations. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks of a rendered turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: The role whose turns a completion is trained on.
TRAINED = "assistant"
UNKNOWN_ROLE = "unknown"


def _header(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    """Turns (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def masked(turns: Column) -> Column:
    """Turns as segments (text, train): headers and other roles are masked, the trained role's texts and ends are not."""
    pair = lambda t: F.array(F.struct(_header(t).alias("text"), F.lit(False).alias("train")), F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == TRAINED).alias("train")))
    return F.flatten(F.transform(turns, pair))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations (pair_id, chosen boolean, conv_id, turn, role, text) as a prompt and two masked completions.

    Turns of a side go in the order of turn (null first), role and text. The longest common
    prefix of both sides' turns, by role and text, is rendered once as prompt; what follows
    on each side is its completion, as segments with a mask. Both sides of a pair are
    gathered in one aggregation, so that a row holds one pair's texts and no more; a very long
    conversation is one row as well.

    Null texts count as empty, null roles as `unknown`. Repeated turns are turns each. A side that the
    other begins with has an empty completion; a pair that lacks a side is left out, as are rows
    with a null pair_id. An empty table gives an empty result.
    Returns pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected (segments).
    """
    turn = F.struct("turn", F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda yes: F.array_sort(F.collect_list(F.when(F.col("chosen") == yes, turn)))
    sides = turns.where("pair_id is not null").groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"), F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id"))
    sides = sides.where((F.size("a") > 0) & (F.size("b") > 0))
    shortest = F.least(F.size("a"), F.size("b"))
    at = lambda x, i: F.struct(F.get(x, i)["role"], F.get(x, i)["text"])
    first_other = F.array_position(F.transform(F.sequence(F.lit(0), shortest - 1), lambda i: at(F.col("a"), i) == at(F.col("b"), i)), F.lit(False))
    sides = sides.withColumn("first_other", first_other).withColumn("n_common", F.when(F.col("first_other") > 0, F.col("first_other") - 1).otherwise(shortest).cast("int"))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    return sides.select("pair_id", "chosen_id", "rejected_id", "n_common", render(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"), masked(rest("a")).alias("chosen"), masked(rest("b")).alias("rejected"))


def spans(segments: Column) -> Column:
    """Trained characters of segments put together, as start:end (end excluded) joined by commas."""
    at = F.aggregate(
        segments,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            (s["n"] + F.char_length(x["text"])).alias("n"),
            F.when(x["train"], F.array_append(s["out"], F.concat(s["n"], F.lit(":"), s["n"] + F.char_length(x["text"])))).otherwise(s["out"]).alias("out"),
        ),
    )
    return F.array_join(at["out"], ",")


def against_own_answers(rows: DataFrame) -> DataFrame:
    """Preference pairs of conversations (conv_id, turn, role, text): each as it is, and with another last answer.

    The rejected side of a conversation has the same turns, but its last turn of the trained role says
    what that of conversation conv_id xor 1 says, or nothing where there is none. So every conversation with a
    conv_id is in one pair, and both sides share all turns before that one.
    """
    rows = rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    is_last = (F.col("role") == TRAINED) & F.struct("turn", "text").eqNullSafe(F.col("last"))
    both = rows.join(last.join(other, "conv_id", "left"), "conv_id", "left").withColumn("chosen", F.explode(F.array(F.lit(True), F.lit(False))))
    text = F.when(~F.col("chosen") & is_last, F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return both.select(F.col("conv_id").alias("pair_id"), "chosen", "conv_id", "turn", "role", text.alias("text"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another last answer: prompt, completions and which of their characters are trained."""
    out = preference_pairs(against_own_answers(table(spark, sf_dir, "conversations")))
    whole = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    sides = [f(F.col(c)).alias(n) for c in ("chosen", "rejected") for n, f in ((c, whole), (f"{c}_spans", spans))]
    return out.select("pair_id", "n_common", "prompt", *sides)


OP2_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS m FROM r WHERE role = 'assistant' GROUP BY 1),
o AS (SELECT xor(conv_id, 1) AS conv_id, m.text AS other FROM l),
b AS (SELECT conv_id AS pair_id, true AS chosen, turn, role, text FROM r UNION ALL
  SELECT r.conv_id, false, turn, role, CASE WHEN role = 'assistant' AND {'turn': turn, 'text': text} IS NOT DISTINCT FROM m THEN coalesce(other, '') ELSE text END
  FROM r LEFT JOIN l USING (conv_id) LEFT JOIN o USING (conv_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn ASC NULLS FIRST, role, text) AS i FROM b),
p AS (SELECT pair_id, max(i) FILTER (chosen) AS na, max(i) FILTER (NOT chosen) AS nb FROM t GROUP BY pair_id),
d AS (SELECT x.pair_id, min(x.i) AS first_other FROM t x JOIN t y ON x.pair_id = y.pair_id AND x.i = y.i AND x.chosen AND NOT y.chosen WHERE x.role <> y.role OR x.text <> y.text GROUP BY 1),
n AS (SELECT p.pair_id, coalesce(d.first_other - 1, least(na, nb))::INT AS n_common FROM p LEFT JOIN d USING (pair_id)),
s AS (SELECT t.pair_id, t.chosen, t.role, t.i, n.n_common, '<|' || t.role || '|>' || chr(10) AS h, t.text || '<|end|>' || chr(10) AS x FROM t JOIN n USING (pair_id)),
e AS (SELECT *, sum(length(h) + length(x)) OVER (PARTITION BY pair_id, chosen ORDER BY i) AS stop FROM s WHERE i > n_common)
SELECT n.pair_id, n.n_common, coalesce((SELECT string_agg(h || x, '' ORDER BY i) FROM s WHERE s.pair_id = n.pair_id AND chosen AND i <= s.n_common), '') AS prompt,
  coalesce(string_agg(h || x, '' ORDER BY i) FILTER (chosen), '') AS chosen,
  coalesce(string_agg((stop - length(x))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (chosen AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(h || x, '' ORDER BY i) FILTER (NOT chosen), '') AS rejected,
  coalesce(string_agg((stop - length(x))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (NOT chosen AND role = 'assistant'), '') AS rejected_spans
FROM n LEFT JOIN e USING (pair_id) GROUP BY n.pair_id, n.n_common
"""

QUERIES = {"op2_chat": op2_chat}
ORACLE = {"op2_chat": OP2_SQL}
