"""Preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation, each an array of (role, text)
turns. Their longest common prefix of turns is rendered once, as the prompt; what
follows on either side is rendered as its completion, with the character spans
that count in training (assistant turns with their end mark; every other turn is
masked). One shuffle gathers the turns of a pair; everything else is projection.

Rendering of a turn: ``<|role|>\\n`` text ``<|end|>\\n``. ``<|`` inside a text
becomes ``< |``, so that no text can forge a mark.

Defined results: turns are ordered by number, then role, then text, so repeated
turns and equal numbers have one order; null roles are ``unknown``, null texts
empty; rows without a conversation id belong to no conversation and are left out;
equal conversations give a prompt and two empty completions; an empty or missing
side gives an empty completion; ids may be any whole numbers, negative ones and
those beyond 2**53 included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

TURNS = "array<struct<role:string,text:string>>"


def ordered_turns(where: Column | None = None) -> Column:
    """Aggregate: the turns of a group as TURNS, in order."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(turn if where is None else F.when(where, turn)))
    return F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def collect_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, chosen, rejected) from two tables of (key, turn, role, text)."""
    columns = [key, "turn", "role", "text"]
    rows = chosen.select(*columns, F.lit(True).alias("is_chosen")).unionByName(rejected.select(*columns, F.lit(False).alias("is_chosen"))).filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(ordered_turns(F.col("is_chosen")).alias("chosen"), ordered_turns(~F.col("is_chosen")).alias("rejected"))


def common_turns(a: str, b: str) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def render_turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) character spans of a rendered completion that count in training."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc, t):
        size, head = F.length(render_turn(t)), F.length(t["role"]) + 5
        span = F.array(F.struct((acc["at"] + head).alias("start"), (acc["at"] + size - 1).alias("end")))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, prompt_turns, prompt, and completion and loss spans of either side, from (key, chosen, rejected)."""
    empty = F.expr(f"cast(array() as {TURNS})")
    pairs = pairs.select(key, *(F.coalesce(F.col(c).cast(TURNS), empty).alias(c) for c in ("chosen", "rejected")))
    pairs = pairs.withColumn("prompt_turns", common_turns("chosen", "rejected"))
    rest = {c: F.slice(c, F.col("prompt_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return pairs.select(
        key,
        "prompt_turns",
        render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        render(rest["chosen"]).alias("chosen_completion"),
        loss_spans(rest["chosen"]).alias("chosen_spans"),
        render(rest["rejected"]).alias("rejected_completion"),
        loss_spans(rest["rejected"]).alias("rejected_spans"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a plain conversation table: (conv_id, chosen, rejected).

    Conversations 2k and 2k+1 are partners. Chosen is the conversation itself;
    rejected is its course up to its last assistant turn, with the last assistant
    turn of the partner in that place (nothing where the partner has none). A
    conversation without assistant turn is rejected as it is.
    """
    rows = conversations.filter("conv_id IS NOT NULL")
    is_even = F.col("conv_id").bitwiseAND(F.lit(1)) == 0
    both = rows.groupBy(F.shiftright("conv_id", 1).alias("pair")).agg(
        F.min(F.when(is_even, F.col("conv_id"))).alias("even_id"),
        F.min(F.when(~is_even, F.col("conv_id"))).alias("odd_id"),
        ordered_turns(is_even).alias("even"),
        ordered_turns(~is_even).alias("odd"),
    )
    sides = F.array(F.struct(F.col("even_id").alias("conv_id"), F.col("even").alias("own"), F.col("odd").alias("other")), F.struct(F.col("odd_id").alias("conv_id"), F.col("odd").alias("own"), F.col("even").alias("other")))
    one = both.select(F.explode(sides).alias("s")).select("s.*").filter("conv_id IS NOT NULL")
    replies = one.withColumn("reply", F.expr("array_max(filter(transform(own, (t, i) -> if(t.role = 'assistant', i + 1, null)), x -> x IS NOT NULL))")).withColumn("swap", F.expr("slice(filter(other, t -> t.role = 'assistant'), greatest(1, size(filter(other, t -> t.role = 'assistant'))), 1)"))
    rejected = F.when(F.col("reply").isNull(), F.col("own")).otherwise(F.concat(F.slice("own", F.lit(1), F.col("reply") - 1), F.col("swap")))
    return replies.select("conv_id", F.col("own").alias("chosen"), rejected.alias("rejected"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every conversation; spans are written ``start-end`` joined by commas."""
    found = format_preferences(swapped_replies(table(spark, sf_dir, "conversations")), "conv_id")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return found.select("conv_id", "prompt_turns", "prompt", "chosen_completion", joined("chosen_spans"), "rejected_completion", joined("rejected_spans"))


SQL = {
    "op5_preferences": r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lastone AS (SELECT conv_id, max(pos) AS i FROM t WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, pos, role, text FROM t),
r AS (SELECT t.conv_id, t.pos, t.role, t.text FROM t LEFT JOIN lastone l USING (conv_id) WHERE l.i IS NULL OR t.pos < l.i
      UNION ALL
      SELECT l.conv_id, l.i, o.role, o.text FROM lastone l JOIN lastone p ON p.conv_id = xor(l.conv_id, 1) JOIN t o ON o.conv_id = p.conv_id AND o.pos = p.i),
n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
d AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.pos, r.pos)) AS first FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos
      WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
k AS (SELECT n.conv_id, coalesce(d.first - 1, n.n) AS lcp FROM n LEFT JOIN d USING (conv_id)),
s AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
x AS (SELECT s.side, s.conv_id, s.pos, s.role, k.lcp, '<|' || s.role || '|>' || chr(10) || replace(s.text, '<|', '< |') || '<|end|>' || chr(10) AS line
      FROM s JOIN k USING (conv_id)),
y AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, conv_id, pos > lcp ORDER BY pos) - length(line) AS beg FROM x),
z AS (SELECT conv_id, any_value(lcp) AS lcp,
  string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos <= lcp) AS prompt,
  string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > lcp) AS cc,
  string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > lcp) AS rc,
  string_agg((beg + length(role) + 5)::BIGINT::VARCHAR || '-' || (beg + length(line) - 1)::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE side = 'c' AND pos > lcp AND role = 'assistant') AS cs,
  string_agg((beg + length(role) + 5)::BIGINT::VARCHAR || '-' || (beg + length(line) - 1)::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE side = 'r' AND pos > lcp AND role = 'assistant') AS rs
  FROM y GROUP BY conv_id)
SELECT conv_id, CAST(lcp AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(cc, '') AS chosen_completion, coalesce(cs, '') AS chosen_spans,
       coalesce(rc, '') AS rejected_completion, coalesce(rs, '') AS rejected_spans FROM z"""
}
QUERIES = {"op5_preferences": op5_preferences}
