"""Preference formatting: shared prompt once, paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import table

#: Template of a turn; an assistant's text with its end mark is what a model learns.
OPEN, BEGIN, END, AFTER = "<|", "|>\n", "<|end|>", "\n"
TRAINED_ROLE = "assistant"


#: Code points that a turn has besides its role and text.
_FIXED = len(OPEN + BEGIN + END + AFTER)
_TURNS = "array<struct<role:string,text:string,stop:int>>"


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """The turns of each pair in order, as an array; ``stop`` is where the rendered turn ends.

    The running sum and the grouping share one shuffle by pair.
    """
    known = rows.where("pair_id is not null").select(
        "pair_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    so_far = Window.partitionBy("pair_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.length("role") + F.length("text") + _FIXED).over(so_far).cast("int")
    return known.withColumn("stop", stop).groupBy("pair_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "stop"))),
        lambda t: F.struct(t.role, t.text, t.stop)).alias(name))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(BEGIN), t.text, F.lit(END + AFTER))), "")


def _mask(turns: Column, before: Column) -> Column:
    """Spans [start, stop) of code points of the rendered turns on which a model is trained,
    counted from ``before``, the place where the first of them begins."""
    return F.transform(F.filter(turns, lambda t: t.role == TRAINED_ROLE), lambda t: F.struct(
        (t.stop - before - len(AFTER + END) - F.length(t.text)).alias("start"),
        (t.stop - before - len(AFTER)).alias("stop")))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``prompt``, and for both conversations of each ``pair_id`` completion and mask.

    Both sides have rows (``pair_id``, ``turn``, ``role``, ``text``). The prompt is the
    longest run of leading turns with equal role and text, rendered once; the rest of
    each conversation is its completion, with the spans of assistant text to train on.
    Built-in functions only; a row holds one pair's conversations.

    Turns are ordered by number, then role, then text, so ties and repeated rows have one
    order. A null role is a user's, a null text is empty, turns without ``pair_id`` are
    left out. A pair with one side only has an empty prompt and the other completion
    empty; equal conversations are all prompt. Other columns are not read.
    """
    pairs = _turns(chosen, "chosen_turns").join(_turns(rejected, "rejected_turns"), "pair_id", "full")
    empty = F.array().cast(_TURNS)
    pairs = pairs.withColumns({n: F.coalesce(n, empty) for n in ("chosen_turns", "rejected_turns")})
    differs = F.array_position(F.zip_with(
        "chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False))), False)
    shared = F.when(differs == 0, F.size("chosen_turns")).otherwise(differs - 1).cast("int")
    pairs = pairs.withColumn("shared_turns", shared)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    before = F.when(shared > 0, F.element_at("chosen_turns", F.col("shared_turns")).stop).otherwise(0)
    columns = []
    for name in ("chosen", "rejected"):
        turns = F.col(f"{name}_turns")
        rest, some = F.slice(turns, F.col("shared_turns") + 1, F.size(turns)), F.size(turns) > F.col("shared_turns")
        columns += [
            F.when(some, _rendered(rest)).otherwise("").alias(name),
            F.when(some, _mask(rest, before)).otherwise(none).alias(f"{name}_mask"),
        ]
    prompt = _rendered(F.slice("chosen_turns", F.lit(1), F.col("shared_turns")))
    return pairs.select("pair_id", "shared_turns", prompt.alias("prompt"), *columns)


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation as chosen; as rejected, its turns up to its last assistant's, which
    is the last one of its neighbour instead (2 i and 2 i + 1 are neighbours)."""
    own = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = own.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    before = own.join(last, "pair_id").where(F.col("turn") < F.col("last.turn")).select(own.columns)
    swap = F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id")
    other = last.select(swap, F.col("last.text").alias("text")).join(
        last.select("pair_id", F.col("last.turn").alias("turn")), "pair_id"
    ).select("pair_id", "turn", F.lit(TRAINED_ROLE).alias("role"), "text")
    return own, before.unionByName(other)


def op4_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, each with its neighbour's last reply as rejected."""
    pairs = format_preferences(*swapped_replies(table(spark, sf_dir, "conversations")))

    def spans(name: str) -> Column:
        return F.array_join(F.transform(
            name, lambda s: F.concat_ws("-", s.start.cast("string"), s.stop.cast("string"))), ",").alias(name)

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "shared_turns", "prompt", "chosen", "rejected",
        spans("chosen_mask"), spans("rejected_mask"))


QUERIES = {"op4_chat_pairs": op4_chat_pairs}
SQL = {"op4_chat_pairs": """
with last as (
  select conv_id, max(turn) as turn, max_by(reply, (turn, reply)) as reply
  from (select conv_id, turn, coalesce(text, '') as reply from conversations
        where role = 'assistant' and conv_id is not null)
  group by conv_id),
sides as (
  select 'chosen' as side, conv_id, turn, role, text from conversations where conv_id is not null
  union all
  select 'rejected', c.conv_id, c.turn, c.role, c.text
  from conversations c join last l on l.conv_id = c.conv_id and c.turn < l.turn
  union all
  select 'rejected', l.conv_id, l.turn, 'assistant', o.reply
  from last l join last o on o.conv_id = xor(l.conv_id, 1)),
numbered as (
  select side, conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text,
    row_number() over (partition by side, conv_id order by turn, coalesce(role, 'user'), coalesce(text, '')) as i
  from sides),
ids as (select distinct conv_id from numbered),
differs as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, min(coalesce(c.i, r.i)) as i
  from (select * from numbered where side = 'chosen') c
  full join (select * from numbered where side = 'rejected') r on c.conv_id = r.conv_id and c.i = r.i
  where c.i is null or r.i is null or c.role <> r.role or c.text <> r.text
  group by 1),
lengths as (select conv_id, max(i) as n from numbered where side = 'chosen' group by conv_id),
shared as (
  select ids.conv_id, coalesce(d.i - 1, l.n, 0) as shared_turns
  from ids left join differs d using (conv_id) left join lengths l using (conv_id)),
rendered as (
  select n.*, s.shared_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown
  from numbered n join shared s using (conv_id)),
placed as (
  select *, sum(length(shown)) over (partition by side, conv_id order by i) as stop from rendered where i > shared_turns),
done as (
  select conv_id, side, string_agg(shown, '' order by i) as completion,
    coalesce(string_agg(case when role = 'assistant' then
      (stop - 8 - length(text))::bigint::varchar || '-' || (stop - 1)::bigint::varchar end, ',' order by i), '') as mask
  from placed group by conv_id, side),
prompts as (
  select conv_id, string_agg(shown, '' order by i) as prompt
  from rendered where side = 'chosen' and i <= shared_turns group by conv_id)
select s.conv_id, s.shared_turns::integer as shared_turns, coalesce(prompt, '') as prompt,
  coalesce(c.completion, '') as chosen, coalesce(r.completion, '') as rejected,
  coalesce(c.mask, '') as chosen_mask, coalesce(r.mask, '') as rejected_mask
from shared s left join prompts using (conv_id)
left join done c on c.conv_id = s.conv_id and c.side = 'chosen'
left join done r on r.conv_id = s.conv_id and r.side = 'rejected'
"""}
