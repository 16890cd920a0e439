"""Logged conversations: snapshots that a longer one contains are dropped, the rest rendered.

A chat is often logged anew at each turn, with all turns so far. Every turn gets a hash of
its conversation's beginning up to it (a running sum of two independent hashes of place,
role and text, so that it needs no list of turns). A conversation whose hash is that of a
proper beginning of another one goes by an anti-join; of equal ones the least id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _defused(text: Column) -> Column:
    """Marks written in a text are no marks: a blank parts them."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _hashes(sums=lambda x: x) -> dict[str, Column]:
    """``h1`` and ``h2`` of a turn, or what ``sums`` makes of them over turns."""
    return {name: sums(F.xxhash64(F.lit(salt), "place", "role", "text").cast("decimal(20,0)")) for name, salt in (("h1", 1), ("h2", 2))}


def _filled(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2, last) of every turn: its place from 1 by turn,
    role and text, the hashes of all turns up to it, and whether it is the last."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _filled(turns).withColumn("place", F.row_number().over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    until = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns(_hashes(lambda x: F.sum(x).over(until).cast("decimal(30,0)"))).drop("turn")


def _said(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _defused(role), F.lit("\n"), _defused(text), F.lit(CLOSE + "\n"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat): the turns by place, each between marks."""
    said = _said(F.col("role"), F.col("text")).alias("said")
    rows = turns.select("conv_id", F.struct("place", said).alias("turn"))
    done = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.said", "").alias("chat"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of the conversations that no longer one begins with.

    Turns are ordered by ``turn`` (null first), then role and text; repeated rows stay.
    Null roles and texts count as empty. A row without a conversation id is a conversation of
    one turn; equal ones are reported once, and only if no conversation begins with this turn.
    Other columns are not looked at; no rows give no rows. A chat becomes one string, so its
    turns meet in one task.
    """
    prefixes = turn_prefixes(turns.where("conv_id is not null"))
    hashes = ["h1", "h2", "place"]
    lone = _filled(turns.where("conv_id is null")).withColumn("place", F.lit(1))
    lone = lone.withColumns(_hashes(lambda x: x.cast("decimal(30,0)")))
    ends = prefixes.where("last").select(*hashes, "conv_id").unionByName(lone.select(*hashes, "conv_id", F.struct("role", "text").alias("only")), allowMissingColumns=True)
    wholes = ends.groupBy(*hashes).agg(F.min("conv_id").alias("kept"), F.min("only").alias("only"))
    longer = prefixes.where("not last").select(*hashes).distinct()
    maximal = wholes.join(longer, hashes, "left_anti")
    own = prefixes.join(maximal.where("kept is not null").select("kept"), F.col("conv_id") == F.col("kept")).drop("kept")
    single = maximal.where("kept is null").select(
        F.col("kept").alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), _said(F.col("only.role"), F.col("only.text")).alias("chat")
    )
    return render(own).unionByName(single)


ORACLE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
         '{OPEN}' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '{CLOSE}' || chr(10) as said
  from conversations
), prefixes as (
  select conv_id, place, string_agg(said, '') over (partition by conv_id order by place rows unbounded preceding) as chat,
         count(*) over (partition by conv_id) as n_turns
  from turns
), wholes as (
  select chat, place as n_turns, min(conv_id) as conv_id from prefixes where place = n_turns group by 1, 2
)
select conv_id, n_turns, chat from wholes w
where not exists (select 1 from prefixes p where p.place < p.n_turns and p.place = w.n_turns and p.chat = w.chat)
"""
