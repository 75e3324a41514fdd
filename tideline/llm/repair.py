"""Repair of conversation structure: the cheapest edits that make a well-formed dialogue, by a fold over each conversation's turns.

A repaired conversation is empty or an optional system turn followed by user and assistant in alternation, ending with the assistant.
Windows flag what is wrong with each turn; the turns of a conversation are then collected in order and folded by ``aggregate``, which
carries for each of four ends of the text so far (nothing, system, user, assistant) the cheapest edits that lead there, as structs of (cost, audit).
Of equal costs the least audit wins; two audits of the same turns and cost are never one the beginning of the other, since what the longer
one had more would be inserts, so the least beginning always leads to the least whole.

A conversation is one array by this method, its audit one string: both are bound by Spark's 2 GB a row, and the fold takes time in the square of
the turns (ten thousand take seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what an undeleted truncated turn adds.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 40
_STATE = "struct<cost:bigint,audit:string>"


def _then(state: str, cost: str, letters: str) -> str:
    return f"named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, '{letters}'))"


def _inserted(v: str) -> str:
    """The four states where turns may be inserted behind what is there; more than two in a row would come back to the same end."""
    user = f"least({v}.u, {_then(f'{v}.n', INSERT, 'I')}, {_then(f'{v}.s', INSERT, 'I')}, {_then(f'{v}.a', INSERT, 'I')})"
    assistant = f"least({v}.a, {_then(f'{v}.u', INSERT, 'I')}, {_then(f'{v}.n', 2 * INSERT, 'II')}, {_then(f'{v}.s', 2 * INSERT, 'II')})"
    return f"named_struct('n', {v}.n, 's', {v}.s, 'u', {user}, 'a', {assistant})"


def _fold() -> str:
    deleted = lambda s: _then(s, DELETE, "D")
    never = f"cast(named_struct('cost', {_NEVER}L, 'audit', '') as {_STATE})"
    before_user = "least(v.n, v.s, v.a)"

    def taken(state: str, initial: str) -> str:
        keep, relabel = _then(state, "x.extra", "K"), _then(state, f"({RELABEL} + x.extra)", "R")
        return f"case when x.lost then {never} when x.initial = '{initial}' then {keep} else {relabel} end"

    system = f"if(not x.lost and x.initial = 's', {_then('v.n', 'x.extra', 'K')}, {never})"
    step = f"named_struct('n', {deleted('v.n')}, 's', least({deleted('v.s')}, {system}), 'u', least({deleted('v.u')}, {taken(before_user, 'u')}), 'a', least({deleted('v.a')}, {taken('v.u', 'a')}))"
    start = f"named_struct('n', cast(named_struct('cost', 0L, 'audit', '') as {_STATE}), 's', {never}, 'u', cast(named_struct('cost', {INSERT}L, 'audit', 'I') as {_STATE}), 'a', cast(named_struct('cost', {2 * INSERT}L, 'audit', 'II') as {_STATE}))"
    return f"aggregate(turns, {start}, (v, x) -> element_at(transform(array({step}), w -> {_inserted('w')}), 1), v -> least(v.n, v.a))"


#: The repaired turns, read off the audit: what is relabelled or inserted is a user after nothing, system or assistant, else an assistant.
_REPLAY = """aggregate(split(audit, ''), named_struct('at', 0, 'last', '', 'out', cast(array() as array<struct<role:string,text:string>>)),
  (v, e) -> if(e = '', v, named_struct(
    'at', v.at + if(e = 'I', 0, 1),
    'last', case when e = 'D' then v.last when e = 'K' then turns[v.at].initial when v.last = 'u' then 'a' else 'u' end,
    'out', if(e = 'D', v.out, array_append(v.out, named_struct(
      'role', case when e = 'K' then turns[v.at].role when v.last = 'u' then 'assistant' else 'user' end,
      'text', if(e = 'I', '', turns[v.at].text)))))),
  v -> v.out)"""


def flagged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with ``place`` in the conversation, ``initial`` of the role, ``fault`` and ``illegal``.

    Order is by turn, nulls first, then role and text.  ``fault`` is the first that holds of blank (nothing but white space), duplicate (role
    and text stand before in the conversation) and truncated (does not end with a full stop, exclamation or question mark); else null.
    ``illegal`` marks a turn whose initial may not follow that of the turn before.  Null roles and texts are one space.  Where there is a
    column ``gone``, rows for which it is true are not turns, and only keep their conv_id in the result.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    rows = rows.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1))
    order = Window.partitionBy("conv_id", "gone").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("pair", F.concat(F.lag("initial").over(order), F.col("initial")))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")) > 1
    core = F.rtrim("text", F.lit(SPACE))
    fault = F.when(core == "", "blank").when(again, "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).withColumn("illegal", F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))).drop("pair")


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, ``repaired(role, text)``.

    ``audit`` has a letter for each edit in order: Keep, Rerole to user or assistant, Delete, Insert of an empty user or assistant turn.
    Blank and duplicate turns must be deleted.  Roles other than system, user and assistant go by their initial, and cannot be kept where that
    is another.  ``gaps`` counts the numbers between the least and the greatest turn that no turn has.  Rows with a null conv_id are one
    conversation; equal rows are turns of their own; a conversation of lost turns only has zeros, an empty audit and no turns; further
    columns are not read; no rows give no rows.
    """
    own = ~F.col("gone")
    count = lambda c: F.count_if(own & c).alias
    turn = F.struct("place", "initial", "role", "text", F.col("fault").isin("blank", "duplicate").alias("lost"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).cast("long").alias("extra"))
    turn = turn.withField("lost", F.coalesce(turn["lost"], F.lit(False)))
    span = F.max(F.when(own, F.col("turn"))) - F.min(F.when(own, F.col("turn"))) + 1 - F.count_distinct(F.when(own, F.col("turn")))
    rows = flagged(turns)
    found = rows.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"))("illegal"),
        F.array_sort(F.collect_list(F.when(own, turn))).alias("turns"),
    )
    found = found.withColumn("best", F.expr(_fold())).withColumn("cost", F.col("best.cost")).withColumn("audit", F.col("best.audit"))
    return found.withColumn("repaired", F.expr(_REPLAY)).drop("best", "turns")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with faults planted by a checksum of conversation and turn, and ``gone``.

    Of twenty turns one each is lost, emptied, stripped of its full stops, repeated, and given to the user.  Nulls are one space in the
    checksum and in role and text; lost turns stay as rows with ``gone``, so that no conversation vanishes.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), roll.alias("roll"))
    text = F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("roll") == 4, "user").otherwise(F.col("role")))
    copies: Column = F.explode(F.sequence(F.lit(1), F.when(F.col("roll") == 3, 2).otherwise(1)))
    return rows.withColumn("copy", copies).select("conv_id", "turn", "role", "text", (F.col("roll") == 0).alias("gone"))


def repair_digests(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged turns, with a digest of the repaired text (``role:text`` of each turn, joined by newlines) in place of the turns."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair(damaged(turns)).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n").cast("binary"), 256)).drop("repaired")
