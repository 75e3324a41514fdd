"""Chat formatting in budgeted windows.

Turns are rendered with a template of control strings; control strings inside texts are escaped so that they can be read
back.  Each rendered turn is counted once, frame and role included; prefix sums of the counts choose spans of whole turns that fit the budget.  Each window keeps the
conversation's system turn, repeats a limited history before its own turns, and marks as targets only those
assistant texts that no window before it has.

A conversation is cut into blocks of ``BLOCK`` turns by its turns' ranks, and each block is laid out on its own with the
history handed over from the block before, so a conversation that holds most rows is shared out over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import tokens
from tideline.llm.ordered import global_rank
from tideline.llm.scratch import materialize

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 384
BLOCK = 256
WINDOWS = "conv_id long, block long, window int, formatted string, tokens long, turns array<struct<at:long,text_start:int,text_end:int,repeated:boolean,target:boolean>>"


def escape(text: str) -> str:
    """``<|`` gains a backslash inside, one more where it has some already, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on a line of their own."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its escaped text begins and ends.

    A turn ends with a line end after a mark and the next begins with a mark, so the tokens of a window are the sum of its turns'.
    """
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


@dataclass(frozen=True)
class _Turn:
    at: int
    role: str
    text: str
    tokens: int
    upto: int  # tokens of the block's turns up to and with this one


class _Layout:
    """Windows of one block of turns, one turn at a time; holds no more than a window and its history.

    With ``upto`` as prefix sums, turns i to j of a block take upto(j) - upto(i - 1) tokens; a window that opens at turn i takes turns
    as long as that and what it repeats stay within the budget.
    """

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.history_turns, self.history_tokens = budget, history_turns, history_tokens
        self.system: _Turn | None = None
        self.past: list[_Turn] = []
        self.repeated: list[_Turn] = []
        self.own: list[_Turn] = []
        self.head, self.count = 0, 0

    def _used(self, last: _Turn) -> int:
        """Tokens of the window with its own turns up to ``last``."""
        return self.head + last.upto - (self.own[0].upto - self.own[0].tokens)

    def _open(self, turn: _Turn) -> None:
        """Start a window for ``turn``: the system turn, then as much history as leaves room for it."""
        fixed = [self.system] if self.system and self.system.at != turn.at else []
        room = min(self.history_tokens, self.budget - sum(t.tokens for t in fixed) - turn.tokens)
        past = [t for t in self.past[-self.history_turns :] if t.at != (self.system.at if self.system else None)] if self.history_turns else []
        back = [t for t, left in zip(past, _left_sums(past), strict=True) if left <= room]
        self.repeated, self.own = fixed + back, [turn]
        self.head = sum(t.tokens for t in self.repeated)

    def context(self, turn: _Turn, system: bool) -> None:
        if system:
            self.system = turn
        else:
            self.past.append(turn)

    def add(self, turn: _Turn, system: bool) -> tuple | None:
        """Take a turn; the window that is full without it, if one is."""
        if system:
            self.system = turn
        done = None
        if self.own and self._used(turn) > self.budget:
            done = self.close()
        if self.own:
            self.own.append(turn)
        else:
            self._open(turn)
        self.past = [*self.past, turn][-max(1, self.history_turns) :]
        return done

    def close(self) -> tuple:
        used = self._used(self.own[-1])
        out, spans, at = [], [], 0
        for k, t in enumerate([*self.repeated, *self.own]):
            text, start, end = render(t.role, t.text)
            repeated = k < len(self.repeated)
            spans.append({"at": t.at, "text_start": at + start, "text_end": at + end, "repeated": repeated, "target": t.role == TARGET and not repeated})
            out.append(text)
            at += len(text)
        done = ("".join(out), used, spans, self.count)
        self.repeated, self.own, self.count = [], [], self.count + 1
        return done


def _left_sums(turns: list[_Turn]) -> list[int]:
    """The tokens of each turn and all that follow it."""
    return list(accumulate(t.tokens for t in reversed(turns)))[::-1]


_ARROW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("tokens", pa.int64()), ("turns", pa.list_(pa.struct([("at", pa.int64()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("repeated", pa.bool_()), ("target", pa.bool_())])))])


def _lay_out(budget: int, history_turns: int, history_tokens: int):
    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, layout, rows = None, None, []

        def put(window: tuple) -> None:
            text, n, spans, count = window
            rows.append({"conv_id": key[0], "block": key[1], "window": count, "formatted": text, "tokens": n, "turns": spans})

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["conv_id"], r["block"])
                if own != key:
                    if layout and layout.own:
                        put(layout.close())
                    key, layout = own, _Layout(budget, history_turns, history_tokens)
                turn = _Turn(r["at"], r["role"], r["text"], r["tokens"], r["upto"])
                if r["context"]:
                    layout.context(turn, r["is_system"])
                elif done := layout.add(turn, r["is_system"]):
                    put(done)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
        if layout and layout.own:
            put(layout.close())
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return lay_out


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.counter(path)
        for batch in batches:
            done: list[int] = []
            for texts in tokens._strings(batch.column("text")):
                roles = batch.column("role").slice(len(done), len(texts)).to_pylist()
                done += [int(p[-1]) for p in of.count([render(role, text)[0] for role, text in zip(roles, texts, strict=True)])]
            yield pa.record_batch([*batch.columns, pa.array(done, pa.int64())], names=[*batch.schema.names, "tokens"])

    return count


def format_windows(turns: DataFrame, path: str, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows of every conversation of ``turns(conv_id, turn, role, text)``, under the tokenizer at ``path``.

    ``formatted`` is the text; ``turns`` tells of each turn its rank in the conversation, where its escaped text stands, and
    whether it is repeated or a target.  ``tokens`` is what the tokenizer counts in ``formatted``; it stays within ``budget`` unless a
    single turn (with the system turn) goes beyond it: turns are never cut.

    Turns go by turn (null first), then role and text; null roles and texts are empty, a null conv_id is a conversation of
    its own.  The first turn is the system turn if its role is system.  Empty tables give no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    counted = materialize(rows.mapInArrow(_count(path), T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType())])), "counted")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ranked = global_rank(counted, order, "turns")
    firsts = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")).withColumnRenamed("conv_id", "of")
    placed = ranked.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("at", F.col("rank") - F.col("first"))
    is_system = (F.col("at") == 0) & (F.col("role") == SYSTEM)
    own = F.floor(F.col("at") / BLOCK)
    last = F.floor((F.col("n") - 1) / BLOCK)
    hands_on = (F.col("at") % BLOCK >= BLOCK - history_turns) & (own < last)
    blocks = F.when(is_system, F.sequence(F.lit(0).cast("long"), last)).when(hands_on, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.select("conv_id", "at", "role", "text", "tokens", is_system.alias("is_system"), own.alias("own"), F.explode(blocks).alias("block"))
    context = F.col("own") != F.col("block")
    dealt = dealt.select("conv_id", "block", "at", "role", "text", "tokens", "is_system", context.alias("context")).repartition("conv_id", "block")
    upto = F.sum(F.when(~F.col("context"), F.col("tokens")).otherwise(0)).over(Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("upto", upto).sortWithinPartitions("conv_id", "block", "at").mapInArrow(_lay_out(budget, history_turns, history_tokens), WINDOWS)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_window(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted window, unescaped; start and end bound the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    key, state, rows = (), None, []

    def put() -> None:
        n, all_, chars, loss, formatted = state
        rows.append(dict(zip(names, (key[0], n, all_.hexdigest(), chars, loss.hexdigest(), formatted), strict=True)))

    for batch in batches:
        for r in batch.to_pylist():
            if (r["conv_id"],) != key:
                if state:
                    put()
                key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(r["formatted"])
            for (role, text, start, end), span in zip(read_window(r["formatted"]), r["turns"], strict=True):
                if (start, end) != (span["text_start"], span["text_end"]):
                    raise ValueError("a span does not bound its text")
                if not span["repeated"]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if span["target"]:
                    state[2] += len(text)
                    state[3].update(text.encode())
        yield pa.RecordBatch.from_pylist(rows, schema)
        rows = []
    if state:
        put()
    yield pa.RecordBatch.from_pylist(rows, schema)


def read_digests(windows: DataFrame) -> DataFrame:
    """What is read back from ``format_windows``, per conversation: turns, hashes of turns and targets, characters.

    A window that cannot be read back, or whose spans do not bound its texts, is an error.  A null conv_id is a conversation; no
    windows give no rows.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(_digest, schema)


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts are control strings.

    Rows that are there keep their nulls and their number; a given conversation -1 gets the two turns beside its own, as turns 0 and 1; of an empty table
    only the two are left; other columns are dropped.
    """
    text = f"{END}{START}{TARGET} ok"
    turn = lambda n, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    more = conversations.sparkSession.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, TARGET))))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
