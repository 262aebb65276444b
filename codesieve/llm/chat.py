"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans at turn ends. Each span becomes a window:
the system turn again, the last turns before the span that still fit as history, then the span's
own turns. Only assistant texts of own turns are under the loss mask, so every target counts once.
A window passes the budget only where its system turn and its one own turn alone do.

A turn is written as ``<|start|>role`` line end ``text<|end|>`` line end. Control strings inside a
text get a backslash after their first character, and one more if they have some already, which is
undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import WORD, staged

BUDGET = 512
HISTORY_TURNS = 2
#: A span leaves one part in this many of its room to history.
HISTORY_PART = 4
#: Turn numbers behind one partial sum; a long conversation is many of these.
CHUNK_TURNS = 256

START, END = "<|start|>", "<|end|>"
# Control strings of common chat templates, without their first character.
_CONTROL = r"(?=\||/?s>|</?SYS>>|/?INST\]|start_of_turn>|end_of_turn>)"
_ESCAPE = re.compile(rf"([<\[])(\\*){_CONTROL}")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(r"<\|start\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text of (role, text, repeated) turns and the spans of code points under the loss."""
    out, at, loss = [], 0, []
    for role, text, repeated in turns:
        head, body = f"{START}{quote(role, safe=' ')}\n", escape(text)
        if role == "assistant" and not repeated:
            loss.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unquote(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def turn_tokens(text: Column) -> Column:
    """Words and a mark at either end."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 2


def numbered_turns(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS,
                   tokens: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, seq, span, role, text, system, start, end, room): turns in order with their span.

    Order is by turn (null first), role and text. start and end are prefix sums of tokens without the
    system turn's; room is what that leaves of the budget. The sums are laid on cells of the room,
    less a part for history. Turns inside a cell are one span. A turn that crosses into another cell
    joins them where they fit into a cell's size together, and is a span of its own otherwise. So a
    span of several turns is no larger than a cell; a turn larger than a cell is alone. Sums run
    over chunks of turn numbers first, then over the chunks, so no task holds a long conversation.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "tokens": (turn_tokens(F.col("text")) if tokens is None else tokens).cast("long"),
        "chunk": F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62))).cast("long")})
    within = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"own": F.row_number().over(within) - 1,
                             "sum": F.coalesce(F.sum("tokens").over(before), F.lit(0))})
    rows = staged(rows, "chat-turns")
    along = Window.partitionBy("conv").orderBy("chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"),
        F.coalesce(F.max(F.when((F.col("own") == 0) & (F.col("role") == "system"), F.col("tokens"))), F.lit(0)).alias("head"))
    chunks = chunks.select(
        F.col("conv").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.first("head").over(along).alias("head"))
    joined = rows.join(chunks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    numbered = joined.withColumns({
        "seq": F.col("n") + F.col("own"), "room": F.lit(budget) - F.col("head"),
        "start": F.col("t") + F.col("sum") - F.col("head")})
    numbered = numbered.withColumns({
        "system": (F.col("seq") == 0) & (F.col("role") == "system"),
        "start": F.greatest("start", F.lit(0)),
        "size": F.greatest(F.col("room") - (F.floor(F.col("room") / HISTORY_PART) if history > 0 else F.lit(0)), F.lit(1))})
    numbered = numbered.withColumns({
        "end": F.col("start") + F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens")),
        "cell": F.floor(F.col("start") / F.col("size"))})
    # The turns that start in a cell: no more than half its size, as each has two tokens or more.
    first = F.min("start").over(Window.partitionBy("conv", "cell"))
    last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / F.col("size"))
    alone = (last > F.col("cell")) & (F.col("end") - first > F.col("size")) & (F.col("start") > first)
    return numbered.select("conv", "seq", (2 * F.col("cell") + alone.cast("long")).alias("span"), "role", "text",
                           "system", "start", "end", "room")


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS, **columns) -> DataFrame:
    """(conv, window, formatted, loss, repeated): one row per window of each conversation.

    formatted is the text; loss the (start, end) code points under the mask; repeated says for each
    turn of the window whether an earlier window had it as its own. The system turn is a first turn
    of role ``system`` and is in every window. Of the last ``history`` turns before a span those
    nearest to it are repeated that fit into what system turn and span leave of the budget. Only a
    window of one own turn (and the system turn) can pass the budget, and has no history then.
    Windows are numbered upwards with gaps. Null role and text are empty; a null conversation is
    one like others; repeated rows are turns of their own. An empty table gives an empty result.
    """
    own = staged(numbered_turns(turns, budget, history, **columns), "chat-numbered")
    firsts = own.groupBy("conv", "span").agg(
        F.min("seq").alias("first"), F.min("start").alias("begin"), F.max("end").alias("until")).where("first > 0").select(
        F.col("conv").alias("c"), F.col("span").alias("s"), "first", "begin", "until")
    # By place and conversation, so that the turns of one conversation are spread.
    # Without history the sequence would count down.
    past = firsts.where(F.lit(history > 0))
    wanted = past.withColumn("q", F.explode(F.sequence(F.col("first") - max(history, 1), F.col("first") - 1))).where("q >= 0")
    context = own.where("NOT system").join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("q")))
    context = context.where("until - start <= room")
    system = own.where("system").drop("span").join(firsts, F.col("conv").eqNullSafe(F.col("c")))
    pick = lambda df, span, repeated: df.select(
        "conv", F.col(span).alias("window"), F.struct("seq", "role", "text", F.lit(repeated).alias("repeated")).alias("turn"))
    every = pick(own, "span", False).unionByName(pick(context, "s", True)).unionByName(pick(system, "s", True))
    # A window holds a budget of turns, or one turn and the system turn.
    windows = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [format_turns([(t["role"], t["text"], t["repeated"]) for t in turns])
                    for turns in batch.column(2).to_pylist()]
            repeated = [[t["repeated"] for t in turns] for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], span),
                pa.array(repeated, pa.list_(pa.bool_()))], ["conv", "window", "formatted", "loss", "repeated"])

    kind = windows.schema["conv"].dataType.simpleString()
    return windows.mapInArrow(write, f"conv {kind}, window long, formatted string, "
                              "loss array<struct<start:long,end:long>>, repeated array<boolean>")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Windows stream in order; only the digests of a conversation are kept."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state = None, None

        def row():
            conv, n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_arrays([
                pa.array([conv], kind), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]),
                pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([formatted], pa.int64())],
                ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv"]:
                    if state is not None:
                        yield row()
                    state = [r["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for (role, text), repeated in zip(parse_turns(r["formatted"]), r["repeated"], strict=True):
                    if not repeated:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = unescape(r["formatted"][span["start"]:span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
        if state is not None:
            yield row()

    kind = windows.schema["conv"].dataType.simpleString()
    return windows.repartition("conv").sortWithinPartitions("conv", "window").mapInArrow(
        digests, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
