"""Chat formatting in budgeted windows.

A conversation is cut into windows of at most ``budget`` tokens, counted in turns as
they are formatted (escaped, with their marks); the tokenizer drops the white space
between turns, so a window has as many tokens as its turns.  Prefix sums of these
counts choose each window's span by binary search, so windows begin and end at turns.  Every window keeps the conversation's system turn, repeats a limited
history (the last turns before its span, at most ``history_turns`` and
``history_tokens``), and then has turns of its own.  The loss mask covers the texts
of assistant turns of its own; repeated targets are masked out, so over a
conversation each assistant text is learned once.  A turn that passes the budget by
itself has a window of its own, whole.

The template marks turns; control strings within texts and roles are escaped, and
``parse`` reverses both.

Prefix sums over a whole conversation also cut it into segments: a turn belongs to
segment floor(tokens before it / ``segment_tokens``).  A window ends with its segment,
while history and the system turn reach across; that is a rule of the format, the same
at every size.  Segments are formatted apart, so a conversation of any length is dealt
over tasks, and a task holds one segment.  The sums come in two levels, by ranges of
turn numbers and then inside a range, so no task sorts a conversation.  Tasks read
segments as sorted streams.  The query's digest of a whole conversation is a sequential
hash, so it streams that conversation's windows through one task in constant memory;
the formatting itself does not.

Defined results: a null text or role is empty; turns of one number are ordered by
role and text; null turn numbers come last; rows of a null conv_id are one
conversation; repeated rows are turns of their own; a conversation without
assistant turns has an empty mask; an empty table gives an empty result; extra
columns are ignored; a text of any length is one turn, held by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, tasks_for
from .tokens import SpacedTokens, default_path

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 512
SEGMENT_TOKENS = 16 * BUDGET
#: Turn numbers whose turns are summed together.
RANGE = 1 << 10
#: Head and tail of a turn by role; any other role is named in its head.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]\n"), "assistant": ("[ANS] ", " </s>\n")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]\n")
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(
    r"<<SYS>> (?P<system>.*?) <</SYS>>\n|<s>\[INST\] (?P<user>.*?) \[/INST\]\n|\[ANS\] (?P<assistant>.*?) </s>\n|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\]\n",
    re.DOTALL,
)


def escape(text: str) -> str:
    r"""A backslash becomes \b; a control string gets \e after its first character."""
    return _CONTROL.sub(lambda m: r"\b" if m[0] == "\\" else f"{m[0][0]}\\e{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([be])", lambda m: "\\" if m[1] == "b" else "", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn.  Raises ``ValueError`` at anything that is no turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return out


def windows(tokens: list[int], own: int, system: int, budget: int, history_turns: int, history_tokens: int) -> Iterator[tuple[int, int, int]]:
    """(first turn of the history, first turn of its own, end) of each window.

    ``tokens`` of all turns without the system turn; those before ``own`` are
    context, for history only.
    """
    sums = np.concatenate(([0], np.cumsum(tokens)))
    at = own
    while at < len(tokens):
        room = budget - system
        past = max(at - history_turns, int(np.searchsorted(sums, sums[at] - history_tokens)))
        # History gives way where the next turn wouldn't fit beside it.
        past = min(at, max(past, int(np.searchsorted(sums, sums[at + 1] - room))))
        end = max(at + 1, int(np.searchsorted(sums, sums[past] + room, side="right")) - 1)
        yield past, at, end
        at = end


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = SpacedTokens.at(path)
        for batch in batches:
            n = []
            for lo in range(0, batch.num_rows, 256):
                rows = zip(*(batch.column(i).slice(lo, 256).to_pylist() for i in (2, 3)))
                n += [len(tokens.ids(turn(role, text)[0])) // 4 for role, text in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "tokens"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, of a sorted stream."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and any(rows[-1][k] != row[k] for k in keys):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


WINDOW_SCHEMA = "conv_id long, block long, window int, repeated int, formatted string, mask array<struct<begin:int,end:int>>"


def _format(budget: int, history_turns: int, history_tokens: int):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("conv_id", "block")):
            # kind 0: the system turn, 1: context, 2: turns of the block
            system = [r for r in rows if r["kind"] == 0]
            if not system and rows[0]["first"] and rows[0]["role"] == "system":
                system = rows[:1]
            turns = [r for r in rows if r["kind"] > 0 and r is not (system[0] if system else None)]
            own = sum(r["kind"] == 1 for r in turns)
            in_block = bool(system) and system[0]["kind"] == 2
            spans = list(windows([r["tokens"] for r in turns], own, sum(r["tokens"] for r in system), budget, history_turns, history_tokens))
            if not spans and in_block:
                spans = [(own, own, own)]
            for number, (past, at, end) in enumerate(spans):
                text, mask = [], []
                length = 0
                for i, r in enumerate([*system, *turns[past:end]]):
                    part, a, b = turn(r["role"], r["text"])
                    if r["role"] == "assistant" and i >= len(system) + at - past:
                        mask.append({"begin": length + a, "end": length + b})
                    text.append(part)
                    length += len(part)
                repeated = at - past + (len(system) if not in_block or number else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[0]["conv_id"]], pa.int64()), pa.array([rows[0]["block"]], pa.int64()), pa.array([number], pa.int32()), pa.array([repeated], pa.int32()), pa.array(["".join(text)]), pa.array([mask], kind)],
                    ["conv_id", "block", "window", "repeated", "formatted", "mask"],
                )

    return run


def _segments(rows: DataFrame, segment_tokens: int) -> DataFrame:
    """Adds ``block``, the segment of each turn.  Only conversations of more than one segment are put in order for it."""
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(1 << 62)))
    sums = staged(rows.groupBy("conv_id", "_range").agg(F.sum("tokens").alias("n")), "chat-sums")
    long_ = staged(sums.groupBy("conv_id").agg(F.sum("n").alias("n")).where(F.col("n") > segment_tokens).select(F.col("conv_id").alias("long_id")), "chat-long")
    is_long = rows.conv_id.eqNullSafe(F.col("long_id"))
    short = rows.join(long_, is_long, "left_anti").withColumn("block", F.lit(0).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.join(long_, sums.conv_id.eqNullSafe(F.col("long_id")), "left_semi").select(
        F.col("conv_id").alias("range_conv"), F.col("_range").alias("range_id"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("conv_id", "_range").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    among = rows.join(long_, is_long, "left_semi").withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    among = among.join(ranges, among.conv_id.eqNullSafe(F.col("range_conv")) & (among["_range"] == F.col("range_id")))
    among = among.withColumn("block", F.floor((F.col("_before") + F.col("_in")) / segment_tokens))
    names = ["conv_id", "turn", "role", "text", "tokens", "block"]
    return short.select(*names).unionByName(among.select(*names))


def format_windows(
    conversations: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS, segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """One row per window: ``conv_id, block, window, repeated, formatted, mask``; ``block`` is the window's segment.

    ``repeated``: turns at the window's head that an earlier window has; ``mask``:
    ranges of characters in ``formatted`` that the loss covers.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    path = tokenizer or default_path("word_bpe_49k.json")
    rows = staged(rows.mapInArrow(_sizes(path), "conv_id long, turn long, role string, text string, tokens long"), "chat-turns")
    rows = _segments(rows, segment_tokens)
    blocks = staged(rows.select("conv_id", "block").distinct(), "chat-blocks")
    per = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select("conv_id", "block", F.lead("block").over(per).alias("next"), F.row_number().over(per).alias("place"))
    several = staged(blocks.where("next is not null or place > 1"), "chat-several").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "next", "place")
    same = rows.conv_id.eqNullSafe(F.col("c")) & (rows.block == F.col("b"))
    base = rows.join(several, same, "left").withColumn("first", F.coalesce(F.col("place") == 1, F.lit(True)))
    plain = base.select("conv_id", "block", F.lit(2).alias("kind"), "turn", "role", "text", "tokens", "first")
    inside = Window.partitionBy("conv_id", "block")
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    ends = [F.col("turn").desc_nulls_first(), F.col("role").desc(), F.col("text").desc()]
    long_ = base.where("place is not null")
    context = (
        long_.where("next is not null").withColumn("_n", F.row_number().over(inside.orderBy(*ends))).where(F.col("_n") <= history_turns)
        .select("conv_id", F.col("next").alias("block"), F.lit(1).alias("kind"), "turn", "role", "text", "tokens", F.lit(False).alias("first"))
    )
    heads = long_.where("first").withColumn("_n", F.row_number().over(inside.orderBy(*order))).where("_n = 1 and role = 'system'")
    heads = heads.select(F.col("conv_id").alias("head_id"), "turn", "role", "text", "tokens")
    later = several.where("place > 1")
    head_rows = later.join(heads, later.c.eqNullSafe(F.col("head_id"))).select(
        F.col("c").alias("conv_id"), F.col("b").alias("block"), F.lit(0).alias("kind"), "turn", "role", "text", "tokens", F.lit(False).alias("first")
    )
    every = plain.unionByName(context).unionByName(head_rows)
    dealt = every.repartition(tasks_for(every), "conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", *order)
    return dealt.mapInArrow(_format(budget, history_turns, history_tokens), WINDOW_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    now: list = []

    def done() -> pa.RecordBatch:
        conv, n, turns, chars, loss, formatted, number = now
        return pa.RecordBatch.from_pylist([dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, number)))], schema=schema)

    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])
    for batch in batches:
        for w in batch.to_pylist():
            if not now or now[0] != w["conv_id"]:
                if now:
                    yield done()
                now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(w["formatted"])[w["repeated"] :]:
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for span in w["mask"]:
                text = unescape(w["formatted"][span["begin"] : span["end"]])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(w["formatted"])
            now[6] += 1
    if now:
        yield done()


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    dealt = formatted.repartition(tasks_for(formatted), "conv_id").sortWithinPartitions("conv_id", "block", "window")
    return dealt.mapInArrow(_digest, DIGEST_SCHEMA)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_windows(rows.unionByName(extra)))
