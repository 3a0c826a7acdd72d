"""Chat formatting: conversations as training windows within a token budget.

A turn is written as `<turn ROLE>`, a line feed, its text, `</turn>` and a line feed. Inside
texts and roles a backslash is doubled, and a backslash is put into what would read as a mark
(after its `<`), so that the marks stand for themselves wherever they are met and each text
comes back as it was.

Windows are spans of whole turns. Running sums of turn tokens choose them: a window takes turns
as long as they fit in the budget, beside the system turn, which every window of its
conversation begins with, and a limited number of turns repeated from before. Only assistant
texts that are not repeated are under the loss mask, each in one window. A turn is never cut:
one that is longer than the budget leaves stands in a window of its own, over the budget.

A conversation of any length is spread: rows are dealt by ranges of (conversation, turn); sums
within a range are carried on by one row for each range; windows are chosen by segments of
SEGMENT budgets, which every window ends at, and which get the turns before them that may be
repeated. Only the digests of a whole conversation (read_back) need it in one task; they pass
over it window by window and hold none of it.

Null texts and roles count as empty strings, a null turn comes first, a null conversation is
one of its own. Turns of equal number are ordered by role and text, repeated rows are turns of
their own. An empty table gives an empty result. Only the named columns are read, so that extra
columns of any name do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm.common import file_broadcast, ship, work_path

OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"
_marks = re.compile(r"\\|<(?=/?turn)")
_role_marks = re.compile(r"\\|<(?=/?turn)|>(?=\n)")
_escaped = re.compile(r"\\(.)", re.DOTALL)
#: Budgets of tokens that are chosen together.
SEGMENT = 64


def escape(text: str) -> str:
    return _marks.sub(lambda m: m[0] + "\\", text)


def escape_role(role: str) -> str:
    return _role_marks.sub(lambda m: m[0] + "\\", role)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def turns_in(window: str) -> Iterator[tuple[str, str]]:
    """The role and the text of each turn of a formatted window."""
    for turn in window.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(OPENED)
        yield unescape(role), unescape(text)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and the turns and tokens that it may repeat from before."""

    tokens: int = 1024
    history_turns: int = 2
    history_tokens: int = 256


_encodings: dict = {}


def _counter(rank_file: bytes, pattern: str):
    """The number of tokens of a text."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x.strip())}
        _encodings[key] = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = _encodings[key].encode_ordinary
    return lambda text: len(encode(text))


TURNS = "role string, body string, text_at long, text_end long, tokens long, part int, nth long, before long"


def formatted_turns(convs: DataFrame, ranks_path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Every turn in its template, with its tokens, its place in its conversation and the tokens
    before it: conv_id, place, start, role, body, text_at, text_end, tokens.

    Both sums run within the ranges that the rows are sorted and written by. A range begins
    inside one conversation at most, so that a row for each range carries the sums on.
    """
    spark = convs.sparkSession
    ship(spark)
    held = file_broadcast(spark, ranks_path)
    kind = convs.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part, now, nth, before = _counter(held.value, pattern), TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            out = [[] for _ in range(8)]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    now, nth, before = conv, 0, 0
                head, text = OPEN + escape_role(role) + OPENED, escape(text)
                body = head + text + CLOSE
                tokens = count(body)
                for column, value in zip(out, (role, body, len(head), len(head) + len(text), tokens, part, nth, before)):
                    column.append(value)
                nth, before = nth + 1, before + tokens
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in TURNS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["conv_id", *names])

    path = work_path(spark, "chat-turns")
    (
        convs.select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
        )
        .repartitionByRange("conv_id", "turn", "role", "text")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, f"conv_id {kind}, {TURNS}")
        .write.parquet(path)
    )
    turns = spark.read.parquet(path)
    ranges = turns.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranges.select("conv_id", "part", F.sum("turns").over(earlier).alias("turns_before"), F.sum("tokens").over(earlier).alias("tokens_before"))
        .where("turns_before > 0")
        .withColumnsRenamed({"conv_id": "c", "part": "p"})
    )
    return turns.join(carried, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id",
        (F.col("nth") + F.coalesce("turns_before", F.lit(0))).alias("place"),
        (F.col("before") + F.coalesce("tokens_before", F.lit(0))).alias("start"),
        "role", "body", "text_at", "text_end", "tokens",
    )


#: What a row is to its segment: the system turn of the conversation, a turn that may be
#: repeated, or a turn of its own.
SYSTEM, BEFORE, OWN = 0, 1, 2
WINDOWS = "segment long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, loss_starts array<long>, loss_ends array<long>"


class _Chooser:
    """The windows of one segment after another; holds one window and what may be repeated."""

    def __init__(self, budget: Budget, target: str):
        self.budget, self.target, self.key = budget, target, None
        self.reset(None)

    def reset(self, key) -> None:
        self.key, self.system, self.past, self.past_tokens = key, None, deque(), 0
        self.head, self.new = [], []

    def remember(self, turn: tuple) -> None:
        """Keeps the latest turns that history allows."""
        self.past.append(turn)
        self.past_tokens += turn[1]
        while self.past and (len(self.past) > self.budget.history_turns or self.past_tokens > self.budget.history_tokens):
            self.past_tokens -= self.past.popleft()[1]

    def add(self, turn: tuple) -> tuple | None:
        """Takes a turn; returns the window that it ends, if it does. The turn's place in the
        running sum says what the window would hold with it."""
        place, tokens, start = turn[0], turn[1], turn[2]
        over = self.new and self.used + start + tokens - self.new[0][2] > self.budget.tokens
        done = self.window() if over else None
        if not self.new:
            left = self.budget.tokens - tokens - (self.system[1] if self.system else 0)
            again, used = [], 0
            for old in reversed(self.past):
                if used + old[1] > left:
                    break
                again, used = [old, *again], used + old[1]
            self.head = [self.system] * (self.system is not None) + again
            self.used = sum(t[1] for t in self.head)
        self.new.append(turn)
        if place == 0 and turn[3] == "system":
            self.system = turn
        else:
            self.remember(turn)
        return done

    def window(self) -> tuple | None:
        if not self.new:
            return None
        at, text, spans = 0, [], []
        for k, (_, _, _, role, body, text_at, text_end) in enumerate([*self.head, *self.new]):
            if k >= len(self.head) and role == self.target:
                spans.append((at + text_at, at + text_end))
            at += len(body)
            text.append(body)
        made = (
            *self.key, self.new[0][0], len(self.new), len(self.head), sum(t[1] for t in self.head) + sum(t[1] for t in self.new),
            "".join(text), [a for a, _ in spans], [b for _, b in spans],
        )
        self.new = []
        return made


def windows(
    convs: DataFrame, ranks_path: str, pattern: str, budget: Budget = Budget(), target: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn"
) -> DataFrame:
    """conv_id, segment, first_turn, n_new, n_repeated, n_tokens, text, loss_starts, loss_ends: a row for each window.

    A window begins with n_repeated turns that stand in an earlier window too (the system turn
    and history), and goes on with n_new turns from place first_turn on. The loss mask is of
    code points in text, in which assistant texts stand escaped.
    """
    kind = convs.schema[conv_col].dataType.simpleString()
    turns = formatted_turns(convs, ranks_path, pattern, conv_col, turn_col)
    stride = SEGMENT * max(budget.tokens, budget.history_tokens, 1)
    placed = turns.withColumn("segment", F.floor(F.col("start") / F.lit(stride)).cast("long"))
    own = placed.withColumn("what", F.lit(OWN))
    near_end = (F.col("segment") + 1) * stride - F.col("start") <= budget.history_tokens
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    before = placed.where(near_end & ~is_system).withColumns({"segment": F.col("segment") + 1, "what": F.lit(BEFORE)})
    later = placed.where("segment > 0").select(F.col("conv_id").alias("c"), F.col("segment").alias("s")).distinct()
    system = placed.where(is_system).join(later, F.col("conv_id").eqNullSafe(F.col("c"))).withColumns({"segment": F.col("s"), "what": F.lit(SYSTEM)}).drop("c", "s")
    dealt = (
        own.unionByName(before)
        .unionByName(system)
        .repartition("conv_id", "segment")
        .sortWithinPartitions("conv_id", "segment", "what", "place")
        .select("conv_id", "segment", "what", "place", "tokens", "start", "role", "body", "text_at", "text_end")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser, out = _Chooser(budget, target), []
        schema = pa.schema([
            ("conv_id", conv_type), ("segment", pa.int64()), ("first_turn", pa.int64()), ("n_new", pa.int64()), ("n_repeated", pa.int64()),
            ("n_tokens", pa.int64()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())),
        ])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                key, what, turn = row[:2], row[2], row[3:]
                if key != chooser.key:
                    out.append(chooser.window())
                    chooser.reset(key)
                if what == SYSTEM:
                    chooser.system = turn
                elif what == BEFORE:
                    chooser.remember(turn)
                else:
                    out.append(chooser.add(turn))
            if made := [w for w in out if w]:
                yield batch_of(made)
            out = []
        if last := chooser.window():
            yield batch_of([last])

    conv_type = to_arrow_type(convs.schema[conv_col].dataType)
    return dealt.mapInArrow(run, f"conv_id {kind}, {WINDOWS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: what windows
    say of each conversation, from their texts and masks alone.

    A digest is of a whole conversation in its order: its windows pass one by one.
    """
    ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = now = object()
        said = loss = counts = None
        ended = lambda: (now, counts[0], said.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3])
        for batch in batches:
            out = []
            for conv, repeated, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is none or conv != now:
                    if now is not none:
                        out.append(ended())
                    now, said, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for k, (role, content) in enumerate(turns_in(text)):
                    if k >= repeated:
                        said.update(f"{role}\n{content}\n".encode("utf-8", "replace"))
                        counts[0] += 1
                for a, b in zip(starts, ends):
                    target = unescape(text[a:b])
                    loss.update(target.encode("utf-8", "replace"))
                    counts[1] += len(target)
                counts[2] += len(text)
                counts[3] += 1
            if out:
                yield batch_of(out)
        if now is not none:
            yield batch_of([ended()])

    kinds = [to_arrow_type(formatted.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return (
        formatted.select("conv_id", "first_turn", "n_repeated", "text", "loss_starts", "loss_ends")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "first_turn")
        .select("conv_id", "n_repeated", "text", "loss_starts", "loss_ends")
        .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
    )


def write_windows(convs: DataFrame, path: str, ranks_path: str, pattern: str, budget: Budget = Budget(), target: str = "assistant") -> DataFrame:
    """Writes the windows as Parquet to path and returns them as read from there."""
    windows(convs, ranks_path, pattern, budget, target).write.parquet(path)
    return convs.sparkSession.read.parquet(path)


def with_conversation(convs: DataFrame, conv_id: int, turns: list[tuple[str, str]]) -> DataFrame:
    """The conversations with one more, of (role, text) in order."""
    spark: SparkSession = convs.sparkSession
    named = convs.select("conv_id", "turn", "role", "text")
    return named.unionAll(spark.createDataFrame([(conv_id, k, r, t) for k, (r, t) in enumerate(turns)], named.schema))
