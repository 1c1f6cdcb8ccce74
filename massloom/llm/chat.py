"""Chat formatting: every assistant turn becomes an example of its own.

An example is the template text of all preceding turns and of one assistant turn; only
that reply is trainable. Turns behind the last assistant turn make a
last example without a target, so nothing of a conversation is lost.

Turn marks are control strings, and each of them but the blank before a reply holds one of the signs ``< > [``. A
backslash is put before every such sign of a text and before every backslash, so a sign
without one in the output is the template's, whatever a text begins or ends with.

Escaping and marking run as column expressions before the rows are dealt to partitions by conversation and
sorted by turn. A task then streams them and holds the text of one conversation, which is
also the size of that conversation's longest example.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
USER_OPEN, USER_CLOSE = "<s>[INST] ", " [/INST]"
REPLY_OPEN, REPLY_CLOSE = " ", " </s>"
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "<<", ">> ", " <</>>"
_SIGNS = r"([\\<>\[])"
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """Put a backslash before each sign of a control string and each backslash; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SIGNS, r"\\$1")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, target_turn, n_turns, example, loss_start, loss_end), one row for each assistant turn.

    ``example[loss_start:loss_end]`` (code points) is the escaped reply. ``target_turn``
    counts turns from 0 in the conversation; it is null in a last example of trailing turns, whose
    loss range is empty. Null texts and roles are empty, null turns come first, equal turn numbers are ordered by
    role and text, repeated rows are turns of their own, and a row without a
    conversation id is a conversation of one turn.
    """
    body = escape(F.col(text))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    is_reply = who == "assistant"
    opened = F.when(who == "user", F.lit(USER_OPEN)).when(is_reply, F.lit(REPLY_OPEN)).otherwise(F.concat(F.lit(OTHER_OPEN), escape(who), F.lit(OTHER_NAMED)))
    closed = F.when(who == "user", F.lit(USER_CLOSE)).when(is_reply, F.lit(REPLY_CLOSE)).otherwise(F.lit(OTHER_CLOSE))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), who.alias("__role"), F.col(text).alias("__text"), is_reply.alias("reply"), opened.alias("open"), body.alias("body"), closed.alias("close"))
    # rows without an id belong to no group, so they are dealt out by what they hold
    place = F.coalesce("conv_id", F.xxhash64("__turn", "__role", "__text"))
    dealt = rows.repartition(place).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("__turn").asc_nulls_first(), "__role", F.col("__text").asc_nulls_first())
    return dealt.select("conv_id", "reply", "open", "body", "close").mapInArrow(_expand, "conv_id long, target_turn long, n_turns long, example string, loss_start long, loss_end long")


def _expand(batches):
    """Stream sorted turns; ``said`` is the text of the conversation so far."""
    now, said, count, pending, started = None, "", 0, False, False
    out: list[tuple] = []
    size = 0

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "target_turn", "n_turns", "example", "loss_start", "loss_end"])

    for rows in batches:
        for conv, reply, opened, body, closed in zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True):
            if not started or conv != now or conv is None:
                if pending:
                    out.append((now, None, count, said, 0, 0))
                now, said, count, pending, started = conv, "", 0, False, True
            start = len(said) + len(opened)
            said = f"{said}{opened}{body}{closed}"
            count += 1
            pending = not reply
            if reply:
                out.append((conv, count - 1, count, said, start, start + len(body)))
                size += len(said)
            if size > 4 << 20 or len(out) >= 2000:
                yield batch()
                out, size = [], 0
    if pending:
        out.append((now, None, count, said, 0, 0))
    if out:
        yield batch()


def read_back(example: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    turns: list[tuple[str, str]] = []
    at, size = 0, len(example)
    while at < size:
        if example.startswith(USER_OPEN, at):
            role, at, closing = "user", at + len(USER_OPEN), USER_CLOSE
        elif example.startswith(OTHER_OPEN, at):
            end = _find(example, OTHER_NAMED, at + len(OTHER_OPEN))
            role, at, closing = unescape(example[at + len(OTHER_OPEN) : end]), end + len(OTHER_NAMED), OTHER_CLOSE
        elif example.startswith(REPLY_OPEN, at):
            role, at, closing = "assistant", at + len(REPLY_OPEN), REPLY_CLOSE
        else:
            raise ValueError(f"no turn starts at {at}")
        end = _find(example, closing, at)
        turns.append((role, unescape(example[at:end])))
        at = end + len(closing)
    return turns


def _find(example: str, mark: str, start: int) -> int:
    """Where the first ``mark`` stands from ``start`` on; its sign is the first that no backslash escapes."""
    for found in re.compile(rf"\\.|{re.escape(mark)}", re.S).finditer(example, start):
        if found.group() == mark:
            return found.start()
    raise ValueError(f"{mark!r} is missing")


def digests(examples: DataFrame) -> DataFrame:
    """Read the examples of each conversation back: turns and loss text with their SHA-256.

    ``examples`` come as ``format_examples`` gives them, a conversation's rows side by side in order.
    """

    def run(batches):
        out: list[tuple] = []
        now, started, loss, chars, total, last = None, False, None, 0, 0, ""

        def close():
            turns = read_back(last)
            whole = hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            out.append((now, len(turns), whole.hexdigest(), chars, loss.hexdigest(), total))

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for rows in batches:
            cols = [rows.column(rows.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "example", "loss_start", "loss_end")]
            for conv, example, a, b in zip(*cols, strict=True):
                if not started or conv != now or conv is None:
                    if started:
                        close()
                    now, started, loss, chars, total = conv, True, hashlib.sha256(), 0, 0
                reply = unescape(example[a:b])
                loss.update(reply.encode())
                chars += len(reply)
                total += len(example)
                last = example
            if len(out) >= 2000:
                yield batch()
                out = []
        if started:
            close()
        if out:
            yield batch()

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
