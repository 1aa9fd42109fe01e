"""Chat formatting with a grammar round trip.

A turn is rendered as ``<turn ROLE>TEXT</turn>`` and a line feed; a role is written as a JSON string. The rendered turn is
parsed again by the grammar below, by which a text holds no control string as it is: neither ``<turn`` nor ``</turn``.
Where role and text don't come back as they were, the turn is rendered once more with its conflicting content escaped
and marked so: ``<turn ROLE escaped>``. There, each backslash is doubled and one follows each ``<``, so that no control
string is left in the text. This round trip always succeeds, which is checked all the same.

Conversations are dealt out by id and sorted, and a task reads them as a stream: it holds one turn and the digests, so
a conversation of any length takes no more memory.

Defined results: a null text is an empty one; a null role is the JSON null, and an empty string in turns_sha256; turns in a conversation are in the order of
turn (null first), and of role and text where they tie; rows with a null conv_id are one conversation; repeated rows are turns of their own. Only the four columns named are
read. The digests of one conversation are one task's work, as SHA-256 goes through a text in order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import by_bytes

#: turn := open text close; open := "<turn " role [" escaped"] ">"; role := JSON string or null; close := "</turn>\n"
OPEN = re.compile(r'<turn ("(?:[^"\\]|\\.)*"|null)( escaped)?>')
CLOSE = "</turn>\n"
CONTROL = re.compile("</?turn")
ESCAPED = re.compile(r"(?:[^\\<]|\\\\|<\\)*")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\")


def unescape(text: str) -> str:
    return re.sub(r"\\\\|<\\", lambda m: m[0][0], text)


def parse_turn(formatted: str, at: int = 0) -> tuple[str | None, str, int, int, int]:
    """Role and text of the turn that begins at ``at``, where its body begins and ends, and where the turn ends."""
    opened = OPEN.match(formatted, at)
    if not opened:
        raise ValueError(f"no turn at {at}")
    body = opened.end()
    if opened[2]:
        end = ESCAPED.match(formatted, body).end()
    else:
        control = CONTROL.search(formatted, body)
        end = control.start() if control else -1
    if end < 0 or not formatted.startswith(CLOSE, end):
        raise ValueError(f"the turn at {at} does not end")
    text = formatted[body:end]
    return json.loads(opened[1]), unescape(text) if opened[2] else text, body, end, end + len(CLOSE)


def render_turn(role: str | None, text: str) -> str:
    """The turn, escaped only if it does not come back without."""
    for mark, body in (("", text), (" escaped", escape(text))):
        formatted = f"<turn {json.dumps(role)}{mark}>{body}{CLOSE}"
        try:
            if (back := parse_turn(formatted))[:2] == (role, text) and back[4] == len(formatted):
                return formatted
        except ValueError:
            continue
    raise AssertionError("an escaped turn did not come back")


def parse(formatted: str) -> list[tuple[str | None, str, int, int]]:
    """All turns of a formatted conversation: role, text, and where the body begins and ends."""
    out, at = [], 0
    while at < len(formatted):
        role, text, a, z, at = parse_turn(formatted, at)
        out.append((role, text, a, z))
    return out


def formatted_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, formatted, and loss_start and loss_end: the part of ``formatted`` under the loss mask, which is an
    assistant's text (null for others). Rows of a conversation come one after another, in order."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 3):
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            formatted = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [parse_turn(f)[2:4] if r == "assistant" else (None, None) for r, f in zip(roles, formatted, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array([a for a, _ in spans], pa.int32()), pa.array([z for _, z in spans], pa.int32())], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render, "conv_id long, turn long, formatted string, loss_start int, loss_end int")


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, parsed from the output alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars. ``formatted`` has its conversations in order, as ``formatted_turns`` gives them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in by_bytes(batches, 2):
            done = []
            for conv, whole, a, z in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    if state:
                        done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, body, end in parse(whole):
                    state[0] += 1
                    state[1].update(f"{role or ''}\n{text}\n".encode("utf-8", "replace"))
                    if a is not None:
                        masked = whole[a:z]
                        masked = unescape(masked) if whole[:body].endswith(" escaped>") else masked
                        state[2] += len(masked)
                        state[3].update(masked.encode("utf-8", "replace"))
                state[4] += len(whole)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True))], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
