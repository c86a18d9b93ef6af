r"""Chat formatting with a grammar round trip.

Grammar, with the fixed control strings of the template:

    output    := turn*
    user      := "[INST] " text " [/INST]"
    system    := "<<SYS>> " text " <</SYS>>"
    assistant := "<s>" text "</s>"
    other     := "[ROLE:" text "] " text " [/ROLE]"

In a text, "\" before "\", "[", "<" or "]" escapes that character.  Each turn is
rendered plainly, parsed again by the deterministic parser and compared with its
source; if they differ, it is rendered with stronger escapes until identical.
Loss falls on assistant texts, without their control strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens and closes the turns of each role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s>", "</s>")}
ROLE, ROLE_OPEN, ROLE_CLOSE = "[ROLE:", "] ", " [/ROLE]"
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE:", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\([\\\[<\]])")


def escape(text: str, level: int) -> str:
    """Level 0 leaves text alone, 1 escapes control strings and what looks like an escape, 2 all special characters."""
    if level == 0:
        return text
    if level == 1:
        return _CONTROL.sub(lambda m: "\\" + m[0], re.sub(r"\\(?=[\\\[<\]]|$)", r"\\\\", text))
    return re.sub(r"[\\\[<\]]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def find(text: str, mark: str, at: int) -> int:
    """The first place of mark from `at` whose characters are not escaped; -1 if none."""
    bare = mark.lstrip(" ")
    lead = len(mark) - len(bare)
    p = text.find(bare, at)
    while p >= 0:
        k = p
        while k > at and text[k - 1] == "\\":
            k -= 1
        if (p - k) % 2 == 0 and p - lead >= at and text[p - lead : p] == mark[:lead]:
            return p - lead
        p = text.find(bare, p + 1)
    return -1


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, first and end place of the raw text) of each turn; None where the grammar does not fit."""
    out, at = [], 0
    while at < len(text):
        for role, (begin, close) in MARKS.items():
            if text.startswith(begin, at):
                start = at + len(begin)
                break
        else:
            if not text.startswith(ROLE, at):
                return None
            p = find(text, ROLE_OPEN, at + len(ROLE))
            if p < 0:
                return None
            role, start, close = unescape(text[at + len(ROLE) : p]), p + len(ROLE_OPEN), ROLE_CLOSE
        if (end := find(text, close, start)) < 0:
            return None
        raw = text[start:end]
        if any(not _escaped(raw, m.start()) for m in _CONTROL.finditer(raw)):
            return None  # a bare control string inside a text is a conflict
        out.append((role, unescape(raw), start, end))
        at = end + len(close)
    return out


def _escaped(raw: str, at: int) -> bool:
    k = at
    while k and raw[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, place of the raw text, its end, escape level), the first level that reads back identically."""
    for level in (0, 1, 2):
        if role in MARKS:
            begin, close = MARKS[role]
        else:
            begin, close = ROLE + escape(role, 2) + ROLE_OPEN, ROLE_CLOSE
        raw = escape(text, level)
        whole = begin + raw + close
        got = parse(whole)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return whole, len(begin), len(begin) + len(raw), level
    raise ValueError("no escape level reads back identically")  # level 2 always does


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, piece, loss_start, loss_end (in the piece; null for no loss), level: a row for each turn.

    Null text and null role are empty strings.  A turn is rendered where it is read,
    so the work spreads whatever the size of a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            role, text = ([x or "" for x in b[c].to_pylist()] for c in ("role", "text"))
            made = [render(r, t) for r, t in zip(role, text)]
            loss = [r == "assistant" for r in role]
            yield pa.RecordBatch.from_pydict({
                "conv_id": b["conv_id"], "turn": b["turn"], "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "piece": pa.array([m[0] for m in made], pa.string()),
                "loss_start": pa.array([m[1] if x else None for m, x in zip(made, loss)], pa.int64()), "loss_end": pa.array([m[2] if x else None for m, x in zip(made, loss)], pa.int64()), "level": pa.array([m[3] for m in made], pa.int32()),
            })

    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, piece string, loss_start long, loss_end long, level int")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped, parsed from the pieces alone.

    Turns go by turn, then role, then text (ties), null turns first; a null conv_id
    is a conversation of its own.  Each task streams its sorted turns through running
    digests, so a conversation of any length takes a bounded memory.
    """
    cols = ("conv_id", "turn", "role", "text", "piece", "loss_start", "loss_end", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flush() -> pa.RecordBatch:
            rows, done[:] = list(zip(*done)) or [()] * 7, []
            return pa.RecordBatch.from_arrays([pa.array(rows[0], kind), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.string()), pa.array(rows[5], pa.int64()), pa.array(rows[6], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"])

        kind = None
        for b in batches:
            kind = b["conv_id"].type
            for conv, piece, lo, hi, level in zip(*(b[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end", "level"))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    said = unescape(piece[lo:hi])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(piece)
                state[5] += level > 0
            if len(done) >= 10_000:
                yield flush()
        close()
        if done:
            yield flush()

    kind = rendered.schema["conv_id"].dataType.simpleString()
    ordered = rendered.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")


def report(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, formatted and read back."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = extra.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return read_back(turns(rows.unionByName(extra)))
