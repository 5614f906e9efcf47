"""Chat formatting: every assistant turn becomes an example whose context is all turns before it.

A turn is written as ``<s>[ROLE:role]text</s>``. Within roles and texts, ``\\``, ``<`` and ``[`` are
written ``\\0``, ``\\1`` and ``\\2`` (``]`` in roles ``\\3``), so no text can hold a mark, and reading restores it exactly.
``expand`` writes one row for each assistant turn: the rendered turns before it, its own, and the span of its
text, which alone is trainable. Turns after a conversation's last reply (or all, if it has none) follow in a row
without a trainable span, so nothing that was given is lost.

Whole contexts make the output grow with the square of a conversation's length; that is what the method
writes. Turns are dealt by conversation, sorted and streamed: a task holds one conversation's text so far and one
batch of BATCH_CHARS, never its turns or examples together.

Defined results: null text and null role are empty; turns that tie are ordered by role, then text; repeated rows
are turns of their own; a conversation without assistant turns has no examples but the row that holds its turns;
a null conv_id is a conversation; texts of any length are kept whole; an empty table has no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of examples in one batch (or one example).
BATCH_CHARS = 1 << 20
TURN = re.compile(r"<s>\[ROLE:([^\[<\]]*)\]([^\[<]*)</s>", re.S)


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1")), F.lit("["), F.lit("\\2"))


def unescape(x: str) -> str:
    return x.replace("\\3", "]").replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\")


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation; raises if it is none."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a rendered conversation")
    return out


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def expand(turns: DataFrame) -> DataFrame:
    """Examples of turns(conv_id, turn, role, text): conv_id, example (from 0), text, loss_start, loss_end.

    Spans are code points of the text. The rest of a conversation after its last reply is a last row, whose
    example and span are null; its text is the whole conversation. A conversation's rows are in order.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit("<s>[ROLE:"), F.replace(escape(F.col("role")), F.lit("]"), F.lit("\\3")), F.lit("]"))
    pieces = base.select("conv_id", "turn", "role", "text", F.concat(head, escape(F.col("text")), F.lit("</s>")).alias("piece"), F.length(head).alias("lead"))
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", (F.col("role") == "assistant").alias("reply"), "piece", "lead")

    def run(batches):
        import pyarrow as pa

        kind, out, held = None, [], 0

        def flush():
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "example", "text", "loss_start", "loss_end"])

        current, stream, n, rest = object(), "", 0, False
        for batch in batches:
            kind = batch.column(0).type
            for conv, reply, piece, lead in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != current:
                    if rest:
                        out.append((current, None, stream, None, None))
                        held += len(stream)
                    current, stream, n = conv, "", 0
                at, rest = len(stream), not reply
                stream += piece
                if reply:
                    out.append((conv, n, stream, at + lead, len(stream) - 4))
                    n, held = n + 1, held + len(stream)
                if held >= BATCH_CHARS:
                    held = 0
                    yield flush()
        if rest:
            out.append((current, None, stream, None, None))
        if out:
            yield flush()

    return ordered.mapInArrow(run, f"conv_id {kind_of(turns, 'conv_id')}, example long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """What examples, as they leave ``expand``, say: one row per conversation, with digests of its turns and of all trainable text.

    Trainable text is read under the loss mask of each example; turns are parsed from a conversation's last row,
    which holds them all. Raises where an example's context is not what the one before it ended with. Rows of a
    conversation arrive in order; one of them is held at a time. formatted_chars counts the text of all rows.
    """
    kind = kind_of(examples, "conv_id")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        conv, last, state, out, key = None, "", None, [], None

        def close():
            turns, digest = turns_of(last), hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            out.append((conv, len(turns), digest.hexdigest(), state[0], state[1].hexdigest(), state[2], state[3]))

        def flush():
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            key = batch.column(0).type
            for c, text, start, end in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
                if state is None or c != conv:
                    if state:
                        close()
                    conv, last, state = c, "", [0, hashlib.sha256(), 0, 0]
                if not text.startswith(last):
                    raise ValueError(f"an example of conversation {c} leaves out a part of its context")
                last = text
                state[2] += len(text)
                if start is not None:
                    loss = unescape(text[start:end])
                    state[0] += len(loss)
                    state[1].update(loss.encode())
                    state[3] += 1
            if out:
                yield flush()
        if state:
            close()
        if out:
            yield flush()

    return examples.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
