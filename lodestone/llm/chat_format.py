"""Chat formatting by columnar byte assembly.

A conversation becomes one text: for each turn a header with the role, the
content, and a footer.  Segment lengths of all turns are laid out in a matrix,
their cumulative sum gives every segment's place, and headers, roles and contents
are scattered into one preallocated Arrow buffer; no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .cluster import need

HEAD, MIDDLE, FOOT = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TARGET_ROLE = "assistant"
_LIMIT = 32 << 20


def _scatter(out: np.ndarray, column: pa.LargeStringArray, to: np.ndarray) -> None:
    """Copies each text of the column to out, from position to[i]."""
    buf, offsets = textcore.raw(column)
    n = np.diff(offsets)
    out[np.repeat(to - offsets[:-1], n) + np.arange(len(buf))] = buf


def _constant(out: np.ndarray, text: bytes, to: np.ndarray) -> None:
    out[to[:, None] + np.arange(len(text))] = np.frombuffer(text, np.uint8)


def assemble(conv: np.ndarray, roles: pa.LargeStringArray, contents: pa.LargeStringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of conversations whose turns are consecutive rows, conv[i] being the number of row i's conversation.

    Also the first row of each conversation, and where each row's content begins and ends in its text.
    """
    n = len(conv)
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.zeros(0, np.int64)
    size = lambda c: np.asarray(pc.binary_length(c), np.int64)
    lengths = np.stack([np.full(n, len(HEAD)), size(roles), np.full(n, len(MIDDLE)), size(contents), np.full(n, len(FOOT))], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    _constant(out, HEAD, starts[:, 0])
    _scatter(out, roles, starts[:, 1])
    _constant(out, MIDDLE, starts[:, 2])
    _scatter(out, contents, starts[:, 3])
    _constant(out, FOOT, starts[:, 4])
    offsets = np.append(starts[first, 0], total)
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), buffer)
    base = np.repeat(offsets[:-1], np.diff(np.append(first, n)))
    return text.cast(pa.string()), first, starts[:, 3] - base, ends[:, 3] - base


def _conversations(table: pa.Table) -> pa.RecordBatch:
    """One row for each conversation of complete, ordered turns."""
    key = pc.fill_null(table.column("conv_id"), 0).combine_chunks()
    null = np.asarray(pc.is_null(table.column("conv_id")))
    k = np.asarray(key)
    conv = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (null[1:] != null[:-1]))]) if len(k) else np.zeros(0, np.int64)
    roles = textcore.strings(pc.fill_null(table.column("role"), "unknown"))
    contents = textcore.strings(table.column("text"))
    clean = lambda c: pc.replace_substring(c, "<|", "< |")
    roles, contents = clean(roles), clean(contents)
    text, first, begin, end = assemble(conv, roles, contents)
    n = np.diff(np.append(first, len(conv)))
    target = np.asarray(pc.equal(roles, TARGET_ROLE))
    spans = np.char.add(np.char.add(begin[target].astype(str), "-"), end[target].astype(str)) if target.any() else np.zeros(0, str)
    of = np.cumsum(target) - target
    spans_of = [",".join(spans[a:b]) for a, b in zip(of[first], np.append(of[first][1:], target.sum()))] if len(first) else []
    cols = [table.column("conv_id").combine_chunks().take(pa.array(first)), pa.array(n, pa.int64()), text, pa.array(spans_of, pa.string())]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["conv_id", "n_turns", "text", "targets"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    size = 0

    def last_start(b: pa.RecordBatch) -> int:
        """The first row of the conversation that the last row belongs to, within the batch."""
        c = b.column("conv_id")
        same = pc.fill_null(pc.equal(c, c[-1]), False) if c[-1].is_valid else pc.is_null(c)
        other = np.flatnonzero(~np.asarray(same))
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            b = batch.slice(at, 5000)
            kept.append(b)
            size += b.nbytes
            if size < _LIMIT:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            whole = t.to_batches()[0]
            cut = last_start(whole)
            if cut:
                yield _conversations(t.slice(0, cut))
                kept = [whole.slice(cut)]
                size = kept[0].nbytes
    if kept:
        yield _conversations(pa.Table.from_batches(kept))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text and targets: one formatted text for each conversation.

    Turns are ordered by turn, then role, then text; null turns come first and
    repeated rows stay.  targets lists the byte ranges 'begin-end' of what the
    assistant says, for a loss mask ('' where it says nothing).  A null role is
    'unknown', a null text is empty, rows with a null conv_id are one
    conversation.  '<|' in a role or text becomes '< |', so contents can't form
    markers.  Other columns aren't used; an empty table gives no rows.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return c.mapInArrow(_format, "conv_id bigint, n_turns bigint, text string, targets string")
