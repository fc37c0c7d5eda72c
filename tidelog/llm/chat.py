"""Chat formatting by columnar byte assembly.

Method: of a slice of turns the segment lengths (marks, role, mark, text, mark)
are laid out in numpy, their running sum gives each segment's place, and
scatter indices copy marks and contents into one buffer, allocated once, that
becomes the Arrow column of results.

A turn is ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash
is doubled, and the control strings get one after their first character, so no
control string is left in them; reading back drops single backslashes. The loss
mask holds the spans of assistant texts, in bytes of the piece.

A conversation's turns are in order of turn, then role, then text. Rows are
dealt by ranges of (conversation, turn, ...), so that one very long
conversation is formatted by several tasks; what a task has of a conversation in
one slice is a piece, and pieces are numbered in order. Reading back, the
pieces of a conversation are streamed through the hashes one by one.

Defined cases: a null text or role is empty; rows with a null conversation id
are one conversation; a null turn goes first; repeated rows are repeated turns;
an empty table gives nothing; other columns, whatever their names, are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text import buffers, lean, strings

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Bytes of texts that are assembled together, and that are scattered at once.
SLICE, SCATTER = 4 << 20, 1 << 20
PIECES = "conv_id long, piece long, n_turns long, formatted string, loss_start array<long>, loss_length array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(column: pa.Array) -> pa.StringArray:
    out = pc.replace_substring(strings(column), "\\", "\\\\")
    out = pc.replace_substring_regex(out, r"<(/?s>)", r"<\\\1")
    return pc.replace_substring_regex(out, r"\[(/?INST\])", r"[\\\1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _assembled(segments: list[bytes | pa.StringArray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with, for each of ``n`` rows, its segments in turn; and the places of all segments, (n, k + 1)."""
    lengths = np.empty((n, len(segments)), np.int64)
    for k, s in enumerate(segments):
        lengths[:, k] = len(s) if isinstance(s, bytes) else np.diff(buffers(s)[1])
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, s in enumerate(segments):
        if isinstance(s, bytes):
            out[starts[:, k, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
        else:
            data, at = buffers(s)
            shift = starts[:, k] - at[:-1]
            for lo in range(0, len(data), SCATTER):  # indices of so many bytes at a time
                hi = min(lo + SCATTER, len(data))
                first, last = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
                within = np.minimum(at[first + 1 : last + 1], hi) - np.maximum(at[first:last], lo)
                out[np.repeat(shift[first:last], within) + np.arange(lo, hi)] = data[lo:hi]
    return out, np.concatenate([starts, ends.reshape(lengths.shape)[:, -1:]], axis=1)


def _pieces(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """A slice's pieces, numbered from ``first``; the slice is sorted by conversation."""
    conv, role, text = batch.columns
    n = len(conv)
    known, ids = np.array(conv.is_valid()), np.array(conv.fill_null(0))
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n)
    raw, at = _assembled([OPEN.encode(), escaped(role), MIDDLE.encode(), escaped(text), CLOSE.encode()], n)
    offsets = np.append(at[heads, 0], len(raw)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(raw))
    loss = np.array(pc.equal(strings(role), "assistant"), bool)
    piece = np.repeat(np.arange(len(heads)), tails - heads)
    counts = np.concatenate([[0], np.cumsum(np.bincount(piece[loss], minlength=len(heads)))]).astype(np.int32)
    starts = at[loss, 3] - at[heads, 0][piece[loss]]
    lists = [pa.ListArray.from_arrays(counts, pa.array(x, pa.int64())) for x in (starts, at[loss, 4] - at[loss, 3])]
    numbers = pa.array(first + np.arange(len(heads)), pa.int64())
    return pa.RecordBatch.from_arrays([conv.take(pa.array(heads)), numbers, pa.array(tails - heads, pa.int64()), formatted, *lists], names=[x.split()[0] for x in PIECES.split(", ")])


def formatted(turns: DataFrame) -> DataFrame:
    """Pieces of formatted conversations, of (conv_id, turn, role, text)."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # ranges are numbered in order
        for batch in batches:
            sizes = np.array(pc.binary_length(strings(batch.column(2)))).cumsum()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
                out = _pieces(batch.slice(lo, hi - lo), number)
                number += out.num_rows
                yield out
                lo = hi

    return dealt.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, PIECES)


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece. No control string is inside them."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text outside the turns")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text outside the turns")
    return out


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts, lengths) -> None:
        turns = read_back(text)
        self.n += len(turns)
        self.chars += len(text)
        self.turns.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        raw = text.encode()
        for s, k in zip(starts, lengths, strict=True):
            masked = unescaped(raw[s : s + k].decode())
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its pieces; a piece at a time is in memory."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, _, text, starts, lengths = (c[i].as_py() for c in batch.columns)
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, starts, lengths)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist(done, schema)

    return dealt.mapInArrow(run, DIGESTS)


#: The digests in DuckDB, from the texts themselves.
ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g'))
    + length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<_\1', 'g'), '\[(/?INST\])', '[_\1', 'g')) + 20 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
