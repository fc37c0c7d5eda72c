"""Sum-of-squares online packing of tokenised documents.

Method: windows of 2048 ids are filled one document at a time. An array holds
how many windows are partly filled at each level, a level being a 64th of a
window; a document goes where the sum of the squared counts becomes least, a new
window being level 0. Of documents longer than a window the full windows are cut
off first. A window in its last level is closed: the few ids it lacks are cut
off the next document.

Windows stay as they were filled. Only when a task's input ends, the emptiest of
the windows that are still open give their pieces to fill the others, and what
is left of the last is cut into windows whose lengths are powers of two, which
need no padding. ``moved`` tells these pieces.

Each task packs its own share of the documents with its own levels: there is no
shuffle, and a task holds the ids of what lies in open windows only.

Texts are split into words and punctuation before they are tokenised, as the
tokenizer does it, and a worker remembers the ids of those it met last.

Defined cases: a null or empty text has just the end id; repeated rows are
packed each; an empty table gives no pieces; other columns are ignored.
"""

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text import SPACE, lean, slices, strings

WINDOW, LEVELS, END_ID = 2048, 64, 1
#: Bytes of text tokenised together, and pieces remembered.
SLICE, REMEMBERED = 1 << 20, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: All but characters whose lower case and composition depend on nothing around them, and a special token's start.
_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\|")
_WORD = re.compile(r"[^\t-\r ]+")
#: Fixed value: how the vocabulary's own pre-tokenizer cuts lower-cased text, for those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")


def _byte_names() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100."""
    out, spare = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


class _Memory(dict):
    """Ids by piece: what is not here is taken from the older memory or found out."""

    def __init__(self, old: dict, find):
        super().__init__()
        self.old, self.find = old, find

    def __missing__(self, piece):
        out = self[piece] = self.old.get(piece) or self.find(piece)
        return out


class WordTokens:
    """Ids of whole texts through their pieces.

    Plain text is cut as the tokenizer would cut it, and each new piece is given
    to its model; any other word goes through the whole tokenizer. Pieces met
    lately are remembered in two generations: when the younger is full it
    becomes the older, and what is met again moves back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.names = Tokenizer.from_file(path), _byte_names()
        self.model, self.known = self.tokenizer.model, _Memory({}, self._ids)

    def _pieces(self, text: str) -> list:
        if not _ODD.search(text):
            return _PIECE.findall(text.lower())
        out: list = []
        for word in _WORD.findall(text):
            out += [(word,)] if _ODD.search(word) else _PIECE.findall(word.lower())
        return out

    def _ids(self, piece: str | tuple) -> bytes:
        if isinstance(piece, tuple):
            ids = self.tokenizer.encode(piece[0], add_special_tokens=False).ids
        else:
            if not piece.isalpha() or not piece.isascii():
                piece = "".join([self.names[b] for b in piece.encode()])
            ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each with the end id."""
        if len(self.known) > REMEMBERED:
            self.known.old = {}
            self.known = _Memory(dict(self.known), self._ids)
        of, end = self.known.__getitem__, struct.pack("<I", END_ID)
        return [np.frombuffer(b"".join(map(of, self._pieces(t))) + end, "<u4") for t in texts]


@lru_cache(1)
def _tokens(path: str) -> WordTokens:
    """One per worker, so that what a task has learned serves the next."""
    return WordTokens(path)


class Packer:
    """Places items shorter than a window; ``done`` has the pieces of closed windows: item, start, length, sequence, offset, moved."""

    def __init__(self, first: int, window: int = WINDOW, levels: int = LEVELS):
        self.window, self.next, self.unit = window, first, max(1, window // levels)
        self.open: list[list[list]] = [[] for _ in range(-(-window // self.unit))]  # by level: [fill, pieces] of each window
        self.short: list[list] = []  # closed, but for ids of the next item
        self.done: list[tuple] = []

    def _finish(self, pieces: list) -> None:
        sequence, offset = self.next, 0
        self.next += 1
        for item, start, length, moved in pieces:
            self.done.append((item, start, length, sequence, offset, moved))
            offset += length

    def _keep(self, window: list) -> None:
        if window[0] == self.window:
            self._finish(window[1])
        elif window[0] > self.window - self.unit:
            self.short.append(window)
        else:
            self.open[window[0] // self.unit].append(window)

    def put(self, item: int, length: int, start: int) -> None:
        """``item`` numbers the document."""
        while length >= self.window:
            self._finish([(item, start, self.window, False)])
            start, length = start + self.window, length - self.window
        while length and self.short:
            last = self.short.pop()
            take = min(self.window - last[0], length)
            last[0] += take
            last[1].append((item, start, take, False))
            start, length = start + take, length - take
            self._keep(last)
        if not length:
            return
        # change of the sum of squares: one window fewer at the level, one more where it gets to
        more = lambda fill: 0 if fill > self.window - self.unit else 2 * len(self.open[fill // self.unit]) + 1
        best, level = more(length), None
        for k in range((self.window - length) // self.unit + 1):
            here = self.open[k]
            if here and here[-1][0] + length <= self.window:
                change = 1 - 2 * len(here) + more(here[-1][0] + length)
                if change <= best:  # of equals the fullest
                    best, level = change, k
        chosen = [0, []] if level is None else self.open[level].pop()
        chosen[0] += length
        chosen[1].append((item, start, length, False))
        self._keep(chosen)

    def end(self) -> None:
        """Closes all: the emptiest windows fill the others."""
        rest = sorted([w for level in self.open for w in level] + self.short, key=lambda w: w[0])
        self.open, self.short = [[] for _ in self.open], []
        giver, taker = 0, len(rest) - 1
        while taker > giver:
            window, source = rest[taker], rest[giver][1]
            while window[0] < self.window and source:
                item, start, length, _ = source.pop()
                take = min(length, self.window - window[0])
                window[1].append((item, start, take, True))
                window[0] += take
                if take < length:
                    source.append((item, start + take, length - take, True))
            if window[0] == self.window:
                self._finish(window[1])
                taker -= 1
            if not source:
                giver += 1
        if taker == giver:
            self._cut(rest[giver][1])

    def _cut(self, pieces: list) -> None:
        """Windows of powers of two; one that has such a length stays."""
        total = sum(p[2] for p in pieces)
        if total & (total - 1) == 0:
            return self._finish(pieces) if total else None
        rest = pieces[::-1]
        for goal in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
            held = []
            while goal:
                item, start, length, _ = rest.pop()
                take = min(goal, length)
                held.append((item, start, take, True))
                goal -= take
                if take < length:
                    rest.append((item, start + take, length - take, True))
            self._finish(held)
        return None

    def waiting(self) -> set[int]:
        """Items with pieces in windows that are not done."""
        return {p[0] for level in (*self.open, self.short) for w in level for p in w[1]}


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of (doc_id, text) by ``SCHEMA``. Their ids are the document's ids from ``start``."""
    path = path or default_tokenizer()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = _tokens(path), Packer(TaskContext.get().partitionId() << 36, window)
        waiting: dict[int, list] = {}  # of documents with pieces in open windows: id, tokens, first id kept, ids from there
        number = 0

        def emit() -> pa.RecordBatch:
            rows = [(waiting[i][0], start, length, crc(i, start, length), waiting[i][1], sequence, offset, moved) for i, start, length, sequence, offset, moved in packer.done]
            packer.done.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            held = packer.waiting()
            for i in [i for i in waiting if i not in held]:
                del waiting[i]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "moved" else pa.int64()) for c, name in zip(columns, _NAMES, strict=True)], names=_NAMES)

        def crc(i: int, start: int, length: int) -> int:
            _, _, kept, ids = waiting[i]
            return zlib.crc32(ids[start - kept : start - kept + length].tobytes())

        for batch in batches:
            ids_of, texts = batch.column(0), strings(batch.column(1))
            for lo, hi in slices(texts, SLICE):
                for k, ids in enumerate(tokens.encode(texts.slice(lo, hi - lo).to_pylist()), lo):
                    waiting[number] = [ids_of[k].as_py(), len(ids), 0, ids]
                    packer.put(number, len(ids), 0)
                    number += 1
                out = emit()
                for x in waiting.values():  # of those that wait only the last, partial window's ids are kept
                    cut = x[1] - x[1] % window
                    if x[2] < cut:
                        x[3], x[2] = x[3][cut - x[2] :].copy(), cut
                if out.num_rows:
                    yield out
        packer.end()
        yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


assert SPACE[0x20] and set(b" \t\n\v\f\r") == set(np.flatnonzero(SPACE))
