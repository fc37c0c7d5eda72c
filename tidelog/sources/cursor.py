"""A cursor over a resolved table, for programs that walk it row by row."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import access


class Cursor:
    """A position in one version of a table; unpositioned at first and after either end.

    A seek or a change of direction costs one top-k query. Beyond its first page
    a walk goes on as one sorted scan, of which the driver holds one partition at
    a time. Whole-table work belongs in ``Table.scan``, which stays distributed.
    """

    def __init__(self, rows: DataFrame, page: int = 256):
        self._rows, self._page = rows, page
        self._now, self._ahead, self._forward = None, iter(()), True

    def _walk(self, rows: DataFrame, forward: bool) -> Iterator:
        first = access.scan(rows, "key", reverse=not forward, limit=self._page).collect()
        yield from first
        if len(first) == self._page:
            rest = access.scan(rows.where(self._past(first[-1]["key"], forward)), "key", reverse=not forward)
            yield from rest.toLocalIterator()

    @staticmethod
    def _past(key: bytes, forward: bool) -> Column:
        at = F.lit(bytearray(key))
        return F.col("key") > at if forward else F.col("key") < at

    def _start(self, rows: DataFrame, forward: bool) -> None:
        self._ahead, self._forward = self._walk(rows, forward), forward
        self._now = next(self._ahead, None)

    def _step(self, forward: bool) -> None:
        if self._forward == forward:
            self._current()
            self._now = next(self._ahead, None)
        else:
            self._start(self._rows.where(self._past(self.key(), forward)), forward)

    def _current(self):
        if self._now is None:
            raise ValueError("the cursor is not at a row")
        return self._now

    def valid(self) -> bool:
        return self._now is not None

    def seek_to_first(self) -> None:
        self._start(self._rows, True)

    def seek_to_last(self) -> None:
        self._start(self._rows, False)

    def seek(self, key: bytes) -> None:
        """To the smallest key at or above ``key``; past the end the cursor is invalid."""
        self._start(self._rows.where(F.col("key") >= F.lit(bytearray(key))), True)

    def next(self) -> None:
        self._step(True)

    def prev(self) -> None:
        self._step(False)

    def key(self) -> bytes:
        return bytes(self._current()["key"])

    def value(self) -> bytes:
        return bytes(self._current()["value"])
