"""Quality rules with suffix-array repetition.

Method: the words of many texts are ranked by prefix doubling, texts apart, so
that one sort orders all their suffixes. Neighbours in that order give the
longest common prefixes; every interval of the suffix order with a common
prefix of at least ``MIN_REPEAT`` words is a maximal repeated substring, and the
spans of all its occurrences are united. A suffix's deepest interval holds all
the shorter ones it lies in, so per suffix the larger of its two neighbouring
prefix lengths gives the whole union. A text fails if the united spans cover
more than ``MAX_COVERED`` of its words or the longest repeat has more than
``MAX_LONGEST`` of them, in words at least ``LONGEST_FLOOR`` and at most
``LONGEST_CEILING``. A passage that stands twice covers twice its length, so the
second limit is below half of the first: it tells one long passage from as many
words in short ones, and does not grow with very long texts.

The base rules fail texts of under 50 words, and those with over half of their
words in 3-word windows found twice or more.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows and ties are judged each alike; an empty table gives no rows;
texts are taken whole at any length; other columns are not touched.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.text import SPACE, Words, buffers, lean, slices, strings, windows

#: Limits of the verdict.
MIN_REPEAT, MAX_COVERED = 8, 0.3
MAX_LONGEST, LONGEST_FLOOR, LONGEST_CEILING = 0.1, 50, 500
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bytes of text that are ranked together.
SLICE = 1 << 20

SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long,
    covered_words long, base_failed boolean, kept boolean"""
COLUMNS = [c.split()[0] for c in SCHEMA.split(",")]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), equal pairs alike."""
    pair = a.astype(np.int64) * (int(b.max(initial=0)) + 2) + b
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def longest_repeats(doc: np.ndarray, token: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run starting there that starts elsewhere in its text too.

    ``doc`` is non-decreasing. Level k ranks the runs of 2**k words; a run that
    would leave its text ranks apart from all others. Only suffixes that still
    share their rank are looked at again, so work falls with each doubling. The
    common prefix of two neighbours in suffix order is then read off the levels,
    from the highest down.
    """
    n = len(token)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, "right")
    left = end - np.arange(n)  # words up to the end of the text
    levels = [_dense(doc, token)]
    span = 1
    tied = np.arange(n)
    while True:
        rank = levels[-1]
        counts = np.bincount(rank)
        tied = tied[(counts[rank[tied]] > 1)]
        tied = tied[left[tied] > span]
        if not len(tied):
            break
        following = tied + span
        pair = rank[tied] * n + rank[following]
        _, dense = np.unique(pair, return_inverse=True)
        new = np.arange(n) + len(tied)  # of its own where it is not looked at
        new[tied] = dense
        # a run of 2 * span words must lie within its text
        out = left[tied] < 2 * span
        new[tied[out]] = tied[out] + len(tied)
        levels.append(new)
        span *= 2
    # suffix order: by the first word's rank, refined level by level
    order = _suffix_order(levels[0], left, end)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    i, j = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (i < end[a]) & (j < end[b]) & (doc[a] == doc[b])
        same = np.zeros(n - 1, bool)
        same[ok] = levels[k][i[ok]] == levels[k][j[ok]]
        step = np.where(same, 1 << k, 0)
        common += step
        i += step
        j += step
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _suffix_order(first: np.ndarray, left: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix array of all texts: prefix doubling on the suffixes that are not yet told apart."""
    n = len(first)
    rank = first.copy()
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    # a suffix's rank is the place of the first of its group
    starts = np.searchsorted(ordered, ordered, "left")
    rank[order] = starts
    del new
    span = 1
    while True:
        groups = rank[order]
        same = np.zeros(n, bool)
        same[1:] = groups[1:] == groups[:-1]
        same[:-1] |= same[1:]
        at = np.flatnonzero(same)
        if not len(at):
            return order
        suffix = order[at]
        ahead = suffix + span
        inside = ahead < end[suffix]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if not inside.any():
            # the text has ended for all that are left: the shorter suffix goes first
            return order
        key = np.lexsort((second, groups[at]))
        order[at] = suffix[key]
        g, s = groups[at][key], second[key]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        base = np.concatenate([[True], g[1:] != g[:-1]])
        base_at = np.maximum.accumulate(np.where(base, np.arange(len(at)), 0))
        rank[order[at]] = g + (lead - base_at)
        span *= 2


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places the spans [start, start + length) cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step)[:n] > 0


def longest_allowed(n_words: np.ndarray) -> np.ndarray:
    """Words that the longest repeat of a text of ``n_words`` may have."""
    return np.clip(MAX_LONGEST * n_words, LONGEST_FLOOR, LONGEST_CEILING)


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def _duplicate_lines(data: np.ndarray, at: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, compared by their bytes."""
    out = np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    many = np.flatnonzero(np.searchsorted(breaks, at[1:]) > np.searchsorted(breaks, at[:-1]))
    for i in many:
        lines = data[at[i] : at[i + 1]].tobytes().split(b"\n")
        held = [x for x in lines if x.strip(b" \t\n\v\f\r")]
        out[i] = len(held) - len(set(held))
    return out


def measure(texts: pa.StringArray) -> pa.RecordBatch:
    """One row per text with the columns of ``SCHEMA``."""
    data, at = buffers(texts)
    n = len(texts)
    words = Words(data, at)
    hashes = words.hashes()
    lead = ((data & 0xC0) != 0x80) & ~SPACE[data]
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    tri, doc, first = windows(words, hashes, 3)
    repeated = np.zeros(0, np.int64)
    if len(tri):
        order = np.lexsort((tri, doc))
        same = (tri[order][1:] == tri[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(tri), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = first[twice]
    in_repeats = _covered(repeated, np.full(len(repeated), 3), len(hashes))
    token = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.zeros(0, np.int64)
    runs = longest_repeats(words.doc, token)
    long = np.flatnonzero(runs >= MIN_REPEAT)
    spans = _covered(long, runs[long], len(hashes))
    n_words = words.count.astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.doc, runs)
    n_repeat, covered = _by_doc(in_repeats, words.doc, n), _by_doc(spans, words.doc, n)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (covered <= MAX_COVERED * n_words) & (longest <= longest_allowed(n_words))
    columns = [n_words, per_doc(lead), per_doc(_SYMBOL[data]), _duplicate_lines(data, at, words, n), n_repeat, longest, covered, failed, kept]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=COLUMNS)


def judged(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of each document with the columns of ``SCHEMA``: one pass without a shuffle."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(batch.num_columns - 1))
            for lo, hi in slices(texts, SLICE):
                found = measure(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[:-1]] + found.columns, names=keys + COLUMNS)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{kinds}, {SCHEMA}")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index(text)))
            for lo, hi in slices(texts, SLICE):
                kept = measure(texts.slice(lo, hi - lo)).column(COLUMNS.index("kept"))
                yield batch.slice(lo, hi - lo).filter(kept)

    return docs.mapInArrow(run, docs.schema)
