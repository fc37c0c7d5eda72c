"""N-gram Jaccard self-join with prefix trees.

Method: a text's set of 5-word shingles is ordered by one global order, rare
shingles first. Two sets that are similar enough share a shingle among the
first of their order (the prefix), so sets that are connected through prefix
shingles, among sets of like size, are brought together. There the sets, in order of size, are stored in a
trie whose nodes hold runs of shingles; a set looks for partners by walking it,
sharing what it overlaps with on the way, and leaves a subtree when sizes, or the
overlap so far plus what can still come, cannot reach the threshold, or when all
that hangs there is in its component already. Overlaps are counted in full, so
links are exact.

What moves: shingles are 48 bits of a 64-bit hash. A block of texts sends its
sorted (shingle, text) pairs, delta-coded, to buckets by shingle; a bucket
answers each block with those that occur elsewhere too. A shingle that 64 texts
of a block share is sent as a count alone, so no common shingle is hot. Texts
with so many shingles of their own that no prefix shingle is shared are done
there; they are most. Of the rest, texts with equal sets are one. Tasks give one
edge per set, never pairs, and the edges' components are found in alternating
stars.

Groups over ``GROUP`` sets are cut into blocks. First each block is joined by
itself, with a few sets of the group that all blocks have, which makes one
component of most of a family of near copies. Only sets outside the group's
largest component are then compared with the other blocks: sets of one component
need no comparison. So work follows the size of a family, and grows with a square
only by the sets that are not of it.

Defined cases: null and empty texts have no shingles, link with nothing and are
their own component; texts of under five words are one shingle; rows with a null
id take part, and get the component of the others, or null; repeated rows are
texts with equal sets; an empty table gives no rows; other columns are ignored.
"""

import math
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.groups import Sets, components, n_files, runs, screened
from tidelog.llm.text import Words, buffers, lean, mixed, shingles, slices, strings
from tidelog.sources.shared import SharedTables

WORDS = 5
#: Links have NUMERATOR * overlap >= DENOMINATOR * union.
NUMERATOR, DENOMINATOR = 100, 80
#: Texts of a block, or of all blocks, from which a shingle counts as common.
COMMON = 64
#: Bytes of text hashed together, of a block, and per bucket. A worker takes about ten times as much as a block or bucket has.
SLICE, BLOCK, BUCKET = 1 << 20, 8 << 20, 8 << 20
#: Sets, and shingles of theirs, that stay together in a group; sets of a larger group that all its blocks have.
GROUP, GROUP_GRAMS, PIVOTS = 256, 1 << 20, 16
#: Components with over one in HOT of all rows are joined without an exchange.
HOT = 256

#: Ratio of the sizes of neighbouring classes; just over the largest ratio of linked sets.
CLASS = 1.01 * NUMERATOR / DENOMINATOR

_ROWS = "kind int, bucket long, block long, doc_id long, text_hash long, n_shingles long, cid long, size long, idx int, payload binary"
_FIELDS = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.int32(), pa.binary()]
_SETS = "doc_id long, text_hash long, n_shingles long, cid long, size long, ahead int, ahead_small int, grams array<long>"
_DOC, _ANSWER, _PAIRS = 0, 1, 2
_HASH = np.uint64(16)
_LOW = np.uint64(0xFFFF)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _coded(keys: np.ndarray, counted: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted (shingle << 16 | text) keys, and shingles with counts."""
    h = keys >> _HASH
    step = np.diff(h, prepend=h[:1] * 0)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    raw = _planes(step, width) + _planes(keys & _LOW, 2) + counted.astype("<u8").tobytes() + times.astype("<u4").tobytes()
    return struct.pack("<IIBI", len(keys), len(counted), width, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, width, size = struct.unpack_from("<IIBI", payload)
    raw = pa.decompress(payload[13:], decompressed_size=size, codec="zstd", asbytes=True)
    h = np.cumsum(_unplaned(raw[: n * width], n, width), dtype=np.uint64)
    at = n * width
    keys = (h << _HASH) | _unplaned(raw[at : at + 2 * n], n, 2)
    at += 2 * n
    return keys, np.frombuffer(raw, "<u8", m, at).astype(np.uint64), np.frombuffer(raw, "<u4", m, at + 8 * m)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)


class _Block:
    """Texts whose shingles are sent together."""

    def __init__(self, number: int, n_buckets: int):
        self.number, self.edges = number, np.array([-(-(b << 48) // n_buckets) << 16 for b in range(1, n_buckets)], np.uint64)
        self.n_buckets, self.keys, self.cids, self.sizes, self.ids, self.size, self.bytes = n_buckets, [], [], [], [], 0, 0

    def add(self, named: list[pa.Array], texts: pa.StringArray) -> None:
        """``named``: ids and hashes of the texts."""
        data, at = buffers(texts)
        words = Words(data, at)
        h, doc = shingles(words, words.hashes(lower=True), WORDS)
        keys = np.sort((h & ~_LOW) | doc.astype(np.uint64))
        again = keys[1:] == keys[:-1]
        sizes = np.bincount((keys & _LOW).astype(np.int64), minlength=len(texts))
        if again.any():  # of the texts that repeat shingles, or have two that are one in 48 bits, those of 64 are counted
            odd = np.zeros(len(texts), bool)
            odd[(keys[1:][again] & _LOW).astype(np.int64)] = True
            at = odd[doc]
            pairs = np.unique(np.stack([doc[at].astype(np.uint64), h[at]], axis=1), axis=0)
            sizes[odd] = np.bincount(pairs[:, 0].astype(np.int64), minlength=len(texts))[odd]
            keys = np.append(keys[:1], keys[1:][~again])
        heads = np.flatnonzero(np.diff(doc, prepend=-1))  # a text's shingles are one run
        total = np.zeros(len(texts), np.uint64)
        if len(heads):
            total[doc[heads]] = np.add.reduceat(mixed(h.copy()), heads)
        self.sizes.append(sizes)
        self.cids.append(mixed(total + np.bincount(doc, minlength=len(texts)).astype(np.uint64)).view(np.int64))
        self.keys.append(keys + np.uint64(self.size))
        self.ids.append(named)
        self.size += len(texts)
        self.bytes += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate(self.keys))
        self.keys.clear()
        cids, n = np.concatenate(self.cids), self.size
        sizes = np.bincount((keys & _LOW).astype(np.int64), minlength=n)  # shingles as the join sees them, of 48 bits
        ids, hashes = (pa.concat_arrays(x) for x in zip(*self.ids, strict=True))
        yield _rows(kind=np.full(n, _DOC), bucket=np.arange(n) % self.n_buckets, block=np.full(n, self.number), doc_id=ids, text_hash=hashes, n_shingles=np.concatenate(self.sizes), cid=cids, size=sizes, idx=np.arange(n))
        # equal texts of a block speak once
        spoken = np.zeros(n, bool)
        spoken[np.unique(cids, return_index=True)[1]] = True
        keys = keys[spoken[(keys & _LOW).astype(np.int64)]]
        h = keys >> _HASH
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(h)))
        common = times >= COMMON
        counted = h[heads[common]]
        here = np.repeat(common, times)
        if here.any():
            yield _rows(kind=[_ANSWER], bucket=[self.number % self.n_buckets], block=[self.number], payload=[_answer(keys[here], np.ones(int(here.sum()), bool))])
        keys = keys[~here]
        cuts = [0, *np.searchsorted(keys, self.edges).tolist(), len(keys)]
        parts = [0, *np.searchsorted(counted, self.edges >> _HASH).tolist(), len(counted)]
        for b in range(self.n_buckets):
            lo, hi, p, q = cuts[b], cuts[b + 1], parts[b], parts[b + 1]
            if lo < hi or p < q:
                yield _rows(kind=[_PAIRS], bucket=[b], block=[self.number], payload=[_coded(keys[lo:hi], counted[p:q], times[common][p:q])])


def _answer(keys: np.ndarray, common: np.ndarray) -> bytes:
    raw = keys.astype("<u8").tobytes() + np.packbits(common).tobytes()
    return struct.pack("<II", len(keys), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _answered(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the global order: common shingles last)."""
    n, size = struct.unpack_from("<II", payload)
    raw = pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True)
    keys = np.frombuffer(raw, "<u8", n)
    common = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * n), count=n).astype(np.int64)
    return (keys & _LOW).astype(np.int64), (keys >> _HASH).astype(np.int64) | common << 48


def _send(n_buckets: int, block_bytes: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 28
        block = _Block(number, n_buckets)
        for batch in batches:
            texts = strings(batch.column(2))
            for lo, hi in slices(texts, SLICE):
                for at in range(lo, hi, 1 << 14):
                    n = min(1 << 14, hi - at)
                    if block.size + n > 1 << 16:
                        yield from block.rows()
                        number += 1
                        block = _Block(number, n_buckets)
                    block.add([batch.column(i).slice(at, n) for i in (0, 1)], texts.slice(at, n))
                if block.bytes >= block_bytes:
                    yield from block.rows()
                    number += 1
                    block = _Block(number, n_buckets)
        if block.size:
            yield from block.rows()

    return run


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of each bucket; rows of other kinds pass."""
    def passed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_pairs = np.asarray(batch.column(0)) == _PAIRS
            if not is_pairs.all():
                waiting.append(batch.filter(pa.array(~is_pairs)))
            if is_pairs.any():
                yield batch.filter(pa.array(is_pairs))

    waiting: list[pa.RecordBatch] = []
    for group in runs(passed(), ["bucket"]):
        yield from waiting
        waiting.clear()
        keys, owner, counted, times = [], [], [], []
        blocks = group["block"].to_pylist()
        for i, payload in enumerate(group["payload"]):
            k, c, t = _decoded(payload.as_py())
            keys.append(k)
            owner.append(np.full(len(k), i, np.int32))
            counted.append(c)
            times.append(t)
        bucket = group["bucket"][0].as_py()
        del group
        keys, owner, counted, times = map(np.concatenate, (keys, owner, counted, times))
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        del order
        h = keys >> _HASH
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        each = np.diff(np.append(heads, len(h)))
        total = each.astype(np.int64)
        if len(counted) and len(heads):
            spots = np.searchsorted(h[heads], counted)
            ok = (spots < len(heads)) & (h[heads][np.minimum(spots, len(heads) - 1)] == counted)
            np.add.at(total, spots[ok], times[ok].astype(np.int64))
        shared = np.repeat(total > 1, each)
        common = np.repeat(total >= COMMON, each)[shared]
        keys, owner = keys[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        keys, owner, common = keys[order], owner[order], common[order]
        at = np.searchsorted(owner, np.arange(len(blocks) + 1))
        for i, block in enumerate(blocks):
            if at[i] < at[i + 1]:
                yield _rows(kind=[_ANSWER], bucket=[bucket], block=[block], payload=[_answer(keys[at[i] : at[i + 1]], common[at[i] : at[i + 1]])])
    yield from waiting


def needed(a: int, b: int) -> int:
    """The least overlap of linked sets of sizes ``a`` and ``b``."""
    return -(-DENOMINATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _prefix(size: np.ndarray) -> np.ndarray:
    """Shingles at the start of a set's order of which a partner has one."""
    return size - -(-size * DENOMINATOR // NUMERATOR) + 1


@lean
def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and the ordered shared shingles of those texts whose prefix has any.

    ``ahead`` of them are in the prefix, ``ahead_small`` in the shorter one that
    is enough where the partner is not smaller; a text's own row has no shingles.
    """
    names = [c.split()[0] for c in _SETS.split(", ")]
    for group in runs(batches, ["block"]):
        kind = np.asarray(group["kind"])
        docs = group.filter(pa.array(kind == _DOC)).combine_chunks()
        answers = group.filter(pa.array(kind == _ANSWER))["payload"].to_pylist()
        del group
        n = docs.num_rows
        numbers = pa.nulls(n, pa.int32())
        own = [docs[c].combine_chunks() for c in names[:5]]
        yield pa.RecordBatch.from_arrays([*own, numbers, numbers, pa.nulls(n, pa.list_(pa.int64()))], names=names)
        if not answers:
            continue
        idx, place = zip(*map(_answered, answers), strict=True)
        answers.clear()
        idx, place = np.concatenate(idx), np.concatenate(place)
        order = np.lexsort((place, idx))
        idx, place = idx[order], place[order]
        del order
        n = int(np.asarray(docs["idx"]).max()) + 1
        size, cid = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[np.asarray(docs["idx"])], cid[np.asarray(docs["idx"])] = np.asarray(docs["size"]), np.asarray(docs["cid"])
        at = np.searchsorted(idx, np.arange(n + 1))
        del idx
        shared = np.diff(at)
        ahead = _prefix(size) - (size - shared)
        small = size - -(-DENOMINATOR * 2 * size // (NUMERATOR + DENOMINATOR)) + 1 - (size - shared)
        keep = np.flatnonzero((ahead > 0) & (shared > 0))
        for lo in range(0, len(keep), 512):
            rows = keep[lo : lo + 512]
            lengths = shared[rows]
            spots = np.arange(int(lengths.sum())) + np.repeat(at[rows] - np.cumsum(lengths) + lengths, lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(place[spots]))
            unnamed = pa.nulls(len(rows), pa.int64())
            counts = [pa.array(np.clip(x[rows], 0, lengths).astype(np.int32)) for x in (ahead, small)]
            yield pa.RecordBatch.from_arrays([unnamed, unnamed, unnamed, pa.array(cid[rows]), pa.array(size[rows]), *counts, lists], names=names)


class _Node:
    """A run of shingles, and what hangs below it."""

    __slots__ = ("below", "ends", "largest", "longest", "mark", "run", "smallest")

    def __init__(self, run: list, size: int, mark: int | None):
        self.run, self.below, self.ends = run, {}, []
        self.smallest = self.largest = size
        self.longest = 0  # most shingles on a way below the run
        self.mark = mark  # a member, if all members here were of one component; else None


class Trie:
    """Ordered sets for partner search; ``sets`` holds the components found."""

    STEP = 16

    def __init__(self, n: int):
        self.root, self.sets, self.sizes = _Node([], 0, None), Sets(n), [0] * n

    def insert(self, number: int, grams: list, size: int) -> None:
        self.sizes[number] = size
        node, at, sets = self.root, 0, self.sets
        while True:
            if node is not self.root:
                node.smallest, node.largest = min(node.smallest, size), max(node.largest, size)
                if node.mark is not None and sets.find(node.mark) != sets.find(number):
                    node.mark = None
            node.longest = max(node.longest, len(grams) - at)
            if at == len(grams):
                node.ends.append(number)
                return
            child = node.below.get(grams[at])
            if child is None:
                child = node.below[grams[at]] = _Node(grams[at:], size, number)
                child.ends.append(number)
                return
            run, k = child.run, 1
            while k < len(run) and at + k < len(grams) and run[k] == grams[at + k]:
                k += 1
            if k < len(run):  # the run is cut where the sets part
                upper = _Node(run[:k], child.smallest, child.mark)
                upper.largest, upper.longest = child.largest, child.longest + len(run) - k
                child.run = run[k:]
                upper.below[child.run[0]] = child
                node.below[grams[at]] = upper
                child = upper
            node, at = child, at + k

    def search(self, number: int, grams: list, size: int) -> None:
        """Links set ``number``, of at least the size of all that are stored, with one partner in each component."""
        sets, own, sizes = self.sets, set(grams), self.sizes
        smallest = -(-size * DENOMINATOR // NUMERATOR)
        stack = [(c, 0) for c in self.root.below.values()]
        for i in range(len(stack)):  # branches that start with a shingle of its own come first
            if stack[i][0].run[0] in own:
                stack.append(stack[i])
                stack[i] = None
        while stack:
            top = stack.pop()
            if top is None:
                continue
            node, overlap = top
            if node.largest < smallest or (node.mark is not None and sets.find(node.mark) == sets.find(number)):
                continue
            least = needed(max(node.smallest, smallest), size)
            run, lost = node.run, False
            rest = len(run) + node.longest
            for lo in range(0, len(run), self.STEP):
                if overlap + min(rest, len(grams) - bisect_right(grams, run[lo] - 1)) < least:
                    lost = True
                    break
                piece = run[lo : lo + self.STEP]
                overlap += len(own.intersection(piece))
                rest -= len(piece)
            if lost or overlap + min(rest, len(grams) - bisect_right(grams, run[-1])) < least:
                continue
            for other in node.ends:
                if sizes[other] >= smallest and overlap >= needed(sizes[other], size):
                    sets.join(number, other)
            stack += [(c, overlap) for c in node.below.values()]


def _joined(group: pa.Table) -> dict[str, np.ndarray]:
    """An edge from each label of a group to the smallest label that its sets reach here; sets of one label are one component."""
    cid, first = np.unique(np.asarray(group["cid"]), return_index=True)
    size, label = np.asarray(group["size"])[first], np.asarray(group["label"])[first]
    none = {"a": label[:0], "b": label[:0]}
    if (label == label[0]).all():
        return none
    lists = group["grams"].combine_chunks().take(pa.array(first))
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    # places in the group's own order; each number is one object, however many sets have it
    known, rank = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    flat = np.arange(len(known)).astype(object)[rank]
    grams = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    trie = Trie(len(cid))
    by_label = np.argsort(label, kind="stable")
    same = label[by_label[1:]] == label[by_label[:-1]]
    for i, j in zip(by_label[1:][same].tolist(), by_label[:-1][same].tolist(), strict=True):
        trie.sets.join(i, j)
    for i in np.lexsort((cid, size)).tolist():
        trie.search(i, grams[i], int(size[i]))
        trie.insert(i, grams[i], int(size[i]))
    root = np.array([trie.sets.find(i) for i in range(len(cid))])
    smallest = np.full(len(cid), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, label)
    moved = np.flatnonzero(label != smallest[root])
    moved = moved[np.unique(label[moved], return_index=True)[1]]
    return {"a": label[moved], "b": smallest[root[moved]]}


@lean
def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["comp", "part"]):
        if group.num_rows > 1:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in _joined(group).items()})


def _classed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and class of every row, in the shared folder; rows that reach each other by links have one class, those without words none."""
    shared = SharedTables(docs.sparkSession)
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_buckets = max(1, min(-(-n_bytes // bucket_bytes), 1 << 24))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    sent = texts.mapInArrow(_send(n_buckets, block_bytes), _ROWS)
    met = sent.repartition(min(n_buckets, 100_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _ROWS).drop("bucket")
    sets = shared.put(met.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_assemble, _SETS))
    own_rows, sets = sets.where("ahead is null").select("doc_id", "text_hash", "n_shingles", "cid"), sets.where("ahead is not null").select("cid", "size", "ahead", "ahead_small", "grams")
    # linked sets are of one size class, or the smaller is of the class below and is shown in the other too
    size_class = F.floor(F.log("size") / math.log(CLASS)).cast("int")
    own = sets.select("cid", size_class.alias("class"), F.lit(1).alias("native"), F.slice("grams", F.lit(1), F.col("ahead")).alias("_h"))
    up = sets.select("cid", (size_class + 1).alias("class"), F.lit(0).alias("native"), F.slice("grams", F.lit(1), F.col("ahead_small")).alias("_h"))
    node = F.xxhash64("cid", "class")
    heads = own.unionByName(up).select(node.alias("n"), "native", F.explode("_h").alias("_g"), "class").select("n", "native", F.xxhash64("_g", "class").alias("gram"))
    least = heads.groupBy("gram").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("native").alias("natives")).where("least < most and natives = 1")
    met_by = heads.join(least.select(F.col("gram").alias("_gram"), "least"), F.col("gram") == F.col("_gram")).where("n <> least").select(F.col("n").alias("a"), F.col("least").alias("b"))
    rough = components(met_by)
    rough = rough.unionByName(rough.select(F.col("root").alias("node"), "root").distinct())
    # only numbers move until it is known where a set goes
    shown = sets.select("cid", F.size("grams").alias("_w"), F.explode(F.array(size_class, size_class + 1)).alias("class")).groupBy("cid", "class").agg(F.max("_w").alias("_w")).select("cid", "_w", node.alias("_n"))
    place = shared.put(shown.join(rough, F.col("_n") == F.col("node")).groupBy(F.col("root").alias("comp"), "cid").agg(F.max("_w").alias("_w")))
    roots = _linked(sets, place, shared)
    rows = own_rows.join(roots, F.col("cid") == F.col("node"), "left")
    return shared.put(rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "cid")).alias("class")))


def _linked(sets: DataFrame, place: DataFrame, shared: SharedTables) -> DataFrame:
    """(node, root) of linked sets; ``place`` has the groups (comp, cid, _w: shingles) within which sets may link."""
    files = n_files(sets.sparkSession, place.count())
    sets = sets.select(F.col("cid").alias("_cid"), "size", "grams")

    def joined(parts: DataFrame, sets: DataFrame) -> DataFrame:
        alone = sets.dropDuplicates(["_cid"])
        close = alone.join(parts, F.col("cid") == F.col("_cid")).select("comp", "part", "cid", "label", "size", "grams")
        return close.repartition("comp", "part").sortWithinPartitions("comp", "part").mapInArrow(_join, "a long, b long")

    blocks = lambda n, w: F.ceil(F.greatest(n / GROUP, w / GROUP_GRAMS)).cast("long")
    pick = lambda n: F.pmod(F.xxhash64("cid"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    n, w = F.count(F.lit(1)), F.sum("_w")
    big = shared.put(place.groupBy(F.col("comp").alias("_comp")).agg(n.alias("_n"), blocks(n, w).alias("_blocks")).where("_blocks > 1").coalesce(files))
    held = place.join(big, F.col("comp") == F.col("_comp"), "left")
    pivot = F.pmod(F.xxhash64("cid", F.lit("pivot")), F.lit(1 << 30)) * F.col("_n") < F.lit(PIVOTS << 30)
    own = F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("long"))).when(pivot, upto(F.col("_blocks"))).otherwise(F.array(pick(F.col("_blocks"))))
    roots = components(joined(held.select("comp", F.explode(own).alias("part"), "cid", F.col("cid").alias("label")), sets))
    if not big.count():
        return roots
    # within large groups: sets outside the largest component, against each other and all the rest
    label = F.coalesce("root", "cid").alias("label")
    labelled = shared.put(place.join(big, F.col("comp") == F.col("_comp")).join(roots, F.col("cid") == F.col("node"), "left").select("comp", "cid", "_w", label).coalesce(files))
    largest = labelled.groupBy("comp", "label").agg(n.alias("_n")).groupBy(F.col("comp").alias("_comp")).agg(F.max(F.struct("_n", "label"))["label"].alias("_largest"))
    flagged = labelled.join(shared.put(largest.coalesce(files)), F.col("comp") == F.col("_comp")).withColumn("_out", F.col("label") != F.col("_largest")).drop("_comp")
    count = lambda which: F.count(F.when(which, 1))
    weight = lambda which: F.coalesce(F.sum(F.when(which, F.col("_w"))), F.lit(0))
    out, rest = F.col("_out"), ~F.col("_out")
    loads = flagged.groupBy(F.col("comp").alias("_comp")).agg(blocks(count(out), weight(out)).alias("_o"), F.greatest(blocks(count(rest), weight(rest)), F.lit(1)).alias("_g")).where("_o > 0")
    loads = shared.put(loads.coalesce(files))
    if not loads.count():
        return roots
    o, g = F.col("_o"), F.col("_g")
    among = F.transform(upto(o), lambda x: F.least(pick(o), x) * o + F.greatest(pick(o), x))
    across = F.transform(upto(g), lambda x: o * o + pick(o) * g + x)
    to = F.when(out, F.concat(among, across)).otherwise(F.transform(upto(o), lambda x: o * o + x * g + pick(g)))
    aimed = shared.put(flagged.join(loads, F.col("comp") == F.col("_comp")).select("comp", to.alias("_to"), "cid", "label").coalesce(files))
    parts = aimed.select("comp", F.explode("_to").alias("part"), "cid", "label")
    some, _ = screened(sets, F.col("_cid"), aimed.select("cid"))  # the shingles of sets that are not compared again stay where they are
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(joined(parts, some)))


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the columns of their class, null for those without; ``classes`` are _class, n (rows) and others.

    Classes with over a HOT-th of all rows, fewer than HOT, come to their rows; only the rows of others are dealt by class.
    """
    n_rows = rows.count()
    classes = SharedTables(rows.sparkSession).put(classes.coalesce(n_files(rows.sparkSession, n_rows)))
    hot = F.col("n") * HOT > n_rows
    large, small = F.broadcast(classes.where(hot)), classes.where(~hot)
    on = F.col("class") == F.col("_class")
    there = rows.join(large, on, "left").where("_class is not null or class is null")
    dealt = rows.where("class is not null").join(large, on, "left_anti").join(small, on, "left")
    return there.unionByName(dealt)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    With larger blocks and buckets a row that moves holds more shingles: as many
    as a block has, over the number of buckets. Texts of many TB want some 128
    MB a block and 1 GB a bucket, and workers with ten times that.
    """
    rows = _classed(docs, id_col, text_col, block_bytes, bucket_bytes)
    classes = rows.where("class is not null").groupBy(F.col("class").alias("_class")).agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _with_classes(rows, classes).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id, nulls last.

    Rows are told apart by id and text, so that two texts that share an id are
    two documents; of rows that repeat both, one stays. Rows without words stay.
    """
    shared = SharedTables(docs.sparkSession)
    rows = _classed(docs, id_col, text_col, BLOCK, BUCKET).where("class is not null")
    named = shared.put(rows.groupBy("doc_id", "text_hash", "class").agg(F.count(F.lit(1)).alias("_times")))
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    classes = named.groupBy(F.col("class").alias("_class")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = _with_classes(named, classes).withColumn("_kept", F.coalesce(order == F.col("_first"), F.lit(True)))
    # all others of a class go; so does a first one that repeats, of which one row comes back
    gone = shared.put(held.where("not _kept or _times > 1").select(F.col("doc_id").alias("_tidelog_id"), F.col("text_hash").alias("_tidelog_hash"), "_kept"))
    hashed = F.xxhash64(F.col(text_col))
    here = F.col(id_col).cast("long").eqNullSafe(F.col("_tidelog_id")) & (hashed == F.col("_tidelog_hash"))
    # texts of which nothing is gone stay where they are
    near, clear = screened(docs, F.xxhash64(F.col(id_col).cast("long"), hashed), gone.select(F.xxhash64("_tidelog_id", "_tidelog_hash")))
    alone = near.join(gone, here, "left_anti")
    first = near.join(gone.where("_kept"), here, "left_semi").withColumn("_tidelog_hash", hashed).dropDuplicates([id_col, "_tidelog_hash"]).drop("_tidelog_hash")
    return clear.unionByName(alone).unionByName(first)
