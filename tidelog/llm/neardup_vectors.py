"""Near-duplicate vectors by collision-counting projections.

Method: vectors of length 1 are projected on many fixed directions and sorted
along each; two vectors collide on a direction if one lies in the window around
the other. Collisions are counted per pair, and pairs with enough of them are
verified by their cosine in double precision. Window and count are calibrated on
pairs placed at just the wanted cosine, of which 99 % must pass.

Counting every pair would take time with the square of the input, so vectors
are first dealt into cells by the signs of ``k`` further projections, in ``T``
independent tables; k grows with the logarithm of the number of vectors, which
keeps cells near ``CELL`` vectors, and T is chosen so that a pair at the wanted
cosine shares a cell with a probability of at least 98 %. A pair is counted in
the first table that has it in one cell, so nothing is counted twice and no list
of pairs is ever made: tasks give the number of links per vector, and at most
one edge per vector of the cell for the components. Cells over ``BLOCK``
vectors are split into pairs of blocks.

What moves is a vector with its number, once per table. Which cells it has in
the tables before is worked out again where it arrives; these projections are
of whole numbers, small enough that their sums are exact in any order, so that
every task finds the same signs. Equal vectors are one, numbered, with a weight.

Defined cases: null, zero, and vectors with null or non-finite components link
with nothing, as do rows without an id (their component is null and they are
not kept); vectors of different lengths do not link; rows that share an id are
vectors of their own; an empty table gives no rows; other columns are ignored.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.groups import Sets, components, dealt, runs
from tidelog.llm.text import lean
from tidelog.sources.shared import SharedTables

THRESHOLD = 0.9
DIRECTIONS, CELL, BLOCK = 24, 512, 1024
RECALL, CELL_RECALL = 0.99, 0.98


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(k, T) for ``n`` vectors."""
    k = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, 1 if k == 0 else math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - same))


@lru_cache(64)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """(dim, n) directions of length sqrt(dim), from a fixed seed."""
    out = np.random.default_rng([seed, dim, n]).normal(size=(dim, n))
    return out * math.sqrt(dim) / np.linalg.norm(out, axis=0)


#: Steps to which components and directions are rounded for signs: products of up to 2**12 of them add up exactly in a double.
STEPS = float(1 << 20)


@lru_cache(256)
def _whole_directions(dim: int, k: int, table: int) -> np.ndarray:
    d = directions(dim, k, 100 + table)
    return np.rint(d * (STEPS / np.abs(d).max()))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors (n, dim) times powers of two, exactly, so that squares of theirs are in range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def cell_of(v: np.ndarray, k: int, table: int) -> np.ndarray:
    """The signs of scaled vectors (n, dim), with their length, as one number each."""
    n, dim = v.shape
    if not k:
        return np.full(n, dim, np.int64)
    whole = np.rint(v * (STEPS / np.abs(v).max(1, keepdims=True)))
    total = np.zeros((n, k))
    for lo in range(0, dim, 1 << 12):  # exact sums each; their total is taken in a fixed order
        total += whole[:, lo : lo + (1 << 12)] @ _whole_directions(dim, k, table)[lo : lo + (1 << 12)]
    return ((total > 0) @ (1 << np.arange(k, dtype=np.int64))) * 65536 + dim % 65536


@lru_cache(64)
def calibrated(dim: int, threshold: float = THRESHOLD) -> tuple[float, int]:
    """Half-width of a window, and the collisions that RECALL of the pairs at ``threshold`` reach."""
    rng = np.random.default_rng([7, dim])
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(4000, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * np.divide(y, length, out=np.zeros_like(y), where=length > 1e-9)
    gap = np.abs((x - y) @ directions(dim, DIRECTIONS, 1))
    width = float(np.quantile(gap, 0.9))
    return width, int(np.quantile((gap <= width).sum(1), 1 - RECALL, method="lower"))


def collisions(left: np.ndarray, right: np.ndarray, width: float) -> np.ndarray:
    """(n, m) counts of directions on which a left vector's window holds a right vector.

    Along a direction the right vectors are sorted once; a window is a range of
    places in that order, and holds the vectors whose places lie in it.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.uint8)
    kind = np.uint16 if m < 1 << 16 else np.int64
    places, place = np.arange(m, dtype=kind), np.empty(m, kind)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        place[order] = places
        lo = np.searchsorted(line, left[:, k] - width, "left").astype(kind)[:, None]
        hi = np.searchsorted(line, left[:, k] + width, "right").astype(kind)[:, None]
        out += (place >= lo) & (place < hi)
    return out


def _linked(cell: pa.Table, k: int, threshold: float) -> dict[str, np.ndarray]:
    """The vectors of one part of a cell with links counted here and an edge to the smallest they reach here."""
    number, copies, table = np.array(cell["number"]), np.array(cell["copies"]), cell["t"][0].as_py()
    n = len(number)
    v = scaled(np.array(cell["v"].combine_chunks().flatten(), np.float64).reshape(n, -1))
    none = {"number": number[:0], "links": number[:0], "root": number[:0]}
    marks = np.empty((n, table), np.int64)
    for t in range(table):
        marks[:, t] = cell_of(v, k, t)
        if (marks[:, t] == marks[0, t]).all():
            return none  # all are in one cell there
    norm = np.sqrt((v * v).sum(1))
    along = (v / norm[:, None]) @ directions(v.shape[1], DIRECTIONS, 1)
    width, least = calibrated(v.shape[1], threshold)
    first = np.array(cell["first"])
    crossed = not first.all()
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if crossed else (np.arange(n), np.arange(n))
    links, sets = np.zeros(n, np.int64), Sets(n)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(collisions(along[rows], along[right], width) >= least)
        i, j = rows[i], right[j]
        if not crossed:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            new = ~(marks[a] == marks[b]).any(1)  # no earlier table has them in one cell
            a, b = a[new], b[new]
            near = (v[a] * v[b]).sum(1) / (norm[a] * norm[b]) >= threshold
            a, b = a[near], b[near]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                sets.join(x, y)
    root = np.array([sets.find(a) for a in range(n)])
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, number)
    keep = links > 0
    return {"number": number[keep], "links": links[keep], "root": smallest[root][keep]}


def linked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    shared = SharedTables(vectors.sparkSession)
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = all_rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    classes = rows.where("_ok").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = shared.put(classes.withColumn("number", F.monotonically_increasing_id()))  # numbers hold once they are written
    k, tables = tables_for(classes.count(), threshold)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(np.array(lists.offsets))
            groups = [(at, scaled(np.array(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1))) for at in (np.flatnonzero(sizes == dim) for dim in np.unique(sizes))]
            for t in range(tables):
                marks = np.zeros(batch.num_rows, np.int64)
                for at, v in groups:
                    marks[at] = cell_of(v, k, t)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(marks)], names=["v", "number", "copies", "t", "mark"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt_out = classes.select("v", "number", "copies").mapInArrow(deal, f"v {kind}, number long, copies long, t int, mark long")
    cells = dealt_out.withColumn("cell", F.xxhash64("t", "mark")).drop("mark")
    spread = dealt(cells, "cell", F.col("number"), BLOCK).select("cell", "part", "first", "t", "number", "copies", "v")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "part"]):
            if group.num_rows > 1:
                yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in _linked(group, k, threshold).items()})

    found = shared.put(spread.mapInArrow(count, "number long, links long, root long"))
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("number").alias("a"), F.col("root").alias("b")))
    numbered = classes.select("number", "rep").join(roots, F.col("number") == F.col("node"), "left").select("number", "rep", F.coalesce("root", "number").alias("_root"))
    smallest = numbered.groupBy("_root").agg(F.min("rep").alias("_component"))
    placed = numbered.join(smallest, "_root").select("number", "_component")
    near = classes.join(links, "number", "left").join(placed, "number")
    near = near.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "_component")
    out = rows.join(near, rows["_ok"] & (rows["v"] == near["_v"]), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
