"""Language identification by sparse multinomial logistic regression.

Method: texts become TF-IDF vectors of hashed character n-grams (1 to 3, over
lower-cased letters with word edges); the weights are trained with
follow-the-regularised-leader under elastic-net penalties, one document at a
time; a temperature fitted on documents that training has not seen calibrates
the probabilities.

Document frequencies are counted over all training documents. Only the weights
and the temperature are fitted on a sample, of at most about ``PER_LANG``
documents of each language and ``SAMPLE`` in all, drawn by a hash of the id. The
driver holds that sample's vectors and the model, whose sizes do not grow with
the corpus: the ``LANGUAGES`` languages with the most documents are told apart.

Defined cases: a null text, and one without letters, is ``und`` with score 0;
null languages and null ids are not learned from; with no training document all
is ``und``; repeated rows count as often as they stand; ties go to the first
language by code point; texts are read whole; other columns are carried or
ignored.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.groups import n_files
from tidelog.llm.text import lean, slices, strings
from tidelog.sources.shared import SharedTables

BUCKETS, LONGEST = 1 << 14, 3
#: Documents of a language that weights and temperature are fitted on; every sixth is for the temperature.
PER_LANG, SAMPLE, LANGUAGES, EPOCHS = 1500, 24_000, 256, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
#: Largest count of a bucket in one row.
MOST = (1 << 31) - 1
#: Bytes and texts vectorised together.
SLICE, ROWS = 1 << 20, 128


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse n-gram counts as (doc, bucket, count), sorted, and which texts have letters."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])  # one space after a word
    keep[:1] = True
    keep[1:] |= doc[1:] != doc[:-1]  # and one before the first
    value = np.where(letter, points, 32)[keep].astype(np.uint64) + np.uint64(1)
    doc, letter = doc[keep], letter[keep]
    cells = []
    for n in range(1, LONGEST + 1):
        h = np.full(max(len(value) - n + 1, 0), np.uint64(n * 0x9E3779B9))
        for j in range(n):
            h = (h + value[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = doc[: len(h)] == doc[n - 1 : n - 1 + len(h)]
        if n == 1:
            ok = letter
        cells.append(doc[: len(h)][ok] * BUCKETS + (h[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    dense = np.bincount(np.concatenate(cells), minlength=len(texts) * BUCKETS)
    cell = np.flatnonzero(dense)
    return cell // BUCKETS, cell % BUCKETS, dense[cell], np.bincount(doc[letter], minlength=len(texts)) > 0


def _parts(texts: pa.StringArray) -> Iterator[tuple[int, list[str]]]:
    for lo, hi in slices(texts, SLICE):
        for at in range(lo, hi, ROWS):
            yield at, texts.slice(at, min(ROWS, hi - at)).to_pylist()


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (bucket, label)
    bias: np.ndarray
    temperature: float = 1.0

    def vectors(self, doc, bucket, count, n) -> np.ndarray:
        """TF-IDF values, each document's of length 1."""
        x = (1 + np.log(count)) * self.idf[bucket]
        norm = np.sqrt(np.bincount(doc, x * x, minlength=n))
        return x / np.maximum(norm[doc], 1e-12)

    def probabilities(self, doc, bucket, count, n) -> np.ndarray:
        x = self.vectors(doc, bucket, count, n)
        z = np.stack([np.bincount(doc, x * self.weights[bucket, c], minlength=n) for c in range(len(self.labels))], axis=1)
        return softmax((z + self.bias) / self.temperature)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        doc, bucket, count, known = counts(texts)
        p = self.probabilities(doc, bucket, count, len(texts))
        best = p.argmax(1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression; bucket ``BUCKETS`` is the bias."""

    def __init__(self, n_labels: int):
        self.z, self.n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, bucket: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def _remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id, 3) == 1, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model from (doc_id, text, lang), of the documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(F.col("doc_id"), 3) != 1)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    each = min(PER_LANG, SAMPLE // len(labels))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sizes.items()], "lang string, _share double")
    usable = usable.join(F.broadcast(shares), "lang")  # LANGUAGES rows at most
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20)) < F.col("_share") * (1 << 20)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            langs, drawn = batch.column(0), batch.column(1)
            for at, texts in _parts(strings(batch.column(2))):
                doc, bucket, count, _ = counts(texts)
                seen += np.bincount(bucket, minlength=BUCKETS)
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                rows = [i for i in range(len(texts)) if drawn[at + i].as_py()]
                if rows:
                    part = lambda values: [values[edges[i] : edges[i + 1]] for i in rows]  # noqa: E731, B023
                    yield _vectors([langs[at + i].as_py() for i in rows], part(bucket), part(count))
        for at in range(0, BUCKETS, 1 << 12):  # a count per bucket, in parts that fit their type
            part = seen[at : at + (1 << 12)]
            while part.any():
                yield _vectors([None], [np.arange(at, at + len(part))], [np.minimum(part, MOST)])
                part = part - np.minimum(part, MOST)

    shared = SharedTables(docs.sparkSession)
    found = usable.select("lang", drawn.alias("drawn"), "text").mapInArrow(run, "lang string, buckets array<short>, counts array<int>")
    found = shared.put(found.repartition(n_files(docs.sparkSession, sum(sizes.values()))))  # not a file per task: each has little
    total = found.where("lang is null").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    df = np.zeros(BUCKETS)
    for bucket, n in total.collect():
        df[bucket] = n
    sample = found.where("lang is not null").toArrow()
    shared.drop()
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    return _train(labels, idf, sample)


def _vectors(langs, buckets, values) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), pa.array(np.concatenate(v), kind)) for v, kind in ((buckets, pa.int16()), (values, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *lists], names=["lang", "buckets", "counts"])


def _train(labels: list[str], idf: np.ndarray, sample: pa.Table) -> Model:
    model = Model(labels, idf, np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)))
    number = {x: i for i, x in enumerate(labels)}
    # views of Arrow's buffers; a row is widened while it is used
    rows = [(number[lang], b, c) for lang, b, c in zip(sample["lang"].to_pylist(), _arrays(sample["buckets"]), _arrays(sample["counts"]), strict=True) if len(b)]
    rows.sort(key=lambda r: (len(r[1]), int(r[1].sum()), int(r[2].sum()), r[0], crc32(r[1]), crc32(r[2])))  # the same order at every run
    order = np.random.default_rng(17).permutation(len(rows))
    spare, taught = order[::6], np.delete(order, slice(None, None, 6))
    learner = Ftrl(len(labels))
    for _ in range(EPOCHS):
        for i in taught:
            y, b, c = rows[i]
            learner.learn(b.astype(np.int64), model.vectors(np.zeros(len(b), np.int64), b, c, 1), y)
    w = learner.weights()
    model.weights, model.bias = w[:-1], w[-1]
    if len(spare):
        model.temperature = _temperature(model, [rows[i] for i in spare])
    return model


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, at = np.asarray(chunk.flatten()), np.asarray(chunk.offsets)
        out += [flat[lo - at[0] : hi - at[0]] for lo, hi in zip(at[:-1], at[1:], strict=True)]
    return out


def _temperature(model: Model, rows: list) -> float:
    """The temperature of least log loss on ``rows``, from 0.02 to 20.

    Targets are smoothed by one document per label, so that a model that is
    right on all rows is not made certain.
    """
    z = np.stack([model.vectors(np.zeros(len(b), np.int64), b, c, 1) @ model.weights[b] + model.bias for _, b, c in rows])
    target = np.full(z.shape, 1.0)
    target[np.arange(len(rows)), [r[0] for r in rows]] += len(rows)
    target /= target.sum(1, keepdims=True)
    loss = lambda t: -(target * np.log(np.maximum(softmax(z / t), 1e-12))).sum(1).mean()
    return float(min(np.geomspace(0.02, 20, 121), key=loss))


def predicted(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` of each document with ``lang_pred`` and ``score``; only the text is read for them."""
    spec = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predict(shipped.value, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], langs, scores], names=[*keys, "lang_pred", "score"])

    return docs.select(*keys, "text").mapInArrow(run, f"{spec}, lang_pred string, score double")


def _predict(model: Model, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    langs, scores = [], [np.zeros(0)]
    for _, texts in _parts(strings(column)):
        found, p = model.predict(texts)
        langs += found
        scores.append(p)
    return pa.array(langs, pa.string()), pa.array(np.concatenate(scores))


def identified(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The documents, with their own columns, whose language is told with a probability of at least ``least``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predict(shipped.value, batch.column(at))
            keep = (np.array(langs) != UNKNOWN) & (np.array(scores) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
