"""A quality classifier learned from positive and unlabelled text.

Method: small networks over measures and hashed n-grams of the text, whose mean
output counts, minimise the non-negative unbiased risk: with class prior p, p
times the loss of trusted positives as positive, plus the larger of 0 and the
loss of unlabelled text as negative less p times that of positives as negative.
Where that difference turns negative, its gradient is followed upwards instead.
Labels other than 1 are not used at all, neither in the fit nor after it:
unlabelled text is every document that is not held out, whatever is known of it.

The prior is estimated from positives and unlabelled text: among texts above a
score, the share of all unlabelled texts over the share of all positives bounds
it from above, and the bound is read where its error is least (the best bin).
First networks, trained with a prior of a half, give these scores, for every
unlabelled document. Probabilities come from a logistic step on the outputs of
the second networks, of the greatest likelihood given the prior, again from
positives and unlabelled text. Each network learns from all folds of the
documents but one; for the prior and the logistic step a document's output is
that of the network that has not seen its fold.

Weights are fitted on at most about ``LABELLED`` positives and ``UNLABELLED``
unlabelled documents, drawn by a hash of the id; the driver holds their features
and the model. Inputs are bounded as they are, so no statistics are taken of a
sample; the prior's counts are of all unlabelled documents.

Defined cases: a null text is empty, and an empty text gets the score of its
features; repeated labels of a document count as 1 if any is 1; null labels and
ids are not learned from; without positives every score is 0.5; ties cannot
arise, as each text is scored alone; texts are read whole and other columns
ignored; ids are of any type.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text import LOWER, SPACE, Words, buffers, lean, slices, strings, windows

LABELLED, UNLABELLED = 8000, 8000
NETWORKS, HIDDEN, STEPS, BATCH, RATE, DECAY = 4, 24, 500, 512, 0.005, 0.03
THRESHOLD = 0.3
SLICE = 1 << 20
#: Measures, and buckets of hashed words and of hashed byte trigrams.
SHARES, WORD_DIM, CHAR_DIM = 20, 192, 192
N_MEASURES = SHARES + WORD_DIM + CHAR_DIM
#: Bins that scores are counted in, and outputs at their ends.
BINS, FAR = 2048, 16.0


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = [
    _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"0123456789"), _class(b"#*$%&<>"), _class(b"|"), _class(b"!"),
    _class(b".,;:?"), _class(b"\n"), _class(b"()[]{}\"'`~^_=+/\\@-"), np.arange(256) >= 128, SPACE,
]


def measures(texts: pa.StringArray) -> np.ndarray:
    """(n, N_MEASURES), each between 0 and about 6: roots of shares of character classes (times 3), words and trigrams, and logarithms of lengths."""
    data, at = buffers(texts)
    n = len(texts)
    words = Words(data, at)
    h = words.hashes(lower=True)
    size, count = np.diff(at).astype(float), words.count.astype(float)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) / np.maximum(size, 1)
    shares = [share(c[data]) for c in _CLASSES]
    upper = shares[0] / np.maximum(shares[0] + shares[1], 1e-9)
    length = (words.end - words.start).astype(float)
    per_word = np.maximum(count, 1)
    last = data[words.end - 1] if len(words.end) else data[:0]
    shares += [np.bincount(words.doc, _CLASSES[3][last] | _CLASSES[5][last], minlength=n) / per_word, np.bincount(words.doc, length == 1, minlength=n) / per_word, upper]
    tri, doc, _ = windows(words, h, 3)
    shares += [_distinct(words.doc, h, n) / per_word, _distinct(doc, tri, n) / np.maximum(np.bincount(doc, minlength=n), 1)]
    longest = np.zeros(n)
    np.maximum.at(longest, words.doc, length)
    logs = [size, count, np.bincount(words.doc, length, minlength=n) / per_word, longest]
    out = np.empty((n, N_MEASURES), np.float32)
    out[:, :SHARES] = 3 * np.stack([*map(np.sqrt, shares), *[np.log1p(x) / 10 for x in logs]], axis=1)
    cells = words.doc * WORD_DIM + (h >> np.uint64(33)).astype(np.int64) % WORD_DIM
    out[:, SHARES : SHARES + WORD_DIM] = np.sqrt(np.bincount(cells, minlength=n * WORD_DIM).reshape(n, WORD_DIM) / per_word[:, None])
    low = LOWER[data].astype(np.uint32)
    gram = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)) if len(low) > 2 else low[:0]
    gram ^= gram >> np.uint32(15)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.maximum(np.diff(at), 0))
    inside = owner[: len(gram)] == owner[2 : 2 + len(gram)]
    cells = (owner[: len(gram)] * CHAR_DIM + (gram * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64) % CHAR_DIM)[inside]
    out[:, SHARES + WORD_DIM :] = np.sqrt(np.bincount(cells, minlength=n * CHAR_DIM).reshape(n, CHAR_DIM) / np.maximum(size - 2, 1)[:, None])
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    prior: float | None
    networks: list | None = None
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.mean([output(w, x) for w in self.networks], axis=0)

    def unseen(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Each row's output of the network that does not learn from its fold."""
        return np.stack([output(w, x) for w in self.networks])[fold, np.arange(len(x))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.networks is None:
            return np.full(len(x), 0.5)
        return _sigmoid(self.slope * self.raw(x).astype(float) + self.shift)


def output(w: list, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]


def risk(w: list, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk under the sigmoid loss, and the gradients to descend by: those of the risk, or upwards of its second part where that is negative."""
    zp, zu = output(w, positive), output(w, unlabelled)
    sp, su = _sigmoid(zp), _sigmoid(zu)  # the loss as negative; as positive it is one less that
    slack = su.mean() - prior * sp.mean()
    up, uu = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)

    def backward(x: np.ndarray, gradient: np.ndarray) -> list[np.ndarray]:
        hidden = np.tanh(x @ w[0] + w[1])
        back = gradient[:, None] * w[2] * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ gradient, gradient.sum()]

    first, second = (-2 * prior * up, uu) if slack >= 0 else (prior * up, -uu)
    return prior * (1 - sp).mean() + max(0.0, slack), [a + b for a, b in zip(backward(positive, first), backward(unlabelled, second), strict=True)]


def _network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng([23, seed])
    d = positive.shape[1]
    w = [rng.normal(0, 0.3, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    w = [p.astype(np.float32) for p in w]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, STEPS + 1):
        _, grads = risk(w, positive[rng.integers(0, len(positive), BATCH)], unlabelled[rng.integers(0, len(unlabelled), BATCH)], prior)
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = (w[k] * (1 - rate * DECAY * (w[k].ndim > 0)) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def binned(z: np.ndarray) -> np.ndarray:
    """Counts of outputs by bin."""
    place = np.clip((z + FAR) / (2 * FAR) * BINS, 0, BINS - 1).astype(np.int64)
    return np.bincount(place, minlength=BINS)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from binned outputs of positives and of unlabelled texts."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = positive[::-1].cumsum()[::-1] / n_p, unlabelled[::-1].cumsum()[::-1] / n_u
    error = np.sqrt(np.log(40) / (2 * n_p)) + np.sqrt(np.log(40) / (2 * n_u))
    held = above_p > 0
    at = np.argmin((above_u[held] + 1.01 * error) / above_p[held])
    return float(np.clip(above_u[held][at] / above_p[held][at], 0.01, 0.99))


def _shuffled_folds(positive: np.ndarray) -> np.ndarray:
    fold = np.zeros(len(positive), np.int64)
    for which in (positive, ~positive):
        rows = np.random.default_rng(29).permutation(np.flatnonzero(which))
        fold[rows] = np.arange(len(rows)) % NETWORKS
    return fold


def _learned(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, fold: np.ndarray, prior: float) -> Model:
    """A network for each fold, which does not see it; of all rows where no other has any."""
    networks = []
    for k in range(NETWORKS):
        parts = [x[rows & (fold != k)] if (rows & (fold != k)).any() else x[rows] for rows in (positive, unlabelled)]
        networks.append(_network(*parts, prior, k))
    return Model(prior, networks)


def train(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, prior: float | None = None, counted=None, fold: np.ndarray | None = None) -> Model:
    """``positive`` marks trusted rows of ``x``; rows marked ``negative`` are left out, all others are unlabelled.

    ``fold`` deals rows to networks. ``counted`` gives a model's binned outputs over all unlabelled
    texts, each by the network of its fold; without it those of ``x`` are counted.
    """
    if not positive.any():
        return Model(None)
    x = np.asarray(x, np.float32)
    unlabelled = ~positive & ~negative
    if not unlabelled.any():
        unlabelled = ~negative
    fold = _shuffled_folds(positive) if fold is None else fold
    if prior is None:
        first = _learned(x, positive, unlabelled, fold, 0.5)
        z = first.unseen(x, fold)
        prior = best_bin(binned(z[positive]), counted(first) if counted else binned(z[unlabelled]))
    model = _learned(x, positive, unlabelled, fold, prior)
    z = model.unseen(x, fold).astype(float)
    model.slope, model.shift = logistic(z[positive], z[unlabelled], prior)
    return model


def logistic(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic step from outputs of positives and of unlabelled texts.

    With p(z) the probability sought, positives are p(z) / prior times as dense
    at z as unlabelled texts. That makes the chance that a text of both samples
    is one of the positives a function of slope and shift, whose likelihood is
    raised by Fisher scoring, under a ridge that fades with the number of texts.
    """
    mean, scale = zu.mean(), zu.std() + 1e-9
    z = (np.concatenate([zp, zu]) - mean) / scale
    trusted = np.arange(len(z)) < len(zp)
    odds = len(zp) / (prior * len(zu))
    theta, ridge = np.array([1.0, np.log(prior / (1 - prior))]), 0.3
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(500):
        p = _sigmoid(design @ theta)
        chance = odds * p / (1 + odds * p)
        g = design.T @ ((trusted - chance) * (1 - p)) - ridge * theta
        info = (design * (chance * (1 - chance) * (1 - p) ** 2)[:, None]).T @ design + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(info, g), -0.5, 0.5)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(theta[0]), 1e-3) / scale
    return slope, float(theta[1]) - slope * mean


def _remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id, 5) == 0, F.lit(False))


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = strings(column)
    for lo, hi in slices(texts, SLICE):
        for at in range(lo, hi, 1024):
            n = min(1024, hi - at)
            yield at, n, measures(texts.slice(at, n))


def _sampled(docs: DataFrame) -> pa.Table:
    """``y``, ``fold`` and the inputs ``x`` of each document."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, x in _parts(batch.column(2)):
                rows = pa.ListArray.from_arrays((np.arange(n + 1) * N_MEASURES).astype(np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in batch.columns[:2]], rows], names=["y", "fold", "x"])

    return docs.select("y", "fold", "text").mapInArrow(run, "y int, fold int, x array<float>").toArrow()


def _counted(docs: DataFrame, model: Model) -> np.ndarray:
    """Binned outputs of all documents, by the network of their fold; a task gives one row for each bin that it met."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, np.int64)
        for batch in batches:
            folds = np.array(batch.column(0))
            for lo, n, x in _parts(batch.column(1)):
                seen += binned(shipped.value.unseen(x, folds[lo : lo + n]))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in docs.select("fold", "text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r["bin"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from (doc_id, text) and (doc_id, label), of the documents that are not held out."""
    trusted = labels.where((F.col(label) == 1) & (_remainder(F.col("doc_id"), 5) != 0)).select("doc_id").distinct()
    n_positive = trusted.count()
    if not n_positive:
        return Model(None)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20))
    # at most LABELLED ids, of a fixed size each: a bounded side
    drawn = trusted.where(place < min(1.0, LABELLED / n_positive) * (1 << 20)).limit(LABELLED + LABELLED // 4)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(NETWORKS)).cast("int")  # a document that is drawn twice is in one
    open_docs = docs.where(_remainder(F.col("doc_id"), 5) != 0).select("doc_id", fold.alias("fold"), "text")
    part = min(1.0, UNLABELLED / max(0.8 * docs.count(), 1))
    sample = open_docs.join(F.broadcast(drawn), "doc_id").select(F.lit(1).alias("y"), "fold", "text").unionByName(open_docs.where(place < part * (1 << 20)).select(F.lit(0).alias("y"), "fold", "text"))
    found = _sampled(sample)
    if not found.num_rows:
        return Model(None)
    y, folds = np.array(found["y"]), np.array(found["fold"])
    x = np.array(found["x"].combine_chunks().flatten()).reshape(-1, N_MEASURES)
    order = np.lexsort((*x[:, SHARES - 1 :: -1].T, folds, y))  # the same order at every run
    return train(x[order], y[order] == 1, np.zeros(len(y), bool), counted=lambda first: _counted(open_docs, first), fold=folds[order])


def scored(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` of each document with ``score`` and ``predicted``."""
    spec = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, x in _parts(batch.column(batch.num_columns - 1)):
                s = shipped.value.scores(x)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in batch.columns[:-1]], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*keys, "score", "predicted"])

    return docs.select(*keys, "text").mapInArrow(run, f"{spec}, score double, predicted int")
