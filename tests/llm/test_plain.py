"""Learned operators and parsers against plain versions."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, words
from tests.oracle import SF, compare
from tidelog.llm import groups, html, langid, mixing, neardup_vectors, ngramjoin, packing, quality, queries, rules
from tidelog.llm.text import strings

MASK = (1 << 64) - 1


def plain_grams(text):
    """Counts of an n-gram's bucket, from the sequence of words with one space around each."""
    letters = [c if langid._letters()[ord(c)] else " " for c in text.lower()]
    line = " " + "".join(w + " " for w in "".join(letters).split(" ") if w)
    out = Counter()
    for n in range(1, langid.LONGEST + 1):
        for i in range(len(line) - n + 1):
            if n == 1 and line[i] == " ":
                continue
            h = n * 0x9E3779B9
            for c in line[i : i + n]:
                h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
            out[(h >> 40) % langid.BUCKETS] += 1
    return out


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_language_model(texts, langs):
    grams = [plain_grams(t) for t in texts]
    labels = sorted(set(langs))
    df = Counter(b for g in grams for b in g)
    idf = lambda b: math.log((1 + len(texts)) / (1 + df[b])) + 1

    def vector(g):
        x = {b: (1 + math.log(c)) * idf(b) for b, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    rows = [(labels.index(lang), g) for lang, g in zip(langs, grams, strict=True) if g]
    rows.sort(key=lambda r: (len(r[1]), sum(r[1]), sum(r[1].values()), r[0]))
    order = np.random.default_rng(17).permutation(len(rows)).tolist()
    spare = order[::6]
    taught = [i for k, i in enumerate(order) if k % 6]
    z, n = defaultdict(lambda: [0.0] * len(labels)), defaultdict(lambda: [0.0] * len(labels))

    def weight(b, c):
        if abs(z[b][c]) <= langid.L1:
            return 0.0
        return -math.copysign(abs(z[b][c]) - langid.L1, z[b][c]) / ((langid.BETA + math.sqrt(n[b][c])) / langid.ALPHA + langid.L2)

    def logits(x):
        return [sum(v * weight(b, c) for b, v in x.items()) + weight("bias", c) for c in range(len(labels))]

    for _ in range(langid.EPOCHS):
        for i in taught:
            y, g = rows[i]
            x = vector(g)
            p = softmax(logits(x))
            w = {b: [weight(b, c) for c in range(len(labels))] for b in (*x, "bias")}
            for b, v in (*x.items(), ("bias", 1.0)):
                for c in range(len(labels)):
                    slope = v * (p[c] - (c == y))
                    z[b][c] += slope - (math.sqrt(n[b][c] + slope * slope) - math.sqrt(n[b][c])) / langid.ALPHA * w[b][c]
                    n[b][c] += slope * slope
    held = [(rows[i][0], logits(vector(rows[i][1]))) for i in spare]

    def loss(t):
        total = 0.0
        for y, s in held:
            p = softmax([v / t for v in s])
            target = [1 + (len(held) if c == y else 0) for c in range(len(labels))]
            total -= sum(q / sum(target) * math.log(max(v, 1e-12)) for q, v in zip(target, p, strict=True))
        return total

    temperature = min(np.geomspace(0.02, 20, 121).tolist(), key=loss) if held else 1.0

    def predict(text):
        g = plain_grams(text)
        if not any(langid._letters()[ord(c)] for c in text):
            return "und", 0.0
        s = logits({b: (1 + math.log(c)) * idf(b) for b, c in g.items()} and vector(g))
        p = softmax([v / temperature for v in s])
        return labels[p.index(max(p))], max(p)

    return predict, temperature


def test_language_model_against_plain(spark):
    loaded = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(160).collect()]
    rows = [(i, (t or "")[: 40 + 3 * (i % 50)], lang) for i, t, lang in loaded] + [(100_001, "", "en"), (100_002, "12 34", "de"), (100_003, "no lang", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    open_rows = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    predict, temperature = plain_language_model(*zip(*open_rows, strict=True))
    assert model.temperature == pytest.approx(temperature)
    for r in langid.predicted(df, model, ["doc_id"]).join(df, "doc_id").collect():
        lang, score = predict(r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9), r


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(langid, "SAMPLE", 60)
    df = spark.range(900).selectExpr("id as doc_id", "concat('text ', id, ' is here') as text", "case when id % 10 = 0 then 'c' when id % 2 = 0 then 'a' else 'b' end as lang")
    taught, train = [], langid._train
    monkeypatch.setattr(langid, "_train", lambda labels, idf, sample: taught.append(sample.num_rows) or train(labels, idf, sample))
    assert langid.fit(df).labels == ["a", "b"] and 20 < taught[0] < 110


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def plain_output(w, x):
    hidden = [math.tanh(sum(x[i] * w[0][i][j] for i in range(len(x))) + w[1][j]) for j in range(len(w[1]))]
    return sum(h * c for h, c in zip(hidden, w[2], strict=True)) + w[3]


@pytest.mark.parametrize(("prior", "shift"), [(0.6, 0.0), (0.9, 4.0)])
def test_nonnegative_risk_and_gradients(prior, shift):
    rng = np.random.default_rng(1)
    w = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.1)]
    positive, unlabelled = rng.normal(size=(7, 5)), rng.normal(size=(11, 5))
    w[3] = np.array(float(w[3]))
    if shift:  # outputs of positives high, of unlabelled low: the second part is negative
        positive, unlabelled = np.repeat(positive[:1], 7, 0), np.repeat(positive[:1] * -1, 11, 0)
        w = [*w[:2], np.sign(np.tanh(positive[0] @ w[0] + w[1])) * shift, np.array(0.0)]

    def parts(w):
        sp = [sigmoid(plain_output(w, x)) for x in positive]
        su = [sigmoid(plain_output(w, x)) for x in unlabelled]
        return prior * sum(1 - s for s in sp) / len(sp), sum(su) / len(su) - prior * sum(sp) / len(sp)

    first, second = parts(w)
    assert (second < 0) == bool(shift)
    value, grads = quality.risk(w, positive, unlabelled, prior)
    assert value == pytest.approx(first + max(second, 0))
    followed = lambda w: sum(parts(w)) if second >= 0 else -parts(w)[1]
    for k in range(4):
        for at in ([()] if w[k].ndim == 0 else list(np.ndindex(*w[k].shape))):
            moved = []
            for d in (1e-5, -1e-5):
                near = [x.copy() for x in w]
                near[k][at] += d
                moved.append(followed(near))
            assert grads[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_measures_against_plain():
    texts = ["", "a", "Ab ab  !!x| 1\n", "é ü ÉÉ", "the cat the cat the cat sat", "x" * 300, "# # $ $%", "\t\n ", "ab ab　cd"]
    got = quality.measures(strings(pa.array(texts)))
    assert got.shape == (len(texts), quality.N_MEASURES) and np.isfinite(got).all()
    for text, row in zip(texts, got, strict=True):
        raw, w = text.encode(), words(text)
        low = [x if not 65 <= x <= 90 else x + 32 for x in raw]
        cells = Counter()
        for i in range(len(low) - 2):
            h = (low[i] * 0x9E3779B1 + low[i + 1] * 0x85EBCA6B + low[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
            h ^= h >> 15
            cells[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 16] += 1
        folded = Counter()
        for h, n in cells.items():
            folded[h % quality.CHAR_DIM] += n
        want = [math.sqrt(folded[k] / max(len(raw) - 2, 1)) for k in range(quality.CHAR_DIM)]
        assert np.allclose(row[quality.SHARES + quality.WORD_DIM :], want, atol=1e-6)
        assert (row[quality.SHARES : quality.SHARES + quality.WORD_DIM] ** 2).sum() == pytest.approx(1 if w else 0, abs=1e-5)
        lower = [x.lower() if x.isascii() else x for x in w]
        assert row[0] == pytest.approx(3 * math.sqrt(sum(65 <= x <= 90 for x in raw) / max(len(raw), 1)), abs=1e-5)
        assert row[14] == pytest.approx(3 * math.sqrt(len(set(lower)) / max(len(w), 1)), abs=1e-5)
        assert row[16] == pytest.approx(0.3 * math.log1p(len(raw)), abs=1e-5)


def test_scores_are_the_networks(spark):
    """The whole path from rows to scores, against the model applied text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0.7 < model.prior < 0.97 and len(model.networks) == quality.NETWORKS
    rows = quality.scored(docs, model, ["doc_id"]).collect()
    for r in rows[::97]:
        x = quality.measures(strings(pa.array([texts[r.doc_id]])))[0].tolist()
        z = sum(plain_output(w, x) for w in model.networks) / len(model.networks)
        assert r.score == pytest.approx(sigmoid(model.slope * z + model.shift), abs=1e-4)


def test_labels_other_than_one_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.fit(docs, labels)
    b = quality.fit(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")))  # ids of another type
    assert a.prior is not None and b.prior is not None
    assert quality.fit(docs, labels.where("quality = 0")).networks is None


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.85):
        positive = rng.normal(2, 1, 20_000)
        mixed = np.where(rng.random(40_000) < share, rng.normal(2, 1, 40_000), rng.normal(-2, 1, 40_000))
        assert quality.best_bin(quality.binned(positive), quality.binned(mixed)) == pytest.approx(share, abs=0.06)
        slope, shift = quality.logistic(positive, mixed, share)
        z = np.linspace(-1.5, 1.5, 7)
        true = share * np.exp(-((z - 2) ** 2) / 2) / (share * np.exp(-((z - 2) ** 2) / 2) + (1 - share) * np.exp(-((z + 2) ** 2) / 2))
        assert np.abs(1 / (1 + np.exp(-(slope * z + shift))) - true).max() < 0.08


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    tiny = [3e-200, 4e-200]
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0]), (5, tiny), (6, [3.0, 4.0]), (7, [-0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup_vectors.linked(df).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_recall_of_links_at_the_threshold(spark):
    """Pairs at cosines from 0.9 to 0.93 only, over many cells."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1200, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.93, (1200, 1))
    pairs = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    whole = pairs @ pairs.T >= 0.9
    n_links = (whole.sum(1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in neardup_vectors.linked(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(n_links))
    assert sum(got.values()) >= 0.97 * sum(n_links) > 0


def test_signs_do_not_depend_on_what_stands_beside():
    v = neardup_vectors.scaled(np.random.default_rng(1).normal(size=(300, 70)))
    v[5:9] *= 1e-3
    whole = neardup_vectors.cell_of(v, 9, 4)
    assert [int(neardup_vectors.cell_of(v[i : i + 1], 9, 4)[0]) for i in range(300)] == whole.tolist()


def test_most_pieces_are_placed_by_the_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs.coalesce(1)).collect()
    assert np.mean([r.moved for r in rows]) < 0.1


def test_hostile_pages_take_linear_time():
    nested = "<div>" * 1_000_000
    pages = {
        '<a "' * 2_500_000: 0, '<a ="' * 1_000_000: 0, nested + "x" + "</div>" * 1_000_000: 1, "<p>" + '"' * 3_000_000: 1, "<" * 3_000_000: 1, "<!--" * 1_000_000: 0, "&#" + "9" * 1_000_000 + ";": 1,
        "<p>&#" + "0" * 1_000_000 + "65;</p>": 1, "</script " * 500_000: 0, "<iframe>" * 500_000: 0, "<ul><li>" * 200_000: 0, "<div " + 'class="x" ' * 500_000 + ">x": 1, "<a " + "=" * 2_000_000 + ">x": 1,
    }
    began = time.perf_counter()
    for page, n in pages.items():
        assert len(html.blocks(page)) == n, page[:20]
    assert time.perf_counter() - began < 60


def test_parts_of_pages():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<p>a <svg><text>b</text></svg> c<math><mi>x</mi></math><object>d</object><canvas>e</canvas>") == ["a b cxde"]
    assert texts("<p>a<script>if (1 < 2) '<p>'</script >b<style>x{}</STYLE\n>c<!-- <p>no --><![x]>d") == ["abcd"]
    assert texts('<p title="a > b" id=x>c</p><p class=\'y\'>d<') == ["c", "d<"]
    assert texts("<p>a<a href='x") == ["a"] and texts("<p>a<template>b") == ["ab"] and texts("a</ >b</>c<?x?>d<1>") == ["abcd<1>"]
    assert texts('<p class="x>a</p><p>b') == ["a", "b"]


def test_a_page_of_many_blocks_is_read_in_chunks(monkeypatch):
    model = html.trained()
    page = "<nav><a>m</a></nav><article>" + "".join(f"<p>Words of paragraph {i} that go on for a while, as text does.</p>" for i in range(300)) + "</article><footer>&copy; x</footer>"
    whole = html.extract([page], model)[0]
    found = html.blocks(page)
    x, length = html._padded([html.vectors(found)])
    logits = model.forward(x, length)[:, 0]
    monkeypatch.setattr(html, "CHUNK", 37)
    assert np.allclose(model.long_logits(found), logits, atol=1e-4)
    monkeypatch.setattr(html, "CELLS", 100)
    assert html.extract([page, "", page], model) == [whole, "", whole]


@pytest.mark.parametrize("name", ["op2_mixing", "op10_url_filters"])
def test_native_operators_run_no_python(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("Python on the main path")

    for method in ("mapInArrow", "mapInPandas", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, method, refuse)
    monkeypatch.setattr(DataFrame, "rdd", property(refuse))
    for method in ("udf", "pandas_udf"):
        monkeypatch.setattr(F, method, refuse)
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sizes_in_sql_and_in_dataframes(spark, tmp_path):
    texts = ["a\x0bb", "a\x0cb c", "a\rb", "a-b", "", None, "  x y", "a\tb\nc", "\x1c \x1f"]
    rows = [(i, t, "en", s, 0) for s in ("a", "b", None) for i, t in enumerate(texts, {"a": 0, "b": 20, None: 40}[s])]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/d")
    part = next((tmp_path / "d").glob("part-*.parquet"))
    part.rename(tmp_path / "documents.parquet")
    df = queries.op2_mixing(spark, str(tmp_path))
    assert {r.doc_id: r["size"] for r in df.collect()} == {i: len(words(t)) for i, t, *_ in rows}
    assert compare(df, mixing.ORACLE, str(tmp_path)) == len(rows)


def test_targets_of_many_sources(spark):
    sizes = spark.range(3000).selectExpr("concat('s', lpad(id, 5, '0')) as source", "id * id % 977 as source_size")
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    whole = sum(r.source_size for r in got.values())
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * whole)
    level = max(r.target / mixing.WEIGHTS[int(s[1:]) % 3] for s, r in got.items())
    for s, r in got.items():
        assert r.target == pytest.approx(min(2.0 * r.source_size, level * mixing.WEIGHTS[int(s[1:]) % 3]))


def test_one_row_of_each_group_stays(spark):
    a = " ".join(f"uno{i} dos{i * 7}" for i in range(60))
    b = " ".join(f"tres{i} cuatro{i * 5}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "y"), (2, a + " fin", "z"), (None, a, "w"), (None, a, "v"), (5, b, "u"), (1, b + " otra", "t"), (None, "solo uno", "s"), (None, "solo dos", "r"), (7, "", "q"), (7, "", "p"), (8, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tidelog string").withColumn("_kept", F.lit(1)).withColumn("class", F.lit("c"))
    out = ngramjoin.deduplicated(df)
    assert out.columns == df.columns
    kept = sorted(r._tidelog for r in out.collect())
    assert len(kept) == len(set(kept))
    assert [k for k in kept if k in "xy"] in (["x"], ["y"]) and not set(kept) & set("zwv")
    # of the pair that shares only a part of its ids, the smaller id stays
    assert "t" in kept and "u" not in kept
    assert set("srqpo") <= set(kept)
    assert ngramjoin.deduplicated(df.where("1 = 0")).count() == 0


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """Where the rows that go are too many to broadcast, the others' texts still stay where they are."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 200))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(20)] + [(7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = ngramjoin.deduplicated(df)
        before = _shuffled(spark)
        assert sorted(map(tuple, out.collect())) == sorted(enumerate(texts))
        assert _shuffled(spark) - before < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("bits", [1 << 12, 1 << 27])
def test_screened_loses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(groups, "FILTER_BITS", bits)
    rows = spark.range(-5000, 5000).select("id", F.xxhash64("id").alias("_at"), F.lit(1).alias("word"))
    keys = rows.where("id % 7 = 0").select(F.col("_at").alias("k"))
    near, clear = groups.screened(rows, F.col("_at"), keys)
    assert near.columns == clear.columns == rows.columns
    near, clear = ({r.id for r in x.collect()} for x in (near, clear))
    assert near | clear == set(range(-5000, 5000)) and not near & clear
    assert not [i for i in clear if i % 7 == 0]
    assert bits < 1 << 27 or sum(i % 7 > 0 for i in near) < 10_000 / 12
    none, rest = groups.screened(rows, F.col("_at"), keys.where("1 = 0"))
    assert none.count() == 0 and rest.count() == 10_000
    unknown, nothing = groups.screened(rows.where("id = 0"), F.lit(None).cast("long"), keys)
    assert unknown.count() == 0 and nothing.count() == 1


def test_shingles_are_counted_on_whole_hashes(monkeypatch):
    """Two shingles that agree in the 48 bits that the join compares are still two."""
    texts = pa.array([" ".join(f"w{i}" for i in range(30))])
    true = ngramjoin.shingles

    def clashing(*args):
        h, doc = true(*args)
        h = h.copy()
        h[1] = h[0] ^ np.uint64(1)
        return h, doc

    monkeypatch.setattr(ngramjoin, "shingles", clashing)
    block = ngramjoin._Block(0, 1)
    block.add([pa.array([1]), pa.array([1])], texts)
    assert block.sizes[0].tolist() == [26] and len(block.keys[0]) == 25


def test_longest_repeat_has_a_limit_of_its_own():
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in rng.permutation(6000)]
    passage = plain[:rules.LONGEST_CEILING + 1]
    once, twice = " ".join(plain), " ".join(plain + passage)
    a, b = rules.measure(pa.array([once, twice])).to_pylist()
    assert a["kept"] and not b["kept"] and b["covered_words"] <= rules.MAX_COVERED * b["n_words"] and b["longest_repeat"] == len(passage)
