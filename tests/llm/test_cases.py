"""Nulls, empty and long texts, repeats, empty tables and clashing columns."""

import random
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, components, shingle_set
from tidelog.llm import chat, groups, html, langid, mixing, neardup_vectors, ngramjoin, packing, quality, rules, urlfilter
from tidelog.sources.shared import SharedTables

LONG = " ".join(f"word{i}" for i in range(60_000))
SAMPLE = " ".join("the quick brown fox jumps over a lazy dog while many other animals look on from afar and say nothing at all".split() * 1) + " "


def odd_docs(spark):
    unique = " ".join(f"uno{i} dos{i * 7}" for i in range(60))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (6, "ONE", None, "b", 3),
        (None, unique, "en", "a", 1), (7, unique, "en", "b", 1), (7, unique, "en", "b", 1), (8, unique + " und mehr", "de", None, 1), (9, LONG, "de", "c", 1), (10, "12 34 !!", "de", "c", 1),
        (11, "é" * 70_000, "fr", "c", 1), (12, "a b c d", "fr", "c", 1), (13, "A B c d", "fr", "c", 1), (14, "x\x00y \ud7ff z", "fr", "", 1),
    ]
    return spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("size"), F.lit("q").alias("kind"), F.lit(0).alias("_source"), F.lit(0).alias("cid"))


def none_of(df):
    return df.where("1 = 0")


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    docs = odd_docs(spark)
    for df in (docs, none_of(docs)):
        out = f(spark, df, "")
        if name != "pack":
            assert out.columns == docs.columns
        n = out.count()
        assert n == 0 if df is not docs else n >= 0


def test_mix_of_odd_documents(spark):
    rows = mixing.mixed_counts(odd_docs(spark)).collect()
    assert len(rows) == 16 and all(r.n_copies == 0 for r in rows if r.size == 0)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert none_of(mixing.mixed_counts(none_of(odd_docs(spark)))).count() == 0


def test_targets_by_repeated_resharing(spark):
    rng = random.Random(5)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 5, 40, 300, 10_000]) for _ in range(rng.randrange(1, 12))]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")).collect()}
        weight = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        target, capped = [0.0] * len(sizes), set()
        while True:
            left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
            free = [i for i in range(len(sizes)) if i not in capped]
            target = [2.0 * sizes[i] if i in capped else left * weight[i] / sum(weight[j] for j in free) for i in range(len(sizes))]
            over = {i for i in free if target[i] > 2 * sizes[i]}
            if not over:
                break
            capped |= over
        assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(target)


def test_language_sample_is_of_1500(spark, monkeypatch):
    docs = spark.range(1900).selectExpr("id as doc_id", "concat('word ', id) as text", "'en' as lang")
    usable = docs.count() - docs.where(langid.held_out(F.col("doc_id"))).count()
    taught, train = [], langid._train
    monkeypatch.setattr(langid, "_train", lambda labels, idf, sample: taught.append(sample.num_rows) or train(labels, idf, sample))
    langid.fit(docs)
    assert 1200 < usable < 1500 and taught == [usable]


def test_language_sample_is_in_few_files(spark, monkeypatch):
    docs = spark.range(0, 600, 1, 40).selectExpr("id as doc_id", "concat('word ', id, ' here') as text", "if(id % 3 = 0, 'en', 'de') as lang")
    files, drop = [], SharedTables.drop
    monkeypatch.setattr(SharedTables, "drop", lambda self: files.extend(f for p in self.paths for f in Path(p.removeprefix("file:")).glob("part-*")) or drop(self))
    many = langid.fit(docs)
    assert len(files) == 1
    one = langid.fit(docs.coalesce(1))
    assert np.array_equal(many.idf, one.idf) and np.array_equal(many.weights, one.weights) and many.temperature == one.temperature


def test_language_sample_is_learned_in_one_order():
    pairs = [(i, 200 - i) for i in range(1, 60)]  # of equal sums
    rows = {"lang": ["a", "b"] * 29 + ["a"], "buckets": pairs, "counts": [(1, 2)] * len(pairs)}
    sample = pa.table(rows, pa.schema([("lang", pa.string()), ("buckets", pa.list_(pa.int16())), ("counts", pa.list_(pa.int32()))]))
    there, back = (langid._train(["a", "b"], np.ones(langid.BUCKETS), s) for s in (sample, sample.take(list(range(len(pairs)))[::-1])))
    assert there.weights.any() and np.array_equal(there.weights, back.weights) and there.temperature == back.temperature


def test_language_cases(spark):
    docs = odd_docs(spark)
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.predicted(docs, model, ["doc_id"]).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 10))
    assert rows[9].lang_pred in model.labels
    nothing = langid.fit(none_of(docs))
    assert nothing.labels == [] and {r.lang_pred for r in langid.predicted(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predicted(none_of(docs), model, ["doc_id"]).count() == 0


def test_ngram_counts():
    from collections import Counter

    texts = ["Ab b", "", "é-ÉX", "ab b"]
    doc, bucket, count, known = langid.counts(texts)
    assert known.tolist() == [True, False, True, True]
    per = [Counter({b: c for d, b, c in zip(doc, bucket, count, strict=True) if d == i}) for i in range(4)]
    assert per[0] == per[3] and sum(per[0].values()) == 3 + 5 + 4 and not sum(per[1].values()) > 3


def test_quality_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model, ["doc_id"]).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    bare = quality.fit(docs, none_of(labels))
    assert {r.score for r in quality.scored(docs, bare, ["doc_id"]).collect()} == {0.5}
    assert quality.scored(none_of(docs), model, ["doc_id"]).count() == 0


def test_nonnegative_risk_learns_from_positives_only():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (3000, quality.N_MEASURES)), rng.normal(-1.5, 1, (1000, quality.N_MEASURES))
    x = np.concatenate([good, bad])
    positive = np.zeros(4000, bool)
    positive[:800] = True
    model = quality.train(x, positive, np.zeros(4000, bool), 0.7)
    assert (model.raw(good[800:]) > 0).mean() > 0.97 and (model.raw(bad) < 0).mean() > 0.97


def test_rules_cases(spark):
    docs = odd_docs(spark)
    rows = rules.judged(docs, ["doc_id"]).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 16 and by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[9].kept and by[9].n_words == 60_000 and by[11].word_chars == 70_000
    assert rules.clean(docs).columns == docs.columns and rules.judged(none_of(docs), ["doc_id"]).count() == 0


def test_repeats_against_plain():
    rng = random.Random(1)
    for trial in range(30):
        texts = ["".join(rng.choice(["a", "b", "é", "cc", "#"]) + rng.choice([" ", "\n", " \t"]) for _ in range(rng.choice([0, 1, 2, 5, 20, 70]))) for _ in range(4)]
        texts.append("x y z w " * rng.randrange(1, 20))
        for text, row in zip(texts, rules.measure(pa.array(texts)).to_pylist(), strict=True):
            w = text.split()
            n = len(w)
            runs = [0] * n
            for i in range(n):
                for j in range(n):
                    k = 0
                    while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                        k += 1
                    runs[i] = max(runs[i], k)
            covered = {p for i in range(n) if runs[i] >= rules.MIN_REPEAT for p in range(i, i + runs[i])}
            assert (row["longest_repeat"], row["covered_words"]) == (max(runs, default=0), len(covered)), (trial, text)


def test_shingle_join_cases(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, ngramjoin.grouped(docs).collect()), key=str)
    by = {}
    for i, n, c in got:
        by.setdefault(i, (n, c))
    assert len(got) == 16 and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[4] == (1, 4) and by[5] == (1, 4) and by[6] == (1, 4)
    assert by[None][1] == 7 and by[7][1] == 7 and by[8][1] == 7 and by[13] == (1, 12) and by[9] == (59_996, 9)
    assert ngramjoin.grouped(none_of(docs)).count() == 0


def test_families_of_near_copies(spark):
    """Chains, families over the common-shingle mark, and groups split into blocks."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(90):
            base = list(base) if rng.random() < 0.5 else base
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 30]))) for _ in range(200)] + texts[:20]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    old = ngramjoin.GROUP, ngramjoin.PIVOTS, ngramjoin.GROUP_GRAMS
    try:
        for sizes in (old, (16, *old[1:]), (16, 2, old[2]), (10, 0, old[2]), (old[0], 1, 2000)):
            ngramjoin.GROUP, ngramjoin.PIVOTS, ngramjoin.GROUP_GRAMS = sizes
            got = {r.doc_id: r.component_id for r in ngramjoin.grouped(df, block_bytes=20_000, bucket_bytes=10_000).collect()}
            assert [got[i] for i in range(len(texts))] == want
    finally:
        ngramjoin.GROUP, ngramjoin.PIVOTS, ngramjoin.GROUP_GRAMS = old


def test_trie_finds_every_component():
    rng = random.Random(2)
    for _ in range(40):
        base = sorted(rng.sample(range(200), 40))
        family = [sorted({*rng.sample(base, rng.randrange(33, 41)), *rng.sample(range(200), rng.randrange(0, 5))}) for _ in range(30)]
        order = sorted(range(30), key=lambda i: len(family[i]))
        trie = ngramjoin.Trie(30)
        for i in order:
            trie.search(i, family[i], len(family[i]))
            trie.insert(i, family[i], len(family[i]))
        links = [(i, j) for i in range(30) for j in range(i) if 100 * len({*family[i]} & {*family[j]}) >= 80 * len({*family[i]} | {*family[j]})]
        assert [trie.sets.find(i) for i in range(30)] == components(30, links)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((60, 50), (60, 20), (30, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(20)] if m else [])
        got = {r.node: r.root for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert [got.get(i, i) for i in range(n)] == components(n, links)


def test_packing_cases(spark):
    docs = odd_docs(spark)
    rows = packing.packed(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].doc_tokens == 1 and by[1].length == 1 and by[2].doc_tokens == 1
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * by[7].doc_tokens
    assert packing.packed(none_of(docs)).count() == 0


def test_tokens_equal_the_tokenizers():
    rng = random.Random(4)
    tokens = packing.WordTokens(packing.default_tokenizer())
    alphabet = list("abZ'stredmvl 1239 .,!?<|>\n\t\x0b\x1c\x85\xa0éÉÀß×÷ÿŸİΣςʼn²ªºµ中👍\u0301\u200d\u2028\u3000\x00\x7f")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["<|endoftext|> a<|startoftext|>b", "it's don't WE'RE !'s", "", "  "]
    whole = [[*e.ids, 1] for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encode(texts)] == whole


def test_sum_of_squares_places():
    packer = packing.Packer(0, 10)
    packer.put(0, 6, 0)
    packer.put(1, 7, 0)
    packer.put(2, 3, 0)  # closes the window at 7: one level fewer beats any other place
    assert {(p[0], p[4]) for p in packer.done} == {(1, 0), (2, 7)}
    packer.put(3, 25, 0)
    packer.end()
    lengths = {}
    for p in packer.done:
        lengths[p[3]] = lengths.get(p[3], 0) + p[2]
    assert sum(lengths.values()) == 41 and all(n == 10 or n & (n - 1) == 0 for n in lengths.values())


def test_chat_cases(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "\\<s>[INST]\\\\ <</s>"), (None, 0, "assistant", "\\<s>[INST]\\\\ <</s>"),
        (2, 0, "[/INST]</s>", "[" * 9 + "INST]"), (2, 1, "assistant", LONG), (3, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("n_turns", F.lit("n"))
    pieces = chat.formatted(df).orderBy("conv_id", "piece").collect()
    back = {}
    for p in pieces:
        back.setdefault(p.conv_id, []).extend(chat.read_back(p.formatted))
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert back == want
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[2].loss_chars == len(LONG) and got[3].loss_chars == 0 and got[1].n_turns == 3
    assert chat.digests(chat.formatted(none_of(df))).count() == 0


def test_one_long_conversation_in_pieces(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} </s> " * (i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.formatted(df.repartition(7)).orderBy("piece").collect()
    assert len(pieces) > 1
    assert [t for p in pieces for t in chat.read_back(p.formatted)] == [(r, x) for _, _, r, x in rows]


def test_url_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "http://COM", "https://a.b.com/x?y://z", "http://net/es/", "http://x.NET/es", "http://net.org/es/", "http://www.example.com/en/?q", "ftp://blog.example.com/en/a#b",
        "http://notexample.com/en/", "http://example.com:80/en/", "x://.example.com/en/", "http://example.com./en/", "a://b://c.com/", "http://www.example.com/en", "http://a.www.example.com/en/1/2", "http://net/fr/x\n://y",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    extra = (*urlfilter.RULES, ("com", "/x/long/path/", "block"), ("com", "/x", "block"), ("com", "/x", "allow"), ("b.com", "/", "allow"))
    for table in (urlfilter.RULES, extra, ()):
        got = {r.page_id: r for r in urlfilter.judge(df, urlfilter.rules_frame(spark, table)).collect()}
        assert len(got) == 2 * len(urls)
        for i, u in enumerate(urls + urls):
            rest = u.split("://", 1)[1] if u and "://" in u else None
            cut = lambda x, stops: x[: min((x.index(c) for c in stops if c in x), default=len(x))]
            host = "" if rest is None else cut(rest, "/?#")
            path = "" if rest is None else cut(rest[len(host) :], "?#")
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            fits = [(len(h + p), len(h), h + p, a) for h, p, a in table if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=None)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2] if best else None, best[3] if best else "allow"), (u, table)
    assert urlfilter.judge(none_of(df), urlfilter.rules_frame(spark)).count() == 0


def test_page_cases(spark):
    body = "".join(f"<p>Paragraph {i} of the article, with some words &amp; more.</p>" for i in range(400))
    rows = [(1, None), (2, ""), (3, "<script>var a = '<p>no</p>'</script>"), (4, f"<nav><a>Home</a></nav><article>{body}</article><footer>&copy; x</footer>"), (5, "<article><p>Open &lt;b&gt; <i>one<p>two &amp;amp; three"), (6, "< p>5 < 6 <!-- x")]
    got = {r.page_id: r for r in html.extracted(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, html string, n_chars int"), ["page_id"]).collect()}
    assert got[1].text == got[2].text == got[3].text == ""
    assert got[4].text.count("\n\n") == 399 and "&amp;" not in got[4].text and got[4].n_chars == len(got[4].text)
    assert got[5].text == unescape("Open &lt;b&gt; one\n\ntwo &amp;amp; three")
    assert html.extracted(none_of(spark.createDataFrame(rows, "page_id long, html string")), ["page_id"]).count() == 0


def test_block_labeller_on_composed_pages():
    rng, model = random.Random(77), html.trained()
    wrong = total = 0
    for _ in range(120):
        found, y = html.labelled(html.sample_page(rng))
        if found:
            x, length = html._padded([html.vectors(found)])
            wrong += int(((model.forward(x, length)[:, 0] > 0) != y).sum())
            total += len(y)
    assert wrong < 0.01 * total


def test_lstm_gradients():
    rng = np.random.default_rng(3)
    model = html.BiLstm(rng)
    model.w = [w.astype(np.float64) for w in model.w]
    length = np.array([4, 2])
    x, y = rng.normal(size=(4, 2, html.DIM)), rng.integers(0, 2, (4, 2)).astype(float)
    x[2:, 1] = 0
    _, grads = model.gradients(x, length, y)
    for k in (0, 1, 2, 3, 4, 6, 7):
        at = tuple(rng.integers(0, s) for s in model.w[k].shape)
        kept = model.w[k][at] if at else model.w[k]
        losses = []
        for d in (1e-3, -1e-3):
            if at:
                model.w[k][at] = kept + d
            else:
                model.w[k] = kept + d
            losses.append(model.gradients(x, length, y)[0])
        if at:
            model.w[k][at] = kept
        else:
            model.w[k] = kept
        assert grads[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neardup_vectors.linked(df).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neardup_vectors.linked(one).collect()) == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True)]
