"""The registered queries over the supplied tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components, shingle_set, words
from tests.oracle import SF, compare
from tidelog.llm import html, langid, packing, queries, quality, rules


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name]) > 0


def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_mix_comes_near_its_targets(spark):
    by = defaultdict(list)
    all_docs = docs(spark)
    rows = queries.op2_mixing(spark, SF).collect()
    assert len(rows) == len(all_docs)
    for r in rows:
        assert r.taken <= 2 * r.size
        by[all_docs[r.doc_id].source].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.06 * rows[0].target
        assert rows[0].target <= 2 * rows[0].source_size + 1e-6
    assert sorted(map(tuple, queries.op2_mixing(spark, SF).collect())) == sorted(map(tuple, [r for rows in by.values() for r in rows]))


def test_languages_of_held_out_documents(spark):
    all_docs = docs(spark)
    rows = queries.op3_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == all_docs[r.doc_id].lang for r in out]) > 0.99
    assert langid.UNKNOWN == "und"


def test_junk_letters_have_no_language(spark):
    loaded = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(loaded)
    rng = np.random.default_rng(5)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(300)]
    assert langid.identified(spark.createDataFrame([(t,) for t in junk], "text string"), model).count() == 0
    assert langid.identified(loaded.where(langid.held_out(F.col("doc_id"))), model).count() == loaded.where(langid.held_out(F.col("doc_id"))).count()


def test_vectors_against_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    base = [(r.vec_id, r.embedding) for r in vectors][:300]
    rng = np.random.default_rng(2)
    near = []
    for k in range(120):  # cosines from 0.8 to 1 with a stored vector
        v = np.array(base[k % 40][1], float)
        v /= np.linalg.norm(v)
        w = rng.normal(size=v.size)
        w -= (w @ v) * v
        c = rng.uniform(0.8, 1.0)
        near.append((10_000 + k, (c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).astype(np.float32).tolist()))
    rows = base + near + [(20_000, base[3][1]), (20_001, base[3][1]), (20_002, [0.0] * 64), (20_003, None), (20_004, [float("nan")] * 64), (20_005, [1.0, 2.0]), (20_006, [2.0, 4.0]), (20_007, [None] * 64), (20_008, [])]
    from tidelog.llm import neardup_vectors

    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rep string")
    old = neardup_vectors.CELL
    try:
        for cell in (old, 32):  # one cell, and many tables of small ones
            neardup_vectors.CELL = cell
            got = {r.vec_id: r for r in neardup_vectors.linked(df).collect()}
            ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
            links = []
            for a in ok:
                for b in ok:
                    if a < b and len(rows[a][1]) == len(rows[b][1]):
                        x, y = np.array(np.float32(rows[a][1]), float), np.array(np.float32(rows[b][1]), float)
                        if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                            links.append((a, b))
            n = defaultdict(int)
            for a, b in links:
                n[a] += 1
                n[b] += 1
            found = sum(got[rows[i][0]].n_links for i in range(len(rows)))
            assert found <= 2 * len(links) and found >= 0.97 * 2 * len(links)
            assert all(got[rows[i][0]].n_links <= n[i] for i in range(len(rows)))
            if found == 2 * len(links):
                roots = components(len(rows), links)
                assert all(got[rows[i][0]].component_id == rows[r][0] and got[rows[i][0]].kept == (r == i) for i, r in enumerate(roots))
    finally:
        neardup_vectors.CELL = old


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    tokenizer, all_docs = Tokenizer.from_file(packing.default_tokenizer()), docs(spark)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == all_docs.keys()
    for i, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(all_docs[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert zlib.crc32(ids[p.start : at].tobytes()) == p.ids_crc32
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_shingle_join_against_all_pairs(spark):
    all_docs = docs(spark)
    ids = sorted(all_docs)
    sets = [shingle_set(all_docs[i].text) for i in ids]
    where = defaultdict(list)
    links = []
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
            where[g].append(k)
        links += [(j, k) for j, o in common.items() if 100 * o >= 80 * (len(s) + len(sets[j]) - o)]
    roots = components(len(ids), links)
    got = {r.doc_id: r for r in queries.op6_ngram_join(spark, SF).collect()}
    assert len(links) > 50
    for k, i in enumerate(ids):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[k]), ids[roots[k]])


def test_quality_of_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op7_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= quality.THRESHOLD) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in out if truth[r.doc_id]], [r.score for r in out if not truth[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_rules_against_duckdb_and_plain(spark):
    all_docs = docs(spark)
    for r in queries.op8_quality_rules(spark, SF).collect():
        text = all_docs[r.doc_id].text or ""
        w = words(text)
        seen, repeated = defaultdict(list), set()
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        for at in seen.values():
            if len(at) > 1:
                repeated |= {i + k for i in at for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        verdict = r.covered_words <= rules.MAX_COVERED * r.n_words and r.longest_repeat <= min(max(rules.LONGEST_FLOOR, rules.MAX_LONGEST * r.n_words), rules.LONGEST_CEILING)
        assert (r.base_failed, r.kept) == (failed, not failed and verdict)


def test_pages_give_their_articles(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x00", inner)))
        parts = [" ".join(unescape(x).split()) for x in inner.split("\x00")]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    assert html.DIM


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    loaded = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(loaded)
    columns = loaded.columns
    kept = corpus_pipeline.language_id(spark, loaded, SF)
    assert kept.columns == columns
    texts = {r.doc_id: r.text for r in loaded.collect()}
    langs, scores = model.predict(list(texts.values()))
    want = {i for i, lang, s in zip(texts, langs, scores, strict=True) if lang != "und" and s >= 0.4}
    assert {r.doc_id for r in kept.collect()} == want
    clean = corpus_pipeline.quality_rules(spark, loaded, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in queries.op8_quality_rules(spark, SF).collect() if r.kept} and clean.columns == columns
    single = corpus_pipeline.ngram_join(spark, loaded, SF)
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in queries.op6_ngram_join(spark, SF).collect()} and single.columns == columns
    mixed = corpus_pipeline.mix(spark, loaded, SF)
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id] += 1
    assert mixed.columns == columns
    assert all(copies[r.doc_id] * r.size == r.taken for r in queries.op2_mixing(spark, SF).collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= want
