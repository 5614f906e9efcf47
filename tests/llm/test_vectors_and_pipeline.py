"""Embeddings against brute force, the pipeline stage by stage, and the SQL of this subpackage."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import nn_descent, queries


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    near = x[:1] + rng.standard_normal((120, 16)) * 0.12
    pairs = x[1:60] + rng.standard_normal((59, 16)) * 0.2
    m = np.r_[x, near, pairs]
    label = [int(v) for v in rng.integers(0, 3, 300)]
    label += [label[0]] * 120 + label[1:60]
    rows = [(i, v.astype(np.float32).tolist(), label[i]) for i, v in enumerate(m)]
    bad = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [], 1), (9004, rows[0][1], None), (9005, [None] * 16, 0), (9006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>, label int")
    m = np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = (m @ m.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None]) & ~np.eye(len(m), dtype=bool)
    comp = np.arange(len(m))
    while True:
        new = np.minimum(comp, np.where(s, comp[None, :], len(m)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: r for r in nn_descent.near_vectors(df, max_list=16).collect()}
    links = s.sum(axis=1)
    assert sum(got[i].n_links for i in range(len(m))) >= 0.97 * links.sum() and all(got[i].n_links <= links[i] for i in range(len(m)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(m))]) > 0.97
    assert all(got[b[0]].n_links == 0 and got[b[0]].kept for b in bad)
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_links_between_full_groups(spark):
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    near = np.r_[[a] * 100, [0.95 * a + (1 - 0.95**2) ** 0.5 * b] * 100] + rng.standard_normal((200, 64)) * 1e-4
    m = np.r_[near, [near[0]] * 80, rng.standard_normal((50, 64))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r for r in nn_descent.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(m))] == links.tolist()
    assert {got[i].component_id for i in range(280)} == {0} and [i for i in range(280) if got[i].kept] == [0]


def test_missed_pairs_are_audited(spark, monkeypatch):
    rng = np.random.default_rng(9)
    group, pairs = rng.standard_normal((1, 32)) + rng.standard_normal((100, 32)) * 0.02, rng.standard_normal((20, 32))
    m = np.r_[group, pairs, pairs + rng.standard_normal((20, 32)) * 0.1]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    # the tables miss all pairs outside the group
    first = nn_descent.first_lists
    monkeypatch.setattr(nn_descent, "first_lists", lambda *a: first(*a).where("v < 100"))
    got = {r.vec_id: r for r in nn_descent.near_vectors(df, retries=1).collect()}
    assert all(got[i].n_links == 99 and got[i].component_id == 0 for i in range(100))
    assert all(got[i].n_links == 1 and got[i].component_id == min(i, i + 20 if i < 120 else i - 20) for i in range(100, 140))
    assert {r.recall for r in got.values()} == {1.0}
    for count in (10**5, 10**6, 10**7):
        bits = np.ceil(np.log2(count / 256))
        assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** nn_descent.tables_needed(count, 0.93, 0.97) >= 0.97


def test_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = " ".join(rnd.choice(["the", "thing", "and", "other", "there", "when"]) + str(i % 7) for i in range(200))
    rows = [(7001, clean, "en"), (7002, clean, "en"), (7003, "12 34", None), (7004, None, "en"), (7005, clean + ' more words token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + clean[::-1], "en")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = docs.unionByName(more)
    sf = "/root/testdata/sf0.001"
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    kept = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert 7003 not in kept[0] and 7004 not in kept[0] and {7001, 7002, 7005} <= kept[0]
    assert 7001 in kept[1] and 7002 not in kept[1] and kept[2] <= kept[1] and kept[3] == kept[2] == kept[4]
    assert "04dbebab" not in seen[3].where("doc_id = 7005").first().text
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:4]) and seen[4].columns == ["doc_id", "samples"]


def test_pipeline_odd_rows(spark):
    rows = [(1, "same words here " * 9, "k"), (1, "same words here " * 9, "k"), (None, "other text of this " * 9, "k"), (None, "other text of this " * 9, "k"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, "").count() == 5
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r._kept) for r in kept.where("text is not null").collect()) == [(0, "k"), (1, "k")] and kept.count() == 3


def test_sql(spark):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, d)
        want = con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)), name
