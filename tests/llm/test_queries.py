"""The registered queries: SQL twins, search recall, and the pipeline's stages."""

from __future__ import annotations

import numpy as np
from conftest import TESTDATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import nndescent, queries


def test_sql_twins(spark, duck):
    for name, sql in queries.SQL.items():
        columns, rows = rows_of(queries.QUERIES[name](spark, TESTDATA))
        assert (columns, rows) == rows_of_sql(duck, sql), name


def test_search_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(100_000, None), (100_020, [0.0] * 64), (100_040, [float("nan")] * 64), (100_060, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    twice = table.where("vec_id = 20").select((F.col("vec_id") + 100_080).alias("vec_id"), "embedding")
    wide = table.select("vec_id", "embedding").unionByName(odd).unionByName(twice).unionByName(table.where("vec_id = 7").select("vec_id", "embedding")).withColumn("id", F.lit(1)).withColumn("rank", F.lit(1))
    made = nndescent.search(wide).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.unionByName(twice, allowMissingColumns=True).collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    got: dict = {}
    for r in made:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = x @ rows[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21))
        assert all(abs(s - float(rows[v] @ rows[q])) < 1e-9 for _, v, s in found)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_search_of_hard_vectors(spark):
    """No clusters, and one vector far longer than the others: the measured recall holds."""
    rng = np.random.default_rng(4)
    for n, long in ((3000, False), (1000, True)):
        x = rng.normal(size=(n, 32))
        if long:
            x[7] *= 300
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got: dict = {}
        for r in nndescent.search(table).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, n, 20):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
        assert hits / n >= 0.9  # n / 20 queries of 20 neighbours


def test_search_by_brute_force(spark):
    """Where walks find too little, the blocks of queries give exact answers."""
    x = np.random.default_rng(5).normal(size=(300, 8))
    x[20] = x[40]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in nndescent.search(table, settings=nndescent.Settings(tries=0)).collect()}
    for q in range(0, 300, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert [got[q, k] for k in range(1, 21)] == np.lexsort((np.arange(300), -score.round(9)))[:20].tolist()


def test_search_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert nndescent.search(spark.createDataFrame([], kind)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], kind)
    assert [(r["rank"], r.vec_id, r.score) for r in nndescent.search(few).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0), (3, 3, -1.0)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    sizes = [docs.count()]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, TESTDATA), f"test{k}")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert rows_of(docs) == rows_of(corpus_pipeline.run(spark, TESTDATA))


def test_op9_one_walk_over_several_shards_finds_enough(spark, monkeypatch):
    """One walk with the settings' beam does; no vector needs brute force but the measured queries."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    asked, walks = [], []
    exactly, walk = nndescent.exactly, nndescent.walk
    monkeypatch.setattr(nndescent, "exactly", lambda nodes, some, *a: asked.append(some.count()) or exactly(nodes, some, *a))
    monkeypatch.setattr(nndescent, "walk", lambda graph, *a: walks.append(graph.count()) or walk(graph, *a))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nndescent.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(got[20 * q] & set(best[q].tolist())) for q in range(300)) >= 0.9 * 6000
    assert asked == [100]
    assert walks == [6]
