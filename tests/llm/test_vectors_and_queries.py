"""Vectors against brute force, components, packed bytes, the registered queries and the pipeline."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from agoradesk.llm import vectors
from agoradesk.llm.components import components
from agoradesk.llm.packing_bytes import pack, unpack
from agoradesk.llm.queries import QUERIES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def brute(rows, cosine=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float64)
        ok[k] = (i, x / np.linalg.norm(x), label)
    links = {k: 0 for k in range(len(rows))}
    name = {k: rows[k][0] for k in range(len(rows))}
    pairs = [
        (a, b) for a in ok for b in ok
        if a != b and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and float(ok[a][1] @ ok[b][1]) >= cosine - 1e-12
    ]
    for a, _ in pairs:
        links[a] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                changed = True
    return sorted(((rows[k][0], links[k], name[k], rows[k][0] == name[k]) for k in range(len(rows))), key=str)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 50 * 16 * 8)
    monkeypatch.setattr(vectors, "COSINES", 1_000)
    draw = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1):
        centres = draw.normal(size=(12, 16))
        for _ in range(160 if label else 60):
            v = centres[draw.integers(12)] + draw.normal(size=16) * draw.choice([0.02, 0.14, 0.5])
            rows.append((n, [float(np.float32(x)) for x in v], label))
            n += 1
    rows += [(n, rows[3][1], 0), (n + 1, rows[3][1], 1), (n + 2, [2 * x for x in rows[5][1]], 0), (n + 3, rows[7][1], 0), (n + 3, rows[7][1], 0)]
    rows += [(n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [1.0, None], 0), (n + 7, [float("nan")] * 16, 1), (n + 8, [float("inf")] * 16, 1)]
    rows += [(n + 9, rows[3][1], None), (n + 10, [1.0, 2.0], 0), (n + 11, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as block", "'x' as lead")
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 100
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_join_roots_names_groups_by_their_smallest():
    draw = np.random.default_rng(8)
    for n, m in ((1, 0), (50, 30), (200, 400), (300, 150)):
        a, b = draw.integers(0, n, m), draw.integers(0, n, m)
        root = np.arange(n)
        for part in np.array_split(np.arange(m), 3):
            root = vectors.join_roots(root, a[part], b[part])
        want, moved = np.arange(n), True
        while moved:
            before = want.copy()
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
            moved = bool((want != before).any())
        assert np.array_equal(root, want)


def test_cells_hold_every_partner():
    draw = np.random.default_rng(2)
    x = vectors.unit(draw.normal(size=(400, 8)))
    pivots = x[:9]
    radius = 0.5
    own, reach = vectors.cell_matrix(x, pivots, radius)
    apart = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for a, b in zip(*np.nonzero(apart <= radius), strict=True):
        assert reach[b, own[a]]
    assert reach.sum() < reach.size


def test_components_of_stars_chains_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 164)] + [(5, k) for k in range(6, 90)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 165)}, **{k: 5 for k in range(5, 90)}, 200: 200, 201: 200, 202: 200}
    assert components(df.limit(0)).count() == 0


def test_packed_bytes_round_trip():
    draw = np.random.default_rng(3)
    arrays = [np.zeros(0, np.uint64), np.array([7]), np.sort(draw.integers(0, 1 << 40, 500)), draw.integers(0, 1 << 63, 300, dtype=np.uint64) * 2 + 1, np.ones(90)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert np.array_equal(np.asarray(a, dtype=np.uint64), b)


@here
@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(list(rel.columns), rel.fetchall())[0]


@here
@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if not sql))
def test_queries_give_every_document(spark, name):
    df = entry.queries()[name](spark, SF)
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    want = spark.read.parquet(f"{SF}/documents.parquet")
    if name == "op4_packing":
        want = want.where("trim(text) <> ''")
        assert set(ids) == {r["doc_id"] for r in want.select("doc_id").collect()}
    else:
        assert sorted(ids) == sorted(r["doc_id"] for r in want.select("doc_id").collect())


@here
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, None, "s", None), (9002, "123 456 !", None, "s", 9), (None, "plain words about a river", "en", "s", 25)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "language_id":
            ids = {r["doc_id"] for r in out.collect()}
            assert 9001 not in ids and 9002 not in ids and len(ids) == docs.count() - 2
        elif name == "near_duplicates":
            found = corpus_pipeline.shingles.jaccard_components(docs).where("doc_id is not null").collect()
            assert {r["doc_id"] for r in out.where("doc_id is not null").collect()} == {r["component_id"] for r in found}
        elif name != "best_fit_packing":
            assert out.count() == docs.count()
        if name == "best_fit_packing":
            words = sum(len((r["text"] or "").split()) for r in docs.collect())
            assert sum(r["length"] for r in out.collect()) == pytest.approx(words, rel=0.01)
        else:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(out.collect(), docs.schema)


@here
def test_run_is_the_chain_of_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
