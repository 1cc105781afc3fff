"""Operators 9 and 10 against brute force, and the SQL of all operators that have some."""

import duckdb
import numpy as np
import pytest

from pagelattice.llm import embedding_dedup, registry, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], SCHEMA)


def vectors(n, dim, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)).astype(np.float32)
    return x


@pytest.mark.parametrize("n, dim, k", [(300, 4, 5), (200, 16, 3), (4, 3, 5)])
def test_topk(spark, n, dim, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    x = np.round(vectors(n, dim, 1) * 3) / 16  # many ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [None] * dim, 0), (1002, [float("nan")] * dim, 0), (1003, [float("inf")] * dim, 0), (None, x[0].tolist(), 0), (50, x[50 % n].tolist(), 1)]
    q = topk.quantised(table(spark, rows))
    found = topk.search(q, q.where("id % 50 = 0"), k).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    ids = {i: z[i] for i in range(n)} | {50: z[50 % n]}
    for i in [i for i in ids if i % 50 == 0]:
        want = sorted(((-int(z_ @ ids[i]), j) for j, z_ in ids.items() if j != i))[:k]
        assert got[i] == [(j, -s) for s, j in want]
    assert topk.search(q.limit(0), q, k).count() == 0 and topk.search(q, q.limit(0), k).count() == 0


def test_threshold_stops_early():
    rnd = np.random.default_rng(5)
    rows = (rnd.pareto(1.5, (5000, 3)) * 100).astype(np.int64)
    index = topk.SortedLists(np.arange(5000), rows)

    seen = []
    index.rows = type("R", (), {"__getitem__": lambda self, at: (seen.append(len(at)), rows[at])[1]})()
    found, score = index.top(-1, np.array([3, 2, 1]), 5)
    assert score.tolist() == sorted((rows @ [3, 2, 1]).tolist(), reverse=True)[:5] and sum(seen) < 2500


@pytest.mark.parametrize("tile, zone, window", [(1024, 8192, 96), (8, 64, 16)])
def test_links(spark, tile, zone, window, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "ZONE", zone)
    rnd = np.random.default_rng(2)
    x = vectors(200, 16, 3)
    near = x[:30] + rnd.normal(size=(30, 16)).astype(np.float32) * 0.03
    crowd = x[5] + rnd.normal(size=(60, 16)).astype(np.float32) * 0.02
    every = np.concatenate([x, near, crowd, x[:10], x[:3] * 2])
    label = (np.arange(len(every)) % 200 % 2).tolist()
    label[230:290] = [1] * 60
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(every, label, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [None] * 16, 1), (905, x[0][:8].tolist(), 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(table(spark, rows + odd), window=window).collect()}
    z = every.astype(np.float64)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    link = (z @ z.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    part = np.arange(len(every))
    for _ in range(len(every)):
        new = np.minimum(part, np.where(link, part[None, :], len(every)).min(axis=1))
        if (new == part).all():
            break
        part = new
    assert got == {i: (int(link[i].sum()), int(part[i]), bool(part[i] == i)) for i in range(len(every))} | {i: (0, i, True) for i, _, _ in odd}


def test_links_in_a_crowded_label(spark):
    rnd = np.random.default_rng(8)
    n, dim = 2000, 64
    # mean cosine 0.85 within the label; each of the last 100 is a near copy of one of the first
    x = rnd.normal(size=(n, dim)) * np.sqrt(0.15 / dim)
    x[:, 0] += np.sqrt(0.85)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rnd.normal(size=(100, dim))
    x[-100:] = x[:100] + off / np.linalg.norm(off, axis=1, keepdims=True) * 0.19
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.links(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]), window=4).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98 + 1e-6, 1))
    assert len(a) >= 95 and all(got[int(i)] == got[int(j)] for i, j in zip(a, b, strict=True))


def test_passes_follow_size_and_spread():
    need = [embedding_dedup.passes_needed(n, s, 0.98, 96) for n, s in ((90, 1.0), (10_000, 1.0), (1_000_000, 1.0), (1_000_000, 0.3))]
    assert need[0] == embedding_dedup.PASSES and need[1] < need[2] < need[3]


def test_tiles_are_dealt_evenly(spark):
    """One component of 40 tiles and many small ones: no bundle holds much more than the others, whatever the component's size."""
    rows = [(i, 0, 1, [1.0], "a", i % 40, 40) for i in range(4000)] + [(10_000 + i, 1 + i // 2, 1, [1.0], "a", 0, 1) for i in range(400)]
    inside = spark.createDataFrame(rows, "node long, component long, n long, v array<float>, label string, tile int, tiles int")
    dealt = embedding_dedup.deal_tiles(inside, bundle=400)
    sizes = [r["count"] for r in dealt.groupBy("bundle").count().collect()]
    assert sum(sizes) == 2 * (4000 * 40 + 400) and max(sizes) <= 10 * 400
    assert dealt.where("component = 0").groupBy("a", "b").count().count() == 1600


def test_links_of_odd_rows(spark):
    v = [1.0, 2.0]
    got = embedding_dedup.links(table(spark, [(7, v, 1), (7, v, 1), (3, v, 1), (None, v, 1)])).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got) == [(-1, 0, None, True), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False)]
    assert embedding_dedup.links(table(spark, [(1, v, 1)]).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(registry.ORACLE[name]).df(), registry.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert len(a) and a.equals(b)
