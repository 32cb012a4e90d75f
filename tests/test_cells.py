import random

import numpy as np
import pytest

from quarry.operators import cells, search
from quarry.operators.access import Principal


def brute(queries, vectors, k, exclude=False):
    out = []
    for q, e in queries:
        scored = sorted((-round(float(np.dot(e, x)), 12), c) for c, x in vectors if not (exclude and c == q))
        out += [(q, i + 1, c, round(-s, 9)) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


def made(n, dim=6, seed=1, groups=7):
    """Vectors around a few directions and of many lengths, one of them repeated, and one without length."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim)) * 3
    rows = [(i, (middle[i % groups] + rng.normal(size=dim) * rng.choice([0.05, 1.0])).tolist()) for i in range(n)]
    rows[3] = (3, rows[2][1])
    rows[4] = (4, [0.0] * dim)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = made(400)
    frame = spark.createDataFrame([(*r, r[0] % 4) for r in rows], "chunk_id long, embedding array<double>, tlp_rank int").repartition(4)
    return rows, frame


@pytest.mark.parametrize("count", [1, 5, 60])
def test_every_hit_is_found(spark, table, count):
    rows, frame = table
    index = cells.build(frame, cells=count)
    queries = made(60, seed=2) + [(1000, rows[7][1])]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3)
    for k in (1, 7):
        assert got(cells.topk(asked, index, k)) == brute(queries, rows, k)
    assert index.cells.count() <= count and index.cells.agg({"n": "sum"}).first()[0] == len(rows)


def test_slices_rights_and_own_ids(spark, table, tmp_path, monkeypatch):
    rows, frame = table
    monkeypatch.setattr(cells, "SLICE", 16)  # every cell and its queries are cut
    index = cells.build(frame).write(str(tmp_path))
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    amber = Principal("amber", clearance="amber")
    readable = [r for r in rows if r[0] % 4 <= 2]
    assert got(cells.topk(asked, index, 4, exclude_self=True)) == brute(rows, rows, 4, True)
    assert got(cells.topk(asked, index, 4, principal=amber)) == brute(rows, readable, 4)


def test_more_queries_than_are_sent_at_once(spark, table):
    rows, frame = table
    queries = made(90, seed=5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = brute(queries, rows, 3)
    assert got(search.dense_topk(asked, frame, 3)) == want
    plan = search.dense_topk(asked, frame, 3, block=20)
    assert got(plan) == want
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1  # near hits are a table by then


def test_cosine(spark):
    rows = [(c, e) for c, e in made(120) if any(e)]
    unit = [(c, (np.array(e) / np.linalg.norm(e)).tolist()) for c, e in rows]
    frame, asked = spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), spark.createDataFrame(rows[:40], "query_id long, embedding array<double>")
    assert got(search.dense_topk(asked, frame, 2, cosine=True, block=7)) == brute(unit[:40], unit, 2)


def test_cells_are_ruled_out(spark):
    """Queries in one of many well-parted groups look into few cells."""
    rng = random.Random(3)
    rows = [(i, [20.0 * (j == i % 10) + rng.random() for j in range(10)]) for i in range(500)]
    index = cells.build(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), cells=20)
    looked = []
    whole = cells._met
    try:
        cells._met = lambda probes, *a: (looked.append(probes.count()), whole(probes, *a))[1]
        asked = spark.createDataFrame(rows[:50], "query_id long, embedding array<double>")
        assert got(cells.topk(asked, index, 3)) == brute(rows[:50], rows, 3)
    finally:
        cells._met = whole
    assert sum(looked) < 50 * index.cells.count() / 2


def test_nulls_empty_tables_and_text_ids(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", None, "y"), (None, [1.0, 0.0], "z"), ("b", [0.0, 1.0], "w")], "chunk_id string, embedding array<float>, cells string")
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (None, [1.0, 1.0])], "query_id int, embedding array<double>")
    index = cells.build(rows)
    assert got(cells.topk(asked, index, 5)) == [(1, 1, "a", 1.0), (1, 2, "b", 0.5)]
    assert got(cells.topk(asked, cells.build(rows.limit(0)), 5)) == []
    assert got(cells.topk(asked.limit(0), index, 5)) == []
    with pytest.raises(ValueError, match="dimensions"):
        cells.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id int, embedding array<double>"))
