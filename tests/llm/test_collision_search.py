import math
import random

import numpy as np
import pytest

from concord.llm import collision_search as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, every, k=10):
    """{query: [(score, vec_id)]} by all distances."""
    rows = [(i, v) for i, v, *_ in rows if i is not None and usable(v)]
    dim = max((len(v) for _, v in rows), default=0)
    rows = [(i, [*map(float, v)] + [0.0] * (dim - len(v))) for i, v in rows]
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        v = min(x for i, x in rows if i == q)
        found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v))), i) for i, x in rows if i != q)
        if found:
            out[q] = found[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_table(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = found(C.op13_collision_counting(spark, folder)), plain(rows, 100)
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    exact = {(q, round(s, 9), i) for q, v in want.items() for s, i in v}
    hits = sum((q, round(s, 9), i) in exact for q, v in got.items() for s, i in v)
    assert hits >= 0.95 * len(exact)


def test_cells_give_what_one_cell_gives(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.2 * r.normal(size=24)).tolist(), 1) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain(rows, 40)
    for shard_rows, block_rows in ((10_000, 10_000), (300, 7)):
        got = found(C.nearest_neighbours(df, every=40, shard_rows=shard_rows, block_rows=block_rows))
        assert sum(i in {x for _, x in want[q]} for q, v in got.items() for _, i in v) >= 0.95 * 10 * len(want)


def test_copies_and_hot_vectors(spark):
    random.seed(5)
    hot = [0.5, -0.25, 1.0, 0.125]
    rows = [(i, hot, 1) for i in range(500)] + [(500 + i, [random.uniform(-1, 1) for _ in range(4)], 1) for i in range(300)]
    got = found(C.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), every=100, shard_rows=200))
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[100] == [(0.0, i) for i in range(10)]
    assert got.keys() == set(range(0, 800, 100))


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [2.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [math.nan, 1.0], 1)]
    rows += [(8, [math.inf, 1.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (0, [3.0, 0.0], 1), (100, [1e200, 1.0], 1), (200, None, 1), (-100, [0.0, 1e-200], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS rank", "3 AS id", "4 AS v", "5 AS cell")
    with np.errstate(over="ignore"):
        got, want = found(C.nearest_neighbours(df)), plain([(i, v) for i, v, _ in rows if i != 100], 100)
    assert set(got) == {0, 100, -100}
    for q in (0, -100):  # fewer than ten candidates: all of them
        assert [i for s, i in got[q] if i != 100] == [i for _, i in want[q]]
    assert C.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.nearest_neighbours(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0


def test_narrow_windows_are_widened():
    r = np.random.default_rng(1)
    v = r.normal(size=(50, 6))
    shard = C.Shard(np.arange(50), v, r.normal(size=(C.PROJECTIONS, 6)), C.THRESHOLD)
    d, rows = shard.search(-1, v[7] * 100, 60)
    assert len(d) == 50 and (np.diff(d) >= 0).all() and sorted(rows.tolist()) == list(range(50))
