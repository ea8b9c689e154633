import math
import random

import duckdb
import numpy as np
import pytest

from concord.llm import walsh_codes as W

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops: {(vec_id, vector): (code, error)}, codebooks as text."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    ints = []
    for _, v, _ in kept:
        v = [max(-W.BOUND, min(W.BOUND, math.floor(4096 * x))) for x in v]
        ints.append(v + [0] * (parts * width - len(v)))
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[ints[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in ints:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(best(part, books[p])[1], []).append(part)
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _, label), v in zip(kept, ints):
        found = [best(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, ",".join(str(x) for book in books for e in book for x in e)


def test_query_equals_its_sql(spark, sf):
    got = W.op11_walsh_hadamard_codes(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(W.ORACLES["op11_walsh_hadamard_codes"]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 24, 40])
def test_nearest_is_exact_with_ties(width):
    r = np.random.default_rng(width)
    rows, entries = r.integers(-6, 6, (300, width)), r.integers(-6, 6, (16, width))
    entries[9] = entries[3]
    rows[0], rows[1], entries[1] = W.BOUND, -W.BOUND, W.BOUND
    code, error = W.nearest(rows, entries)
    for x, k, e in zip(rows.tolist(), code.tolist(), error.tolist()):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in entries.tolist()]
        assert (e, k) == min((v, i) for i, v in enumerate(d))


def test_sequency_rows_grow_in_sign_changes():
    h = W.sequency_matrix(16)
    assert [(row[1:] != row[:-1]).sum() for row in h] == list(range(16))
    assert (h @ h.T == 16 * np.eye(16)).all()


def test_odd_rows(spark):
    random.seed(1)
    rows = [(i, [random.uniform(-1, 1) for _ in range(20)], i % 3 or None) for i in range(40)]
    rows += [(90, None, 1), (91, [None, 1.0], 1), (92, [math.nan], 2), (93, [math.inf, 0.0], 2)]
    rows += [(94, [], 5), (95, [0.25], None), (96, [1e30, -1e30], 6), (None, [0.5] * 20, 6), rows[3], rows[3], (3, [0.1] * 20, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS code", "1 AS error", "2 AS id", "3 AS v")
    got = [tuple(r) for r in W.coded_vectors(df, keep=("label",)).collect()]
    want, books = plain(rows)
    assert sorted(map(str, [g[:4] for g in got])) == sorted(map(str, want))
    assert {g[4] for g in got} == {__import__("hashlib").sha256(books.encode()).hexdigest()}


def test_few_and_no_rows(spark):
    assert W.coded_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.coded_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    got = W.coded_vectors(spark.createDataFrame([(2, [0.5] * 8, 1), (1, [0.5] * 8, 1)], SCHEMA)).collect()
    assert [(r["id"], r["code"], r["error"]) for r in sorted(got)] == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    assert W.coded_vectors(spark.createDataFrame([(2, [], 1)], SCHEMA)).first()["error"] == 0
