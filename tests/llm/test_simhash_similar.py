import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm.simhash_similar import drop_similar, similar_groups, similar_links


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    both = len(a & b)
    return a == b or 5 * both >= 4 * (len(a) + len(b) - both)


def pairs_of(sets):
    """Pairs of distinct sets with a similarity of at least 0.8; every pair that shares a shingle is tested."""
    holders, found = defaultdict(list), set()
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders[x]}
        found |= {(j, i) for j in near if similar(s, sets[j])}
        for x in s:
            holders[x].append(i)
    return found


def groups_of(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs_of(sets):
        parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def kept(pairs):
    """Ids that stay, by exact similarity of all pairs."""
    sets = list({shingles(t) for _, t in pairs})
    roots = dict(zip(sets, groups_of(sets)))
    best = {}
    for i, t in pairs:
        r = roots[shingles(t)]
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return sorted((None if none else i for none, i in best.values()), key=str)


def got(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table_against_all_pairs(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    assert got(drop_similar(docs)) == kept([tuple(r) for r in docs.select("doc_id", "text").collect()])


def edited(rng, words, least, most):
    out = list(words)
    for _ in range(rng.randint(least, most)):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


def planted(seed=3, many=250):
    rng = random.Random(seed)
    pairs = []
    for k in range(many):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 120, 400)))]
        pairs.append((2 * k, " ".join(words)))
        pairs.append((2 * k + 1, " ".join(edited(rng, words, 1, max(1, len(words) // 35)))))
    return pairs


def test_recall_of_planted_near_copies(docs_of):
    pairs = planted()
    rows, groups = similar_groups(docs_of(pairs))
    found = {r["doc_id"]: (r["loose"], r["root"]) for r in rows.join(groups, "node").collect()}
    sets = [shingles(t) for _, t in pairs]
    want = pairs_of(sets)
    linked = [p for p in want if found[p[0]] == found[p[1]]]
    assert len(want) > 100 and len(linked) >= 0.97 * len(want)
    assert all(similar(sets[2 * k], sets[2 * k + 1]) for k in range(250) if found[2 * k] == found[2 * k + 1])
    # parts of a few sets give the same links
    rows, groups = similar_groups(docs_of(pairs), tree_size=2, part_hashes=60)
    split = {r["doc_id"]: (r["loose"], r["root"]) for r in rows.join(groups, "node").collect()}
    assert {p for p in want if split[p[0]] == split[p[1]]} == set(linked)


def test_a_family_of_variants_is_one_group_by_links(docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    pairs = [(i, " ".join(edited(rng, words, 1, 3))) for i in range(300)]
    # most variants lie beyond 0.8 of each other; what is kept follows the links alone
    assert got(drop_similar(docs_of(pairs), tree_size=64)) == kept(pairs)


def test_links_of_two_parts_cross_only():
    sets = [np.arange(10, dtype=np.uint64)] * 3 + [np.arange(100, 110, dtype=np.uint64)]
    assert similar_links([1, 1, 1, 1], sets, [0, 0, 1, 1], 0.8, 16) == [(2, 0), (2, 1)]
    assert similar_links([1, 1, 1, 1], sets, [0, 0, 0, 0], 0.8, 16) == [(1, 0), (2, 0)]


def test_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(30000))
    pairs = [
        (5, None), (3, ""), (4, " \n\t"), (None, "a b"), (7, "A b"), (9, long), (9, long), (9, "other words of nine here"),
        (11, long + " x"), (None, None), (None, "q r s"), (None, "q r s"), (None, "t"), (12, "a b c d e"), (13, "a b c d e f"),
    ]
    df = docs_of(pairs, {"row": 1, "node": "clash", "set": 2, "fp": 3, "_id": 4, "loose": 5})
    out = drop_similar(df)
    assert out.dtypes == df.dtypes
    assert got(out) == kept(pairs)
    assert sorted(r["text"] for r in out.where(F.col("doc_id").isNull()).collect()) == ["q r s", "t"]
    assert {r["text"][:5] for r in out.where("doc_id = 9").collect()} == {"w0 w1", "other"}
    assert drop_similar(docs_of([])).count() == 0
