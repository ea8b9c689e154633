import random
import re

import xxhash
from pyspark.sql import functions as F

from concord.llm.simhash_tree import Tree, components, drop_near_duplicates, fingerprint_links, op10_simhash_bktree, simhash_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs):
    fps = [brute_fingerprint(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(pairs)):
        groups.setdefault(root(i), []).append(pairs[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((pairs[i][0], f"{fps[i]:016x}", least[root(i)]) for i in range(len(pairs))), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op10_simhash_bktree(spark, sf)) == brute(pairs)


def test_defined_results_for_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(30000))
    pairs = [(5, None), (3, ""), (4, " \n\t"), (None, "a b"), (7, "A b"), (9, long), (9, long), (11, long + " x"), (None, None)]
    got = simhash_components(docs_of(pairs, {"fingerprint": "clash", "fp": 1, "root": 2}))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert rows(got) == brute(pairs)
    assert simhash_components(docs_of([])).count() == 0


def test_split_shards_lose_no_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    for _ in range(60):  # a shared half: shards of many unlinked fingerprints
        fps.add((rng.getrandbits(38) << 26) | 0x2AAAAAA)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {}
    for size in (5, 2048):
        rooted = {r["node"]: r["root"] for r in components(fingerprint_links(df, tree_size=size)).collect()}
        groups = {}
        for f in (r["fp"] for r in df.collect()):
            groups.setdefault(rooted.get(f, f), set()).add(f)
        got[size] = sorted(map(sorted, groups.values()))
    assert got[5] == got[2048]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    seen, want = set(), []
    for f, s in zip(fps, signed):
        if s in seen:
            continue
        todo, comp = [(f, s)], {s}
        while todo:
            x, _ = todo.pop()
            for g, t in zip(fps, signed):
                if t not in comp and bin(x ^ g).count("1") <= 3:
                    comp.add(t)
                    todo.append((g, t))
        seen |= comp
        want.append(sorted(comp))
    assert got[5] == sorted(want)


def test_tree_answers_the_radius_query():
    rng = random.Random(2)
    values = [rng.getrandbits(16) for _ in range(300)]
    tree = Tree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == sorted({v for v in values if bin(v ^ q).count("1") <= 3})


def test_chain_of_links_settles(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_stage_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1)).withColumn("fp", F.lit(1))
    kept = drop_near_duplicates(docs)
    assert kept.dtypes == docs.dtypes
    want = {c for _, _, c in brute([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_stage_on_repeated_and_empty_tables(docs_of):
    kept = drop_near_duplicates(docs_of([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "q"), (None, "q"), (3, None), (4, "")]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", "a b c d"), ("None", "q"), ("3", None)], key=str)
    assert drop_near_duplicates(docs_of([])).count() == 0
