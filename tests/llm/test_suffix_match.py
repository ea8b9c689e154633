import hashlib
import random
import re

from pyspark.sql import functions as F

from concord.llm.suffix_match import Block, Shard, contamination, decontaminated, longest_matches, op3_suffix_decontamination


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows, lists = {}, [split(text) for _, text in items]
    for name, text in items:
        w = split(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(name)
    out = []
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                names = windows.get(tuple(w[p : p + n]))
                if names:
                    hit.update(range(p, p + n))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        best, at = max(((n, -p) for x in lists for n, p in matches(w, x)), default=(None, None))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit), best, None if at is None else -at))
    return sorted(out, key=str)


def matches(w, item):
    """(words, start) of every maximal common stretch of a document and an item that holds a window of the item."""
    least = min(10, len(item))
    for shift in range(-len(item), len(w)) if item else ():
        run = 0
        for q in range(len(item) + 1):
            p = q + shift
            if q < len(item) and 0 <= p < len(w) and w[p] == item[q]:
                run += 1
                continue
            if run >= least:
                yield run, p - run
            run = 0


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def result(docs, bench, **how):
    f = contamination(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), bench, **how)
    return rows(f.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0, "longest", "longest_at"))


def pairs(spark, sf, name, key):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]


def test_whole_tables_against_brute_force(spark, sf):
    want = brute(pairs(spark, sf, "documents", "doc_id"), pairs(spark, sf, "benchmark", "item_id"))
    assert any(r[5] for r in want)
    assert rows(op3_suffix_decontamination(spark, sf)) == want


def test_random_small_alphabet_in_one_and_many_blocks(spark, docs_of):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(7, None), (None, text(40)), (7, ""), (200, text(3000))]
    items = [(i, text(rng.randrange(0, 30))) for i in range(12)] + [(3, "b a"), (None, "c c c c c"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert result(docs_of(docs), bench) == want
    assert result(docs_of(docs), bench, block_bytes=60) == want
    assert result(docs_of([]), bench) == []
    assert result(docs_of(docs), bench.limit(0)) == brute(docs, [])


def test_stage_drops_affected_documents_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_hit", F.lit("x")).withColumn("longest", F.lit(1))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r[0] for r in brute(pairs(spark, sf, "documents", "doc_id"), pairs(spark, sf, "benchmark", "item_id")) if r[5]}
    kept = decontaminated(docs, bench)
    assert kept.dtypes == docs.dtypes
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_longest_match_and_location(spark, docs_of):
    item = " ".join(f"k{i}" for i in range(30))
    docs = docs_of([(1, "x " + " ".join(f"k{i}" for i in range(5, 18)) + " y"), (2, "z z " + " ".join(f"k{i}" for i in range(5, 25)))])
    got = {r["start"]: (r["length"], r["doc_id"], r["word"]) for r in longest_matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got[5] == (20, 2, 2) and got[10] == (15, 2, 7) and 0 not in got and 16 not in got


def test_suffix_array_is_sorted():
    rng = random.Random(4)
    lists = [[rng.choice((b"a", b"b", b"q")) for _ in range(40)] for _ in range(5)]
    block = Block([("x", b"a b a a b b a b a b a a b")])
    shard = Shard(lists, block)
    keys = [tuple(shard.words[p : p + block.depth]) for p in shard.array.tolist()]
    assert keys == sorted(keys)
