import hashlib
import os
import random

from concord.llm.prefix_hash import WIDTH, Print, code_points, common_extension, edited_fingerprints, likeness, op2_prefix_hash


def brute(pairs):
    rows = sorted(((i, t or "") for i, t in pairs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        share = lambda a, b: len(os.path.commonprefix([a, b]))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), Print(t).value, Print(edited).value, share(t, edited), share(t, nxt)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], r[7], r[8]) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op2_prefix_hash(spark, sf)) == brute(pairs)


def test_ranges_and_odd_rows(docs_of):
    rng = random.Random(8)
    pairs = [(rng.randrange(-50, 50) * 10**12, "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.randrange(30)))) for _ in range(200)]
    pairs += [(None, "first"), (None, None), (3, ""), (3, "x" * 40000), (3, "x" * 40000)]
    docs = docs_of(pairs, {"key": 1, "bucket": 2, "fingerprint": "clash"})
    for size in (7, 50, 5000):
        assert rows(edited_fingerprints(docs, range_rows=size)) == brute(pairs)
    assert rows(edited_fingerprints(docs_of([(1, "alone here")]))) == brute([(1, "alone here")])
    assert edited_fingerprints(docs_of([])).count() == 0


def test_likeness_follows_the_shared_part(spark, sf):
    got = [r for r in op2_prefix_hash(spark, sf).collect() if r["n_chars"] > 1000 and r["fingerprint"] != r["edited_fingerprint"]]
    assert sum(0.2 < r["near_edited"] < 0.8 for r in got) > 0.9 * len(got)
    assert sum(r["near_next"] < 0.2 for r in got) > 0.8 * len(got)
    for r in got[:20]:
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])


def test_spans_and_extensions():
    rng = random.Random(9)
    for _ in range(60):
        s, t = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 80))) for _ in range(2))
        a, b = Print(s).hashes, Print(t).hashes
        i, j = rng.randrange(len(s)), rng.randrange(len(t))
        assert common_extension(a, i, b, j) == len(os.path.commonprefix([s[i:], t[j:]]))
        n = rng.randrange(1, min(len(s) - i, len(t) - j) + 1)
        assert (s[i : i + n] == t[j : j + n]) == (a[0].span(i, n) == b[0].span(j, n))
    assert len(code_points("é\U0001f600")) == 2
    assert likeness(Print("").value, Print("").value) == 1.0 and likeness(Print("").value, Print("x").value) == 0.0
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    assert likeness(Print(text).value, Print(text[: 2000 - WIDTH] + "z" * WIDTH).value) > 0.9
