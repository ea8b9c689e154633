import random
import re
import zlib
from collections import Counter, defaultdict

from concord.llm import pivotal_grams as P

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs):
    """{word: (form, root, n, n_near, form_n)} by deletions of one letter."""
    counts = Counter()
    for i, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i], w[i + 1 :]].add(w)
    for (a, b), group in less.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda o: (-words[o], o))
            if words[best] >= 5 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(P.op12_pivotal_grams(spark, sf)) == plain(docs)


def test_few_letters_many_neighbours(spark, docs_of):
    random.seed(2)
    words = {"".join(random.choice("abé") for _ in range(random.randint(5, 9))) for _ in range(900)}
    docs = [(i, " ".join(f"{w} " * random.randint(1, 9) for w in random.sample(sorted(words), 500))) for i in range(8)]
    got = found(P.spelling_variants(docs_of(docs)))
    assert got == plain(docs)
    assert max(v[3] for v in got.values()) >= 10


def test_chains_ties_and_case(spark, docs_of):
    text = "aaaaaa " * 1000 + "AAAAAAA " * 200 + "aaaaaaaa " * 40 + "aaaaaaaaa " * 8 + "bbbbbb " * 25 + "bbbbbc bbbbbd " * 5 + "ÀÀÀÀÀÀ àààààà " * 6
    docs = [(1, text), (2, None), (3, ""), (None, "zzzzzz " * 5), (4, "short of six")]
    got = found(P.spelling_variants(docs_of(docs, {"word": "x", "n": 1, "id": 2, "form": "y"})))
    assert got == plain(docs)
    assert got["aaaaaaaaa"][1] == "aaaaaa" and got["bbbbbc"][0] == "bbbbbb" and "ÀÀÀÀÀÀ" in got and "zzzzzz" in got


def test_long_runs_by_halves(spark, docs_of):
    random.seed(4)
    base = ["".join(random.choice("abcdef") for _ in range(n)) for n in (46, 47, 48, 49, 50, 51, 3000)] + ["a" * 48, "a" * 49, "a" * 50, "b" * 12_000]
    words = set(base)
    for w in base:
        for _ in range(3):
            i = random.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + "g" + w[i:], w[:i] + "g" + w[i + 1 :]}
    docs = [(i, " ".join(f"{w} " * (25 if w in base else 5) for w in sorted(words) if len(w) < 4000 or i == 1)) for i in range(1, 3)]
    # the plain version copies a word for each letter, so the longest run stands in a test of its own
    short = [(i, " ".join(w for w in t.split() if len(w) < 4000)) for i, t in docs]
    assert found(P.spelling_variants(docs_of(short))) == plain(short)
    long = [(7, ("c" * 12_000 + " ") * 25 + ("c" * 6_000 + "d" + "c" * 6_000 + " ") * 5)]
    got = found(P.spelling_variants(docs_of(long)))
    assert sorted(v[3] for v in got.values()) == [1, 1] or len(got) == 1


def test_pivots_are_the_cheapest_disjoint_pair():
    random.seed(6)
    for _ in range(300):
        word = "".join(random.choice("abc") for _ in range(random.randint(6, 10)))
        ranks = {g: r for r, g in enumerate(random.sample([x + y for x in "abc" for y in "abc"], 9))}
        places, _ = P.prefix_places(word, ranks)
        a, b = P.pivots(word, places, ranks)
        cost = [ranks[word[i : i + 2]] + ranks[word[j : j + 2]] for i in places for j in places if j - i >= 2]
        assert b - a >= 2 and ranks[word[a : a + 2]] + ranks[word[b : b + 2]] == min(cost)


def test_empty_table(spark, docs_of):
    assert P.spelling_variants(docs_of([])).count() == 0
    assert P.spelling_variants(docs_of([(1, None)])).count() == 0
