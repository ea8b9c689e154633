import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import gru, gru_lm
from concord.llm.common import id_and_text
from concord.llm.gru_lm import CLASS_WORDS, HEAD, HIDDEN, Lexicon, Model, inputs, lm_scores, op8_gru_language_model, score_lists, token_counts, train_on, windows

FEW = ((1, 0.1),)


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(pairs):
    c = Counter(w for i, t in pairs if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in pairs:
        w = split(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in df.collect()), key=str)


def test_whole_table_counts_and_base(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_gru_language_model(spark, sf).cache()
    assert rows(got) == brute(pairs)
    held_rows = [r for r in got.collect() if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)  # better than the base on text it never saw
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.collect())


@pytest.mark.parametrize("known", [1 << 17, 5])
def test_odd_rows_and_counts_that_are_joined(docs_of, monkeypatch, known):
    monkeypatch.setattr(gru_lm, "KNOWN", known)
    pairs = [(1, None), (2, ""), (3, "A a B c\n\td é"), (4, "x " * 5000), (5, "x y z q r s t"), (5, "x y z q r s t"), (None, "no id a"), (9, "unseen words only"), (10, "a b c"), (16, "a q unseen")]
    docs = docs_of(pairs, {"score": "clash", "token": 1, "number": 2})
    got = lm_scores(docs, rounds=FEW)
    assert rows(got) == brute(pairs)
    same = [r["score"] for r in got.collect() if r["doc_id"] == 5]
    assert abs(same[0] - same[1]) < 1e-3
    assert lm_scores(docs_of([]), rounds=FEW).count() == 0


def lexicon_of(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return Lexicon(token_counts(id_and_text(docs)))


def test_probabilities_of_a_state_sum_to_one(spark):
    lexicon = lexicon_of(spark, [" ".join(f"w{i}" for i in range(k)) for k in range(1500)])
    assert lexicon.heads == HEAD and len(lexicon.code) > HEAD
    model = Model(lexicon.heads)
    model.unigram(lexicon)
    h = np.random.default_rng(1).standard_normal((1, HIDDEN)).astype(np.float32)
    head = np.arange(lexicon.heads)
    p = np.exp(model.log_probs(np.repeat(h, len(head), 0), head, head // CLASS_WORDS)).sum()
    tails = np.arange(gru_lm.TAIL_CLASSES)
    classes = np.exp(model.log_probs(np.repeat(h, len(tails), 0), np.full(len(tails), -1), HEAD // CLASS_WORDS + tails))
    words = np.arange(lexicon.heads, len(lexicon.code))
    in_class = np.bincount(lexicon.tail[words], lexicon.count[words] + 1, gru_lm.TAIL_CLASSES) / 10**lexicon.log_mass
    unseen = 1 / 10**lexicon.log_mass
    assert np.allclose(in_class + unseen, 1) and abs(p + classes.sum() - 1) < 1e-4


def test_state_is_carried_to_the_end_of_a_text(spark, monkeypatch):
    lexicon = lexicon_of(spark, ["a b c d e f g"] * 3)
    model = Model(lexicon.heads)
    text = [[b"a", b"b", b"q"] * 40, [b"c"], [], [b"d"] * 33]
    scores = []
    for steps in (32, 7, 1000):
        monkeypatch.setattr(gru_lm, "windows", lambda sizes, starts, n=steps: windows(sizes, starts, n))
        scores.append(score_lists(model, lexicon, text)["score"])
    assert np.allclose(scores[0], scores[1], atol=1e-3) and np.allclose(scores[0], scores[2], atol=1e-3)


def test_gradients(spark):
    lexicon = lexicon_of(spark, ["a b c d e f g a a b"] * 3)
    model = Model(lexicon.heads)
    got = lexicon.read([[b"a", b"b", b"zz"], [b"c"]])
    starts, sizes = np.array([0, 4]), np.array([4, 2])
    at, real, first = next(windows(sizes, starts))
    row = inputs(got["row"], at, starts, first)
    own = np.flatnonzero(real.ravel())

    def loss():
        hs = gru.run(model.p["emb"][row], model.p["u"], np.zeros((2, HIDDEN), np.float32)).reshape(-1, HIDDEN)[own]
        return -model.log_probs(hs, got["target"][at].ravel()[own], got["class"][at].ravel()[own]).sum()

    class Keep:
        def __init__(self):
            self.g = {}

        def dense(self, name, grad):
            self.g[name] = grad

        def rows(self, name, index, grad):
            full = np.zeros_like(model.p[name])
            np.add.at(full, index, grad)
            self.g[name] = full

    keep = Keep()
    model.step(keep, row, got["target"][at], got["class"][at], real, np.zeros((2, HIDDEN), np.float32))
    for name, place in (("wc", (3, 0)), ("bc", (0,)), ("wo", (1, 2)), ("bo", (2,)), ("u", (2, 5)), ("emb", (int(row[1, 0]), 7)), ("emb", (gru_lm._START, 20))):
        old, sides = model.p[name][place], []
        for e in (0.01, -0.01):
            model.p[name][place] = old + e
            sides.append(loss())
        model.p[name][place] = old
        assert abs((sides[0] - sides[1]) / 0.02 / math.sqrt(len(own)) - keep.g[name][place]) < 5e-3, name


def test_every_token_is_trained_on_after_its_own_past(spark):
    texts = [[f"t{d}n{k}".encode() for k in range(n)] for d, n in enumerate((900, 1, 40, 256, 0, 513, 31, 32))]
    lexicon = lexicon_of(spark, [" ".join(w.decode() for w in t) for t in texts])
    got, pairs = lexicon.read(texts), Counter()

    class Seen:
        def step(self, opt, row, target, cls, real, h):
            for lane in range(row.shape[1]):
                n = int(real[:, lane].sum())
                # the state tells which token came last, zero at the start of a text
                before = int(h[lane, 0]) - 1
                for k in range(n):
                    assert row[k, lane] == (gru_lm._START if before < 0 else before)
                    before = int(target[k, lane])
                    pairs[before] += 1
                h[lane, 0] = before + 1
            return h

    assert len(lexicon.code) > lexicon.heads
    lexicon.heads = len(lexicon.code)  # targets name every token
    lexicon.row = np.arange(len(lexicon.code))
    n = train_on(Seen(), lexicon, None, texts)
    assert n == got["sizes"].sum() == sum(len(t) + 1 for t in texts)
    assert pairs == Counter(lexicon.code[w] for t in texts for w in (*t, b"\n"))


def test_training_reaches_the_late_words_of_a_text(spark):
    words = [f"s{k}" for k in range(4) for _ in range(256)]
    lexicon = lexicon_of(spark, [" ".join(words)])
    model = Model(lexicon.heads)
    before = model.p["emb"].copy()
    assert train_on(model, lexicon, gru.Adagrad(model.p, 0.1), [[w.encode() for w in words]]) == len(words) + 1
    for k in range(4):
        row = lexicon.row[lexicon.code[f"s{k}".encode()]]
        assert (model.p["emb"][row] != before[row]).any(), k


def test_most_frequent_by_histogram(spark):
    import random as rnd

    from concord.llm.gru_lm import most_frequent

    rnd.seed(1)
    rows = [(f"t{i}", rnd.choice([1, 1, 2, 3, 7, 100, rnd.randint(1, 10**9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "token string, c long")
    order = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    for n in (1, 5, 400, 700, 2999, 3000, 5000):
        assert [tuple(r) for r in most_frequent(df, n)] == order[:n]
    assert most_frequent(df.limit(0), 5) == []


def test_tokens_are_looked_up_once_and_steps_run_across(spark):
    """The cost was a lookup per token and gates strided through memory."""

    class Asked(dict):
        times = 0

        def get(self, *a):
            self.times += 1
            return super().get(*a)

    lexicon = lexicon_of(spark, ["a b c d e f g"] * 3)
    lexicon.code = Asked(lexicon.code)
    got = lexicon.read([[b"a", b"zz", b"b"] * 500, [], [b"zz", b"yy"]])
    assert lexicon.code.times == 0 and got["sizes"].tolist() == [1501, 1, 3]
    assert got["code"].tolist() == [lexicon.code["a".encode()], -1, lexicon.code[b"b"]] * 500 + [0, 0, -1, -1, 0]
    assert got["new"].tolist() == [*range(1, 1500, 3), 1502, 1503]

    rng = np.random.default_rng(3)
    emb, u, first = (rng.standard_normal(s).astype(np.float32) for s in ((9, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (5, HIDDEN)))
    row, d = rng.integers(0, 9, (7, 5)), rng.standard_normal((7, 5, HIDDEN)).astype(np.float32)
    want, kept = gru.run_kept(emb[row], u, first)
    states, gates = gru.run_across(emb, row, u, first.T, keep=True)
    assert np.allclose(states.transpose(0, 2, 1), want, atol=1e-5) and np.allclose(gru.run_across(emb, row, u, first.T)[0], states, atol=1e-6)
    dx, du = gru.back_across(np.ascontiguousarray(d.transpose(0, 2, 1)), first.T, states, gates, u)
    want_dx, want_du = gru.back(d, kept, u)
    assert np.allclose(dx.transpose(0, 2, 1), want_dx, atol=1e-4) and np.allclose(du, want_du, atol=1e-3)


def test_scores_match_a_plain_loop(spark):
    lexicon = lexicon_of(spark, [" ".join(f"w{i}" for i in range(k)) for k in range(0, 1200, 3)])
    model = Model(lexicon.heads)
    model.unigram(lexicon)
    texts = [[b"w1", b"w1190", b"nowhere", b"w3"] * 9, [], [b"x"] * 3 + [b"w700"]]
    got = score_lists(model, lexicon, texts)
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    for text, score in zip(texts, got["score"]):
        h, before, total = np.zeros(HIDDEN, np.float32), gru_lm._START, 0.0
        for w in [*text, b"\n"]:
            h = gru.run(model.p["emb"][[[before]]], model.p["u"], h[None])[0, 0]
            classes = softmax(h @ model.p["wc"] + model.p["bc"])
            code = lexicon.code.get(w, -1)
            if 0 <= code < HEAD:
                own = slice(code // CLASS_WORDS * CLASS_WORDS, code // CLASS_WORDS * CLASS_WORDS + CLASS_WORDS)
                p = classes[code // CLASS_WORDS] * softmax(model.p["wo"][own] @ h + model.p["bo"][own])[code % CLASS_WORDS]
            else:
                tail = gru_lm.tail_class(w)
                p = classes[HEAD // CLASS_WORDS + tail] * ((lexicon.count[code] if code >= 0 else 0) + 1) / 10 ** lexicon.log_mass[tail]
            total += math.log10(p)
            before = code if 0 <= code < HEAD else HEAD + zlib.crc32(w) % gru_lm.TAIL_ROWS
        assert abs(score - total) < 1e-3
    each, words, times = got["rest"]
    assert each.tolist() == [1, 0, 1] and words.to_pylist() == [b"nowhere", b"x"] and times.tolist() == [9, 3]
