"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 7).

Each word enters as the sum of a vector of the word and the mean vector of its character n-grams, so an unseen form of a
known stem is known. Two recurrent layers read a window of words in both directions, attention pools their states, and a
logistic unit scores the pooled state. All windows of `WINDOW` words at a distance of `STRIDE` are scored, whatever the
length of the text; the score of a document is that of its worst window. Training is numpy on the driver over a bounded
sample of labelled documents (TRAIN_DOCS documents of at most TRAIN_CHARS characters, half of them toxic where there are enough). The vectors start from the log-odds
of their word or n-gram between toxic and clean documents, and the windows of a toxic document that count as toxic are at
first those with the most telling word, later those that the network finds worst. A fifth of the sample is not trained
on: the scores are shifted so that the decision at 0.3 parts it best.

Defined results: a null or empty text is one window without words; without examples of both labels every score is the
share of label 1 among them (0 without labels); repeated rows are scored one by one; rows without a label or text teach
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import gru
from concord.llm.common import boxed, id_and_text, map_text, table, unboxed, words

WINDOW, STRIDE = 16, 8
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
GRAMS = (3, 4, 5)
INPUT, HIDDEN, ATTENTION = 12, 8, 8
#: Training documents that a word or n-gram must occur in to count; rarer ones are the zero vector.
LEAST_DOCS = 3
#: Bounds of the training sample: documents (half of them toxic where there are enough) and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 3_000, 20_000
THRESHOLD = 0.3
#: Training steps before and after each new choice of toxic windows.
STEPS = (300, 250, 250)
_PRIME = 1000003


def features(distinct: list[bytes], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, n-gram rows laid end to end, and where each word's n-grams start (a word has at least one)."""
    if len(distinct) <= chunk:
        return _features(distinct)
    parts = [_features(distinct[i : i + chunk]) for i in range(0, len(distinct), chunk)]
    before = np.cumsum([0] + [len(grams) for _, grams, _ in parts])
    return np.concatenate([r for r, _, _ in parts]), np.concatenate([g for _, g, _ in parts]), np.concatenate([s + b for (_, _, s), b in zip(parts, before)])


def _features(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in distinct), np.int64, len(distinct))
    size = np.fromiter((len(w) + 2 for w in distinct), np.int64, len(distinct))
    data = np.frombuffer(b"".join(b"<%b>" % w for w in distinct), np.uint8).astype(np.int64)
    start = np.cumsum(size) - size
    word_of = np.repeat(np.arange(len(distinct)), size)
    left = (start + size)[word_of] - np.arange(len(data))  # bytes up to the end of the word
    which, found = [], []
    rolling = np.zeros(len(data), np.int64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(data), np.int64)
        shifted[: len(data) - n + 1] = data[n - 1 :] if n <= len(data) else 0
        rolling = (rolling * _PRIME + shifted) & 0x7FFFFFFFFFFF
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            which.append(word_of[at])
            found.append(((rolling[at] * 31 + n) >> 3) % GRAM_ROWS)
    which, found = np.concatenate(which), np.concatenate(found)
    order = np.argsort(which, kind="stable")
    return rows.astype(np.int32), found[order].astype(np.int32), np.searchsorted(which[order], np.arange(len(distinct)))


def window_index(count: int) -> np.ndarray:
    """Word numbers (windows, WINDOW) of a text of `count` words; count stands for no word."""
    n = max(1, -(-(count - WINDOW) // STRIDE) + 1) if count > WINDOW else 1
    at = np.arange(n)[:, None] * STRIDE + np.arange(WINDOW)
    return np.minimum(at, count)


class Network:
    """Parameters, the forward pass over windows, and a training step."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": w(WORD_ROWS, INPUT, scale=0.05), "gram": w(GRAM_ROWS, INPUT, scale=0.1),
            "in": w(INPUT, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "uf": w(HIDDEN, 3 * HIDDEN), "ub": w(HIDDEN, 3 * HIDDEN),
            "att": w(2 * HIDDEN, ATTENTION), "attv": w(ATTENTION),
            "out": w(2 * HIDDEN), "out0": np.zeros(1, np.float32),
        }
        self.shift, self.constant = 0.0, None

    def start_from(self, odds: dict[str, np.ndarray]) -> None:
        """First coordinates from log-odds; rows without (nan) become zero and, being masked in training, stay so."""
        for name, value in odds.items():
            self.p[name][:, 0] = 0.5 * value
            self.p[name][np.isnan(value)] = 0.0

    def vectors(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        rows, grams, start = found
        if not len(rows):
            return np.zeros((0, INPUT), np.float32)
        total = np.diff(np.append(start, len(grams))).astype(np.float32)[:, None]
        return self.p["word"][rows] + np.add.reduceat(self.p["gram"][grams], start, axis=0) / total

    def projected(self, distinct: list[bytes], chunk: int = 20_000) -> np.ndarray:
        """Gate inputs of each word, and of the missing word in the last row."""
        parts = [self.vectors(features(distinct[i : i + chunk])) @ self.p["in"] for i in range(0, len(distinct), chunk)]
        return np.concatenate([*parts, np.zeros((1, 6 * HIDDEN), np.float32)]) + self.p["bias"]

    def logits(self, x: np.ndarray, index: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Scores of windows: index (windows, WINDOW) into x, real tells words from filling."""
        out = []
        for i in range(0, len(index), 4096):
            at = index[i : i + 4096].T
            zero = np.zeros((at.shape[1], HIDDEN), np.float32)
            fore = gru.run(x[at, : 3 * HIDDEN], self.p["uf"], zero)
            aft = gru.run(x[at[::-1], 3 * HIDDEN :], self.p["ub"], zero)[::-1]
            s = np.concatenate((fore, aft), axis=2)
            e = np.tanh(s @ self.p["att"]) @ self.p["attv"] - 1e4 * ~real[i : i + 4096].T
            a = np.exp(e - e.max(axis=0))
            a /= a.sum(axis=0)
            out.append(np.einsum("tb,tbh,h->b", a, s, self.p["out"], optimize=True) + self.p["out0"])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def step(self, opt: gru.Adagrad, found: tuple, vec: np.ndarray, index: np.ndarray, real: np.ndarray, label: np.ndarray) -> None:
        """One update; vec and found (features) are those of the batch's distinct words, the last word of vec is the missing one."""
        p, n = self.p, len(index)
        at = index.T
        x = (vec @ p["in"] + p["bias"])[at]
        zero = np.zeros((n, HIDDEN), np.float32)
        fore, kf = gru.run_kept(x[:, :, : 3 * HIDDEN], p["uf"], zero)
        aft, kb = gru.run_kept(x[::-1, :, 3 * HIDDEN :], p["ub"], zero)
        s = np.concatenate((fore, aft[::-1]), axis=2)
        q = np.tanh(s @ p["att"])
        e = q @ p["attv"] - 1e4 * ~real.T
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        d = (gru.sigmoid(pooled @ p["out"] + p["out0"]) - label).astype(np.float32) / n
        d_pooled = d[:, None] * p["out"]
        da = np.einsum("tbh,bh->tb", s, d_pooled)
        de = a * (da - (a * da).sum(axis=0))
        dq = de[:, :, None] * p["attv"] * (1 - q * q)
        ds = a[:, :, None] * d_pooled + dq @ p["att"].T
        grads = {"out": d @ pooled, "out0": d.sum(keepdims=True), "attv": np.einsum("tb,tbk->k", de, q), "att": np.einsum("tbh,tbk->hk", s, dq)}
        dxf, grads["uf"] = gru.back(ds[:, :, :HIDDEN], kf, p["uf"])
        dxb, grads["ub"] = gru.back(ds[::-1, :, HIDDEN:], kb, p["ub"])
        dx = np.concatenate((dxf, dxb[::-1]), axis=2).reshape(-1, 6 * HIDDEN)
        flat = at.reshape(-1)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
        used = flat[order][first]
        d_proj = np.zeros((len(vec), 6 * HIDDEN), np.float32)
        d_proj[used] = np.add.reduceat(dx[order], first, axis=0)
        grads["bias"] = d_proj.sum(axis=0)
        grads["in"] = vec.T @ d_proj
        d_vec = (d_proj @ p["in"].T)[:-1]
        for k, g in grads.items():
            opt.dense(k, g)
        rows, grams, start = found
        size = np.diff(np.append(start, len(grams)))
        d_gram = np.repeat(d_vec / size[:, None].astype(np.float32), size, axis=0)
        known_w, known_g = self.known["word"][rows], self.known["gram"][grams]
        opt.rows("word", rows[known_w], d_vec[known_w])
        opt.rows("gram", grams[known_g], d_gram[known_g])


def pick_rows(found: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of some of the words."""
    rows, grams, start = found
    size = np.diff(np.append(start, len(grams)))[at]
    first = np.cumsum(size) - size
    return rows[at], grams[np.repeat(start[at] - first, size) + np.arange(size.sum())], first


def log_odds(found: tuple[np.ndarray, np.ndarray, np.ndarray], docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Log-odds of the table rows between toxic and clean documents; nan for rows in fewer than LEAST_DOCS of them."""
    out = {}
    toxic = max(1.0, float(labels.sum()))
    clean = max(1.0, float(len(labels) - labels.sum()))
    for name, size in (("word", WORD_ROWS), ("gram", GRAM_ROWS)):
        seen = np.zeros((2, size))
        for own, y in zip(docs, labels.astype(int).tolist()):
            if len(own):
                seen[y][np.unique(pick_rows(found, own)[0 if name == "word" else 1])] += 1
        odds = np.log((seen[1] + 0.1) / (toxic + 0.2)) - np.log((seen[0] + 0.5) / (clean + 1.0))
        out[name] = np.where(seen.sum(axis=0) >= LEAST_DOCS, np.clip(odds, -3, 5), np.nan).astype(np.float32)
    return out


def train(examples: list[tuple[bytes, int]], steps: tuple[int, ...] = STEPS, batch: int = 256, seed: int = 7, clean_weight: float = 1.0) -> Network:
    """A network from (text, label) pairs; steps before and after each new choice of toxic windows. clean_weight: how many
    clean documents one of the sample stands for, against a toxic one."""
    net = Network(seed)
    labels = np.array([y for _, y in examples], np.float32)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.0
        return net
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    numbers = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t, _ in examples]
    distinct = list(number) or [b""]
    found = features(distinct)
    del number
    aside = np.arange(len(numbers)) % 5 == 4
    if labels[aside].sum() < 5 or labels[~aside].sum() < 5:  # too few to set some aside
        aside[:] = False
    learn = np.flatnonzero(~aside)
    net.start_from(odds := log_odds(found, [numbers[i] for i in learn.tolist()], labels[learn]))
    net.known = {k: ~np.isnan(v) for k, v in odds.items()}
    index = [np.append(own, np.int32(len(distinct)))[window_index(len(own))] for own in numbers]
    doc = np.repeat(np.arange(len(numbers)), [len(x) for x in index])
    index = np.concatenate(index)
    real = index < len(distinct)
    real[:, 0] = True
    toxic, own = labels[doc] == 1, ~aside[doc]
    clean = np.flatnonzero(~toxic & own)
    opt = gru.Adagrad(net.p, 0.05)
    scores = np.append(net.vectors(found)[:, 0], -9.0)[index].max(axis=1)
    for count in steps:
        worst = np.full(len(numbers), -np.inf, np.float32)
        np.maximum.at(worst, doc, scores)
        chosen = np.flatnonzero(toxic & own & ((scores >= worst[doc]) | (scores > max(0.0, np.quantile(scores[clean], 0.999)))))
        if not len(chosen):  # the worst are held in single precision and may have been rounded above their own scores
            chosen = np.flatnonzero(toxic & own & (scores.astype(np.float32) >= worst[doc]))
        hard = clean[np.argsort(-scores[clean])[: max(batch, len(clean) // 20)]]
        for _ in range(count):
            pick = np.concatenate((rng.choice(chosen, batch // 4), rng.choice(clean, batch // 2), rng.choice(hard, batch - batch // 4 - batch // 2)))
            used, local = np.unique(index[pick], return_inverse=True)
            some = pick_rows(found, used[used < len(distinct)])
            vec = np.concatenate((net.vectors(some), np.zeros((1, INPUT), np.float32)))
            local = np.minimum(local.reshape(len(pick), WINDOW), len(vec) - 1)
            net.step(opt, some, vec, local, real[pick], toxic[pick].astype(np.float32))
        scores = net.logits(net.projected(distinct), index, real)
    worst = np.full(len(numbers), -np.inf, np.float32)
    np.maximum.at(worst, doc, scores)
    judged = aside if aside.any() else np.ones(len(numbers), bool)
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(worst[judged], labels[judged], clean_weight))
    return net


def best_cut(score: np.ndarray, label: np.ndarray, clean_weight: float = 1.0) -> float:
    """Cut with the best F1 over score >= cut: half way between the two scores around it."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(label[order])
    f1 = 2 * hit / (hit + clean_weight * np.cumsum(1 - label[order]) + label.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def score_texts(net: Network, texts: list[bytes]) -> list[float]:
    if net.constant is not None:
        return [net.constant] * len(texts)
    lists = [words(t) for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
    missing = len(number)
    x = net.projected(list(number))
    index, starts = [], [0]
    for ws in lists:
        own = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
        at = np.append(own, missing)[window_index(len(ws))]
        index.append(at)
        starts.append(starts[-1] + len(at))
    index = np.concatenate(index)
    real = index < missing
    real[:, 0] = True
    worst = np.maximum.reduceat(net.logits(x, index, real), starts[:-1])
    return gru.sigmoid(worst.astype(np.float64) + net.shift).tolist()


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_DOCS, longest: int = TRAIN_CHARS, steps: tuple[int, ...] = STEPS) -> Network:
    """Network from a bounded sample of the labelled rows that are not held out: of each label those with the smallest
    hashes of the id, as many of both where there are enough."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & ~held_out() & (F.length("text") <= longest))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = rows.select("doc_id").join(marks, "doc_id").distinct()
    every = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = min([limit // 2, *every.values()]) if len(every) == 2 else limit
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit - few if n > few else few) for y, n in sorted(every.items())]
    if not parts:
        return train([])
    sample = parts[0].union(parts[1]) if len(parts) == 2 else parts[0]
    found = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("t"))  # the sample has `limit` rows at most
    got = sorted(((r["doc_id"], bytes(r["t"]), r["y"]) for r in found.limit(2 * limit).collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    toxic = sum(y for _, _, y in got)
    weight = (every.get(0, 0) / max(1, every.get(1, 0))) / ((len(got) - toxic) / max(1, toxic)) if 0 < toxic < len(got) else 1.0
    return train([(t, y) for _, t, y in got], steps, clean_weight=weight)


def _scorer(spark: SparkSession, net: Network):
    shared = spark.sparkContext.broadcast(net)  # a fixed size: the tables of the network
    return lambda texts: {"score": score_texts(shared.value, texts)}


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    net = fitted(docs, labels, id_col=id_col, text_col=text_col, **how)
    scored = map_text(id_and_text(docs, id_col, text_col), _scorer(docs.sparkSession, net), "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents scored at THRESHOLD or more."""
    net = fitted(docs, labels, id_col=id_col, text_col=text_col, **how)
    scored = map_text(boxed(docs, text_col), _scorer(docs.sparkSession, net), "score double")
    return unboxed(scored.where(F.col("score") < THRESHOLD), docs.columns)


def op7_bigru_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_bigru_attention": op7_bigru_attention}
ORACLES: dict[str, str] = {}
