"""Language-model scoring with a gated recurrent network (operator 8).

Tokens are counted over all training documents. The most frequent ones form classes by frequency (a class is a run of the
ranking), all others fall into classes by the end of the word. The network reads the tokens before a place and gives the
probability of the class, then of the word within it: by a softmax for the frequent classes, by the corpus counts plus one
for the others, so that every token has a probability and those of a state sum to at most one.

Training is numpy by truncated backpropagation over windows of STEPS tokens, over every token of every training document:
each partition starts from the same parameters and trains on its own documents, and Spark averages the parameters, weighted
by tokens; once over a share of the documents, then over all. Training and scoring carry the state across the windows of a
document to its end; only its first token is read after the start row and a zero state.
Counts of tokens outside the KNOWN most frequent ones come by a join on the token, so nothing that grows with the
vocabulary is collected or broadcast.

Defined results: a null or empty text is the end token alone; documents with a null id are trained on; repeated rows are
scored one by one; without training documents every count is zero and the network is untrained; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import gru
from concord.llm.common import id_and_text, slices, table
from concord.session import as_table, new_run_dir

END = b"\n"  # cannot be a token
HEAD, CLASS_WORDS, TAIL_CLASSES, TAIL_ROWS = 1024, 32, 16, 512
CLASSES = HEAD // CLASS_WORDS + TAIL_CLASSES
#: Most frequent tokens whose counts every task holds.
KNOWN = 1 << 16
HIDDEN, STEPS, STREAMS = 16, 32, 256
#: (share of the training documents as 1 / n, learning rate) of each training round.
ROUNDS = ((8, 0.1), (1, 0.1))
LM_SLICE = 6 << 20
COUNT_SLICE = 16 << 20
_START = HEAD + TAIL_ROWS  # row of the state before the first token
#: Distinct tokens a counting task holds before it hands them on.
COUNT_FLUSH = 500_000


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text, its end token left out."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0  # white space at the ends of a text leaves empty ones
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full)))[ends], pa.int32()), words.filter(pa.array(full)).cast(pa.binary()))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, tail, c): how often each token occurs in docs (doc_id, text), the end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches, "text", COUNT_SLICE):
            seen = token_lists(part.column("text")).flatten().value_counts()
            held.append(pa.table({"token": seen.field(0), "n": seen.field(1)}))
            held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([part.num_rows], pa.int64())}))
            if sum(map(len, held)) > 2 * COUNT_FLUSH:
                held = [summed(held)]
                if len(held[0]) > COUNT_FLUSH:
                    yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    def summed(held: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"token": got.column("token").cast(pa.string()), "n": got.column("n_sum")}).combine_chunks()

    counts = docs.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))
    tail = F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)) % TAIL_CLASSES  # tail_class
    return counts.select("token", tail.cast("int").alias("tail"), "c")


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n rows of (token, c) with the largest c, ties by token.

    A plain top-n sends n rows of every partition to the driver. So the count of the n-th row is found first, from a
    histogram of quarter octaves and then of the counts in one of them; what is fetched are the rows above it and those
    that tie with it.
    """
    octave = F.floor(F.log2(F.col("c").cast("double")) * 4)
    above, cut = 0, 0
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if above + r["n"] >= n:
            inside = counts.where(octave == r["o"]).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
            for x in sorted(inside, reverse=True):
                above, cut = above + x["n"], x["c"]
                if above >= n:
                    break
            break
        above += r["n"]
    rows = counts.where(F.col("c") >= cut).select("token", "c").collect()
    return sorted(rows, key=lambda r: (-r["c"], r["token"].encode()))[:n]


class Lexicon:
    """Totals of the counts, the KNOWN most frequent tokens, and which of them are in the head."""

    def __init__(self, counts: DataFrame) -> None:
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.total, self.distinct = int(total), int(distinct)
        top = most_frequent(counts, KNOWN)
        ranked = [(r["token"].encode(), r["c"]) for r in top if r["token"] != END.decode()]
        ends = counts.where(F.col("token") == END.decode()).select("c").first()
        words = [(END, ends["c"] if ends else 0), *ranked]
        self.code = {w: i for i, (w, _) in enumerate(words)}
        self.count = np.array([c for _, c in words], np.int64)
        self.tail = np.array([tail_class(w) for w, _ in words], np.int32)
        self.row = np.array([i if i < HEAD else HEAD + zlib.crc32(w) % TAIL_ROWS for i, (w, _) in enumerate(words)], np.int32)
        self.heads = min(HEAD, len(words))
        mass = np.zeros(TAIL_CLASSES, np.int64)
        for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            mass[r["tail"]] = r["c"] + r["n"]
        np.subtract.at(mass, self.tail[: self.heads], self.count[: self.heads] + (self.count[: self.heads] > 0))
        self.log_mass = np.log10(mass + 1.0)  # counts plus one of the tokens of each tail class, and one for unseen ones

    @cached_property
    def words(self) -> pa.Array:
        """The known tokens in the order of their codes."""
        return pa.array(list(self.code), pa.binary())

    def read(self, lists: pa.ListArray | list[list[bytes]]) -> dict:
        """Arrays over all tokens (end tokens included) of several texts, laid end to end."""
        lists = lists if isinstance(lists, pa.ListArray) else pa.array(lists, pa.list_(pa.binary()))
        sizes = lists.value_lengths().to_numpy().astype(np.int64) + 1
        flat = lists.flatten().dictionary_encode()
        distinct, which = flat.dictionary, flat.indices.to_numpy()
        own = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy()  # code of each distinct token
        tail, row = self.tail[own], self.row[own]
        new = np.flatnonzero(own < 0)
        if len(new):
            rest = distinct.take(pa.array(new))
            tail[new] = _crcs(pc.binary_slice(rest, -2)) % TAIL_CLASSES
            row[new] = HEAD + _crcs(rest) % TAIL_ROWS
        place = np.arange(len(which)) + np.repeat(np.arange(len(sizes)), sizes - 1)

        def laid(of_distinct: np.ndarray, of_end) -> np.ndarray:
            out = np.full(len(which) + len(sizes), of_end, of_distinct.dtype)
            out[place] = of_distinct[which]
            return out

        end = self.code[END]
        head = (own >= 0) & (own < self.heads)
        target, cls = np.where(head, own, -1).astype(np.int32), np.where(head, own // CLASS_WORDS, HEAD // CLASS_WORDS + tail).astype(np.int16)
        unknown = np.flatnonzero(own[which] < 0)
        return {
            "sizes": sizes, "code": laid(own, end), "row": laid(row, self.row[end]), "tail": laid(tail, self.tail[end]),
            "target": laid(target, end), "class": laid(cls, end // CLASS_WORDS),
            "new": place[unknown], "rest": which[unknown], "distinct": distinct,
        }


def _crcs(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words))


class Model:
    """Parameters as float arrays by name; `flat` and `load` turn them into one row of numbers and back."""

    def __init__(self, heads: int, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "emb": w(_START + 1, 3 * HIDDEN, scale=0.2), "u": w(HIDDEN, 3 * HIDDEN, scale=0.3),
            "wc": w(HIDDEN, CLASSES, scale=0.02), "bc": np.zeros(CLASSES, np.float32),
            "wo": w(HEAD, HIDDEN, scale=0.02), "bo": np.zeros(HEAD, np.float32),
        }
        self.p["bo"][heads:] = -30.0  # places of the head that no word takes

    def unigram(self, lexicon: Lexicon) -> None:
        """Biases from the counts, so that training starts from the frequencies."""
        head = lexicon.count[: lexicon.heads].astype(float) + 1
        mass = np.concatenate((np.add.reduceat(np.pad(head, (0, HEAD - len(head))), np.arange(0, HEAD, CLASS_WORDS)), 10.0**lexicon.log_mass))
        self.p["bc"][:] = np.log(np.maximum(mass, 1e-3) / mass.sum())
        self.p["bo"][: len(head)] = np.log(head)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def weights(self) -> tuple[np.ndarray, np.ndarray, bool, bool]:
        """Of the classes (HIDDEN + 1, CLASSES) and of the words of each head class, biases last; whether a logit may need a bound."""
        wc = np.vstack((self.p["wc"], self.p["bc"]))
        wo = np.hstack((self.p["wo"], self.p["bo"][:, None]))
        # states lie between -1 and 1
        return wc, wo.reshape(-1, CLASS_WORDS, HIDDEN + 1), bool(np.abs(wc).sum(axis=0).max() > 60), bool(np.abs(wo).sum(axis=1).max() > 60)

    def log_probs(self, h: np.ndarray, target: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural logs of P(class) and, for head words, P(word | class) after each state."""
        wc, wo, wide_c, wide_o = self.weights()
        order, runs = _by_class(cls)
        hs, c, word, heads = _with_one(h, order), cls[order], target[order] % CLASS_WORDS, runs[-1][2] if runs else 0
        lp, x = np.empty(len(h), np.float64), np.empty((heads, CLASS_WORDS), np.float32)
        for i in range(0, len(h), 8192):  # what fits a cache
            lp[i : i + 8192] = _log_of(hs[i : i + 8192] @ wc, c[i : i + 8192], wide_c)
        for k, a, b in runs:
            np.matmul(hs[a:b], wo[k].T, out=x[a:b])
        for i in range(0, heads, 8192):
            lp[i : min(i + 8192, heads)] += _log_of(x[i : i + 8192], word[i : min(i + 8192, heads)], wide_o)
        out = np.empty(len(h), np.float64)
        out[order] = lp
        return out

    def step(self, opt: gru.Adagrad, row: np.ndarray, target: np.ndarray, cls: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One update over a window (steps, streams); returns the states after it."""
        p = self.p
        wc, wo, wide_c, wide_o = self.weights()
        begin = np.ascontiguousarray(h.T)
        states, gates = gru.run_across(p["emb"], row, p["u"], begin, keep=True)
        own = np.flatnonzero(real.ravel())
        order, runs = _by_class(cls.ravel()[own])
        own, heads = own[order], runs[-1][2] if runs else 0
        hs = _with_one(states.transpose(0, 2, 1).reshape(-1, HIDDEN), own)
        t, c = target.ravel()[own], cls.ravel()[own]
        scale = np.float32(1.0 / np.sqrt(len(own)))
        d = _softmax_less(hs @ wc, c, scale, wide_c)
        dh = np.zeros((len(own) + 1, HIDDEN), np.float32)  # the last row is for places without a token
        np.matmul(d, p["wc"].T, out=dh[:-1])
        dwc = hs.T @ d
        e = np.empty((heads, CLASS_WORDS), np.float32)
        for k, a, b in runs:
            np.matmul(hs[a:b], wo[k].T, out=e[a:b])
        e = _softmax_less(e, t[:heads] % CLASS_WORDS, scale, wide_o)
        dwo, back = np.zeros_like(wo), np.empty((heads, HIDDEN), np.float32)
        for k, a, b in runs:
            np.matmul(e[a:b], wo[k, :, :HIDDEN], out=back[a:b])
            np.matmul(e[a:b].T, hs[a:b], out=dwo[k])
        dh[:heads] += back
        dwo = dwo.reshape(HEAD, HIDDEN + 1)
        at = np.full(real.size, len(own))
        at[own] = np.arange(len(own))
        d_states = np.ascontiguousarray(dh.take(at, axis=0).reshape(*real.shape, HIDDEN).transpose(0, 2, 1))
        dx, du = gru.back_across(d_states, begin, states, gates, p["u"])
        grads = {"wc": dwc[:HIDDEN], "bc": dwc[HIDDEN], "wo": dwo[:, :HIDDEN], "bo": dwo[:, HIDDEN], "u": du}
        for k, g in grads.items():
            opt.dense(k, np.clip(g, -5, 5))
        opt.rows("emb", row.ravel()[own].astype(np.int16), dx.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN).take(own, axis=0))
        return states[-1].T


def _with_one(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """States of the places `at` with a one behind, which the biases are multiplied by."""
    out = np.ones((len(at), HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = h.take(at, axis=0)
    return out


def _exp_sums(x: np.ndarray, wide: bool) -> np.ndarray:
    """Exponentials in x; returns their sums by row."""
    if wide:
        np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32)


def _log_of(x: np.ndarray, which: np.ndarray, wide: bool) -> np.ndarray:
    """Log of the softmax of each row at one place; works in x."""
    own = x.ravel().take(np.arange(0, x.size, x.shape[1]) + which)
    if wide:
        np.clip(own, -60, 60, out=own)
    return own - np.log(_exp_sums(x, wide))


def _softmax_less(x: np.ndarray, which: np.ndarray, scale: np.float32, wide: bool) -> np.ndarray:
    """`scale` times the softmax of each row less one at one place, in x."""
    x *= (scale / _exp_sums(x, wide))[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + which] -= scale
    return x


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places by class, head words first, and (class, begin, end) of each run of those."""
    order = np.argsort(cls.astype(np.int16), kind="stable")  # sorted by digits
    c = cls[order]
    c = c[: np.searchsorted(c, HEAD // CLASS_WORDS)]
    cuts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))).tolist() if len(c) else []
    return order, [(int(c[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(c)])]


def windows(sizes: np.ndarray, starts: np.ndarray, steps: int = STEPS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, real, first step) of texts in lockstep, longest first: places (steps, texts still going) into the tokens."""
    going = len(sizes)
    for first in range(0, int(sizes[0]) if len(sizes) else 0, steps):
        while sizes[going - 1] <= first:
            going -= 1
        step = first + np.arange(min(steps, int(sizes[0]) - first))[:, None]
        real = step < sizes[:going]
        yield np.where(real, starts[:going] + step, 0), real, first


def inputs(row: np.ndarray, at: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """Rows that the network reads before each place: the token before, or the start."""
    before = row[np.maximum(at - 1, 0)]
    if first == 0:
        before[0] = _START
    return before


def lanes(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, real, new) of texts laid end to end in at most STREAMS lanes of about equal length: places (steps, lanes still
    going) into the tokens, and which lanes are at the first window of a text. No lane is cut, so the longest text sets their
    length, and there are as many as that length needs."""
    parts = -(-sizes // STEPS)
    count = max(1, min(STREAMS, -(-int(parts.sum()) // int(parts.max(initial=1)))))
    rng = np.random.default_rng(len(sizes))
    heap, own = [(0, k) for k in range(count)], [[] for _ in range(count)]
    for i in np.argsort(-parts, kind="stable").tolist():
        length, k = heap[0]
        heapq.heapreplace(heap, (length + int(parts[i]), k))
        own[k].append(i)
    filled = [own[k] for _, k in sorted(heap, reverse=True) if own[k]]
    texts = [rng.permutation(x) for x in filled]
    part = [np.concatenate([np.arange(n) for n in parts[x]]) for x in texts]
    first = [np.repeat(starts[x], parts[x]) + STEPS * k for x, k in zip(texts, part)]
    left = [np.repeat(sizes[x], parts[x]) - STEPS * k for x, k in zip(texts, part)]
    going = len(texts)
    step = np.arange(STEPS)[:, None]
    for t in range(len(part[0]) if part else 0):
        while len(part[going - 1]) <= t:
            going -= 1
        real = step < np.array([x[t] for x in left[:going]])
        yield np.where(real, np.array([x[t] for x in first[:going]]) + step, 0), real, np.array([x[t] for x in part[:going]]) == 0


def train_on(model: Model, lexicon: Lexicon, opt: gru.Adagrad, lists: pa.ListArray | list[list[bytes]]) -> int:
    """Updates from the whole texts of a slice; returns the tokens trained on."""
    got = lexicon.read(lists)
    begin = np.cumsum(got["sizes"]) - got["sizes"]
    h, total = np.zeros((STREAMS, HIDDEN), np.float32), 0
    for at, real, new in lanes(got["sizes"], begin):
        row = got["row"][np.maximum(at - 1, 0)]
        row[0, new] = _START
        h = h[: at.shape[1]]
        h[new] = 0
        h = model.step(opt, row, got["target"][at], got["class"][at], real, h).copy()
        total += int(real.sum())
    return total


def trained(docs: DataFrame, lexicon: Lexicon, rounds: tuple[tuple[int, float], ...] = ROUNDS) -> Model:
    """A model trained where the documents lie; what comes back is one average of the parameters a round."""
    spark = docs.sparkSession
    model = Model(lexicon.heads)
    model.unigram(lexicon)
    words = spark.sparkContext.broadcast(lexicon)  # at most KNOWN tokens
    for share, rate in rounds:
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            own = Model(words.value.heads)
            own.load(start.value.flat())
            opt = gru.Adagrad(own.p, rate)
            for seen in opt.seen.values():
                seen += 0.02  # small first steps: the averaged parameters are kept, not overrun
            weight = 0
            for part in slices(batches, "text", LM_SLICE):
                weight += train_on(own, words.value, opt, token_lists(part.column("text")))
            if weight:
                v = own.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v * weight), pa.array(np.full(len(v), float(weight)))], names=["i", "v", "w"])

        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0) if share > 1 else docs
        mean = some.mapInArrow(run, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("m"))
        got = mean.toPandas()  # one number for each parameter
        if len(got):
            flat = np.empty(len(got), np.float64)
            flat[got["i"].to_numpy()] = got["m"].to_numpy()
            model.load(flat)
    return model


def score_lists(model: Model, lexicon: Lexicon, lists: pa.ListArray | list[list[bytes]]) -> dict:
    """What the known counts and the network say about each text, and the tokens whose counts are yet to be joined."""
    got = lexicon.read(lists)
    sizes = got["sizes"]
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    known = got["code"] >= 0
    count = np.where(known, lexicon.count[got["code"]], 0)
    log = np.log10(count + 1.0)
    tail = got["target"] < 0
    score = np.bincount(doc, np.where(tail, log - lexicon.log_mass[got["tail"]], 0.0), len(sizes))
    order = np.argsort(-sizes, kind="stable")
    starts, h = begin[order], np.zeros((HIDDEN, len(sizes)), np.float32)
    for at, real, first in windows(sizes[order], starts):
        states, _ = gru.run_across(model.p["emb"], inputs(got["row"], at, starts, first), model.p["u"], np.ascontiguousarray(h[:, : at.shape[1]]))
        h = states[-1]
        own = np.flatnonzero(real.ravel())
        place = at.ravel()[own]
        lp = model.log_probs(states.transpose(0, 2, 1).reshape(-1, HIDDEN)[own], got["target"][place], got["class"][place])
        score += np.bincount(doc[place], lp, len(sizes)) / np.log(10)
    base = np.bincount(doc, log, len(sizes)) - sizes * np.log10(lexicon.total + lexicon.distinct + 1.0)
    pair, times = np.unique(doc[got["new"]].astype(np.int64) * max(1, len(got["distinct"])) + got["rest"], return_counts=True)
    owner, word = np.divmod(pair, max(1, len(got["distinct"])))
    rest = (np.bincount(owner, minlength=len(sizes)), got["distinct"].take(pa.array(word)), times)  # unknown tokens of each text, and how often
    return {"n_tokens": sizes, "n_known": np.bincount(doc, count > 0, len(sizes)).astype(np.int64), "base": base, "score": score, "rest": rest}


def _scored(docs: DataFrame, model: Model, lexicon: Lexicon) -> DataFrame:
    spark = docs.sparkSession
    both = spark.sparkContext.broadcast((model, lexicon))
    entry = pa.struct([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", LM_SLICE):
            got = score_lists(*both.value, token_lists(part.column("text")))
            n = part.num_rows
            each, word, times = got["rest"]
            lengths = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(lengths), pa.StructArray.from_arrays([word.cast(pa.string()), pa.array(times, pa.int64())], fields=list(entry)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + n)), part.column("doc_id"), *(pa.array(got[k]) for k in ("n_tokens", "n_known", "base", "score")), rest],
                names=["number", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
            )
            number += n

    return docs.mapInArrow(run, "number long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<token:string,n:long>>")


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[tuple[int, float], ...] = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark, folder = docs.sparkSession, new_run_dir(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    train = rows.where(~held_out())
    counts = as_table(token_counts(train), folder, "counts")
    lexicon = Lexicon(counts)
    model = trained(train, lexicon, rounds)
    scored = as_table(_scored(rows, model, lexicon), folder, "scored")
    rest = scored.select("number", F.explode("rest").alias("r")).select("number", "r.token", "r.n")
    found = rest.join(counts, "token").groupBy("number").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"))
    joined = scored.drop("rest").join(found, "number", "left")
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return joined.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )


def op8_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op8_gru_language_model": op8_gru_language_model}
ORACLES: dict[str, str] = {}
