"""Benchmark decontamination by training suffix arrays (operator 3).

The words of a slice of documents form a shard; its suffix array is binary-searched for every suffix of the benchmark
items: the range of suffixes that start with a window gives all its verbatim places, and the place of a whole suffix inside
that range is where its longest match stands. The longest match at a place of a document is shared with the test suffix next
below or next above it, so the same search gives each document's longest match and its first word. Words that no item of the block holds are one number that matches nothing, and a suffix that
meets such a word before the shortest window ends is left out of the array: it can start no match. The array is sorted as
deep as the longest item.

The benchmark is the query set. It is read in blocks of at most `block_bytes` (or one item), each block is broadcast and
passes over all documents; blocks are chained in one scan, and nothing is shuffled.

Defined results: a null text has no words and is never hit; an item without words matches nothing; repeated item ids count
once; an item whose id is null hits words but is not listed; repeated documents are judged row by row; empty tables give
empty results, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import boxed, id_and_text, map_text, table, unboxed, words

WINDOW = 10
BLOCK_BYTES = 8 << 20


class Block:
    """A block of items: words as numbers from 1, distinct windows, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        lists = [words(raw) for _, raw in items]
        self.names = [name for name, _ in items]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
        flat, seen, item, first, left = [], {}, 0, [], []
        self.places: list[tuple[int, int]] = []  # (item, start) of each distinct suffix
        self.window_items: list[list[int]] = []
        self.length: list[int] = []
        for item, ws in enumerate(lists):
            size = min(window, len(ws))
            base = len(flat)
            numbers = [self.vocab[w] for w in ws]
            flat += numbers + [-1]
            for at in range(len(ws) - size + 1 if ws else 0):
                key = tuple(numbers[at : at + size])
                k = seen.get(key)
                if k is None:
                    k = seen[key] = len(first)
                    first.append(base + at)
                    self.length.append(size)
                    self.window_items.append([])
                if not self.window_items[k] or self.window_items[k][-1] != item:
                    self.window_items[k].append(item)
                self.places.append((item, at))
                left.append((k, base + at, len(ws) - at))
        self.words = np.array(flat or [-1], np.int32)
        self.first = np.array(first, np.int64)
        self.size = np.array(self.length, np.int64)
        self.suffixes = np.array(left, np.int64).reshape(-1, 3)  # window, start, words to the item's end
        self.depth = int(self.suffixes[:, 2].max()) if len(left) else 0
        self.shortest = int(self.size.min()) if len(first) else 0
        self.window = window
        row = np.full(len(self.words) + 1, -1)
        row[self.suffixes[:, 1]] = np.arange(len(left))
        order = row[Shard(lists, self).array]  # the items laid end to end as a shard of their own have the same positions
        self.sorted = self.suffixes[order[order >= 0]]


class Shard:
    """Words of several documents as one array, and its suffix array to a block's depth."""

    def __init__(self, lists: list[list[bytes]], block: Block) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate(([0], np.cumsum(counts + 1)))[: len(lists)]  # a gap after each document
        total = int((counts + 1).sum())
        self.words = np.zeros(total + block.depth + 3, np.int32)
        at = np.ones(total, bool)
        at[self.starts + counts] = False
        flat = np.fromiter(map(block.vocab.get, chain.from_iterable(lists), repeat(0)), np.int32, int(counts.sum()))
        self.words[:total][at] = flat
        self.array = self._suffixes(total, block)

    def _suffixes(self, total: int, block: Block) -> np.ndarray:
        if not block.shortest:
            return np.zeros(0, np.int64)
        known = self.words[: total + 1] > 0
        gaps = np.flatnonzero(~known)  # the last word is a gap, so every position has a next gap
        at = np.flatnonzero(known)
        if not len(at):
            return at
        at = at[gaps[np.searchsorted(gaps, at)] - at >= block.shortest]
        group = np.zeros(len(at), np.int64)
        order, tied = np.arange(len(at)), np.arange(len(at))
        for d in range(0, block.depth, 2):  # two words a step; only suffixes that still tie are looked at again
            if len(tied) < 2:
                break
            pos = at[order[tied]]
            key = (self.words[pos + d].astype(np.int64) << 32) | self.words[pos + d + 1]
            by = np.lexsort((key, group[tied]))
            order[tied] = order[tied][by]
            g, key = group[tied], key[by]  # groups are laid end to end, so sorting leaves their places as they are
            new = np.ones(len(tied), bool)
            new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            group[tied] = tied[heads][np.cumsum(new) - 1]
            size = np.diff(np.append(heads, len(tied)))
            tied = tied[np.repeat(size > 1, size)]
        return at[order]

    def compare(self, at: np.ndarray, test: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of suffixes of this shard against the first `size` words of test suffixes, and words they share."""
        sign, shared, live, d = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64), np.arange(len(at)), 0
        live = live[size > 0]
        while len(live):
            a, b = self.words[at[live] + d], test[start[live] + d]
            differ = a != b
            sign[live[differ]] = np.where(a[differ] < b[differ], -1, 1)
            live = live[~differ]
            d += 1
            shared[live] = d
            live = live[size[live] > d]
        return sign, shared

    def bound(self, test: np.ndarray, start: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search in array[lo:hi] for the first suffix not below (upper: above) each prefix."""
        lo, hi = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            sign, _ = self.compare(self.array[mid], test, start[live], size[live])
            right = sign <= 0 if upper else sign < 0
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo

    def ranges(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        zero, end = np.zeros(len(block.first), np.int64), np.full(len(block.first), len(self.array))
        lo = self.bound(block.words, block.first, block.size, zero, end, False)
        return lo, self.bound(block.words, block.first, block.size, lo, end, True)

    def longest(self, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, start, words, document, word) of the longest match of each test suffix whose window occurs."""
        lo, hi = self.ranges(block)
        which, start, size = block.suffixes.T
        own = np.flatnonzero(hi[which] > lo[which])
        lo, hi, start, size = lo[which[own]], hi[which[own]], start[own], size[own]
        at = self.bound(block.words, start, size, lo, hi, False)
        best, place = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= lo) & (near < hi))
            _, shared = self.compare(self.array[near[ok]], block.words, start[ok], size[ok])
            better = shared > best[ok]
            best[ok[better]], place[ok[better]] = shared[better], self.array[near[ok]][better]
        doc = np.searchsorted(self.starts, place, "right") - 1
        for k, n, d, p in zip(own.tolist(), best.tolist(), doc.tolist(), (place - self.starts[doc]).tolist()):
            yield (*block.places[k], n, d, p)

    def reach(self, block: Block, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that the suffix at each place of the array shares with some test suffix, at most: with its neighbours among
        them in sorted order."""
        which, start, size = block.sorted.T
        at = self.bound(block.words, start, size, lo[which], hi[which], False)
        best, after = np.zeros(len(place), np.int64), np.searchsorted(at, place, "right")
        for near in (after - 1, after):
            ok = np.flatnonzero((near >= 0) & (near < len(at)))
            _, shared = self.compare(self.array[place[ok]], block.words, start[near[ok]], size[near[ok]])
            best[ok] = np.maximum(best[ok], shared)
        return best

    def hits(self, block: Block) -> tuple[list[list[dict]], list[list[str]], list[dict | None]]:
        """Hit word ranges, listed items and longest match (words, first word) of each document."""
        n = len(self.starts)
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        longest: list[dict | None] = [None] * n
        lo, hi = self.ranges(block)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return spans, items, longest
        many = (hi - lo)[found]
        window = np.repeat(found, many)
        begin = np.repeat(lo[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = self.array[begin]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.size[window], -1)
        covered = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0]))
        change = np.diff(covered)
        s, e = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        doc = np.searchsorted(self.starts, s, "right") - 1
        for d, x, y in zip(doc.tolist(), (s - self.starts[doc]).tolist(), (e - self.starts[doc]).tolist()):
            spans[d].append({"start": x, "end": y})
        listed: dict[int, set[str]] = {}
        pairs = np.unique(np.stack((np.searchsorted(self.starts, at, "right") - 1, window)), axis=1)
        for d, w in pairs.T.tolist():
            listed.setdefault(d, set()).update(block.names[i] for i in block.window_items[w] if block.names[i] is not None)
        for d, names in listed.items():
            items[d] = sorted(names)
        size = self.reach(block, lo, hi, begin)
        size = np.where(size >= block.window, size, block.size[window])  # below a full window only whole items count
        doc = np.searchsorted(self.starts, at, "right") - 1
        best = np.lexsort((at, -size, doc))
        for k in best[np.flatnonzero(np.diff(doc[best], prepend=-1))].tolist():
            longest[doc[k]] = {"words": int(size[k]), "back": int(self.starts[doc[k]] - at[k])}
        return spans, items, longest


def blocks_of(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark in broadcast blocks; their number follows its measured size."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("raw")).where(F.col("raw").isNotNull())
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("raw"), F.lit(n)) == k).collect()
        yield spark.sparkContext.broadcast(Block(sorted(((r["item"], bytes(r["raw"])) for r in part), key=str), window))


def _pass(block: Broadcast, k: int):
    def run(texts: list[bytes]) -> dict:
        lists = [words(t) for t in texts]
        spans, items, longest = Shard(lists, block.value).hits(block.value)
        return {f"n{k}": [len(w) for w in lists], f"s{k}": spans, f"i{k}": items, f"l{k}": longest}

    return run


def contamination(rows: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """rows (text, ...) with n_words, spans, n_hit, items, longest, longest_at added and the text kept.

    longest is the number of words of the longest verbatim match that holds a window, longest_at its first word (of equal
    ones the first in the document); both null where nothing is hit.
    """
    names, n = rows.columns, 0
    for n, block in enumerate(blocks_of(benchmark, **how), 1):
        rows = map_text(rows, _pass(block, n), f"n{n} long, s{n} array<struct<start:int,end:int>>, i{n} array<string>, l{n} struct<words:long,back:long>", keep_text=True)
    spans = F.array_sort(F.concat(*[F.col(f"s{k}") for k in range(1, n + 1)]))
    state = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        new = F.greatest(F.lit(0), x["end"] - F.greatest(acc["until"], x["start"]))
        return F.struct(F.greatest(acc["until"], x["end"]).alias("until"), (acc["n"] + new).alias("n"))

    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"i{k}") for k in range(1, n + 1)])))
    longest = F.array_max(F.array(*[F.col(f"l{k}") for k in range(1, n + 1)]))  # back counts from the place to the start: larger is earlier
    return rows.select(
        *names, F.col("n1").alias("n_words"), spans.alias("spans"), F.aggregate(spans, state, step)["n"].alias("n_hit"), items.alias("items"),
        longest["words"].alias("longest"), (-longest["back"]).alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that hold a benchmark window."""
    found = contamination(boxed(docs, text_col), benchmark, **how)
    return unboxed(found.where(F.col("n_hit") == 0), docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(item_id, start, length, doc_id, word): the longest verbatim match of every benchmark suffix whose window occurs."""
    out = None
    rows = id_and_text(docs, id_col, text_col)
    for block in blocks_of(benchmark, **how):
        found = rows.mapInArrow(_longest(block), "item_id string, start int, length int, doc_id long, word int")
        out = found if out is None else out.union(found)
    best = F.max_by(F.struct("length", "doc_id", "word"), F.struct("length", -F.col("doc_id"), -F.col("word"))).alias("b")
    return out.groupBy("item_id", "start").agg(best).select("item_id", "start", "b.*")


def _longest(block: Broadcast):
    def run(batches):
        import pyarrow as pa

        from concord.llm.common import slices

        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            ids = part.column("doc_id").to_pylist()
            b = block.value
            found = [(b.names[i], s, n, ids[d], p) for i, s, n, d, p in Shard([words(t) for t in texts], b).longest(b)]
            cols = list(zip(*found)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item_id", "start", "length", "doc_id", "word"])

    return run


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(id_and_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest", "longest_at",
    )


QUERIES = {"op3_suffix_decontamination": op3_suffix_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op3_suffix_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS t, item_id, {_WORDS} AS w FROM benchmark),
lens AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT t, item_id, n, p AS q, array_to_string(w[p + 1 : p + n], ' ') AS x
       FROM (SELECT t, item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, p, array_to_string(w[p + 1 : p + n], ' ') AS x
       FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, t, item_id, p, q, n FROM dw JOIN bw USING (n, x)),
runs AS (SELECT r, min(p) AS first_word, count(*) + min(n) - 1 AS size
         FROM (SELECT *, p - row_number() OVER (PARTITION BY r, t, p - q ORDER BY p) AS g FROM m) GROUP BY r, t, p - q, g),
best AS (SELECT r, max(size) AS longest, arg_min(first_word, {{'a': -size, 'b': first_word}}) AS longest_at FROM runs GROUP BY r),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       longest, longest_at
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN best USING (r)"""
}
