"""SimHash near-duplicates through BK-trees (operator 10).

A fingerprint is the bitwise majority of the XXH64 hashes of a text's shingles. Two fingerprints that differ in at most
three bits agree on at least two of five bit blocks, so each fingerprint goes to ten shards, one for each pair of blocks
and their value. In a shard a BK-tree (children keyed by their integer Hamming distance to the parent) answers the
radius query; only edges whose key lies within the radius of the query's distance are followed. The trees of all
documents have no size bound, so they are built where their shard lies instead of being broadcast; a shard of more than
`tree_size` fingerprints is split into trees of that size, and every pair of its parts is its own group, so no task
holds more than two trees however large a shard is. A shard emits a spanning set of links, never all pairs.

Defined results: a null or blank text has no words and fingerprint zero, linked like any other; repeated rows and ids
give one output row each; a null doc_id never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import boxed, id_and_text, map_text, staged, table, tokens, unboxed

SEED = 42
#: Bit blocks (first bit, width) of a fingerprint; three differing bits leave two of five untouched.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3
#: Most fingerprints in one tree.
TREE_SIZE = 2048


def shingle_hashes(raw: bytes, size: int = 3) -> list[int]:
    """XXH64 of every run of `size` words, repeats included; of the whole sequence if there are fewer; none without words."""
    w = tokens(raw)
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from all hashes laid end to end, `counts` of them per text; zero for a text without any.

    Eight bits are counted at once in the bytes of a word; a run of at most 255 hashes cannot overflow a byte.
    """
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    n = counts[own]
    first = np.cumsum(n) - n
    runs = (n + 254) // 255
    run_first = np.cumsum(runs) - runs
    starts = np.repeat(first - 255 * run_first, runs) + 255 * np.arange(runs.sum())
    lanes = np.uint64(0x0101010101010101)
    result = np.zeros(len(own), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, starts)
        per_text = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for byte in range(8):
            result |= (2 * per_text[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[own] = result
    return out


def fingerprint_slice(texts: list[bytes], size: int = 3) -> dict:
    lists = [shingle_hashes(t, size) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
    return {"fp": majority(flat, counts).view(np.int64)}


class Tree:
    """BK-tree over 64-bit integers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            kids = self.children[at]
            if kids:
                for key in range(max(1, d - radius), d + radius + 1):
                    nxt = kids.get(key)
                    if nxt is not None:
                        todo.append(nxt)
        return found


def spanning_links(members: list[int], parts: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest member of its local component) among the members of a shard.

    With `parts`, only links between the smaller and the larger part number are looked for.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = Tree()
    if parts is None:
        for value in members:
            for other in tree.within(value, radius):
                a, b = root(value), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            tree.add(value)
    else:
        low = min(parts)
        for value, part in zip(members, parts):
            if part == low:
                tree.add(value)
        for value, part in zip(members, parts):
            if part != low:
                for other in tree.within(value, radius):
                    a, b = root(value), root(other)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def _shard_links(radius: int):
    """Streams rows sorted by shard; a shard of one fingerprint costs nothing."""
    names = ["shard", "key", "low", "high"]

    def links(cols: dict[str, np.ndarray], cuts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for s, e in zip(cuts.tolist(), ends.tolist()):
            fps = (cols["fp"][s:e].view(np.uint64)).tolist()
            split = cols["low"][s] != cols["high"][s]
            found += spanning_links(fps, cols["part"][s:e].tolist() if split else None, radius)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None

        def emit(cols: dict[str, np.ndarray], last: bool):
            n = len(cols["fp"])
            new = np.zeros(n, bool)
            new[0] = True
            for c in names:
                new[1:] |= cols[c][1:] != cols[c][:-1]
            cuts = np.flatnonzero(new)
            ends = np.append(cuts[1:], n)
            if not last:
                rest = {c: v[cuts[-1] :] for c, v in cols.items()}
                cuts, ends = cuts[:-1], ends[:-1]
            many = ends - cuts > 1
            pairs = links(cols, cuts[many], ends[many])
            return (None if last else rest), pairs

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "part", "fp"]}
            if kept is not None:
                cols = {c: np.concatenate((kept[c], cols[c])) for c in cols}
            kept, pairs = emit(cols, False)
            if pairs:
                yield batch_of(pairs)
        if kept is not None:
            _, pairs = emit(kept, True)
            if pairs:
                yield batch_of(pairs)

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints `fp` at most `radius` (3 or less) bits apart."""
    if radius > 3:
        raise ValueError("two of five blocks agree only up to three differing bits")
    masks = []
    for x, y in combinations(BLOCKS, 2):
        mask = sum(((1 << w) - 1) << b for b, w in (x, y))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(shards).alias("s")).select("fp", "s.shard", "s.key")
    sizes = rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(tree_size)).cast("int")
    rows = rows.join(sizes, ["shard", "key"]).withColumn("part", F.pmod(F.hash("fp", F.lit(7)), parts))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = rows.select("shard", "key", "fp", "part", other.alias("o"))
    rows = rows.select("shard", "key", F.least("part", "o").alias("low"), F.greatest("part", "o").alias("high"), "part", "fp")
    keys = ["shard", "key", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_shard_links(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: repeated big-star and small-star steps until the links no longer change.

    Each step is an aggregation and a join on the node, so a node with many links is pre-aggregated and its join can be
    split; the links are checkpointed between rounds. Every round brings nodes nearer to the smallest of their component,
    so the rounds end by themselves, after about the logarithm of the longest chain.
    """

    def stars(edges: DataFrame, both: bool) -> DataFrame:
        # big star: every larger neighbour is hung on the smallest node around; small star: the smaller ones are
        pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = pairs.join(least, "a")
        if both:
            return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = least.select("a", F.col("m").alias("b"))
        return hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()

    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        edges = staged(stars(stars(edges, True), False))


def near_duplicates(rows: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of rows (doc_id, fp): root names the component by its
    fingerprint, component_id by its smallest doc_id."""
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(prints, radius, tree_size))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    rows = staged(map_text(id_and_text(docs, id_col, text_col), lambda texts: fingerprint_slice(texts, shingle), "fp long"))
    found = near_duplicates(rows, radius, tree_size)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays (rows with an id before rows
    without; of several such rows any one)."""
    names = docs.columns
    marked = map_text(boxed(docs, text_col).withColumn("doc_id", F.col("row").getField(id_col).cast("long")), lambda texts: fingerprint_slice(texts, shingle), "fp long")
    slim = staged(marked.select("doc_id", "fp"))
    found = near_duplicates(slim, radius)
    best = marked.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return unboxed(best.groupBy("root").agg(F.first("row").alias("row")), names)


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_bktree": op10_simhash_bktree}
ORACLES: dict[str, str] = {}
