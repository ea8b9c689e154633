"""Near copies by SimHash and BK-trees with an exact similarity test (the pipeline's use of operator 10).

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8; a group is
what such links connect, and one document of it stays. Texts of equal sets are one node before anything is compared.

Candidates: at similarity 0.8 two 64-bit fingerprints differ in about ten bits (three more or less), so the radius is 20,
which leaves out hardly a pair (unlike texts differ in 32, four more or less). That is too wide for shards by bit blocks; instead a fingerprint goes to
`BANDS` shards, each named by the smallest shingles under two orders of the hashes, which two texts of similarity s share
with a chance of s * s: one of six is shared by 99.8 % of the pairs at 0.8. In each shard a BK-tree answers the radius
query. What the shards link loosely is a group of candidates; its shingle sets move once, and the test inside is exact:
every pair of a group within the radius is tested, but for pairs that are connected already. Shards and groups above a
size are split into parts, and every pair of parts is a unit of its own, so a task holds two parts however large a group.

Defined results: a null or blank text has the empty set, so such texts are copies of each other; a text of fewer words
than a shingle has its whole sequence as its only one; of a group the row with the smallest id stays, rows with an id
before rows without, of several rows with that id and the same set any one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import boxed, map_text, staged, unboxed
from concord.llm.simhash_tree import TREE_SIZE, Tree, _shard_links, components, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BANDS = 6
#: Shingle hashes of one part of a group of candidates (8 bytes each); a single longer text is a part with others.
PART_HASHES = 4 << 20


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(np.array(shingle_hashes(raw, size), np.uint64))


def digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes))


def _orders(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    factors = rng.integers(0, 1 << 63, 2 * bands, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, 2 * bands, np.uint64)


def sketch_slice(texts: list[bytes], size: int = SHINGLE, bands: int = BANDS) -> dict:
    """Fingerprint, set digest, set size and shard key of each band for a slice of texts."""
    sets = [shingle_set(t, size) for t in texts]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys = np.zeros((len(sets), bands), np.uint64)
    own = np.flatnonzero(counts)
    if len(own):
        starts = (np.cumsum(counts) - counts)[own]
        factors, shifts = _orders(bands)
        for b in range(bands):
            first, second = (np.minimum.reduceat(flat * factors[k] + shifts[k], starts) for k in (2 * b, 2 * b + 1))
            keys[own, b] = (first ^ (first >> np.uint64(29))) * factors[b] + second
    return {
        "fp": majority(flat, counts).view(np.int64),
        "node": np.array([digest(s) for s in sets], np.uint64).view(np.int64),
        "n": counts,
        "keys": list(keys.view(np.int64)),
    }


def _by_parts(rows: DataFrame, keys: list[str], parts, spread: str) -> DataFrame:
    """rows once for each unit (low, high) of two parts of their group; `parts` counts the parts of the row's group."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.hash(spread, F.lit(7)), F.col("parts")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = [c for c in rows.columns if c not in ("parts", "part", "o", *keys)]
    return rows.select(*keys, F.least("part", "o").alias("low"), F.greatest("part", "o").alias("high"), "part", *kept)


def loose_links(reps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links that span what fingerprints within the radius connect inside the shards of reps (fp, keys)."""
    rows = reps.select("fp", F.posexplode("keys").alias("shard", "key")).distinct()
    sizes = rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
    keys = ["shard", "key"]
    rows = _by_parts(rows.join(sizes, keys), keys, F.ceil(F.col("many") / F.lit(tree_size)), "fp").select(*keys, "low", "high", "part", "fp")
    units = [*keys, "low", "high"]
    return rows.repartition(*units).sortWithinPartitions(*units).mapInArrow(_shard_links(radius), "a long, b long")


def similar_links(fps: list[int], sets: list[np.ndarray], parts: list[int], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links (places of members) that span the groups of sets with at least `similarity`, of one part or between two."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, held, links = Tree(), {}, []
    split = len(set(parts)) > 1
    for i in sorted(range(len(fps)), key=lambda i: parts[i]):
        if not split or parts[i] != parts[0]:
            for value in tree.within(fps[i], radius):
                for j in held[value]:
                    if root(i) == root(j):
                        continue
                    small, large = sorted((len(sets[i]), len(sets[j])))
                    if small < similarity * large - 1e-9:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (small + large - both) - 1e-9:
                        parent[root(i)] = root(j)
                        links.append((i, j))
        if not split or parts[i] == parts[0]:
            tree.add(fps[i])
            held.setdefault(fps[i], []).append(i)
    return links


def _exact(similarity: float, radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        if group["low"].iloc[0] != group["high"].iloc[0] and group["part"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
        fps = group["fp"].to_numpy(np.int64).view(np.uint64).tolist()
        nodes = group["node"].to_numpy(np.int64)
        links = similar_links(fps, sets, group["part"].tolist(), similarity, radius)
        return pd.DataFrame({"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]}, dtype="int64")

    return run


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    radius: int = RADIUS, bands: int = BANDS, tree_size: int = TREE_SIZE, part_hashes: int = PART_HASHES,
) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (doc_id, node) of every row of docs, and (node, loose, root) of every distinct shingle set.

    Two sets are near copies, by links, if `loose` and `root` are equal.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = staged(map_text(base, lambda texts: sketch_slice(texts, shingle, bands), "fp long, node long, n long, keys array<long>"))
    reps = staged(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("doc_id"),
                                           F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    loose = components(loose_links(reps, radius, tree_size))
    named = reps.join(loose, reps["fp"] == loose["node"], "left").select(reps["node"], "doc_id", "fp", "n", F.coalesce("root", "fp").alias("loose"))
    named = staged(named)
    sizes = named.groupBy("loose").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("hashes")).where(F.col("many") > 1)
    parts = F.greatest(F.ceil(F.col("many") / F.lit(tree_size)), F.ceil(F.col("hashes") / F.lit(part_hashes)), F.lit(1))
    members = named.join(sizes, "loose").select("node", "doc_id", "fp", "loose", parts.alias("parts"))
    # only texts with candidates are read again for their sets; equal ids of other sets drop out with the second join
    texts = base.join(members.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def sets_of(texts: list[bytes]) -> dict:
        sets = [shingle_set(t, shingle) for t in texts]
        return {"node": np.array([digest(s) for s in sets], np.uint64).view(np.int64), "hashes": [s.tobytes() for s in sets]}

    sets = map_text(texts.select("text"), sets_of, "node long, hashes binary").dropDuplicates(["node"])
    units = _by_parts(members.drop("doc_id"), ["loose"], F.col("parts"), "node").join(sets, "node")
    exact = units.groupBy("loose", "low", "high").applyInPandas(_exact(similarity, radius), "a long, b long")
    roots = components(exact).withColumnRenamed("node", "_node")
    groups = named.join(roots, named["node"] == roots["_node"], "left").select("node", "loose", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "node"), groups


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near copies; the choice is made on ids and digests, so a text moves only to be kept."""
    names = docs.columns
    shingle = how.get("shingle", SHINGLE)
    rows, groups = similar_groups(docs, id_col=id_col, text_col=text_col, **how)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    # copies of one set are pre-aggregated before the join, so a set of many rows is one row there
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("w")).select("node", "w.doc_id")
    best = first.join(groups, "node").groupBy("loose", "root").agg(least.alias("w")).select("w.doc_id", "w.node")
    times = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    best = best.join(times.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").alias("_id"), "node", "times")
    best = staged(best)
    full = boxed(docs, text_col).withColumn("doc_id", F.col("row").getField(id_col).cast("long"))
    alone = full.join(best.where("times = 1").select("_id"), F.col("doc_id") == F.col("_id"), "left_semi").select("row")
    # an id of several rows names no single row: these rows are told apart by their sets
    several = full.join(best.where("times > 1").select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    several = map_text(several, lambda texts: {"set": np.array([digest(shingle_set(t, shingle)) for t in texts], np.uint64).view(np.int64)}, "set long")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("set") == F.col("node"))
    several = several.join(best.where("times > 1"), match).groupBy("doc_id", "set").agg(F.first("row").alias("row")).select("row")
    return unboxed(alone.unionByName(several), names)
