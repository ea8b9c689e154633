"""Product-quantised vector codes found through an integer Walsh-Hadamard transform (operator 11).

A vector's components become integers floor(4096 x) and are cut into equal consecutive parts; every part position has a
codebook of integer entries. Parts and entries are padded with zeros to a power of two P and transformed with the +1/-1
matrix of that order, its rows sorted by sequency (number of sign changes). The transform keeps squared distances up to
the factor P, so the squared differences of the coefficients, summed in sequency order, are a growing lower bound of P
times the distance; an entry leaves as soon as its sum exceeds the whole sum of the entry that led after the first
coefficients. All of it is integer arithmetic, so the nearest entry, ties and the errors are exact.

Codebooks are a few kilobytes (16 entries of a vector's length) and travel in the closure; each round sums parts in the
tasks, then in Spark, and only one row per part, entry and position comes to the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; vectors shorter than the
longest, or than a multiple of the number of parts, count as filled with zeros; integers beyond 2^26 in size
(components beyond 16,384) are held at that bound, so that all sums stay exact in 64 bits; repeated rows and ids count
and are coded one by one (the seeds order equal ids by their vectors, a null id comes last); fewer than 16 kept rows give
as many entries; a null label is a label of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import staged, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Largest size of an integer component: P * part length * (2 * BOUND)^2 fits 64 bits for parts of up to 22 components;
#: longer parts go through Python's integers.
BOUND = 1 << 26
#: Coefficients that are summed for every entry before any can leave.
FIRST = 2
#: Vectors that a Python function works on at once.
BATCH_ROWS = 4096


def sequency_matrix(order: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by growing number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < order:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Coefficients in sequency order of the rows, padded with zeros to a power of two."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    padded = np.zeros((len(rows), size), rows.dtype)
    padded[:, : rows.shape[1]] = rows
    return padded @ sequency_matrix(size).astype(rows.dtype).T


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, exact squared distance) of each row; ties go to the lower index."""
    if 8 * rows.shape[1] ** 2 * BOUND**2 >= 1 << 63:
        rows, entries = rows.astype(object), entries.astype(object)
    x, c = transformed(rows), transformed(entries)
    order = x.shape[1]
    n, at = len(x), np.arange(len(x))
    head = min(FIRST, order)
    sums = np.zeros((n, len(c)), x.dtype)
    for k in range(head):
        sums += (x[:, k, None] - c[None, :, k]) ** 2
    lead = sums.argmin(axis=1)
    limit = sums[at, lead] + ((x[:, head:] - c[lead, head:]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= limit[:, None])
    total = sums[row, entry]
    for k in range(head, order):
        total = total + (x[row, k] - c[entry, k]) ** 2
        stay = total <= limit[row]
        row, entry, total = row[stay], entry[stay], total[stay]
    # what is left of a row has its whole sum: rows ascend, and of each the least sum with the least index counts
    rank = np.lexsort((entry, total.astype(np.int64) if total.dtype != object else total, row))
    first = rank[np.searchsorted(row[rank], at)]
    return entry[first], (total[first] // order).astype(np.int64)


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers kept, their integer vectors) of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # nulls arrive as NaN
    owner = np.repeat(np.arange(len(column)), lengths)
    keep = np.asarray(column.is_valid())
    keep &= np.bincount(owner[bad], minlength=len(column)) == 0
    good = keep[owner]
    position = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows = np.flatnonzero(keep)
    out = np.zeros((len(rows), dim), np.int64)
    scaled = np.clip(np.floor(values[good] * SCALE), -BOUND, BOUND)
    out[np.searchsorted(rows, owner[good]), position[good]] = scaled.astype(np.int64)
    return rows, out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _sums(books: np.ndarray):
    """Rows (part, entry, position, total, members): what the parts of a partition add to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.shape, np.int64)
        members = np.zeros((parts, entries), np.int64)
        for batch in _cut(batches):
            _, ints = integers(batch.column("v"), parts * width)
            for p in range(parts):
                own = ints[:, p * width : (p + 1) * width]
                if len(own):
                    code, _ = nearest(own, books[p])
                    np.add.at(total[p], code, own)
                    members[p] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(members)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(members[part, entry], width))],
                names=["part", "entry", "position", "total", "members"],
            )

    return run


def _codes(books: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            rows, ints = integers(batch.column("v"), parts * width)
            code, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for p in range(parts):
                if len(rows):
                    code[:, p], e = nearest(ints[:, p * width : (p + 1) * width], books[p])
                    error += e
            kept = batch.take(pa.array(rows))
            text = ["".join(f"{x:02x}" for x in own) for own in code.tolist()]
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array(text, pa.string()), pa.array(error)], names=[*names, "code", "error"])

    return run


def learn_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integer codebooks [part, entry, position] of rows (id, v), after `rounds` rounds of assigning and averaging."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(usable)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.zeros((len(seeds), parts * width), np.int64)
    if seeds:
        _, start = integers(pa.array([[float(x) for x in r["v"]] for r in seeds], pa.list_(pa.float64())), parts * width)
    books = start.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if books.size else 0):
        added = vectors.select("v").mapInArrow(_sums(books), "part long, entry long, position long, total long, members long")
        for r in added.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["members"]
    return books


def coded_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, the columns `keep`, code, error, codebooks_sha256) of every kept row."""
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    books = learn_codebooks(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = embeddings.select(F.col(id_col).alias("id"), F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), F.col(vector_col).alias("v"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, kept {rows.schema['kept'].dataType.simpleString()}, code string, error long"
    coded = rows.mapInArrow(_codes(books, ["id", "kept"]), fields)
    return coded.select("id", *[F.col("kept").getField(c).alias(c) for c in keep], "code", "error", F.lit(digest).alias("codebooks_sha256"))


def op11_walsh_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = staged(coded_vectors(table(spark, sf_dir, "embeddings"), keep=("label",)))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """The same rounds spelled out: one assignment and one update per round over (vector, part, position) rows."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, embedding, len(embedding) // 8 AS width FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """cells AS MATERIALIZED (SELECT r, vec_id, label, i // width AS part, i % width AS pos, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 4096) AS BIGINT) AS x
        FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept))""",
        "book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS y FROM cells WHERE r <= 16)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM
            (SELECT c.r, c.part, b.entry, sum((c.x - b.y) * (c.x - b.y)) AS d FROM cells c JOIN book{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CAST(coalesce((s - ((s % m) + m) % m) // m, b.y) AS BIGINT) AS y FROM book{k} b LEFT JOIN
                (SELECT c.part, n.entry, c.pos, CAST(sum(c.x) AS BIGINT) AS s, count(*) AS m FROM cells c JOIN near{k} n ON n.r = c.r AND n.part = c.part GROUP BY ALL) u
                ON u.part = b.part AND u.entry = b.entry AND u.pos = b.pos)"""
            )
    last = f"near{ROUNDS}"
    return f"""WITH {", ".join(steps)},
    coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM {last} n JOIN kept k ON k.r = n.r GROUP BY k.r, k.vec_id, k.label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""


QUERIES = {"op11_walsh_hadamard_codes": op11_walsh_hadamard_codes}
ORACLES = {"op11_walsh_hadamard_codes": _oracle()}
