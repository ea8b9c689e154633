"""Spelling variants: words one edit apart, found through pivotal grams (operator 12).

Bigrams are ranked by the number of words that hold them, rare ones first. A word's gram prefix is its 3 rarest bigrams
(2 * 1 + 1 for one edit), with all that tie with the last of them; its pivots are two disjoint bigrams of that prefix,
chosen by dynamic programming for the least total rank. One edit spoils at most one of two disjoint bigrams. So of
two near words that with the lower last rank (either, if equal) has a pivot that stands in the other's gram prefix, at
the same place or one beside it.

The pivots a < b (their places) cut a word into three stretches, and the edit lies in one of them:
  after b     everything up to the end of bigram b is the same in both words, and b is the pivot that is kept;
  between     everything up to the end of bigram a and from the end of bigram b is the same, a is kept;
  up to a     everything from the end of bigram a is the same, b is kept.
An index key is such a case with the text that has to be the same and the length of the stretch: the indexed word gives
its stretch with one character more, as many, and one less (the position limit); the other word gives the keys for each
bigram of its prefix taken as the kept pivot. An equi-join on the keys' hashes yields the candidates, which are verified
by the exact edit distance.

Runs beyond 48 letters are no words of a language and may be as long as a text; there the bigrams repeat and their keys
would grow with the square of the length. They are cut into two halves instead, one of which the edit leaves as it is.

The ranks are at most 90 * 90 numbers, as words are spelled with 90 letters. Words are counted in the tasks before the
shuffle. Copies of a text move counts only.

Defined results: a null text has no words; a null id counts as empty in `<id>:<word>`; repeated rows count again; the
empty result of an emptied run is no word; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import slices, staged, table

RUN = re.compile("[a-zÀ-ÿ]+")
#: A run of a document loses a character if its hash is divisible by this.
SPOIL_EVERY = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as the word.
FORM_TIMES = 5
PREFIX = 3
#: Words of up to one letter more are found by pivots, words from this length on by halves.
LONG = 48
#: Words that a task counts before it passes its counts on; bounds memory, not results.
HELD_WORDS = 400_000
KEY_ROWS = 20_000


def spoilt(doc_id: object, raw: bytes, least: int = LEAST_LETTERS) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a UTF-8 text, after the deletions; words of at least `least` letters."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in Counter(RUN.findall(raw.lower().decode())).items():
        if len(word) >= least:
            h = zlib.crc32(word.encode(), start)
            if h % SPOIL_EVERY == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
            yield word, n


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches, "text"):
            for doc_id, raw in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for word, n in spoilt(doc_id, raw):
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
        if held:
            yield out()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram by the number of words that hold it, rarest first; at most 90 * 90 of them."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") <= LONG + 1).select(F.explode(F.array_distinct(F.transform(places, lambda i: F.col("word").substr(i, F.lit(2))))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: rank for rank, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}


def prefix_places(word: str, ranks: dict[str, int]) -> tuple[list[int], int]:
    """(places of the bigrams of the gram prefix, rank of its last bigram)."""
    own = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(own)[PREFIX - 1]
    return [i for i, r in enumerate(own) if r <= last], last


def pivots(word: str, places: list[int], ranks: dict[str, int]) -> tuple[int, int]:
    """Places of two disjoint bigrams of the prefix with the least total rank.

    Dynamic programming from left to right: `one` is the best single bigram that ends before the present one, `two` the
    best pair so far. Three bigrams always hold two disjoint ones.
    """
    two: tuple[int, int, int] | None = None
    one: tuple[int, int] | None = None
    waiting: tuple[int, int] | None = None  # the bigram at the place just before overlaps with this one
    for at in places:
        if waiting is not None and at - waiting[1] >= 2:
            one = waiting if one is None else min(one, waiting)
            waiting = None
        cost = ranks[word[at : at + 2]]
        if one is not None:
            pair = (one[0] + cost, one[1], at)
            two = pair if two is None else min(two, pair)
        if waiting is not None:
            one = waiting if one is None else min(one, waiting)
        waiting = (cost, at)
    assert two is not None
    return two[1], two[2]


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def half_keys(word: str, indexed_length: int) -> list[tuple[int, int]]:
    """Keys of both halves, cut where an indexed word of that length is cut."""
    cut = indexed_length // 2
    return [(_key("first half", indexed_length, word[:cut]), 0), (_key("second half", indexed_length, word[len(word) - (indexed_length - cut) :]), 0)]


def pivot_keys(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(key, rank of the last bigram of the prefix) of an indexed word's two pivots."""
    n = len(word)
    found = half_keys(word, n) if n >= LONG else []
    if n <= LONG + 1:
        places, last = prefix_places(word, ranks)
        a, b = pivots(word, places, ranks)
        keys = set()
        for change in (-1, 0, 1):
            keys.add(_key("after", n - b - 2 + change, word[: b + 2]))
            keys.add(_key("between", b - a + change, word[: a + 2], word[b + 2 :]))
            keys.add(_key("up to", a + 2 + change, b - a, word[a + 2 :]))
        found += [(key, last) for key in keys]
    return found


def prefix_keys(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(key, rank of the last bigram of the prefix) under which an indexed word may find a word."""
    n = len(word)
    found = [x for length in (n - 1, n, n + 1) for x in half_keys(word, length)] if n >= LONG else []
    if n <= LONG + 1:
        places, last = prefix_places(word, ranks)
        keys = set()
        for kept in places:
            keys.add(_key("after", n - kept - 2, word[: kept + 2]))
            for rest in range(kept + 2, n + 1):
                keys.add(_key("between", rest - kept - 2, word[: kept + 2], word[rest:]))
            for rest in range(kept + 1):
                keys.add(_key("up to", rest, kept - rest + 2, word[rest:]))
        found += [(key, last) for key in keys]
    return found


def _keyed(words: DataFrame, make, ranks: dict[str, int]) -> DataFrame:
    """(key, last, word, n) for each key of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEY_ROWS):
                part = batch.slice(at, KEY_ROWS)
                keys, lasts, rows = [], [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    for key, last in make(word, ranks):
                        keys.append(key)
                        lasts.append(last)
                        rows.append(i)
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lasts, pa.int32()), taken.column("word"), taken.column("n")], names=["key", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, last int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart, in both directions, once."""
    ranks = gram_ranks(words)
    index = _keyed(words, pivot_keys, ranks).select("key", F.col("last").alias("l1"), F.col("word").alias("w1"), F.col("n").alias("n1"))
    others = _keyed(words, prefix_keys, ranks).select("key", F.col("last").alias("l2"), F.col("word").alias("w2"), F.col("n").alias("n2"))
    met = index.join(others, "key").where((F.col("l1") <= F.col("l2")) & (F.col("w1") != F.col("w2")) & (F.levenshtein("w1", "w2", 1) == 1))
    both = F.array(F.struct(F.col("w1").alias("word"), F.col("n1").alias("n"), F.col("w2").alias("other"), F.col("n2").alias("other_n")), F.struct(F.col("w2").alias("word"), F.col("n2").alias("n"), F.col("w1").alias("other"), F.col("n1").alias("other_n")))
    return met.select(F.explode(both).alias("p")).select("p.*").dropDuplicates(["word", "other"])


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, twice as far with each round.

    A form is several times as frequent as its word, so chains are short and end; the rounds go on until none changes.
    """
    roots = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not roots.join(on, "root", "left_semi").take(1):
            return roots
        roots = staged(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    words = staged(word_counts(docs, id_col=id_col, text_col=text_col))
    # of the near words the most frequent, of equal ones the first in code-point order, which is the order of UTF-8 bytes
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = staged(found.select("word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = roots_of(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_pivotal_grams": op12_pivotal_grams}
ORACLES: dict[str, str] = {}
