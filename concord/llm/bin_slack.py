"""Packing documents into token sequences by minimum bin slack (operator 9).

Only documents longer than a sequence are cut, and their short piece comes first. What remains is one-dimensional bin
packing over integer lengths, so the number of pieces of each length (at most `capacity` numbers, whatever the corpus) is
all that the packing needs: for each bin, seeded with the longest length left, a bitset subset-sum over the lengths left
finds the fullest feasible filling, which is then removed as often as the counts allow. The resulting list of
(filling, times) is applied to the pieces by arithmetic on their rank within their length, which Spark computes in salted
groups, so that a length which holds a third of all pieces is spread as well.

Defined results: a null or empty text is the end token alone; repeated rows are packed one by one; sequence ids are
consecutive from 0; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import id_and_text, slices, staged, table

CAPACITY = 1024
END_ID = 2
#: Pieces that one rank group holds on average.
GROUP_ROWS = 5_000
#: Text parts whose ids a worker remembers before it starts anew; bounds memory, not results.
MEMO_PARTS = 1_400_000

#: Bytes of text that the encoder sees at once.
PACK_SLICE = 8 << 20

_MARK = "\x00"
#: White space other than a space and a line feed.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r" (?=\S)")
_INNER = re.compile(r".\s|^[^\S ]|^ ?$", re.S)
#: A run of letters, of a range in which every Unicode version has the same ones, alone or before one mark.
_LETTERS = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character by which a byte-level vocabulary names each byte; a line feed stays, to part words.
_SYMBOLS = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))} | {10: "\n"}


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The tokenizer splits a text around single line feeds and before each space that precedes another character, whatever
    stands around them, so such parts are encoded once and remembered. Texts with runs of white space, or with other white
    space than these two, are cut only before a space that precedes another character, where a cut is always right.
    A part of letters only is one word to the tokenizer, so its model is given the word without looking for its ends.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        cut, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        byte_level = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and isinstance(self.model, BPE)
        self.by_word = byte_level and self.tokenizer.normalizer is None and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token)  # one character of a byte-level token stands for one byte
        self._forget()

    def _forget(self) -> None:
        """Start with no parts: `memo` numbers them, their ids lie one after the other in `ids` from `first`, `size` of them."""
        self.memo: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = pa.array(["" if _MARK in x else self._marked(x) for x in texts], pa.large_string())
        lists = pc.split_pattern(marked, _MARK)
        flat = lists.flatten().dictionary_encode()  # each part once: what follows touches distinct parts only
        distinct = flat.dictionary.to_numpy(zero_copy_only=False)
        if len(self.memo) > MEMO_PARTS:
            self._forget()
        known = np.fromiter(map(self.memo.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = distinct[known < 0].tolist()
        self._learn(new)
        known[known < 0] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        number = known[flat.indices.to_numpy()]
        raw = self._gather(number).tobytes()
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        ends = 4 * np.concatenate(([0], np.cumsum(self.size[number])))[np.concatenate(([0], np.cumsum(counts)))]
        # a text that holds the mark itself is encoded whole
        return [self._ids(x).tobytes() if _MARK in x else raw[s:e] for x, s, e in zip(texts, ends.tolist(), ends[1:].tolist())]

    @staticmethod
    def _marked(text: str) -> str:
        """The text with a mark at each place where it is cut."""
        if "  " in text or " \n" in text or "\n\n" in text or text.endswith(" ") or _other_space(text):
            return _CUT.sub(_MARK + " ", text)
        return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n" + _MARK)

    def _gather(self, number: np.ndarray) -> np.ndarray:
        """The ids of numbered parts, laid end to end."""
        size = self.size[number]
        shift = self.first[number] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))]

    def _add(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.memo.update(zip(parts, range(len(self.size), len(self.size) + len(parts))))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))

    def _learn(self, new: list[str]) -> None:
        """Ids of new parts; those after whose letters one mark stands share the ids of the rest."""
        plain, marked, single = set(), [], []
        if self.by_word:
            parts = pa.array(new, pa.string())
            word, ended = (pc.match_substring_regex(parts, _LETTERS + end) for end in ("$", "[.,;:!?]$"))
            marked = parts.filter(ended).to_numpy(zero_copy_only=False).tolist()
            words = set(parts.filter(word).to_numpy(zero_copy_only=False)).union(p[:-1] for p in marked)
            self._add(*self._worded(list(words.difference(self.memo))))
            plain.update(p[-1] for p in marked)
            new = parts.filter(pc.invert(pc.or_(word, ended))).to_pylist()
        for p in new:
            if p[p[:1] == " " :].isalnum():
                plain.add(p)
            elif _INNER.search(p):  # white space elsewhere than one space in front
                single.append(p)
            elif len(p) > 2 and p[-1] in ".,;:!?" and p[-2].isalpha():
                marked.append(p)
                plain.update((p[:-1], p[-1]))
            else:
                plain.add(p)
        some = list(plain.difference(self.memo))
        if some or single:
            found = [self._joined(some[i : i + 2000]) for i in range(0, len(some), 2000)] + [([p], x := self._ids(p), np.array([len(x)])) for p in single]
            self._add([p for x, _, _ in found for p in x], np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found]))
        if marked:
            number = np.empty((len(marked), 2), np.int64)
            number[:, 0] = np.fromiter((self.memo[p[:-1]] for p in marked), np.int64, len(marked))
            number[:, 1] = np.fromiter((self.memo[p[-1]] for p in marked), np.int64, len(marked))
            self._add(marked, self._gather(number.ravel()), self.size[number].sum(axis=1))

    def _worded(self, some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of letters, given to the tokenizer's model as they are: (words, ids, sizes)."""
        named = "\n".join(some).encode().decode("latin-1").translate(_SYMBOLS).split("\n") if some else []
        found = [[t.id for t in self.model.tokenize(w)] for w in named]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return some, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size

    def _joined(self, some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Parts encoded as one text with line feeds between them, cut again by the bytes of the tokens: (parts, ids, sizes)."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.token_bytes[ids])
        size = pc.binary_length(pa.array(some, pa.string())).to_numpy().astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + size, "right")
        if (ends[last - 1] == start + size).all() and (np.concatenate(([0], ends))[first] == start).all():
            n = last - first
            return some, ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n
        each = [self._ids(p) for p in some]
        return some, np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _ids(self, part: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4")


def _other_space(text: str) -> bool:
    for c in _OTHER:
        if c in text:
            return True
    return False


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text", PACK_SLICE):
            out: list[tuple] = []
            for doc, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                raw += end
                n = len(raw) // 4
                start, size = 0, n if n <= capacity else n % capacity or capacity
                k = 0
                while start < n:
                    ids = raw[4 * start : 4 * (start + size)]
                    out.append((doc, k, start, size, zlib.crc32(ids), ids if keep_ids else None))
                    start, size, k = start + size, capacity, k + 1
            doc, k, start, size, crc, ids = zip(*out)
            arrays = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids and the end token."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(_pieces(path, capacity, end_id, keep_ids), schema)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """How many of each length fill `room` as far as the lengths left allow: subset sums as bits of one integer.

    Lengths enter from the longest; the search ends as soon as at most `slack` stays free.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    if room <= slack:
        return {}
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left and not reach >> max(0, room - slack):
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << (length * times) & full
            left -= times
            times *= 2
        if reach >> max(0, room - slack):
            break
    at, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            used[length] = used.get(length, 0) + times
    return used


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY, slacks: tuple[int, ...] = (0, 2, 8, 32, 64)) -> list[tuple[dict[int, int], int]]:
    """Fillings (length: how many) with the number of bins each is used for, until no length is left.

    A free place or two may be worth keeping the short lengths for later bins, so the packing is made for several
    allowed slacks and the one with the fewest bins is returned.
    """
    plans = [_plan(counts, capacity, slack) for slack in slacks]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        filling = fullest({n: c for n, c in left.items() if c}, capacity - seed, slack)
        left[seed] += 1
        filling[seed] = filling.get(seed, 0) + 1
        times = min(left[n] // k for n, k in filling.items())
        for n, k in filling.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((filling, times))
    return plan


class Layout:
    """From (length, rank within that length) to (sequence, offset), by arithmetic on the plan's running totals."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first bin, pieces a bin, first offset
        used: dict[int, int] = {}
        bins = 0
        for filling, times in plan:
            offset = 0
            for length in sorted(filling, reverse=True):
                k = filling[length]
                rows.append((length, used.get(length, 0), bins, k, offset))
                used[length] = used.get(length, 0) + k * times
                offset += k * length
            bins += times
        rows.sort()
        self.bins = bins
        self.length, self.rank, self.bin, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.rank, (length << 44) + rank, "right") - 1
        rank = rank - self.rank[at]
        return self.bin[at] + rank // self.each[at], self.offset[at] + rank % self.each[at] * length


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (length, ...) with sequence_id and offset added."""
    names = pieces.columns
    pieces = staged(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    layout = Layout(minimum_slack(counts, capacity))
    groups = -(-sum(counts.values()) // group_rows) or 1
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(first, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_first") + F.col("_row") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = layout.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ranked.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece with its place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    pieces = token_pieces(docs, path or tokenizer_path(), id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    return pack(pieces, capacity=capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from pack_documents(..., keep_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_minimum_bin_slack": op9_minimum_bin_slack}
ORACLES: dict[str, str] = {}
