import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from concord.llm.bin_slack import Encoder, Layout, fullest, minimum_slack, op9_minimum_bin_slack, pack_documents, packed_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def holds(pairs, got):
    """Pieces are the plain ids cut as told; sequences are gapless."""
    want = sorted((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for (i, _), ids in zip(pairs, plain_ids([t for _, t in pairs])) for k, s, n in cuts(len(ids)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return len(bins)


def cuts(n):
    first = n if n <= 1024 else n % 1024 or 1024
    out, start, size = [], 0, first
    while start < n:
        out.append((len(out), start, size))
        start, size = start + size, 1024
    return out


def test_whole_table_is_packed_tightly(spark, sf):
    pairs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op9_minimum_bin_slack(spark, sf).collect()
    total = sum(r["length"] for r in got)
    assert holds(pairs, got) <= 1.01 * math.ceil(total / 1024) + 1


def test_odd_rows(docs_of):
    pairs = [(1, None), (2, ""), (3, " a  b\n\n c \t d "), (3, "a b"), (3, "a b"), (4, "x " * 9000), (5, "<|endoftext|> é  "), (6, "word" * 3000)]
    got = pack_documents(docs_of(pairs, {"piece": "clash", "length": 1})).collect()
    holds(pairs, got)
    assert pack_documents(docs_of([])).count() == 0


def test_sequences_hold_the_ids(docs_of):
    pairs = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(40)]
    packed = pack_documents(docs_of(pairs), keep_ids=True)
    ids = sorted(x for r in packed_sequences(packed).collect() for x in r["ids"])
    assert ids == sorted(x for d in plain_ids([t for _, t in pairs]) for x in d)


def test_parts_encode_as_the_whole_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t  ab'sé1.,\u0085") for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() + [2] for b in Encoder(PATH).encode(texts)]
    assert got == plain_ids(texts)


def test_fullest_matches_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = fullest(counts, room)
        assert all(k <= counts[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def best_fit_decreasing(counts, capacity=1024):
    room = [0] * (capacity + 1)  # bins by room left
    bins = 0
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((r for r in range(n, capacity + 1) if room[r]), None)
        if at is None:
            bins, at = bins + 1, capacity
        else:
            room[at] -= 1
        room[at - n] += 1
    return bins


def test_layout_covers_every_rank_once():
    rng = random.Random(7)
    counts = {n: rng.randrange(1, 300) for n in rng.sample(range(1, 1025), 60)}
    plan = minimum_slack(counts)
    layout, load, seen = Layout(plan), defaultdict(int), set()
    for n, c in counts.items():
        seq, offset = layout.place(np.full(c, n), np.arange(c))
        for s, o in zip(seq.tolist(), offset.tolist()):
            assert (s, o) not in seen
            seen.add((s, o))
            load[s] += n
    assert max(load.values()) <= 1024 and len(load) == layout.bins
    assert layout.bins <= best_fit_decreasing(counts)


def test_words_of_letters_go_to_the_model_alone():
    """The cost per new part is the tokenizer's search for words; a part of letters is one already."""

    class Seen(Encoder):
        def _joined(self, some):
            joined.update(some)
            return super()._joined(some)

    rng, joined = random.Random(8), set()
    letters = "abzAZ" + "".join(map(chr, (0xC0, 0xD6, 0xD8, 0xF6, 0xF8, 0x24F, 0x130, 0x1C5)))
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    odd = ["a1", "x×y", "ª", "ɐ", "b'll", "é", "日本", "a_b.", "<|endoftext|>", "...", "no-go!"]
    texts = [" ".join(rng.choice(words) + rng.choice(("", "", ".", ",", "?")) for _ in range(50)) + "\n" + rng.choice(odd) + " " + rng.choice(odd) for _ in range(300)]
    encoder = Seen(PATH)
    for some in (texts[:150], texts[100:]):
        assert [np.frombuffer(b, "<u4").tolist() + [2] for b in encoder.encode(some)] == plain_ids(some)
    assert joined and not [p for p in joined if set(p) <= set(letters + " ")]
    encoder.by_word = False  # a tokenizer of another kind
    encoder._forget()
    assert [np.frombuffer(b, "<u4").tolist() + [2] for b in encoder.encode(texts)] == plain_ids(texts)
