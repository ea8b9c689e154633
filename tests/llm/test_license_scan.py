import re

import numpy as np

from concord.llm.license_scan import BASE, Rules, license_scan, op1_signature_rules, resolve, rules, scan


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    """Base places word by word; labels by running every rule without prefilter and comparing all intervals."""
    w = split(text)
    base = [(i, label) for i in range(len(w)) for phrase, label in BASE if w[i : i + len(phrase.split())] == phrase.split()]
    joined, kept = " " + " ".join(w) + " ", []
    for label, _, _, pattern in rules().ordered:
        before = list(kept)
        for m in re.finditer(pattern.pattern.decode(), joined):
            if not any(s <= m.start() and m.end() <= e for s, e, _ in before):
                kept.append((m.start(), m.end(), label))
    places = [p for p, _ in base]
    names = sorted({x for _, x in base})
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(names), ",".join(sorted({*names, *(x for _, _, x in kept)})))


def test_whole_table_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_signature_rules(spark, sf).collect()
    assert len(got) == len(texts) and any(r["n_base"] for r in got)
    for r in got:
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_there_are_hundreds_of_rules_and_each_needs_its_keyword():
    assert len(rules().ordered) > 200
    for _, _, keyword, pattern in rules().ordered:
        assert keyword in re.findall(rb"[a-z0-9\x80-\xff]+", pattern.pattern), (keyword, pattern.pattern)


def test_containment_and_priority():
    text = b"Licensed under the Apache License, Version 2.0 or GNU General Public License v3 or later; MIT license. MIT License"
    got = scan(text)
    assert [label for _, label in got["base"]] == ["apache", "gpl", "mit", "mit"]
    labels = {rules().ordered[i][0] for i, _, _ in got["kept"]}
    assert "apache-2.0" in labels and "apache" not in labels and "gpl-3.0+" in labels
    spans = lambda *x: np.array(x, np.int64)
    assert resolve([(0, spans((2, 6))), (1, spans((2, 6), (1, 6), (3, 4))), (2, spans((0, 9), (1, 5)))]) == [(0, 2, 6), (1, 1, 6), (2, 0, 9)]


def test_odd_rows(docs_of):
    long = "word " * 50000 + "mit license"
    got = {r["doc_id"]: r for r in license_scan(docs_of([(1, None), (2, ""), (3, long), (4, "mit\nLICENSE mit.license"), (4, "é mit licenses")], {"labels": "x", "score": 1})).collect() if r["doc_id"] != 4 or r["n_base"]}
    assert (got[1]["n_words"], got[1]["labels"], got[1]["score"], got[1]["first_word"]) == (0, "", 0.0, None)
    assert (got[3]["n_words"], got[3]["first_word"]) == (50002, 50000)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 2)
    assert license_scan(docs_of([])).count() == 0


def test_rules_of_ones_own():
    own = Rules("[x]\n2 b x y\n1 a x y z\n")
    assert [r[0] for r in own.ordered] == ["a", "b"]
