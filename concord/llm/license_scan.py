"""License scan by ordered signature rules (operator 1).

A text becomes its lower-cased words joined by one space. Each rule of `license_rules` carries a keyword; only rules whose
keyword is among the text's words run their expression. Detections are resolved in rule order: by priority, then by place
in the list, and a detection that lies inside the interval of one kept before is suppressed. The three base phrases are
rules of their own that nothing suppresses, and that suppress nothing.

Defined results: a null text has no words; labels are distinct and sorted; first_word and last_word are null without a base
place; the score joins the confidences of the kept labels as independent evidence, 0 without any; repeated rows are scanned
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from concord.llm.common import id_and_text, map_text, table, words
from concord.llm.license_rules import RULES

#: Base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: How sure a detection of each priority is.
CONFIDENCE = {1: 0.98, 2: 0.9, 3: 0.7, 4: 0.3}


class Rules:
    """Rules by keyword, in the order in which detections are resolved."""

    def __init__(self, text: str = RULES) -> None:
        found, keyword = [], ""
        for line in text.strip().splitlines():
            if line.startswith("["):
                keyword = line[1:-1]
            else:
                priority, label, expression = line.split(" ", 2)
                found.append((int(priority), len(found), label, keyword.encode(), re.compile(b" (?:" + expression.encode() + b")(?= )")))
        self.ordered = [(label, CONFIDENCE[priority], keyword, pattern) for priority, _, label, keyword, pattern in sorted(found, key=lambda r: r[:2])]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.ordered):
            self.by_keyword.setdefault(rule[2], []).append(i)


@lru_cache(maxsize=1)
def rules() -> Rules:
    return Rules()


_BASE = [(phrase.encode(), label, phrase.split()[0].encode(), re.compile(b" " + phrase.encode() + b"(?= )")) for phrase, label in BASE]


def resolve(detections: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(rule, start, end) kept of the intervals of each rule, given in order: none lies inside one kept before.

    Kept intervals stay sorted by start with the furthest end so far, so one binary search settles each new interval.
    """
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = starts
    kept = []
    for rule, spans in detections:
        at = np.searchsorted(starts, spans[:, 0], "right") - 1
        inside = np.zeros(len(spans), bool)
        own = at >= 0
        inside[own] = reach[at[own]] >= spans[own, 1]
        new = spans[~inside]
        if len(new):
            kept += [(rule, s, e) for s, e in new.tolist()]
            starts, ends = np.concatenate((starts, new[:, 0])), np.concatenate((ends, new[:, 1]))
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            reach = np.maximum.accumulate(ends)
    return kept


def scan(raw: bytes) -> dict:
    """Base places and kept detections of one text; places are word numbers, ends exclusive."""
    w = words(raw)
    have = set(w)
    out = {"n_words": len(w), "base": [], "kept": []}
    ruled = rules()
    hot = sorted(i for k in have & ruled.by_keyword.keys() for i in ruled.by_keyword[k])
    base = [b for b in _BASE if b[2] in have]
    if not hot and not base:
        return out
    joined = b" " + b" ".join(w) + b" "
    gaps = None
    found = [(label, [m.span() for m in pattern.finditer(joined)]) for _, label, _, pattern in base]
    spans = [(i, [m.span() for m in ruled.ordered[i][3].finditer(joined)]) for i in hot]
    if any(s for _, s in found) or any(s for _, s in spans):
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        place = lambda s: np.searchsorted(gaps, np.array(s, np.int64).reshape(-1, 2))  # noqa: E731  word n starts after gap n
        out["base"] = sorted((p, label) for label, s in found for p in place(s)[:, 0].tolist())
        out["kept"] = resolve([(i, place(s)) for i, s in spans if s])
    return out


def _scan_slice(texts: list[bytes]) -> dict:
    cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
    for raw in texts:
        got = scan(raw)
        places = [p for p, _ in got["base"]]
        base = {label for _, label in got["base"]}
        sure: dict[str, float] = dict.fromkeys(base, 0.9)
        for i, _, _ in got["kept"]:
            label, confidence = rules().ordered[i][:2]
            sure[label] = max(confidence, sure.get(label, 0.0))
        cols["n_words"].append(got["n_words"])
        cols["n_base"].append(len(places))
        cols["first_word"].append(places[0] if places else None)
        cols["last_word"].append(places[-1] if places else None)
        cols["base_labels"].append(",".join(sorted(base)))
        cols["labels"].append(",".join(sorted(sure)))
        cols["score"].append(1.0 - float(np.prod([1.0 - c for c in sure.values()])) if sure else 0.0)
        cols["detections"].append([{"label": rules().ordered[i][0], "start": s, "end": e} for i, s, e in got["kept"]])
    return cols


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row."""
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long>>"
    return map_text(id_and_text(docs, id_col, text_col), _scan_slice, fields)


def op1_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op1_signature_rules": op1_signature_rules}
ORACLES: dict[str, str] = {}
