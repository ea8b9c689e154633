"""Personal data by anchor expansion (operator 5).

One Aho-Corasick pass finds the anchors of a text: at-signs, plus signs, digits, scheme separators and identifier cues.
From each anchor a local parser expands to the boundaries of its kind and validates what it found; a parser starts where
the last match of its kind ended, so matches of a kind never overlap and each character is expanded over a bounded number
of times. Base kinds follow their expressions exactly, leftmost and greedy, and a match that fails its test is dropped
without a retry. Further kinds are found at cues: spelled-out addresses, credentials in addresses with a scheme, IBANs,
social security, account and passport numbers.

Defined results: a null text is empty; places are code points, ends exclusive; spans are sorted by start, then by kind in
the order of KINDS; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from concord.llm.common import id_and_text, map_text, sha256, spans_text, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_spelled", "url_login", "iban", "ssn", "account", "passport")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\[(] ?at ?[\])] ?([A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+)", re.I)
_LOGIN = re.compile(r"://[^\s/@:]++:[^\s/@]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_GAP = r"(?: ?(?:no|nr|number|nummer|num[eé]ro|n[uú]mero|code|card)\b\.?)?[ :#=]{0,3}"
_IBAN = re.compile(r"IBAN" + _GAP + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.I)
_SSN = re.compile(r"(?:SSN|social security)" + _GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
_ACCOUNT = re.compile(r"(?:account|acct|konto|compte|cuenta)" + _GAP + r"([0-9]{6,17})(?![0-9])", re.I)
_PASSPORT = re.compile(r"passport" + _GAP + r"([A-Z0-9]{6,9})(?![A-Za-z0-9])", re.I)
#: Cues (in three spellings each) and the parser they start.
_CUES = {"[at": "email_spelled", "(at": "email_spelled", "[ at": "email_spelled", "( at": "email_spelled", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "passport": "passport"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("url_login", 3))
    for cue, kind in _CUES.items():
        for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban(value: str) -> int:
    """Length of the longest prefix of the candidate that is a valid IBAN, 0 if none."""
    for end in range(len(value), 14, -1):
        bare = value[:end].replace(" ", "").upper()
        if value[end - 1] != " " and 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            return end
    return 0


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all personal data in a text, sorted by start, then kind."""
    found: list[tuple[int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in _automaton().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        found.append((at, "card", m.end()))
            if at >= done["ip"]:
                m = _IP.match(text, at)
                done["ip"] = m.end() if m else _DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append((at, "ip", m.end()))
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                done["email"] = m.end()
                found.append((start, "email", m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((at, "phone", m.end()))
        elif at >= done[anchor]:
            _expand(text, anchor, at, done, found)
    found.sort(key=lambda s: (s[0], _ORDER[s[1]]))
    return found


def _expand(text: str, kind: str, at: int, done: dict[str, int], found: list[tuple[int, str, int]]) -> None:
    """The kinds that start at a cue."""
    start = at
    if kind == "email_spelled":
        m = _SPELLED.match(text, at)
        if m and start and text[start - 1] == " ":
            start -= 1
        edge = start
        while m and start > done[kind] and text[start - 1] in _LOCAL:
            start -= 1
        ok, end = bool(m) and start < edge, m.end() if m else at
    elif kind == "url_login":
        m = _LOGIN.match(text, at)
        while m and start > done[kind] and text[start - 1] in _SCHEME:
            start -= 1
        ok, end = bool(m) and start < at, m.end() if m else at
    else:
        m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "passport": _PASSPORT}[kind].match(text, at)
        start, end = m.span(1) if m else (at, at)
        ok = bool(m)
        if ok and kind == "iban":
            n = _iban(m[1])
            ok, end = n > 0, start + n
        elif ok and kind == "passport":
            ok = any(c.isdigit() for c in m[1])
    if ok:
        done[kind] = end
        found.append((start, kind, end))


def _scan_slice(texts: list[bytes]) -> dict:
    cols: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans")}
    for raw in texts:
        spans = scan(raw.decode())
        base = [s for s in spans if s[1] in BASE_KINDS]
        for k in BASE_KINDS:
            cols[f"n_{k}"].append(sum(s[1] == k for s in base))
        cols["base_sha256"].append(sha256(spans_text(base)))
        cols["spans"].append(spans_text(spans))
    return cols


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    fields = ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return map_text(id_and_text(docs, id_col, text_col), _scan_slice, fields)


def op5_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op5_anchor_expansion": op5_anchor_expansion}
ORACLES: dict[str, str] = {}
