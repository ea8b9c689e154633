import hashlib
import random
import re

from concord.llm.anchor_pii import BASE_KINDS, op5_anchor_expansion, personal_data, scan

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(double) % 10 == 0
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute(text):
    found = [(m.start(), BASE_KINDS.index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [(s, BASE_KINDS[k], e) for s, k, e in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def test_whole_table_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_anchor_expansion(spark, sf).collect()
    assert len(got) == len(texts) and any(r["n_email"] for r in got)
    for r in got:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[1] == k for s in base) for k in BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()


def test_random_texts_against_brute_force():
    rng = random.Random(10)
    parts = ["a@b.c", "@", "x.y+z", "4111 1111 1111 1111", "4111-1111-11111111", "1.2.3.4", "256.1.1.1", ".5", "+49 (30) 1234567", "+1", " ", "-", ".", "7", "00", "é", "\n", "a%b@c-d.e.f", "@g.h", "+12 ) ) 3"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert [s for s in scan(text) if s[1] in BASE_KINDS] == brute(text), text


def test_kinds_found_at_cues():
    kinds = lambda t: {(k, t[s:e]) for s, k, e in scan(t) if k not in BASE_KINDS}
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 now") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert kinds("iban DE89 3704 0044 0532 0130 01") == set()
    assert kinds("My SSN is no; SSN: 123-45-6789.") == {("ssn", "123-45-6789")}
    assert kinds("account number 12345678") == {("account", "12345678")}
    assert kinds("Passport no. AB123456") == {("passport", "AB123456")}
    assert kinds("see https://joe:pw1@example.com/x") == {("url_login", "https://joe:pw1@example.com")}
    assert kinds("write jane.doe [at] example [dot] com") == {("email_spelled", "jane.doe [at] example [dot] com")}
    assert kinds("He is at home, on account of rain and a passport office.") == set()


def test_odd_rows(docs_of):
    pairs = [(1, None), (2, ""), (3, "1" * 60000 + "a@b.cd"), (4, "x" * 50000 + "@"), (5, "\U0001f600 a@b.cd"), (5, "\U0001f600 a@b.cd"), (6, "1." * 30000)]
    got = sorted(personal_data(docs_of(pairs, {"spans": "clash"})).collect(), key=str)
    assert len(got) == 7
    for r, (i, t) in zip(got, sorted(pairs, key=str)):
        assert r["doc_id"] == i and r["base_sha256"] == hashlib.sha256(joined(brute(t)).encode()).hexdigest()
    assert got[4]["spans"] == "email:2:8"
    assert personal_data(docs_of([])).count() == 0


def test_logins_of_any_length():
    user, word = "u" * 500, "p" * 5000
    text = f"see https://{user}:{word}@host.example.org/x and ftp://a:b@h"
    found = [(text[s:e]) for s, kind, e in scan(text) if kind == "url_login"]
    assert len(found) == 2 and f"{user}:{word}@host.example.org" in found[0]
    assert not [1 for _, kind, _ in scan("://" + "a" * 100000 + ":" + "b" * 100000) if kind == "url_login"]
