import time

import pytest

from concord.functions import values as N
from concord.functions.similarity import indel_ratio


@pytest.mark.parametrize("text,want", [("131,058", 131058.0), ("131 058", 131058.0), ("131.058,50", 131058.5), ("1,234,567.8", 1234567.8), ("21.5", 21.5), ("131.058", 131058.0), ("0", 0.0), ("N/A", None), ("", None)])
def test_numbers(one, text, want):
    assert one(N.parse_number, text) == want


@pytest.mark.parametrize("text,label,want", [("21.577 MT", "", 21577.0), ("21.577", "Gross Weight (MT)", 21577.0), ("138 MT", "", 138000.0), ("1000 lbs", "", 453.592), ("____MT", "", None), ("TBA", "", None)])
def test_weights(one, text, label, want):
    assert one(N.weight_kg, text, label) == want


@pytest.mark.parametrize("text,want", [("3 x 40HC", 3), ("12X20'FCL", 12), ("3×40HC", 3), ("2x20GP + 1x40HC", 3), ("THREE (3)", 3), ("TWO CONTAINERS", 2), ("1 x 40 ft HC", 1), ("TBA", None)])
def test_counts(one, text, want):
    assert one(N.container_count, text)["count"] == want


@pytest.mark.parametrize("a,b,same", [("Port Kelang", "PORT KLANG, MALAYSIA", True), ("JNPT, INDIA", "Nhava Sheva, India", True), ("SINGAPORE", "SINGAPORE, SINGAPORE (SGSIN)", True),
                                      ("Port of Rotterdam, Netherlands", "ROTTERDAM", True), ("SINGAPORE, SINGAPORE (MYPKG)", "PORT KLANG (WESTPORT), MALAYSIA (MYPKG)", False),
                                      ("NANTONG, CHINA", "RUGAO/NANTONG/SHANGHAI, CHINA", False)])
def test_ports(one, a, b, same):
    key = lambda c: N.port_key(N.port_parts(c))
    assert (one(key, a) == one(key, b)) is same


@pytest.mark.parametrize("a,b", [("To the Order of ROXCEL TRADING GMBH", "ROXCEL TRADING GMBH"), ("Ball and Doggett Australia Pty Limited", "BALL & DOGGETT AUSTRALIA PTY LTD"),
                                 ("EAST BRIGHT L.L.C.", "EAST BRIGHT LLC"), ("X SENDIRIAN BERHAD", "X SDN BHD"), ("M/S X", "X")])
def test_parties(one, a, b):
    assert one(N.party_norm, a) == one(N.party_norm, b)


@pytest.mark.parametrize("text,want", [("", True), ("   ", True), ("???", True), ("____", True), ("_______ MTS", True), ("TBA", True), ("N/A", True), ("n.a.", True), ("To be advised", True), ("-", True), ("SINGAPORE", False), ("3 x 40'HC", False)])
def test_blanks(one, text, want):
    assert one(N.is_blank, text) is want


def test_order_only(one):
    assert one(N.is_order_only, "To Order of Shipper") and one(N.is_order_only, "TO ORDER") and not one(N.is_order_only, "TO THE ORDER OF X")


@pytest.mark.parametrize("a,b", [("ROXCEL TRADING GMBH", "ROXCEL TRADING"), ("ACME PAPER", "ACME PAPRE"), ("A" * 70, "A" * 69 + "B"), ("ABCXYZ" * 12, "BXZAYC" * 13), ("", "A"),
                                 ("AB" * 60, "BA" * 61), ("é日A" * 50, "日Aé" * 43), ("X" * 121, "Y" * 61), ("A" * 59, "A" * 120)])
def test_ratio_against_the_textbook_table(one, a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert one(indel_ratio, a, b) == pytest.approx(2 * table[-1][-1] / (len(a) + len(b)))


def test_long_values_take_seconds(one):
    """5,000 letters against 5,000: a run cut out in the middle and another letter at every hundredth place."""
    a = "".join(chr(65 + (i * i // 7 + i) % 26) for i in range(5000))
    b = "".join("#" if i % 100 == 99 else c for i, c in enumerate(a) if not 2000 <= i < 2200)
    began = time.monotonic()
    assert one(indel_ratio, a, b) == pytest.approx(2 * (4800 - 48) / 9800)
    assert time.monotonic() - began < 30
