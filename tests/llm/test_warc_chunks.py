import gzip
import hashlib
import uuid
from pathlib import Path

import pytest

from concord.llm.warc_chunks import REVISIT_PROFILE, Parser, chunk_rows, op4_chunked_warc, pieces, read_archives, with_references, write_archives


def brute(pages):
    rows = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, p in rows:
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in rows:
        ref = first.get(p)
        again = ref is not None and (i is None or i > ref)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert rows(op4_chunked_warc(spark, sf)) == brute(pages)


ODD = [
    (1, None), (2, ""), (3, "\r\n\r\n"), (4, "a\r\n"), (5, "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "é\U0001f600" * 5000),
    (7, "x" * 200), (8, "x" * 200), (None, "x" * 200), (7, "x" * 200), (9, "x" * 99), (10, "x" * 99), (None, None), (11, "\n" * 700), (12, "\r" * 300 + "\n"), (13, "y" * 300000),
]


def test_round_trip_of_odd_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, h, 1) for i, h in ODD], "page_id long, url string, html string, digest int").repartition(3)
    for size in (7, 300, 1 << 16):
        folder = str(tmp_path / uuid.uuid4().hex)
        write_archives(pages, folder, chunk_bytes=size)
        assert rows(read_archives(spark, folder)) == brute([(i, h) for i, h in ODD])
    write_archives(pages.limit(0), str(tmp_path / "none"))
    assert rows(read_archives(spark, str(tmp_path / "none"))) == []


def test_files_are_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>" + "z" * 900)], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"), chunk_bytes=400)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    kinds, payload = [], b""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields[b"Content-Length"])
        payload += rest[:n]
        assert hashlib.sha256(payload).hexdigest().encode() == fields[b"WARC-Running-Digest"][7:]
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append((fields[b"WARC-Type"], fields[b"WARC-Segment-Number"]))
        data = rest[n + 4 :]
    assert kinds == [(b"response", b"1"), (b"continuation", b"2"), (b"continuation", b"3")] and len(payload) == 903


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>hello</p>")], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in Path(tmp_path / "w").glob("part-*")).replace(b"hello", b"hallo")
    parser = Parser()
    with pytest.raises(ValueError, match="damaged"):
        for line in text.split(b"\n"):
            parser.line(line)


def test_pieces_are_whole_characters_of_bounded_size():
    raw = ("é日\U0001f600a" * 50).encode()
    for size in (1, 2, 3, 4, 5, 64, 1000):
        got = [bytes(p) for p in pieces(memoryview(raw), size)]
        assert b"".join(got) == raw and all(p.decode() and (len(p) <= size or len(p.decode()) == 1) for p in got)
    assert [bytes(p) for p in pieces(memoryview(b""), 8)] == [b""]


def test_large_payload_leaves_in_rows_with_running_digests(spark):
    html = "日" * 3_000_000 + "z"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = chunk_rows(with_references(pages)).collect()
    running = hashlib.sha256()
    for no, r in enumerate(got, 1):
        running.update(r["chunk"].encode())
        assert (r["chunk_no"], r["running_digest"], r["last"]) == (no, running.hexdigest(), no == len(got)) and len(r["chunk"].encode()) <= 1 << 16
    assert running.hexdigest() == got[0]["digest"] and got[0]["total_bytes"] == len(html.encode()) and len(got) == -(-len(html.encode()) // 65535)


def test_revisits_name_their_profile(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    heads = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*")).decode().split("WARC/1.1\r\n")[1:]
    assert {("WARC-Type: revisit" in h): f"WARC-Profile: {REVISIT_PROFILE}\r\n" in h for h in heads} == {False: False, True: True}
