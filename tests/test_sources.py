import json

from pyspark.sql import functions as F

from concord.operators.extract import BLOCK, collect_continuations, docs_to_rows, location, split_rows
from concord.sources.inbox import attachment_list, layout_rows, read_attachments, read_messages, sniff_format, text_documents
from concord.streaming.ingest import current_board, start_ingest
from concord.sources.inbox import stream_messages
from tests.test_checks import BL, BODY, SI


def _inbox(root, n=2):
    (root / "inbox").mkdir(), (root / "attachments").mkdir()
    for i in range(n):
        files = [f"attachments/{i}_SI.txt", f"attachments/{i}_BL.txt", f"attachments/{i}_gone.txt"][: 2 + (i == 1)]
        (root / "inbox" / f"email_{i}.json").write_text(json.dumps({"email_id": f"email_{i}", "from": "a@b.com", "subject": "s", "body": BODY, "attachments": files}))
        (root / files[0]).write_text(SI)
        (root / files[1]).write_text(BL)
    return str(root)


def test_inbox_and_missing_files(spark, tmp_path):
    path = _inbox(tmp_path)
    mail = read_messages(spark, path)
    docs = text_documents(read_attachments(spark, mail, path))
    rows = {r["name"]: r for r in docs.collect()}
    assert mail.count() == 2 and len(rows) == 5
    assert rows["attachments/0_SI.txt"]["text"] == SI and rows["attachments/1_gone.txt"]["error"] == "the attachment is not in the folder"


def test_sniffing(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.5"), "a.txt"), (bytearray(b"PK\x03\x04"), "a.docx"), (bytearray(b"\xff\xd8\xff"), "x"), (bytearray(b"hello"), "n.csv")], "content binary, name string")
    assert [r[0] for r in df.select(sniff_format(F.col("content"), F.col("name"))).collect()] == ["pdf", "docx", "image", "txt"]


def test_word_boxes_become_rows(spark):
    words = [("d", 0, 0, 10.0, 10.0, 40.0, 20.0, "Load"), ("d", 0, 1, 42.0, 10.5, 60.0, 20.5, "Port"), ("d", 0, 2, 120.0, 11.0, 180.0, 21.0, "SINGAPORE"), ("d", 0, 3, 120.0, 30.0, 150.0, 40.0, "next"), ("d", 1, 0, 10.0, 10.0, 20.0, 20.0, "end")]
    df = spark.createDataFrame(words, "doc_id string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [(r["row_index"], r["text"], r["label"], r["value"], r["indent"]) for r in layout_rows(df).orderBy("row_index").collect()]
    assert got == [(0, "Load Port   SINGAPORE", "Load Port", "SINGAPORE", False), (1, "next", None, None, True), (2, "end", None, None, False)]


def test_values_across_block_borders(spark):
    """A label on the last row of a block finds its lines in the next one."""
    lines = [f"filler {i}" for i in range(BLOCK - 1)] + ["Shipper:", "ACME LTD", "  LINE 1", "  LINE 2", "Vessel: X"]
    docs = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    got = collect_continuations(split_rows(docs_to_rows(docs))).where("field = 'shipper'").collect()
    assert [(r["raw"], r["full"]) for r in got] == [("ACME LTD", "ACME LTD\nLINE 1\nLINE 2")]


def test_stream_fills_the_board(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    path = _inbox(src, 1)
    board = str(tmp_path / "board")
    load = lambda batch: text_documents(read_attachments(spark, batch, path))
    start_ingest(stream_messages(spark, path), load, board, str(tmp_path / "cp")).awaitTermination()
    assert [(r["case_id"], r["status"]) for r in current_board(spark, board).collect()] == [("email_0", "OK")]
    assert attachment_list(read_messages(spark, path)).count() == 2


def _boxes(spark, words):
    rows = [(d, p, i, float(x0), float(y0), float(x1), float(y1), t) for i, (d, p, x0, y0, x1, y1, t) in enumerate(words)]
    return layout_rows(spark.createDataFrame(rows, "doc_id string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"))


def test_rows_and_values_know_their_boxes(spark):
    """A value in a column of its own, one after a colon on the same line, and one printed below its label."""
    words = [
        ("d", 0, 10, 10, 40, 20, "Load"), ("d", 0, 42, 10.04, 60, 20, "Port"), ("d", 0, 120, 11, 160, 21, "PORT"), ("d", 0, 163, 11, 200, 21.06, "KLANG"),
        ("d", 0, 10, 30, 50, 40, "Shipper:"), ("d", 0, 53, 30, 80, 40, "ACME"), ("d", 0, 83, 30.5, 99, 41, "LTD"),
        ("d", 1, 10, 10, 60, 20, "Consignee:"), ("d", 1, 10, 25, 40, 35, "BUYER"), ("d", 1, 43, 25, 60, 35, "LLC"),
    ]
    rows = _boxes(spark, words)
    first = rows.where("row_index = 0").select("loc.*", "value_loc.bbox").collect()[0]
    assert (first[0], first[1], first[3], first[5]) == ("bbox", 0, [10.0, 10.0, 200.0, 21.1], [120.0, 11.0, 200.0, 21.1])
    got = {r["field"]: (r["raw"], r["loc"]["page"], r["loc"]["bbox"]) for r in collect_continuations(split_rows(rows)).collect()}
    assert got == {
        "port_of_loading": ("PORT KLANG", 0, [120.0, 11.0, 200.0, 21.1]),
        "shipper": ("ACME LTD", 0, [53.0, 30.0, 99.0, 41.0]),
        "consignee": ("BUYER LLC", 1, [10.0, 25.0, 60.0, 35.0]),
    }


def test_values_know_their_line_and_characters(spark):
    text = "Shipper:  ACME LTD | UNIT 4  \n  LINE 1\n\nNotify:\n\n  BUYER LLC\nPOD:\n"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = {r["field"]: r for r in collect_continuations(split_rows(docs_to_rows(docs))).collect()}
    lines = text.split("\n")
    for field, line, raw in (("shipper", 1, "ACME LTD"), ("notify_party", 6, "BUYER LLC")):
        r = got[field]
        assert (r["loc"]["kind"], r["loc"]["line"], r["raw"]) == ("line", line, raw) and lines[line - 1][r["start"] : r["stop"]] == raw
    assert (got["port_of_discharge"]["loc"]["line"], got["port_of_discharge"]["start"], got["port_of_discharge"]["stop"]) == (7, None, None)


def test_supplied_places_are_kept(spark):
    """Rows of a sheet bring their cells; rows without places give null ones."""
    row = "doc_id string, row_index int, text_no int, text string, label string, value string, indent boolean"
    cell = location("cell", ref=F.lit("Form!A2"))
    df = spark.createDataFrame([("s", 0, 0, "Shipper   ACME LTD", "Shipper", "ACME LTD", False)], row)
    with_cells = df.withColumns({"loc": cell, "value_loc": location("cell", ref=F.lit("Form!B2"))})
    assert [r["loc"]["ref"] for r in collect_continuations(split_rows(with_cells)).collect()] == ["Form!B2"]
    assert [(r["raw"], r["loc"], r["start"]) for r in collect_continuations(split_rows(df)).collect()] == [("ACME LTD", None, 10)]
