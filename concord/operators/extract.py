"""Documents to fields: lines, titles, labels, values.

`doc_rows` is long: doc_id, row_index (from 0), text_no (from 0 among non-blank rows, null for blank ones), text,
label, value, indent, and where known the row's place in its file: loc, value_loc, words (see `LOCATION`). A document may be very long, so nothing here groups a whole document into one task: rows are
windowed in blocks of `BLOCK` rows that carry the few rows after them as a halo.

A text document has all its rows in its own text, so `docs_to_rows(whole=True)` keeps them together, as `rows` of one row per
document, and the steps up to the best values work inside it: no row is sent anywhere. That holds for documents of an id of
their own; those that share one (`alone` is false) are read as one document, so their rows take the long way.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord import specs
from concord.functions.lookup import look_up_in
from concord.functions.regex import LINES, NOCASE, NOCASE_LINES, PLAIN, extract, first_of, folded, guarded, guarded_in, let, look_up, matches, needed_literals, strip, sub
from concord.functions.text import file_stem
from concord.functions.values import is_blank, normalise_label
from concord.operators.knowledge import active_aliases
from concord.session import as_table, new_run_dir

BLOCK = 1024
#: So many learned label names at most are looked up inside a document; more of them are joined.
FEW_ALIASES = 1_000
ROWS_AHEAD = specs.MAX_VALUE_LINES
#: Where something stands in its file. `kind` says which parts are set: line (from 1), bbox (page, box x0 y0 x1 y1), cell
#: (ref is `sheet!B4`), paragraph or table (ref is its number, for a table `number/row`).
LOCATION = "struct<kind:string,page:int,line:int,bbox:array<double>,ref:string>"
#: Words of a row on a page, from left to right; `at` counts the characters of the row's words before, blanks left out.
WORDS = "array<struct<at:bigint,text:string,x0:double,y0:double,x1:double,y1:double>>"


def location(kind: str, *, page: Column | None = None, line: Column | None = None, bbox: Column | None = None, ref: Column | None = None) -> Column:
    """A LOCATION with the parts that are known."""
    parts = {"kind": (F.lit(kind), "string"), "page": (page, "int"), "line": (line, "int"), "bbox": (bbox, "array<double>"), "ref": (ref, "string")}
    return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in parts.items()])


def box_around(words: Column) -> Column:
    """The smallest box around some words, rounded to tenths."""

    def each(name: str) -> Column:
        return F.transform(words, lambda w: w[name])

    return F.array(*[F.round(c, 1) for c in (F.array_min(each("x0")), F.array_min(each("y0")), F.array_max(each("x1")), F.array_max(each("y1")))])


def value_box(words: Column, value: Column, loc: Column) -> Column:
    """Place of the words at the end of a row that make up its value, blanks aside; null where no word starts there."""
    want = F.regexp_replace(value, r"(?U)\s+", "")
    row = F.regexp_replace(F.array_join(F.transform(words, lambda w: w["text"]), ""), r"(?U)\s+", "")
    start = F.length(row) - F.length(want)
    tail = F.filter(words, lambda w: w["at"] >= start)
    fits = (want != "") & F.endswith(row, want) & F.exists(words, lambda w: w["at"] == start)
    return F.when(fits, location("bbox", page=loc["page"], bbox=box_around(tail)))


def _with_places(doc_rows: DataFrame) -> DataFrame:
    """Rows from a source that does not know places have null ones."""
    missing = {n: F.lit(None).cast(t) for n, t in (("loc", LOCATION), ("value_loc", LOCATION), ("words", WORDS)) if n not in doc_rows.columns}
    return doc_rows.withColumns(missing) if missing else doc_rows


# ---------------------------------------------------------------- S3, T6: text to rows, document type


def read_state(text: Column) -> Column:
    """S3: why a text document cannot be read, null when it can."""
    signs = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]"
    # looked for sign by sign first: a class of single ASCII characters is one table, while ranges are tested one by one
    single = "[" + "".join(f"\\x{i:02x}" for i in range(32) if i not in (9, 10, 13)) + "]"
    some = F.contains(text, F.lit("�")) | text.rlike(single)
    odd = F.when(some, F.length(text) - F.length(F.regexp_replace(text, signs, ""))).otherwise(F.lit(0))
    return first_of(
        [
            (text.isNull() | ~text.rlike(r"(?U)\S"), F.lit("nothing is written in it")),
            (odd > 0.10 * F.length(text), F.lit("too many of its characters are no text")),
        ]
    )


def _right_trimmed(whole: Column) -> Column:
    """White space before every line end dropped, in one pass over the text. The class of all white space costs several tests
    a character; a text of ASCII alone, where it is these five, takes a class that is one table."""
    ascii_only = F.length(whole) == F.octet_length(whole)
    return F.when(ascii_only, sub(whole, r"[\t\x0b\f\r ]+$", "", "(?dm)")).otherwise(sub(whole, r"[^\S\n]+$", "", LINES))


def _repeated_ids(docs: DataFrame) -> DataFrame | None:
    """Hashes (`_id`) of the ids that several documents share, as a table of the run; none where every id stands alone. A hash
    that two ids share only sends both the long way."""
    ids = docs.groupBy(F.xxhash64("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    found = as_table(ids, new_run_dir(docs.sparkSession), "repeated_ids")
    return None if found.isEmpty() else found


def docs_to_rows(docs: DataFrame, text: str = "text", *, whole: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """S3: numbered, right-trimmed lines of every readable document, straight from each document's own row.

    With `whole` one row per document: its rows that are not blank as `rows`, and `alone` where some ids are shared. `ids` is
    a table with the doc_id of all documents, where there is one that is cheaper to read than they are.
    """
    lines = F.split(_right_trimmed(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))), "\n")
    if whole:
        repeated = _repeated_ids((docs if ids is None else ids).select("doc_id"))
        readable = docs.where(read_state(F.col(text)).isNull())
        numbered = F.transform(lines, lambda line, i: F.struct(i.alias("row_index"), line.alias("text")))
        rows = F.filter(numbered, lambda r: r["text"] != "").alias("rows")
        if repeated is None:
            return readable.select("doc_id", rows)
        marked = readable.withColumn("_probe", F.xxhash64("doc_id")).join(repeated, F.col("_probe") == F.col("_id"), "left")
        return marked.select("doc_id", F.col("_id").isNull().alias("alone"), rows)
    numbered = docs.where(read_state(F.col(text)).isNull()).select("doc_id", lines.alias("_lines")).select("doc_id", _numbered(F.col("_lines")).alias("rows"))
    # a split text has a row at least; the plain inline would make Spark number every text once more to drop empty ones
    return numbered.select("doc_id", F.inline_outer("rows")).select(
        "doc_id", "row_index", "text_no", "text", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value"),
        _indented(F.col("text")).alias("indent"),
        location("line", line=F.col("row_index") + 1).alias("loc"),
    )


def _indented(text: Column) -> Column:
    return matches(text, r"^(\s{2,}|\t)\S", PLAIN)


def _parted(whole: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents of an id of their own, and those that share one."""
    return (whole.where("alone").drop("alone"), whole.where(~F.col("alone")).drop("alone")) if "alone" in whole.columns else (whole, None)


def _as_rows(whole: DataFrame) -> DataFrame:
    """Whole documents as long rows, without the blank ones."""
    rows = whole.select("doc_id", F.posexplode_outer("rows").alias("text_no", "r")).where(F.col("r").isNotNull()).select("doc_id", "text_no", "r.*")
    null = F.lit(None).cast("string")
    return rows.select(
        "doc_id", "row_index", "text_no", "text", null.alias("label"), null.alias("value"), _indented(F.col("text")).alias("indent"),
        location("line", line=F.col("row_index") + 1).alias("loc"),
    )


def _numbered(lines: Column) -> Column:
    """array<struct(row_index, text_no, text)>; the non-blank number comes from positions, not from a fold."""
    rows = F.transform(lines, lambda line, i: F.struct(i.alias("row_index"), line.alias("text")))
    full = F.transform(F.filter(rows, lambda r: r["text"] != ""), lambda r, n: F.struct(r["row_index"].alias("row_index"), n.alias("text_no"), r["text"].alias("text")))
    empty = F.transform(F.filter(rows, lambda r: r["text"] == ""), lambda r: F.struct(r["row_index"].alias("row_index"), F.lit(None).cast("int").alias("text_no"), r["text"].alias("text")))
    return F.concat(full, empty)


def number_rows(doc_rows: DataFrame) -> DataFrame:
    """Add `text_no` to rows that come without it, by a two-level count that never sorts a whole document.

    Non-blank rows are counted per block, the block counts are summed up per document (one row per BLOCK rows),
    and rows are numbered inside their block.
    """
    rows = doc_rows.withColumn("_block", F.floor(F.col("row_index") / BLOCK)).withColumn("_full", (F.trim("text") != "").cast("int"))
    sizes = rows.groupBy("doc_id", "_block").agg(F.sum("_full").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("doc_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("_full").over(W.partitionBy("doc_id", "_block").orderBy("row_index"))
    return (
        rows.withColumn("_in", inside)
        .join(before, ["doc_id", "_block"])
        .withColumn("text_no", F.when(F.col("_full") == 1, (F.col("_before") + F.col("_in") - 1).cast("int")))
        .drop("_block", "_full", "_in", "_before")
    )


TITLE = "struct<type:string,subtype:string>"


def _title_hit(text: Column, low: Column) -> Column:
    """struct(type, subtype) of the first title pattern that matches, in test order; `low` is the folded text."""
    return first_of(
        [
            (guarded_in(low, text, pattern, NOCASE_LINES), F.struct(F.lit(kind).alias("type"), F.lit(sub_kind).cast("string").alias("subtype")))
            for kind, sub_kind, pattern in specs.TITLE_PATTERNS
        ]
    )


def detect_doc_type(
    docs: DataFrame, doc_rows: DataFrame | None = None, text: str = "text", *, title_rows: int = specs.TITLE_ROWS, title_chars: int = specs.TITLE_MAX_CHARS
) -> DataFrame:
    """Add type, subtype, type_confidence.

    The title is looked for in the first `title_rows` non-blank rows of at most `title_chars` characters (which define
    what a title is), then in the whole body, then in the file name. With a text column all three are read off the document's own row; documents known only as rows pass
    `doc_rows`, of which just the first rows of each document are used.
    """
    if doc_rows is None:
        lines = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")
        heads = F.slice(F.filter(lines, lambda line: line.rlike(r"(?U)\S")), 1, title_rows)
        df = docs.withColumn("_heads", F.transform(heads, lambda line: sub(line, r"\s+$", "")))
        body = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"(?m)[^\S\n]+$", "")
        in_body = let(body, lambda t: let(folded(t), lambda low: _title_hit(t, low)))
    else:
        # titles stand on one row, so the body is tested row by row: per document only the first rows and the first hit of
        # each title pattern are gathered, and the pattern that comes first in the list wins as in a whole text
        hits = F.array(*[F.when(matches(F.col("text"), p, NOCASE_LINES), F.struct(F.lit(i).alias("i"), F.lit(k).alias("type"), F.lit(s).cast("string").alias("subtype"))) for i, (k, s, p) in enumerate(specs.TITLE_PATTERNS)])
        parts = doc_rows.withColumn("_t", F.array_min(F.array_compact(hits))).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("text_no") < title_rows, F.struct("row_index", "text")))).alias("_h"), F.min("_t").alias("_b")
        )
        df = docs.join(parts, "doc_id", "left").withColumn("_heads", F.transform("_h", lambda r: r["text"]))
        in_body = F.struct("_b.type", "_b.subtype")

    def title(head: Column) -> Column:
        return let(F.regexp_extract(head, r"(?sU)^(.*?)(\s{3,}|$)", 1), lambda t: let(folded(t), lambda low: _title_hit(t, low)))

    # the first hit ends the search: rows after it are not tested
    found = F.aggregate("_heads", F.lit(None).cast(TITLE), lambda hit, h: F.coalesce(hit, F.when(F.length(h) <= title_chars, title(h))))
    df = df.withColumn("_title", found)
    df = df.withColumn("_in_body", F.when(F.col("_title").isNull(), in_body if doc_rows is None else F.when(F.col("_b").isNotNull(), in_body)))
    stem = file_stem(F.col("name"))
    by_name = first_of([(matches(stem, specs.SI_FILE_NAME), F.lit("SI")), (matches(stem, specs.BL_FILE_NAME), F.lit("BL"))])
    readable = read_state(F.col(text)).isNull() if doc_rows is None else F.coalesce("readable", F.lit(True))
    kind = F.coalesce("_title.type", "_in_body.type", by_name, F.lit("UNKNOWN"))
    confidence = first_of([(F.col("_title").isNotNull(), F.lit(0.97)), (F.col("_in_body").isNotNull(), F.lit(0.75)), (by_name.isNotNull(), F.lit(0.5))], F.lit(0.2))
    return (
        df.withColumn("type", F.when(readable, kind))
        .withColumn("subtype", F.when(readable, F.coalesce("_title.subtype", "_in_body.subtype")))
        .withColumn("type_confidence", F.when(readable, confidence))
        .drop("_heads", "_h", "_b", "_title", "_in_body")
    )


# ---------------------------------------------------------------- E1, E2: labels


def match_label(df: DataFrame, label: str, out: str, aliases: DataFrame | None = None, spread: str | None = None) -> DataFrame:
    """Add `out` = struct(field, confidence) for a column of labels as written.

    The normal form is a column of its own before the ordered tests use it; learned label names are looked up by it.
    """
    text = F.col(label)
    df = df.withColumn("_norm", normalise_label(text))
    if aliases is not None:
        df = look_up_in(df, F.nullif(F.col("_norm"), F.lit("")), aliases, "key", "value", "_alias", spread)
    else:
        df = df.withColumn("_alias", F.lit(None).cast("string"))
    norm, squashed = F.col("_norm"), F.col("_squashed")
    df = df.withColumn("_squashed", F.replace(norm, F.lit(" "), F.lit("")))
    df = df.withColumn("_rule", _label_rule(text, norm, squashed, F.col("_alias")))
    return df.withColumn(out, _label_hit(text, norm, F.col("_alias"), F.col("_rule"))).drop("_norm", "_alias", "_squashed", "_rule")


def _usable(text: Column, norm: Column) -> Column:
    return text.isNotNull() & (text != "") & (F.length(text) <= specs.MAX_LABEL_CHARS) & (norm != "")


def _label_rule(text: Column, norm: Column, squashed: Column, alias: Column) -> Column:
    """struct(field, squashed): what the fixed lists say of a label; the squashed names are tried where no rule fits."""
    # both lists stand in a lambda: compiled into one method with the rest of the row they are too long for the JIT
    by_rule = first_of([(guarded_in(norm, norm, pattern, ""), F.lit(field)) for field, pattern in specs.LABEL_RULES])

    def by_squash(s: Column) -> Column:
        return first_of([((s == key) | (F.startswith(s, F.lit(key)) & (F.length(s) <= len(key) + 6)), F.lit(field)) for key, field in specs.SQUASHED_LABELS])

    said = let(by_rule, lambda field: F.struct(field.alias("field"), F.when(field.isNull(), let(squashed, by_squash)).alias("squashed")))
    return F.when(alias.isNull() & _usable(text, norm) & ~guarded_in(norm, norm, specs.NOT_A_FIELD, ""), said)


def _label_hit(text: Column, norm: Column, alias: Column, rule: Column) -> Column:
    """struct(field, confidence) of a label: the weight sign, a learned name, the rules, the squashed names."""
    by_weight_sign = F.contains(text, F.lit(specs.GROSS_WEIGHT_CJK)) & (F.length(text) <= specs.MAX_LABEL_CHARS)
    sure = F.when(F.size(F.split(norm, " ")) <= 7, F.lit(0.98)).otherwise(F.lit(0.8))

    def hit(field: Column, confidence: Column) -> Column:
        return F.struct(field.alias("field"), confidence.alias("confidence"))

    tests = [
        (by_weight_sign, hit(F.lit("gross_weight_kg"), F.lit(0.97))),
        (alias.isNotNull() & _usable(text, norm), hit(alias, F.lit(0.95))),
        (rule["field"].isNotNull(), hit(rule["field"], sure)),
        (rule["squashed"].isNotNull(), hit(rule["squashed"], F.lit(0.85))),
    ]
    return first_of(tests, hit(F.lit(None).cast("string"), F.lit(0.0)))


COLON_ROW = r"^\s*([^:：]{1,70})[:：](.*)$"


def _glued_pattern(words: str) -> str:
    return rf"^\s*({words})(?![a-z])((?:\s*\([^)]*\))*)\s*[:：]?\s*(.*)$"


def _glued(text: Column) -> Column:
    """The field a row starts with the label of, without a colon."""

    def tests(low: Column) -> Column:
        # most rows start with no label at all: one pattern of all of them goes before the single ones
        some = guarded_in(low, text, _glued_pattern("|".join(words for _, words in specs.GLUED_LABELS)))
        which = first_of([(guarded_in(low, text, _glued_pattern(words)), F.lit(field)) for field, words in specs.GLUED_LABELS])
        return F.when(some & ~normalise_label(F.left(text, F.lit(40))).rlike(specs.NOT_A_FIELD), which)

    return let(folded(text), tests)


def _glued_parts(text: Column, field: Column) -> Column:
    """The parts of a glued row, cut by the pattern of the field it was recognised as."""
    cut = [first_of([(field == name, F.regexp_extract(text, NOCASE + _glued_pattern(words), i)) for name, words in specs.GLUED_LABELS]) for i in (1, 2, 3)]
    return F.struct(*[c.alias(f"g{i}") for i, c in enumerate(cut, 1)])


def _has_colon(text: Column) -> Column:
    return F.contains(text, F.lit(":")) | F.contains(text, F.lit("："))


def split_rows(doc_rows: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Add field, field_label, field_value, confidence, method to every row: cell pair, `label: value`, glued label.

    Whole documents get them in `rows`, and `indent` with them; with more learned names than `FEW_ALIASES` they become long rows."""
    aliases = None if knowledge is None else active_aliases(knowledge, "label_alias")
    if "rows" in doc_rows.columns:
        few = [] if aliases is None else aliases.limit(FEW_ALIASES + 1).collect()
        if len(few) > FEW_ALIASES:
            return split_rows(_as_rows(doc_rows), knowledge)
        return doc_rows.withColumn("rows", F.transform("rows", lambda r: _split_text(r["row_index"], r["text"], _name_lookup(few))))
    df = doc_rows.withColumn("_cell", F.regexp_replace("label", "[:： ]+$", "")).withColumn("_spread", F.concat("doc_id", F.lit(":"), "row_index"))
    df = df.withColumn("_before", F.when(_has_colon(F.col("text")), F.regexp_extract("text", PLAIN + COLON_ROW, 1))).withColumn("_before", F.when(F.col("_before") != "", F.col("_before")))
    df = match_label(match_label(df, "_cell", "_c", aliases, "_spread"), "_before", "_t", aliases, "_spread")
    direct = F.col("_c.field").isNotNull() | F.col("_t.field").isNotNull()
    df = df.withColumn("_g", F.when(~direct, _glued(F.col("text"))))
    df = df.withColumn("_p", F.when(F.col("_g").isNotNull(), let(F.col("_g"), lambda field: _glued_parts(F.col("text"), field))))
    in_cell, in_text, in_glue = F.col("_c.field").isNotNull(), F.col("_t.field").isNotNull(), F.col("_g").isNotNull()
    return df.select(
        *doc_rows.columns,
        F.coalesce("_c.field", "_t.field", "_g").alias("field"),
        first_of([(in_cell, F.col("_cell")), (in_text, strip(F.col("_before")))], strip(F.concat("_p.g1", "_p.g2"))).alias("field_label"),
        first_of([(in_cell, strip(F.coalesce("value", F.lit("")))), (in_text, strip(F.regexp_extract("text", PLAIN + COLON_ROW, 2)))], strip(F.col("_p.g3"))).alias("field_value"),
        first_of([(in_cell, F.col("_c.confidence")), (in_text, F.col("_t.confidence")), (in_glue, F.lit(0.92))]).alias("confidence"),
        first_of([(in_cell | in_text, F.lit("rule")), (in_glue, F.lit("prefix"))]).alias("method"),
    )


def _name_lookup(aliases: list) -> Callable[[Column], Column]:
    """The learned field of a normal form, from a fixed list in buckets by checksum."""
    if not aliases:
        return lambda norm: F.lit(None).cast("string")
    n = len(aliases) // 4 + 1
    held: list[list] = [[] for _ in range(n)]
    for a in aliases:
        if a["key"]:
            held[zlib.crc32(a["key"].encode()) % n].append(a)
    none = F.array().cast("array<struct<key:string,value:string>>")
    buckets = F.array(*[F.array(*[F.struct(F.lit(a["key"]).alias("key"), F.lit(a["value"]).cast("string").alias("value")) for a in b]) if b else none for b in held])
    return lambda norm: F.get(F.filter(F.get(buckets, F.pmod(F.crc32(norm), F.lit(n)).cast("int")), lambda e: e["key"] == norm), F.lit(0))["value"]


def _plain_ends(text: Column) -> Column:
    """Whether a text starts and ends with a visible ASCII character, so that nothing is there to trim."""
    return F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)


def _trimmed(text: Column) -> Column:
    """`strip`, with the pattern run only where something may be trimmed."""
    return let(text, lambda t: F.when(_plain_ends(t), t).otherwise(strip(t)))


def _split_text(row_index: Column, text: Column, learned: Callable[[Column], Column]) -> Column:
    """struct(row_index, text, indent, hit): what `split_rows` says of a row that is known by its text alone; `hit` is null
    where it says nothing."""

    def hit(field: Column, label: Column, value: Column, confidence: Column, method: str) -> Column:
        return F.struct(field.alias("field"), label.alias("field_label"), value.alias("field_value"), confidence.alias("confidence"), F.lit(method).alias("method"))

    def labelled(before: Column) -> Column:
        def known(norm: Column) -> Column:
            return let(learned(norm), lambda alias: let(_label_rule(before, norm, F.replace(norm, F.lit(" "), F.lit("")), alias), lambda rule: _label_hit(before, norm, alias, rule)))

        def found(t: Column) -> Column:
            return F.when(t["field"].isNotNull(), hit(t["field"], _trimmed(before), _trimmed(F.regexp_extract(text, PLAIN + COLON_ROW, 2)), t["confidence"], "rule"))

        return F.when(before != "", let(let(normalise_label(before), known), found))

    def glued(field: Column) -> Column:
        def parts(p: Column) -> Column:
            return hit(field, strip(F.concat(p["g1"], p["g2"])), strip(p["g3"]), F.lit(0.92), "prefix")

        return F.when(field.isNotNull(), let(_glued_parts(text, field), parts))

    by_colon = F.when(_has_colon(text), let(F.regexp_extract(text, PLAIN + COLON_ROW, 1), labelled))
    indent = F.when(F.ascii(text).between(33, 126), F.lit(False)).otherwise(_indented(text))
    return F.struct(row_index.alias("row_index"), text.alias("text"), indent.alias("indent"), F.coalesce(by_colon, let(_glued(text), glued)).alias("hit"))


# ---------------------------------------------------------------- E3, E4, E5: values


LABEL_LIKE = r"^\s*[A-Za-z][^:：]{0,45}[:：]"


def collect_continuations(split: DataFrame, whole: bool = False) -> DataFrame:
    """One candidate per labelled row, with the value lines that follow it.

    Lines follow while they are indented; one unindented line may open the value when the label had none and the
    line does not look like a label; a blank row ends a started value; eight lines at most (the size of an address
    block). Only non-blank rows are kept, in blocks of BLOCK with the next eight as a halo, so the window of a block
    never exceeds BLOCK + 8 rows however long the document is. In a whole document the next eight are a slice of its rows;
    with `whole` the candidates of documents of an id of their own stay together, as `found`.

    `loc` is the place of the value: its own cells or words where they are known, else the row that holds its first line
    (the label's row when there is none). `start` and `stop` are the code points of `raw` in that row's text (from 0, end
    exclusive), null where the row spells the value differently or there is none.
    """
    if "rows" in split.columns:
        own, shared = _parted(split)
        found = own.withColumn("found", let(F.col("rows"), _found_in))
        if whole:
            return found
        candidates = found.select("doc_id", F.inline_outer("found")).where(F.col("field").isNotNull())
        return candidates if shared is None else candidates.unionByName(collect_continuations(_split_as_rows(shared)))
    split = _with_places(split)
    looks = F.col("field").isNotNull() | F.when(F.col("label").isNotNull() & ~F.col("indent"), F.length("label") <= 45).otherwise(
        matches(F.col("text"), LABEL_LIKE, PLAIN) & ~F.col("indent")
    )
    rows = split.where(F.col("text_no").isNotNull()).withColumn("_looks", looks)
    home = F.floor(F.col("text_no") / BLOCK)
    halo = F.when((F.col("text_no") % BLOCK < ROWS_AHEAD) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    blocks = rows.withColumn("_home", home).withColumn("_block", F.explode(halo))
    ahead = W.partitionBy("doc_id", "_block").orderBy("text_no").rowsBetween(1, ROWS_AHEAD)
    following = F.collect_list(F.struct("row_index", "text", "indent", F.col("_looks").alias("looks"), "loc")).over(ahead)
    labelled = blocks.withColumn("_next", following).where((F.col("_home") == F.col("_block")) & F.col("field").isNotNull() & ~F.col("indent"))
    place = F.coalesce("value_loc", value_box(F.col("words"), F.col("field_value"), F.col("loc")))
    row = {c: F.col(c) for c in labelled.columns}
    df = labelled.select("doc_id", _value_of(row, F.col("_next"), lambda n: n["looks"], lambda below: F.coalesce(place, below["loc"], F.col("loc"))).alias("_v"))
    return df.select("doc_id", "_v.*")


def _split_as_rows(whole: DataFrame) -> DataFrame:
    """Whole documents after `split_rows` as long rows, without the blank ones."""
    plain = whole.select("doc_id", F.posexplode_outer("rows").alias("text_no", "r")).where(F.col("r").isNotNull())
    null = F.lit(None).cast("string")
    return plain.select("doc_id", "r.row_index", "text_no", "r.text", null.alias("label"), null.alias("value"), "r.indent", location("line", line=F.col("r.row_index") + 1).alias("loc"), "r.hit.*")


def _found_in(rows: Column) -> Column:
    """The candidates of a whole document, an array in the order of its rows."""
    labelled = F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: x["r"]["hit"].isNotNull() & ~x["r"]["indent"])

    def looks(n: Column) -> Column:
        return n["hit"].isNotNull() | (~n["indent"] & matches(n["text"], LABEL_LIKE, PLAIN))

    def candidate(x: Column) -> Column:
        own, hit = x["r"], x["r"]["hit"]
        row = {c: own[c] for c in ("row_index", "text")} | {c: hit[c] for c in ("field", "field_label", "field_value", "confidence", "method")}
        return _value_of(row, F.slice(rows, x["i"] + 2, ROWS_AHEAD), looks, lambda below: location("line", line=F.coalesce(below["row_index"], own["row_index"]) + 1))

    return F.transform(labelled, candidate)


def _value_of(row: dict[str, Column], following: Column, looks: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """The candidate of a labelled row with its following rows; `place` is the value's place by the row below that opens it."""
    given = row["field_value"]
    start = F.struct(
        F.when(given != "", F.array(given)).otherwise(F.array().cast("array<string>")).alias("lines"),
        F.lit(False).alias("stopped"),
        row["row_index"].alias("at"),
        row["row_index"].alias("previous"),
    )

    def step(acc: Column, nxt: Column) -> Column:
        started = F.size(acc["lines"]) > 0
        gap = nxt["row_index"] > acc["previous"] + 1
        takes = ~acc["stopped"] & (F.size(acc["lines"]) < specs.MAX_VALUE_LINES) & ~(started & gap) & (nxt["indent"] | (~started & ~looks(nxt)))
        return F.struct(
            F.when(takes, F.concat(acc["lines"], F.array(_trimmed(nxt["text"])))).otherwise(acc["lines"]).alias("lines"),
            (acc["stopped"] | ~takes).alias("stopped"),
            F.when(takes & ~started, nxt["row_index"]).otherwise(acc["at"]).alias("at"),
            nxt["row_index"].alias("previous"),
        )

    def gathered(rows: Column) -> Column:
        # most values end on their own row: where the next row is not taken, none is
        first = F.get(rows, F.lit(0))
        takes = F.when(given != "", first["indent"] & (first["row_index"] <= row["row_index"] + 1)).otherwise(first["indent"] | ~looks(first))
        return F.when(takes, F.aggregate(rows, start, step)).otherwise(start)

    def raw_of(full: Column) -> Column:
        cut = F.when(F.contains(full, F.lit("\n")) | F.contains(full, F.lit("|")), F.regexp_extract(full, r"(?sU)^(.*?)(\n|\s+\|\s+|$)", 1)).otherwise(full)
        return F.when((given != "") & ~row["field"].isin(specs.PARTY_FIELDS), given).otherwise(_trimmed(cut))

    def said_at(v: Column, full: Column, raw: Column, below: Column) -> Column:
        held = F.coalesce(below["text"], row["text"])
        said = F.when(below.isNull(), given).otherwise(_trimmed(below["text"]))
        begin = let(held, lambda h: let(said, lambda s: F.when((raw != "") & F.endswith(h, s) & F.startswith(s, raw), F.length(h) - F.length(s))))
        return let(begin, lambda begin: candidate(v, full, raw, below, begin))

    def candidate(v: Column, full: Column, raw: Column, below: Column, begin: Column) -> Column:
        return F.struct(
            row["field"].alias("field"),
            F.nullif(raw, F.lit("")).alias("raw"),
            F.nullif(full, F.lit("")).alias("full"),
            row["field_label"].alias("label"),
            v["at"].alias("row_index"),
            row["row_index"].alias("label_row"),
            row["confidence"].alias("confidence"),
            row["method"].alias("method"),
            is_blank(raw).alias("blank"),
            place(below).alias("loc"),
            begin.alias("start"),
            (begin + F.length(raw)).alias("stop"),
        )

    def of(rows: Column) -> Column:
        def with_lines(v: Column) -> Column:
            below = F.get(F.filter(rows, lambda n: n["row_index"] == v["at"]), F.lit(0))
            return let(F.array_join(v["lines"], "\n"), lambda full: let(raw_of(full), lambda raw: let(below, lambda b: said_at(v, full, raw, b))))

        return let(gathered(rows), with_lines)

    return let(following, of)


def cap_ocr_confidence(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """E5: values of scanned documents are only as sure as the scan."""
    scans = _scans(docs)
    df = candidates.join(scans, "doc_id", "left")
    if "found" in candidates.columns:
        def capped(c: Column) -> Column:
            sure, how = F.round(c["confidence"] * F.col("_cap"), 3), F.lit("ocr")
            return c.withField("confidence", sure).withField("method", how)

        return df.withColumn("found", F.when(F.col("_scan"), F.transform("found", capped)).otherwise(F.col("found"))).drop("_scan", "_cap")
    return (
        df.withColumn("confidence", F.when(F.col("_scan"), F.round(F.col("confidence") * F.col("_cap"), 3)).otherwise(F.col("confidence")))
        .withColumn("method", F.when(F.col("_scan"), F.lit("ocr")).otherwise(F.col("method")))
        .drop("_scan", "_cap")
    )


def _scans(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("method") == "ocr").select("doc_id", F.lit(True).alias("_scan"), F.least(F.lit(0.9), F.coalesce(F.nullif("ocr_confidence", F.lit(0.0)), F.lit(0.5))).alias("_cap"))


def _is_total(field: Column, label: Column) -> Column:
    return (field == "gross_weight_kg") & matches(F.coalesce(label, F.lit("")), r"\btotal\b")


def best_candidate(candidates: DataFrame, around: tuple[int, int] | None = None) -> DataFrame:
    """One value per document and field: filled before blank, a weight labelled total first, then first in the document.

    Candidates that stand together in their documents (`found`) are sorted there; `around` adds `near` (see `extract_fields`)."""
    kept = ["raw", "full", "label", "row_index", "confidence", "method", "blank", *[c for c in ("loc", "start", "stop") if "found" in candidates.columns or c in candidates.columns]]
    if "found" in candidates.columns:
        def ranked(c: Column) -> Column:
            return F.struct(c["field"].alias("field"), c["blank"].cast("int").alias("blank"), (~_is_total(c["field"], c["label"])).cast("int").alias("other"), c["label_row"].alias("label_row"), c.alias("c"))

        firsts = let(F.sort_array(F.transform("found", ranked)), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["field"] != x["field"])))

        def value(x: Column) -> Column:
            near = [] if around is None else [_near(F.col("rows"), x["c"]["row_index"], *around).alias("near")]
            return F.struct(x["field"].alias("field"), *[x["c"][k].alias(k) for k in kept], *near)

        long = candidates.select("doc_id", F.inline_outer(F.transform(firsts, value)))
        best = long.where(F.col("field").isNotNull())
    else:
        rank = F.struct(F.col("blank").cast("int"), (~_is_total(F.col("field"), F.col("label"))).cast("int"), F.col("label_row"))
        best = candidates.groupBy("doc_id", "field").agg(F.min_by(F.struct(*kept), rank).alias("b")).select("doc_id", "field", "b.*")
    return best.withColumn("confidence", F.when(F.col("blank"), F.least("confidence", F.lit(0.9))).otherwise(F.col("confidence")))


def extract_fields(doc_rows: DataFrame, docs: DataFrame | None = None, knowledge: DataFrame | None = None, *, around: tuple[int, int] | None = None) -> DataFrame:
    """The fields of every document, long.

    With `around` the values of whole documents bring along, as `near`, the rows that stand so many lines before and after
    at most; it is null for documents that share their id.
    """
    split = split_rows(doc_rows, knowledge)
    scanned = docs is not None and "ocr_confidence" in docs.columns
    if "rows" not in split.columns:
        found = collect_continuations(split)
        return best_candidate(cap_ocr_confidence(found, docs) if scanned else found)
    found = collect_continuations(split, whole=True)
    if scanned and not _scans(docs).isEmpty():  # without a scan no document is looked up
        found = cap_ocr_confidence(found, docs)
    best = best_candidate(found, around)
    shared = _parted(split)[1]
    if shared is not None:
        rest = collect_continuations(_split_as_rows(shared))
        best = best.unionByName(best_candidate(cap_ocr_confidence(rest, docs) if scanned else rest), allowMissingColumns=True)
    return best


# ---------------------------------------------------------------- E6-E11


def _near(rows: Column, at: Column, before: int, after: int) -> Column:
    """array<struct(row_index, text)> of the rows around a row of a whole document."""
    return F.transform(F.filter(rows, lambda r: r["row_index"].between(at - before, at + after)), lambda r: F.struct(r["row_index"].alias("row_index"), r["text"].alias("text")))


def value_context(values: DataFrame, doc_rows: DataFrame, before: int = 2, after: int = 3) -> DataFrame:
    """The non-blank rows around each value, with a hit flag. The neighbours are spelled out, so this is an equi-join;
    values that brought their neighbours along (`near`, as far as they were asked for) need none."""
    if "near" in values.columns:
        near = F.filter("near", lambda r: r["row_index"].between(F.col("row_index") - before, F.col("row_index") + after))
        own = values.where(F.col("doc_id").isNotNull()).select("doc_id", "field", F.col("row_index").alias("value_row"), F.inline_outer(near)).where(F.col("row_index").isNotNull())
        own = own.select("doc_id", "row_index", "field", "value_row", "text", (F.col("row_index") == F.col("value_row")).alias("hit"))
        shared = _parted(doc_rows)[1]
        return own if shared is None else own.unionByName(value_context(values.where(F.col("near").isNull()).drop("near"), _as_rows(shared), before, after))
    if "rows" in doc_rows.columns:
        doc_rows = _as_rows(doc_rows)
    wanted = values.where(F.col("row_index").isNotNull()).select(
        "doc_id", "field", F.col("row_index").alias("value_row"), F.explode(F.sequence(F.col("row_index") - before, F.col("row_index") + after)).alias("row_index")
    )
    rows = doc_rows.where(F.trim("text") != "").select("doc_id", "row_index", "text")
    return wanted.join(rows, ["doc_id", "row_index"]).withColumn("hit", F.col("row_index") == F.col("value_row"))


def _reference(text: Column, label_pattern: str) -> Column:
    groups = label_pattern.count("(") + 1
    return extract(text, rf"(?:{label_pattern})[^:：A-Za-z0-9]{{0,12}}[:：]?\s*([A-Z0-9][A-Z0-9\-]{{5,}})", groups, NOCASE)


def find_reference(doc_rows: DataFrame, label_pattern: str) -> DataFrame:
    """(doc_id, reference): the first row with a labelled reference number."""
    hits = doc_rows.withColumn("_ref", _reference(F.col("text"), label_pattern)).where(F.col("_ref").isNotNull())
    return hits.groupBy("doc_id").agg(F.min_by("_ref", "row_index").alias("reference"))


def reference_in(text: Column, label_pattern: str) -> Column:
    """E7 on a document's own text column, without taking it apart into rows."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    hits = F.filter(F.transform(F.filter(lines, lambda line: matches(line, label_pattern)), lambda line: _reference(line, label_pattern)), lambda r: r.isNotNull())
    # most documents lack one kind of reference: its literals are looked for in the whole text first
    low = folded(text)
    there = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in sorted(s)]) for s in needed_literals(label_pattern)]
    return F.when(reduce(lambda a, b: a & b, there, F.lit(True)), F.get(hits, F.lit(0)))


def detect_carrier(cases: DataFrame, refs: list[str], texts: list[str], knowledge: DataFrame | None = None) -> DataFrame:
    """Add `carrier` from reference prefixes, `NAME(REF)` in a text, or an unambiguous name.

    `refs` and `texts` name string columns in test order. Fixed prefixes are one CASE chain, longest first; learned
    ones are looked up by every prefix length that occurs among them, which keeps the prefix test an equi-join.
    """
    df = cases
    upper = {r: F.upper(F.col(r)) for r in refs}
    by_ref: list[Column] = []
    learned = None
    if knowledge is not None:
        learned = active_aliases(knowledge, "carrier_prefix")
        lengths = learned.where(F.length("key") > 0).agg(F.collect_set(F.length("key")).alias("n")).scalar()

        def probe(i: int, ref: Column) -> Column:
            fits = F.filter(F.col("_lengths"), lambda n: F.length(ref) >= n)
            return F.transform(fits, lambda n: F.struct(F.lit(i).alias("ref_no"), n.alias("n"), F.left(ref, n).alias("prefix")))

        none = F.array().cast("array<struct<ref_no:int,n:int,prefix:string>>")
        probes = F.explode(F.concat(*[F.coalesce(probe(i, upper[r]), none) for i, r in enumerate(refs)]))
        hits = df.withColumn("_lengths", lengths).select("case_id", probes.alias("p")).select("case_id", "p.*").join(learned, F.col("prefix") == F.col("key"))
        longest = hits.groupBy("case_id", "ref_no").agg(F.max_by(F.struct("n", "value"), "n").alias("hit"))
        picked = longest.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("ref_no", "hit"))).alias("_learned"))
        df = df.join(picked, "case_id", "left")
    for i, r in enumerate(refs):
        fixed = first_of([(F.startswith(upper[r], F.lit(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(name).alias("value")))
                          for p, name in sorted(specs.CARRIER_PREFIXES.items(), key=lambda kv: -len(kv[0]))])
        if learned is None:
            by_ref.append(fixed["value"])
        else:
            own = F.try_element_at(F.col("_learned"), F.lit(i))
            longer = F.coalesce(own["n"], F.lit(0)) >= F.coalesce(fixed["n"], F.lit(0))
            by_ref.append(F.when(longer, own["value"]).otherwise(fixed["value"]))
    ours = F.array_compact(F.array(*upper.values()))
    named: list[Column] = []
    pattern = r"\b([A-Z][A-Z ]{1,12})\(([A-Z0-9]{7,})\)"
    for t in texts:
        text = F.upper(F.coalesce(F.col(t), F.lit("")))
        pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.struct(F.trim(a).alias("name"), b.alias("ref")))
        name = F.get(F.filter(pairs, lambda p: F.array_contains(ours, p["ref"])), F.lit(0))["name"]
        named.append(F.coalesce(look_up(specs.SHORT_CARRIERS, name), F.when(F.length(name) <= 4, name).otherwise(F.initcap(name))))
    plain = [first_of([(F.upper(F.col(t)).rlike(rx), F.lit(name)) for name, rx in specs.CARRIER_NAMES]) for t in texts]
    return df.withColumn("carrier", F.coalesce(*by_ref, *named, *plain)).drop("_learned")


def apply_value_overrides(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """A reviewer's value (case_id, side, field, value) replaces or adds an extracted one."""
    human = overrides.select("case_id", "side", "field", F.col("value").alias("_value"))
    df = values.join(human, ["case_id", "side", "field"], "full")
    given = F.col("_value").isNotNull()
    out = df.withColumn("raw", F.coalesce("_value", "raw")).withColumn("confidence", F.when(given, F.lit(1.0)).otherwise(F.col("confidence")))
    out = out.withColumn("method", F.when(given, F.lit("human")).otherwise(F.col("method"))).withColumn("blank", F.when(given, F.lit(False)).otherwise(F.col("blank")))
    if "full" in values.columns:
        out = out.withColumn("full", F.coalesce("_value", "full"))
    return out.drop("_value")


def verify_grounded(proposals: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """A proposed value (doc_id, field, value) is trusted only where its document holds it word for word.

    Unknown fields and empty values are dropped.
    """
    wanted = proposals.where(F.col("field").isin(specs.FIELDS) & (strip(F.col("value")) != ""))
    df = wanted.join(docs.select("doc_id", F.lower(text).alias("_text")), "doc_id")
    grounded = F.contains("_text", F.lower(strip(F.col("value"))))
    return df.withColumn("grounded", grounded).withColumn("confidence", F.when(grounded, F.lit(0.8)).otherwise(F.lit(0.4))).drop("_text")


def missing_fields(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, field) of every field a document lacks: one aggregate, no join."""
    seen = values.select("doc_id", "field").unionByName(docs.select("doc_id", F.lit(None).cast("string").alias("field")))
    have = seen.groupBy("doc_id").agg(F.collect_set("field").alias("have"), F.bool_or(F.col("field").isNull()).alias("known")).where("known")
    return have.select("doc_id", F.explode(F.array_except(F.array(*[F.lit(f) for f in specs.FIELDS]), "have")).alias("field"))
