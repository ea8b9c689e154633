"""Text preparation: body cleaning, references, names, sentences, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord import specs
from concord.functions.regex import NOCASE, NOCASE_LINES, PLAIN, extract, first_of, look_up, matches, strip, sub


def body_parts(body: Column) -> dict[str, Column]:
    """`banner`, `quoted`, `signature` and `message` of a mail body.

    Every cut is one anchored replacement that mentions its input once, so the plan stays linear even when a filter
    on the message is pushed below the projection.
    """
    whole = F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    head = F.left(whole, F.lit(specs.BANNER_WINDOW))
    first_banner = NOCASE_LINES + r"\A((?s:.*?))" + specs.BANNER_LINE
    rest = F.concat(F.regexp_replace(head, first_banner, "$1"), F.substr(whole, F.lit(specs.BANNER_WINDOW + 1)))
    thread = NOCASE_LINES + specs.QUOTE_START + r"(?s:.*)"
    own = F.regexp_replace(rest, thread, "")
    # a sign-off needs text above it: the part before it starts with white space and one visible character
    closing = NOCASE_LINES + rf"\A((?s:\s*+\S.*?))((?:{specs.SIGN_OFF}|{specs.SIGN_DASHES})(?s:.*))\z"
    text = strip(F.regexp_replace(own, closing, "$1"))
    return {
        "banner": strip(F.regexp_extract(head, NOCASE_LINES + specs.BANNER_LINE, 0)),
        "quoted": strip(F.regexp_extract(rest, thread, 0)),
        "signature": strip(F.regexp_extract(own, closing, 2)),
        "message": strip(sub(text, specs.GREETING, "", NOCASE)),
    }


def clean_body(messages: DataFrame, body: str = "body") -> DataFrame:
    """T1 on a message table."""
    return messages.withColumns(body_parts(F.col(body)))


def snippet(message: Column) -> Column:
    """The first 140 characters on one line (a preview by definition)."""
    return F.left(sub(message, r"\s+", " "), F.lit(140))


def references(subject: Column, message: Column) -> dict[str, Column]:
    """Order, bill-of-lading and invoice number of a message."""
    both = F.concat_ws("\n", F.coalesce(subject, F.lit("")), message)
    return {
        "oc_no": extract(both, specs.ORDER_NO, 1, PLAIN),
        "bl_no": F.coalesce(extract(message, specs.BL_NO_LABELLED, 1, NOCASE), extract(message, specs.BL_NO_BARE, 1, PLAIN)),
        "invoice": extract(both, specs.INVOICE_NO, 1, NOCASE),
    }


def title_case(value: Column, boundary: str = r"\P{L}") -> Column:
    """Upper case after every character of the boundary class, lower case elsewhere (`initcap` only knows blanks)."""
    pieces = F.split(F.lower(value), f"(?<={boundary})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def sender_domain(sender: Column) -> Column:
    return F.substring_index(sender, "@", -1)


def sender_customer(sender: Column) -> Column:
    """T4: customer name from the mail domain, null without an address."""
    name = F.substring_index(sender_domain(F.lower(sender)), ".", 1)
    known = look_up(specs.SENDER_ALIASES, name)
    domain = sender_domain(F.lower(sender))
    return F.when(F.contains(sender, F.lit("@")) & (domain != ""), F.coalesce(known, title_case(F.replace(name, F.lit("-"), F.lit(" ")))))


def greeting_name(sender: Column) -> Column:
    """T5: first name for the salutation, "Team" for role mailboxes."""
    local = F.substring_index(F.coalesce(sender, F.lit("")), "@", 1)
    part = F.substring_index(F.replace(local, F.lit("."), F.lit("_")), "_", 1)
    personal = part.rlike(r"^\p{L}{3,}$") & ~F.lower(part).isin(specs.ROLE_MAILBOXES)
    return F.when(personal, title_case(part)).otherwise(F.lit("Team"))


def file_stem(path: Column) -> Column:
    name = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    return F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")


def filename_role(path: Column) -> Column:
    """SI or BL from the file name."""
    stem = file_stem(path)
    return first_of([(matches(stem, specs.SI_FILE_ROLE), F.lit("SI")), (matches(stem, specs.BL_FILE_ROLE), F.lit("BL"))])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, although lambdas inside the body read it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of sentences. A piece after an abbreviation ("no.", "ref.") of the same line is joined back.

    Linear in the text: the pieces are cut into runs that end at the first piece without an abbreviation, and only
    runs of two pieces or more are folded, each by itself.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")

    def pieces_of(line: Column, no: Column) -> Column:
        cut = F.filter(F.transform(F.split(line, r"(?U)(?<=[.!?])\s+"), strip), lambda p: p != "")
        return F.transform(cut, lambda p: F.struct(no.alias("line"), p.alias("piece"), matches(p, specs.ABBREVIATION).alias("short")))

    def step(acc: Column, p: Column, all_lines: Column) -> Column:
        last = acc["last"]
        joins = last.isNotNull() & F.contains(F.get(all_lines, p["line"]), last)
        return F.struct(
            F.when(joins | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"),
            F.when(joins, F.concat_ws(" ", last, p["piece"])).otherwise(p["piece"]).alias("last"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def folded(run: Column, all_lines: Column) -> Column:
        return F.aggregate(run, start, lambda acc, p: step(acc, p, all_lines), lambda acc: F.concat(acc["done"], F.array(acc["last"])))

    def from_runs(all_lines: Column, pieces: Column, starts: Column) -> Column:
        def run(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(pieces)) - at
            return F.when(n == 1, F.array(F.get(pieces, at)["piece"])).otherwise(folded(F.slice(pieces, at + 1, n), all_lines))

        return F.flatten(F.transform(starts, run))

    def whole(all_lines: Column, pieces: Column) -> Column:
        starts = F.transform(pieces, lambda p, i: F.when((i == 0) | ~F.get(pieces, i - 1)["short"], i))
        return _let(F.array_compact(starts), lambda s: from_runs(all_lines, pieces, s))

    return _let(lines, lambda ls: _let(F.flatten(F.transform(ls, pieces_of)), lambda pieces: whole(ls, pieces)))


def diff_values(a: Column, b: Column) -> Column:
    """struct(same_start, left_part, right_part, same_end): only the middle parts differ."""

    def run(x: Column, y: Column) -> Column:
        equal = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p.eqNullSafe(q))
        at = F.array_position(equal, F.lit(False))
        return F.when(at > 0, (at - 1).cast("int")).otherwise(F.least(F.length(x), F.length(y)))

    start = F.when((a == "") | (b == ""), F.lit(0)).otherwise(run(a, b))
    room = F.least(F.length(a), F.length(b)) - start
    end = F.when(room <= 0, F.lit(0)).otherwise(F.least(run(F.reverse(a), F.reverse(b)), room))
    return F.struct(
        F.left(a, start).alias("same_start"),
        F.substr(a, start + 1, F.length(a) - end - start).alias("left_part"),
        F.substr(b, start + 1, F.length(b) - end - start).alias("right_part"),
        F.right(a, end).alias("same_end"),
    )


def readable_subject(category: Column, carrier: Column, customer: Column, pod: Column, sender: Column, attachments: Column) -> Column:
    """A plain-words subject per category."""

    def filled(c: Column) -> Column:
        return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))

    port = title_case(F.substring_index(F.regexp_replace(pod, r"(?i)^POD\s+", ""), ",", 1), r"[\s\-(]")
    who = F.coalesce(filled(customer), filled(sender))
    to = F.coalesce(F.concat(F.lit(" · going to "), F.when(filled(pod).isNotNull(), port)), F.lit(""))
    from_who = F.coalesce(F.concat(F.lit(" from "), who), F.lit(""))
    line = F.coalesce(F.concat(F.lit("the "), filled(carrier), F.lit(" draft")), F.lit("the draft"))
    asks = F.concat(F.coalesce(who, F.lit("The sender")), F.lit(" is asking for "), line, to)
    checks = F.concat(F.lit("Check "), line, F.coalesce(F.concat(F.lit(" for "), who), F.lit("")), to)
    return first_of(
        [
            ((category == specs.CHECK) & (attachments == 0), asks),
            (category == specs.CHECK, checks),
            (category == "SI_REQUEST", F.concat(F.lit("New shipping instructions"), from_who, to)),
            (category == "INVOICE_QUERY", F.concat(F.lit("Invoice question"), from_who)),
            (category == "GENERAL", F.concat(F.lit("General mail"), from_who)),
            (category == "SPAM", F.concat(F.lit("Junk"), F.coalesce(F.concat(F.lit(" from "), filled(sender)), F.lit("")))),
        ]
    )


def enrich_messages(messages: DataFrame) -> DataFrame:
    """One projection with everything read off a message: parts, snippet, references, customer, salutation."""
    df = clean_body(messages)
    refs = references(F.col("subject"), F.col("message"))
    return df.select(
        "*",
        snippet(F.col("message")).alias("snippet"),
        *[c.alias(name) for name, c in refs.items()],
        sender_customer(F.col("sender")).alias("customer"),
        greeting_name(F.col("sender")).alias("hello"),
    )


def customer_traffic(enriched: DataFrame) -> DataFrame:
    """Messages per customer and how many carry each kind of reference."""
    return enriched.groupBy(F.coalesce("customer", F.lit("Unknown")).alias("customer")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count("oc_no").alias("with_order_no"),
        F.count("bl_no").alias("with_bl_no"),
        F.count("invoice").alias("with_invoice"),
        F.sum(F.length("message")).alias("message_chars"),
    )
