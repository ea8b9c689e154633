"""Standard forms of field values: numbers, weights, counts, ports, parties, labels. Column in, Column out."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord import specs
from concord.functions.regex import NOCASE, PLAIN, extract, first_of, kept, let, look_up, matches, sub

# ---------------------------------------------------------------- folding


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility folding built from the Unicode rule: single-character folds, and the longer ones."""
    source, target, longer = [], [], []
    for low, high in ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x209F), (0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)):
        for point in range(low, high + 1):
            ch = chr(point)
            folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if folded == ch:
                continue
            if len(folded) == 1:
                source.append(ch)
                target.append(folded)
            else:
                longer.append((ch, folded))
    return "".join(source), "".join(target), longer


def ascii_upper(value: Column) -> Column:
    """Compatibility fold, accents dropped, upper case. Plain ASCII skips the fold."""
    source, target, longer = _fold_tables()
    folded = F.translate(sub(value, r"[̀-ͯ]", ""), source, target)
    rare = "[" + "".join(ch for ch, _ in longer) + "]"
    # one fold over a list of "character + expansion" keeps the expression small wherever it is inlined
    listed = F.split(F.lit("\x02".join(ch + text for ch, text in longer)), "\x02")
    expanded = F.aggregate(listed, folded, lambda acc, p: F.replace(acc, F.left(p, F.lit(1)), F.substr(p, F.lit(2))))
    folded = F.when(folded.rlike(rare), expanded).otherwise(folded)
    return F.upper(F.when(value.rlike(r"[^\x00-\x7F]"), folded).otherwise(value))


# ---------------------------------------------------------------- numbers, weights, counts


def _folded(value: Column, folded: Column | None) -> Column:
    return ascii_upper(value) if folded is None else folded


def parse_number(value: Column, dot_thousands: Column | bool = True) -> Column:
    """The first number in a text, whatever its separators."""
    dots = F.lit(dot_thousands) if isinstance(dot_thousands, bool) else dot_thousands
    s = F.regexp_replace(F.regexp_extract(value, r"\d[\d.,\s']*\d|\d", 0), r"[\s']", "")
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    no_dots, no_commas, comma_decimal = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit(","), F.lit("."))
    comma_is_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    grouped = s.rlike(r"^[^,]*(,[^,]{3})+$")
    lone_thousands = dots & s.rlike(r"^\d{1,3}\.\d{3}$") & (F.coalesce(no_dots.try_cast("double"), F.lit(0.0)) >= 1000)
    plain = first_of(
        [
            (comma & dot & comma_is_last, F.replace(no_dots, F.lit(","), F.lit("."))),
            (comma & dot, no_commas),
            (comma & grouped, no_commas),
            (comma, comma_decimal),
            (s.rlike(r"\..*\.") | lone_thousands, no_dots),
        ],
        s,
    )
    return F.nullif(plain, F.lit("")).try_cast("double")


def _unit_factor(text: Column) -> Column:
    return first_of([(matches(text, pattern), F.lit(factor)) for pattern, factor in specs.UNITS_TO_KG])


def weight_kg(value: Column, label: Column | None = None) -> Column:
    """A weight in kg; the unit stands after the number or in the label."""
    label = F.lit("") if label is None else F.coalesce(label, F.lit(""))
    tail = F.regexp_replace(value, r"(?s)^(.*?)[\d.,\s']+", "$1 ")
    factor = F.coalesce(_unit_factor(tail), _unit_factor(label), F.lit(1.0))
    return F.round(parse_number(value, factor == 1.0) * factor, 3)


def container_count(value: Column, folded: Column | None = None) -> Column:
    """struct(count, sizes): sized groups, else a bracketed number, else a bare number, else number words.

    `folded` is ascii_upper(value) where a query has it as a column already; so in the functions below.
    """
    s = F.translate(_folded(value, folded), "×*", "XX")  # digits of every script are 0-9 by then
    groups = F.regexp_extract_all(s, F.lit(specs.SIZED_CONTAINERS), F.lit(0))
    sizes = F.transform(groups, lambda g: F.concat(F.regexp_extract(g, specs.SIZED_CONTAINERS, 2), F.regexp_extract(g, specs.SIZED_CONTAINERS, 3)))
    words = F.filter(F.transform(F.regexp_extract_all(s, F.lit("[A-Z]+"), F.lit(0)), lambda w: look_up(specs.NUMBER_WORDS, w)),
                     lambda n: n.isNotNull())
    single = F.coalesce(extract(s, r"\((\d{1,3})\)", 1, PLAIN), extract(s, specs.BARE_COUNT, 1, PLAIN))
    counted = F.when(F.size(words) > 0, F.aggregate(words, F.lit(0), lambda acc, n: acc + n))
    count = F.when(F.size(groups) > 0, F.aggregate(groups, F.lit(0), lambda acc, g: acc + F.coalesce(F.regexp_extract(g, r"^\d+", 0).try_cast("int"), F.lit(0)))).otherwise(
        F.coalesce(single.try_cast("int"), counted)
    )
    return F.struct(count.alias("count"), F.coalesce(sizes, F.array().cast("array<string>")).alias("sizes"))


# ---------------------------------------------------------------- ports


def port_parts(value: Column, folded: Column | None = None) -> Column:
    """struct(full, city, country, locode) of a port text, before aliases.

    Every step is a value of its own, as written out each part would cut the text again, some thirty patterns in all.
    """

    def country_of(country: Column) -> Column:
        return F.coalesce(look_up(specs.COUNTRY_ALIASES, country), country)

    def city_of(town: Column) -> Column:
        quiet = F.trim(F.regexp_replace(F.regexp_replace(town, specs.PORT_NOISE, " "), " {2,}", " "))
        return let(quiet, lambda q: F.when(q != "", q).otherwise(town))

    def parts(raw: Column, bare: Column, listed: Column) -> Column:
        country = F.when(F.contains(listed, F.lit(",")), F.trim(F.substring_index(listed, ",", -1))).otherwise(F.when(listed.isNotNull(), F.lit("")))
        # the code stands in brackets: a text without any skips the pattern
        locode = F.replace(extract(F.when(F.contains(raw, F.lit("(")), raw), r"\(\s*([A-Z]{2}\s?[A-Z0-9]{3})\s*\)", 1, PLAIN), F.lit(" "), F.lit(""))
        return F.struct(
            kept(bare, "A-Z0-9/").alias("full"),
            let(F.trim(F.substring_index(listed, ",", 1)), city_of).alias("city"),
            let(country, country_of).alias("country"),
            locode.alias("locode"),
        )

    def from_bare(raw: Column, bare: Column) -> Column:
        return let(F.btrim(kept(bare, "A-Z0-9/,"), F.lit(" ,")), lambda listed: parts(raw, bare, listed))

    return let(_folded(value, folded), lambda raw: let(F.regexp_replace(raw, r"(?s)\(.*?\)", " "), lambda bare: from_bare(raw, bare)))


def port_candidates(parts: Column) -> list[Column]:
    """The names an alias may be known under, most specific first."""
    return [parts["full"], parts["city"], F.concat(F.lit("PORT "), parts["city"])]


def port_key(parts: Column, learned: list[Column] | None = None) -> Column:
    """The comparable port name. `learned` holds looked-up aliases for the candidates and wins over the fixed ones."""
    found = []
    for i, name in enumerate(port_candidates(parts)):
        if learned is not None:
            found.append(learned[i])
        found.append(look_up(specs.PORT_ALIASES, name))
    return F.coalesce(*found, parts["city"])


# ---------------------------------------------------------------- parties


def _may_have(name: Column, pattern: str) -> Column:
    """Whether a legal-form pattern can match the name, or what the rewrites before it make of the name: by its first word,
    else by its letters without the word ends. No rewrite brings in such a word, and the only one that ends in letters of a
    later rule, COMPANY to CO, begins with them already."""
    words = re.findall("[A-Z]{2,}", pattern)
    return F.contains(name, F.lit(words[0])) if words else matches(name, pattern.replace(r"\b", ""), PLAIN)


def _legal_forms(name: Column) -> Column:
    """The legal forms rewritten in order; a rewrite runs only where its words are in the name."""

    def rewritten(s: Column, pattern: str, form: str) -> Column:
        return let(s, lambda x: F.when(_may_have(name, pattern), sub(x, pattern, form)).otherwise(x))

    # most names hold none of the words: one test of all of them goes before the steps
    some = reduce(lambda a, b: a | b, [_may_have(name, pattern) for pattern, _ in specs.LEGAL_REWRITES])
    return F.when(some, reduce(lambda s, rule: rewritten(s, *rule), specs.LEGAL_REWRITES, name)).otherwise(name)


def party_norm(value: Column, folded: Column | None = None) -> Column:
    """One spelling per company: order wording dropped, legal forms rewritten in order, punctuation dropped."""

    def named(text: Column) -> Column:
        ordered = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ("ORDER", "M/S", "MESSRS")])
        return F.replace(F.when(ordered, F.regexp_replace(text, specs.ORDER_PREFIX, "")).otherwise(text), F.lit("."), F.lit(""))

    s = let(let(_folded(value, folded), named), _legal_forms)
    return kept(F.replace(s, F.lit("&"), F.lit(" & ")), "A-Z0-9&")


def party_core(norm: Column) -> Column:
    """The name without legal-form tokens."""
    return F.array_join(F.filter(F.split(norm, " "), lambda t: ~t.isin([*specs.LEGAL_TOKENS, "&"])), " ")  # a set, not a list


def is_order_only(value: Column, folded: Column | None = None) -> Column:
    """N7."""
    return matches(F.coalesce(_folded(value, folded), F.lit("")), specs.ORDER_ONLY, PLAIN)


def is_blank(value: Column) -> Column:
    """Nothing there, or only a placeholder. White space at the ends needs no trimming: every anchored part of the
    pattern takes it in."""
    return value.isNull() | matches(value, specs.BLANK_VALUE, NOCASE)


# ---------------------------------------------------------------- labels


def normalise_label(label: Column) -> Column:
    """N11. CJK signs need no step of their own: no lower case of theirs is a letter or digit that is kept."""
    return kept(F.lower(label), "a-z0-9")
