"""Secret scan by a battery of randomness tests (operator 6), in DataFrame functions only.

Base kinds follow their expressions: the text is split at the matches, and the lengths of the parts and of the matches
give every place without a Python function. Further secrets are runs of at least `TOKEN` characters that look drawn at
random: the encoding is inferred from the characters, and three tests are made against a uniform draw from its alphabet: a
chi-squared test of uniformity (over about n / 5 equal parts of the alphabet), a runs test around the middle of the
alphabet and a test of the correlation of neighbours. Their p-values are joined by Fisher's method.

A run ends after its '=' (padding, or the name of what follows). Where its p-value is in the lowest bin or it has a
word between its '/', '_' and '-', the pieces of at least `TOKEN` characters between these are tested as well, and reported
where the run itself is not: a key may have a prefix or stand in a path. Hex in
groups (as in a UUID) is tested without its hyphens. Lower-case base32 and base36 must have a digit, as letters alone are
words; a random key has none with a chance of 1.6 % (base32 of 20 characters) or 0.15 % (base36 of 20) and falls to base64.

A random token has a p-value that is uniform, ordinary text has one close to zero - the more so the longer it is. So the
threshold above which a token counts as random is set for each encoding and band of lengths, over the whole table: the
share of random tokens follows from the p-values above one half, and the threshold is the lowest at which the estimated
share of others among the reported is at most `FALSE_SHARE`. A stratum of few tokens, from which that cannot be told, takes
the threshold of its encoding or of the table, so that a lone key is not lost for want of company. The histogram has at most BINS rows for each of at most 80
strata (encoding, band of lengths, run or piece), whatever the table.

Defined results: a null text is empty; places are code points, ends exclusive; spans are sorted by start, then by kind in
the order of KINDS; repeated rows are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import boxed, id_and_text, table, unboxed

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Expressions of the base kinds (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = 20
#: Characters below which a token without its padding is never random.
LEAST = 8
CANDIDATE = r"[A-Za-z0-9+/_-]+=*"
PIECE = r"[A-Za-z0-9+]+=*"
#: A piece that is a word: letters of one case alone, with a piece after it.
WORD = r"(^|[/_-])([a-z]{2,}|[A-Z]{2,})[/_-]"
FALSE_SHARE = 0.05
BINS = 64
#: Tokens beyond the lowest bin from which a stratum is judged by itself alone, and the limit of a table with fewer.
ENOUGH = 16
LONE = 0.02
#: Hex in groups of at least four, joined by hyphens that are no data.
GROUPED = (r"^[0-9a-f]{4,}(-[0-9a-f]{4,})+$", r"^[0-9A-F]{4,}(-[0-9A-F]{4,})+$")
#: Encodings from the narrowest: name, characters that occur, alphabet in order.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base32 lower", r"^(?=.*[2-7])[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36 lower", r"^(?=.*[0-9])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("hex groups", GROUPED[0], "0123456789abcdef"),
    ("HEX groups", GROUPED[1], "0123456789ABCDEF"),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def places(text: Column, pattern: str, keep) -> Column:
    """array<struct<start, end, match>> of the leftmost, non-overlapping matches for which keep(match) holds."""
    parts = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(matches)).alias("part"), matches.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(_SPAN)


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """Spans of the base kinds; a kind is looked for only where something that it needs is in the text."""
    none = F.array().cast(_SPAN)
    low = F.lower(text)
    assign = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in _ASSIGN_WORDS])
    found = (
        (0, assign, ASSIGN, lambda m: F.length(F.regexp_extract(m, "(?s)^" + ASSIGN, 1)) >= ASSIGN_VALUE),
        (1, F.contains(text, F.lit("AKIA")), ACCESS, lambda m: F.length(m) >= ACCESS_CHARS),
        (2, text.rlike(f"[0-9a-f]{{{HEX_CHARS}}}"), HEX, lambda m: F.length(m) >= HEX_CHARS),
    )
    kinds = []
    for kind, gate, pattern, keep in found:
        kinds.append(F.when(gate, _tagged(places(text, pattern, keep), kind)).otherwise(none))
    return F.concat(*kinds)


def _upper_tail(z: Column) -> Column:
    """Normal tail above z, by a logistic curve (error below 0.0002)."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """struct<encoding, n, p> of a token of at least TOKEN characters: p is near 0 for text, uniform for random draws."""
    bare = F.regexp_replace(token, "=+$", "")  # padding is no data
    data = F.when(reduce(lambda a, b: a | b, [bare.rlike(g) for g in GROUPED]), F.translate(bare, "-", "")).otherwise(bare)
    kind = reduce(lambda rest, i: F.when(bare.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(rest), reversed(range(len(ENCODINGS) - 1)), F.lit(len(ENCODINGS) - 1))

    def with_codes(s: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), s["kind"] + 1)
        size = F.length(alphabet)
        letters = F.filter(F.split(s["bare"], ""), lambda c: c != "")
        codes = F.transform(letters, lambda c: F.greatest(F.lit(1), F.call_function("instr", alphabet, c)) - 1)
        return F.struct(s["kind"].alias("kind"), size.alias("size"), codes.alias("codes"), F.size(codes).cast("double").alias("n"))

    def with_mean(s: Column) -> Column:  # what lambdas read is a value by then, not an expression evaluated per character
        n = F.greatest(s["n"], F.lit(float(LEAST)))
        mean = F.aggregate(s["codes"], F.lit(0.0), lambda a, x: a + x) / n
        bins = F.greatest(F.lit(4), F.least(F.lit(16), F.floor(n / 5))).cast("int")
        return F.struct(s["kind"].alias("kind"), s["size"].alias("size"), s["codes"].alias("codes"), s["n"].alias("n"), n.alias("m"), mean.alias("mean"), bins.alias("bins"))

    def with_tests(s: Column) -> Column:
        codes, size, n, mean, bins = s["codes"], s["size"], s["m"], s["mean"], s["bins"]
        expected = n / bins
        chi = F.aggregate(
            F.sequence(F.lit(0), bins - 1), F.lit(0.0),
            lambda acc, b: acc + F.pow(F.size(F.filter(codes, lambda x: F.floor(x * bins / size) == b)) - expected, F.lit(2.0)) / expected,
        )
        df = bins - 1.0
        z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.transform(codes, lambda x: (x * 2 >= size).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
        product = 2 * n1 * (n - n1)
        near = F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.lit(0), F.size(codes) - 1)), F.slice(codes, F.lit(2), F.greatest(F.lit(0), F.size(codes) - 1)), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
        runs = 1 + F.size(F.filter(near, lambda x: (x["a"] * 2 >= size) != (x["b"] * 2 >= size)))
        spread = product * (product - n) / (n * n * (n - 1))
        run_p = F.when(spread > 0, 2 * _upper_tail(F.abs(runs - (product / n + 1)) / F.sqrt(spread))).otherwise(F.lit(1e-9))
        total = F.aggregate(codes, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(2.0)))
        serial = F.aggregate(near, F.lit(0.0), lambda a, x: a + (x["a"] - mean) * (x["b"] - mean))
        serial_p = F.when(total > 0, 2 * _upper_tail(F.abs(serial / total + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))
        ln = [F.log(F.least(F.lit(1.0), F.greatest(p, F.lit(1e-12)))) for p in (_upper_tail(z), run_p, serial_p)]
        return F.struct(s["kind"].alias("kind"), s["n"].cast("int").alias("n"), (-(ln[0] + ln[1] + ln[2])).alias("x"))

    first = F.array(F.struct(kind.alias("kind"), data.alias("bare")))
    tested = F.transform(F.transform(F.transform(first, with_codes), with_mean), with_tests)  # each step names its values once
    joined = lambda s: F.when(s["n"] >= LEAST, F.exp(-s["x"]) * (1 + s["x"] + s["x"] * s["x"] / 2)).otherwise(F.lit(0.0))
    return F.element_at(F.transform(tested, lambda s: F.struct(s["kind"].alias("encoding"), s["n"].alias("n"), joined(s).alias("p"))), 1)


def candidates(text: Column) -> Column:
    """array<struct<start, end, run, piece, encoding, n, p>> of all runs of at least TOKEN characters of any encoding, and of
    the pieces of those that look like text; `run` is the start of the run."""
    kind = "array<struct<start:int,end:int,run:int,piece:boolean,encoding:int,n:int,p:double>>"
    long = f"[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{{{TOKEN - 1}}}"
    keep = lambda m: F.length(m) >= TOKEN

    def tested(start: Column, run: Column, piece: bool, match: Column) -> Column:
        place = F.struct(start.alias("start"), (start + F.length(match)).alias("end"), run.alias("run"), F.lit(piece).alias("piece"))
        return F.struct(place.alias("at"), match.alias("match"), battery(match).alias("t"))

    def with_pieces(x: Column) -> Column:
        at = x["at"]["start"]
        pieces = F.transform(places(x["match"], PIECE, keep), lambda y: tested(at + y["start"], at, True, y["match"]))
        has = ((x["t"]["p"] < 1 / BINS) | x["match"].rlike(WORD)) & x["match"].rlike("[/_-]") & x["match"].rlike(f"[A-Za-z0-9+=]{{{TOKEN}}}")
        return F.when(has, F.concat(F.array(x), pieces)).otherwise(F.array(x))

    runs = F.transform(places(text, CANDIDATE, keep), lambda x: tested(x["start"], x["start"], False, x["match"]))
    both = F.flatten(F.transform(runs, with_pieces))
    names = lambda s, *of: [s[n].alias(n) for n in of]
    flat = F.transform(both, lambda s: F.struct(*names(s["at"], "start", "end", "run", "piece"), *names(s["t"], "encoding", "n", "p")))
    return F.when(text.rlike(long), flat.cast(kind)).otherwise(F.array().cast(kind))


def _stratum(c: Column) -> Column:
    """One of four bands of length for each encoding, of runs and of pieces."""
    band = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.log2(F.greatest(c["n"], F.lit(1)).cast("double"))) - 4))
    return ((c["encoding"] + F.when(c["piece"], F.lit(len(ENCODINGS))).otherwise(F.lit(0))) * 4 + band).cast("int")


def lowest_accepted(hist: list[int], false_share: float) -> float | None:
    """The lowest p-value at which at most `false_share` of the tokens reported are others than random ones, by the
    estimate from the upper half of the histogram; None where there is no such value."""
    random_each = sum(hist[BINS // 2 :]) / (BINS - BINS // 2)
    best, reported = None, 0
    for b in reversed(range(BINS)):
        reported += hist[b]
        others = max(0.0, reported - random_each * (BINS - b))
        if reported and others <= false_share * reported:
            best = b / BINS
    return None if best is None else max(best, 1e-3)


def limits_of(counts: dict[int, list[int]], false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Lowest accepted p-value of each stratum, from its histogram of p-values.

    Fewer than ENOUGH tokens beyond the lowest bin are too few to tell that none is random. Such a stratum without a value
    of its own takes that of its encoding, then that of the whole table; where even the table has too few, LONE.
    """

    def pooled(strata) -> list[int]:
        return [sum(x) for x in zip(*(counts[s] for s in strata))]

    def few(hist: list[int]) -> bool:
        return sum(hist[1:]) < ENOUGH

    out = {}
    for s, hist in counts.items():
        limit = lowest_accepted(hist, false_share)
        if limit is None and few(hist):
            for level in (pooled(x for x in counts if x // 4 == s // 4), pooled(counts)):
                if not few(level):
                    limit = lowest_accepted(level, false_share)
                    break
            else:
                limit = LONE
        if limit is not None:
            out[s] = limit
    return out


def thresholds(rows: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Lowest accepted p-value of each stratum, from the candidates (column `cands`) of all rows; at most 80 entries."""
    one = rows.select(F.explode("cands").alias("c")).select(_stratum(F.col("c")).alias("s"), F.least(F.lit(BINS - 1), F.floor(F.col("c.p") * BINS)).cast("int").alias("b"))
    counts: dict[int, list[int]] = {}
    for r in one.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["s"], [0] * BINS)[r["b"]] = r["n"]
    return limits_of(counts, false_share)


def random_spans(cands: Column, limits: dict[int, float]) -> Column:
    if not limits:
        return F.array().cast(_SPAN)
    table_ = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
    kept = F.filter(cands, lambda c: c["p"] >= F.coalesce(F.element_at(table_, _stratum(c)), F.lit(2.0)))
    runs = F.transform(F.array(kept), lambda k: F.struct(k.alias("kept"), F.transform(F.filter(k, lambda c: ~c["piece"]), lambda c: c["run"]).alias("runs")))
    once = F.flatten(F.transform(runs, lambda s: F.filter(s["kept"], lambda c: ~c["piece"] | ~F.array_contains(s["runs"], c["run"]))))
    return _tagged(once, len(BASE_KINDS))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(rows: DataFrame, *, false_share: float = FALSE_SHARE) -> DataFrame:
    """rows (text, ...) with `base` and `spans`, arrays of (start, kind, end) in order."""
    names = rows.columns
    scanned = rows.withColumn("cands", candidates(F.col("text")))
    limits = thresholds(scanned, false_share)
    found = scanned.select(*names, "cands", F.array_sort(base_spans(F.col("text"))).alias("base"))
    return found.select(*names, "base", F.array_sort(F.concat("base", random_spans(F.col("cands"), limits))).alias("spans"))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = secrets(id_and_text(docs, id_col, text_col), false_share=false_share)
    counts = [_count(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars", mask: str = "[secret]", false_share: float = FALSE_SHARE) -> DataFrame:
    """docs with every secret span of the text replaced by `mask` (touching or overlapping spans by one), and the count of
    characters with it; rows without secrets stay as they are."""
    found = secrets(boxed(docs, text_col), false_share=false_share)
    text = F.col("text")

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["parts"], F.array(gap, F.lit(mask)))
        parts = F.when((s["start"] > acc["at"]) | (F.size(acc["parts"]) == 0), new).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1)))
    has = F.size("spans") > 0
    found = found.select("row", has.alias("has"), F.when(has, clean).alias("clean"))
    old = F.col("row").getField(text_col)
    changed = {text_col: F.when(F.col("has"), F.col("clean")).otherwise(old)}
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        changed[count_col] = F.when(F.col("has"), F.length("clean").cast(kind)).otherwise(F.col("row").getField(count_col))
    return unboxed(found, docs.columns, **changed)


def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_randomness_battery": op6_randomness_battery}
ORACLES: dict[str, str] = {}
