"""Secret scan: three fixed patterns, and strings that pass a battery of randomness tests.

Base patterns give spans (kind, start, end) in code points; a pattern's matches are
leftmost and do not overlap.  The method adds kind ``random``: a run of 20 or more token
characters with a letter and a digit, whose symbols look drawn at random from the
alphabet of its inferred encoding.  Three tests give p-values under that hypothesis:
chi-squared uniformity of the alphabet, Wald-Wolfowitz runs about the middle of the
alphabet, and serial correlation at lag one; Fisher's rule combines them.

A true random string has a uniform p-value, other strings crowd near 0.  Each different
string counts once, however often it was copied.  Per encoding and length class (power of
two, as short strings say little) the number of random strings is estimated from the p-values
above ``RANDOM_ABOVE``, where others hardly come; the strings between a threshold and there
that are more than this number lets expect are false discoveries.  The lowest threshold at
which their share of all accepted stays within ``max_false`` is taken; a class in which none
does accepts nothing.

Cases: null text has no spans; very long texts are taken whole; empty tables give empty
results; null doc_ids and repeated rows pass through, each with its own spans; of two spans
that start together the kind listed first comes first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.text import bind
from holdfast.llm import shared as sh

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
# Encodings from narrow to wide; a string belongs to the first whose alphabet holds it.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
THRESHOLDS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
RANDOM_ABOVE = 0.75
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class ScanRules:
    min_value: int = 8
    max_false: float = 0.1


def _found(text: Column, pattern: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use(matches, starts)``; starts come from the lengths of matches and of the parts between them."""

    def starts(parts: Column, matches: Column) -> Column:
        gaps = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.struct(
            F.length(p).alias("gap"), F.length(m).alias("long")))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        walked = F.aggregate(gaps, state, lambda acc, g: F.struct(
            (acc["at"] + g["gap"] + g["long"]).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + g["gap"])).alias("starts"),
        ))
        return walked["starts"]

    return bind(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: bind(starts(F.split(text, pattern, -1), m), lambda s: use(m, s)),
    )


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("int").alias("end"))


def _plain_spans(text: Column, pattern: str, kind: str) -> Column:
    spans = _found(text, pattern, lambda m, s: F.zip_with(m, s, lambda x, at: _span(at, kind, at + F.length(x))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _assign_spans(text: Column, rules: ScanRules) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))

    def long_enough(m: Column, s: Column) -> Column:
        rows = F.zip_with(F.arrays_zip(m.alias("m"), s.alias("s")), values, lambda x, v: F.struct(
            _span(x["s"], "assign", x["s"] + F.length(x["m"])).alias("span"), F.length(v).alias("long")))
        return F.transform(F.filter(rows, lambda r: r["long"] >= rules.min_value), lambda r: r["span"])

    return F.when(text.rlike(ASSIGN), _found(text, ASSIGN, long_enough)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, rules: ScanRules = ScanRules()) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    return F.sort_array(F.concat(
        _assign_spans(text, rules), _plain_spans(text, ACCESS, "access"), _plain_spans(text, HEX, "hex")
    ))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z of either sign, by a rational approximation of erfc."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    series = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = F.lit(c) + series * t
    half = series * t * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def _encoding(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS.items()):
        pattern = "^[" + alphabet.replace("-", "\\-") + "]+$"
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tested(strings: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``size_class`` and the combined ``p`` to rows with a ``token`` string."""
    rows = strings.withColumn("encoding", _encoding(F.col("token"))).withColumn("n", F.length("token").cast("double"))
    alphabet = F.lit("")
    for name, letters in ENCODINGS.items():
        alphabet = F.when(F.col("encoding") == name, F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumn("_abc", alphabet).withColumn("k", F.length("_abc").cast("double"))
    letters = F.split(F.col("_abc"), "")
    counts = F.transform(
        F.filter(letters, lambda c: c != ""), lambda c: F.length("token") - F.length(F.replace(F.col("token"), c, F.lit("")))
    )
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
    codes = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.instr(F.col("_abc"), c) - 1)
    rows = rows.withColumn("_squares", squares).withColumn("_codes", codes)
    n, k, codes = F.col("n"), F.col("k"), F.col("_codes")
    chi = k / n * F.col("_squares") - n
    df = k - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is close to normal.
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (df * 9))) / F.sqrt(2 / (df * 9))
    middle = (k - 1) / 2
    follow = F.slice(codes, 2, F.size(codes) - 1)
    first = F.slice(codes, 1, F.size(codes) - 1)
    product = F.aggregate(
        F.zip_with(first, follow, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda acc, x: acc + x
    )
    spread = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x - middle) * (x - middle))
    changes = F.aggregate(
        F.zip_with(first, follow, lambda a, b: ((a > middle) != (b > middle)).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    high = F.size(F.filter(codes, lambda x: x > middle)).cast("double")
    rows = rows.withColumns({"_zchi": z_chi, "_product": product, "_spread": spread, "_changes": changes, "_high": high})
    low, high = n - F.col("_high"), F.col("_high")
    both = low * high * 2
    mean = both / n + 1
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(var > 0, (F.col("_changes") + 1 - mean) / F.sqrt(var)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("_spread") > 0, F.col("_product") / F.col("_spread") * F.sqrt(n)).otherwise(F.lit(9.0))
    tails = [_upper_tail(F.col("_zchi")), _upper_tail(F.abs(z_runs)) * 2, _upper_tail(F.abs(z_serial)) * 2]
    logs = F.lit(0.0)
    for t in tails:
        logs = logs - F.log(F.greatest(F.least(t, F.lit(1.0)), F.lit(1e-300)))
    rows = rows.withColumn("_x", logs)  # half of Fisher's statistic, six degrees of freedom
    p = F.exp(-F.col("_x")) * (1 + F.col("_x") + F.col("_x") * F.col("_x") / 2)
    return rows.withColumn("p", p).withColumn("size_class", F.floor(F.log2("n")).cast("int")).drop(
        "_abc", "n", "k", "_squares", "_codes", "_zchi", "_product", "_spread", "_changes", "_high", "_x"
    )


def thresholds(tests: DataFrame, rules: ScanRules = ScanRules()) -> dict[tuple[str, int], float]:
    """Lowest accepted p by (encoding, length class) of different strings; classes without one accept nothing.

    Counts of all tested strings come to the driver as one row per encoding and power of
    two of the length.
    """
    above = [F.count_if(F.col("p") > t).alias(f"a{i}") for i, t in enumerate((*THRESHOLDS, RANDOM_ABOVE))]
    out = {}
    for r in tests.groupBy("encoding", "size_class").agg(*above).collect():
        sure = r[f"a{len(THRESHOLDS)}"]
        for i, t in enumerate(THRESHOLDS):
            expected = sure * (RANDOM_ABOVE - t) / (1 - RANDOM_ABOVE)
            false = max(0.0, r[f"a{i}"] - sure - expected)
            if sure and false <= rules.max_false * r[f"a{i}"]:
                out[r["encoding"], r["size_class"]] = t
                break
    return out


def scan(docs: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """Base spans and added random spans of every document, as sorted span arrays.

    The texts are read once; per document only its spans and its few candidate strings
    are written.
    """
    text = sh.whole("text")
    candidates = _found(text, CANDIDATE, lambda m, s: F.filter(
        F.zip_with(m, s, lambda x, at: F.struct(x.alias("token"), at.alias("start"))),
        lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]"),
    ))
    found = F.when(text.rlike(CANDIDATE), candidates).otherwise(
        F.array().cast("array<struct<token:string,start:int>>")
    )

    def apart(base: Column) -> Callable[[Column], Column]:
        return lambda c: ~F.exists(base, lambda b: (b["start"] < c["start"] + F.length(c["token"])) & (b["end"] > c["start"]))

    rows = sh.written(
        docs.select(
            "doc_id", base_spans(text, rules).alias("base"), found.alias("_found"),
            F.monotonically_increasing_id().alias("_row"),
        )
        .withColumn("tokens", F.filter("_found", apart(F.col("base")))).drop("_found"),
        "spans",
    )
    tokens = rows.filter(F.size("tokens") > 0)
    limits = thresholds(tested(tokens.select(F.explode("tokens.token").alias("token")).distinct()), rules)
    # The few documents with candidates are tested again by row, then joined by row number.
    limit = F.lit(2.0)  # above any p
    for (encoding, size_class), t in sorted(limits.items()):
        limit = F.when((F.col("encoding") == encoding) & (F.col("size_class") == size_class), F.lit(t)).otherwise(limit)
    again = tested(tokens.select("_row", F.explode("tokens").alias("t")).select("_row", "t.token", "t.start"))
    # A generator of one row keeps the filter from being pushed into the tests' expressions.
    verdict = F.struct("_row", "token", "start", (F.col("p") > limit).alias("accepted"))
    again = again.select(F.inline(F.array(verdict))).filter("accepted")
    added = again.groupBy("_row").agg(F.sort_array(F.collect_list(
        _span(F.col("start"), "random", F.col("start") + F.length("token"))
    )).alias("random"))
    return rows.join(added, "_row", "left").select(
        "doc_id", "base", F.coalesce("random", F.array().cast(SPAN)).alias("random")
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and kind, between commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    rows = scan(docs, rules)
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "random"))).alias("spans"),
    )
