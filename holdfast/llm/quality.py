"""Quality rules: counts of repetition and symbols, and divergence from language references.

All native column functions.  A language reference holds two histograms of the
language's documents: character classes, and its most frequent words, the first ones
each for itself and the others in bands of ranks.  A document is compared with every
reference by Jensen-Shannon distance (0 to 1) and judged by its closest one, so a wrong or
missing label costs nothing; a label without a reference leaves the base rules only.  References are
fitted on every labelled row, and the word limit of a language and length class comes from the
distances of all its own rows.  Distances of short texts are noise: below the minimum
lengths they are null and reject nothing.

Cases: null text has no words; very long texts are taken whole; equal counts of words are ranked by the word; empty tables give empty results; null doc_ids pass
through, but no reference is fitted on them; without any labelled document only the base rules apply; repeated rows are
judged each by itself; extra columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.text import bind
from holdfast.llm import shared as sh
from holdfast.operators.common import first_n_per_key

SYMBOLS = "[#*$%&|<>]"
UPPER = "\\p{Lu}"
DIGIT = "[0-9]"
WINDOW = 8
# Letters with their marks, and blanks; what is left of a text without them is short.
LETTER_RUN = "[\\p{L}\\p{M} \\x09-\\x0D]+"
CONTROL = "[\\p{C}\\x{FFFD}]"
PUNCTUATION = "[\\p{P}\\p{S}&&[^\\x{FFFD}]]"
DISTANCE_STEP = 1e-5
CLASSES = ("upper", "lower", "digit", "symbol", "blank", "punctuation", "control", "other")


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    The class default leaves ordinary prose and tables alone (below 0.17 on the test
    tables) and rejects texts strewn with symbols (0.3 and more).  The word limit is the
    median distance of the language's rows plus ``word_fence`` times the way from its 5 % quantile
    to the median: the upper tail holds the junk and says nothing about good
    texts.  It stays below ``max_word_distance`` and below the distance of a text without
    any common word.

    Every language with ``min_language_rows`` labelled rows gets a reference; documents of a rarer labelled
    language are judged by the base rules only.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    min_language_rows: int = 20
    common_words: int = 256
    single_words: int = 8
    min_chars_for_classes: int = 200
    min_words_for_common: int = 120
    max_class_distance: float = 0.3
    max_word_distance: float = 0.6
    word_fence: float = 4.0
    min_rows_for_limit: int = 20
    length_classes: int = 7


@dataclass(frozen=True)
class Reference:
    language: str
    classes: tuple[float, ...]
    cells: tuple[tuple[int, ...], ...]  # hashes of the words of each cell
    shares: tuple[float, ...]


def _pairs(values: Column, step: int) -> Column:
    """Hash of every value with the one ``step`` places on."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort hashes with places,
    keep those equal to a neighbour, add up the union of their stretches."""

    def places(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))

    def length(p: Column) -> Column:
        ends = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.element_at(p, -1) + WINDOW))
        gaps = F.zip_with(p, ends, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    at = F.sequence(F.lit(0), F.size(windows) - 1)
    zipped = F.zip_with(windows, at, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return bind(
        bind(F.sort_array(zipped), places),
        lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(length(p)),
    )


def _repeated(hashes: Column) -> Column:
    """Words in 8-word windows found twice or more.

    A repeated window repeats five 4-word windows, so a text with fewer repeated
    4-word windows has none and skips the exact step.
    """

    def exact(four: Column) -> Column:
        return bind(_pairs(four, 4), _covered)

    def guarded(four: Column) -> Column:
        return F.when(F.size(four) - F.size(F.array_distinct(four)) < 5, F.lit(0)).otherwise(exact(four))

    inner = bind(bind(_pairs(hashes, 1), lambda two: _pairs(two, 2)), guarded)
    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0)).otherwise(inner)


def _cells(ranked: list, single: int) -> list[list]:
    """The first ``single`` values one by one, then bands that double."""
    ends, at = [], 0
    while at < len(ranked):
        ends.append((at, at + 1 if at < single else max(at + 1, 2 * at)))
        at = ends[-1][1]
    return [ranked[a:b] for a, b in ends]


def _common(hashes: Column, refs: list[Reference]) -> Column:
    """Words of the text in every cell of every reference, one reference after another."""

    def of_one(ref: Reference) -> Column:
        def count(own: Column, cell: tuple[int, ...]) -> Column:
            if len(cell) == 1:
                return F.size(own) - F.size(F.array_remove(own, F.lit(cell[0]).cast("long")))
            return F.size(F.filter(own, lambda x: x.isin(*cell)))

        listed = [c for cell in ref.cells for c in cell]
        return bind(F.filter(hashes, lambda x: x.isin(*listed)), lambda own: F.array(*[count(own, c) for c in ref.cells]))

    return F.concat(*[of_one(r) for r in refs]) if refs else F.array().cast("array<int>")


def _class_parts(text: Column) -> list[Column]:
    """The counts behind ``_class_counts`` that are not measures of their own."""
    rest = F.regexp_replace(text, LETTER_RUN, "")
    counts = bind(rest, lambda r: F.array(
        F.length(r), *[F.regexp_count(r, F.lit(p)) for p in (DIGIT, PUNCTUATION, CONTROL)]))
    return [F.regexp_count(text, F.lit(UPPER)).cast("long").alias("upper"), counts.alias("marks")]


def _measures(text: Column, refs: list[Reference]) -> Column:
    """Every count of one text; the text, its words and word hashes are computed once."""

    def of_hashes(w: Column, h: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(text).cast("long").alias("n_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            *(_class_parts(text) if refs else [F.lit(0).cast("long").alias("upper"), F.array().cast("array<int>").alias("marks")]),
            _dup_lines(text).alias("n_dup_lines"),
            _repeated(h).cast("long").alias("n_repeat_words"),
            _common(h, refs).alias("common"),
        )

    return bind(sh.words(text), lambda w: bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of_hashes(w, h)))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(sh.WORD))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _class_counts() -> list[Column]:
    """Characters by class, from the counts of a row; disjoint and adding up to the text."""
    c = F.col
    left, digit, punctuation, control = (F.get("marks", i) for i in range(4))
    letters = c("word_chars") - left
    return [c("upper"), letters - c("upper"), digit, c("n_symbols"), c("n_chars") - c("word_chars"),
            punctuation - c("n_symbols"), control, left - digit - punctuation - control]


def references(docs: DataFrame, rules: QualityRules = QualityRules()) -> list[Reference]:
    """Histograms of each language, fitted on all its labelled rows."""
    return fitted(docs, rules)[0]


def fitted(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[list[Reference], DataFrame | None]:
    """The references and the rows (lang, text) that they are fitted on, all of them labelled.

    Only sums per language and the most frequent words come to the driver.
    """
    refs, labelled = word_references(docs, rules)
    if labelled is None:
        return [], None
    text = F.col("text")
    counts = labelled.select(
        "lang", F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"), *_class_parts(text),
        F.length(text).alias("n_chars"),
        F.length(sh.without_blanks(text)).alias("word_chars"),
    )
    return with_classes(refs, counts), labelled


def word_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[list[Reference], DataFrame | None]:
    """The references with their words only, and the labelled rows (lang, text) that they are fitted on."""
    labelled = docs.filter(_labelled())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kept = [r["lang"] for r in counts.filter(F.col("n") >= rules.min_language_rows).collect()]
    if not kept:
        return [], None
    labelled = labelled.filter(F.col("lang").isin(kept)).select("lang", "text")
    found = frequent_words(labelled, rules).collect()
    totals = {r["lang"]: r["count"] for r in found if r["_rank"] is None}
    out = []
    for language in sorted(totals):
        own = sorted((r for r in found if r["lang"] == language and r["_rank"] is not None), key=lambda r: r["_rank"])
        cells = _cells(own, rules.single_words)
        shares = tuple(sum(r["count"] for r in cell) / totals[language] for cell in cells)
        out.append(Reference(
            language, (), tuple(tuple(r["hash"] for r in cell) for cell in cells), (*shares, max(0.0, 1 - sum(shares))),
        ))
    return out, labelled


def frequent_words(labelled: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The most frequent words of each language, and a row without word and rank that counts all its words.

    Both sides read the same shuffled counts, so the texts are split once.
    """
    counted = labelled.select("lang", F.explode(sh.words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    top = first_n_per_key(counted, ["lang"], [F.desc("count"), F.col("word")], rules.common_words)
    totals = counted.groupBy("lang").agg(F.sum("count").alias("count"))
    return (
        top.select("lang", "count", "_rank", F.xxhash64("word").alias("hash"))
        .unionByName(totals, allowMissingColumns=True)
    )


def with_classes(refs: list[Reference], counts: DataFrame) -> list[Reference]:
    """The references with the character classes of their rows, from the counts of each."""
    classes = [c.cast("long").alias(n) for n, c in zip(CLASSES, _class_counts(), strict=True)]
    rows = counts.select("lang", *classes).groupBy("lang").agg(*[F.sum(n).alias(n) for n in CLASSES]).collect()
    sums = {r["lang"]: [r[n] for n in CLASSES] for r in rows}
    return [replace(r, classes=tuple(n / sum(sums[r.language]) for n in sums[r.language])) for r in refs]


def _labelled() -> Column:
    return F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def js_distance(shares: Column, reference: tuple[float, ...]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits between two histograms."""

    def cell(q: Column, p: Column) -> Column:
        middle = (q + p) / 2
        return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)

    cells = F.zip_with(shares, F.array(*[F.lit(float(p)) for p in reference]), cell)
    total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_distances(refs: list[Reference]) -> list[Column]:
    """Distance to every reference from the columns ``common`` and ``n_words``."""
    out, at, n = [], 0, F.greatest(F.col("n_words"), F.lit(1))
    for r in refs:
        own = F.transform(F.slice("common", at + 1, len(r.cells)), lambda c: c / n)
        rest = F.aggregate(own, F.lit(1.0), lambda acc, c: acc - c)
        out.append(js_distance(F.concat(own, F.array(F.greatest(rest, F.lit(0.0)))), r.shares))
        at += len(r.cells)
    return out


def _long_distances(refs: list[Reference], rules: QualityRules) -> Column:
    """The distances to every reference, null for texts of too few words."""
    return F.when(F.col("n_words") >= rules.min_words_for_common, F.array(*word_distances(refs)))


def _length_class(rules: QualityRules) -> Column:
    """0 from ``min_words_for_common`` words on, one more for every doubling."""
    doublings = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)) / rules.min_words_for_common))
    return F.greatest(F.least(doublings, F.lit(rules.length_classes - 1)), F.lit(0)).cast("int")


def without_common_words(ref: Reference) -> float:
    """Distance of a text that holds none of the reference's words."""
    rest = ref.shares[-1]
    middle = (1 + rest) / 2
    total = sum(ref.shares[:-1]) - math.log2(middle) + (rest * math.log2(rest / middle) if rest > 0 else 0.0)
    return math.sqrt(max(0.0, total / 2))


def word_limits(labelled: DataFrame, refs: list[Reference], rules: QualityRules = QualityRules()) -> list[list[float]]:
    """The limits of ``distance_limits`` for labelled texts."""

    def counts(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return bind(hashes, lambda h: F.struct(F.size(w).cast("long").alias("n_words"), _common(h, refs).alias("common")))

    rows = labelled.select("lang", F.inline(F.array(bind(sh.words(F.col("text")), counts))))
    return distance_limits(rows.select("lang", "n_words", _long_distances(refs, rules).alias("_word_ds")), refs, rules)


def distance_limits(rows: DataFrame, refs: list[Reference], rules: QualityRules = QualityRules()) -> list[list[float]]:
    """Largest accepted word distance of every reference, by length class.

    A class with too few rows takes the limit of the next shorter one, which is never
    the stricter one, since distances shrink with length.  Quantiles are of all rows, out of
    counts by cells of ``DISTANCE_STEP``, so that no task holds the distances of a language:
    each is the smallest distance of the cell that its rank falls into.
    """
    own = F.lit(None).cast("double")
    for at, r in enumerate(refs):
        own = F.when(F.col("lang") == r.language, F.get("_word_ds", F.lit(at))).otherwise(own)
    cells = (
        rows.select("lang", _length_class(rules).alias("length"), own.alias("d")).filter("d is not null")
        .groupBy("lang", "length", F.floor(F.col("d") / DISTANCE_STEP).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
    )
    whole = Window.partitionBy("lang", "length")
    ranked = cells.withColumns(
        {"upto": F.sum("n").over(whole.orderBy("cell")), "total": F.sum("n").over(whole)}
    )

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("upto") > (F.col("total") - 1) * share, F.col("d")))

    found = {
        (r["lang"], r["length"]): r for r in ranked.groupBy("lang", "length")
        .agg(F.max("total").alias("n"), F.array(quantile(0.05), quantile(0.5)).alias("q")).collect()
    }
    out = []
    for r in refs:
        limit = cap = min(rules.max_word_distance, 0.95 * without_common_words(r))
        limits = []
        for k in range(rules.length_classes):
            seen = found.get((r.language, k))
            if seen and seen["n"] >= rules.min_rows_for_limit:
                low, middle = seen["q"]
                # A language of equal texts has no spread; half the median is left open then.
                limit = min(cap, middle + max(rules.word_fence * (middle - low), middle / 2))
            limits.append(limit)
        out.append(limits)
    return out


def measured(docs: DataFrame, refs: list[Reference], carried: list[str] | None = None) -> DataFrame:
    """The documents (or their ``carried`` columns) as struct ``_d`` beside the counts of their texts.

    The counts come out of a generator of one row, so that a later filter on them is not
    pushed below and computed anew for every use of a count.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("_d")
    return docs.select(whole, _labelled().alias("_labelled"), F.inline(F.array(_measures(sh.whole("text"), refs))))


def judge_rows(
    docs: DataFrame, rules: QualityRules = QualityRules(), carried: list[str] | None = None,
) -> DataFrame:
    """Counts, distances, ``base_failed`` and ``kept`` beside the documents as struct ``_d``.

    With references, the measured rows are written once; class histograms, word limits and
    verdicts are read from that table, so that every text is measured a single time.
    """
    refs, _ = word_references(docs, rules)
    rows = measured(docs, refs, carried)
    chars = F.greatest(F.col("n_chars"), F.lit(1))
    class_d, word_d, strange = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)
    if refs:
        rows = sh.written(rows.withColumn("_word_ds", _long_distances(refs, rules)).drop("common"), "quality")
        labelled = rows.filter("_labelled").withColumn("lang", F.col("_d.lang"))
        refs = with_classes(refs, labelled)
        by_class = F.array(*[c / chars for c in _class_counts()])
        class_ds = [js_distance(by_class, r.classes) for r in refs]
        class_d = F.when(F.col("n_chars") >= rules.min_chars_for_classes, F.array_min(F.array(*class_ds)))
        word_d = F.array_min("_word_ds")
        # By length class, the limits in the order of the references.
        limits = F.array(*[F.array(*[F.lit(x) for x in own])
                           for own in zip(*distance_limits(labelled, refs, rules), strict=True)])
        over = F.zip_with("_word_ds", F.get(limits, _length_class(rules)), lambda d, limit: d > limit)
        strange = F.coalesce(F.forall(over, lambda x: x), F.lit(False))
    n_words = F.col("n_words")
    failed = (n_words < rules.min_words) | (F.col("n_repeat_words") * 100 > n_words * rules.max_repeat_percent)
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) | strange
    lang = F.col("_d.lang")
    far = far & (lang.isNull() | lang.isin([r.language for r in refs]))
    return (
        rows.withColumn("class_distance", class_d).withColumn("word_distance", word_d)
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    )


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One verdict row per document."""
    rows = judge_rows(docs.select("doc_id", "text", "lang"), rules, ["doc_id", "lang"])
    return rows.select(
        "_d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge_rows(docs, rules).filter("kept").select(*[F.col(f"_d.`{c}`") for c in docs.columns])
