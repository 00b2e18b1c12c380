"""Constraint checks on a response, a registry of them, and their dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import text as tx

KWARGS_TYPE = (
    "struct<num_highlights:int,num_words:int,num_sentences:int,num_paragraphs:int,"
    "num_bullets:int,num_placeholders:int,forbidden_words:array<string>,"
    "keywords:array<string>,keyword:string,frequency:int,letter:string,"
    "let_frequency:int,relation:string,end_phrase:string>"
)

Check = Callable[[Column, Column], Column]


def _unless_given(param: Column, check: Column) -> Column:
    """A check without its parameter passes."""
    return F.when(param.isNull(), F.lit(True)).otherwise(check)


def _related(count: Column, goal: Column, relation: Column, default: str) -> Column:
    named = F.coalesce(relation, F.lit(default))
    last = count >= goal if default == "at least" else count == goal
    return (
        F.when(named == "at least", count >= goal)
        .when(named == "at most", count <= goal)
        .when(named == "exactly", count == goal)
        .otherwise(last)
    )


def no_comma(r: Column, kw: Column) -> Column:
    return ~r.contains(",")


def highlighted_sections(r: Column, kw: Column) -> Column:
    bold = tx.matches(r, r"\*\*[^*]+\*\*")
    headings = tx.matches(r, rf"(?md)^#{{1,6}}[{fx.SPACE}]+[^\n]+$")
    return _unless_given(kw["num_highlights"], bold + headings == kw["num_highlights"])


def word_total(r: Column, kw: Column) -> Column:
    return _unless_given(
        kw["num_words"], _related(tx.word_count(r), kw["num_words"], kw["relation"], "at least")
    )


def sentence_total(r: Column, kw: Column) -> Column:
    parts = F.split(tx.strip(r), rf"[.!?]+[{fx.SPACE}]+")
    return _unless_given(
        kw["num_sentences"], F.size(F.filter(parts, lambda s: ~tx.is_blank(s))) == kw["num_sentences"]
    )


def paragraph_total(r: Column, kw: Column) -> Column:
    parts = F.filter(F.split(r, "\n\n"), lambda s: ~tx.is_blank(s))
    return _unless_given(kw["num_paragraphs"], F.size(parts) == kw["num_paragraphs"])


def bullet_total(r: Column, kw: Column) -> Column:
    bullets = tx.matches(r, rf"(?md)^[{fx.SPACE}]*[-*•][{fx.SPACE}]+")
    return _unless_given(kw["num_bullets"], bullets == kw["num_bullets"])


def placeholder_total(r: Column, kw: Column) -> Column:
    return _unless_given(
        kw["num_placeholders"], tx.matches(r, r"\[[^\]]*\]") == kw["num_placeholders"]
    )


def no_forbidden_words(r: Column, kw: Column) -> Column:
    found = F.exists(kw["forbidden_words"], lambda w: F.lower(r).contains(F.lower(w)))
    return F.coalesce(~found, F.lit(True))


def all_keywords(r: Column, kw: Column) -> Column:
    return F.coalesce(
        F.forall(kw["keywords"], lambda w: F.lower(r).contains(F.lower(w))), F.lit(True)
    )


def keyword_frequency(r: Column, kw: Column) -> Column:
    count = tx.occurrences(F.lower(r), F.lower(kw["keyword"]))
    goal = F.coalesce(kw["frequency"], F.lit(1))
    return _unless_given(
        F.nullif(kw["keyword"], F.lit("")), _related(count, goal, kw["relation"], "exactly")
    )


def letter_frequency(r: Column, kw: Column) -> Column:
    count = tx.occurrences(F.lower(r), F.lower(kw["letter"]))
    goal = F.coalesce(kw["let_frequency"], F.lit(1))
    named = F.coalesce(kw["relation"], F.lit("at least"))
    check = (
        F.when(named == "at least", count >= goal)
        .when(named == "at most", count <= goal)
        .otherwise(count == goal)
    )
    return _unless_given(F.nullif(kw["letter"], F.lit("")), check)


def valid_json(r: Column, kw: Column) -> Column:
    # Duplicate keys of one object count as invalid, as NaN does: the parser refuses both.
    # It also stops at the end of the first value, so the text is read inside an object and inside
    # an array: what follows a value must then be "}" or "," there, "]" or "," here, and a comma
    # makes a second element.
    def whole(s: Column) -> Column:
        inside = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()
        alone = F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == 1
        return F.when(s.rlike(tx.MAY_BE_JSON), inside & F.coalesce(alone, F.lit(False))).otherwise(F.lit(False))

    return tx.bind(tx.strip(r), whole)


def markdown_title(r: Column, kw: Column) -> Column:
    return tx.strip(r).rlike(rf"\A#{{1,6}}[{fx.SPACE}]+[^\n]")


def postscript(r: Column, kw: Column) -> Column:
    return r.contains("P.S.")


def quoted(r: Column, kw: Column) -> Column:
    bare = tx.strip(r)
    return bare.startswith('"') & bare.endswith('"')


def all_lowercase(r: Column, kw: Column) -> Column:
    return r == F.lower(r)


def all_uppercase(r: Column, kw: Column) -> Column:
    return r == F.upper(r)


def ends_with_phrase(r: Column, kw: Column) -> Column:
    phrase = F.nullif(kw["end_phrase"], F.lit(""))
    return _unless_given(phrase, F.endswith(tx.strip(r), kw["end_phrase"]))


_CHECKS: dict[str, Check] = {
    "punctuation:no_comma": no_comma,
    "detectable_format:number_highlighted_sections": highlighted_sections,
    "length_constraints:number_words": word_total,
    "length_constraints:number_sentences": sentence_total,
    "length_constraints:number_paragraphs": paragraph_total,
    "detectable_format:number_bullets": bullet_total,
    "detectable_content:number_placeholders": placeholder_total,
    "keywords:forbidden_words": no_forbidden_words,
    "keywords:existence": all_keywords,
    "keywords:frequency": keyword_frequency,
    "keywords:letter_frequency": letter_frequency,
    "detectable_format:json_format": valid_json,
    "detectable_format:title": markdown_title,
    "detectable_content:postscript": postscript,
    "startend:quotation": quoted,
    "change_case:english_lowercase": all_lowercase,
    "change_case:english_capital": all_uppercase,
    "startend:end_checker": ends_with_phrase,
}


def register_constraint(name: str, check: Check) -> None:
    """Add or replace a constraint check: ``(response, kwargs struct) -> boolean``."""
    _CHECKS[name] = check


def constraint_names() -> list[str]:
    return sorted(_CHECKS)


def kwargs_literal(**params: object) -> Column:
    """A kwargs struct column from Python values; names not given are null."""
    fields = []
    for part in _split_fields(KWARGS_TYPE):
        name, kind = part.split(":", 1)
        value = params.get(name)
        if isinstance(value, (list, tuple)):
            column = F.array(*[F.lit(v) for v in value])
        else:
            column = F.lit(value)
        fields.append(column.cast(kind).alias(name))
    return F.struct(*fields)


def _split_fields(struct_type: str) -> list[str]:
    return struct_type[len("struct<") : -1].split(",")


def check_one(response: Column, ctype: Column, kwargs: Column) -> Column:
    """Outcome of one constraint; an unknown type is null and skipped later."""
    base = F.regexp_replace(ctype, "_2$", "")
    known_alias = ctype.isin([f"{t}_2" for t in fx.CONSTRAINT_ALIASED_TYPES])
    name = F.when(known_alias, base).otherwise(ctype)
    chain = None
    for key, check in _CHECKS.items():
        outcome = check(response, kwargs)
        chain = F.when(name == key, outcome) if chain is None else chain.when(name == key, outcome)
    return chain


def response_score(response: Column | str, constraints: Column | str) -> Column:
    """1 if every known constraint holds, 0 if one fails or the call failed.

    ``constraints`` is ``array<struct<type, kwargs>>``.  A response without any
    constraint has nothing to score and yields null.
    """
    response, constraints = tx.col(response), tx.col(constraints)
    holds = F.forall(
        constraints,
        lambda c: F.coalesce(check_one(response, c["type"], c["kwargs"]), F.lit(True)),
    )
    return (
        F.when(response.startswith("[ERROR]"), F.lit(0))
        .when(F.coalesce(F.size(constraints), F.lit(0)) <= 0, F.lit(None).cast("int"))
        .otherwise(holds.cast("int"))
    )
