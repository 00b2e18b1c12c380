"""Text measures as native columns (no Python in the plan)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx

TokenCounter = Callable[[Column], Column]

# Text that cannot be JSON is not handed to the parser: a failed parse is slow.
MAY_BE_JSON = r'\A(?:[\{\["0-9-]|true|false|null)'

def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A column used several times inside ``when`` branches is otherwise computed anew
    in each of them, which matters for regex searches and JSON parsing.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column | str) -> Column:
    """Remove white space of any script at both ends."""
    return F.btrim(col(text), F.lit(fx.SPACE_CHARS))


def lstrip(text: Column | str) -> Column:
    return F.ltrim(col(text), F.lit(fx.SPACE_CHARS))


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(rf"[^{fx.SPACE}]")


def matches(text: Column | str, pattern: str) -> Column:
    """How many non-overlapping matches of ``pattern`` the text holds."""
    return F.regexp_count(col(text), F.lit(pattern))


def words(text: Column | str) -> Column:
    """Words between white space of any script.

    All white space becomes a plain space first: splitting at one character is several
    times faster than a regex class of thirty.
    """
    spaced = F.translate(col(text), fx.SPACE_CHARS, " " * len(fx.SPACE_CHARS))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def token_count(text: Column | str) -> Column:
    """Default token counter: letter/digit runs plus single other marks."""
    return matches(text, fx.TOKEN_PATTERN)


def in_token_range(
    text: Column | str, low: int, high: int, counter: TokenCounter = token_count
) -> Column:
    return counter(col(text)).between(low, high)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping count of a plain substring; a blank needle counts 0."""
    cut = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.coalesce(F.try_divide(cut, F.length(needle)).cast("long"), F.lit(0))


def contains_any(text: Column | str, phrases: Sequence[str]) -> Column:
    """Case-insensitive: does the text hold at least one of the phrases?"""
    lowered = F.lower(col(text))
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase.lower())
    return found


def is_english(text: Column | str) -> Column:
    """More than 70 % of the letters are ASCII; no letters means no."""
    letters = F.length(F.regexp_replace(col(text), r"\P{L}", ""))
    ascii_letters = F.length(F.regexp_replace(col(text), "[^A-Za-z]", ""))
    return F.coalesce(F.try_divide(ascii_letters, letters) > fx.ENGLISH_SHARE, F.lit(False))


def clean_content(text: Column | str) -> Column:
    """Strip, then turn the Unicode line and paragraph marks into newlines."""
    return F.translate(strip(text), "\u2028\u2029", "\n\n")


def passes_quality(
    text: Column | str,
    *,
    min_chars: int = 10,
    language: str | None = None,
    exclude: Sequence[str] = (),
) -> Column:
    keep = F.length(col(text)) >= min_chars
    if language == "en":
        keep = keep & is_english(text)
    if exclude:
        keep = keep & ~contains_any(text, exclude)
    return keep


def excerpt(text: Column | str, limit: int = 220) -> Column:
    """White space collapsed; longer texts end in an ellipsis at ``limit``."""
    flat = F.regexp_replace(
        strip(F.coalesce(col(text), F.lit(""))), rf"[{fx.SPACE}]+", " "
    )
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))
    )


def compact(text: Column | str, limit: int, marker: str = "\n\n...[{n}]...\n\n") -> Column:
    """Keep head and tail of a long text around a marker that names its length."""
    whole = F.coalesce(col(text), F.lit(""))
    head = limit // 2
    before, after = marker.split("{n}")
    return F.when(F.length(whole) <= limit, whole).otherwise(
        F.concat(
            F.left(whole, F.lit(head)),
            F.lit(before),
            F.length(whole).cast("string"),
            F.lit(after),
            F.right(whole, F.lit(limit - head)),
        )
    )


def korean_main(text: Column | str) -> Column:
    """Clear Korean majority: 30 syllables or more and 1.8 x the Latin letters."""
    hangul = matches(text, "[가-힣]")
    latin = matches(text, "[A-Za-z]")
    return (hangul >= fx.KOREAN_MAIN_MIN) & (hangul >= latin * fx.KOREAN_MAIN_RATIO)


def render_template(template: Column | str, params: Column | str) -> Column:
    """Fill ``{name}`` marks from a map; if one stays open the template is kept."""
    template = col(template)
    params = F.coalesce(col(params), F.create_map().cast("map<string,string>"))
    # The template is split at its marks once, so a value that holds a mark stays as it is.
    filled = F.array_join(
        F.zip_with(
            F.split(template, r"\{\w+\}", -1), F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)),
            lambda piece, name: F.concat(
                piece, F.when(name.isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(params, name), F.lit("")))
            ),
        ),
        "",
    )
    missing = F.exists(
        F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)),
        lambda name: ~F.coalesce(F.map_contains_key(params, name), F.lit(False)),
    )
    return F.when(missing, template).otherwise(filled)


def numbered_lines(items: Column | str, text_of: Callable[[Column], Column]) -> Column:
    """``1. first\\n2. second`` from an array."""
    return F.array_join(
        F.transform(
            col(items),
            lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), text_of(item)),
        ),
        "\n",
    )


def prompt_preamble(prompt: Column | str, marker: str = fx.PROMPT_RULE_MARKER) -> Column:
    """Text before the rule marker; a prompt without the marker is an error."""
    text = col(prompt)
    return F.when(text.contains(marker), strip(F.substring_index(text, marker, 1))).otherwise(
        F.raise_error(F.lit("system prompt does not hold the rule marker"))
    )
