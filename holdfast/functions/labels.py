"""Small label and key normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions.text import col, strip


def _aliased(value: Column, aliases: dict[str, str]) -> Column:
    """Old names replaced; ``value`` is used once, so nothing is computed twice."""
    out = value
    for old, new in aliases.items():
        out = F.regexp_replace(out, f"^{old}$", new)
    return out


def rule_type(value: Column | str) -> Column:
    value = F.coalesce(F.nullif(col(value), F.lit("")), F.lit("unknown"))
    return _aliased(value, fx.RULE_TYPE_ALIASES)


def attack_mode(value: Column | str) -> Column:
    return _aliased(F.coalesce(col(value), F.lit("")), fx.ATTACK_MODE_ALIASES)


def temperature(direct: Column | str, nested: Column | str | None = None) -> Column:
    """The row's own temperature, else its generation settings, else 0.0."""
    options = [col(direct)] + ([col(nested)] if nested is not None else [])
    return F.coalesce(*[o.cast("double") for o in options], F.lit(0.0))


def temperature_tag(value: Column | str) -> Column:
    """0.7 -> temp0p7, -1.0 -> tempm1."""
    fixed = F.format_string("%.3f", col(value).cast("double"))
    short = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return F.concat(F.lit("temp"), F.translate(short, "-.", "mp"))


def run_id(case_id: Column | str, rep: Column | str, model: Column | str, temp: Column | str) -> Column:
    return F.concat_ws("_", col(case_id).cast("string"), col(rep).cast("string"), col(model), temperature_tag(temp))


def natural_rule_number(rule_id: Column | str) -> Column:
    """Sort key part: R2 before R10, ids without digits last."""
    digits = F.regexp_replace(col(rule_id), r"\D", "")
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(999))


def natural_rule_order(rule_id: Column | str) -> list[Column]:
    return [natural_rule_number(rule_id), col(rule_id)]


def base_method(variant: Column | str, methods: list[str]) -> Column:
    """Transform family of a variant name, e.g. sliding_window_3 -> sliding_window."""
    variant = col(variant)
    out = variant
    for method in reversed(methods):
        out = F.when(variant.startswith(method), F.lit(method)).otherwise(out)
    return out


def rule_count_level(count: Column | str) -> Column:
    return F.when(col(count) <= 1, 1).when(col(count) <= 3, 3).otherwise(5)


def text_bool(value: Column | str) -> Column:
    """TRUE / FALSE / NA / '' as the label sheets write them."""
    upper = F.upper(strip(F.coalesce(col(value), F.lit(""))))
    return (
        F.when(upper.isin("TRUE", "FALSE", "NA"), upper)
        .when(upper == "NONE", F.lit("NA"))
        .otherwise(F.lit(""))
    )


def bool_of_text(value: Column | str) -> Column:
    normal = text_bool(value)
    return F.when(normal == "TRUE", F.lit(True)).when(normal == "FALSE", F.lit(False))


def label_text(value: Column | str) -> Column:
    """Common yes/no spellings to TRUE / FALSE; anything else stays as typed."""
    raw = strip(col(value))
    lowered = F.lower(raw)
    return (
        F.when(lowered.isin(fx.TRUE_WORDS), F.lit("TRUE"))
        .when(lowered.isin(fx.FALSE_WORDS), F.lit("FALSE"))
        .otherwise(raw)
    )


def bool_label(value: Column | str) -> Column:
    value = col(value)
    return F.when(value, F.lit("TRUE")).when(~value, F.lit("FALSE")).otherwise(F.lit("NA"))


def attack_position(mode: Column | str, turn: Column | str, turn_count: Column | str) -> Column:
    """Where an attack turn sits: single, first or second of the final two."""
    mode, turn, turn_count = col(mode), col(turn), col(turn_count)
    return (
        F.when(~F.coalesce(mode.isin(fx.ATTACK_MODES), F.lit(False)), F.lit("non_attack"))
        .when(turn_count == 1, F.lit("single_attack"))
        .when(turn == turn_count - 1, F.lit("first_attack"))
        .when(turn == turn_count, F.lit("second_attack"))
        .otherwise(F.lit("attack_turn"))
    )


def is_unresolved(method: Column | str, passed: Column | str, detail: Column | str) -> Column:
    """A judge cell that still waits for a verdict."""
    return (
        F.coalesce(col(method).isin(fx.JUDGE_METHODS), F.lit(False))
        & col(passed).isNull()
        & ~F.lower(F.coalesce(col(detail), F.lit(""))).startswith("not applicable")
    )


def sampling_key(*parts: Column | str) -> Column:
    """Deterministic sort key: SHA-256 of the joined parts."""
    return F.sha2(F.concat_ws("::", *[col(p).cast("string") for p in parts]), 256)
