"""Judge replies (free text) to verdict columns, stage by stage, without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import text as tx
from holdfast.functions.text import col

_FENCED = rf"(?s)```(?:json)?[{fx.SPACE}]*(\{{.*?\}})[{fx.SPACE}]*```"
_OUTERMOST = r"(?s)\{.*\}"


def _embedded(raw: Column, field: str) -> Column:
    """The first flat object in the text that names the field."""
    return F.regexp_extract(raw, rf'\{{[^{{}}]*"{field}"[^{{}}]*\}}', 0)




def _json(text: Column) -> Column:
    return F.when(text.rlike(tx.MAY_BE_JSON), F.try_parse_json(text))


def _get(value: Column, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{field}", kind)


def _has(value: Column, field: str) -> Column:
    return F.coalesce(F.variant_get(value, f"$.{field}", "variant").isNotNull(), F.lit(False))


def truthy(value: Column, field: str) -> Column:
    """Python truth of a JSON field: false, 0, "", null, [] and {} are false."""
    inner = F.variant_get(value, f"$.{field}", "variant")
    kind = F.schema_of_variant(inner)
    written = F.try_variant_get(value, f"$.{field}", "string")
    return (
        F.when(inner.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", written == "true")
        .when(kind == "STRING", written != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~written.isin("{}", "[]"))
        .otherwise(F.coalesce(written.cast("double") != 0, F.lit(False)))
    )


def _bound(raw: Column | str, *parsed: Column, use: Callable[[Column], Column]) -> Column:
    """Bind the text and its first parsable reading (``t`` and ``v``) for ``use``."""
    return tx.bind(
        F.struct(F.coalesce(col(raw), F.lit("")).alias("t"), F.coalesce(*parsed).alias("v")), use
    )


def task_verdict(raw: Column | str) -> Column:
    """``struct<reasoning, verdict, score>``: direct, fenced, embedded JSON, then keywords."""
    text = F.coalesce(col(raw), F.lit(""))

    def complete(candidate: Column) -> Column:
        return tx.bind(
            _json(candidate), lambda v: F.when(_has(v, "score") & _has(v, "verdict"), v)
        )

    def verdict(b: Column) -> Column:
        lowered = F.lower(b["t"])
        says_pass, says_fail = lowered.contains("pass"), lowered.contains("fail")

        def fallback(name: str, score: int) -> Column:
            return F.struct(
                b["t"].alias("reasoning"), F.lit(name).alias("verdict"), F.lit(score).alias("score")
            )

        return (
            F.when(
                b["v"].isNotNull(),
                F.struct(
                    F.coalesce(_get(b["v"], "reasoning"), F.lit("")).alias("reasoning"),
                    _get(b["v"], "verdict").alias("verdict"),
                    _get(b["v"], "score", "int").alias("score"),
                ),
            )
            .when(says_pass & ~says_fail, fallback("PASS", 1))
            .when(says_fail, fallback("FAIL", 0))
            .otherwise(fallback("PARSE_ERROR", 0))
        )

    stages = [tx.strip(text), F.regexp_extract(text, _FENCED, 1), _embedded(text, "verdict")]
    return _bound(text, *[complete(s) for s in stages], use=verdict)


def _reason(value: Column) -> Column:
    return F.coalesce(_get(value, "reason"), _get(value, "reasoning"), F.lit(""))


def rule_verdict(raw: Column | str) -> Column:
    """``struct<pass, detail>`` of one rule reply; null pass is pending or not applicable."""
    text = F.coalesce(col(raw), F.lit(""))
    unknown = F.lit(None).cast("boolean")

    def verdict(passed: Column, detail: Column) -> Column:
        return F.struct(passed.alias("pass"), detail.alias("detail"))

    def cut(head: str, part: Column, n: int) -> Column:
        return F.concat(F.lit(head), F.left(part, F.lit(n)))

    def decide(b: Column) -> Column:
        raw_text, value = b["t"], b["v"]
        reason = _reason(value)
        applicable = ~_has(value, "applicable") | truthy(value, "applicable")
        lowered = F.lower(raw_text)
        says_true = lowered.contains('"pass": true') | lowered.contains('"pass":true')
        says_false = lowered.contains('"pass": false') | lowered.contains('"pass":false')
        return (
            F.when(raw_text == "", verdict(unknown, F.lit("empty judge response")))
            .when(
                _has(value, "pass"),
                F.when(
                    ~applicable, verdict(unknown, cut("not applicable: ", reason, 80))
                ).otherwise(verdict(truthy(value, "pass"), F.left(reason, F.lit(100)))),
            )
            .when(says_true | says_false, verdict(says_true, cut("fallback_parse: ", raw_text, 80)))
            .otherwise(verdict(unknown, cut("parse_error: ", raw_text, 100)))
        )

    return _bound(text, _json(tx.strip(text)), _json(_embedded(text, "pass")), use=decide)


def coerced_bool(value: Column, field: str, default: bool) -> Column:
    """Booleans, numbers and yes/no words of a JSON field; anything else is the default."""
    inner = F.variant_get(value, f"$.{field}", "variant")
    kind = F.schema_of_variant(inner)
    word = F.lower(tx.strip(F.try_variant_get(value, f"$.{field}", "string")))
    number = F.try_variant_get(value, f"$.{field}", "double")
    return (
        F.when(inner.isNull() | (kind == "VOID"), F.lit(default))
        .when(kind == "BOOLEAN", word == "true")
        .when(
            kind == "STRING",
            F.when(word.isin(fx.JUDGE_TRUE_WORDS), F.lit(True))
            .when(word.isin(fx.JUDGE_FALSE_WORDS), F.lit(False))
            .otherwise(F.lit(default)),
        )
        .otherwise(F.coalesce(number != 0, F.lit(default)))
    )


def reply_object(raw: Column | str) -> Column:
    """The JSON object of a reply: fenced part first, whole text, outermost braces."""
    text = F.coalesce(col(raw), F.lit(""))
    inner = tx.bind(
        F.regexp_extract(text, _FENCED, 1),
        lambda fenced: F.when(fenced != "", fenced).otherwise(tx.strip(text)),
    )
    return tx.bind(inner, lambda t: F.coalesce(_json(t), _json(F.regexp_extract(t, _OUTERMOST, 0))))


def batch_verdicts(raw: Column | str) -> Column:
    """``array<struct<item_id, applicable, pass, reasoning>>`` of a batched reply."""
    results = F.try_variant_get(reply_object(raw), "$.results", "array<variant>")
    rows = F.transform(
        F.coalesce(results, F.array().cast("array<variant>")),
        lambda item: F.struct(
            tx.strip(F.coalesce(_get(item, "item_id"), F.lit(""))).alias("item_id"),
            coerced_bool(item, "applicable", True).alias("applicable"),
            coerced_bool(item, "pass", False).alias("pass"),
            F.left(_reason(item), F.lit(120)).alias("reasoning"),
        ),
    )
    return F.filter(rows, lambda r: r["item_id"] != "")


def column_verdict(raw: Column | str, target_rule: Column | str) -> Column:
    """Whole-response verdict; the non-target flag is recomputed from the failed list."""
    target = col(target_rule)
    stripped = tx.strip(F.coalesce(col(raw), F.lit("")))
    bare = F.regexp_replace(
        F.regexp_replace(stripped, rf"\A```(?:json)?[{fx.SPACE}]*", ""), rf"[{fx.SPACE}]*```\z", ""
    )
    text = F.when(stripped.startswith("```"), bare).otherwise(stripped)
    parsed = tx.bind(text, lambda t: F.coalesce(_json(t), _json(F.regexp_extract(t, _OUTERMOST, 0))))

    def verdict(value: Column) -> Column:
        listed = F.try_variant_get(value, "$.failed_rules", "array<string>")
        named = F.filter(
            F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda r: tx.strip(r)),
            lambda r: F.coalesce(r != "", F.lit(False)),
        )
        return tx.bind(
            named,
            lambda failed: F.struct(
                truthy(value, "perfect_success").alias("perfect_success"),
                F.exists(failed, lambda r: r != target).alias("non_target_failure"),
                failed.alias("failed_rules"),
                F.left(F.coalesce(_get(value, "reason"), F.lit("")), F.lit(120)).alias("reason"),
            ),
        )

    return tx.bind(parsed, lambda value: F.when(value.isNotNull(), verdict(value)))


def suggestion_note(failed: Column | str, reason: Column | str, label: str = "SUGGESTED") -> Column:
    listed = F.coalesce(F.nullif(F.array_join(col(failed), ","), F.lit("")), F.lit("none"))
    return F.concat(
        F.lit(f"{label} failed_rules="), listed, F.lit("; reason="), F.coalesce(col(reason), F.lit(""))
    )


def append_note(notes: Column | str, addition: Column | str, separator: str = " | ") -> Column:
    kept = F.nullif(tx.strip(F.coalesce(col(notes), F.lit(""))), F.lit(""))
    return F.concat_ws(separator, kept, col(addition))
