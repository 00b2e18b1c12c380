"""Corpus preparation: user turns, conversations, instruction and scenario probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import labels as lb
from holdfast.functions import text as tx
from holdfast.operators.common import first_n_per_key

# --- user turns -------------------------------------------------------------------


def user_turns(messages: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """User messages with cleaned, non-empty content."""
    rows = messages.filter(F.col(role).isin(fx.USER_ROLES)).withColumn("content", tx.clean_content(text))
    return rows.filter(F.col("content") != "")


def with_quality(turns: DataFrame, **filters: object) -> DataFrame:
    return turns.withColumn("keep", tx.passes_quality("content", **filters))


def token_bin(tokens: Column | str, bins: Mapping[str, tuple[int, int]]) -> Column:
    """First bin whose inclusive range holds the token count.  Bins must not overlap."""
    ranges = sorted(bins.values())
    if any(a[1] >= b[0] for a, b in zip(ranges, ranges[1:])):
        raise ValueError("token bins overlap")
    chain = F.lit(None).cast("string")
    for name, (low, high) in bins.items():
        chain = F.when(tx.col(tokens).between(low, high), F.lit(name)).otherwise(chain)
    return chain


def bin_turns(
    turns: DataFrame, bins: Mapping[str, tuple[int, int]], cap: int, order: Sequence[Column],
    counter: tx.TokenCounter = tx.token_count, prefix: str = "pool",
) -> DataFrame:
    """Turns by token length, the first ``cap`` of each bin in input order, with ids.

    A bin that holds most of the corpus is cut before the shuffle.
    """
    sized = turns.withColumn("token_count", counter(F.col("content")))
    placed = sized.withColumn("token_length_bin", token_bin("token_count", bins)).filter(
        F.col("token_length_bin").isNotNull()
    )
    kept = first_n_per_key(placed, ["token_length_bin"], order, cap, "bin_rank")
    return kept.withColumn(
        "turn_id",
        F.concat_ws("_", F.lit(prefix), "token_length_bin", (F.col("bin_rank") - 1).cast("string")),
    )


def prep_counters(turns: DataFrame, bins: Mapping[str, tuple[int, int]], cap: int,
                  counter: tx.TokenCounter = tx.token_count) -> DataFrame:
    """One row: extracted, filtered, and kept per bin."""
    bin_of = F.when(F.col("keep"), token_bin(counter(F.col("content")), bins))
    return turns.withColumn("_bin", bin_of).agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(~F.col("keep")).alias("filtered"),
        *[
            F.least(F.count_if(F.col("_bin") == name), F.lit(cap)).alias(f"kept_{name}")
            for name in bins
        ],
    )


# --- conversations -------------------------------------------------------------------


def clean_turns(messages: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """User and assistant messages with content."""
    return messages.filter(F.col(role).isin("user", "assistant") & (F.col(text) != ""))


def nested_turns(conversation: Column | str) -> Column:
    """The same on an array of ``struct<role, content>``."""
    return F.filter(
        tx.col(conversation), lambda m: m["role"].isin("user", "assistant") & (m["content"] != "")
    )


def conversation_table(
    turns: DataFrame, key: str, attributes: Sequence[str] = (), min_user_turns: int = 2,
    axes: Sequence[str] = (),
) -> DataFrame:
    """Turn and message counts of conversations with enough user turns.

    The messages stay in their own table; only counts are aggregated here.
    """
    rows = turns.filter(F.col("axis").isin(list(axes))) if axes else turns
    return (
        rows.groupBy(key, *attributes)
        .agg(
            F.count_if(F.col("role") == "user").alias("turn_count"),
            F.count(F.lit(1)).alias("total_messages"),
        )
        .filter(F.col("turn_count") >= min_user_turns)
    )


def axis_distribution(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy(F.coalesce(F.col("axis"), F.lit("unknown")).alias("axis")).agg(
        F.count(F.lit(1)).alias("conversations")
    )


# --- instruction probes -----------------------------------------------------------------


def scorable_prompts(prompts: DataFrame, scorable: Sequence[str]) -> DataFrame:
    """Prompts with text and ids whose instruction types can all be scored."""
    known = F.array(*[F.lit(s) for s in scorable])
    return prompts.filter(
        (F.coalesce(F.length("prompt"), F.lit(0)) > 0)
        & (F.coalesce(F.size("instruction_ids"), F.lit(0)) > 0)
        & (F.size(F.array_except("instruction_ids", known)) == 0)
    )


def constraints_of(ids: Column | str) -> Column:
    """Instruction types -> ``array<struct<type, description>>``, unknown ones dropped."""
    known = F.create_map(*[F.lit(x) for pair in fx.CONSTRAINT_DESCRIPTIONS.items() for x in pair])
    described = F.transform(
        tx.col(ids),
        lambda i: F.struct(i.alias("type"), F.try_element_at(known, i).alias("description")),
    )
    return F.filter(described, lambda c: c["description"].isNotNull())


def _last_end(text: Column, mark: str) -> Column:
    """0-based position of the last ``mark`` (two characters), -1 without one."""
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.length(text) - back - 1).otherwise(F.lit(-1))


def split_task_and_rules(prompt: Column | str) -> Column:
    """``struct<task, rules>``: cut before the first format phrase, at a sentence end.

    The search runs over the whole text, so its result is bound once.
    """
    signal = "(?i)" + "|".join(f"(?:{p})" for p in fx.FORMAT_SIGNALS)
    text = tx.col(prompt)
    found = F.struct(
        text.alias("text"), F.regexp_instr(text, F.lit(signal)).alias("at")
    )

    def cut(bound: Column) -> Column:
        before = F.left(bound["text"], bound["at"] - 1)
        sentence = F.greatest(*[_last_end(before, m) for m in (". ", ".\n", "?\n")])
        return F.struct(
            bound["text"].alias("text"), bound["at"].alias("at"),
            F.when(sentence > 0, sentence + 1).otherwise(bound["at"] - 1).alias("cut"),
        )

    def parts(bound: Column) -> Column:
        whole, end = bound["text"], bound["cut"]
        return F.when(
            bound["at"] > 0,
            F.struct(
                tx.strip(F.left(whole, end)).alias("task"),
                tx.strip(F.substring(whole, end + 1, F.length(whole))).alias("rules"),
            ),
        ).otherwise(F.struct(whole.alias("task"), F.lit("").alias("rules")))

    return tx.bind(tx.bind(found, cut), parts)


def format_prompt(rules: Column | str, constraints: Column | str) -> Column:
    """System prompt from the rule text, else from the joined descriptions."""
    rules, constraints = tx.col(rules), tx.col(constraints)
    listed = F.array_join(F.transform(constraints, lambda c: c["description"]), "; ")
    body = F.when(rules != "", rules).otherwise(listed)
    return F.when(
        (rules == "") & (F.size(constraints) == 0), F.lit("")
    ).otherwise(F.concat(F.lit(fx.FORMAT_PROMPT_HEAD), body))


def instruction_probes(prompts: DataFrame, scorable: Sequence[str]) -> DataFrame:
    """Scorable prompts as probes with task, system prompt and constraint list."""
    rows = scorable_prompts(prompts, scorable).withColumns(
        {"constraints": constraints_of("instruction_ids"), "_s": split_task_and_rules("prompt")}
    )
    rows = rows.filter(F.size("constraints") > 0)
    return rows.withColumns(
        {
            "task": F.col("_s.task"),
            "system_prompt": format_prompt("_s.rules", "constraints"),
            "rule_count": F.size("constraints"),
            "scoring_check": F.array_join(F.transform("constraints", lambda c: c["description"]), "; "),
        }
    ).drop("_s")


def first_probes(probes: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return probes.orderBy(*order).limit(n)


# --- scenario probes -----------------------------------------------------------------------


def scenario_probes(
    cases: DataFrame, scenarios: DataFrame, per_scenario: int, order: Sequence[Column]
) -> DataFrame:
    """First cases of each scenario and suite, rendered; failed extractions drop out.

    ``cases``: scenario, suite, params (map), messages (array of role / content).
    ``scenarios``: scenario, template, check_template, rule_count (a few rows).
    """
    picked = first_n_per_key(cases, ["suite", "scenario"], order, per_scenario, "case_rank")
    rows = picked.join(scenarios, "scenario")
    asked = F.filter("messages", lambda m: m["role"] == "user")
    return (
        rows.withColumns(
            {
                "system_prompt": tx.render_template("template", "params"),
                "probe": F.try_element_at(asked, F.lit(-1))["content"],
                "rule_count_level": lb.rule_count_level("rule_count"),
                "scoring_check": tx.render_template(
                    F.coalesce("check_template", F.lit("manual check required")), "params"
                ),
                "probe_id": F.concat_ws(
                    "_", F.lit("rules"), "scenario", "suite", (F.col("case_rank") - 1).cast("string")
                ),
            }
        )
        .filter((F.col("system_prompt") != "") & F.col("probe").isNotNull())
        .drop("template", "check_template", "case_rank")
    )


def numbered_prompt(rules: Column | str, head: str, tail: str) -> Column:
    """Header, numbered rule texts, footer."""
    return F.concat(F.lit(head), tx.numbered_lines(rules, lambda r: r["text"]), F.lit(tail))


def probe_matrix(
    questions: DataFrame, levels: Mapping[int, Sequence[int]], targets: Mapping[int, Sequence[int]],
    per_condition: int = 2,
) -> DataFrame:
    """Level x target x intensity x question index.

    ``questions``: target_rule, intensity, questions (array).  Levels and targets are
    small fixed maps, so each question row is expanded in place.
    """
    pairs = [(lv, t) for lv, ts in targets.items() for t in ts]
    rules = F.create_map(
        *[x for lv, ids in levels.items() for x in (F.lit(lv), F.array(*[F.lit(i) for i in ids]))]
    )
    rows = questions.withColumn(
        "_pair",
        F.explode(
            F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(t).alias("target")) for lv, t in pairs])
        ),
    ).filter(F.col("_pair.target") == F.col("target_rule"))
    rows = rows.select(
        F.col("_pair.level").alias("rule_count_level"), "target_rule", "intensity",
        F.posexplode(F.slice("questions", 1, per_condition)).alias("probe_index", "question"),
    )
    return rows.withColumns(
        {
            "rule_ids": rules[F.col("rule_count_level")],
            "probe_id": F.format_string(
                "L%d_R%d_%s_P%d", "rule_count_level", "target_rule", "intensity", "probe_index"
            ),
        }
    )


