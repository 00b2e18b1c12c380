"""Queries on design generation and on conversation-context transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import text as tx
from holdfast.operators import context as cx
from holdfast.operators import design as ds
from holdfast.operators import prep
from holdfast.operators import sampling as sm
from holdfast.operators import profiles as pf
from holdfast.operators import transform_report as tr
from holdfast.operators.common import rounded
from holdfast.plans import testbed as tb
from holdfast.plans.registry import query
from holdfast.plans.text_queries import BINS, POOL_SQL, TOKENS, _pool, count_sql

SEVEN = tb.RULE_IDS
POOL = [f"Question {i} about an order, please." for i in range(1, 13)]
POOL_LIST = "[" + ", ".join(f"'{p}'" for p in POOL) + "]"

# --- rule sets and cases -----------------------------------------------------------------

VARIANTS_SQL = """
ids AS (SELECT unnest(range(1, 8)) AS t),
masks AS (SELECT unnest(range(0, 64)) AS m),
v0 AS (SELECT t, m, list_filter(range(0, 6), lambda i: (m >> i) & 1 = 1) AS bits FROM ids, masks),
v1 AS (SELECT *, len(bits) + 1 AS rc, list_transform(bits, lambda i: 'R0' || (CASE WHEN i + 1 < t THEN i + 1 ELSE i + 2 END)) AS fillers FROM v0),
variants AS (SELECT 'R0' || t AS target_rule_id, CAST(rc AS INTEGER) AS rule_count, fillers,
    list_sort(list_append(fillers, 'R0' || t)) AS active,
    row_number() OVER (PARTITION BY t, rc ORDER BY bits) AS possible_ordinal, count(*) OVER (PARTITION BY t, rc) AS possible_count
  FROM v1 WHERE rc IN (1, 3, 5, 7)),
designs AS (SELECT s_suppkey AS design_id, 's' || s_suppkey AS seed, 'R0' || (1 + s_suppkey % 7) AS target_rule_id FROM supplier),
sets AS (SELECT * FROM designs JOIN variants USING (target_rule_id))
"""


def designs(spark, sf):
    key = F.col("s_suppkey")
    return tb.table(spark, sf, "supplier").select(
        key.alias("design_id"), F.concat(F.lit("s"), key.cast("string")).alias("seed"),
        F.element_at(F.array(*[F.lit(r) for r in SEVEN]), (key % 7).cast("int") + 1).alias("target_rule_id"),
    )


@query(
    "rule_set_variants",
    f"""WITH {VARIANTS_SQL} SELECT design_id, rule_count, array_to_string(fillers, ',') AS fillers,
      array_to_string(active, ',') AS active, possible_ordinal, possible_count FROM sets""",
)
def rule_set_variants(spark, sf):
    rows = ds.design_rule_sets(designs(spark, sf), ds.rule_set_variants(spark, SEVEN))
    return rows.select(
        "design_id", "rule_count", F.array_join("filler_rule_ids", ",").alias("fillers"),
        F.array_join("active_rule_ids", ",").alias("active"),
        F.col("possible_ordinal").cast("long").alias("possible_ordinal"), "possible_count",
    )


SAMPLED_SQL = f"""{VARIANTS_SQL},
wanted AS (SELECT *, {tb.keys_sql("seed", "target_rule_id", "rule_count", "10")} AS ks
  FROM (SELECT DISTINCT design_id, seed, target_rule_id, rule_count, possible_count FROM sets)),
drawn AS (SELECT *, unnest(range(1, least(possible_count, 10) + 1)) AS sampled_ordinal FROM wanted),
numbered AS (SELECT design_id, rule_count, sampled_ordinal, CASE WHEN possible_count <= 10 THEN sampled_ordinal
    ELSE 1 + {tb.permuted_sql("sampled_ordinal - 1", "possible_count", "ks")} END AS possible_ordinal FROM drawn),
picked AS (SELECT *, printf('RC%d_S%03d', rule_count, sampled_ordinal) AS sampled_variant_id,
    printf('RC%d_P%03d', rule_count, possible_ordinal) AS possible_variant_id
  FROM sets JOIN numbered USING (design_id, rule_count, possible_ordinal))
"""


def _sampled(spark, sf):
    return ds.sampled_rule_sets(designs(spark, sf), SEVEN, samples=10)


@query(
    "sampled_rule_sets",
    f"""WITH {SAMPLED_SQL} SELECT design_id, sampled_variant_id, possible_variant_id, array_to_string(active, ',') AS active,
      least(possible_count, 10) AS sampled_count FROM picked""",
)
def sampled_rule_sets(spark, sf):
    return _sampled(spark, sf).select(
        "design_id", "sampled_variant_id", "possible_variant_id", F.array_join("active_rule_ids", ",").alias("active"),
        F.col("sampled_count").cast("long").alias("sampled_count"),
    )


KIND_SQL = "['language','format','format','behavior','behavior','persona','persona'][CAST(x[2:] AS INTEGER)]"


@query(
    "category_composition",
    f"""WITH {VARIANTS_SQL}, k AS (SELECT design_id, rule_count, possible_ordinal, list_transform(active, lambda x: {KIND_SQL}) AS ks FROM sets)
    SELECT design_id, rule_count, possible_ordinal, concat_ws(',',
      {", ".join(f"CASE WHEN list_contains(ks, '{n}') THEN '{n}=' || len(list_filter(ks, lambda y: y = '{n}')) END" for n in sorted(fx.RULE_TYPES))}) AS composition
    FROM k""",
)
def category_composition(spark, sf):
    rows = ds.design_rule_sets(designs(spark, sf), ds.rule_set_variants(spark, SEVEN))
    entries = F.map_entries(ds.composition("active_rule_ids", tb.RULE_TYPES))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return rows.select(
        "design_id", "rule_count", F.col("possible_ordinal").cast("long").alias("possible_ordinal"), text.alias("composition")
    )


PROMPTS_SQL = """
prompts0 AS (SELECT 'R0' || (1 + item_id % 7) AS rule_id, 1 + (item_id // 7) % 2 AS level, item_id, text FROM benchmark),
prompts AS (SELECT rule_id, level, 'p' || min(item_id) AS prompt_id, arg_min(text, item_id) AS prompt_text FROM prompts0 GROUP BY 1, 2)
"""


def attack_prompts(spark, sf):
    """First benchmark text of each rule and level as its attack prompt."""
    item = F.col("item_id")
    rows = tb.table(spark, sf, "benchmark").select(
        F.element_at(F.array(*[F.lit(r) for r in SEVEN]), (item % 7).cast("int") + 1).alias("rule_id"),
        (1 + F.floor(item / 7) % 2).cast("int").alias("level"), item, "text",
    )
    return rows.groupBy("rule_id", "level").agg(
        F.concat(F.lit("p"), F.min("item_id").cast("string")).alias("prompt_id"),
        F.min_by("text", "item_id").alias("prompt_text"),
    )


BALANCED_SQL = f"""{VARIANTS_SQL}, {PROMPTS_SQL},
sets2 AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY rule_count, possible_ordinal) - 1 AS s FROM sets),
bal AS (SELECT *, (s * 4 + ti) * 2 + a AS case_number, [1, 5, 10, 15][CAST(ti + 1 AS INTEGER)] AS turn_count
  FROM sets2, (SELECT unnest(range(0, 4)) AS ti), (SELECT unnest([0, 1]) AS a))
"""


def _balanced(spark, sf):
    return ds.balanced_cases(designs(spark, sf), ds.rule_set_variants(spark, SEVEN))


@query(
    "balanced_case_matrix",
    f"""WITH {BALANCED_SQL} SELECT design_id || '_' || printf('%05d', case_number) AS case_id, rule_count,
      CAST(turn_count AS INTEGER) AS turn_count, target_rule_id, printf('RC%d_V%03d', rule_count, possible_ordinal) AS filler_variant_id,
      CASE a WHEN 1 THEN 'escalation_attack' ELSE 'benign_context' END AS condition, array_to_string(active, ',') AS rule_set,
      CASE WHEN a = 0 THEN 'all benign' WHEN turn_count = 1 THEN 'T=1:L2' ELSE 'B×' || (turn_count - 2) || ',L1,L2' END AS schedule
    FROM bal""",
)
def balanced_case_matrix(spark, sf):
    return _balanced(spark, sf).select(
        "case_id", "rule_count", "turn_count", "target_rule_id", "filler_variant_id", "condition",
        F.array_join("rule_set_variant", ",").alias("rule_set"), "schedule",
    )


@query(
    "balanced_conversation_turns",
    f"""WITH {BALANCED_SQL},
    t AS (SELECT *, unnest(range(1, turn_count + 1)) AS turn FROM (SELECT *, {tb.keys_sql("seed", "case_number")} AS ks FROM bal)),
    x AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN turn_count = 1 THEN 2 WHEN turn = turn_count - 1 THEN 1 WHEN turn = turn_count THEN 2 ELSE 0 END AS lv FROM t)
    SELECT design_id || '_' || printf('%05d', case_number) AS case_id, CAST(turn AS INTEGER) AS turn,
      CASE lv WHEN 0 THEN 'benign' WHEN 1 THEN 'implicit_attack' ELSE 'strong_pressure' END AS attack_mode,
      CASE WHEN lv = 0 THEN {POOL_LIST}[CAST(1 + {tb.permuted_sql(f"(turn - 1) % {len(POOL)}", str(len(POOL)), "ks")} AS INTEGER)] ELSE prompt_text END AS content,
      CASE WHEN lv = 0 THEN '' ELSE x.target_rule_id END AS attack_targets, CASE WHEN lv > 0 THEN prompt_id END AS prompt_id
    FROM x LEFT JOIN prompts p ON p.rule_id = x.target_rule_id AND p.level = lv""",
)
def balanced_conversation_turns(spark, sf):
    lookup = ds.prompt_lookup(attack_prompts(spark, sf))
    cases = ds.with_balanced_conversation(_balanced(spark, sf), lookup, POOL)
    # The outer form spares the filter on its input, which would build every conversation twice.
    turns = cases.select("case_id", F.inline_outer("conversation_template"))
    return turns.select(
        "case_id", "turn", "attack_mode", "content", F.array_join("attack_targets", ",").alias("attack_targets"), "prompt_id"
    )


@query(
    "benign_turn_schedule",
    f"""WITH c AS (SELECT o_orderkey AS case_id, [1, 5, 10, 15][CAST(1 + o_orderkey % 4 AS INTEGER)] AS turn_count,
      {tb.keys_sql("o_custkey", "o_orderkey")} AS ks FROM orders),
    t AS (SELECT *, unnest(range(1, turn_count + 1)) AS turn, (SELECT count(*) FROM part) AS n FROM c),
    x AS (SELECT case_id, CAST(turn AS INTEGER) AS turn, {tb.permuted_sql("(turn - 1) % n", "n", "ks")} AS place FROM t)
    SELECT case_id, turn, p_name AS content FROM x JOIN part ON p_partkey = place""",
)
def benign_turn_schedule(spark, sf):
    """Every order as a case, all parts as its pool."""
    key = F.col("o_orderkey")
    cases = tb.table(spark, sf, "orders").select(
        key.alias("case_id"), "o_custkey", F.element_at(F.lit(fx.TURN_COUNTS), (key % 4).cast("int") + 1).alias("turn_count")
    )
    pool = tb.table(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("content"))
    return ds.benign_turns(cases, pool, pool.count(), "o_custkey", "case_id").select("case_id", "turn", "content")


LARGE_POOL = [f"X{i:02d}" for i in range(1, 41)]


@query(
    "sampled_large_rule_sets",
    f"""WITH d AS (SELECT s_suppkey AS design_id, s_suppkey AS seed, 'X' || printf('%02d', 1 + s_suppkey % 40) AS target_rule_id FROM supplier),
    k AS (SELECT *, {tb.keys_sql("seed", "target_rule_id", "7", "10")} AS ks FROM d),
    r AS (SELECT *, unnest(range(1, 11)) AS sampled_ordinal FROM k)
    SELECT design_id, sampled_ordinal::INTEGER AS sampled_ordinal, 1 + {tb.permuted_sql("sampled_ordinal - 1", "3262623", "ks")} AS possible_ordinal,
      3262623::BIGINT AS possible_count, 1 + {tb.permuted_sql("sampled_ordinal - 1", "3262623", "ks")} AS number_of_set, 7 AS rules FROM r""",
)
def sampled_large_rule_sets(spark, sf):
    """Ten of 3,262,623 rule sets for each design; ``number_of_set`` is counted back from the rules."""
    key = F.col("s_suppkey")
    made = tb.table(spark, sf, "supplier").select(
        key.alias("design_id"), key.alias("seed"), F.element_at(F.lit(LARGE_POOL), (key % 40).cast("int") + 1).alias("target_rule_id")
    )
    rows = ds.sampled_rule_sets(made, LARGE_POOL, [7], 10)
    others = F.filter(F.lit(LARGE_POOL), lambda r: r != F.col("target_rule_id"))
    places = F.transform("filler_rule_ids", lambda r: F.array_position(others, r).cast("int") - 1)
    # Combinations that come later in dictionary order, summed over the places.
    later = F.aggregate(
        F.transform(places, lambda p, i: sm.binomial_of(38 - p, 6 - i, 39, 6)), F.lit(0).cast("long"), lambda a, c: a + c
    )
    return rows.select(
        "design_id", "sampled_ordinal", "possible_ordinal", "possible_count", (F.col("possible_count") - later).alias("number_of_set"),
        F.size("active_rule_ids").alias("rules"),
    )


@query(
    "balanced_case_counts",
    f"""WITH {BALANCED_SQL}, c AS (SELECT CAST(rule_count AS VARCHAR) AS rule_count, CAST(turn_count AS VARCHAR) AS turn_count,
      CASE a WHEN 1 THEN 'escalation_attack' ELSE 'benign_context' END AS condition, target_rule_id FROM bal) """
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM c GROUP BY 2"
        for d in ("rule_count", "turn_count", "condition", "target_rule_id")
    ),
)
def balanced_case_counts(spark, sf):
    return pf.counts_by(_balanced(spark, sf), ["rule_count", "turn_count", "condition", "target_rule_id"])


ORDERED_SQL = f"""{SAMPLED_SQL},
orders_(tc, variant, o1, o2) AS (VALUES ('one', 'none', NULL, NULL), ('many', 'none', NULL, NULL),
  ('one', 'single_implicit', 'implicit_attack', NULL), ('one', 'single_adversarial', 'adversarial_attack', NULL),
  ('many', 'implicit_then_adversarial', 'implicit_attack', 'adversarial_attack'),
  ('many', 'adversarial_then_implicit', 'adversarial_attack', 'implicit_attack')),
samp AS (SELECT p.*, CAST(turn_count AS INTEGER) AS turn_count, variant AS attack_order_variant, concat_ws(',', o1, o2) AS attack_order,
    CASE WHEN variant = 'none' THEN 'benign_context' ELSE 'injection_context' END AS condition
  FROM picked p, (SELECT unnest([1, 5, 10, 15]) AS turn_count) JOIN orders_ o ON o.tc = CASE WHEN turn_count = 1 THEN 'one' ELSE 'many' END),
samp2 AS (SELECT *, design_id || '_' || target_rule_id || '_rc' || rule_count || '_' || sampled_variant_id || '_t' || turn_count || '_' || condition AS grp FROM samp)
"""


def _sampled_cases(spark, sf):
    return ds.sampled_cases(_sampled(spark, sf), single_turn="both")


@query(
    "sampled_case_matrix",
    f"""WITH {ORDERED_SQL} SELECT grp || '_' || attack_order_variant AS case_id, condition, rule_count, turn_count, attack_order_variant,
      attack_order, CASE WHEN condition = 'injection_context' THEN grp END AS order_average_group_id,
      CASE WHEN condition = 'injection_context' THEN target_rule_id ELSE '' END AS attack_targets,
      CASE WHEN condition = 'benign_context' THEN 'all benign' WHEN turn_count = 1 THEN attack_order_variant
        ELSE 'B×' || (turn_count - 2) || ',' || attack_order END AS schedule FROM samp2""",
)
def sampled_case_matrix(spark, sf):
    return _sampled_cases(spark, sf).select(
        "case_id", "condition", "rule_count", "turn_count", "attack_order_variant",
        F.array_join("attack_order", ",").alias("attack_order"), "order_average_group_id",
        F.array_join("attack_targets", ",").alias("attack_targets"), "schedule",
    )


def _mode_lookup(spark, sf):
    prompts = attack_prompts(spark, sf).withColumn(
        "mode", F.when(F.col("level") == 1, F.lit("implicit_attack")).otherwise(F.lit("adversarial_attack"))
    )
    return ds.prompt_lookup(prompts, "mode")


def _full_sampled(spark, sf):
    return ds.with_sampled_conversation(_sampled_cases(spark, sf), _mode_lookup(spark, sf), POOL)


RULE_TABLE = [
    {"rule_id": r, "type": tb.RULE_TYPES[r], "text": f"Rule {r}: keep to {tb.RULE_TYPES[r]}.", "scoring": "llm_judge"} for r in SEVEN
]
PROMPT_HEAD, PROMPT_TAIL = "Follow these rules:\n\n", "\n\nThey hold for every turn."
DESIGN = {"design_version": "sampled_v1", "research_question": "Q1", "source_attack_prompt_file": "benchmark"}
KINDS = sorted(fx.RULE_TYPES)


def _composition_sql(rules: str) -> str:
    kinds = f"list_transform({rules}, lambda x: {KIND_SQL})"
    parts = [
        f"CASE WHEN list_contains({kinds}, '{n}') THEN '\"{n}\":' || len(list_filter({kinds}, lambda y: y = '{n}')) END" for n in KINDS
    ]
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


TEXT_SQL = f"'Rule ' || {{x}} || ': keep to ' || {KIND_SQL.replace('x[2:]', '{x}[2:]')} || '.'"
COMPLETE_SQL = f"""{ORDERED_SQL}, {PROMPTS_SQL},
keyed AS (SELECT *, {tb.keys_sql("seed", "target_rule_id", "rule_count", "sampled_variant_id", "turn_count", "attack_order_variant")} AS ks,
    string_split(attack_order, ',') AS os, condition = 'injection_context' AS inj FROM samp2),
full_ AS (SELECT s.*, {TEXT_SQL.format(x="target_rule_id")} AS target_rule_text, {_composition_sql("fillers")} AS fc, {_composition_sql("active")} AS ac,
    'Follow these rules:' || chr(10) || chr(10) || array_to_string(list_transform(active, lambda x, i: i || '. ' || {TEXT_SQL.format(x="x")}), chr(10))
      || chr(10) || chr(10) || 'They hold for every turn.' AS system_prompt,
    CASE WHEN inj THEN list_transform(os, lambda m: CASE m WHEN 'implicit_attack' THEN p1.prompt_id ELSE p2.prompt_id END) ELSE []::VARCHAR[] END AS ids,
    CASE WHEN inj THEN list_transform(os, lambda m: CASE m WHEN 'implicit_attack' THEN p1.prompt_text ELSE p2.prompt_text END) ELSE []::VARCHAR[] END AS texts,
    CASE WHEN NOT inj THEN 0 WHEN turn_count = 1 THEN 1 ELSE 2 END AS na
  FROM keyed s JOIN prompts p1 ON p1.rule_id = target_rule_id AND p1.level = 1 JOIN prompts p2 ON p2.rule_id = target_rule_id AND p2.level = 2)
"""


def _turn_sql(i: int) -> list[str]:
    """The eight cells of turn ``i`` (from 1)."""
    at = f"CAST({i} - (turn_count - na) AS INTEGER)"
    benign = f"{POOL_LIST}[CAST(1 + {tb.permuted_sql(f'{(i - 1) % len(POOL)}', str(len(POOL)), 'ks')} AS INTEGER)]"
    cells = {
        "turn": f"'{i}'", "role": "'user'", "attack_mode": f"CASE WHEN {at} > 0 THEN os[{at}] ELSE 'benign' END",
        "attack_type": f"CASE WHEN {at} > 0 THEN os[{at}] ELSE '' END", "attack_targets": f"CASE WHEN {at} > 0 THEN target_rule_id ELSE '' END",
        "scenario_id": f"CASE WHEN {at} > 0 THEN ids[{at}] ELSE '' END", "prompt_id": f"CASE WHEN {at} > 0 THEN ids[{at}] ELSE '' END",
        "content": f"CASE WHEN {at} > 0 THEN texts[{at}] ELSE {benign} END",
    }
    return [f"CASE WHEN {i} > turn_count THEN '' ELSE {cells[f]} END AS turn_{i:02d}_{f}" for f in fx.TRACE_TURN_FIELDS]


def _json_sql(items: str) -> str:
    return f"'[' || array_to_string(list_transform({items}, lambda x: '\"' || x || '\"'), ',') || ']'"


TRACE_SQL = {
    "case_id": "grp || '_' || attack_order_variant", "design_version": "'sampled_v1'", "research_question": "'Q1'",
    "system_prompt_profile": "''", "q2_profile_caveat": "''", "condition": "condition", "rule_count": "rule_count",
    "turn_count": "turn_count", "conversation_turn_count": "turn_count", "target_rule_id": "target_rule_id",
    "target_rule_category": KIND_SQL.replace("x[2:]", "target_rule_id[2:]"), "target_rule_text": "target_rule_text",
    "attack_intensity": "CASE WHEN inj THEN 'adversarial' ELSE 'benign' END", "attack_mode": "CASE WHEN inj THEN 'order_balanced' ELSE 'none' END",
    "attack_scope": "CASE WHEN inj THEN 'single_rule' ELSE 'none' END", "attack_turn_count": "CAST(na AS INTEGER)",
    "attack_order_variant": "attack_order_variant", "attack_order": "replace(attack_order, ',', '|')",
    "attack_order_json": f"CASE WHEN inj THEN {_json_sql('os')} ELSE '[]' END", "order_average_group_id": "CASE WHEN inj THEN grp ELSE '' END",
    "sampled_variant_id": "sampled_variant_id", "possible_variant_id": "possible_variant_id", "sampling_seed": "seed",
    "samples_per_rule_count": "10", "possible_combination_count": "possible_count", "sampled_combination_count": "least(possible_count, 10)",
    "active_rule_ids": "array_to_string(active, '|')", "active_rule_ids_json": _json_sql("active"),
    "filler_rule_ids": "array_to_string(fillers, '|')", "filler_rule_ids_json": _json_sql("fillers"),
    "filler_category_composition_json": "fc", "active_category_composition_json": "ac", "source_attack_prompt_file": "'benchmark'",
    "source_scenario_ids": "array_to_string(ids, '|')", "source_scenario_ids_json": _json_sql("ids"), "single_turn_attack_policy": "'both'",
    "schedule": "CASE WHEN NOT inj THEN 'all benign' WHEN turn_count = 1 THEN attack_order_variant ELSE 'B×' || (turn_count - 2) || ',' || attack_order END",
    "system_prompt": "system_prompt",
    "rule_texts_by_id_json": f"'{{' || array_to_string(list_transform(active, lambda x: '\"' || x || '\":\"' || {TEXT_SQL.format(x='x')} || '\"'), ',') || '}}'",
}


def _complete(spark, sf):
    sets = ds.with_rule_texts(_sampled(spark, sf), RULE_TABLE, PROMPT_HEAD, PROMPT_TAIL)
    cases = ds.with_sampled_conversation(ds.sampled_cases(sets, single_turn="both"), _mode_lookup(spark, sf), POOL)
    return ds.complete_cases(cases, RULE_TABLE, PROMPT_HEAD, PROMPT_TAIL, DESIGN, "order_balanced")


@query(
    "sampled_case_trace",
    f"WITH {COMPLETE_SQL} SELECT " + ", ".join(f"{v} AS {k}" for k, v in TRACE_SQL.items()) + ", "
    + ", ".join(c for i in range(1, 16) for c in _turn_sql(i)) + " FROM full_",
)
def sampled_case_trace(spark, sf):
    """Every base column and all eight cells of all fifteen turns; two JSON columns are held to a round trip in the tests."""
    return ds.trace_rows(_complete(spark, sf)).drop("rules_json", "conversation_template_json")


@query(
    "complete_case_matrix",
    f"""WITH {COMPLETE_SQL} SELECT grp || '_' || attack_order_variant AS case_id, md5(system_prompt) AS prompt_md5,
      array_to_string(list_transform(active, lambda x: {TEXT_SQL.format(x='x')}), '|') AS rule_texts, fc AS fillers, ac AS active,
      CASE WHEN inj THEN target_rule_id ELSE '' END AS attack_targets, seed AS sampling_seed, possible_count AS possible_combination_count,
      least(possible_count, 10) AS sampled_combination_count
    FROM full_""",
)
def complete_case_matrix(spark, sf):
    return _complete(spark, sf).select(
        "case_id", F.md5(F.encode("system_prompt", "utf-8")).alias("prompt_md5"),
        F.array_join(F.transform("rules", lambda r: r["text"]), "|").alias("rule_texts"),
        F.to_json("filler_category_composition").alias("fillers"), F.to_json("active_category_composition").alias("active"),
        F.array_join("attack_targets", "|").alias("attack_targets"), "sampling_seed", "possible_combination_count",
        F.col("sampled_combination_count").cast("long").alias("sampled_combination_count"),
    )


@query(
    "case_violations",
    f"""WITH {ORDERED_SQL}, c0 AS (SELECT grp || '_' || attack_order_variant AS case_id, turn_count, condition, rule_count, target_rule_id, attack_order FROM samp2),
    c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE turn_count = 1)
    SELECT case_id, unnest(['rule count differs from rule set', 'wrong filler count']) AS violation FROM c WHERE turn_count = 5
    UNION ALL SELECT case_id, 'wrong number of turns' FROM c WHERE turn_count = 10
    UNION ALL SELECT case_id, 'benign case with attacks' FROM c WHERE turn_count = 15 AND condition = 'injection_context'
    UNION ALL SELECT case_id, 'attack turns differ from order' FROM c WHERE turn_count = 10 AND condition = 'injection_context' AND rule_count = 7
    UNION ALL SELECT case_id, 'target is a filler' FROM c WHERE turn_count = 1 AND rule_count = 3
    UNION ALL SELECT case_id, 'target not in rule set' FROM c WHERE turn_count = 1 AND rule_count = 5
    UNION ALL SELECT case_id, 'duplicate case id' FROM c0 WHERE turn_count = 1""",
)
def case_violations(spark, sf):
    """Generated cases keep every rule of the design; here each kind of check is broken on some cases."""
    turns, rules, target = F.col("turn_count"), F.col("rule_count"), F.array("target_rule_id")
    cases = _full_sampled(spark, sf)
    broken = cases.withColumns(
        {
            "rule_count": rules + F.when(turns == 5, 1).otherwise(0),
            "condition": F.when(turns == 15, F.lit("benign_context")).otherwise(F.col("condition")),
            "turn_count": F.when(turns == 10, 11).otherwise(turns),
            "attack_order": F.when((turns == 10) & (rules == 7), F.reverse("attack_order")).otherwise(F.col("attack_order")),
            "filler_rule_ids": F.when((turns == 1) & (rules == 3), F.concat(F.slice("filler_rule_ids", 1, 1), target)).otherwise(
                F.col("filler_rule_ids")
            ),
            "rule_set_variant": F.when(
                (turns == 1) & (rules == 5), F.concat(F.array_except("rule_set_variant", target), F.array(F.lit("R99")))
            ).otherwise(F.col("rule_set_variant")),
        }
    )
    return ds.case_violations(broken.unionByName(broken.filter(F.col("turn_count") == 1)))


@query(
    "unknown_targets",
    "SELECT o_orderkey AS design_id, 'R0' || (o_orderkey % 9) AS target_rule_id FROM orders WHERE o_orderkey % 9 NOT BETWEEN 1 AND 7",
)
def unknown_targets(spark, sf):
    key = F.col("o_orderkey")
    rows = tb.table(spark, sf, "orders").select(
        key.alias("design_id"), F.concat(F.lit("R0"), (key % 9).cast("string")).alias("target_rule_id")
    )
    return ds.unknown_targets(rows, ds.rule_set_variants(spark, SEVEN)).select("design_id", "target_rule_id")


@query(
    "design_size_violations",
    f"WITH {ORDERED_SQL} SELECT design_id, count(*) AS cases FROM samp2 WHERE design_id % 4 > 0 OR turn_count < 15 GROUP BY 1 HAVING count(*) <> 264",
)
def design_size_violations(spark, sf):
    """Every fourth design has lost its longest cases."""
    expected = ds.expected_case_count(7, 10, "both")
    cases = _sampled_cases(spark, sf).filter((F.col("design_id") % 4 > 0) | (F.col("turn_count") < 15))
    return ds.size_violations(cases, expected)


@query(
    "attack_prompt_violations",
    """WITH p AS (SELECT 'R0' || (1 + item_id % 8) AS rule_id, 1 + item_id % 3 AS level,
        CASE WHEN item_id % 9 = 0 THEN 'multi' ELSE 'single_rule' END AS attack_scope,
        CASE WHEN item_id % 11 = 0 THEN ' ' ELSE text END AS prompt_text FROM benchmark),
    n AS (SELECT rule_id, level, count(*) AS c FROM p GROUP BY 1, 2)
    SELECT rule_id, CAST(level AS VARCHAR) AS level, 'unknown rule' AS violation FROM p WHERE rule_id = 'R08'
    UNION ALL SELECT rule_id, CAST(level AS VARCHAR), 'unexpected level' FROM p WHERE level = 3
    UNION ALL SELECT rule_id, CAST(level AS VARCHAR), 'scope is not single_rule' FROM p WHERE attack_scope <> 'single_rule'
    UNION ALL SELECT rule_id, CAST(level AS VARCHAR), 'empty prompt' FROM p WHERE trim(prompt_text) = ''
    UNION ALL SELECT rule_id, CAST(level AS VARCHAR), 'duplicate' FROM n WHERE c > 1
    UNION ALL SELECT 'R0' || r, CAST(l AS VARCHAR), 'missing' FROM (SELECT unnest(range(1, 8)) AS r), (SELECT unnest([1, 2]) AS l)
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE rule_id = 'R0' || r AND level = l)""",
)
def attack_prompt_violations(spark, sf):
    item = F.col("item_id")
    prompts = tb.table(spark, sf, "benchmark").select(
        F.concat(F.lit("R0"), (1 + item % 8).cast("string")).alias("rule_id"), (1 + item % 3).alias("level"),
        F.when(item % 9 == 0, F.lit("multi")).otherwise(F.lit("single_rule")).alias("attack_scope"),
        F.when(item % 11 == 0, F.lit(" ")).otherwise(F.col("text")).alias("prompt_text"),
    )
    return ds.prompt_violations(prompts, SEVEN, [1, 2])


SCENARIO_ROWS_SQL = """
sc AS (SELECT 's' || item_id AS scenario_id, CASE WHEN item_id % 10 = 0 THEN 'other' ELSE 'general' END AS system_prompt_profile,
    CASE WHEN item_id % 12 = 0 THEN 3 ELSE 1 END AS turn_count, CASE WHEN item_id % 13 = 0 THEN 'all' ELSE 'single_rule' END AS attack_scope,
    CASE WHEN item_id % 7 = 0 THEN 'R01, R08' ELSE 'R01,R02' END AS system_rule_set, 'Preamble here 다음 규칙을 반드시 준수하세요: x' AS system_prompt_text,
    CASE item_id % 3 WHEN 0 THEN 'implicit_attack' WHEN 1 THEN 'adversarial_attack' ELSE 'odd' END AS attack_type,
    CASE WHEN item_id % 17 = 0 THEN '' ELSE text END AS prompt_text, 'R0' || (item_id % 5) AS target_rule_id,
    'text ' || (item_id % 5) || CASE WHEN item_id = 9 THEN '!' ELSE '' END AS target_rule_text, 'format' AS target_rule_category FROM benchmark)
"""


def scenario_rows(spark, sf):
    item = F.col("item_id")
    return tb.table(spark, sf, "benchmark").select(
        F.concat(F.lit("s"), item.cast("string")).alias("scenario_id"),
        F.when(item % 10 == 0, F.lit("other")).otherwise(F.lit("general")).alias("system_prompt_profile"),
        F.when(item % 12 == 0, F.lit(3)).otherwise(F.lit(1)).alias("turn_count"),
        F.when(item % 13 == 0, F.lit("all")).otherwise(F.lit("single_rule")).alias("attack_scope"),
        F.when(item % 7 == 0, F.lit("R01, R08")).otherwise(F.lit("R01,R02")).alias("system_rule_set"),
        F.lit(f"Preamble here {fx.PROMPT_RULE_MARKER} x").alias("system_prompt_text"),
        F.when(item % 3 == 0, F.lit("implicit_attack")).when(item % 3 == 1, F.lit("adversarial_attack")).otherwise(F.lit("odd")).alias("attack_type"),
        F.when(item % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("prompt_text"),
        F.concat(F.lit("R0"), (item % 5).cast("string")).alias("target_rule_id"),
        F.concat(F.lit("text "), (item % 5).cast("string"), F.when(item == 9, F.lit("!")).otherwise(F.lit(""))).alias("target_rule_text"),
        F.lit("format").alias("target_rule_category"),
    )


@query(
    "scenario_profile_violations",
    f"""WITH {SCENARIO_ROWS_SQL}, g AS (SELECT target_rule_id AS r, min(target_rule_text) <> max(target_rule_text) AS t,
      count(*) FILTER (attack_type = 'implicit_attack') AS i, count(*) FILTER (attack_type = 'adversarial_attack') AS a FROM sc GROUP BY 1)
    SELECT scenario_id AS subject, 'wrong profile' AS violation FROM sc WHERE system_prompt_profile <> 'general'
    UNION ALL SELECT scenario_id, 'not single-turn' FROM sc WHERE turn_count <> 1
    UNION ALL SELECT scenario_id, 'scope is not single_rule' FROM sc WHERE attack_scope <> 'single_rule'
    UNION ALL SELECT scenario_id, 'banned rule' FROM sc WHERE contains(system_rule_set, 'R08')
    UNION ALL SELECT scenario_id, 'unexpected attack type' FROM sc WHERE attack_type = 'odd'
    UNION ALL SELECT scenario_id, 'empty prompt' FROM sc WHERE prompt_text = ''
    UNION ALL SELECT 'system_rule_set', 'inconsistent rule set' WHERE (SELECT count(DISTINCT system_rule_set) FROM sc) > 1
    UNION ALL SELECT r, 'inconsistent rule text' FROM g WHERE t
    UNION ALL SELECT r, 'missing implicit_attack' FROM g WHERE i = 0 UNION ALL SELECT r, 'missing adversarial_attack' FROM g WHERE a = 0
    UNION ALL SELECT r, 'duplicate implicit_attack' FROM g WHERE i > 1 UNION ALL SELECT r, 'duplicate adversarial_attack' FROM g WHERE a > 1""",
)
def scenario_profile_violations(spark, sf):
    return ds.profile_violations(scenario_rows(spark, sf), "general")


MODELS = ["lab/model-a", "lab/model-b:free"]


@query(
    "request_plan",
    f"""WITH {SCENARIO_ROWS_SQL}, m(model, slug) AS (VALUES ('lab/model-a', 'lab__model-a'), ('lab/model-b:free', 'lab__model-b_free'))
    SELECT scenario_id || '__' || slug AS request_id, model, sha256(prompt_text) AS prompt_sha256, sha256(system_prompt_text) AS system_prompt_sha256,
      CAST(CASE WHEN target_rule_id = 'R03' THEN 4096 ELSE 1024 END AS INTEGER) AS max_tokens, 'Preamble here' AS preamble FROM sc, m""",
)
def request_plan(spark, sf):
    plan = ds.request_plan(scenario_rows(spark, sf), MODELS, 1024, {"R03": 4096})
    return plan.select(
        "request_id", "model", "prompt_sha256", "system_prompt_sha256", "max_tokens",
        tx.prompt_preamble("system_prompt_text").alias("preamble"),
    )


@query(
    "numbered_system_prompts",
    f"""WITH {VARIANTS_SQL} SELECT design_id, rule_count, possible_ordinal, md5('Head:' || chr(10) || array_to_string(
      list_transform(active, lambda x, i: i || '. Rule ' || x), chr(10)) || chr(10) || 'End.') AS prompt_md5 FROM sets""",
)
def numbered_system_prompts(spark, sf):
    rows = ds.design_rule_sets(designs(spark, sf), ds.rule_set_variants(spark, SEVEN))
    rules = F.transform("active_rule_ids", lambda r: F.struct(F.concat(F.lit("Rule "), r).alias("text")))
    return rows.select(
        "design_id", "rule_count", F.col("possible_ordinal").cast("long").alias("possible_ordinal"),
        F.md5(prep.numbered_prompt(rules, "Head:\n", "\nEnd.")).alias("prompt_md5"),
    )


# --- context cases ---------------------------------------------------------------------------------

PROBE_SQL = """
probes0 AS (SELECT item_id, [1, 3, 5][CAST(1 + item_id % 3 AS INTEGER)] AS rule_count_level, CASE WHEN item_id % 2 = 0 THEN 'basic' ELSE 'redteam' END AS intensity,
    CAST(1 + (item_id // 6) % 3 AS INTEGER) AS target_rule, text AS question, 'Rules ' || (item_id % 3) || ' apply.' AS system_prompt FROM benchmark),
probes AS (SELECT * FROM probes0 QUALIFY row_number() OVER (PARTITION BY rule_count_level, intensity, target_rule ORDER BY item_id) = 1)
"""


def probe_rows(spark, sf):
    item = F.col("item_id")
    rows = tb.table(spark, sf, "benchmark").select(
        item, F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), (item % 3).cast("int") + 1).alias("rule_count_level"),
        F.when(item % 2 == 0, F.lit("basic")).otherwise(F.lit("redteam")).alias("intensity"),
        (1 + F.floor(item / 6) % 3).cast("int").alias("target_rule"), F.col("text").alias("question"),
        F.concat(F.lit("Rules "), (item % 3).cast("string"), F.lit(" apply.")).alias("system_prompt"),
    )
    return ds.first_probe(rows, [F.col("item_id")])


NL = "chr(10)"
TAIL_SQL = "'" + fx.HISTORY_TAIL.replace("\n", f"' || {NL} || '") + "'"
HEAD_SQL = "'" + fx.HISTORY_HEAD.replace("\n", f"' || {NL} || '") + "'"
CONTEXT_SQL = f"""{POOL_SQL}, {PROBE_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY token_length_bin ORDER BY conv_id, turn) AS n FROM binned WHERE token_length_bin IS NOT NULL
  QUALIFY n <= 4),
pools AS (SELECT token_length_bin AS token_length, list(content ORDER BY n) AS items FROM ranked GROUP BY 1),
plan AS (SELECT p.*, t AS turn_count, l AS token_length, s AS strategy FROM probes p, (SELECT unnest([5, 10]) AS t),
    (SELECT unnest(['short', 'medium', 'long']) AS l), (SELECT unnest(['once', 'reinforced']) AS s)
  UNION ALL SELECT *, 0, 'none', 'once' FROM probes),
drawn AS (SELECT plan.*, coalesce(list_transform(range(0, turn_count), lambda i: items[CAST(i % len(items) + 1 AS INTEGER)]), []) AS hist
  FROM plan LEFT JOIN pools USING (token_length)),
lines AS (SELECT *, flatten(list_transform(hist, lambda x, i: CASE WHEN strategy = 'reinforced' AND i % 2 = 0
    THEN ['User: ' || x, '{fx.REINFORCEMENT_TAG}'] ELSE ['User: ' || x] END)) AS ls FROM drawn),
ctx AS (SELECT *, CASE WHEN turn_count = 0 THEN question ELSE {HEAD_SQL} || array_to_string(ls, chr(10)) || {TAIL_SQL} || question END AS rendered FROM lines),
ctx2 AS (SELECT *, 'exp_L' || rule_count_level || '_' || intensity || '_R' || target_rule || '_T' || turn_count || '_' || token_length || '_' || strategy AS case_id,
    {count_sql('system_prompt', TOKENS)} AS system_prompt_tokens, {count_sql('rendered', TOKENS)} AS user_message_tokens FROM ctx)
"""


def _context_cases(spark, sf):
    binned = prep.bin_turns(_pool(spark, sf).filter("keep"), BINS, 4, [F.col("conv_id"), F.col("turn")])
    pools = ds.turn_pools(binned, [5, 10])
    return ds.context_cases(probe_rows(spark, sf), pools, [0, 5, 10], list(BINS), ["once", "reinforced"])


@query(
    "context_case_matrix",
    f"""WITH {CONTEXT_SQL} SELECT case_id, turn_count, CASE WHEN turn_count = 0 THEN 'baseline' ELSE 'normal' END AS difficulty,
      md5(rendered) AS rendered_md5, system_prompt_tokens, user_message_tokens, system_prompt_tokens + user_message_tokens AS total_context_tokens FROM ctx2""",
)
def context_case_matrix(spark, sf):
    return _context_cases(spark, sf).select(
        "case_id", "turn_count", "difficulty", F.md5("rendered_user_message").alias("rendered_md5"),
        "system_prompt_tokens", "user_message_tokens", "total_context_tokens",
    )


@query(
    "context_token_summary",
    f"""WITH {CONTEXT_SQL}, c AS (SELECT CASE WHEN turn_count = 0 THEN 'baseline' ELSE 'normal' END AS difficulty, turn_count, rule_count_level,
      nullif(system_prompt_tokens + user_message_tokens, 0) AS t FROM ctx2)
    SELECT difficulty, turn_count, rule_count_level, count(*) AS cases, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 6) AS mean_tokens
    FROM c GROUP BY GROUPING SETS ((difficulty), (turn_count), (rule_count_level), ())""",
)
def context_token_summary(spark, sf):
    return rounded(ds.token_summary(_context_cases(spark, sf)))


CONV_SQL = """
msgs AS (SELECT 'c' || conv_id AS conversation_id, conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''),
convs AS (SELECT conversation_id, conv_id, count(*) FILTER (role = 'user') AS turn_count, count(*) AS total_messages FROM msgs GROUP BY 1, 2)
"""


def _messages(spark, sf):
    rows = prep.clean_turns(tb.table(spark, sf, "conversations"))
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"), "conv_id", "turn", "role",
        F.col("text").alias("content"),
    )


def _conversation_rows(spark, sf):
    return prep.conversation_table(_messages(spark, sf), "conversation_id", ["conv_id"], 0)


@query(
    "embedded_conversation_cases",
    f"""WITH {CONV_SQL}, {PROBE_SQL}, b AS (SELECT *, CASE WHEN turn_count BETWEEN 2 AND 3 THEN '2-3' WHEN turn_count BETWEEN 4 AND 5 THEN '4-5' END AS turn_bin FROM convs),
    s AS (SELECT * FROM b WHERE turn_bin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turn_bin ORDER BY sha256('42::' || conversation_id), conversation_id) <= 5),
    d AS (SELECT conversation_id, turn_bin, any_value(s.turn_count) AS turn_count, string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY turn) AS dia
      FROM s JOIN msgs USING (conversation_id) GROUP BY 1, 2)
    SELECT conversation_id, turn_bin, turn_count, p.rule_count_level AS rule_count_level, p.intensity AS intensity, target_rule,
      md5({HEAD_SQL} || dia || {TAIL_SQL} || question) AS rendered_md5 FROM d, probes p WHERE p.rule_count_level IN (1, 5)""",
)
def embedded_conversation_cases(spark, sf):
    sampled = ds.sampled_conversations(_conversation_rows(spark, sf), [(2, 3), (4, 5)], 5, 42)
    cases = ds.embedded_conversation_cases(
        sampled, _messages(spark, sf), probe_rows(spark, sf), [1, 5], ["basic", "redteam"]
    )
    return cases.select(
        "conversation_id", "turn_bin", "turn_count", "rule_count_level", "intensity", "target_rule",
        F.md5("rendered_user_message").alias("rendered_md5"),
    )


LEVEL_PROMPTS = {1: "Only one rule.", 5: "Five rules: a, b, c, d, e."}


@query(
    "task_case_matrix",
    f"""WITH {CONV_SQL}, q AS (SELECT *, CASE WHEN conv_id % 4 <> 0 THEN 'What is ' || conv_id || '?' ELSE '' END AS tq FROM convs),
    t AS (SELECT conversation_id, sum({count_sql("role || ': ' || content", TOKENS)})::BIGINT AS turns_tokens FROM msgs GROUP BY 1),
    lv(rule_count_level, p) AS (VALUES (0, ''), (1, 'Only one rule.'), (5, 'Five rules: a, b, c, d, e.'))
    SELECT conversation_id, rule_count_level, CASE WHEN conv_id % 3 = 0 THEN 'criteria ' || conv_id ELSE 'YES' END AS pass_criteria,
      turns_tokens, {count_sql('p', TOKENS)} + turns_tokens + {count_sql('tq', TOKENS)} AS total_context_tokens
    FROM q JOIN t USING (conversation_id), lv WHERE tq <> ''""",
)
def task_case_matrix(spark, sf):
    conv = F.col("conv_id")
    rows = _conversation_rows(spark, sf).withColumns(
        {
            "target_question": F.when(conv % 4 != 0, F.concat(F.lit("What is "), conv.cast("string"), F.lit("?"))).otherwise(F.lit("")),
            "source_id": conv,
        }
    )
    criteria = tb.table(spark, sf, "conversations").filter((conv % 3 == 0) & (F.col("turn") == 0)).select(
        conv.alias("source_id"), F.concat(F.lit("criteria "), conv.cast("string")).alias("pass_criteria")
    )
    cases = ds.task_cases(rows, _messages(spark, sf), criteria, LEVEL_PROMPTS)
    return cases.select("conversation_id", "rule_count_level", "pass_criteria", "turns_tokens", "total_context_tokens")


# --- context transforms ------------------------------------------------------------------------------

TURNS_SQL = """
t AS (SELECT conv_id AS case_id, turn, role, text AS content, 'Rule one.' || chr(10) || chr(10) || '  Be number ' || conv_id || '.' AS system_prompt
  FROM conversations WHERE role IN ('user', 'assistant'))
"""


def context_turns(spark, sf):
    conv = F.col("conv_id")
    rows = tb.table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.select(
        conv.alias("case_id"), "turn", "role", F.col("text").alias("content"),
        F.concat(F.lit("Rule one.\n\n  Be number "), conv.cast("string"), F.lit(".")).alias("system_prompt"),
    )


@query(
    "eligible_cases",
    f"WITH {TURNS_SQL} SELECT case_id, count(*) AS turn_count FROM t GROUP BY 1 HAVING count(*) >= 4",
)
def eligible_cases(spark, sf):
    cases = context_turns(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("turn_count"))
    return cx.eligible(cases, 4)


@query(
    "last_turn_window",
    f"""WITH {TURNS_SQL} SELECT case_id || '_sliding_window_3' AS case_id, turn, role, md5(content) AS content_md5 FROM t
    QUALIFY row_number() OVER (PARTITION BY t.case_id ORDER BY turn DESC) <= 3""",
)
def last_turn_window(spark, sf):
    out = cx.apply_variant(context_turns(spark, sf), "sliding_window", window_size=3)
    return out.select("case_id", "turn", "role", F.md5("content").alias("content_md5"))


PRUNE_SQL = rf"""
pw AS (SELECT case_id, turn, content, list_filter(regexp_split_to_array(content, '[{fx.SPACE}]+'), lambda x: x <> '') AS ws FROM t),
ps AS (SELECT *, len(ws) AS n, greatest(1, CAST(floor(len(ws) * 0.5) AS INTEGER)) AS keep,
    list_sort(list_transform(ws, lambda w, i: {{'s': len(regexp_extract_all(w, '{TOKENS}')) +
      length(regexp_replace(w, '^[.,!?;:"''()\[\]{{}}]+|[.,!?;:"''()\[\]{{}}]+\z', '', 'g')) / 10::DOUBLE, 'i': i}})) AS sorted FROM pw),
pruned AS (SELECT case_id, turn, content, CASE WHEN n <= 2 THEN content ELSE array_to_string(list_transform(list_sort(list_transform(
    sorted[n - keep + 1:], lambda b: b.i)), lambda j: ws[CAST(j AS INTEGER)]), ' ') END AS new_content FROM ps)
"""


@query(
    "pruned_turns",
    f"WITH {TURNS_SQL}, {PRUNE_SQL} SELECT case_id, turn, md5(new_content) AS content_md5, length(new_content) AS chars FROM pruned",
)
def pruned_turns(spark, sf):
    out = cx.prune_turns(context_turns(spark, sf), 0.5)
    return out.select("case_id", "turn", F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("chars"))


REMIND_SQL = """
u AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY case_id ORDER BY turn) AS users FROM t),
r AS (SELECT case_id, turn, 0 AS slot, role, content FROM t UNION ALL
  SELECT case_id, turn, 1, 'assistant', '[REMINDER] I must follow these rules:' || chr(10) || '- Rule one.' || chr(10) || '- Be number ' || case_id || '.'
  FROM u WHERE role = 'user' AND users % 2 = 0)
"""


@query(
    "reinforced_turns",
    f"WITH {TURNS_SQL}, {REMIND_SQL} SELECT case_id, turn, slot, role, md5(content) AS content_md5 FROM r",
)
def reinforced_turns(spark, sf):
    out = cx.reinforce(context_turns(spark, sf), 2)
    return out.select("case_id", "turn", "slot", "role", F.md5("content").alias("content_md5"))


SUMMARY_SQL = f"""
sm AS (SELECT case_id, turn, role, CASE WHEN {count_sql('content', TOKENS)} <= 50 OR turn % 3 = 0 THEN content ELSE 'in short: ' || content END AS content FROM t)
"""


def _summaries(spark, sf):
    turns = context_turns(spark, sf).filter(F.col("turn") % 3 != 0)
    return turns.select("case_id", "turn", F.concat(F.lit("in short: "), "content").alias("summary"))


@query("summarized_turns", f"WITH {TURNS_SQL}, {SUMMARY_SQL} SELECT case_id, turn, role, md5(content) AS content_md5 FROM sm")
def summarized_turns(spark, sf):
    out = cx.apply_summaries(context_turns(spark, sf), _summaries(spark, sf), 50)
    return out.select("case_id", "turn", "role", F.md5("content").alias("content_md5"))


@query(
    "joined_token_totals",
    f"""WITH {TURNS_SQL}, j AS (SELECT case_id, string_agg(content, '' ORDER BY turn) AS a, string_agg(content, ' - ' ORDER BY turn) AS b FROM t GROUP BY 1)
    SELECT case_id, {count_sql('a', TOKENS)}::BIGINT AS unbroken, {count_sql('b', TOKENS)}::BIGINT AS dashed FROM j""",
)
def joined_token_totals(spark, sf):
    """Tokens of whole conversations run together and joined by dashes; tokens cross the turns' ends."""
    turns = context_turns(spark, sf)
    unbroken = cx.joined_token_count(turns, ["case_id"], ["turn"], separator="", name="unbroken")
    return unbroken.join(cx.joined_token_count(turns, ["case_id"], ["turn"], separator=" - ", name="dashed"), "case_id")


@query(
    "transform_size_changes",
    f"""WITH {TURNS_SQL}, {PRUNE_SQL}, {REMIND_SQL}, {SUMMARY_SQL},
    b AS (SELECT case_id, {count_sql('content', TOKENS)}::BIGINT AS o FROM (SELECT case_id, string_agg(content, ' ' ORDER BY turn) AS content FROM t GROUP BY 1)),
    a AS (SELECT case_id, 'sliding_window_3' AS variant, content FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY turn DESC) <= 3)
      UNION ALL SELECT case_id, 'selective_context_050', new_content FROM pruned
      UNION ALL SELECT case_id, 'reinforce_2', content FROM r UNION ALL SELECT case_id, 'summarize_turns', content FROM sm),
    g AS (SELECT case_id, variant, {count_sql('content', TOKENS)}::BIGINT AS c FROM (SELECT case_id, variant, string_agg(content, ' ') AS content FROM a GROUP BY 1, 2))
    SELECT case_id AS original_case_id, variant, o AS original_token_count, c AS compressed_token_count, round(c / o, 4) AS compression_ratio
    FROM g JOIN b USING (case_id)""",
)
def transform_size_changes(spark, sf):
    turns = context_turns(spark, sf)
    changed = cx.apply_variants(
        turns,
        [
            ("sliding_window", {"window_size": 3}), ("selective_context", {"target_ratio": 0.5}),
            ("system_prompt_reinforce", {"injection_interval": 2}), ("summarize_turns", {"summaries": _summaries(spark, sf)}),
        ],
    )
    return cx.size_change(turns, changed)


# --- transform report ------------------------------------------------------------------------------------

SCORED_SQL = """
scored AS (SELECT ['none', 'sliding_window_3', 'sliding_window_5', 'selective_context_050', 'summarize_turns'][CAST(1 + o_custkey % 5 AS INTEGER)] AS variant,
    CAST(2 * (o_orderkey % 4) AS INTEGER) AS turn_count, CAST([1, 5, 10][CAST(1 + o_orderkey % 3 AS INTEGER)] AS INTEGER) AS rule_count,
    ['none', 'short', 'medium', 'long'][CAST(1 + o_custkey % 4 AS INTEGER)] AS token_length,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS compliant,
    CASE WHEN o_custkey % 5 > 0 THEN (1 + o_orderkey % 10) / 10.0 END::DOUBLE AS compression_ratio FROM orders),
vt AS (SELECT variant, turn_count, count(compliant) AS n, coalesce(sum(compliant), 0)::BIGINT AS compliant, round(sum(compliant) / count(compliant), 4) AS compliance_rate
  FROM scored GROUP BY 1, 2)
"""


def scored_responses(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def nth(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)

    return tb.table(spark, sf, "orders").select(
        nth(["none", "sliding_window_3", "sliding_window_5", "selective_context_050", "summarize_turns"], cust % 5).alias("variant"),
        (2 * (key % 4)).cast("int").alias("turn_count"), nth([1, 5, 10], key % 3).alias("rule_count"),
        nth(["none", "short", "medium", "long"], cust % 4).alias("token_length"),
        F.when(key % 17 == 0, F.lit(None).cast("int")).when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("compliant"),
        F.when(cust % 5 > 0, (1 + key % 10) / F.lit(10.0)).alias("compression_ratio"),
    )


def _report_set(name: str, keys: list[str]) -> str:
    every = ["variant", "turn_count", "rule_count", "token_length"]
    return (
        "SELECT " + ", ".join(k if k in keys else f"NULL AS {k}" for k in every)
        + f", '{name}' AS \"grouping\", count(compliant) AS n, count(*) FILTER (compliant IS NULL) AS unscored, "
        + "coalesce(sum(compliant), 0)::BIGINT AS compliant, round(sum(compliant) / count(compliant), 4) AS compliance_rate FROM scored GROUP BY "
        + ", ".join(keys)
    )


@query(
    "transform_report",
    f"WITH {SCORED_SQL} "
    + " UNION ALL ".join(
        [
            _report_set("variant_turns", ["variant", "turn_count"]), _report_set("rules_turns", ["turn_count", "rule_count"]),
            _report_set("rules_tokens", ["rule_count", "token_length"]),
        ]
    ),
)
def transform_report(spark, sf):
    return tr.transform_report(scored_responses(spark, sf))


@query(
    "defense_effect",
    f"""WITH {SCORED_SQL}, j AS (SELECT v.variant, v.turn_count, v.compliance_rate AS c, coalesce(b.compliance_rate, 0.0) AS b
      FROM vt v LEFT JOIN vt b ON b.variant = 'none' AND b.turn_count = v.turn_count WHERE v.variant <> 'none')
    SELECT variant, turn_count, c AS compliance_rate, b AS baseline_rate,
      round(CASE WHEN b < 1 THEN (c - b) / (1 - b) ELSE 0 END, 4) AS defense_effectiveness,
      round(CASE WHEN b > 0 THEN c / b ELSE 0 END, 4) AS compliance_preservation FROM j""",
)
def defense_effect(spark, sf):
    return tr.defense_effect(tr.variant_turn_rates(scored_responses(spark, sf)))


@query(
    "mean_compression_ratios",
    f"WITH {SCORED_SQL} SELECT variant, round(avg(compression_ratio), 4) AS avg_compression_ratio, count(*) AS n FROM scored WHERE compression_ratio IS NOT NULL GROUP BY 1",
)
def mean_compression_ratios(spark, sf):
    return tr.mean_ratios(scored_responses(spark, sf))


@query(
    "ratio_against_compliance",
    f"""WITH {SCORED_SQL}, r AS (SELECT variant, round(avg(compression_ratio), 4) AS avg_compression_ratio FROM scored WHERE compression_ratio IS NOT NULL GROUP BY 1)
    SELECT variant, round(avg(compliance_rate), 6) AS mean_compliance_rate, any_value(avg_compression_ratio) AS avg_compression_ratio,
      CASE WHEN starts_with(variant, 'sliding') THEN 'sliding_window' WHEN starts_with(variant, 'selective') THEN 'selective_context' ELSE variant END AS method
    FROM vt JOIN r USING (variant) WHERE variant <> 'none' GROUP BY 1""",
)
def ratio_against_compliance(spark, sf):
    rows = scored_responses(spark, sf)
    return rounded(tr.method_rollup(tr.variant_turn_rates(rows), tr.mean_ratios(rows)))


@query(
    "rule_count_overall_rate",
    f"""WITH {SCORED_SQL}, g AS (SELECT rule_count, turn_count, count(compliant) AS n, round(avg(compliant), 4) AS r FROM scored GROUP BY 1, 2)
    SELECT rule_count, sum(n)::BIGINT AS n, round(sum(r * n) / sum(n), 6) AS overall_rate FROM g GROUP BY 1""",
)
def rule_count_overall_rate(spark, sf):
    return rounded(tr.rule_count_overall(scored_responses(spark, sf)))


