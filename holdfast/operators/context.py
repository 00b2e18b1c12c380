"""Conversation-context transforms on a turns table, and their registry.

A turns table has ``case_id``, an integer ``turn`` (unique per case), ``role`` and
``content``.  Conversations stay exploded: a very long one is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import fixed_values as fx
from holdfast.functions import text as tx
from holdfast.operators.common import first_n_per_key, running_count

Transform = Callable[..., DataFrame]
_TRANSFORMS: dict[str, Transform] = {}


def register_transform(name: str, transform: Transform) -> None:
    """Add a transform ``(turns, **params) -> turns`` under a name."""
    _TRANSFORMS[name] = transform


def transform_named(name: str) -> Transform:
    return _TRANSFORMS[name]


def eligible(cases: DataFrame, min_turns: int) -> DataFrame:
    return cases.filter(F.col("turn_count") >= min_turns)


def keep_last(turns: DataFrame, window_size: int) -> DataFrame:
    """The last N turns of every case."""
    return first_n_per_key(turns, ["case_id"], [F.col("turn").desc()], window_size).drop("_rank")


def keep_last_nested(turns: Column | str, window_size: int) -> Column:
    """The same on an array already held in a row."""
    turns = tx.col(turns)
    start = F.greatest(F.size(turns) - window_size + 1, F.lit(1))
    return F.slice(turns, start, F.lit(window_size))


def prune_words(text: Column | str, target_ratio: float, counter: tx.TokenCounter = tx.token_count) -> Column:
    """Drop the least informative words of a text down to the target share.

    A word's score is its token count plus a tenth of its bare length; the lowest
    scores go first, earlier words first among equals; order is kept; one or two
    words stay as they are.
    """
    text = tx.col(text)
    split = tx.words(text)
    chars = "".join(f"\\{c}" for c in fx.PRUNE_TRIM_CHARS)
    bare = rf"^[{chars}]+|[{chars}]+\z"
    scored = F.transform(
        split,
        lambda w, i: F.struct(
            (counter(w) + F.length(F.regexp_replace(w, bare, "")) / F.lit(10.0)).alias("s"), i.alias("i"),
            w.alias("w"),
        ),
    )
    n = F.size(split)
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(target_ratio)).cast("int"))
    best = F.slice(F.array_sort(scored), n - keep + 1, keep)
    ordered = F.array_sort(F.transform(best, lambda b: F.struct(b["i"].alias("i"), b["w"].alias("w"))))
    return F.when(n <= 2, text).otherwise(
        F.array_join(F.transform(ordered, lambda b: b["w"]), " ")
    )


def prune_turns(turns: DataFrame, target_ratio: float, counter: tx.TokenCounter = tx.token_count) -> DataFrame:
    return turns.withColumn("content", prune_words("content", target_ratio, counter))


def reminder_text(prompt: Column | str, max_words: int = 100) -> Column:
    """Reminder built from the prompt's non-blank lines, cut to ``max_words`` words."""
    lines = F.filter(
        F.transform(F.split(tx.strip(tx.col(prompt)), "\n"), lambda x: tx.strip(x)), lambda x: x != ""
    )
    full = F.array_join(
        F.concat(F.array(F.lit(fx.REMINDER_HEAD)), F.transform(lines, lambda x: F.concat(F.lit("- "), x))),
        "\n",
    )
    split = tx.words(full)
    return F.when(F.size(split) > max_words, F.array_join(F.slice(split, 1, max_words), " ")).otherwise(full)


def reinforce(
    turns: DataFrame, injection_interval: int, prompts: DataFrame | None = None, max_reminder_tokens: int = 100
) -> DataFrame:
    """An assistant reminder after every K-th user turn.

    The reminder sits at the same ``turn`` with ``slot`` 1, so (turn, slot) is the new
    order.  ``prompts`` (case_id, system_prompt) may be left out if turns carry it.
    """
    rows = turns if prompts is None else turns.join(prompts, "case_id", "left")
    counted = running_count(rows, ["case_id"], "turn", F.col("role") == "user", "_users")
    remind = (F.col("role") == "user") & (F.col("_users") % injection_interval == 0)
    own = F.struct(F.lit(0).alias("slot"), F.col("role").alias("role"), F.col("content").alias("content"))
    extra = F.struct(
        F.lit(1).alias("slot"), F.lit("assistant").alias("role"),
        reminder_text("system_prompt", max_reminder_tokens).alias("content"),
    )
    keep = [c for c in turns.columns if c not in ("role", "content", "system_prompt")]
    return counted.select(
        *keep, F.explode(F.when(remind, F.array(own, extra)).otherwise(F.array(own))).alias("_t")
    ).select(*keep, "_t.*")


def apply_summaries(
    turns: DataFrame, summaries: DataFrame, max_summary_tokens: int = 50,
    counter: tx.TokenCounter = tx.token_count,
) -> DataFrame:
    """Stored summaries replace long turns; short turns and turns without one stay."""
    joined = turns.join(summaries.select("case_id", "turn", "summary"), ["case_id", "turn"], "left")
    short = counter(F.col("content")) <= max_summary_tokens
    return joined.withColumn(
        "content", F.when(short, F.col("content")).otherwise(F.coalesce("summary", "content"))
    ).drop("summary")


register_transform("sliding_window", keep_last)
register_transform("selective_context", prune_turns)
register_transform("system_prompt_reinforce", reinforce)
register_transform("summarize_turns", apply_summaries)


def variant_name(method: str, params: Mapping[str, object]) -> str:
    if method == "sliding_window":
        return f"sliding_window_{params['window_size']}"
    if method == "selective_context":
        return f"selective_context_{int(float(params['target_ratio']) * 100):03d}"
    if method == "system_prompt_reinforce":
        return f"reinforce_{params['injection_interval']}"
    return method


def apply_variant(turns: DataFrame, method: str, **params: object) -> DataFrame:
    """Transformed turns under rewritten case ids with the variant's name."""
    name = variant_name(method, params)
    out = transform_named(method)(turns, **params)
    if "slot" not in out.columns:
        out = out.withColumn("slot", F.lit(0))
    return out.withColumns(
        {
            "original_case_id": F.col("case_id"),
            "variant": F.lit(name),
            "method": F.lit(method),
            "case_id": F.concat(F.col("case_id").cast("string"), F.lit(f"_{name}")),
        }
    )


def apply_variants(
    turns: DataFrame, variants: Sequence[tuple[str, Mapping[str, object]]]
) -> DataFrame:
    """All configured variants; each is an independent branch of the plan."""
    out = None
    for method, params in variants:
        part = apply_variant(turns, method, **params)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def joined_token_count(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "content", separator: str = " ",
    counter: tx.TokenCounter = tx.token_count, edge: int = 1, block: int = 4096, name: str = "tokens",
) -> DataFrame:
    """Tokens of every key's parts joined in order, without joining them.

    The count of a joined text is the sum over its parts plus what changes where two parts
    meet: a token may go over the seam, or the separator makes tokens.  A part is summed
    up as (head, tokens, tail) with ``edge`` characters at either end, which must be
    enough to decide a seam (one is, for counters of character runs).  Summaries merge in
    order: the parts inside a block of the first order column, then the blocks.  Empty
    parts only add their separators.  Null texts are no parts.

    ``order`` columns are unique per key and the first is a whole number; a task holds
    short summaries of one block at most.
    """
    parts = parts.filter(F.col(text).isNotNull())
    body = F.col(text)
    rows = parts.select(
        *keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(2**62))).alias("_block"), counter(body).cast("long").alias("_tokens"),
        F.nullif(F.left(body, F.lit(edge)), F.lit("")).alias("_head"), F.nullif(F.right(body, F.lit(edge)), F.lit("")).alias("_tail"),
    )

    def seam(before: Column, gaps: Column, after: Column) -> Column:
        """How the count changes when two texts meet over some separators; either may be missing."""
        left, right = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
        between = F.repeat(F.lit(separator), gaps.cast("int"))
        return (counter(F.concat(left, between, right)) - counter(left) - counter(right)).cast("long")

    def merged(rows: DataFrame, group: Sequence[str], by: Sequence[str]) -> DataFrame:
        """One summary per group from rows with _tokens, _head, _tail, and _lead / _trail / _n parts around them."""
        line = Window.partitionBy(*group).orderBy(*by)
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        full = F.col("_head").isNotNull()
        first = F.sum("_n").over(earlier)
        placed = rows.withColumn("_from", F.coalesce(first, F.lit(0)))
        placed = placed.withColumns(
            {
                "_at": F.col("_from") + F.col("_lead"), "_end": F.col("_from") + F.col("_n") - F.col("_trail"),
            }
        ).withColumns(
            {
                "_before": F.last(F.when(full, F.col("_tail")), True).over(earlier),
                "_before_end": F.last(F.when(full, F.col("_end")), True).over(earlier),
            }
        )
        met = F.when(
            full & F.col("_before").isNotNull(), seam(F.col("_before"), F.col("_at") - F.col("_before_end") + 1, F.col("_head"))
        ).otherwise(F.lit(0))
        return placed.withColumn("_tokens", F.col("_tokens") + met).groupBy(*group).agg(
            F.sum("_tokens").alias("_tokens"), F.sum("_n").alias("_n"),
            F.min_by("_head", F.when(full, F.col("_at"))).alias("_head"), F.max_by("_tail", F.when(full, F.col("_end"))).alias("_tail"),
            F.coalesce(F.min(F.when(full, F.col("_at"))), F.sum("_n")).alias("_lead"),
            F.coalesce(F.sum("_n") - F.max(F.when(full, F.col("_end"))), F.lit(0)).alias("_trail"),
        )

    empty = F.col("_head").isNull().cast("long")
    single = rows.withColumns({"_n": F.lit(1).cast("long"), "_lead": empty, "_trail": F.lit(0).cast("long")})
    blocks = merged(single, [*keys, "_block"], [f"_o{i}" for i in range(len(order))])
    whole = merged(blocks, keys, ["_block"])
    outer = F.when(
        F.col("_head").isNull(), counter(F.repeat(F.lit(separator), (F.col("_n") - 1).cast("int")))
    ).otherwise(
        seam(F.lit(None).cast("string"), F.col("_lead"), F.col("_head")) + seam(F.col("_tail"), F.col("_trail"), F.lit(None).cast("string"))
    )
    return whole.select(*keys, (F.col("_tokens") + outer).cast("long").alias(name))


def size_change(
    original: DataFrame, transformed: DataFrame, counter: tx.TokenCounter = tx.token_count, separator: str = " ",
) -> DataFrame:
    """Token counts before and after per transformed case, with the rounded ratio.

    Counts are those of the turns joined with ``separator``.  No tokens before means 0, 0
    and 1.0.
    """
    before = joined_token_count(
        original, ["case_id"], ["turn"], separator=separator, counter=counter, name="original_token_count"
    ).withColumnRenamed("case_id", "original_case_id")
    after = joined_token_count(
        transformed, ["original_case_id", "variant"], ["turn", "slot"], separator=separator, counter=counter,
        name="compressed_token_count",
    )
    joined = after.join(before, "original_case_id", "left")
    total = F.coalesce(F.col("original_token_count"), F.lit(0))
    return joined.withColumns(
        {
            "original_token_count": total,
            "compressed_token_count": F.when(total > 0, F.col("compressed_token_count")).otherwise(F.lit(0)),
            "compression_ratio": F.when(
                total > 0, F.round(F.col("compressed_token_count") / total, 4)
            ).otherwise(F.lit(1.0)),
        }
    )


# --- rendering ---------------------------------------------------------------------------


def embed_history(lines: Column, probe: Column | str) -> Column:
    """History lines and the probe as one message; without history just the probe."""
    return F.when(F.size(lines) <= 0, tx.col(probe)).otherwise(
        F.concat(
            F.lit(fx.HISTORY_HEAD), F.array_join(lines, "\n"), F.lit(fx.HISTORY_TAIL), tx.col(probe)
        )
    )


def user_history(turns: Column | str, strategy: Column | str) -> Column:
    """``User: ...`` lines; ``reinforced`` adds the tag after every second turn."""
    tag = F.lit(fx.REINFORCEMENT_TAG)
    every = fx.REINFORCE_EVERY
    return F.flatten(
        F.transform(
            tx.col(turns),
            lambda t, i: F.when(
                (tx.col(strategy) == "reinforced") & ((i + 1) % every == 0),
                F.array(F.concat(F.lit("User: "), t), tag),
            ).otherwise(F.array(F.concat(F.lit("User: "), t))),
        )
    )


def dialogue_history(turns: Column | str) -> Column:
    """``User: ...`` / ``Assistant: ...`` lines of an array of role / content."""
    return F.transform(
        tx.col(turns), lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"])
    )
