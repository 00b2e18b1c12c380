"""Turn metrics kept as counts, and put right by differences after an audit.

The four metrics of a turn follow from six counts, which add up.  A changed cell is one
row that takes its old score away and adds its new one, so after an audit only the touched
turns get new counts; the cells themselves are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["scored", "passed", "target_scored", "target_passed", "other_scored", "other_failed"]


def _parts(passed: Column) -> dict[str, Column]:
    """What one cell with this score adds to each count."""
    ok, bad = F.coalesce(passed, F.lit(False)), F.coalesce(~passed, F.lit(False))
    target, other = F.col("is_target"), F.col("any_target") & ~F.col("is_target")
    hits = [passed.isNotNull(), ok, target & passed.isNotNull(), target & ok, other & passed.isNotNull(), other & bad]
    return {name: hit.cast("long") for name, hit in zip(COUNTS, hits, strict=True)}


def metric_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored table: six counts per turn, one map-side combined aggregate."""
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _parts(F.col("pass")).items()])


def change_counts(changes: DataFrame, keys: Sequence[str], before: str = "pass_before", after: str = "pass") -> DataFrame:
    """Signed counts per touched turn from changed cells, with how many cells changed."""
    old, new = _parts(F.col(before)), _parts(F.col(after))
    return changes.groupBy(*keys).agg(
        *[F.sum(new[n] - old[n]).alias(n) for n in COUNTS], F.count(F.lit(1)).alias("changed_cells")
    )


def merged_counts(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored counts with the changes added; ``changed_cells`` is 0 on untouched turns.

    The changes are as few as the touched turns, so Spark may broadcast them when they are
    small; null keys meet null keys.
    """
    renamed = changes.select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(n).alias(f"_{n}") for n in [*COUNTS, "changed_cells"]]
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = stored.join(renamed, same, "left")
    return joined.select(
        *keys, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in COUNTS],
        F.coalesce("_changed_cells", F.lit(0)).alias("changed_cells"),
    )


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """The four metrics in place of the counts."""
    metrics = {
        "per_rule_pass_rate": F.coalesce(F.try_divide("passed", "scored"), F.lit(1.0)),
        "perfect_success": (F.col("passed") == F.col("scored")).cast("double"),
        "targeted_rule_success": F.when(
            F.col("target_scored") > 0, (F.col("target_passed") == F.col("target_scored")).cast("double")
        ),
        "non_target_failure": F.when(F.col("other_scored") > 0, (F.col("other_failed") > 0).cast("double")),
    }
    return counts.withColumns(metrics).drop(*COUNTS)
