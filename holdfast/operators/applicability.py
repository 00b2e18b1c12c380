"""Tables that keep not-applicable cells visible next to passes and failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.common import rate


def applicability_table(
    counts: DataFrame, keys: Sequence[str], roll_over: str | None = None
) -> DataFrame:
    """active / scorable / na / passed / failed and the three rates built on them.

    With ``roll_over`` the same pass also returns the table without that key;
    ``level`` tells the two apart (``detail`` and ``overall``).
    """
    sums = [F.sum(c).alias(c) for c in ("passed", "failed", "na")]
    if roll_over is None:
        table = counts.groupBy(*keys).agg(*sums)
    else:
        coarse = [k for k in keys if k != roll_over]
        table = (
            counts.groupingSets([list(keys), coarse], *keys)
            .agg(*sums, F.grouping(roll_over).alias("_rolled"))
            .withColumn(
                "level", F.when(F.col("_rolled") == 1, F.lit("overall")).otherwise(F.lit("detail"))
            )
            .drop("_rolled")
        )
    return (
        table.withColumn("scorable", F.col("passed") + F.col("failed"))
        .withColumn("active", F.col("scorable") + F.col("na"))
        .withColumns(
            {
                "applicability_rate": rate("scorable", "active"),
                "conditional_failure_rate": rate("failed", "scorable"),
                "opportunity_failure_rate": rate("failed", "active"),
            }
        )
    )
