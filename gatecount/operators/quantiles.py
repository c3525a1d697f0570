"""Exact grouped quantiles without collecting a group.

``percentile`` keeps every distinct value of a group in one buffer. Here values
are counted per (group, bin) and per (group, value); the bin that holds the
wanted rank is found on the small bin table, and only the values of that bin are
ranked. The result is the linear interpolation between the two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    bin_width: float = 0.001,
) -> DataFrame:
    """Rows (groups, probability, n, quantile). ``value`` is a double without nulls or NaN."""
    groups = list(groups)
    counts = df.groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_bin", F.floor(F.col("_v") / F.lit(bin_width)))

    # One row per (group, bin): the window over bins never sees single values.
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    bins = counts.groupBy(*groups, "_bin").agg(F.sum("_n").alias("_in_bin"))
    bins = bins.select(
        *groups,
        "_bin",
        "_in_bin",
        F.coalesce(F.sum("_in_bin").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_bin").over(whole).alias("n"),
    )

    # Wanted 0-based ranks: the two neighbours of p * (n - 1).
    wanted = bins.select(
        "*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    ).withColumn("_at", F.col("probability") * (F.col("n") - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    first, last = F.col("_before"), F.col("_before") + F.col("_in_bin") - 1
    hit = wanted.where(((low >= first) & (low <= last)) | ((high >= first) & (high <= last)))

    in_bin = Window.partitionBy(*groups, "probability", "_bin").orderBy("_v")
    ranked = hit.join(counts, [*groups, "_bin"]).withColumn(
        "_end", F.col("_before") + F.sum("_n").over(in_bin)
    )
    holds_low = (low >= F.col("_end") - F.col("_n")) & (low < F.col("_end"))
    holds_high = (high >= F.col("_end") - F.col("_n")) & (high < F.col("_end"))
    fraction = F.col("_at") - F.floor("_at")
    return (
        ranked.groupBy(*groups, "probability", "n", "_at")
        .agg(
            F.max(F.when(holds_low, F.col("_v"))).alias("_low"),
            F.max(F.when(holds_high, F.col("_v"))).alias("_high"),
        )
        .select(
            *groups,
            "probability",
            "n",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * fraction).alias("quantile"),
        )
    )
