"""Chart specifications: normalised data and the rules for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A palette for readers with colour-vision deficiency.
PALETTE = ("#0072B2", "#D55E00", "#009E73", "#CC79A7", "#E69F00", "#56B4E9", "#000000")


def tick_rotation(categories: Column) -> Column:
    """15 for more than 8 categories or a label of more than 14 characters, else 0."""
    longest = F.array_max(F.transform(categories, F.length))
    return F.when((F.size(categories) > 8) | (F.coalesce(longest, F.lit(0)) > 14), 15).otherwise(0)


def labels_bars(series: Column, categories: Column) -> Column:
    return F.size(series) * F.size(categories) <= 12


def chart_series(charts: DataFrame) -> DataFrame:
    """chart_id, k, name, color, values, error: one row per series of (chart_id, categories, series).

    series: array of struct<name, values, color>. Unnamed series are numbered, uncoloured ones take the
    palette in turn. error says how a series' length differs; a chart without categories or series has one row that says so.
    """
    rows = charts.select("chart_id", "categories", F.posexplode_outer("series").alias("k", "s"))
    k = F.coalesce(F.col("k"), F.lit(0))
    color = F.coalesce(F.nullif(F.col("s.color"), F.lit("")), F.element_at(F.array(*(F.lit(c) for c in PALETTE)), (k % len(PALETTE) + 1).cast("int")))
    name = F.coalesce(F.col("s.name"), F.concat(F.lit("series"), (k + 1).cast("string")))
    n, want = F.coalesce(F.size("s.values"), F.lit(0)), F.size("categories")
    error = F.when(F.col("categories").isNull() | F.col("s").isNull(), "no categories or series").when(n != want, F.format_string("%d values for %d categories", n, want))
    return rows.select("chart_id", F.col("k").cast("long").alias("k"), name.alias("name"), color.alias("color"), F.col("s.values").alias("values"), error.alias("error"))
