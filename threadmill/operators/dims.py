"""Outputs that judge one text along several dimensions: reading, comparing and tracing them.

An output is a JSON object with one object for each dimension: {"pain": {"label": "1",
"confidence": 3.5, "reasoning": "..."}}. Whatever is missing or of another kind reads as
its default, so reading never fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(output: Column, dim: Column, key: str) -> Column:
    own = F.try_element_at(F.from_json(output, "map<string,string>"), dim)
    return F.try_element_at(F.from_json(own, "map<string,string>"), F.lit(key))


def dim_label(output: Column, dim: Column) -> Column:
    """1 for "1", "true" and "yes" in any case, else 0."""
    return F.coalesce(F.lower(_value(output, dim, "label")).isin("1", "true", "yes"), F.lit(False)).cast("int")


def dim_confidence(output: Column, dim: Column) -> Column:
    """The confidence as a number, 0 where it isn't one."""
    return F.coalesce(F.trim(_value(output, dim, "confidence")).try_cast("double"), F.lit(0.0))


def dim_reasoning(output: Column, dim: Column) -> Column:
    return F.coalesce(_value(output, dim, "reasoning"), F.lit(""))


def by_dimension(df: DataFrame, key: str, output: str, dims: Sequence[str]) -> DataFrame:
    """(key, dim, label, confidence, reasoning): an output in long form, one row per dimension."""
    each = df.select(key, output, F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim"))
    o, d = F.col(output), F.col("dim")
    return each.select(key, "dim", dim_label(o, d).alias("label"), dim_confidence(o, d).alias("confidence"), dim_reasoning(o, d).alias("reasoning"))


def changed_dimensions(df: DataFrame, key: str, before: str, after: str, dims: Sequence[str]) -> DataFrame:
    """(key, dim, from, to): dimensions whose label differs between two outputs of a row.

    Both outputs stand in one row, so nothing is joined; a dimension that one of them
    lacks reads as 0 and may count as changed.
    """
    each = df.select(key, before, after, F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim"))
    both = each.select(key, "dim", dim_label(F.col(before), F.col("dim")).alias("from"), dim_label(F.col(after), F.col("dim")).alias("to"))
    return both.where(F.col("from") != F.col("to"))


def dim_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """rows (key, dim) with the verdict (key, dim, verdict) each has; without one it is approved."""
    one = verdicts.groupBy(key, "dim").agg(F.max("verdict").alias("verdict"))
    return rows.join(one, [key, "dim"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("approved")))


def trace_meta(trace: DataFrame, key: str) -> DataFrame:
    """(key, final_source, approved): maps from dimension to where its label came from, and to
    whether the first review approved it, as text; '' where that isn't known."""
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")))))
    return trace.groupBy(key).agg(of("final_source").alias("final_source"), of("approved").alias("approved"))
