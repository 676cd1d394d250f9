"""Study period, monthly sampling dates, and mapping of expressions to a dictionary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The study period, both days included.
STUDY_PERIOD = (dt.date(2023, 7, 1), dt.date(2026, 6, 30))


def in_period(day: Column, period: tuple[dt.date, dt.date] = STUDY_PERIOD) -> Column:
    """'inside', 'outside', or 'missing' for a day that isn't known."""
    return F.when(day.isNull(), "missing").when(day.between(F.lit(period[0]), F.lit(period[1])), "inside").otherwise("outside")


def monthly_dates(spark: SparkSession, period: tuple[dt.date, dt.date] = STUDY_PERIOD, seed: int = 7) -> DataFrame:
    """(month, day): one day of every month of a period, by a hash of the month and the seed.

    Partial months give one of their days inside the period. The same seed always gives
    the same days, so every corpus is sampled on the same ones.
    """
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(period[0]), "month"), F.lit(period[1]), F.expr("interval 1 month"))).alias("month"))
    first, last = F.greatest("month", F.lit(period[0])), F.least(F.last_day("month"), F.lit(period[1]))
    pick = F.pmod(F.xxhash64(F.col("month").cast("string"), F.lit(seed)), F.datediff(last, first) + 1).cast("int")
    return months.select("month", F.date_add(first, pick).alias("day"))


def sample_days(df: DataFrame, day: str, dates: DataFrame) -> DataFrame:
    """The rows of the sampled days."""
    return df.join(F.broadcast(dates.select(F.col("day").alias("__day"))), F.col(day) == F.col("__day"), "left_semi")  # one row a month


def map_concepts(expressions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """expressions (…, expression) with concept and status.

    ``dictionary`` is (expression, concept). Expressions are compared without case and
    outer white space. Exactly one concept is 'existing_dictionary'; several different
    ones are 'ambiguous' and get none; no entry is 'new_candidate'.
    """
    norm = lambda c: F.lower(F.trim(c))
    entries = dictionary.where("concept is not null").groupBy(norm(F.col("expression")).alias("__e")).agg(F.min("concept").alias("__a"), F.max("concept").alias("__b"))
    told = expressions.withColumn("__e", norm(F.col("expression"))).join(entries, "__e", "left")
    status = F.when(F.col("__a").isNull(), "new_candidate").when(F.col("__a") == F.col("__b"), "existing_dictionary").otherwise("ambiguous")
    return told.withColumn("concept", F.when(F.col("__a") == F.col("__b"), F.col("__a"))).withColumn("status", status).drop("__e", "__a", "__b")
