"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may well take; a hot key has more, and more than a
#: thousandth of all rows, so that at most a thousand keys are hot.
PER_SALT = 100_000
MOST_HOT = 1_000
_TRACKED = 10 * MOST_HOT


def salts_of(n: int) -> int:
    """Over how many tasks ``n`` rows of one key are spread."""
    return max(2, math.ceil(n / PER_SALT))


def hot_keys(df: DataFrame, *columns: str) -> dict[object, int]:
    """value -> salts of the hot keys of each column, from a frequent-items sketch over all rows.

    One pass without shuffling rows; the sketch's size is bounded and its counts are never
    too low for a hot key. It only decides how rows are spread, never which rows join.
    """
    got = df.agg(F.count("*").alias("n"), *[F.expr(f"approx_top_k({c}, {MOST_HOT}, {_TRACKED})").alias(f"t{i}") for i, c in enumerate(columns)]).first()
    least = max(PER_SALT, got["n"] // MOST_HOT)
    return {x["item"]: salts_of(x["count"]) for i in range(len(columns)) for x in got[f"t{i}"] or [] if x["item"] is not None and x["count"] > least}


def hot_groups(counts: DataFrame, key: str, n: str) -> dict[object, int]:
    """value -> salts of the hot keys, where the number of rows of each key is known."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    found = counts.where((F.col(n) > max(PER_SALT, total // MOST_HOT)) & F.col(key).isNotNull()).select(key, n).collect()  # at most MOST_HOT rows
    return {k: salts_of(c) for k, c in found}


def lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "left", hot: dict[object, int] | None = None, merge: bool = False) -> DataFrame:
    """``left`` joined with ``right``, where right has few rows for each ``key``.

    Rows of a hot key on the left are spread, by a hash of ``spread``, over as many tasks
    as their number asks for; the rows on the right are repeated for each. ``hot`` says
    which keys are hot, if that is known; else ``left`` is read once more to find them.
    Rows with a null key meet nothing; a left join keeps them, spread like the others.
    ``merge`` keeps either side from being broadcast: for sides that Python makes, whose
    size Spark guesses from the input's and may take for a hundredth of what it is.
    Other column names must not clash.
    """
    hot = hot_keys(left, key) if hot is None else hot
    right = right.where(F.col(key).isNotNull())
    salted = ["__salt"] if hot or how == "left" else []
    if hot:
        kind = left.schema[key].dataType.simpleString()
        table = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), f"{key} {kind}, __salts int"))  # at most a few MOST_HOT rows
        left = left.join(table, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
        right = right.join(table, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    elif salted:
        left, right = left.withColumn("__salt", F.lit(0)), right.withColumn("__salt", F.lit(0))
    if how == "left":  # a null key would send all its rows to one task
        left = left.withColumn("__salt", F.when(F.col(key).isNull(), F.xxhash64(*spread).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).otherwise(F.col("__salt")))
    return left.join(right.hint("merge") if merge else right, [key, *salted], how).drop("__salt")
