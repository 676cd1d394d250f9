"""Evidence-preserving cleaning and date recovery for collected text."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.joins import lookup
from threadmill.functions.text import SPACE, filled, strip


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """HTML entities decoded, then Unicode NFKC: neither has a SQL built-in."""
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", html.unescape(s)))


def clean_text(title: Column, body: Column) -> Column:
    """Title and body after nine steps: entities, NFKC, newlines, zero width, URLs, blanks,
    line ends, runs of empty lines, title before body."""

    def one(c: Column) -> Column:
        c = decoded(c)
        for pattern, into in (
            (r"\r\n?", "\n"),
            (r"[\x{200b}-\x{200d}\x{2060}\x{feff}]", ""),
            (r"(?:https?://|www\.)[^\s\x{4e00}-\x{9fff}]+", "[URL]"),
            (r"[ \t\x{a0}\x{3000}]+", " "),
            (r" *\n *", "\n"),
            (r"\n{3,}", "\n\n"),
        ):
            c = F.regexp_replace(c, pattern, into)
        return filled(strip(c))

    return F.concat_ws("\n", one(title), one(body))


def recover_date(text: Column, at: Column) -> Column:
    """A date as written, relative to the collection date ``at``: struct(day, precision).

    Reads full dates, month and day (of the year before where that lies after ``at``),
    n days / hours / minutes ago, yesterday and today; null elsewhere. ``at`` is a date or
    a timestamp; hours and minutes are counted back from its time of day.
    """
    moment, at = at.cast("timestamp"), at.cast("date")
    full = F.regexp_extract_all(text, F.lit(r"(\d{4})[-/.年]\d{1,2}[-/.月]\d{1,2}"), F.lit(0))
    part = lambda s, k: F.regexp_extract(s, r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})", k).try_cast("int")
    whole = F.get(full, F.lit(0))
    md = r"(?<![\d年/.-])(\d{1,2})[-/月](\d{1,2})(?!\d)"
    month, day = F.regexp_extract(text, md, 1).try_cast("int"), F.regexp_extract(text, md, 2).try_cast("int")
    this = F.try_make_timestamp(F.year(at), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    last = F.try_make_timestamp(F.year(at) - 1, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    ago = F.regexp_extract(text, r"(\d{1,3})\s*(?:天前|日前|일 ?전|days? ago)", 1).try_cast("int")
    back = lambda unit, names: F.regexp_extract(text, rf"(\d{{1,4}})\s*(?:{names})", 1).try_cast("int") * F.lit(unit)
    seconds = F.coalesce(back(3600, "小时前|時間前|시간 ?전|hours? ago"), back(60, "分钟前|分前|분 ?전|minutes? ago"))
    row = lambda d, p: F.struct(d.alias("day"), F.lit(p).alias("precision"))
    made = F.try_make_timestamp(part(whole, 1), part(whole, 2), part(whole, 3), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return (
        F.when(whole.isNotNull() & made.isNotNull(), row(made, "day"))
        .when(ago.isNotNull(), row(F.date_sub(at, F.coalesce(ago, F.lit(0))), "day"))
        .when(text.rlike("昨天|昨日|어제|yesterday"), row(F.date_sub(at, 1), "day"))
        .when(seconds.isNotNull(), row(F.timestamp_seconds(F.unix_seconds(moment) - F.coalesce(seconds, F.lit(0))).cast("date"), "day"))
        .when(text.rlike("今天|今日|오늘|today|刚刚"), row(at, "day"))
        .when(this.isNotNull(), row(F.when(this <= at, this).otherwise(last), "year_inferred"))
    )


def exact_representatives(df: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """(text_hash, representative, n): equal texts after white space is collapsed.

    The representative is the first by ``order`` (nulls last), then key: one struct is
    aggregated map-side, so hot texts cost no more than others.
    """
    collapsed = strip(F.regexp_replace(F.col(text), f"[{SPACE}]+", " "))
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))], F.col(key))
    rows = df.select(key, F.sha2(filled(collapsed), 256).alias("text_hash"), rank.alias("__o")).where("text_hash is not null")
    return rows.groupBy("text_hash").agg(F.min_by(key, "__o").alias("representative"), F.count("*").alias("n"))


def deduplicate(df: DataFrame, key: str, platform: list[str], text: str, order: list[str]) -> DataFrame:
    """(key, representative, reason, group): every row with the row that stands for it.

    Rows of one platform id (all ``platform`` columns not null) come first: the first by
    ``order`` (nulls last), then key, is kept and reason 'platform_id' given to the others.
    Among what is kept, equal texts after white space is collapsed are treated alike, with
    reason 'exact_text'. Kept rows represent themselves; group is the hash of the text, null
    for texts that are empty.
    """
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))], F.col(key))
    known = F.concat_ws("\1", *platform)
    has = F.lit(True)
    for c in platform:
        has = has & F.col(c).isNotNull() & (F.col(c) != "")
    collapsed = strip(F.regexp_replace(F.col(text), f"[{SPACE}]+", " "))
    rows = df.select(key, F.when(has, known).alias("pid"), F.sha2(filled(collapsed), 256).alias("group"), rank.alias("__o"))
    first = rows.where("pid is not null").groupBy("pid").agg(F.min_by(key, "__o").alias("__first"))
    named = lookup(rows, first, "pid", [key]).withColumn("__first", F.coalesce("__first", key))
    kept = named.where(F.col(key) == F.col("__first")).where(F.col("group").isNotNull()).groupBy("group").agg(F.min_by(key, "__o").alias("__same"))
    both = lookup(named, kept, "group", [key])
    again = F.col(key) != F.col("__first")
    by_text = ~again & F.col("__same").isNotNull() & (F.col("__same") != F.col(key))
    representative = F.when(again, F.col("__first")).when(by_text, F.col("__same")).otherwise(F.col(key))
    return both.select(key, representative.alias("representative"), F.when(again, "platform_id").when(by_text, "exact_text").otherwise("").alias("reason"), "group")
