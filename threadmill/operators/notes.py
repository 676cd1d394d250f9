"""The note store: reading cards and details, deduplication, search, statistics, ledgers."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Mapping, Sequence
from contextlib import closing
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.functions.text import contains_any, filled

_path = lambda raw, p: F.get_json_object(raw, f"$.{p}")


def first_of(raw: Column, *paths: str) -> Column:
    """The first path that is there and not null; '' counts as there."""
    return F.coalesce(*[_path(raw, p) for p in paths])


def first_filled(raw: Column, *paths: str, default: str = "") -> Column:
    """The first path whose value isn't empty."""
    return F.coalesce(*[filled(_path(raw, p)) for p in paths], F.lit(default))


def count_of(raw: Column, *paths: str) -> Column:
    """The first path's value as a whole number; 0 where it isn't one, later paths don't help."""
    v = first_of(raw, *paths)
    return F.coalesce(F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("bigint")), F.lit(0).cast("bigint"))


_INFO = {"liked_count": ["likedCount", "liked"], "collected_count": ["collectedCount", "collected"], "comment_count": ["commentCount", "commenCount"], "share_count": ["sharedCount", "shareCount"]}


def card_fields(raw: Column) -> list[Column]:
    """A feed card's ten columns; all come from its noteCard if it has one, else from the card itself."""
    inner = F.nullif(_path(raw, "noteCard"), F.lit("{}"))
    card = F.coalesce(F.when(inner.startswith("{"), inner), raw)
    return [
        F.coalesce(filled(_path(raw, "id")), first_filled(card, "noteId")).alias("note_id"),
        F.coalesce(filled(_path(raw, "xsecToken")), first_filled(card, "xsecToken")).alias("xsec_token"),
        first_filled(card, "displayTitle", "title").alias("title"),
        first_filled(card, "type", default="normal").alias("type"),
        F.coalesce(first_of(card, "user.nickname", "user.nickName"), F.lit("")).alias("author_name"),
        first_filled(card, "user.userId").alias("author_id"),
        *[count_of(card, *[f"interactInfo.{p}" for p in ps]).alias(c) for c, ps in _INFO.items()],
    ]


def _names(raw: Column, path: str, key: str) -> Column:
    """The non-empty values of one key in an array of objects."""
    items = F.from_json(F.coalesce(_path(raw, path), F.lit("[]")), f"array<struct<{key}:string>>")
    return F.filter(F.transform(items, lambda x: x[key]), lambda x: F.coalesce(x, F.lit("")) != "")


def detail_arrays(raw: Column) -> list[Column]:
    """A note's thirteen columns from its detail object, lists as arrays; note_id is null where it has none.

    A count that isn't a whole number is 0.
    """
    ms = _path(raw, "time").try_cast("bigint")
    video = F.coalesce(*[F.get(_names(raw, f"video.media.stream.{c}", "masterUrl"), F.lit(0)) for c in ("h265", "h264")], F.lit(""))
    return [
        filled(_path(raw, "noteId")).alias("note_id"),
        F.coalesce(_path(raw, "title"), F.lit("")).alias("title"),
        F.coalesce(_path(raw, "desc"), F.lit("")).alias("content"),
        F.coalesce(first_of(raw, "user.nickname", "user.nickName"), F.lit("")).alias("author_name"),
        F.coalesce(_path(raw, "user.userId"), F.lit("")).alias("author_id"),
        *[count_of(raw, *[f"interactInfo.{p}" for p in ps]).alias(c) for c, ps in _INFO.items()],
        F.coalesce(F.date_format(F.timestamp_millis(F.nullif(ms, F.lit(0))), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("publish_time"),
        _names(raw, "imageList", "urlDefault").alias("images"),
        video.alias("video_url"),
        _names(raw, "tagList", "name").alias("hashtags"),
    ]


def detail_fields(raw: Column) -> list[Column]:
    """detail_arrays with lists joined by '; '."""
    names = ["note_id", "title", "content", "author_name", "author_id", *_INFO, "publish_time", "images", "video_url", "hashtags"]
    return [F.array_join(c, "; ").alias(n) if n in ("images", "hashtags") else c for n, c in zip(names, detail_arrays(raw))]


def note_of_state(state: Column) -> Column:
    """The note of a page state: the current (or first) id's entry, else the first that has one.

    An id whose entry is null gives null; it doesn't fall through to another.
    """
    notes = F.from_json(_path(state, "note.noteDetailMap"), "map<string,string>")
    wanted = F.coalesce(filled(_path(state, "note.currentNoteId")), filled(_path(state, "note.firstNoteId")))
    has = F.coalesce(F.map_contains_key(notes, F.coalesce(wanted, F.lit(""))), F.lit(False)) & wanted.isNotNull()
    any_note = F.get(F.filter(F.transform(F.map_values(notes), lambda e: F.get_json_object(e, "$.note")), lambda n: n.isNotNull()), F.lit(0))
    return F.when(has, F.get_json_object(F.try_element_at(notes, wanted), "$.note")).otherwise(any_note)


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of smallest ``order`` of each key; rows with a null key all stay.

    The winner is aggregated map-side as one struct, so a key that a third of the rows
    share costs no more than any other.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r")).select(key, "__r.*")
    return kept.select(df.columns).union(df.where(F.col(key).isNull()))


def merge_stores(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing plus the first of each new key; rows already there win."""
    fresh = first_wins(new, key, order)
    return existing.unionByName(fresh.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"))


def scan_store(spark: SparkSession, path: str, table: str = "notes", tasks: int = 8) -> DataFrame:
    """The notes of another store: a parquet folder, or a SQLite file that all executors can read.

    A SQLite table is read in ``tasks`` ranges of its row numbers. Columns it lacks are null.
    """
    columns = [f.name for f in schema.NOTE.fields]
    if not path.endswith((".db", ".sqlite")):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.NOTE.fields])
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        there = {r[1] for r in db.execute(f'pragma table_info("{table}")')}
        least, most = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
    wanted = ", ".join(f'"{c}"' if c in there else "null" for c in columns)
    step = max(1, -(-(most - least + 1) // tasks))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["first"]:
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    rows = db.execute(f'select {wanted} from "{table}" where rowid >= ? and rowid < ? order by rowid', (int(first), int(first) + step))
                    while part := rows.fetchmany(10_000):
                        yield pd.DataFrame(part, columns=columns, dtype=object)

    return spark.range(least, most + 1, step, tasks).select(F.col("id").alias("first")).mapInPandas(read, schema.NOTE)


def pool_ids(df: DataFrame, key: str = "note_id") -> DataFrame:
    """The distinct ids a store holds."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def merge_counts(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row (n_read, n_inserted, n_skipped) of merging new rows into a store, first wins.

    Rows without key can't be known again and are all inserted.
    """
    keyed = new.where(F.col(key).isNotNull()).select(key)
    fresh = keyed.distinct().join(existing.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("__fresh"))
    read = new.agg(F.count("*").alias("n_read"), F.count_if(F.col(key).isNull()).alias("__null"))
    both = read.join(F.broadcast(fresh), how="cross").withColumn("n_inserted", F.col("__fresh") + F.col("__null"))
    return both.select("n_read", "n_inserted", (F.col("n_read") - F.col("n_inserted")).alias("n_skipped"))


def export(df: DataFrame, keyword: str | None = None) -> DataFrame:
    """What an export holds: all notes, or those whose keyword contains a text, whatever the case."""
    return df.where(F.lower("keyword").contains(keyword.lower())) if keyword else df


def listing() -> list[Column]:
    """The columns of a printed result list, cut to their widths; missing counts are '0'."""
    cut_ = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return [cut_(F.col(c), n).alias(a) for c, n, a in (("note_id", 16, "note_id"), ("title", 28, "title"), ("author_name", 12, "author"))] + [
        F.coalesce(F.col("liked_count"), F.lit(0)).cast("string").alias("likes"), F.coalesce(F.col("collected_count"), F.lit(0)).cast("string").alias("collects"), cut_(F.col("publish_time"), 10).alias("time"),
    ]


def title_relevant(title: Column, keyword: Column, variants: Mapping[str, Sequence[str]], terms: Sequence[str]) -> Column:
    """Whether a title holds its keyword or one of its variants, whatever the case, or a general term."""
    low = F.lower(title)
    own = F.coalesce(F.contains(low, F.lower(keyword)), F.lit(False))
    by_variant = [(keyword == k) & contains_any(low, [v.lower() for v in vs]) for k, vs in variants.items() if vs]
    found = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), [*by_variant, contains_any(title, terms)], own)
    return F.coalesce((title != "") & found, F.lit(False))


def most_engaged(df: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, engagement): of each group the row of most likes and collects, the first of equal ones."""
    total = F.coalesce("liked_count", F.lit(0)) + F.coalesce("collected_count", F.lit(0))
    best = df.groupBy(by).agg(F.max(F.struct(total.alias("t"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(by, (-F.col("b.o")).alias(order), F.col("b.t").alias("engagement"))


def search(df: DataFrame, keyword: str | None = None, author: str | None = None, min_likes: int = 0, min_collects: int = 0) -> DataFrame:
    """Notes whose title or content holds the keyword, whose author's name holds the author's,
    and that reach the thresholds; a threshold of 0 or less is none."""
    if keyword:
        df = df.where(F.lower("title").contains(keyword.lower()) | F.lower("content").contains(keyword.lower()))
    if author:
        df = df.where(F.lower("author_name").contains(author.lower()))
    for c, least in (("liked_count", min_likes), ("collected_count", min_collects)):
        if least > 0:
            df = df.where(F.col(c) >= least)
    return df.select("id", "note_id", "title", "author_name", "liked_count", "collected_count", "comment_count", "publish_time")


def top(df: DataFrame, limit: int = 200) -> DataFrame:
    """The most liked, ties by id."""
    return df.orderBy(F.desc_nulls_last("liked_count"), "id").limit(limit)


def stats(df: DataFrame) -> DataFrame:
    """One row: totals and averages of a store."""
    return df.agg(
        F.count("*").alias("total"), F.avg("liked_count").alias("avg_likes"), F.avg("collected_count").alias("avg_collects"), F.sum("liked_count").alias("total_likes"),
        F.count_if((F.col("images") != "[]") & (F.col("images") != "")).alias("with_images"), F.count_if(F.col("video_url") != "").alias("with_video"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"),
    )


def top_authors(df: DataFrame, limit: int = 10) -> DataFrame:
    """The authors of most notes with their mean likes, ties by name."""
    return df.groupBy("author_name").agg(F.count("*").alias("n"), F.avg("liked_count").alias("avg_likes")).orderBy(F.desc("n"), F.asc_nulls_first("author_name")).limit(limit)


def repeated_titles(df: DataFrame, limit: int = 20) -> DataFrame:
    """(title, n, note_id): the titles of most notes, one row for each note that has it.

    The top titles are found from counts alone. All their ids come out, as rows: a title
    that a third of all notes share would be too much for one list.
    """
    counts = df.where(F.col("title") != "").groupBy("title").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "title").limit(limit)
    return df.select("title", "note_id").join(F.broadcast(counts), "title").select("title", "n", "note_id")


def stale_runs(batches: DataFrame, order: str, new: str, limit: int) -> DataFrame:
    """(run, first, last, n): stretches of at least ``limit`` successive batches without new rows.

    ``batches`` is one row per batch, already aggregated.
    """
    marked = batches.selectExpr(order, new, f"sum(case when {new} > 0 then 1 else 0 end) over (order by {order}) as run").where(F.col(new) == 0)
    return marked.groupBy("run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= limit)
