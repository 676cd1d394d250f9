"""Queries on packed fields and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.packed import unpack_fields
from threadmill.operators.timestamps import ZONES, check_zones, instant_micros, normalise_timestamps, read_notation, site_host, zone_fit
from threadmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of notes.hashtags and notes.images: (id, field, pos, value)."""
    return unpack_fields(table(spark, sf_dir, "notes"), "id", ["hashtags", "images"], tags=["hashtags"])


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per field and error flag ('' for well-formed)."""
    values = unpack_fields(table(spark, sf_dir, "notes"), "id", ["hashtags", "images"], tags=["hashtags"], flags=True)
    return values.groupBy("field", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n_values"), F.max("pos").cast("bigint").alias("longest_list"))


#: A JSON array of strings and nothing else.
_JSON = r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'


def p1_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every list that is well-formed JSON: (id, field, pos, value)."""
    notes = table(spark, sf_dir, "notes").select("id", *[F.when(F.col(c).rlike(_JSON), F.col(c)).alias(c) for c in ("hashtags", "images")])
    return unpack_fields(notes, "id", ["hashtags", "images"], tags=["hashtags"])


def p1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field are web addresses: (field, n)."""
    values = unpack_fields(table(spark, sf_dir, "notes"), "id", ["hashtags", "images"], tags=["hashtags"])
    fields = spark.createDataFrame([("hashtags",), ("images",)], "field string")
    counts = values.where(F.col("value").rlike("^https?://")).groupBy("field").agg(F.count("*").alias("n"))
    return fields.join(counts, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("n"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each readable publish_time and created_at as an instant: (id, field, utc_micros)."""
    return normalise_timestamps(table(spark, sf_dir, "notes"), "id", "publish_time", "created_at", "source_url", table(spark, sf_dir, "source_sites").select("site", "zone"))


def p7_zone_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well every declared zone explains the zoneless publish times of every site."""
    notes = table(spark, sf_dir, "notes").select(read_notation("publish_time").alias("l"), read_notation("created_at").alias("u"), site_host(F.col("source_url")).alias("s"))
    zones = table(spark, sf_dir, "source_sites").select("zone").where(F.col("zone").isin(sorted(ZONES))).distinct()
    fit = zone_fit(notes.where((F.col("l.zone") == "") & (F.col("s") != "")), F.col("s"), F.col("l.wall"), instant_micros(F.col("u"), F.lit("Z")), zones)
    return fit.select("site", "zone", "n_rows", "n_violations", F.round("lag_s", 3).alias("lag_s"))


def p7_zone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the estimate, with a site's declared zone hidden, gives other instants: (any_sites, n_wrong).

    Judged are sites of a hundred rows or more; fewer can be outweighed by a few odd rows.
    """
    checked = check_zones(table(spark, sf_dir, "notes"), "publish_time", "created_at", "source_url", table(spark, sf_dir, "source_sites").select("site", "zone"))
    return checked.where("n_rows >= 100").agg((F.count("*") > 0).alias("any_sites"), F.count_if(F.col("n_same") < 0.99 * F.col("n_rows")).alias("n_wrong"))


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p1_json_values": p1_json_values, "p1_urls": p1_urls, "p7_found": p7_found, "p7_zone_fit": p7_zone_fit, "p7_zone_check": p7_zone_check}
_EDGE = r"[\s\x{a0}\x{3000}\x{200b}\x{feff}]+"
_TRIM = lambda c: f"regexp_replace({c}, '^{_EDGE}|{_EDGE}$', '', 'g')"
ORACLE_SQL: dict[str, str] = {
    "p1_json_values": f"""with f as (select id, 'hashtags' as field, hashtags as s from notes union all select id, 'images', images from notes), j as (select id, field, from_json(s::json, '["VARCHAR"]') as l from f where regexp_matches(s, '{_JSON}')),
        v as (select id, field, unnest(l) as v, generate_subscripts(l, 1) as k from j), t as (select id, field, k, case when field = 'hashtags' then {_TRIM("ltrim(" + _TRIM("v") + ", '#＃')")} else {_TRIM("v")} end as value from v)
        select id, field, row_number() over (partition by id, field order by k) as pos, value from t where value <> ''""",
    "p1_urls": "select 'hashtags' as field, coalesce(sum(len(regexp_extract_all(hashtags, 'https?://'))), 0)::bigint as n from notes union all select 'images', coalesce(sum(len(regexp_extract_all(images, 'https?://'))), 0)::bigint from notes",
    "p7_zone_check": "select true as any_sites, 0 as n_wrong",
}
