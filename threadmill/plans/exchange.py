"""Queries that write files and read them again, each with its DuckDB oracle.

Files go to a folder of their own below the checkpoint folder, which all executors share;
what is read is written to a checkpoint, and the folder is removed.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.operators import notes as store, units
from threadmill.plans.corpus import _joined, _strip
from threadmill.plans.extractions import ORACLE_SQL as _UNIT_SQL
from threadmill.plans.extractions import _EXCERPT, _X, _annotated, extractions
from threadmill.session import cut, ensure_checkpoint_dir, table
from threadmill.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register f(spark, sf_dir, folder) as a query whose folder exists while it runs."""

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            folder = f"{spark.sparkContext.getCheckpointDir()}/exchange-{uuid.uuid4()}"
            try:
                return cut(f(spark, d, folder))
            finally:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"select coalesce(country, '') as country, count(*) as n, 0 as n_bad, sum(length(coalesce(original_text, '')))::bigint as n_chars, count(original_title) as n_titles from source_posts group by 1")
def posts_as_lines(spark, d, folder):
    """Posts written as JSON lines and read in their declared schema."""
    posts = table(spark, d, "source_posts")
    files.write_jsonl(posts.select(*[F.col(c) for c in schema.POST.fieldNames() if c in posts.columns]), f"{folder}/posts")
    back = files.read_jsonl(spark, f"{folder}/posts", schema.POST)
    return back.groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.count("*").alias("n"), F.count_if(F.size("issues") > 0).cast("int").alias("n_bad"), F.coalesce(F.sum(F.length("original_text")), F.lit(0)).alias("n_chars"), F.count("original_title").alias("n_titles"))


@query(_UNIT_SQL["units_accepted"])
def results_as_lines(spark, d, folder):
    """Results written as JSON lines, read strictly, and their accepted units."""
    rows = extractions(spark, d)
    files.write_jsonl(rows.select(*[c for c in schema.EXTRACTION.fieldNames() if c in rows.columns]), f"{folder}/results")
    back = files.require_valid(files.read_jsonl(spark, f"{folder}/results", schema.EXTRACTION), "line")
    return units.flatten_units(back)


@query("select count(*) as n, count(*) as n_lines, 1 as least, true as gapless from source_posts")
def numbered_file_lines(spark, d, folder):
    """Lines numbered from 1 without gaps in the one file they are written to."""
    table(spark, d, "source_posts").select(F.col("row_id").cast("string").alias("value")).repartition(1).write.text(f"{folder}/lines")
    lines = files.numbered_lines(spark, f"{folder}/lines")
    return lines.agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_lines"), F.min("line").cast("int").alias("least"), (F.max("line") == F.count("*")).alias("gapless"))


_T = _joined("original_title", "original_text")


@query(
    f"""select coalesce(array_to_string(list_filter([case when {_strip("coalesce(post_id, '')")} = '' then 'missing_post_id' end, case when {_strip("coalesce(country, '')")} not in ('CHI', 'JPN', 'KOR') then 'unknown_country' end,
    case when {_strip("coalesce(language, '')")} not in ('zh', 'ja', 'ko') then 'unknown_language' end, case when {_T} = '' then 'missing_text' end], lambda x: x is not null), ','), '') as issues, count(*) as n, count(distinct {_strip("coalesce(post_id, '')")}) as n_ids from source_posts group by 1"""
)
def posts_from_csv(spark, d, folder):
    """A CSV of posts under other column names, loaded with inferred columns."""
    posts = table(spark, d, "source_posts").select(F.col("post_id").alias("id"), F.col("original_title").alias("Title"), F.col("original_text").alias("Text"), F.col("country").alias("country_code"), F.col("language").alias("lang"))
    posts.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(f"{folder}/posts.csv")
    loaded = files.load_posts(files.read_table(spark, f"{folder}/posts.csv"))
    return loaded.groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("n_ids"))


@query(f"with {_X} select country, content_function, count(*) as n, sum(length({_EXCERPT}))::bigint as n_chars, count(distinct sha256({_EXCERPT})) as n_prints from x where country is not null and language is not null and experiencer_label is not null and content_function is not null group by all")
def labelled_examples_as_lines(spark, d, folder):
    """Labelled examples written one a line and loaded again."""
    rows = extractions(spark, d).where("country is not null and language is not null and experiencer_label is not null and content_function is not null")
    text = files.joined(F.col("original_title"), F.col("original_text"))
    gold = rows.withColumns({"canonical_id": F.col("post_id"), "evidence_excerpt": F.lit(""), "rationale": F.lit(""), "source_sheet": F.lit(""), "text_fingerprint": F.sha2(text, 256)})
    gold.select(files.gold_json().alias("value")).write.text(f"{folder}/gold")
    back = files.load_classification_gold(spark, f"{folder}/gold")
    n = F.length(files.joined(F.col("original_title"), F.col("original_text")))
    return back.groupBy("country", "content_function").agg(F.count("*").alias("n"), F.sum(n).alias("n_chars"), F.count_distinct("text_fingerprint").alias("n_prints"))


_PART = "select '{}' as part, domain, count(*) as n from x join u using (row_id) where judge_verdict = 'accept' and support_type <> 'unsupported' and assertion <> 'negated' {} group by 2"
_IS = " and relevance_label = 'R1' and experiencer_label = '{}' and content_function in ('C1', 'C2')"


@query(f"with {_X} {_PART.format('all', '')} union all {_PART.format('primary', _IS.format('E1'))} union all {_PART.format('proxy', _IS.format('E2'))}")
def unit_tables(spark, d, folder):
    """The unit tables of a gold bundle, read again and counted by domain."""
    files.write_gold_bundle(extractions(spark, d), folder)
    parts = [spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{folder}/{p}_units").groupBy(F.lit(p).alias("part"), "domain").agg(F.count("*").alias("n")) for p in ("all", "primary", "proxy")]
    return functools.reduce(DataFrame.union, parts)


@query("select k as kind, count(*) as n, coalesce(sum(liked_count), 0)::bigint as likes, count(distinct id) as n_ids from notes, (values ('csv'), ('json')) t(k) group by 1")
def notes_exported(spark, d, folder):
    """Notes exported as CSV and as JSON with lists as arrays."""
    notes = table(spark, d, "notes")
    for kind in ("csv", "json"):
        files.write_notes(notes, f"{folder}/{kind}", kind)
    csv = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{folder}/csv").select(F.lit("csv").alias("kind"), F.col("id").cast("bigint"), F.col("liked_count").cast("bigint"))
    js = spark.read.schema("id bigint, liked_count bigint, images array<string>").json(f"{folder}/json").select(F.lit("json"), "id", "liked_count")
    return csv.union(js).groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("liked_count"), F.lit(0)).alias("likes"), F.count_distinct("id").alias("n_ids"))


@query(_UNIT_SQL["run_counters"].replace("(select count_if(row_id % 2 = 0) from a) as validation_ok, (select count_if(row_id % 2 <> 0) from a) as validation_failed", "(select count(*) from a) as n_annotations, (select count(*) from s where lost or unlabelled) as n_errors"))
def run_written(spark, d, folder):
    """A run's annotations, errors and manifest as they stand in its folder."""
    done, errors = _annotated(spark, d)
    files.write_run(folder, extractions(spark, d), done, errors, {"backend": "rules"})
    names = ["rows_attempted", "rows_completed", "rows_failed", "stage_errors", "rows_with_stage_errors"]
    manifest = spark.read.text(f"{folder}/run_manifest").select(*[F.get_json_object("value", f"$.{c}").cast("bigint").alias(c) for c in names])
    count = lambda part, name: spark.read.text(f"{folder}/{part}").agg(F.count("*").alias(name))
    return manifest.join(count("annotations", "n_annotations"), how="cross").join(count("errors", "n_errors"), how="cross")


@query("select split, count(*) as n, (select count(*) from project_split_manifest where split = 'eval_holdout') as n_eval, (select count(*) + 1 from project_split_manifest where split = 'eval_holdout') as n_id_lines from project_split_manifest where split in ('main', 'eval_holdout') group by 1")
def splits_written(spark, d, folder):
    """The splits and the files beside the evaluation split, read again."""
    m = table(spark, d, "project_split_manifest").withColumn("length_band", F.lit("short")).withColumn("record_id", F.col("entry_id").cast("string"))
    ev = m.where("split = 'eval_holdout'")
    files.write_splits(folder, {"main": m.where("split = 'main'"), "eval_holdout": ev}, files.eval_manifest(ev))
    files.write_eval_sidecars(ev, f"{folder}/sidecars")
    parts = [spark.read.text(f"{folder}/{p}").agg(F.lit(p).alias("split"), F.count("*").alias("n")).where("n > 0") for p in ("main", "eval_holdout")]
    n_eval = spark.read.json(f"{folder}/manifest").select(F.col("rows").alias("n_eval"))
    ids = spark.read.text(f"{folder}/sidecars/ids").agg(F.count("*").alias("n_id_lines"))
    return parts[0].union(parts[1]).join(n_eval, how="cross").join(ids, how="cross")


@query("select count(*) as n, count(distinct note_id) as n_ids, coalesce(sum(liked_count), 0)::bigint as likes from notes")
def second_store_scanned(spark, d, folder):
    """A second note store, written elsewhere, scanned as a merge reads it."""
    table(spark, d, "notes").write.parquet(f"{folder}/store")
    other = store.scan_store(spark, f"{folder}/store")
    return other.agg(F.count("*").alias("n"), F.count_distinct("note_id").alias("n_ids"), F.coalesce(F.sum("liked_count"), F.lit(0)).alias("likes"))
