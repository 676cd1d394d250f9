"""Readers and writers of post tables, extraction documents and collected notes."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill import schema
from threadmill.functions.text import canonical_id, clean_cell, combined_text, filled, fingerprint, joined
from threadmill.operators.units import candidate, flatten_units, missing_spans
from threadmill.session import cut

# Column names that are taken for a canonical field.
_CANDIDATES = {
    "post_id": ["post_id", "record_id", "Post_ID", "id", "ID", "note_id", "tweet_id", "帖子ID"],
    "title": ["original_title", "title", "Title", "原文标题"],
    "text": ["text_clean", "original_text", "text", "Text", "content", "Content", "post_text", "clean_text", "正文", "原文正文"],
    "country": ["country", "Country", "country_code", "Country_Code"],
    "language": ["language", "Language", "lang", "Lang"],
    "platform": ["platform", "Platform"],
}
# The sheets of a classification workbook, and its headers.
SHEETS = {"中文": ("CHI", "zh"), "日文": ("JPN", "ja"), "韩文": ("KOR", "ko")}
_HEADERS = {
    "post_id": "帖子ID", "original_title": "原文标题", "original_text": "原文正文", "analysis_text_en": "英文译文",
    "experiencer_label": "经历主体", "content_function": "内容功能", "evidence_excerpt": "证据摘录", "rationale": "判定理由",
}


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, multi_line: bool = True) -> DataFrame:
    """A CSV, JSON-lines or Excel table, all values as text (ids keep leading zeros).

    With ``multi_line`` quoted CSV cells may hold line ends, but one task reads a whole
    file; give False for large files without such cells. A workbook is read on the driver.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    if kind in (".jsonl", ".ndjson"):
        return spark.read.json(path, primitivesAsString=True)
    if kind in (".xlsx", ".xls"):
        return spark.createDataFrame(_sheet(path, sheet))
    raise ValueError(f"Unsupported table format: {kind or path}")


def _sheet(path: str, sheet: str | int):
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading Excel workbooks needs openpyxl") from e
    import pandas as pd

    return pd.read_excel(path, sheet_name=sheet, dtype=str)


def infer_columns(columns: Sequence[str]) -> dict[str, str]:
    """Canonical field -> the one column that matches it; id and text are required."""
    out = {}
    for field, names in _CANDIDATES.items():
        found = [c for c in columns if c in names]
        if len(found) > 1:
            raise ValueError(f"Ambiguous {field} column: {found}")
        if found:
            out[field] = found[0]
        elif field in ("post_id", "text"):
            raise ValueError(f"Could not infer the {field} column from {list(columns)}")
    return out


def load_posts(df: DataFrame, columns: Mapping[str, str] | None = None, country: str | None = None, language: str | None = None, drop_empty: bool = False) -> DataFrame:
    """Posts in the canonical schema with an issues column: bad rows are kept and marked.

    ``columns`` maps canonical fields to columns (else they are inferred); constants fill
    country and language where no column does. With ``drop_empty`` rows without title and
    text are left out. The text goes to text_clean where its column has that very name.
    """
    m = dict(columns or infer_columns(df.columns))
    constants = {"country": country, "language": language}
    for c in constants:
        if c not in m and constants[c] is None:
            raise ValueError(f"{c} must be provided as a column or a constant")
    cell = lambda f: clean_cell(F.col(f"`{m[f]}`")) if f in m else F.lit(constants.get(f) or "")
    clean = m["text"] == "text_clean"
    out = df.select(
        cell("post_id").alias("post_id"), cell("country").alias("country"), cell("language").alias("language"), cell("platform").alias("platform"), cell("title").alias("original_title"),
        (F.lit("") if clean else cell("text")).alias("original_text"), (cell("text") if clean else F.lit("")).alias("text_clean"),
    )
    text = F.coalesce(combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text")), F.lit(""))
    if drop_empty:
        out = out.where((F.col("original_title") != "") | (F.col("original_text") != "") | (F.col("text_clean") != ""))
    issue = lambda c, code: F.when(c, F.lit(code))
    issues = F.array_compact(F.array(issue(F.col("post_id") == "", "missing_post_id"), issue(~F.col("country").isin(schema.COUNTRIES), "unknown_country"), issue(~F.col("language").isin(schema.LANGUAGES), "unknown_language"), issue(text == "", "missing_text")))
    return out.withColumn("issues", issues)


def require_valid(df: DataFrame, what: str = "row") -> DataFrame:
    """df without its issues column; the first row with an issue fails the query."""
    return df.where(F.when(F.size("issues") > 0, F.raise_error(F.concat_ws(" ", F.lit(f"bad {what}:"), F.array_join("issues", ", ")))).otherwise(F.lit(True))).drop("issues")


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line, raw): every line of text files with its number in its file, from 1.

    Files are split like any other: lines are counted per split, and a split's lines are
    numbered on from those of the splits before it. One row per split meets a window.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    splits = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = splits.selectExpr("file", "at", "first", "sum(n) over (partition by file order by at) - n as before")
    return lines.join(before, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "raw")


def read_jsonl(spark: SparkSession, path: str, struct, strict: bool = True) -> DataFrame:
    """JSON lines in a declared schema, with issues: malformed lines and unknown keys.

    Each row carries its 1-based line number and file; blank lines count but give no row.
    With ``strict`` unknown keys are issues, those of nested units as well, else they are
    ignored. Fields may stand under their older names.
    """
    rows = numbered_lines(spark, path).where(F.trim("raw") != "")
    names = lambda fields, aliases: F.array(*[F.lit(n) for f in fields for n in aliases.get(f, [f])])
    keys = F.json_object_keys("raw")
    extra = F.array_except(keys, names(struct.fieldNames(), schema.POST_ALIASES))
    if "units" in struct.fieldNames():
        raws = F.coalesce(F.from_json(F.get_json_object("raw", "$.units"), "array<string>"), F.array().cast("array<string>"))
        known = names(schema.UNIT.fieldNames(), schema.UNIT_ALIASES)
        inner = F.array_distinct(F.flatten(F.transform(raws, lambda r: F.coalesce(F.array_except(F.json_object_keys(r), known), F.array().cast("array<string>")))))
        extra = F.concat(extra, F.transform(inner, lambda k: F.concat(F.lit("units."), k)))
    parsed = rows.select("file", "line", "raw", F.from_json("raw", struct).alias("r"), keys.isNull().alias("bad"), extra.alias("extra"), *[_aliased(F.col("raw"), keys, n).alias(f"__{c}") for c, n in schema.POST_ALIASES.items()])

    def field(f):
        if f.name == "units":
            return _aliased_units(F.col("raw"), F.col("r.units")).alias("units")
        return F.coalesce(F.col(f"__{f.name}"), F.col(f"r.{f.name}")).alias(f.name) if f.name in schema.POST_ALIASES else F.col(f"r.{f.name}").alias(f.name)

    issues = F.array_compact(F.array(F.when(F.col("bad"), F.lit("malformed_json")), F.when((F.size("extra") > 0) & F.lit(strict), F.concat(F.lit("unknown_keys:"), F.array_join("extra", ",")))))
    return parsed.select("file", "line", *[field(f) for f in struct.fields], issues.alias("issues"))


def _aliased_units(raw, units):
    """Units whose fields were filled from their older names where those are present."""
    raws = F.from_json(F.get_json_object(raw, "$.units"), "array<string>")

    def one(u, r):
        for c, names in schema.UNIT_ALIASES.items():
            u = u.withField(c, F.coalesce(u[c], *[F.get_json_object(r, f"$.{n}") for n in names[1:]]))
        return u

    return F.zip_with(units, raws, one)


def _aliased(raw, keys, names: Sequence[str]):
    """The value of the first key present, even if it is null: presence decides, not value."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), F.get_json_object(raw, f"$.{n}")).otherwise(out)
    return out


def load_gold(spark: SparkSession, paths: Sequence[str], validate_spans: bool = True) -> DataFrame:
    """Extraction documents of several JSON array files.

    A file that isn't a list, a post id in two places, and with ``validate_spans`` an
    evidence span that doesn't stand in its record's text, are errors that name them.
    """
    heads = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("v")).where("v <> ''")
    no_list = [r["file"] for r in heads.groupBy("file").agg(F.min_by("v", "id").alias("v")).where("not v like '[%'").orderBy("file").limit(20).collect()]
    if no_list:
        raise ValueError(f"Must contain a JSON list: {no_list}")
    df = spark.read.schema(schema.EXTRACTION).json(list(paths), multiLine=True)
    refuse_repeats(df, ["post_id"], "post_id across files")
    if validate_spans:
        text = combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))
        bad = [r["post_id"] for r in df.where(F.size(missing_spans(text)) > 0).select("post_id").orderBy("post_id").limit(20).collect()]
        if bad:
            raise ValueError(f"evidence_span_original not found in source text of {bad}")
    return df


def refuse_repeats(df: DataFrame, key: Sequence[str], what: str) -> None:
    """A ValueError that lists the first keys that occur twice."""
    again = [tuple(r[c] for c in key) for r in df.groupBy(*key).count().where("count > 1").orderBy(*key).limit(20).collect()]
    if again:
        raise ValueError(f"Duplicate {what}: {again}")


def classification_gold(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Labelled examples from the sheets of a workbook, in one table.

    ``sheets`` is name -> rows under the workbook's headers; the name gives country and
    language. A row without title and text, and a (country, canonical id) that occurs
    twice, are errors.
    """
    parts = []
    for name, df in sheets.items():
        country, language = SHEETS[name]
        cell = lambda c: (clean_cell(F.col(f"`{_HEADERS[c]}`")) if _HEADERS[c] in df.columns else F.lit("")).alias(c)  # noqa: B023, E731
        parts.append(df.select(*[cell(c) for c in _HEADERS], F.lit(country).alias("country"), F.lit(language).alias("language"), F.lit(name).alias("source_sheet")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("canonical_id", canonical_id(F.col("post_id"))).withColumn("text_fingerprint", fingerprint(joined(F.col("original_title"), F.col("original_text"))))
    empty = [tuple(r) for r in rows.where("original_title = '' and original_text = ''").select("source_sheet", "post_id").orderBy("source_sheet", "post_id").limit(20).collect()]
    if empty:
        raise ValueError(f"Missing source text: {empty}")
    refuse_repeats(rows, ["country", "canonical_id"], "canonical id within classification gold")
    return rows


def load_classification_workbook(spark: SparkSession, path: str) -> DataFrame:
    """classification_gold of an Excel workbook."""
    return classification_gold({name: spark.createDataFrame(_sheet(path, name)) for name in SHEETS})


GOLD_COLUMNS = ["post_id", "canonical_id", "country", "language", "original_title", "original_text", "analysis_text_en", "experiencer_label", "content_function", "evidence_excerpt", "rationale", "source_sheet", "text_fingerprint"]


def gold_json() -> Column:
    """A labelled example as one JSON line."""
    return F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in GOLD_COLUMNS]))


def gold_posts(gold: DataFrame) -> DataFrame:
    """Labelled examples as posts."""
    empty = [f for f in schema.POST.fields if f.name not in GOLD_COLUMNS or f.name in ("analysis_text_en", "source_sheet")]
    return gold.select("post_id", "country", "language", "original_title", "original_text", "text_fingerprint", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty])


def load_classification_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples from JSON lines; missing optional fields are ''. Nothing is recomputed."""
    rows = read_jsonl(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in GOLD_COLUMNS]), strict=False)
    required = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("post_id", "canonical_id", "country", "language", "experiencer_label", "content_function")])
    bad = F.when((F.size("issues") > 0) | required.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("bad line"), "line", F.array_join("issues", ","), required))).otherwise(F.lit(True))
    return rows.where(bad).select(*[F.coalesce(c, F.lit("")).alias(c) for c in GOLD_COLUMNS])


def existing_or(path: str, fallback: str) -> str:
    """A path if something is there, else its fallback; an error if neither is."""
    for p in (path, fallback):
        if os.path.exists(p):
            return p
    raise FileNotFoundError(f"Neither {path} nor {fallback} exists")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, value): the captured state, cards and markup below a folder, a file a row."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{ssr.json,dom_cards.json,page.html}").text(root, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(F.input_file_name(), r"/([^/]+)$", 1).alias("name"), "value")


def read_collected(spark: SparkSession, root: str) -> DataFrame:
    """Notes below collect_* and snapshot_* folders: all_notes.json of a folder that has notes
    in it, else every note_*/note_parsed.json; the keyword is the folder name's second part."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.input_file_name().alias("file"), "value")
    dirs = F.regexp_extract("file", r"/((?:collect|snapshot)_[^/]*)/", 1)
    files = files.select("file", "value", dirs.alias("dir"), F.regexp_extract("file", r"/([^/]+)$", 1).alias("name")).where("dir <> ''")
    whole = files.where("name = 'all_notes.json'").select("dir", F.explode(F.from_json("value", "array<string>")).alias("raw"))
    single = files.where("name = 'note_parsed.json'").join(whole.select("dir").distinct(), "dir", "left_anti").select("dir", F.col("value").alias("raw"))
    keyword = F.coalesce(F.get(F.split("dir", "_"), F.lit(1)), F.lit(""))
    return whole.union(single).select(keyword.alias("keyword"), "dir", "raw")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_units(df: DataFrame, path: str, accepted_only: bool = True, kind: str = "csv") -> None:
    """The flattened units of an extraction table as CSV with a header, or as a workbook.

    A workbook is written by the driver and holds at most the rows of one sheet.
    """
    rows = flatten_units(df, accepted_only)
    if kind == "csv":
        rows.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "xlsx":
        few = rows.limit(1_048_576).toPandas()
        if len(few) > 1_048_575:
            raise ValueError("a sheet has no more than 1,048,575 rows")
        few.to_excel(path, index=False)
    else:
        raise ValueError(f"Unsupported unit table format: {kind}")


def write_run(folder: str, posts: DataFrame, results: DataFrame, errors: DataFrame, about: Mapping[str, object] | None = None) -> None:
    """A run's annotations, traces, errors and manifest, side by side.

    ``results`` is what annotate returned. What the manifest says beside its counters
    (input, backend, configuration) is given in ``about``.
    """
    trace = ["post_id", "stages", "issues"]
    write_jsonl(results.drop("stages", "issues"), f"{folder}/annotations")
    write_jsonl(results.select(*trace), f"{folder}/trace")
    write_jsonl(errors, f"{folder}/errors")
    manifest = run_summary(posts, results, errors).first()["manifest"]
    given = json.dumps({**dict(about or {}), **json.loads(manifest)}, ensure_ascii=False)
    posts.sparkSession.createDataFrame([(given,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_manifest")


def write_splits(folder: str, parts: Mapping[str, DataFrame], manifest: DataFrame) -> None:
    """The rows of each split as JSON lines, and a manifest of one row.

    A part may be read from the very folder it goes to, so all parts are materialised in
    the checkpoint folder before the first is overwritten.
    """
    held = {name: cut(df) for name, df in [*parts.items(), ("manifest", manifest.coalesce(1))]}
    for name, df in held.items():
        write_jsonl(df, f"{folder}/{name}")


def eval_manifest(rows: DataFrame) -> DataFrame:
    """One row (rows, countries, length_bands, country_length_bands): counts as JSON objects."""
    counts = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))))
    each = cut(rows.groupBy(F.coalesce("country", F.lit("")).alias("country"), F.coalesce("length_band", F.lit("")).alias("band")).agg(F.count("*").alias("n")))
    of = lambda name, c: each.groupBy(c.alias("k")).agg(F.sum("n").alias("n")).agg(counts("k").alias(name))
    parts = [of("countries", F.col("country")), of("length_bands", F.col("band")), of("country_length_bands", F.concat_ws(":", "country", "band"))]
    return reduce(lambda a, b: a.join(F.broadcast(b), how="cross"), parts, each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))


def write_eval_sidecars(rows: DataFrame, folder: str) -> None:
    """Ids and strata of evaluation rows as unquoted CSV, and their counts."""
    columns = ["record_id", "country", "language", "length_band", "text_fingerprint"]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in columns])
    header = rows.sparkSession.createDataFrame([(",".join(columns),)], "value string")
    header.union(rows.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(f"{folder}/ids")  # an evaluation set fits one file
    write_jsonl(eval_manifest(rows).coalesce(1), f"{folder}/manifest")


def session_summary(notes: DataFrame, session: str, top: int = 5) -> DataFrame:
    """(session, summary): per session its notes, keywords and most liked titles, as JSON."""
    counts = notes.groupBy(session).agg(F.count("*").alias("notes"), F.array_sort(F.collect_set("keyword")).alias("keywords"), F.coalesce(F.sum("liked_count"), F.lit(0)).alias("likes"))
    ranked = notes.selectExpr(session, "title", f"row_number() over (partition by {session} order by liked_count desc nulls last, id) as rank").where(F.col("rank") <= top)
    best = ranked.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.coalesce(x["title"], F.lit(""))).alias("top"))
    return counts.join(best, session, "left").select(session, F.to_json(F.struct("notes", "keywords", "likes", "top")).alias("summary"))


def write_gold_bundle(df: DataFrame, folder: str) -> None:
    """All accepted units, and those of primary and proxy candidates, side by side."""
    for name, part in {"all": df, "primary": df.where(candidate("E1")), "proxy": df.where(candidate("E2"))}.items():
        write_units(part, f"{folder}/{name}_units")


def write_notes(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An export of notes, most liked first: CSV, or JSON with array fields as arrays."""
    ordered = df.orderBy(F.desc_nulls_last("liked_count"), "id")
    if kind == "csv":
        ordered.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    else:
        arrays = [F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(F.nullif(F.col(c), F.lit("")), "; ")).alias(c) if c in ("images", "hashtags") else F.col(c) for c in df.columns]
        ordered.select(*arrays).write.mode("overwrite").json(path)


def run_summary(posts: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """One JSON document of a run's counters.

    ``posts`` are the rows that went in, ``results`` has issues for each row that came out.
    A post that a stage lost is among the failed: those are the rows attempted less the
    different posts that came out.
    """
    tried = posts.agg(F.count("*").alias("rows_attempted"))
    done = results.agg(
        F.count("*").alias("rows"), F.count("*").alias("rows_completed"), F.count("*").alias("rows_succeeded"), F.count_distinct(filled(F.col("post_id"))).alias("__posts"), F.count_if(F.size("issues") == 0).alias("validation_ok"), F.count_if(F.size("issues") > 0).alias("validation_failed")
    )
    bad = errors.agg(F.count("*").alias("stage_errors"), F.count_distinct(filled(F.col("post_id"))).alias("rows_with_stage_errors"))
    one = tried.join(F.broadcast(done), how="cross").join(F.broadcast(bad), how="cross").withColumn("rows_failed", F.greatest(F.col("rows_attempted") - F.col("__posts"), F.lit(0)))
    return one.select(F.to_json(F.struct(*[c for c in one.columns if c != "__posts"])).alias("manifest"))
