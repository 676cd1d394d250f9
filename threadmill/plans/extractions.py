"""Queries on posts with nested units, each with its DuckDB oracle.

The tables have no extraction results, so one is derived for every source post: labels and
up to three units follow from row_id, and the evidence is a part of the post's own text or
isn't. The oracles derive the same rows in long form, without arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.functions.text import combined_text
from threadmill.operators import retrieve, units
from threadmill.plans.annotate import annotate
from threadmill.plans.corpus import _combined, _joined, _strip
from threadmill.session import table
from threadmill.sources.files import run_summary

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# The formulas of the derived rows: r is row_id, k the unit's place from 1, h = 7 r + k.
_LABELS = {
    "relevance_label": "case when r % 6 = 0 then 'R0' when r % 6 = 1 then null else 'R1' end",
    "experiencer_label": "case when r % 12 in (0, 1) or r % 7 = 0 then null else concat('E', cast(r % 3 + 1 as varchar(9))) end",
    "content_function": "case when (r % 6 = 0 and r % 5 > 0) or r % 8 = 0 then null else concat('C', cast(r % 5 + 1 as varchar(9))) end",
}
_PICK = lambda values, by: "case " + " ".join(f"when {by} % {len(values)} = {i} then '{v}'" for i, v in enumerate(values)) + " end"
_UNIT = {
    "unit_id": "case when h % 3 = 0 then '' when h % 11 = 0 then 'X' else concat(post_id, '_u', right(concat('00', cast(k as varchar(9))), 3)) end",
    "domain": _PICK([*schema.DOMAINS, "Other"], "h"),
    "evidence_span_original": "case h % 4 when 0 then substr(text, 1, 5) when 1 then 'nowhere to be found' when 2 then '' else substr(text, 3, 4) end",
    "surface_text_working": "concat('s', cast(h % 17 as varchar(9)))",
    "working_language": "language",
    "normalized_concept_en": "case when h % 5 = 0 then '' else concat('c', cast(h % 7 as varchar(9))) end",
    "concept_status": _PICK(schema.CONCEPT_STATUS, "h"),
    "support_type": _PICK(["explicit", "implicit", "unsupported", "explicit"], "h"),
    "assertion": _PICK(["present", "negated", "present", "uncertain", "planned"], "h"),
    "temporality": _PICK(schema.TEMPORALITIES, "h"),
    "sentiment_or_outcome": _PICK(schema.OUTCOMES, "h"),
    "confidence": "cast(h % 13 as double) / 10",
    "judge_verdict": _PICK(["accept", "accept", "revise", "accept", "reject", "maybe", "needs_human_review"], "h"),
}
_X = f"""x as (select *, {', '.join(f'{e} as {c}' for c, e in _LABELS.items())} from (select row_id, row_id as r, concat('p', row_id) as post_id, country, language, coalesce(platform, '') as platform,
    coalesce(original_title, '') as original_title, coalesce(original_text, '') as original_text, coalesce(text_clean, '') as text_clean, coalesce(analysis_text_en, '') as analysis_text_en, {_combined()} as text from source_posts)),
    u as (select row_id, k, {', '.join(f'{e} as {c}' for c, e in _UNIT.items())} from (select x.*, k, r * 7 + k as h from x, lateral (select unnest(range(1, r % 4 + 1)) as k)))"""
_ACCEPTED = "judge_verdict = 'accept' and support_type <> 'unsupported' and assertion <> 'negated'"
_CANDIDATE = "relevance_label = 'R1' and experiencer_label = '{}' and content_function in ('C1', 'C2')"
_BOTH = f"({_CANDIDATE.format('E1')} or {_CANDIDATE.format('E2')})"


def extractions(spark: SparkSession, d: str) -> DataFrame:
    """One result for every source post."""
    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    p = table(spark, d, "source_posts").select(
        "row_id", F.col("row_id").alias("r"), F.concat(F.lit("p"), "row_id").alias("post_id"), "country", "language", *[filled(c) for c in ("platform", "original_title", "original_text", "text_clean", "analysis_text_en")],
        combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text")).alias("text"),
    )
    fields = [f"{_UNIT[f.name]} as {f.name}" for f in schema.UNIT.fields]
    made = ", ".join(f"'{x.rsplit(' as ', 1)[1]}', {x.rsplit(' as ', 1)[0]}" for x in fields)
    unit = f"case when r % 4 = 0 then array() else transform(sequence(1, cast(r % 4 as int)), i -> transform(array(named_struct('k', i, 'h', r * 7 + i)), z -> named_struct({_lambda(made)}))[0]) end"
    rows = p.selectExpr("*", *[f"{e} as {c}" for c, e in _LABELS.items()]).withColumn("units", F.expr(unit).cast(f"array<{schema.UNIT.simpleString()}>"))
    return rows.drop("r", "text")


def _lambda(sql: str) -> str:
    """k and h of the formulas as fields of the lambda variable z."""
    return re.sub(r"\b([kh])\b(?!')", r"z.\1", sql)


_FLAT = "post_id, country, language, coalesce(relevance_label, '') as relevance_label, coalesce(experiencer_label, '') as experiencer_label, coalesce(content_function, '') as content_function, cast(k - 1 as int) as unit_pos, " + ", ".join(f.name for f in schema.UNIT.fields)


@query(f"with {_X} select {_FLAT} from x join u using (row_id)")
def units_all(spark, d):
    """Every unit with its post's labels."""
    return units.flatten_units(extractions(spark, d), accepted_only=False)


@query(f"with {_X} select {_FLAT} from x join u using (row_id) where {_ACCEPTED}")
def units_accepted(spark, d):
    """The accepted units."""
    return units.flatten_units(extractions(spark, d))


@query(f"with {_X} select row_id, {', '.join(f'coalesce(max(case when {_ACCEPTED} and domain = {chr(39)}{n}{chr(39)} then 1 end), 0)::int as {n.lower().replace(chr(32), chr(95))}' for n in schema.DOMAINS)} from x left join u using (row_id) group by 1")
def unit_domains(spark, d):
    """Which domains each post's accepted units touch."""
    return extractions(spark, d).select("row_id", *units.domain_labels())


@query(f"with {_X} select row_id, coalesce({_CANDIDATE.format('E1')}, false) as is_primary, coalesce({_CANDIDATE.format('E2')}, false) as is_proxy, (select count(*) from u where u.row_id = x.row_id and {_ACCEPTED}) as n_accepted from x")
def csm_candidates(spark, d):
    """Primary and proxy candidates with their number of accepted units."""
    return extractions(spark, d).select("row_id", units.candidate("E1").alias("is_primary"), units.candidate("E2").alias("is_proxy"), F.size(units.accepted_units()).cast("bigint").alias("n_accepted"))


@query(f"with {_X} select row_id, text_clean <> '' as cleaned from x where {_CANDIDATE.format('E1')} and content_function = 'C1'")
def strict_sensitivity_set(spark, d):
    """The strict analysis set: relevant own stories that tell."""
    return extractions(spark, d).where(units.candidate("E1") & (F.col("content_function") == "C1")).select("row_id", (F.col("text_clean") != "").alias("cleaned"))


@query(
    f"""with {_X}, b as (select row_id, post_id, k, unit_id, row_number() over (partition by row_id order by k) as nth from x join u using (row_id) where {_strip('unit_id')} = ''),
    free as (select row_id, name, row_number() over (partition by row_id order by n) as nth from (select row_id, n, concat(post_id, '_u', right(concat('00', n), 3)) as name from x, range(1, 9) t(n)) f where not exists (select 1 from u where u.row_id = f.row_id and u.unit_id = f.name))
    select row_id, cast(k as int) as k, unit_id from u where {_strip('unit_id')} <> '' union all select row_id, cast(k as int), name from b join free using (row_id, nth)"""
)
def unit_ids_assigned(spark, d):
    """Unit ids after blanks are filled."""
    return units.assign_unit_ids(extractions(spark, d)).select("row_id", F.posexplode("units").alias("k", "u")).select("row_id", (F.col("k") + 1).alias("k"), "u.unit_id")


@query(f"with {_X} select row_id, coalesce((select string_agg(evidence_span_original, '|' order by k) from u where u.row_id = x.row_id and not contains(x.text, evidence_span_original)), '') as missing from x")
def ungrounded_spans(spark, d):
    """The evidence spans that don't stand in the text, in order."""
    text = combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))
    return extractions(spark, d).select("row_id", F.array_join(units.missing_spans(text), "|").alias("missing"))


def _codes_sql(codes: list[tuple[str, str]]) -> str:
    """SQL: the codes whose condition isn't known to be false, as a list."""
    return "list_filter([" + ", ".join(f"case when coalesce({c}, true) then '{n}' end" for c, n in codes) + "], lambda y: y is not null)"


_HAS = "exists (select 1 from u where u.row_id = x.row_id)"
_SCHEMA_ROW = [
    ("x.post_id = ''", "missing_post_id"), (f"x.country not in ({_list(schema.COUNTRIES)})", "unknown_country"), (f"x.language not in ({_list(schema.LANGUAGES)})", "unknown_language"), ("x.text = ''", "missing_text"),
    (f"(select count(*) <> count(distinct unit_id) from u where u.row_id = x.row_id and {_strip('unit_id')} <> '')", "repeated_unit_id"),
]
_SCHEMA_UNIT = [
    ("not confidence between 0 and 1", "confidence_out_of_range"), (f"concept_status <> 'unmapped' and {_strip('normalized_concept_en')} = ''", "missing_concept"),
    *[(f"{c} not in ({_list(v)})", f"unknown_{c}") for c, v in {"concept_status": schema.CONCEPT_STATUS, "support_type": schema.SUPPORT_TYPES, "assertion": schema.ASSERTIONS, "judge_verdict": schema.VERDICTS}.items()],
]
_NO = "coalesce(relevance_label in ('R0', 'RU'), false)"
_HIERARCHY_ROW = [
    ("relevance_label is null", "missing_relevance"), (f"{_NO} and experiencer_label is not null", "downstream_after_non_r1"), (f"{_NO} and content_function is not null", "downstream_after_non_r1"), (f"{_NO} and {_HAS}", "units_after_non_r1"),
    ("coalesce(relevance_label = 'R1', false) and experiencer_label is null", "missing_experiencer"), ("coalesce(relevance_label = 'R1', false) and content_function is null", "missing_content_function"),
    (f"{_HAS} and not coalesce({_BOTH}, false)", "units_for_ineligible_row"),
]
_SPAN = _strip("evidence_span_original")
_HIERARCHY_UNIT = [(f"domain not in ({_list(schema.DOMAINS)})", "invalid_csm_domain"), (f"{_SPAN} = ''", "missing_evidence_span"), (f"{_SPAN} <> '' and not contains(t.text, {_SPAN})", "evidence_span_not_found")]


def _issues_sql(row: list, unit: list, text: str = "x.text") -> str:
    per = f"coalesce((select flatten(list({_codes_sql(unit)} order by k)) from u, (select {text} as text) t where u.row_id = x.row_id), [])"
    return f"{_codes_sql(row)} || {per}"


@query(f"with {_X} select row_id, array_to_string({_issues_sql(_SCHEMA_ROW, _SCHEMA_UNIT)} || {_issues_sql(_HIERARCHY_ROW, _HIERARCHY_UNIT)}, ',') as issues from x")
def extraction_issues(spark, d):
    """Every broken constraint of every result, in the order of the checks."""
    df = extractions(spark, d)
    return df.select("row_id", F.array_join(F.concat(units.schema_codes(), units.hierarchy_codes(units._text())), ",").alias("issues"))


# Results whose id, country or language was changed on the way.
_MOVED = {"post_id": "case when row_id % 11 = 0 then concat(post_id, 'x') else post_id end", "country": "case when row_id % 9 = 0 then 'JPN' else country end", "language": "case when row_id % 10 = 0 then 'xx' else language end"}
_Y = f"y as (select row_id, {', '.join(f'{e} as {c}' for c, e in _MOVED.items())} from x)"
_DIFFERS = {c: f"(x.{c} is null or y.{c} is null or x.{c} <> y.{c})" for c in _MOVED}
_MISMATCH = [(e, f"{c}_mismatch") for c, e in _DIFFERS.items()]
_LOST = "exists (select 1 from u where u.row_id = x.row_id and not contains(x.text, evidence_span_original))"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return extractions(spark, d).withColumns({c: F.expr(e) for c, e in _MOVED.items()})


@query(
    f"""with {_X}, {_Y} select row_id, array_to_string({_issues_sql(_MISMATCH + _HIERARCHY_ROW, _HIERARCHY_UNIT)}, ',') as issues,
    case {' '.join(f"when {e} then '{c}'" for c, e in _DIFFERS.items())} when {_LOST} then 'spans' else '' end as first_error from x join y using (row_id)"""
)
def results_against_posts(spark, d):
    """Results whose metadata may have changed, checked against their source posts."""
    checked = units.validate_against_posts(_results(spark, d), extractions(spark, d), "row_id")
    return checked.select("row_id", F.array_join("issues", ",").alias("issues"), "first_error")


_BROKEN_UNIT = _SCHEMA_UNIT + [(f"domain not in ({_list(schema.DOMAINS)})", "d"), (f"{_SPAN} = ''", "s")]
_SCHEMA_Y = [("y.post_id = ''", "p"), (f"y.country not in ({_list(schema.COUNTRIES)})", "c"), (f"y.language not in ({_list(schema.LANGUAGES)})", "l"), *_SCHEMA_ROW[3:]]


@query(
    f"""with {_X}, {_Y} select row_id, case when row_id % 13 = 0 or len({_issues_sql(_SCHEMA_Y, _BROKEN_UNIT)}) > 0 then 'schema_error'
    else array_to_string({_issues_sql(_MISMATCH + _HIERARCHY_ROW, _HIERARCHY_UNIT)}, ',') end as issues from x join y using (row_id)"""
)
def payload_issues(spark, d):
    """Raw JSON payloads, some under older field names, some not JSON, read and checked."""
    older = {"evidence_span_original": "evidence_span", "surface_text_working": "surface_text_original", "normalized_concept_en": "normalized_concept"}
    renamed = F.transform("units", lambda u: F.struct(*[u[f.name].alias(older.get(f.name, f.name)) for f in schema.UNIT.fields]))
    rows = _results(spark, d)
    plain = [c for c in rows.columns if c not in ("row_id", "units", "original_text")]
    as_json = lambda text, us: F.to_json(F.struct(*plain, F.col("original_text").alias(text), us.alias("units")))
    payload = F.when(F.col("row_id") % 13 == 0, "{not json").when(F.col("row_id") % 5 == 0, as_json("text", renamed)).otherwise(as_json("original_text", F.col("units")))
    checked = units.validate_payloads(rows.select("row_id", payload.alias("payload")), "row_id", "payload", extractions(spark, d))
    return checked.select("row_id", F.array_join("issues", ",").alias("issues"))


@query(f"with {_X} select row_id, post_id, true as unlabelled, 0 as n_units from x")
def empty_extractions(spark, d):
    """The empty result of every post."""
    posts = extractions(spark, d).drop("relevance_label", "experiencer_label", "content_function", "units")
    unlabelled = F.col("relevance_label").isNull() & F.col("experiencer_label").isNull() & F.col("content_function").isNull()
    return units.empty_results(posts).select("row_id", "post_id", unlabelled.alias("unlabelled"), F.size("units").alias("n_units"))


_HIST = " union all ".join(
    [f"select '{c}' as measure, {c} as value, count(*) as n from x where {c} is not null group by 2" for c in ("country", "language", "relevance_label", "experiencer_label", "content_function")]
    + [f"select '{c}', {c}, count(*) from u group by 2" for c in ("domain", "concept_status", "support_type", "assertion", "temporality", "sentiment_or_outcome", "judge_verdict")]
    + [f"select 'accepted_domain', domain, count(*) from u where {_ACCEPTED} group by 2"]
)


@query(
    f"""with {_X} {_HIST} union all select unnest(['posts', 'units', 'accepted_units', 'span_exact_matches', 'primary_posts', 'proxy_posts']), '',
    unnest([(select count(*) from x), (select count(*) from u), (select count(*) from u where {_ACCEPTED}), (select count(*) from u join x using (row_id) where contains(text, evidence_span_original)),
    (select count(*) from x where {_CANDIDATE.format('E1')}), (select count(*) from x where {_CANDIDATE.format('E2')})])"""
)
def gold_counts(spark, d):
    """Totals and histograms of a result table."""
    return units.gold_summary(extractions(spark, d))


@query(f"with {_X}, c as (select x.*, (select count(*) from u where u.row_id = x.row_id and not contains(x.text, evidence_span_original)) as bad from x) select count_if({_CANDIDATE.format('E1')}) as n_primary, count_if({_CANDIDATE.format('E2')}) as n_proxy, sum(case when {_BOTH} then bad else 0 end)::bigint as n_bad_spans, n_primary >= 1 and n_proxy >= 1 and n_bad_spans = 0 as ready from c")
def seed_ready(spark, d):
    """Whether the results can seed retrieval."""
    return units.seed_readiness(extractions(spark, d), 1, 1)


_V = """v as (select row_id, unit_id, seq, case (row_id + seq * 3 + k) % 5 when 0 then 'accept' when 1 then 'reject' when 2 then 'perhaps' when 3 then 'revise' else 'accept' end as verdict
    from (select row_id, k, unit_id, k * 10 + s as seq from u, range(0, 3) t(s) where k + s <> 3))"""


@query(f"with {_X}, {_V}, l as (select row_id, unit_id, max_by(verdict, seq) as verdict from v where verdict <> 'perhaps' group by 1, 2) select row_id, cast(k as int) as k, coalesce(verdict, 'needs_human_review') as verdict from u left join l using (row_id, unit_id)")
def judged_units(spark, d):
    """Units with the last legal verdict a judge gave them."""
    df = extractions(spark, d)
    each = df.select("row_id", "post_id", F.posexplode("units").alias("p", "u")).selectExpr("row_id", "post_id", "p + 1 as k", "u.unit_id as unit_id", "explode(sequence(0, 2)) as s").where("k + s <> 3").selectExpr("*", "k * 10 + s as seq")
    verdict = "case (row_id + seq * 3 + k) % 5 when 0 then 'accept' when 1 then 'reject' when 2 then 'perhaps' when 3 then 'revise' else 'accept' end as judge_verdict"
    judged = units.apply_verdicts(df, each.selectExpr("post_id", "seq", "unit_id", verdict))
    return judged.select("row_id", F.posexplode("units").alias("k", "u")).select("row_id", (F.col("k") + 1).alias("k"), F.col("u.judge_verdict").alias("verdict"))


_POST_JSON = "to_json(struct_pack(" + ", ".join(f"{c} := coalesce({c}, '')" for c in ("post_id", "country", "language", "platform", "original_title", "original_text", "text_clean", "analysis_text_en")) + "))"


@query(f"with {_X} select row_id, cast({_POST_JSON} as varchar) as payload from x")
def post_payloads(spark, d):
    """Posts as a model sees them."""
    return extractions(spark, d).select("row_id", units.post_payload().alias("payload"))


_EXCERPT = _joined("original_title", "original_text")
_EXAMPLE_JSON = f"to_json(struct_pack(country := country, language := language, source_excerpt := substr({_EXCERPT}, 1, 900), experiencer_label := experiencer_label, content_function := content_function, evidence_excerpt := substr(original_text, 1, 500), rationale := substr(original_text, 1, 300)))"


@query(f"with {_X} select row_id, cast({_EXAMPLE_JSON} as varchar) as payload from x where country is not null and language is not null and experiencer_label is not null and content_function is not null")
def example_payloads(spark, d):
    """Labelled examples as a model sees them."""
    df = extractions(spark, d).where("country is not null and language is not null and experiencer_label is not null and content_function is not null")
    return df.withColumn("evidence_excerpt", F.col("original_text")).withColumn("rationale", F.col("original_text")).select("row_id", units.example_payload().alias("payload"))


_JUDGE = ["unit_id", "domain", "evidence_span_original", "surface_text_working", "normalized_concept_en", "support_type", "assertion", "temporality", "sentiment_or_outcome"]


@query(f"with {_X} select row_id, '[' || string_agg(cast(to_json(struct_pack({', '.join(f'{c} := {c}' for c in _JUDGE)})) as varchar), ',' order by k) || ']' as payload from u group by 1")
def judge_payloads(spark, d):
    """Units as a judge sees them."""
    return extractions(spark, d).where(F.size("units") > 0).select("row_id", units.judge_payload().alias("payload"))


# ---------------------------------------------------------------- staged annotation
def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rule providers stand in for models; two of them fail for some posts."""
    posts = extractions(spark, d).drop("relevance_label", "experiencer_label", "content_function", "units", "row_id")
    n = F.substring("post_id", 2, 20).cast("bigint")
    fails = lambda k: F.when(n % k == 0, F.lit("failed")).alias("error")
    relevance = lambda df: df.select("post_id", F.when(n % 3 == 0, "R0").otherwise("R1").alias("relevance_label"), fails(17))
    labels = lambda df: df.select("post_id", F.concat(F.lit("E"), n % 3 + 1).alias("experiencer_label"), F.concat(F.lit("C"), n % 4 + 1).alias("content_function"), fails(19))
    text = combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))

    def extract(df):
        unit = {"domain": F.lit("Symptom Description"), "evidence_span_original": F.substring(text, 1, 4), "concept_status": F.lit("unmapped"), "support_type": F.lit("explicit"), "assertion": F.lit("present"), "confidence": F.lit(0.5)}
        made = F.struct(*[unit.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.UNIT.fields])
        return df.select("post_id", F.when(n % 5 == 0, F.array().cast(f"array<{schema.UNIT.simpleString()}>")).otherwise(F.array(made)).alias("units"), F.lit(None).cast("string").alias("error"))

    judge = lambda df: df.select("post_id", F.lit(1).alias("seq"), F.explode("units").alias("u")).select("post_id", "seq", "u.unit_id", F.when(n % 2 == 0, "accept").otherwise("reject").alias("judge_verdict"))
    return annotate(posts, relevance, labels, extract, judge)


_STAGES = """s as (select row_id, post_id, country, language, text, row_id % 3 <> 0 as r1, row_id % 17 = 0 as lost, row_id % 3 <> 0 and row_id % 19 = 0 as unlabelled from x),
    a as (select *, r1 and row_id % 3 + 1 in (1, 2) and row_id % 4 + 1 in (1, 2) as ready from s where not lost and not unlabelled)"""


@query(
    f"""with {_X}, {_STAGES} select post_id, case when r1 then 'R1' else 'R0' end as relevance, case when r1 then concat('E', row_id % 3 + 1) end as experiencer, case when r1 then concat('C', row_id % 4 + 1) end as content_function,
    case when ready and row_id % 5 <> 0 then concat(post_id, '_u001') end as unit_id, case when ready and row_id % 5 <> 0 then case when row_id % 2 = 0 then 'accept' else 'reject' end end as verdict,
    array_to_string(list_filter(['relevance', case when r1 then 'labels' end, case when ready then 'extract' end, case when ready and row_id % 5 <> 0 then 'judge' end], lambda y: y is not null), ',') as stages from a"""
)
def annotated_posts(spark, d):
    """Posts after all stages: labels, the unit, its verdict and the stages they went through."""
    done, _ = _annotated(spark, d)
    first = F.get("units", F.lit(0))
    return done.select("post_id", F.col("relevance_label").alias("relevance"), F.col("experiencer_label").alias("experiencer"), "content_function", first["unit_id"].alias("unit_id"), first["judge_verdict"].alias("verdict"), F.array_join("stages", ",").alias("stages"))


@query(f"with {_X}, {_STAGES} select post_id, 'relevance' as stage, 'failed' as error from s where lost union all select post_id, 'labels', 'failed' from s where unlabelled and not lost")
def annotation_errors(spark, d):
    """Posts that a provider failed for, with the stage."""
    return _annotated(spark, d)[1].select("post_id", "stage", "error")


@query(
    f"""with {_X}, {_STAGES} select (select count(*) from s) as rows_attempted, (select count(*) from a) as rows_completed, (select count(*) from s where lost or unlabelled) as rows_failed, (select count(*) from s where lost or unlabelled) as stage_errors,
    (select count(*) from s where lost or unlabelled) as rows_with_stage_errors, (select count_if(row_id % 2 = 0) from a) as validation_ok, (select count_if(row_id % 2 <> 0) from a) as validation_failed"""
)
def run_counters(spark, d):
    """The counters of a run: what was attempted, completed, failed and valid."""
    done, errors = _annotated(spark, d)
    n = F.substring("post_id", 2, 20).cast("bigint")
    results = done.select("post_id", F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("issues"))
    counters = run_summary(extractions(spark, d), results, errors)
    names = ["rows_attempted", "rows_completed", "rows_failed", "stage_errors", "rows_with_stage_errors", "validation_ok", "validation_failed"]
    return counters.select(*[F.get_json_object("manifest", f"$.{c}").cast("bigint").alias(c) for c in names])


# ---------------------------------------------------------------- reranking
_RANKED = "c as (select row_id as qid, row_id * 31 + g as gid, 1.0 / g as score, cast(g as int) as rank, (row_id * 13 + g * 7) % 10 as m from source_posts, range(1, 9) t(g))"
_RERANKED = f"{_RANKED}, r as (select *, case when m = 0 then null when m = 1 then null else m / 10.0 end as second from c where rank <= 6), o as (select qid, gid, second, row_number() over (partition by qid order by second desc nulls last, rank, gid) as rank from r)"


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "source_posts").selectExpr("row_id as qid", "explode(sequence(1, 8)) as rank").selectExpr("qid", "qid * 31 + rank as gid", "1.0D / rank as score", "rank", "(qid * 13 + rank * 7) % 10 as m")
    scores = c.selectExpr("qid", "gid", "case when m = 0 then double('NaN') when m = 1 then null else m / 10.0D end as rerank_score")
    return c.drop("m"), scores


@query(f"with {_RERANKED} select qid, gid, cast(rank as int) as rank from o where rank <= 2")
def reranked(spark, d):
    """The two best of each query's six first candidates by a second score."""
    return retrieve.rerank(*_candidates(spark, d), k=2).select("qid", "gid", "rank")


@query(f"with {_RERANKED} select concat('q', qid) as post_id, cast(rank as int) as rank, case when score <> 1.0 then score end as score, concat('g', gid) as gold_post_id, 'JPN' as gold_country, '' as gold_experiencer_label from o join c using (qid, gid) where o.rank <= 2".replace("cast(rank", "cast(o.rank").replace("case when score", "case when c.score").replace("then score end", "then c.score end"))
def retrieval_trace(spark, d):
    """The trace of retrieved examples: their rank, finite score and the example's labels."""
    found = retrieve.rerank(*_candidates(spark, d), k=2).select("qid", "gid", F.when(F.col("score") == 1.0, float("inf")).otherwise(F.col("score")).alias("score"), "rank")
    gold = found.select("gid").distinct().select("gid", F.concat(F.lit("g"), "gid").alias("post_id"), F.lit("JPN").alias("country"), F.lit("ja").alias("language"), F.lit(None).cast("string").alias("experiencer_label"), F.lit("C1").alias("content_function"))
    queries = found.select("qid").distinct().select("qid", F.concat(F.lit("q"), "qid").alias("post_id"))
    return retrieve.trace_rows(found, queries, gold).select("post_id", "rank", "score", "gold_post_id", "gold_country", "gold_experiencer_label")
