"""Narrative units: acceptance, flattening, identifiers, summaries and constraint checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.functions.text import combined_text, filled, joined, strip


def accepted(u: Column) -> Column:
    """A unit counts where its verdict accepts it and it is neither unsupported nor negated."""
    return F.coalesce((u["judge_verdict"] == "accept") & (u["support_type"] != "unsupported") & (u["assertion"] != "negated"), F.lit(False))


def accepted_units() -> Column:
    return F.filter("units", accepted)


def domain_labels() -> list[Column]:
    """One 0/1 column per domain, from the accepted units."""
    touched = F.transform(accepted_units(), lambda u: u["domain"])
    return [F.coalesce(F.array_contains(touched, d), F.lit(False)).cast("int").alias(d.lower().replace(" ", "_")) for d in schema.DOMAINS]


def candidate(experiencer: str) -> Column:
    """Relevant posts of an experiencer that tell or ask: null labels are false."""
    return F.coalesce((F.col("relevance_label") == "R1") & (F.col("experiencer_label") == experiencer) & F.col("content_function").isin("C1", "C2"), F.lit(False))


def assign_unit_ids(df: DataFrame) -> DataFrame:
    """Fill blank unit ids with {post}_u{nnn}: counted in array order, names in use are skipped."""
    blank = lambda u: F.coalesce(strip(u["unit_id"]), F.lit("")) == ""
    name = lambda n: F.format_string("%s_u%03d", F.col("post_id"), n)
    taken = F.transform(F.filter("units", lambda u: ~blank(u)), lambda u: u["unit_id"])
    free = F.filter(F.transform(F.sequence(F.lit(1), F.size("units") * 2 + 1), name), lambda x: ~F.array_contains(F.col("__taken"), x))
    nth = lambda i: F.size(F.filter(F.slice("units", 1, i + 1), blank))
    fixed = F.transform("units", lambda u, i: F.when(blank(u), u.withField("unit_id", F.element_at("__free", nth(i)))).otherwise(u))
    return df.withColumn("__taken", taken).withColumn("__free", free).withColumn("units", fixed).drop("__taken", "__free")


_UNIT_COLUMNS = [f.name for f in schema.UNIT.fields]


def flatten_units(df: DataFrame, accepted_only: bool = True) -> DataFrame:
    """One row per unit with its post's labels; null labels become ''."""
    rows = df.select("post_id", "country", "language", *[F.coalesce(c, F.lit("")).alias(c) for c in ("relevance_label", "experiencer_label", "content_function")], F.posexplode("units").alias("unit_pos", "u"))
    if accepted_only:
        rows = rows.where(accepted(F.col("u")))
    return rows.select("post_id", "country", "language", "relevance_label", "experiencer_label", "content_function", "unit_pos", *[F.col(f"u.{c}").alias(c) for c in _UNIT_COLUMNS])


def _text() -> Column:
    return F.coalesce(combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text")), F.lit(""))


def _span(u: Column) -> Column:
    return F.coalesce(strip(u["evidence_span_original"]), F.lit(""))


def _code(broken: Column, code: str) -> Column:
    """The code where a constraint is broken; one that can't be decided is broken."""
    return F.when(F.coalesce(broken, F.lit(True)), F.lit(code))


def _codes(row: list[Column], per_unit: Callable[[Column], Column]) -> Column:
    found = F.coalesce(F.flatten(F.transform("units", per_unit)), F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(*row), found))


def schema_codes() -> Column:
    """Codes of what the row type itself forbids: closed value sets, required values,
    confidence outside [0, 1], concepts missing, unit ids repeated."""
    ids = F.filter(F.transform("units", lambda u: filled(strip(u["unit_id"]))), lambda x: x.isNotNull())
    known = {"concept_status": schema.CONCEPT_STATUS, "support_type": schema.SUPPORT_TYPES, "assertion": schema.ASSERTIONS, "judge_verdict": schema.VERDICTS}
    row = [
        _code(filled(strip(F.col("post_id"))).isNull(), "missing_post_id"),
        _code(~F.col("country").isin(schema.COUNTRIES), "unknown_country"),
        _code(~F.col("language").isin(schema.LANGUAGES), "unknown_language"),
        _code(_text() == "", "missing_text"),
        F.when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated_unit_id"),
    ]
    return _codes(
        row,
        lambda u: F.array(
            _code(~u["confidence"].between(0, 1), "confidence_out_of_range"),
            _code((u["concept_status"] != "unmapped") & (F.coalesce(strip(u["normalized_concept_en"]), F.lit("")) == ""), "missing_concept"),
            *[_code(~u[c].isin(v), f"unknown_{c}") for c, v in known.items()],
        ),
    )


def hierarchy_codes(text: Column, *first: Column) -> Column:
    """Codes of labels and units that don't fit each other or the text, behind those of ``first``.

    An evidence span must stand in ``text`` letter by letter. Codes come in the order of
    the checks and as often as they are broken.
    """
    has_units = F.coalesce(F.size("units"), F.lit(0)) > 0
    label = F.col("relevance_label")
    no = F.coalesce(label.isin("R0", "RU"), F.lit(False))
    r1 = F.coalesce(label == "R1", F.lit(False))
    row = [
        *first,
        _code(label.isNull(), "missing_relevance"),
        _code(no & F.col("experiencer_label").isNotNull(), "downstream_after_non_r1"),
        _code(no & F.col("content_function").isNotNull(), "downstream_after_non_r1"),
        _code(no & has_units, "units_after_non_r1"),
        _code(r1 & F.col("experiencer_label").isNull(), "missing_experiencer"),
        _code(r1 & F.col("content_function").isNull(), "missing_content_function"),
        _code(has_units & ~(candidate("E1") | candidate("E2")), "units_for_ineligible_row"),
    ]
    return _codes(
        row,
        lambda u: F.array(
            _code(~u["domain"].isin(schema.DOMAINS), "invalid_csm_domain"),
            F.when(_span(u) == "", "missing_evidence_span").when(~F.contains(text, _span(u)), "evidence_span_not_found"),
        ),
    )


def unit_issues(df: DataFrame) -> DataFrame:
    """(post_id, issues): every broken constraint of an extraction row, as codes.

    Those of schema_codes, then those of hierarchy_codes against the row's own text. A row
    without issues has an empty array.
    """
    return df.select("post_id", F.concat(schema_codes(), hierarchy_codes(_text())).alias("issues"))


def missing_spans(text: Column) -> Column:
    """All evidence spans that don't stand in a text, in array order; null spans are ''."""
    spans = F.transform("units", lambda u: F.coalesce(u["evidence_span_original"], F.lit("")))
    return F.filter(spans, lambda x: ~F.contains(F.coalesce(text, F.lit("")), x))


def validate_against_posts(results: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """(key, issues, missing, first_error) of every result, checked against its source post.

    Both sides are joined on ``key``, posts with one row for each. issues are the codes of
    a mismatch of id, country and language followed by hierarchy_codes against the post's
    text; missing are the spans that don't stand in it; first_error is what a check that
    stops at the first failure says: a mismatched field, 'spans' or ''. A result without
    post mismatches in all three and has no text.
    """
    about = ["post_id", "country", "language"]
    source = posts.select(key, *[F.col(c).alias(f"__{c}") for c in about], _text().alias("__text"))
    joined = results.join(source, key, "left")
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"__{c}")) | F.col(f"__{c}").isNull() for c in about}
    text = F.coalesce("__text", F.lit(""))
    first = F.coalesce(*[F.when(x, F.lit(c)) for c, x in differs.items()], F.when(F.size(missing_spans(text)) > 0, "spans"), F.lit(""))
    return joined.select(key, hierarchy_codes(text, *[_code(x, f"{c}_mismatch") for c, x in differs.items()]).alias("issues"), missing_spans(text).alias("missing"), first.alias("first_error"))


def read_payload(payload: Column) -> Column:
    """A result from the JSON text of a payload; null where it isn't an object.

    Fields may come under their older names; of several the current name counts.
    """
    units = F.from_json(F.get_json_object(payload, "$.units"), "array<string>")
    at = lambda raw, c: F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in schema.UNIT_ALIASES.get(c, schema.POST_ALIASES.get(c, [c]))])
    value = lambda raw, f: at(raw, f.name).try_cast(f.dataType).alias(f.name)
    unit = lambda raw: F.struct(*[value(raw, f) for f in schema.UNIT.fields])
    plain = [f for f in schema.EXTRACTION.fields if f.name not in ("units", "country_length_tertile_cutpoints")]
    result = F.struct(*[value(payload, f) for f in plain], F.coalesce(F.transform(units, unit), F.array().cast(f"array<{schema.UNIT.simpleString()}>")).alias("units"))
    return F.when(F.json_object_keys(payload).isNotNull(), result)


def validate_payloads(df: DataFrame, key: str, payload: str, posts: DataFrame) -> DataFrame:
    """(key, issues): a raw payload's codes; one that breaks the row type is a 'schema_error' alone."""
    read = df.select(key, read_payload(F.col(payload)).alias("r"))
    broken = read.where("r is null").select(key, F.array(F.lit("schema_error")).alias("issues"))
    rows = read.where("r is not null").select(key, "r.*")
    known = {"domain": schema.DOMAINS, "temporality": schema.TEMPORALITIES, "sentiment_or_outcome": schema.OUTCOMES}
    untyped = lambda u: F.coalesce(reduce(lambda a, b: a | b, [~u[c].isin(v) for c, v in known.items()], _span(u) == ""), F.lit(True))
    unknown = [F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in {"relevance_label": schema.RELEVANCE, "experiencer_label": schema.EXPERIENCERS, "content_function": schema.FUNCTIONS}.items()]
    odd = F.when(F.exists("units", untyped) | reduce(lambda a, b: a | b, unknown), F.array(F.lit("unknown_value"))).otherwise(F.array().cast("array<string>"))
    by_type = rows.select(key, F.concat(schema_codes(), odd).alias("__codes"))
    checked = validate_against_posts(rows, posts, key).join(by_type, key)
    return broken.union(checked.select(key, F.when(F.size("__codes") > 0, F.array(F.lit("schema_error"))).otherwise(F.col("issues"))))


def empty_results(posts: DataFrame) -> DataFrame:
    """A result without labels and units for every post."""
    labels = [F.lit(None).cast("string").alias(c) for c in ("relevance_label", "experiencer_label", "content_function")]
    return posts.select(*posts.columns, *labels, F.array().cast(f"array<{schema.UNIT.simpleString()}>").alias("units"))


def seed_readiness(df: DataFrame, min_primary: int = 1, min_proxy: int = 0) -> DataFrame:
    """One row (n_primary, n_proxy, n_bad_spans, ready): whether a result table can seed retrieval.

    It needs so many primary and proxy candidates, and no evidence span of these that
    doesn't stand in its own text.
    """
    both = candidate("E1") | candidate("E2")
    bad = F.sum(F.when(both, F.size(missing_spans(_text()))).otherwise(0))
    counts = df.agg(F.count_if(candidate("E1")).alias("n_primary"), F.count_if(candidate("E2")).alias("n_proxy"), F.coalesce(bad, F.lit(0)).alias("n_bad_spans"))
    return counts.withColumn("ready", (F.col("n_primary") >= min_primary) & (F.col("n_proxy") >= min_proxy) & (F.col("n_bad_spans") == 0))


def require_seed(df: DataFrame, min_primary: int = 1, min_proxy: int = 0) -> DataFrame:
    """df, or a ValueError that says why it can't seed retrieval."""
    r = seed_readiness(df, min_primary, min_proxy).first()
    if not r["ready"]:
        raise ValueError(f"Not ready to seed retrieval: {r['n_primary']} primary (needs {min_primary}), {r['n_proxy']} proxy (needs {min_proxy}), {r['n_bad_spans']} ungrounded spans")
    return df


def judge_payload() -> Column:
    """The units of a row as a judge sees them, as JSON."""
    keep = ["unit_id", "domain", "evidence_span_original", "surface_text_working", "normalized_concept_en", "support_type", "assertion", "temporality", "sentiment_or_outcome"]
    return F.to_json(F.transform("units", lambda u: F.struct(*[F.coalesce(u[c], F.lit("")).alias(c) for c in keep])))


def post_payload() -> Column:
    """A post as a model sees it, as JSON."""
    keep = ["post_id", "country", "language", "platform", "original_title", "original_text", "text_clean", "analysis_text_en"]
    return F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keep]))


def example_payload() -> Column:
    """A labelled example as a model sees it: excerpts of 900, 500 and 300 characters, as JSON."""
    text = joined(F.col("original_title"), F.col("original_text"))
    part = lambda c, n, name: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(name)
    return F.to_json(F.struct("country", "language", part(text, 900, "source_excerpt"), "experiencer_label", "content_function", part(F.col("evidence_excerpt"), 500, "evidence_excerpt"), part(F.col("rationale"), 300, "rationale")))


def gold_summary(df: DataFrame) -> DataFrame:
    """(measure, value, n): totals and label histograms of an extraction table, one pass each."""
    text = combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))
    exact = F.filter("units", lambda u: F.contains(text, u["evidence_span_original"]))
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint")
    totals = df.agg(
        F.count("*").alias("posts"), size(F.col("units")).alias("units"), size(accepted_units()).alias("accepted_units"), size(exact).alias("span_exact_matches"), F.count_if(candidate("E1")).alias("primary_posts"), F.count_if(candidate("E2")).alias("proxy_posts")
    ).unpivot([], ["posts", "units", "accepted_units", "span_exact_matches", "primary_posts", "proxy_posts"], "measure", "n").select("measure", F.lit("").alias("value"), "n")
    label = lambda src, cols, at: src.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), at(c).alias("value")) for c in cols])))
    posts = label(df, ["country", "language", "relevance_label", "experiencer_label", "content_function"], F.col)
    units = label(df.select(F.explode("units").alias("u")), ["domain", "concept_status", "support_type", "assertion", "temporality", "sentiment_or_outcome", "judge_verdict"], lambda c: F.col(f"u.{c}"))
    taken = label(df.select(F.explode(accepted_units()).alias("u")), ["accepted_domain"], lambda c: F.col("u.domain"))
    hist = posts.union(units).union(taken).where("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))
    return totals.union(hist)


def apply_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Units with the verdicts (post_id, seq, unit_id, judge_verdict) a judge gave them.

    Unknown verdicts are ignored, of repeated ones the last by seq counts, units without
    one need human review.
    """
    last = verdicts.where(F.col("judge_verdict").isin(schema.VERDICTS)).groupBy("post_id", "unit_id").agg(F.max_by("judge_verdict", "seq").alias("v"))
    maps = last.groupBy("post_id").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "v"))).alias("__v"))
    verdict = lambda u: F.coalesce(F.try_element_at(F.col("__v"), u["unit_id"]), F.lit("needs_human_review"))
    return df.join(maps, "post_id", "left").withColumn("units", F.transform("units", lambda u: u.withField("judge_verdict", verdict(u)))).drop("__v")
