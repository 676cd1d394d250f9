"""Staged annotation of a corpus with pluggable providers.

A provider is a function DataFrame -> DataFrame keyed by post_id, such as a mapInPandas
that loads its model once a partition. Each stage filters first, so an expensive provider
sees only the rows that reached it, and writes its result to the shared checkpoint folder
before the next stage, so no provider runs twice for a row. A provider may return an
``error`` column; such rows keep the state of the stage before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.operators.units import apply_verdicts, assign_unit_ids, candidate, unit_issues
from threadmill.session import cut

Provider = Callable[[DataFrame], DataFrame]
_UNITS = f"array<{schema.UNIT.simpleString()}>"


def _errors(out: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(rows that succeeded, (post_id, stage, error) of those that did not)."""
    if "error" not in out.columns:
        return out, out.select("post_id", F.lit(stage).alias("stage"), F.lit("").alias("error")).limit(0)
    return out.where("error is null").drop("error"), out.where("error is not null").select("post_id", F.lit(stage).alias("stage"), "error")


def annotate(posts: DataFrame, relevance: Provider, labels: Provider, extract: Provider, judge: Provider, retrieve: Provider | None = None, proxies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(extractions with issues and stages, errors) of posts with one row per post_id.

    relevance gives (post_id, relevance_label); labels, for relevant posts, (post_id,
    experiencer_label, content_function); retrieve, for candidates, (post_id, examples),
    which extract then sees as a column; extract gives (post_id, units); judge, for posts
    with units, (post_id, seq, unit_id, judge_verdict). Only units are taken from extract,
    so a wrong id or label in its output can't leak. Units are unjudged after extraction:
    what a judge doesn't name needs human review.
    """
    base = posts.select([c for c in posts.columns if c in schema.POST.fieldNames()])
    got, failed = _errors(cut(relevance(base)), "relevance")
    state = base.join(got.select("post_id", "relevance_label"), "post_id")
    got, bad = _errors(cut(labels(state.where("relevance_label = 'R1'"))), "labels")
    failed = failed.union(bad)
    named = got.select("post_id", "experiencer_label", "content_function")
    state = cut(state.join(bad.select("post_id"), "post_id", "left_anti").join(named, "post_id", "left"))
    ready = state.where(candidate("E1") | candidate("E2") if proxies else candidate("E1"))
    if retrieve:
        ready = ready.join(cut(retrieve(ready)).select("post_id", "examples"), "post_id", "left")
    got, bad = _errors(cut(extract(ready)), "extract")
    failed = failed.union(bad)
    fresh = F.transform(F.col("units").cast(_UNITS), lambda u: u.withField("judge_verdict", F.lit("needs_human_review")))
    extracted = state.join(got.select("post_id", fresh.alias("units")), "post_id", "left").withColumn("units", F.coalesce("units", F.array().cast(_UNITS)))
    extracted = cut(assign_unit_ids(extracted))
    got, bad = _errors(cut(judge(extracted.where(F.size("units") > 0))), "judge")
    failed = failed.union(bad)
    done = apply_verdicts(extracted, got)
    stages = F.array_compact(F.array(F.lit("relevance"), F.when(F.col("relevance_label") == "R1", F.lit("labels")), F.when(candidate("E1") | (candidate("E2") & F.lit(proxies)), F.lit("extract")), F.when(F.size("units") > 0, F.lit("judge"))))
    done = cut(done.withColumn("stages", stages))
    for c in schema.POST.fieldNames():
        if c not in done.columns:
            done = done.withColumn(c, F.lit(None).cast(schema.POST[c].dataType))
    return done.join(unit_issues(done), "post_id"), failed
