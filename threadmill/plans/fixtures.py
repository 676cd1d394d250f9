"""Queries over small literal cases: readers of model output, page state and configuration.

What they read isn't in the tables, so each case stands here with the result it must have;
the oracle is that list.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import repair
from threadmill.sources import config

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(v: object) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def cases(columns: str, rows: list[tuple]):
    """Register a query over ``rows``: (text, results...); columns are those of the results."""

    def add(f):
        names = columns.split()

        def run(spark: SparkSession, d: str) -> DataFrame:
            df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, text string")
            return df.select("id", *f(F.col("text")))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        values = ", ".join(f"({', '.join(map(_sql, (i, *r[1:])))})" for i, r in enumerate(rows))
        ORACLE_SQL[f.__name__] = f"select * from (values {values}) t(id, {', '.join(names)})"
        return f

    return add


_UNIT = {"domain": "d", "evidence_span_original": "疼{", "surface_text_working": "s", "normalized_concept_en": "c", "concept_status": "unmapped", "support_type": "explicit", "assertion": "present", "confidence": 0.5}
_U = json.dumps(_UNIT, ensure_ascii=False)


@cases("rest", [("<think>a {b} </think>{\"x\": 1}", '{"x": 1}'), ("  <THINK>never closed {\"x\": 2}", '{"x": 2}'), ("<think>no json", ""), ("plain", "plain"), ("a<think>b</think>c<think>d", "ac<think>d"), (None, None)])
def thinking_stripped(text):
    """Model output without its think blocks."""
    return [repair.without_thinking(text).alias("rest")]


@cases("objects", [('x {"a": {"b": "}"}} y {"c": 1}', '{"a": {"b": "}"}} | {"b": "}"} | {"c": 1}'), ('{"a": [{"b": 1}, {"c": 2}', '{"b": 1} | {"c": 2}'), ('he said "{" and {"a": 1}', ""), ("none", ""), (None, "")])
def objects_found(text):
    """Every JSON object in a text, nested ones and those inside a broken one as well."""
    return [F.array_join(repair.json_objects(text), " | ").alias("objects")]


@cases("status n", [('{"units": [' + _U + "]}", "ok", 1), ('{"units": [' + _U + ", " + _U + ', {"domain": "d", "evid', "recovered", 2), ('{"units": [{"domain": }]}', "malformed", None), ('{"units": [' + _U + ', {"domain": }]}', "recovered", 1), ("no object", "none", None), ('{"other": 1}', "ok", 0), (None, "none", None)])
def units_recovered(text):
    """Units of complete and of broken output."""
    r = repair.parse_units(text)
    return [r["status"].alias("status"), F.json_array_length(r["units"]).alias("n")]


_LABELS = repair.parse_labels(["experiencer", "function"])


@cases("status experiencer function", [('{"experiencer": "E1", "function": "C2"}', "ok", "E1", "C2"), ('<think>"experiencer": "E3"</think> "experiencer" : "E1", "function": "C1"', "recovered", "E3", "C1"), ('{"experiencer": "E2"', "missing", "E2", None), ("", "missing", None, None), (None, "missing", None, None)])
def labels_recovered(text):
    """Labels of complete output, else the first value of each key."""
    r = _LABELS(text)
    return [r["status"].alias("status"), r["experiencer"].alias("experiencer"), r["function"].alias("function")]


_GAP = "x" * 1300


@cases("verdicts", [
    ('{"unit_verdicts": [{"unit_id": "a", "judge_verdict": "accept"}, {"unit_id": "b", "judge_verdict": "odd"}]}', "a=accept,b=odd"),
    ('{"unit_verdicts": [{"unit_id": "a", "judge_verdict": "accept"}, {"unit_id": "b", "judge_verdict": "odd", "judge_verdict": "reject"}, }', "a=accept,b=reject"),
    ('{"unit_id": "a", "unit_id": "b", "judge_verdict": "revise", }', "b=revise"),
    ('{"unit_id": "a", "note": "' + _GAP + '", "judge_verdict": "accept", }', ""),
    ('{"unit_id": "a", "note": "' + _GAP + '", "judge_verdict": "accept", "unit_id": "b", }', "a=accept"),
    ("nothing", ""), (None, ""),
])
def verdicts_recovered(text):
    """Verdicts of complete and of broken output."""
    return [F.array_join(F.transform(repair.parse_verdicts(text), lambda x: F.concat(x["unit_id"], F.lit("="), x["judge_verdict"])), ",").alias("verdicts")]


@cases("title", [
    ('<script>window.__INITIAL_STATE__={"title":"a}b","x":undefined,"s":"undefined"}</script>', "a}b"),
    ('<script>window.__INITIAL_STATE__ = {"title":"q\\"{"};</script>{"title":"no"}', 'q"{'),
    ('window.__INITIAL_STATE__={"title":', None), ("<html></html>", None), (None, None),
])
def page_states(text):
    """The state embedded in a page."""
    return [F.get_json_object(repair.parse_state(text), "$.title").alias("title")]


@cases("status action", [('```json\n{"action": "SCROLL"}\n```', "ok", "SCROLL"), ('{"action": "DANCE"}', "ok", "STOP"), ('{"params": {}}', "ok", "STOP"), ("go on", "malformed", "STOP"), ("[1]", "malformed", "STOP"), (None, "malformed", "STOP")])
def actions_read(text):
    """Decisions in a code fence or not; what isn't known is STOP."""
    r = repair.parse_action(text)
    return [r["status"].alias("status"), r["action"].alias("action")]


# ---------------------------------------------------------------- configuration
_STACK = {
    "model_stack": {"relevance": {"model_id": "org/a", "backend": "causal"}, "embedder": {"model_id": "b", "quantization": "8bit"}, "reranker": {"model_id": "org/c", "backend": "cross"}},
    "runtime": {"default_rag_k": 5, "use_reranker": False, "other": 1},
    "paths": {"rag_gold": "gold.json"},
}


def active_models(spark: SparkSession, d: str) -> DataFrame:
    """The roles of a model stack with their state and where their files are looked for."""
    stack = config.model_stack(_STACK)
    rows = [(s.role, s.model_id, s.role in stack.active(), str(s.local_path("models"))) for s in stack.specs.values()]
    return spark.createDataFrame(rows, "role string, model_id string, active boolean, path string")


def settings_checked(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with some settings, checked against their rules."""
    given = [{}, {"scheduler": {"daily_count": 0}}, {"scheduler": {"time_windows": ["9-11"]}}, {"scheduler": {"time_windows": ["11:00-09:00"]}}, {"collection": {"detail_scroll_chance": 2}}, {"scheduler": {"keywords": [], "random_skip_chance": -1}}]
    rows = [(i, ",".join(config.setting_problems(config.merged(config.DEFAULTS, x)))) for i, x in enumerate(given)]
    return spark.createDataFrame(rows, "id int, problems string")


QUERIES |= {"active_models": active_models, "settings_checked": settings_checked}
ORACLE_SQL |= {
    "active_models": "select * from (values ('relevance', 'org/a', true, 'models/org/a'), ('embedder', 'b', true, 'models/b'), ('reranker', 'org/c', false, 'models/org/c')) t(role, model_id, active, path)",
    "settings_checked": "select * from (values (0, ''), (1, 'scheduler.daily_count'), (2, 'scheduler.time_windows'), (3, 'scheduler.time_windows'), (4, 'collection.detail_scroll_chance'), (5, 'scheduler.keywords,scheduler.random_skip_chance')) t(id, problems)",
}
