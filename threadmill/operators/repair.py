"""Strict and recovering readers of model output, and of state embedded in pages.

Strict JSON (nothing may follow the value) and balanced braces aren't expressible in SQL
built-ins, so these run in Arrow batches; each returns a status with the value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that make an object a unit, and the legal verdicts.
UNIT_KEYS = {"domain", "evidence_span_original", "surface_text_working", "normalized_concept_en", "concept_status", "support_type", "assertion", "confidence"}
VERDICTS = ["accept", "revise", "reject", "needs_human_review"]
_WINDOW = 1200

_TAG = re.compile(r"<(/?)think>", re.I)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)
_FIELD = re.compile(r'"([^"]+)"\s*:\s*"([^"]+)"')


def strip_thinking(text: str) -> str:
    """The text without closed think blocks and without an unclosed one before the JSON."""
    kept, at, since = [], 0, None
    for tag in _TAG.finditer(text):
        if not tag[1] and since is None:
            kept.append(text[at : tag.start()])
            since = tag.start()
        elif tag[1] and since is not None:
            at, since = tag.end(), None
    rest = text[at:] if since is None else text[since:]
    if since is not None and not "".join(kept).strip():
        begins = [k for k in (rest.find("{"), rest.find("[")) if k >= 0]
        rest = rest[min(begins) :] if begins else ""
    return "".join([*kept, rest]).strip()


def braces(text: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """(begin, end) of every balanced {...}, inner ones first, from one pass over the text.

    Inside an object strings are passed over as a whole, so their braces don't count;
    between objects quotes mean nothing.
    """
    open_: list[int] = []
    at = start
    while True:
        if not open_:
            at = text.find("{", at)
            if at < 0:
                return
            open_.append(at)
            at += 1
            continue
        token = _TOKEN.search(text, at)
        if token is None:
            return
        at = token.end()
        if token[0] == "{":
            open_.append(token.start())
        elif token[0] == "}":
            yield open_.pop(), at


def _load(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def read_object(text: str) -> tuple[str, object]:
    """('ok', value), ('malformed', None) for a broken {...}, ('none', None) without one."""
    text = strip_thinking(text)
    first, last = text.find("{"), text.rfind("}")
    for part in (text, text[first : last + 1] if 0 <= first < last else ""):
        done, value = _load(part)
        if done:
            return "ok", value
    return ("malformed" if 0 <= first < last else "none"), None


def objects_in(text: str) -> list[dict]:
    """Every JSON object in a text in the order they begin, nested ones as well."""
    read = [(begin, _load(text[begin:end])) for begin, end in braces(text)]
    return [value for _, (done, value) in sorted(read, key=lambda x: x[0]) if done]


def read_units(text: str | None) -> tuple[str, str | None]:
    """(status, units as JSON): ok, recovered from a broken text, malformed, or none."""
    status, value = read_object(text or "")
    if status == "ok":
        return "ok", json.dumps(value.get("units", []) if isinstance(value, dict) else [], ensure_ascii=False)
    if status == "malformed":
        units = [o for o in objects_in(strip_thinking(text)) if UNIT_KEYS <= o.keys()]
        if units:
            return "recovered", json.dumps(units, ensure_ascii=False)
    return status, None


def fields_in(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, key, value) of everything that looks like a key with a string, in order."""
    return [(m.start(), m.end(), m[1], m[2]) for m in _FIELD.finditer(text)]


def read_labels(text: str | None, keys: list[str]) -> tuple[str, dict[str, str]]:
    """Labels of a complete object, else the first value of each key; 'missing' if one is absent."""
    status, value = read_object(text or "")
    if status != "ok" or not isinstance(value, dict):
        status, value = "recovered", {}
        for _, _, key, label in fields_in(text or ""):
            value.setdefault(key, label)
    return ("missing" if set(keys) - value.keys() else status), {k: str(value[k]) for k in keys if k in value}


def read_verdicts(text: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(unit_id, verdict) pairs; from a broken text, the first legal verdict after each id.

    An id's verdict stands before the next id; behind the last, within a fixed distance.
    """
    status, value = read_object(text or "")
    if status == "ok":
        rows = value.get("unit_verdicts", []) if isinstance(value, dict) else []
        return "ok", [(str(r.get("unit_id", "")), str(r.get("judge_verdict", ""))) for r in rows if isinstance(r, dict)]
    if status != "malformed":
        return status, []
    found: list[tuple[str, str]] = []
    unit, since, done = "", 0, True
    fields = fields_in(text)
    last = max((begin for begin, _, key, _ in fields if key == "unit_id"), default=-1)
    for begin, end, key, value in fields:
        if key == "unit_id":
            unit, since, done = value, begin, False
        elif key == "judge_verdict" and value in VERDICTS and not done and (since != last or end <= since + _WINDOW):
            found.append((unit, value))
            done = True
    return ("recovered", found) if found else (status, [])


def balanced_object(html: str, marker: str) -> str | None:
    """The first balanced {...} after a marker; braces inside strings don't count."""
    at = html.find(marker)
    start = html.find("{", at) if at >= 0 else -1
    return next((html[begin:end] for begin, end in (braces(html, start) if start >= 0 else ()) if begin == start), None)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def undefined_to_null(text: str) -> str:
    """`undefined` as a value becomes null, except inside strings."""
    out, at = [], 0
    for m in _STRING.finditer(text):
        out += [re.sub(r"\bundefined\b", "null", text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, re.sub(r"\bundefined\b", "null", text[at:])])


# What a browsing decision may ask for.
ACTIONS = ["SEARCH", "SCROLL", "OPEN_NOTE", "STOP"]


def read_action(text: str | None) -> tuple[str, str]:
    """(status, action) of a decision, in a code fence or not; unknown actions are STOP."""
    text = (text or "").strip()
    if text.startswith("```"):
        text = text.partition("\n")[2] or text
        text = text.rpartition("```")[0].strip() if "```" in text else text.strip()
    done, value = _load(text)
    if not done or not isinstance(value, dict):
        return "malformed", "STOP"
    action = value.get("action", "STOP")
    return "ok", action if action in ACTIONS else "STOP"


def page_state(html: str | None, marker: str = "window.__INITIAL_STATE__") -> str | None:
    """The state object embedded in a page, as strict JSON text; None where none can be read."""
    raw = balanced_object(html or "", marker)
    for candidate in (raw, undefined_to_null(raw)) if raw else ():
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("units", T.StringType())]))
def parse_units(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_units(x) for x in texts], columns=["status", "units"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("judge_verdict", T.StringType())])))
def parse_verdicts(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"unit_id": a, "judge_verdict": b} for a, b in read_verdicts(x)[1]] for x in texts])


@F.pandas_udf(T.StringType())
def parse_state(html: pd.Series) -> pd.Series:
    return pd.Series([page_state(x) for x in html], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts: pd.Series) -> pd.Series:
    return pd.Series([[json.dumps(o, ensure_ascii=False) for o in objects_in(x or "")] for x in texts])


def parse_labels(keys: list[str]):
    """A column function: struct(status, one field for each of ``keys``)."""

    @F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), *[T.StructField(k, T.StringType()) for k in keys]]))
    def parse(texts: pd.Series) -> pd.DataFrame:
        read = [read_labels(x, keys) for x in texts]
        return pd.DataFrame([[s, *[v.get(k) for k in keys]] for s, v in read], columns=["status", *keys])

    return parse


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("action", T.StringType())]))
def parse_action(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_action(x) for x in texts], columns=["status", "action"])


@F.pandas_udf(T.StringType())
def without_thinking(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else strip_thinking(x))
