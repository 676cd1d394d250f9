"""Several values packed in one string field: split into one row per value.

A parsing expression grammar with ordered choice. ``/`` tries its alternatives
left to right and the first that matches wins; a failed alternative consumes
nothing, so malformed quotes fall back to the next one.

    Field     <- WS (Wrapped / Bracketed / Torn / List)
    Wrapped   <- Quoted WS EOF, the unquoted text matching Bracketed
    Bracketed <- '[' (Element (',' Element)*)? ']' EOF
    Torn      <- '[' Element (',' Element)* EOF          flag unclosed_bracket
    Element   <- Quoted &(WS [,\\]]) / Raw
    List      <- (Sep / Item)* EOF
    Item      <- Quoted &(WS (Sep / EOF)) / Url / Tag / Bare
    Url       <- scheme '://' up to white space, '|' or a separator that is followed by
                 another item's URL, another separator or the end
    Tag       <- '#' up to Sep, '#', or white space before '#'
    Bare      <- up to Sep, or white space before '#' or a URL
    Quoted    <- '"' ('""' / '\\' any / [^"\\\\])* '"'  /  the same with "'"

A quote that opens a value but never closes makes Quoted fail; Bare then takes
the text and the value carries the flag ``unclosed_quote``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SEP = r"[,，;；|、\t\n\r]"
_WS = re.compile(r"[\s​﻿]*")
_SEPARATOR = re.compile(rf"[\s​﻿]*{_SEP}[\s​﻿]*|[\s​﻿]+")
_QUOTED = re.compile(r'"((?:""|\\.|[^"\\])*)"', re.S)
_QUOTED1 = re.compile(r"'((?:\\.|[^'\\])*)'", re.S)
_AFTER_ITEM = re.compile(rf"[\s​﻿]*(?:{_SEP}|$)")
_AFTER_ELEMENT = re.compile(r"\s*[,，\]]")
_ELEMENT_SEP = re.compile(r"\s*[,，]\s*")
_RAW = re.compile(r"[^,，\]]*")
_URL = re.compile(
    rf"[A-Za-z][A-Za-z0-9+.-]*://(?:(?!{_SEP}+\s*(?:[A-Za-z][A-Za-z0-9+.-]*://|[\"'#]|{_SEP}|$))[^\s|\"])+"
)
_TAG = re.compile(rf"[#＃](?:(?!\s+(?:[#＃]|[a-z]+://))[^#＃,，;；|、\t\n\r])*")
_BARE = re.compile(rf"(?:(?!\s+(?:[#＃]|[a-z]+://)){_SEP.replace('[', '[^', 1)})+")
_ESCAPE = re.compile(r'\\u([0-9a-fA-F]{4})|\\(.)|""', re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

Value = tuple[str, str | None]


def _unescape(body: str, doubled: bool) -> tuple[str, str | None]:
    """The text a quoted body stands for; flag ``bad_escape`` for a broken ``\\u``."""
    flag = None

    def one(m: re.Match) -> str:
        nonlocal flag
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            if m[2] == "u":
                flag = "bad_escape"
                return m[0]
            return _PLAIN.get(m[2], m[2])
        return '"' if doubled else '""'

    if "\\" in body or '""' in body:
        body = _ESCAPE.sub(one, body)
        if any("\ud800" <= c <= "\udfff" for c in body):
            body = body.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return body, flag


def _bracketed(s: str, at: int, torn: bool) -> list[Value] | None:
    """Bracketed, or Torn if ``torn``; None where the alternative doesn't match."""
    out: list[Value] = []
    n = len(s)
    at = _WS.match(s, at + 1).end()
    if s[at : at + 1] == "]":
        return out if _WS.match(s, at + 1).end() == n else None
    while True:
        c = s[at : at + 1]
        m = _QUOTED.match(s, at) if c == '"' else _QUOTED1.match(s, at) if c == "'" else None
        if m and (_AFTER_ELEMENT.match(s, m.end()) or (torn and _WS.match(s, m.end()).end() == n)):
            out.append(_unescape(m[1], False))
        else:
            m = _RAW.match(s, at)
            raw = m[0].strip()
            if raw[:1] in ('"', "'") and raw:
                if not torn:
                    return None
                out.append((raw[1:], "unclosed_quote"))
            elif raw not in ("null", "None"):
                out.append((raw, None))
        at = m.end()
        sep = _ELEMENT_SEP.match(s, at)
        if sep:
            at = sep.end()
            continue
        at = _WS.match(s, at).end()
        if s[at : at + 1] == "]" and _WS.match(s, at + 1).end() == n:
            return out
        if torn and at >= n:
            return [(v, f or "unclosed_bracket") for v, f in out]
        return None


def _list(s: str, at: int) -> list[Value]:
    """List; it matches every text."""
    out: list[Value] = []
    n = len(s)
    while at < n:
        m = _SEPARATOR.match(s, at)
        if m:
            at = m.end()
            continue
        c, flag = s[at], None
        if c in "\"'":
            m = (_QUOTED if c == '"' else _QUOTED1).match(s, at)
            if m and _AFTER_ITEM.match(s, m.end()):
                out.append(_unescape(m[1], True))
                at = m.end()
                continue
            if not m and c == '"':
                flag, at = "unclosed_quote", at + 1
        m = _TAG.match(s, at) or _URL.match(s, at) or _BARE.match(s, at)
        if not m or m.end() == at:
            at += 1
            continue
        out.append((m[0], flag))
        at = m.end()
    return out


def parse_packed(s: str | None) -> list[Value]:
    """All values of one field, in order, with their flag; blanks are not dropped here.

    null gives no value. The work is linear in the length for well-formed input; each
    alternative reads the text once, so a malformed one is read at most four times.
    """
    if not s:
        return []
    at = _WS.match(s).end()
    c = s[at : at + 1]
    if c == '"':
        m = _QUOTED.match(s, at)
        if m and _WS.match(s, m.end()).end() == len(s):
            inner, flag = _unescape(m[1], True)
            head = _WS.match(inner).end()
            if inner[head : head + 1] == "[":
                got = _bracketed(inner, head, False)
                if got is not None:
                    return got
            return [(inner, flag)]
    elif c == "[":
        got = _bracketed(s, at, False)
        if got is None:
            got = _bracketed(s, at, True)
        if got is not None:
            return got
    return _list(s, at)


_EDGE = " \t\n\r\f\v ​　﻿   "


def unpack_values(s: str | None, strip_hash: bool) -> list[Value]:
    """Values as delivered: trimmed, without leading ``#`` if asked, blanks dropped."""
    out = []
    for v, flag in parse_packed(s):
        v = v.strip(_EDGE)
        if strip_hash:
            v = v.lstrip("#＃").strip(_EDGE)
        if v:
            out.append((v, flag))
    return out


def unpack_fields(df: DataFrame, key: str, fields: Sequence[str], tags: Sequence[str] = (), flags: bool = False) -> DataFrame:
    """One row per value of each packed field: (key, field, pos, value[, error]).

    ``tags`` names the fields whose values lose a leading ``#``. pos counts from 1 over the
    values that remain. error is null for well-formed values.

    Defined results: null, empty and blank fields, and fields with separators only, give no
    row; repeated values and repeated rows are kept; a null key stays null; an empty table
    gives an empty result; other columns of ``df`` are ignored, whatever their names, since
    only key and fields are read. Values are parsed whole, whatever their length.

    Narrow: one pass over the scan, no shuffle.
    """
    fields = list(fields)
    strip = [f in tags for f in fields]
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())]
        + ([T.StructField("error", T.StringType())] if flags else [])
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take: list[int] = []
            names: list[str] = []
            pos: list[int] = []
            values: list[str] = []
            errors: list[str | None] = []
            for k, f in enumerate(fields):
                for row, s in enumerate(b.column(k + 1).to_pylist()):
                    if not s:
                        continue
                    for p, (v, flag) in enumerate(unpack_values(s, strip[k]), 1):
                        take.append(row)
                        names.append(f)
                        pos.append(p)
                        values.append(v)
                        errors.append(flag)
            cols = [b.column(0).take(pa.array(take, pa.int64())), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(errors, pa.string())] if flags else []), names=schema.names)

    return df.select(key, *fields).mapInArrow(split, schema)
