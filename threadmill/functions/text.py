"""Text expressions with the exact semantics the corpus tools rely on."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that counts as white space for Python's str.strip.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: Column) -> Column:
    """White space of any script removed from both ends (SQL's trim knows blanks only)."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_cell(c: Column) -> Column:
    """null becomes '', everything else its stripped text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def filled(c: Column) -> Column:
    """The value, or null where it is null or empty: for chains of alternatives."""
    return F.nullif(c, F.lit(""))


def joined(title: Column, text: Column) -> Column:
    """The non-empty of title and text, one a line, stripped."""
    return strip(F.concat_ws("\n", filled(strip(title)), filled(strip(text))))


def combined_text(text_clean: Column, title: Column, text: Column) -> Column:
    """text_clean if not blank, else title and text."""
    return F.coalesce(filled(strip(text_clean)), joined(title, text))


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text, in hex; null for ''."""
    return F.sha2(filled(text), 256)


def canonical_id(post_id: Column) -> Column:
    """A post id without padding and without its country or platform prefix."""
    return F.regexp_replace(strip(post_id), "^(CHI|JPN|KOR|XHS)_", "")


def words(c: Column) -> Column:
    """Word tokens, lower case: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def contains_any(c: Column, cues: Sequence[str]) -> Column:
    """Whether any cue occurs, as one alternation compiled once a task; false without cues."""
    return c.rlike("|".join(re.escape(x) for x in cues)) if cues else F.lit(False)


def cue_count(c: Column, cues: Sequence[str]) -> Column:
    """How many different cues occur."""
    return F.aggregate(F.array(*[F.lit(x) for x in cues]), F.lit(0), lambda n, x: n + F.contains(c, x).cast("int"))


def first_cue(c: Column, cues: Sequence[str]) -> Column:
    """The first cue of the list that occurs; null if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(x)), F.lit(x)) for x in cues]) if cues else F.lit(None).cast("string")


def occurrences(c: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(c) - F.length(F.translate(c, char, ""))


def marks(c: Column) -> Column:
    """Hashtags and mentions: what follows each # or @ up to space or the next one."""
    return F.regexp_extract_all(c, F.lit(rf"[#@]([^#@{SPACE}]+)"), F.lit(1))


def distinct_tags(c: Column) -> Column:
    """Hashtags of a '; '-joined or blank-separated field: no leading #, first of repeats, no blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(c, rf"[;；,，、|{SPACE}]+"), lambda x: F.regexp_replace(x, "^#+", "")), lambda x: x != ""))


def digits_as_count(c: Column) -> Column:
    """All digits of a text as one number, 0 where there are none."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def note_id_of(url: Column) -> Column:
    """The note id in a link: /explore/ or /search_result/, else /discovery/item/, else ''."""
    first = filled(F.regexp_extract(url, r"/(?:explore|search_result)/([0-9a-f]+)", 1))
    return F.coalesce(first, F.regexp_extract(url, r"/discovery/item/([0-9a-f]+)", 1))


def page_type(url: Column) -> Column:
    """note_detail, search_result, home or unknown."""
    return F.when(url.rlike("/explore/|/discovery/item/"), "note_detail").when(url.contains("/search_result"), "search_result").when(url.rlike(r"^https?://[^/]+/?(explore/?)?$"), "home").otherwise("unknown")


def long_prefix(c: Column, marker: str, least: int = 3) -> Column:
    """Whether a marker stands in a text behind at least ``least`` characters."""
    return F.coalesce(F.contains(c, F.lit(marker)) & (F.length(F.substring_index(c, marker, 1)) >= least), F.lit(False))
