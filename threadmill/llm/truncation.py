"""Text cut off by field limits: found from where word trigrams occur, in pure SQL.

A word is a run of Latin letters, a number (all numbers are one word), or a single
character of a script written without reliable spaces (Han, kana, Hangul). Every
position of a text shows the trigram that ends there and whether the sentence ends with
it or goes on. A text whose last trigram almost always goes on elsewhere, and almost
never ends a sentence, was cut. Trigrams too rare to judge fall back to their last two
words; a last word cut inside counts as every word it begins, after the same two words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import lookup
from threadmill.operators.timestamps import site_host
from threadmill.session import cut

# What platforms put where they cut, and marks that only decorate an end.
_MORE = ["全文", "展开", "展開", "查看全文", "阅读全文", "もっと見る", "続きを読む", "続きを見る", "더보기", "더 보기", "see more", "read more", "show more", "more"]
_ELLIPSES = ["…", "...", "⋯"]
_DECORATION = r"[\s\x{a0}\x{3000}\x{200b}\x{feff}~～」』】\"'*_]+"
_CLOSING = r"[)）」』\"'’”]*"
_STOPS = "[。！？!?.．｡]"
#: A broken character, a bracket or an entity that was opened and not closed.
_BROKEN = [r"\s*+\x{fffd}+", r"[^\]\[\n]{0,8}\[", r"(?:\d{0,5}#|[a-z]{1,6})&"]


def _backwards(words: list[str]) -> str:
    return "|".join(re.escape(w[::-1]).replace("\\ ", r"\s*+") for w in words)


# Ends are looked at from behind, in the reversed text, so that however much white space or
# decoration follows, the whole end is seen.
_PLATFORM = rf"(?i)^\s*+(?:{_backwards(_MORE)})\s*+(?:{_backwards(_ELLIPSES)})"
_BROKEN_END = f"(?i)^(?:{'|'.join(_BROKEN)})"

#: Words: Latin runs, the last digit of a number (or of a code of digits and letters), one
#: character of Han/kana/Hangul; and sentence ends. It runs over text in which _SAME has
#: made digits 0 and ends $.
_TOKEN = r"((?<![a-z0])[a-z]++(?:['’][a-z]++)?(?!0)|0(?=[a-z]*+(?!0))|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsHangul}]|\$|\.(?=[\s\p{Punct}]|$))"
_SAME = ("123456789。！？!?\n\r｡\u200b\ufeff", "0" * 9 + "$" * 8)

MIN_SEEN = 8
MAX_RATE = 0.1
#: Texts that begin with two "label: value" lines end their lines where prose goes on, so they are counted apart.
_LINES = r"^[^\n:：]{1,20}[:：][^\n]*\n[^\n:：]{1,20}[:：]"


def _words(text: Column) -> Column:
    """The words of a text behind two starts ^; every number is 0, a sentence end $ or a dot."""
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.regexp_extract_all(F.translate(F.lower(text), *_SAME), F.lit(_TOKEN), F.lit(1)))


def fields_of(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, kind, s): one row per non-blank field; kind is the field, with # for label-value lines."""
    rows = df.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in fields])))
    rows = rows.where("s is not null and trim(s) <> ''")
    return rows.select("id", "field", F.concat("field", F.when(F.col("s").rlike(_LINES), "#").otherwise("")).alias("kind"), "s")


def marked(rows: DataFrame) -> DataFrame:
    """(id, field, kind, s, mark, stem): what surrounds the end of each value.

    mark is 'cut' where the platform or a broken character says so, 'open' where the end
    shows neither a full stop nor anything like it, 'dots' for an ellipsis, else 'stop'.
    stem is the text without a platform's mark.
    """
    rows = rows.select("id", "field", "kind", "s", F.reverse("s").alias("r"))
    bare = F.regexp_replace("r", "^" + _DECORATION, "")
    sure = F.col("r").rlike(_PLATFORM) | F.col("r").rlike(_BROKEN_END)
    mark = F.when(sure, "cut").when(bare.rlike(r"^[….。⋯]*(?:…|⋯|\.\.)"), "dots").when(bare.rlike(f"^{_CLOSING}{_STOPS}"), "stop").otherwise("open")
    known = rows.select("id", "field", "kind", "s", "r", mark.alias("mark"))
    stem = F.when(F.col("mark") == "cut", F.reverse(F.regexp_replace(F.regexp_replace("r", _PLATFORM, ""), _BROKEN_END, ""))).otherwise(F.col("s"))
    return known.select("id", "field", "kind", "s", "mark", stem.alias("stem"))


def trigrams_and_finals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, k3, k2, lat, goes_on, ends) and (id, field, kind, mark, k3, k2, whole) from one scan of ``marked`` rows.

    The first says how often each trigram goes on or ends a sentence. Open ends of whole
    texts are counted apart; a platform's mark behind a cut end counts as going on, which
    is what it says. k3 and k2 are hashes of the last three and two words; lat holds the
    words where the last is Latin. Map-side partial aggregation leaves distinct trigrams
    per task; hot trigrams arrive pre-counted.

    The second has the last trigram of each open or marked end and a hash of the text up
    to there; k3 and k2 are null where there is no word.
    """
    words = rows.select("id", "field", "kind", "mark", _words(F.col("s")).alias("t"), F.when(F.col("mark") == "cut", _words(F.col("stem"))).alias("u"))
    both = cut(
        rows.sparkSession.sql(
            """
            with e as (select *, coalesce(u, t) as e from {words}),
            n as (select *, array_position(transform(reverse(if(size(e) < 8, e, slice(e, -8, 8))), x -> x not in ('$', '.')), true) as near from e),
            f as (select id, field, kind, mark, t, slice(e, 1, size(e) + 1 - if(near > 0, near, array_position(transform(reverse(e), x -> x not in ('$', '.')), true))) as f from n),
            g as (select id, concat_ws(' ', field, mark) as about, kind, if(mark = 'stop', null, xxhash64(f)) as whole,
                         inline(concat(cast(arrays_zip(t, slice(t, 2, size(t)), slice(t, 3, size(t)), slice(t, 4, size(t))) as array<struct<a: string, b: string, c: string, d: string>>),
                                       if(mark <> 'stop' and size(f) > 2, array(named_struct('a', element_at(f, -3), 'b', element_at(f, -2), 'c', element_at(f, -1), 'd', '')),
                                       if(mark = 'cut', array(named_struct('a', string(null), 'b', string(null), 'c', string(null), 'd', '')), array()))))
                  from f)
            select kind, if(c is null, null, xxhash64(a, b, c)) as k3, if(c is null, null, xxhash64(b, c)) as k2,
                   case when d <> '' and ascii(c) between 97 and 122 then concat_ws(' ', a, b, c) end as lat,
                   if(d = '', id, null) as id, if(d = '', about, null) as about, if(d = '', whole, null) as whole,
                   count_if(d not in ('$', '.')) as goes_on, count_if(d in ('$', '.')) as ends
            from g where d = '' or c not in ('$', '.') group by all
            """,
            words=words,
        )
    )
    inside = both.where("about is null").select("kind", "k3", "k2", "lat", "goes_on", "ends")
    finals = both.where("about is not null").selectExpr("id", "substring_index(about, ' ', 1) as field", "kind", "substring_index(about, ' ', -1) as mark", "k3", "k2", "whole", "explode(array_repeat(0, cast(goes_on as int))) as z")
    return inside, finals.drop("z")


def truncated(df: DataFrame, key: str, fields: list[str], min_seen: int = MIN_SEEN, max_rate: float = MAX_RATE) -> DataFrame:
    """(id, field) of every field value that was cut inside a sentence: see truncation_evidence."""
    return truncation_evidence(df, key, fields, min_seen, max_rate).select("id", "field")


def truncation_evidence(df: DataFrame, key: str, fields: list[str], min_seen: int = MIN_SEEN, max_rate: float = MAX_RATE) -> DataFrame:
    """(id, field, mark, evidence) of every field value that was cut inside a sentence.

    A value is cut where its last trigram (else, if seen less than ``min_seen`` times, its
    last two words) goes on at least ``min_seen`` times and ends at most a share
    ``max_rate`` of the times. A platform's mark or a broken character behind the end
    (mark 'cut') says so outright, whatever the words. evidence says what decided:
    'trigram' or 'pair', and 'mark' where the words alone would not have. Values that end
    in a full stop are never cut; an ellipsis is judged like an open end.

    Defined results: null and blank values are not cut; values without words are judged by
    their mark only; repeated rows each give their row; null ids are kept; empty tables
    give an empty result; columns other than key and fields aren't read, so names may clash.
    """
    rows = fields_of(df, key, fields)
    inside, finals = trigrams_and_finals(marked(rows))
    tail = finals.where("mark <> 'cut' and k3 is not null").groupBy("kind", "k3", "k2").agg(F.count_distinct("whole").alias("texts"))
    wanted = finals.where("k3 is not null").select("kind", "k3", "k2").distinct()
    # A last word cut inside: count each Latin word under all its beginnings.
    begun = inside.where("lat is not null").selectExpr("kind", "goes_on + ends as n", "substring_index(lat, ' ', 2) as ab", "substring_index(lat, ' ', -1) as c")
    begun = begun.selectExpr("kind", "n", "ab", "explode(transform(sequence(1, greatest(length(c) - 1, 1)), i -> substring(c, 1, i))) as p", "length(c) as l").where("length(p) < l")
    begun = begun.selectExpr("kind", "xxhash64(split(ab, ' ')[0], split(ab, ' ')[1], p) as k3", "xxhash64(split(ab, ' ')[1], p) as k2", "n as goes_on", "cast(0 as bigint) as ends", "cast(0 as bigint) as texts")
    counts = (
        inside.selectExpr("kind", "k3", "k2", "goes_on", "ends", "cast(0 as bigint) as texts")
        .union(tail.selectExpr("kind", "k3", "k2", "cast(0 as bigint)", "cast(0 as bigint)", "texts"))
        .union(wanted.selectExpr("kind", "k3", "k2", "cast(0 as bigint)", "cast(0 as bigint)", "cast(0 as bigint)"))
        .union(begun)
        .groupBy("kind", "k3", "k2")
        .agg(*[F.sum(c).alias(c) for c in ("goes_on", "ends", "texts")])
    )
    counts = cut(counts)
    two = counts.groupBy("kind", "k2").agg(*[F.sum(c).alias(f"{c}2") for c in ("goes_on", "ends", "texts")])
    rare = F.col("goes_on") + F.col("ends") + F.col("texts") < min_seen
    by_words = F.when(rare, _never_ends(("goes_on2", "ends2", "texts2"), min_seen, max_rate)).otherwise(_never_ends(("goes_on", "ends", "texts"), min_seen, max_rate))
    verdict = wanted.join(counts, ["kind", "k3", "k2"]).join(two, ["kind", "k2"]).select(F.xxhash64("kind", "k3", "k2").alias("__k"), F.when(by_words, F.when(rare, "pair").otherwise("trigram")).alias("words")).where("words is not null")
    judged = lookup(finals.select("id", "field", "mark", F.when(F.col("k3").isNotNull(), F.xxhash64("kind", "k3", "k2")).alias("__k")), verdict, "__k", ["id", "field"])
    return judged.select("id", "field", "mark", F.coalesce("words", F.when(F.col("mark") == "cut", "mark")).alias("evidence")).where("evidence is not null")


def _never_ends(seen: tuple[str, str, str], min_seen: int, max_rate: float) -> Column:
    g, e, t = map(F.col, seen)
    return (g >= min_seen) & (e + t <= 1 + max_rate * (g + e + t))


def truncation_rates(df: DataFrame, key: str, fields: list[str], url: str) -> DataFrame:
    """(site, field, n_values, n_cut, rate) per host of ``url``; '' where there is none."""
    found = truncated(df, key, fields).distinct().withColumn("cut", F.lit(1))
    rows = df.select(F.col(key).alias("id"), site_host(F.col(url)).alias("site"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in fields]))).where("trim(s) <> ''")
    return rows.drop("s").join(found, ["id", "field"], "left").groupBy("site", "field").agg(F.count("*").alias("n_values"), F.count("cut").alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_values"), 6))
