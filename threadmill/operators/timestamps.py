"""Mixed timestamp notations and zones, normalised to one instant in UTC.

Each text is read once, in Arrow batches, into its wall clock and its zone as written
(a ladder of regular expressions in Catalyst was measured at eight times the CPU, since
each part repeats the match). All zone arithmetic stays in the JVM: to_utc_timestamp
gives the results wanted at daylight saving changes (a local time that occurs twice
takes the earlier instant, a skipped one the offset before the change) and doesn't
depend on the session's time zone.

Missing zones are estimated per site: the local times are aligned with an ingestion
time, and of the candidate zones (offset histories) the one wins under which the fewest
rows would have been written after they were ingested.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.joins import lookup
from threadmill.session import cut

# Words for halves of the day, zone abbreviations without daylight saving
# and English month names, as they occur in the notations read here.
_PM = ["下午", "晚上", "中午", "午後", "오후", "pm", "p.m."]
_AM = ["上午", "凌晨", "早上", "午前", "오전", "am", "a.m."]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_ABBREVIATIONS = {"utc": "Z", "gmt": "Z", "jst": "+09:00", "kst": "+09:00"}

_HALF = "(?:" + "|".join(map(re.escape, _PM + _AM)) + ")(?![a-z])"
_MON = "|".join(_MONTHS)
_ZONE = r"(?:[zZ]|\(?(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?\)?|\(?(?:UTC|GMT|JST|KST)\)?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_CLOCK = r"(?P<h>\d{1,2})\s*[:：時时시]\s*(?P<mi>\d{1,2})\s*[分분]?(?:\s*[:：]?\s*(?P<s>\d{1,2})(?:[.,](?P<f>\d{1,9}))?\s*[秒초]?)?"
_DAY_NAME = r"(?:[a-z]{3,9}\.?,?\s+)?"
_MD = rf"(?P<mo>{_MON})[a-z]*\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?"
_NOTATIONS = [
    re.compile(x, re.I)
    for x in (
        rf"(?P<y>\d{{4}})\s*[-/.年년]\s*(?P<mo>\d{{1,2}})\s*[-/.月월]\s*(?P<d>\d{{1,2}})\s*[日일.]?(?:\s*[T, ]?\s*(?P<half>{_HALF})?\s*{_CLOCK}(?:\s*(?P<half2>{_HALF}))?)?\s*(?P<z>{_ZONE})?",
        r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)(?:[T ]?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?)?",
        rf"{_DAY_NAME}{_MD},?\s+(?P<y>\d{{4}})(?:,?\s+{_CLOCK}(?:\s*(?P<half>{_HALF}))?)?\s*(?P<z>{_ZONE})?",
        rf"{_DAY_NAME}{_MD}\s+{_CLOCK}\s+(?P<z>{_ZONE})?\s*(?P<y>\d{{4}})",
        rf"{_DAY_NAME}(?P<d>\d{{1,2}})\s+(?P<mo>{_MON})[a-z]*\.?,?\s+(?P<y>\d{{4}})(?:,?\s+{_CLOCK}(?:\s*(?P<half>{_HALF}))?)?\s*(?P<z>{_ZONE})?",
    )
]
#: Digits of an epoch value, and the power of ten that makes it microseconds.
_EPOCH_DIGITS = {9: 6, 10: 6, 12: 3, 13: 3, 15: 0, 16: 0, 19: -3}
_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()
ZONES = zoneinfo.available_timezones()
_EDGE = " \t\r\n\u00a0\u3000\u200b\ufeff\"'"


def read_zone(z: str) -> str | None:
    """A zone as written -> 'Z', '+HH:MM', a name of the time zone database; None if unknown."""
    z = z.strip("()")
    if (low := z.lower()) == "z":
        return "Z"
    if low in _ABBREVIATIONS:
        return _ABBREVIATIONS[low]
    if m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2})(?::?([0-5]\d))?", low):
        return f"{m[1]}{int(m[2]):02}:{m[3] or '00'}" if int(m[2]) <= 14 else None
    return z if z in ZONES else None


def read_text(s: str | None) -> tuple[int, str] | None:
    """(wall clock in microseconds as if UTC, zone as written or '') of one text, or None.

    None for null, empty, all-zero and wordy texts, impossible dates and unknown zones.
    Epoch values come with zone 'Z'.
    """
    if not s or not (s := s.strip(_EDGE)):
        return None
    if s.isdecimal() and s[0] != "0" and (power := _EPOCH_DIGITS.get(len(s))) is not None:
        v = int(s)
        return (v * 10**power if power >= 0 else v // 10**-power), "Z"
    for pattern in _NOTATIONS[:2] if s[0].isdecimal() and not s[1:3].strip("0123456789 ").isalpha() else _NOTATIONS[2:]:
        if m := pattern.fullmatch(s):
            break
    else:
        m = next((m for p in _NOTATIONS if (m := p.fullmatch(s))), None)
    if not m:
        return None
    g = m.groupdict()
    month, hour, half, zone = g["mo"], int(g["h"] or 0), g.get("half") or g.get("half2"), g.get("z")
    if half:
        hour = hour % 12 + (12 if half.lower() in _PM else 0)
    minute, second = int(g["mi"] or 0), int(g.get("s") or 0)
    if zone and (zone := read_zone(zone)) is None or hour > 24 or minute > 59 or second > 60 or (hour == 24 and (minute or second)):
        return None
    try:
        day = dt.date(int(g["y"]), int(month) if month.isdecimal() else _MONTHS.index(month.lower()) + 1, int(g["d"])).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    fraction = int((g.get("f") or "0").ljust(6, "0")[:6])
    return (((day * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000 + fraction, zone or ""


@F.pandas_udf(T.StructType([T.StructField("wall", T.LongType()), T.StructField("zone", T.StringType())]))
def read_notation(texts: pd.Series) -> pd.DataFrame:
    """read_text over a column; null fields where a text can't be read."""
    got = [read_text(x) for x in texts]
    return pd.DataFrame({"wall": pd.array([g and g[0] for g in got], dtype="Int64"), "zone": [g and g[1] for g in got]})


def instant_micros(read: Column, zone: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a read text; ``zone`` counts where it names none."""
    own = F.when(read["zone"] == "", zone).otherwise(read["zone"])
    return F.when(own == "Z", read["wall"]).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(read["wall"]), own)))


def site_host(url: Column) -> Column:
    """Host of a URL in lower case, without sub-domains m. and www.; '' where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^(?:(?:www|m)\.)+", ""), F.lit(""))


#: Up to so many sites are broadcast; more are looked up under a salt.
MAX_BROADCAST_SITES = 100_000
_SLOT_S = 900  # zone offsets are whole quarter hours
_REACH_S = 15 * 3600  # no offset is further from UTC


def _evidence(df: DataFrame, site: Column, local: Column, ingested: Column) -> DataFrame:
    """(site, __hour, __slot, __n, __sum): rows counted by site, hour and quarter-hour slack.

    Offsets are whole quarter hours, so that is all the fit needs; rows of more than 15 h
    of slack are in one counter per site. What meets the candidates is bounded by sites x
    hours x 120 whatever the number of rows.
    """
    floor = lambda x, y: F.floor(x / F.lit(y)).cast("bigint")
    at = df.select(site.alias("site"), local.alias("__at"), ingested.alias("__in"))
    slack = at.where("__at is not null and __in is not null").select("site", "__at", floor(F.col("__in") - F.col("__at"), 1_000_000).alias("__slack"))
    near = F.col("__slack") < _REACH_S
    slot = F.greatest(floor(F.col("__slack"), _SLOT_S), F.lit(-_REACH_S // _SLOT_S).cast("bigint"))
    rows = slack.select("site", F.when(near, floor(F.col("__at"), 3_600_000_000)).alias("__hour"), F.when(near, slot).alias("__slot"), "__slack")
    return rows.groupBy("site", "__hour", "__slot").agg(F.count("*").alias("__n"), F.sum("__slack").alias("__sum"))


def _offset(zone: Column) -> Column:
    """The zone's offset in seconds at an hour of evidence.

    to_utc_timestamp shifts by the zone's offset at that local time: the difference is the offset.
    """
    wall = F.timestamp_seconds(F.col("__hour") * 3600)
    return F.unix_seconds(wall) - F.unix_seconds(F.to_utc_timestamp(wall, zone))


def _fit(counted: DataFrame, candidates: DataFrame, least_s: int) -> DataFrame:
    offset = _offset(F.col("zone"))
    late = F.col("__hour").isNotNull() & (offset < F.lit(least_s) - F.col("__slot") * _SLOT_S)
    lag = F.when(~late, F.col("__sum") - F.coalesce(offset, F.lit(0)) * F.col("__n") * F.lit(-1))
    return (
        counted.join(F.broadcast(candidates.select("zone")), how="cross")
        .groupBy("site", "zone")
        .agg(F.sum("__n").alias("n_rows"), F.sum(F.when(late, F.col("__n")).otherwise(0)).alias("n_violations"), (F.sum(lag) / F.sum(F.when(~late, F.col("__n")))).alias("lag_s"))
    )


def zone_fit(df: DataFrame, site: Column, local: Column, ingested: Column, candidates: DataFrame, least_s: int = 0) -> DataFrame:
    """How well each candidate zone explains the local times of each site.

    ``local`` are wall clocks in microseconds, ``ingested`` the row's ingestion
    instant in microseconds, ``candidates`` has columns zone. One row per site and zone:
    (site, zone, n_rows, n_violations, lag_s): rows that can be aligned, rows whose instant
    under the zone would be less than ``least_s`` before their ingestion, and the mean lag
    in seconds of those that are not.
    """
    return _fit(_evidence(df, site, local, ingested), candidates, least_s)


def _lags(counted: DataFrame, zones: DataFrame) -> DataFrame:
    """(site, zone, lag, n): rows by the quarter hours from local time to ingestion under each zone.

    Rows of more than 15 h of slack say nothing of the zone and have no lag.
    """
    lag = F.floor(F.col("__slot") + _offset(F.col("zone")) / _SLOT_S).cast("int").alias("lag")
    return counted.join(F.broadcast(zones.select("zone")), how="cross").groupBy("site", "zone", lag).agg(F.sum("__n").alias("n"))


def _costs(lags: DataFrame, known: DataFrame) -> DataFrame:
    """(site, zone, cost): how unlikely a site's lags under a zone are among those of the other sites of known zone.

    A lag's chance is its share of their rows, each lag counted half a row more, so odd rows
    cost every zone alike. A known site's own rows are taken out of what it is compared with.
    """
    of = lags.where("lag is not null")
    own = of.join(known, (F.col("site") == F.col("__site")) & (F.col("zone") == F.col("__known"))).select("site", "lag", F.col("n").alias("__own"))
    pool = own.groupBy("lag").agg(F.sum("__own").alias("__pool"))
    whole = own.agg(F.coalesce(F.sum("__own"), F.lit(0)).alias("__whole"))
    mine = own.groupBy("site").agg(F.sum("__own").alias("__mine"))
    both = of.join(pool, "lag", "left").join(own, ["site", "lag"], "left").join(mine, "site", "left").join(F.broadcast(whole), how="cross")
    zero = lambda c: F.coalesce(c, F.lit(0))
    chance = (zero("__pool") - zero("__own") + 0.5) / (F.col("__whole") - zero("__mine") + 0.5 * 2 * _REACH_S / _SLOT_S)
    return both.groupBy("site", "zone").agg(F.round(F.sum(-F.col("n") * F.ln(chance)), 6).alias("cost"))


def estimate_zones(df: DataFrame, site: Column, local: Column, ingested: Column, declared: DataFrame, default: str, hidden: bool = False) -> DataFrame:
    """The offset history to use for each site: (site, zone, n_violations, n_rows, declared).

    ``declared`` (site, zone) are sites whose zone is known; for them the known history
    wins and the fit is its measure; with ``hidden`` it is left out, to see what the fit
    alone would say. A zone and a lag can't be told apart by one site, so every other site
    takes, of all declared zones, the one that makes its lags most like those of the sites
    of known zone. Where these are no guide, it takes the one with the fewest violations
    (instants later than their ingestion), then the smallest mean lag, then ``default``,
    then the first name.
    """
    declared = declared.where(F.col("site").isNotNull() & F.col("zone").isin(sorted(ZONES)))
    known = declared.groupBy(F.lower("site").alias("site")).agg(F.min("zone").alias("__known"))
    counted = cut(_evidence(df, site, local, ingested))
    zones = declared.select("zone").union(df.sparkSession.createDataFrame([(default,)], "zone string")).distinct()
    costs = _costs(_lags(counted, zones), known.select(F.col("site").alias("__site"), "__known"))
    known = known.limit(0) if hidden else known
    # Declared sites stay even without any row to align: they join with an empty count.
    none = known.select("site", F.col("__known").alias("zone"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_violations"), F.lit(None).cast("double").alias("lag_s"))
    fit = _fit(counted, zones, 0).union(none).groupBy("site", "zone").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_violations").alias("n_violations"), F.max("lag_s").alias("lag_s")).join(costs, ["site", "zone"], "left")
    order = F.struct((F.coalesce(F.col("__known"), F.lit("")) != F.col("zone")).alias("a"), F.coalesce("cost", F.lit(0.0)).alias("w"), F.col("n_violations").alias("b"), F.col("lag_s").alias("c"), (F.col("zone") != default).alias("d"), F.col("zone").alias("e"))
    best = fit.join(known, "site", "left").groupBy("site").agg(F.min_by(F.struct("zone", "n_violations", "n_rows"), order).alias("__b"), F.max("__known").alias("__known"))
    return best.select("site", "__b.zone", "__b.n_violations", "__b.n_rows", F.col("__known").isNotNull().alias("declared"))


def check_zones(df: DataFrame, local_field: str, utc_field: str, url: str, sites: DataFrame, default: str = "Asia/Shanghai") -> DataFrame:
    """(site, declared, estimated, n_rows, n_same): the estimate with each declared zone hidden.

    n_rows are the site's readable local times without zone, n_same those that both zones
    make the same instant. Sites without such rows aren't there.
    """
    rows = df.select(read_notation(local_field).alias("__l"), read_notation(utc_field).alias("__u"), site_host(F.col(url)).alias("__site")).where((F.col("__l.zone") == "") & (F.col("__site") != ""))
    rows = cut(rows.select("__l", instant_micros(F.col("__u"), F.lit("Z")).alias("__in"), "__site"))
    guess = estimate_zones(rows, F.col("__site"), F.col("__l.wall"), F.col("__in"), sites, default, hidden=True).select("site", F.col("zone").alias("estimated"))
    told = sites.where("site is not null and zone is not null").groupBy(F.lower("site").alias("site")).agg(F.min("zone").alias("declared"))
    both = lookup(rows.withColumnRenamed("__site", "site"), guess.join(told, "site"), "site", ["__in", "__l"], "inner")
    same = instant_micros(F.col("__l"), F.col("declared")) == instant_micros(F.col("__l"), F.col("estimated"))
    return both.groupBy("site", "declared", "estimated").agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_same"))


def normalise_timestamps(df: DataFrame, key: str, local_field: str, utc_field: str, url: str, sites: DataFrame, default: str = "Asia/Shanghai") -> DataFrame:
    """Each readable value as an instant: (key, field, utc_micros).

    ``local_field`` without zone is local time of the row's site, whose zone comes from
    ``estimate_zones`` over ``sites`` (site, zone); an empty URL means ``default``.
    ``utc_field`` without zone is UTC and serves as the ingestion time. Epoch values and
    values with their own zone or offset are absolute.

    Defined results: null, empty, all-zero, wordy and impossible values give no row; a
    null key stays null; repeated rows give repeated results; an empty table gives an
    empty result; columns other than key, the two fields and the URL are not read, so
    names may clash. Two scans: one counts the evidence, one converts.
    """
    rows = df.select(F.col(key), read_notation(local_field).alias("__l"), read_notation(utc_field).alias("__u"), site_host(F.col(url)).alias("__site"))
    utc = instant_micros(F.col("__u"), F.lit("Z"))
    zones = estimate_zones(rows.where((F.col("__l.zone") == "") & (F.col("__site") != "")), F.col("__site"), F.col("__l.wall"), utc, sites, default)
    zones = cut(zones.select(F.col("site").alias("__site"), F.col("zone").alias("__zone")))
    few = zones.limit(MAX_BROADCAST_SITES + 1).count() <= MAX_BROADCAST_SITES
    zoned = rows.join(F.broadcast(zones), "__site", "left") if few else lookup(rows, zones, "__site", [key])
    both = F.array(
        F.struct(F.lit(local_field).alias("field"), instant_micros(F.col("__l"), F.coalesce(F.col("__zone"), F.lit(default))).alias("utc_micros")),
        F.struct(F.lit(utc_field).alias("field"), utc.alias("utc_micros")),
    )
    return zoned.select(key, F.inline(both)).where("utc_micros is not null")

