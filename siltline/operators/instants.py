"""Mixed timestamp notations to UTC instants, by an as-of join to zone-offset intervals.

A written time is parsed to a *local* microsecond count plus what it says about its zone. Written
offsets, ``Z`` and epoch counts fix the instant at once. Wall-clock times are joined as-of to the
zone's offset intervals: on the local time line an instant of wall clock falls into two intervals
(an ambiguous, repeated hour), none (a skipped hour) or one. The interval table is exploded by
local year, so the as-of join is an equi-join on (zone, year) with a residual range test on a
small broadcast side, whose size is fixed by the zone database and not by the data.

Defined results: null, blank, senseless and impossible values (30 February, month 13) give a null
instant with status ``unresolvable``; rows keep their order of magnitude, none is dropped or doubled.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1970, 2060
SECOND, DAY = 1_000_000, 86_400_000_000
_OPEN = 1 << 50  # the first and the last interval stay open
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

# Month names of the languages the platforms write in.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "janvier": 1, "janv": 1, "enero": 1, "ene": 1, "gennaio": 1, "gen": 1, "janeiro": 1, "januari": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "fevrier": 2, "févr": 2, "febrero": 2, "febbraio": 2, "fevereiro": 2, "fev": 2, "februari": 2,
    "mar": 3, "march": 3, "märz": 3, "mär": 3, "maerz": 3, "mars": 3, "marzo": 3, "março": 3, "maart": 3, "mrt": 3,
    "apr": 4, "april": 4, "avril": 4, "avr": 4, "abril": 4, "abr": 4, "aprile": 4,
    "may": 5, "mai": 5, "mayo": 5, "maggio": 5, "mag": 5, "maio": 5, "mei": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6, "giugno": 6, "giu": 6, "junho": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "juil": 7, "julio": 7, "luglio": 7, "lug": 7, "julho": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8, "augustus": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "settembre": 9, "set": 9, "setembro": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "octobre": 10, "octubre": 10, "ottobre": 10, "ott": 10, "outubro": 10, "out": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11, "novembro": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "décembre": 12, "déc": 12, "diciembre": 12, "dic": 12, "dicembre": 12, "dezembro": 12,
}
# Seconds of the units of relative times; a month has 30 days, a year 365.
UNITS = {
    1: ["s", "sec", "secs", "second", "seconds", "sekunde", "sekunden", "seconde", "secondes", "segundo", "segundos", "secondo", "secondi"],
    60: ["m", "min", "mins", "minute", "minutes", "minuten", "minuto", "minutos", "minuti", "minuut"],
    3600: ["h", "hr", "hrs", "hour", "hours", "stunde", "stunden", "heure", "heures", "hora", "horas", "ora", "ore", "uur", "uren"],
    86400: ["d", "day", "days", "tag", "tage", "tagen", "jour", "jours", "día", "días", "dia", "dias", "giorno", "giorni", "dag", "dagen"],
    604800: ["w", "wk", "week", "weeks", "woche", "wochen", "semaine", "semaines", "semana", "semanas", "settimana", "settimane", "weken"],
    2592000: ["mo", "mos", "month", "months", "monat", "monate", "monaten", "mois", "mes", "meses", "mês", "mese", "mesi", "maand", "maanden"],
    31536000: ["y", "yr", "yrs", "year", "years", "jahr", "jahre", "jahren", "an", "ans", "année", "années", "año", "años", "ano", "anos", "anno", "anni", "jaar", "jaren"],
}

_ZONE = r"(?:\s*(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}|[A-Z][A-Za-z_]+/[A-Za-z_/+-]+[0-9]*))?(?:\s*\[([A-Za-z_/+0-9-]+)\])?$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s+Uhr)?"
_AT = r",?\s+(?:at\s+|um\s+|à\s+|a\s+)?"
#: notation -> (pattern, order of the three date groups); "" is the order of the platform
NOTATIONS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:[T ]|,\s)" + _CLOCK + ")?" + _ZONE, "ymd"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2}):?(\d{2}):?(\d{2})?(?:[.,](\d+))?()" + _ZONE, "ymd"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?:" + _AT + _CLOCK + ")?" + _ZONE, ""),
    (r"^(?:\p{L}+\.?,?\s+)?(\p{L}{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:" + _AT + _CLOCK + ")?" + _ZONE, "mdy"),
    (r"^(?:\p{L}+\.?,\s+)?(\d{1,2})(?:\.|st|nd|rd|th)?\s+(?:de\s+)?(\p{L}{3,})\.?,?\s+(?:de\s+)?(\d{4})(?:" + _AT + _CLOCK + ")?" + _ZONE, "dmy"),
]
_UNIT = "|".join(sorted((u for us in UNITS.values() for u in us), key=lambda u: (-len(u), u)))
RELATIVE = rf"^(?:vor\s+|hace\s+|il\s+y\s+a\s+|há\s+)?(\d{{1,6}}|an?|one|einer?|einem|une?|una?|uma?|un|een)?\s*({_UNIT})(?:\s+(?:ago|fa|geleden|atrás))?$"


@functools.cache
def offset_intervals(zone: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, offset, abbreviation) of a zone: UTC seconds from FIRST_YEAR to LAST_YEAR, without gaps."""
    z = zoneinfo.ZoneInfo(zone)
    at = lambda s: (lambda t: (int(t.utcoffset().total_seconds()), t.tzname() or ""))((_EPOCH + dt.timedelta(seconds=s)).astimezone(z))
    start = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) - 86400
    end = int((dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) + 86400
    out, since, now, s = [], start, at(start), start
    while s < end:
        nxt = min(s + 7 * 86400, end)  # no zone changes twice within a week
        if at(nxt) != now:
            lo, hi = s, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            out.append((since, hi, *now))
            since, now = hi, at(hi)
        s = nxt
    out.append((since, end, *now))
    return tuple(out)


@functools.cache
def _segments(zones: tuple[str, ...]) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows, names = [], {}
    year_start = {y: int((dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) for y in range(FIRST_YEAR, LAST_YEAR + 2)}
    edge_from, edge_to = min(year_start.values()), max(year_start.values())
    for zone in zones:
        cuts: list[tuple[int, int, str, int]] = []
        spans = offset_intervals(zone)
        for k, (a, b, off, abbr) in enumerate(spans):
            names[zone, abbr] = off
            lo, hi = a + off, b + off
            before, after = (spans[k - 1][2] if k else off), (spans[k + 1][2] if k + 1 < len(spans) else off)
            if k:
                if off > before:  # skipped hour: the offset before the change holds
                    cuts.append((a + before, a + off, "nonexistent", before))
                elif off < before:  # repeated hour: belongs to the first pass, taken by the span before
                    lo = a + before
            end = hi - max(0, off - after) if k + 1 < len(spans) else hi
            if lo < end:
                cuts.append((lo, end, "unique", off))
            if k + 1 < len(spans) and after < off:
                cuts.append((max(lo, hi - (off - after)), hi, "ambiguous", off))
        for lo, hi, kind, off in cuts:
            first = max(FIRST_YEAR, (_EPOCH + dt.timedelta(seconds=lo)).year)
            last = min(LAST_YEAR, (_EPOCH + dt.timedelta(seconds=hi - 1)).year)
            for y in range(first, last + 1):
                a, b = max(lo, year_start[y]), min(hi, year_start[y + 1])
                rows.append((zone, y, -_OPEN if a == edge_from else a, _OPEN if b == edge_to else b, kind, off))
    seg = pd.DataFrame(rows, columns=["seg_zone", "seg_year", "seg_from", "seg_to", "seg_kind", "seg_offset"])
    abb = pd.DataFrame([(z, a, o) for (z, a), o in names.items() if a[:1].isalpha()], columns=["abb_zone", "abb_name", "abb_offset"])
    return seg, abb


def zone_segments(spark: SparkSession, zones: set[str]) -> tuple[DataFrame, DataFrame]:
    """The local time lines of the zones, cut where the number of matching offset intervals changes, by local year."""
    seg, abb = _segments(tuple(sorted(zones & zoneinfo.available_timezones() | {"UTC"})))
    return (
        spark.createDataFrame(seg, "seg_zone string, seg_year int, seg_from long, seg_to long, seg_kind string, seg_offset int"),
        spark.createDataFrame(abb, "abb_zone string, abb_name string, abb_offset int"),
    )


def zones_of(df: DataFrame, text: str, home_zone: str) -> set[str]:
    """The zones that a column of written times needs: at most as many as the zone database has names."""
    known = sorted(zoneinfo.available_timezones())
    named = F.regexp_extract(F.col(text), r"([A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)*[0-9]*)\]?\s*$", 1)
    zones = df.select(F.explode(F.array(F.col(home_zone), named)).alias("z")).distinct().filter(F.col("z").isin(known))
    return {r.z for r in zones.collect()}


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, by arithmetic alone: nothing to throw on a wrong date."""
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_written(df: DataFrame, text: str, order: str, prefix: str = "w_") -> DataFrame:
    """Add ``{prefix}local`` (microseconds of wall clock), ``zone`` (as written) and ``epoch`` (microseconds) to ``df``.

    ``text`` and ``order`` (dmy, mdy or ymd) are column names. All three are null where nothing can be read.
    """
    p = prefix
    t = F.trim(F.regexp_replace(F.col(text), r"[\s    ﻿]+", " "))
    df = df.withColumn(f"{p}t", t)
    t = F.col(f"{p}t")
    kind = F.lit(None).cast("int")
    for k, (pattern, _) in reversed(list(enumerate(NOTATIONS))):
        kind = F.when(t.rlike(pattern), k).otherwise(kind)
    df = df.withColumn(f"{p}kind", F.when(t.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$"), -1).otherwise(kind))
    kind = F.col(f"{p}kind")

    def group(i: int) -> Column:
        c = F.lit(None).cast("string")
        for k, (pattern, _) in enumerate(NOTATIONS):
            c = F.when(kind == k, F.regexp_extract(t, pattern, i)).otherwise(c)
        return F.nullif(c, F.lit(""))

    df = df.withColumns({f"{p}g{i}": group(i) for i in range(1, 11)})
    g = {i: F.col(f"{p}g{i}") for i in range(1, 11)}
    written = F.lit(None).cast("string")
    for k, (_, o) in enumerate(NOTATIONS):
        written = F.when(kind == k, F.lit(o) if o else F.when(F.col(order) == "ymd", "dmy").otherwise(F.coalesce(F.col(order), F.lit("dmy")))).otherwise(written)
    df = df.withColumn(f"{p}o", written)
    o = F.col(f"{p}o")
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    at = lambda letter: F.when(o.substr(1, 1) == letter, g[1]).when(o.substr(2, 1) == letter, g[2]).otherwise(g[3])
    year = _int(at("y"))
    df = df.withColumns({
        f"{p}y": F.when(F.length(at("y")) == 2, year + 2000).otherwise(year),
        f"{p}m": F.coalesce(_int(at("m")), F.try_element_at(month, F.lower(at("m"))).cast("long")),
        f"{p}d": _int(at("d")),
        f"{p}h": F.coalesce(_int(g[4]), F.lit(0)),
        f"{p}mi": F.coalesce(_int(g[5]), F.lit(0)),
        f"{p}s": F.coalesce(_int(g[6]), F.lit(0)),
        f"{p}us": F.coalesce(_int(F.rpad(F.substring(g[7], 1, 6), 6, "0")), F.lit(0)),
        f"{p}ap": F.lower(g[8]),
    })
    c = {k: F.col(f"{p}{k}") for k in ("y", "m", "d", "h", "mi", "s", "us", "ap")}
    hour = F.when(c["ap"].isNull(), c["h"]).when(c["ap"] == "p", c["h"] % 12 + 12).otherwise(c["h"] % 12)
    fits = (
        c["y"].between(1, 9999) & c["m"].between(1, 12) & (c["d"] >= 1) & (c["d"] <= _month_days(c["y"], c["m"]))
        & (c["mi"] < 60) & (c["s"] < 60) & F.when(c["ap"].isNull(), c["h"] < 24).otherwise(c["h"].between(1, 12))
    )
    n = _int(t)
    epoch = F.when(kind == -1, F.when(F.length(t) == 10, n * SECOND).when(F.length(t) == 13, n * 1000).otherwise(n))
    local = F.when(fits, _days(c["y"], c["m"], c["d"]) * DAY + (hour * 3600 + c["mi"] * 60 + c["s"]) * SECOND + c["us"])
    df = df.withColumns({f"{p}epoch": epoch, f"{p}local": local, f"{p}zone": F.coalesce(g[9], g[10])})
    drop = [f"{p}{x}" for x in ("t", "kind", "o", "y", "m", "d", "h", "mi", "s", "us", "ap", *(f"g{i}" for i in range(1, 11)))]
    return df.drop(*drop)


def relative_seconds(text: Column) -> Column:
    """Seconds that a relative time lies back (``3 days ago``, ``vor 2 Wochen``, ``5mo • Edited``); null if it isn't one."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s  ]+", " "), r"\s*[•·](?:\s*Edited)?\s*$", "")))
    unit = F.create_map(*[F.lit(x) for s, us in UNITS.items() for u in us for x in (u, s)])
    hit = t.rlike(RELATIVE)
    count = F.coalesce(_int(F.regexp_extract(t, RELATIVE, 1)), F.when(F.regexp_extract(t, RELATIVE, 1) != "", 1))
    return F.when(hit, count * F.try_element_at(unit, F.regexp_extract(t, RELATIVE, 2)).cast("long"))


def resolve_instants(df: DataFrame, text: str, home_zone: str, order: str, base: str | None = None) -> DataFrame:
    """Add ``utc_us`` and ``instant_status`` for the written time in column ``text``.

    ``home_zone`` and ``order`` name the columns with the zone and all-number date order that hold where
    the value says nothing; ``base`` names the column with the written time that relative values count
    back from. Status: ``fixed`` (offset or epoch written), ``unique``, ``ambiguous`` (repeated hour, first pass),
    ``nonexistent`` (skipped hour, offset before), ``relative`` or ``unresolvable`` (``utc_us`` null).
    """
    spark = df.sparkSession
    seg, abb = zone_segments(spark, zones_of(df, text, home_zone))
    back = relative_seconds(F.col(text)) if base else F.lit(None).cast("long")
    out = df.withColumn("r_back", back)
    out = out.withColumn("r_text", F.when(F.col("r_back").isNotNull(), F.col(base)).otherwise(F.col(text)) if base else F.col(text))
    out = parse_written(out, "r_text", order, "r_")
    z = F.col("r_zone")
    named = z.contains("/") | F.lower(z).isin("etc/utc")
    offset = F.when(z.isin("Z", "UTC", "GMT"), 0).when(
        z.rlike(r"^[+-]\d{2}:?\d{2}$"),
        F.when(z.startswith("-"), -1).otherwise(1) * (_int(F.substring(z, 2, 2)) * 3600 + _int(F.regexp_extract(z, r"(\d{2})$", 1)) * 60),
    )
    out = out.withColumns({"r_offset": offset, "r_line": F.when(named, z).otherwise(F.col(home_zone)), "r_abbr": F.when(~named & offset.isNull(), z)})
    out = out.join(F.broadcast(abb), (F.col("r_abbr") == F.col("abb_name")) & (F.col(home_zone) == F.col("abb_zone")), "left")
    out = out.withColumn("r_offset", F.coalesce(F.col("r_offset"), F.col("abb_offset").cast("long")))
    wall = F.col("r_offset").isNull() & F.col("r_abbr").isNull() & F.col("r_local").isNotNull()
    second = F.floor(F.col("r_local") / SECOND)
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("r_local") / DAY).cast("int")))
    out = out.withColumns({"r_year": F.when(wall, F.least(F.greatest(year, F.lit(FIRST_YEAR)), F.lit(LAST_YEAR))), "r_second": second})
    inside = (F.col("r_second") >= F.col("seg_from")) & (F.col("r_second") < F.col("seg_to"))
    out = out.join(F.broadcast(seg), (F.col("r_line") == F.col("seg_zone")) & (F.col("r_year") == F.col("seg_year")) & inside, "left")
    utc = F.coalesce(
        F.col("r_epoch"),
        F.col("r_local") - F.col("r_offset") * SECOND,
        F.when(wall, F.col("r_local") - F.col("seg_offset").cast("long") * SECOND),
    )
    status = (
        F.when(utc.isNull(), "unresolvable").when(F.col("r_back").isNotNull(), "relative")
        .when(F.col("r_epoch").isNotNull() | F.col("r_offset").isNotNull(), "fixed").otherwise(F.col("seg_kind"))
    )
    utc = F.when(F.col("r_back").isNotNull(), utc - F.col("r_back") * SECOND).otherwise(utc)
    names = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*names, utc.cast("long").alias("utc_us"), status.alias("instant_status"))


def post_instants(posts: DataFrame, platforms: DataFrame) -> DataFrame:
    """One row for each of the two written times of each post: row_no, field, written, utc_us, instant_status."""
    base = posts.select("row_no", F.col("source.platform").alias("platform"), F.col("source.captured_at").alias("captured"), F.col("source.published_at").alias("published"))
    home = platforms.groupBy("platform").agg(F.max("home_zone").alias("home_zone"), F.max("date_order").alias("date_order"))
    both = base.select(
        "row_no", "platform", "captured",
        F.explode(F.array(
            F.struct(F.lit("captured_at").alias("field"), F.col("captured").alias("written")),
            F.struct(F.lit("published_at").alias("field"), F.col("published").alias("written")),
        )).alias("v"),
    ).select("row_no", "platform", "captured", "v.field", "v.written")
    both = both.join(F.broadcast(home), "platform", "left")
    return resolve_instants(both, "written", "home_zone", "date_order", base="captured").select("row_no", "field", "written", "utc_us", "instant_status")
