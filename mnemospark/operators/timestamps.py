"""One UTC instant from timestamps of any notation, precision and zone."""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, small

DEFAULT_ZONE = "Asia/Shanghai"
#: Years in which a bare number is a Unix time: 2022 to 2027.
EPOCH_YEARS = (1_640_995_200, 1_830_297_600)
#: Sequence numbers of an export that one window partition holds.
SEQUENCE_BLOCK = 4096
DAY_US = 86_400_000_000

# Month names and abbreviations of English, German, Spanish, French and Portuguese, by month.
MONTHS = {
    1: "jan january januar jänner ene enero janv janvier janeiro",
    2: "feb february februar febrero févr février fevrier fev fevereiro",
    3: "mar march mär märz marz maerz marzo mars março marco",
    4: "apr april abr abril avr avril",
    5: "may mai mayo maio",
    6: "jun june juni junio juin junho",
    7: "jul july juli julio juil juillet julho",
    8: "aug august ago agosto août aout",
    9: "sep sept september septiembre septembre set setembro",
    10: "oct october okt oktober octubre octobre out outubro",
    11: "nov november noviembre novembre novembro",
    12: "dec december dez dezember dic diciembre déc décembre decembre dezembro",
}
# Words for a day relative to the export, with the days to count back.
RELATIVE = {
    0: "today 今天 今日 heute hoy hoje aujourd'hui",
    1: "yesterday 昨天 昨日 gestern ayer ontem hier",
    2: "前天 一昨日 vorgestern anteayer anteontem avant-hier",
}
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "BRST": -120, "ART": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Marks of the half of the day; True adds twelve hours.
HALVES = {"am": False, "pm": True, "a.m.": False, "p.m.": True, "上午": False, "凌晨": False, "早上": False, "下午": True, "中午": True, "傍晚": True, "晚上": True, "午前": False, "午後": True}
# Locales that write the month before the day.
MONTH_FIRST = ("en_US", "en-US", "en_PH", "en-PH")

_MONTH_OF = {word: number for number, words in MONTHS.items() for word in words.split()}
_BACK_OF = {word: back for back, words in RELATIVE.items() for word in words.split()}


def _any(words) -> str:
    return "|".join(regex.escape(w) for w in sorted(words, key=len, reverse=True))


def _pattern() -> regex.Pattern:
    half = rf"(?P<half>{_any(HALVES)})"
    clock = r"(?P<h>\d{1,2})[:：h](?P<mi>\d{2})(?:[:：](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
    zone = r"(?:\s*(?P<off>[+\-−]\d{2}:?\d{2}|[+\-−]\d{2})|\s*(?P<abbr>[A-Z]{1,5})(?![a-z]))?"
    time = rf"(?:{half}\s*)?{clock}(?:\s*{half})?(?:\s*Uhr)?{zone}"
    month = rf"(?P<mon>{_any(_MONTH_OF)})\.?"
    forms = [
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:T|,?\s+){time}",
        rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{zone}",
        rf"(?:(?P<y>\d{{4}})\s*年\s*)?(?P<mo>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*日?\s*{time}",
        rf"(?P<first>\d{{1,2}})(?P<sep2>[-/.])(?P<second>\d{{1,2}})(?P=sep2)(?P<y>\d{{4}}),?\s+{time}",
        rf"(?P<mo>\d{{1,2}})-(?P<d>\d{{1,2}})\s+{time}",
        rf"(?:\p{{L}}{{2,}}\.?,?\s+)?(?P<d>\d{{1,2}})\.?\s+(?:de\s+)?{month}\s+(?:de\s+)?(?P<y>\d{{4}}),?\s+(?:um\s+|at\s+|às\s+|à\s+)?{time}",
        rf"(?:\p{{L}}{{2,}}\.?,?\s+)?{month}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{time}",
        rf"(?P<rel>{_any(_BACK_OF)}),?\s*(?:at\s+|um\s+|às\s+|a\s+las\s+|à\s+)?{time}",
        r"(?P<unix>\d{9,17})(?:\.(?P<f>\d{1,9}))?",
    ]
    return regex.compile(rf"[\s​﻿]*(?:{'|'.join(forms)})[\s​﻿]*", regex.IGNORECASE | regex.UNICODE)


PARTS = T.StructType([T.StructField(n, T.LongType()) for n in ("y", "mo", "d", "first", "second", "us", "off", "back", "unix_us")] + [T.StructField("cst", T.BooleanType())])


def _unix(digits: str, fraction: str | None) -> int | None:
    value, part = int(digits), int((fraction or "")[:6].ljust(6, "0"))
    for unit in (1_000_000, 1_000, 1):
        us = value * unit + part * unit // 1_000_000
        if EPOCH_YEARS[0] * 1_000_000 <= us < EPOCH_YEARS[1] * 1_000_000:
            return us
    return None


def parse(text: str | None, pattern: regex.Pattern) -> tuple | None:
    """The written components of one raw time in the order of ``PARTS``; None if it is no time or its clock reads impossibly."""
    m = pattern.fullmatch(text) if text else None
    if m is None:
        return None
    g = m.groupdict()
    if g["unix"]:
        us = _unix(g["unix"], g["f"])
        return None if us is None else (None,) * 8 + (us, False)
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g["half"]:
        late = HALVES[g["half"].lower()]
        if h > 12 and not late:
            return None
        h = h % 12 + 12 * late if h <= 12 else h
    if h > 23 or mi > 59 or s > 59:
        return None
    off, cst = None, False
    if g["off"]:
        digits = [int(c) for c in g["off"] if c.isdigit()]
        off = (digits[0] * 10 + digits[1]) * 60 + (digits[2] * 10 + digits[3] if len(digits) == 4 else 0)
        if off > 18 * 60 or len(digits) == 4 and digits[2] > 5:
            return None
        off = off if g["off"][0] == "+" else -off
    elif g["abbr"]:
        off, cst = ZONES.get(g["abbr"].upper()), g["abbr"].upper() == "CST"
        if off is None:
            return None
    us = ((h * 60 + mi) * 60 + s) * 1_000_000 + int((g["f"] or "")[:6].ljust(6, "0"))
    number = lambda x: int(g[x]) if g[x] else None
    month = _MONTH_OF[g["mon"].lower()] if g["mon"] else number("mo")
    back = _BACK_OF[g["rel"].lower()] if g["rel"] else None
    return (number("y"), month, number("d"), number("first"), number("second"), us, off, back, None, cst)


@F.pandas_udf(PARTS)
def _components(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    pattern = _pattern()
    nothing = (None,) * len(PARTS)
    for raw in batches:
        rows = [parse(x, pattern) or nothing for x in raw]
        out = pd.DataFrame(rows, columns=PARTS.names)
        yield out.astype({n: "Int64" for n in PARTS.names[:-1]} | {"cst": "boolean"})


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, in integers."""
    year = y - (m <= 2).cast("int")
    era = F.floor(year / 400)
    of_era = year - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def _month_length(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _date_ok(y: Column, m: Column, d: Column) -> Column:
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m))


def _with_instant(df: DataFrame, name: str, local_us: Column) -> DataFrame:
    """Adds ``name``, the UTC microseconds of a wall clock: by off, else in zone the first time it is shown; null if it never is.

    Each step is a column of its own: the planner then computes it once,
    where nested expressions would be repeated in the generated code.
    """
    df = df.withColumn("__local", local_us)
    df = df.withColumn("__wall", F.timestamp_micros("__local")).withColumn("__utc", F.to_utc_timestamp("__wall", F.col("zone")))
    shown = F.when(F.from_utc_timestamp("__utc", F.col("zone")) == F.col("__wall"), F.unix_micros("__utc"))
    return df.withColumn(name, F.when(F.col("off").isNotNull(), F.col("__local") - F.col("off") * 60_000_000).otherwise(shown)).drop("__local", "__wall", "__utc")


def _turn(before: Column, now: Column) -> Column:
    """Years to add so that a place in the year lies nearest to the one before; places are microseconds into a plain year."""
    half = F.lit(DAY_US * 365 // 2)
    return F.when(before - now > half, 1).when(now - before > half, -1).otherwise(0)


def _place(m: Column, d: Column, us: Column) -> Column:
    return (_days(F.lit(2001), m, d) - 11323) * DAY_US + us


def resolve_times(
    df: DataFrame, batches: DataFrame, row_id: str = "row_id", batch: str = "import_batch_id", sequence: str = "sequence", raw: str = "raw_time", default_zone: str = DEFAULT_ZONE
) -> DataFrame:
    """(row_id, utc_us) of every row; utc_us is null where ``raw`` denotes no instant.

    ``batches`` has id, locale, source_timezone, base_year and exported_at. A
    clock without zone is in the batch's zone (null: ``default_zone``; an
    unknown zone resolves nothing without an offset). A clock shown twice means
    the first time, one never shown nothing. A numeric day/month/year is read
    month first in the locales of ``MONTH_FIRST``; without a locale only where
    one reading is possible. A missing year is the nearest to the closest
    earlier row of the batch that denotes an instant, else base_year; half a
    year either way counts as 182.5 days. Rows without sequence number have no
    earlier row. Relative days need exported_at. Null and empty texts denote
    nothing, as do texts of any length that are no time; repeated rows resolve alike; an unknown batch has
    the defaults; an empty table gives no rows. Further columns of either
    table are not read.

    All notations are one alternation, matched once per row in Arrow batches;
    ranges, calendar and zones are column arithmetic. The fold over missing
    years is a scan in two levels, over blocks of sequence numbers and then
    over one row per block, so that no export is one task's work.
    """
    known = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    # Zones are looked up once per batch, not per row.
    b = batches.withColumn("__zone", F.coalesce("source_timezone", F.lit(default_zone))).select(
        F.col("id").alias("__b"), F.col("locale").alias("__locale"), F.expr(f"CASE WHEN __zone IN ({known}) THEN __zone END").alias("__zone"),
        F.col("base_year").cast("bigint").alias("__base"), F.col("exported_at").alias("__exported"),
    )
    rows = df.select(F.col(row_id).alias("__row"), F.col(batch).alias("__batch"), F.col(sequence).cast("bigint").alias("__seq"), F.col(raw).alias("__raw"))
    rows = rows.join(small(b), F.col("__batch") == F.col("__b"), "left")
    zone = F.when(F.col("__b").isNull(), F.lit(default_zone)).otherwise(F.col("__zone"))
    p = rows.select("__row", "__batch", "__seq", "__locale", "__base", "__exported", zone.alias("zone"), _components("__raw").alias("p")).select("*", "p.*").drop("p")
    p = p.withColumn("off", F.when(F.col("cst") & F.col("zone").isin("Asia/Shanghai", "Asia/Taipei", "Asia/Hong_Kong"), 480).otherwise(F.col("off")))
    first, second = F.col("first"), F.col("second")
    month_first = F.when(F.col("__locale").isNotNull(), F.col("__locale").isin(*MONTH_FIRST)).when(first > 12, False).when(second > 12, True).when(first == second, True)
    p = p.withColumns({"mo": F.when(first.isNull(), F.col("mo")).when(month_first, first).when(~month_first, second), "d": F.when(first.isNull(), F.col("d")).when(month_first, second).when(~month_first, first)})
    today = F.unix_date(F.to_date(F.from_utc_timestamp("__exported", F.col("zone"))))
    dated = F.when(_date_ok(F.col("y"), F.col("mo"), F.col("d")), _days(F.col("y"), F.col("mo"), F.col("d")) * DAY_US + F.col("us"))
    local = F.when(F.col("back").isNotNull(), (today - F.col("back")) * DAY_US + F.col("us")).otherwise(dated)
    p = _with_instant(p, "clock_us", local).withColumn("full_us", F.coalesce("unix_us", "clock_us"))
    yearless = F.col("y").isNull() & F.col("back").isNull() & _date_ok(F.lit(2000), F.col("mo"), F.col("d")) & F.col("zone").isNotNull()
    p = p.withColumn("yearless", F.coalesce(yearless, F.lit(False)))
    p = cut(p.select("__row", "__batch", "__seq", "__base", "zone", "mo", "d", "us", "off", "full_us", "yearless"))

    shown = F.from_utc_timestamp(F.timestamp_micros("full_us"), F.coalesce("zone", F.lit("UTC")))
    since = F.unix_micros(shown) - F.unix_date(F.to_date(shown)) * F.lit(DAY_US)
    dated = p.where("(yearless or full_us is not null) and __seq is not null and __batch is not null").select(
        "*",
        F.floor(F.col("__seq") / SEQUENCE_BLOCK).alias("block"),
        F.year(shown).alias("full_year"),
        F.when(F.col("yearless"), _place(F.col("mo"), F.col("d"), F.col("us"))).otherwise(_place(F.month(shown), F.dayofmonth(shown), since)).alias("place"),
    )
    inner = Window.partitionBy("__batch", "block").orderBy("__seq", "__row")
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("yearless"), F.coalesce(_turn(F.lag("place").over(inner), F.col("place")), F.lit(0))).otherwise(0)
    scanned = dated.withColumn("turns", F.sum(step).over(running))
    scanned = scanned.withColumn("anchor", F.last(F.when(~F.col("yearless"), F.col("full_year") - F.col("turns")), ignorenulls=True).over(running))
    edge = F.struct("__seq", "__row")
    heads = scanned.groupBy("__batch", "block").agg(
        F.min_by(F.struct("place", "yearless"), edge).alias("head"), F.max_by(F.struct("place", "turns", "anchor"), edge).alias("tail")
    )
    outer = Window.partitionBy("__batch").orderBy("block")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("enter", F.when(F.col("head.yearless"), F.coalesce(_turn(F.lag("tail.place").over(outer), F.col("head.place")), F.lit(0))).otherwise(0))
    heads = heads.withColumn("offset", F.coalesce(F.sum(F.col("enter") + F.col("tail.turns")).over(before), F.lit(0)) + F.col("enter"))
    heads = heads.withColumn("carried", F.last(F.col("tail.anchor") - F.col("offset"), ignorenulls=True).over(before))
    heads = heads.select(F.col("__batch").alias("hb"), F.col("block").alias("hk"), "offset", "carried")
    years = scanned.where("yearless").join(heads, (F.col("__batch") == F.col("hb")) & (F.col("block") == F.col("hk")))
    whole = F.col("turns") + F.col("offset")
    years = years.withColumn("y", F.coalesce(F.col("anchor") - F.col("offset"), F.col("carried"), F.col("__base")) + whole)
    alone = p.where("yearless and (__seq is null or __batch is null)").withColumn("y", F.col("__base"))
    columns = ["__row", "zone", "mo", "d", "us", "off", "y"]
    years = years.select(*columns).unionByName(alone.select(*columns))
    filled = F.when(_date_ok(F.col("y"), F.col("mo"), F.col("d")), _days(F.col("y"), F.col("mo"), F.col("d")) * DAY_US + F.col("us"))
    done = p.where(~F.col("yearless")).select("__row", "full_us").unionByName(_with_instant(years, "full_us", filled).select("__row", "full_us"))
    return done.select(F.col("__row").alias(row_id), F.col("full_us").alias("utc_us"))


def repairs(df: DataFrame, resolved: DataFrame, row_id: str = "row_id", stored: str = "occurred_at") -> DataFrame:
    """(row_id, utc_ms) of rows whose raw time denotes an instant while the stored one is null or a second or more away."""
    now = df.select(F.col(row_id).alias("__id"), F.unix_micros(stored).alias("__stored"))
    both = resolved.where("utc_us is not null").join(now, F.col(row_id) == F.col("__id"))
    wrong = F.col("__stored").isNull() | (F.abs(F.col("__stored") - F.col("utc_us")) >= 1_000_000)
    return both.where(wrong).select(row_id, F.floor(F.col("utc_us") / 1000).cast("bigint").alias("utc_ms"))
