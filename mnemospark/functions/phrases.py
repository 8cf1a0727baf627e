"""Phrases of time and place in texts: windows that a question asks for, words relative to a day, terms of a message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"
# Phrases that name a window, by window, in the order in which they are looked for.
WINDOWS = {
    "day_before_yesterday": ("前天",), "yesterday": ("昨天", "昨日"), "today": ("今天", "今日"), "previous_month": ("上个月", "上月"), "current_month": ("这个月", "本月", "这月"), "recent_month": ("最近一个月", "近一个月", "过去一个月"),
    "previous_week": ("上周", "上一周"), "current_week": ("本周", "这周", "这一周"), "recent_week": ("最近一周", "近一周", "过去一周", "最近7天", "最近七天", "过去7天", "过去七天"),
}
# Phrases of a few days, words that ask for a summary, and digits as written in words.
FEW_DAYS = ("这几天", "最近几天", "近几天")
SUMMARY_WORDS = ("怎么样", "如何", "总结", "概括", "回顾", "发生了什么", "聊了什么", "说了什么", "讲了什么", "问了什么", "做了什么", "有什么", "有哪些", "过得", "状态", "近况", "我最近", "最近我")
NUMBERS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
# Days of the windows that count back from today, and the most days that may be asked for.
FEW, WEEK, MONTH, MOST_DAYS = 3, 7, 30, 60
# Words relative to a day: pattern, days from that day, and the part of the day that is added.
RELATIVE = (
    ("昨晚|昨天晚上", -1, " 晚上"), ("昨天中午", -1, " 中午"), ("昨天早上|昨早", -1, " 早上"), ("昨天", -1, ""), ("今晚|今天晚上", 0, " 晚上"), ("今天中午|今中午", 0, " 中午"), ("今天早上|今早", 0, " 早上"), ("今天下午|今下午", 0, " 下午"), ("今天", 0, ""), ("明晚|明天晚上", 1, " 晚上"), ("明天中午", 1, " 中午"), ("明天早上", 1, " 早上"), ("明天", 1, ""),
)


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def time_window(text: Column, now: Column, zone: str = LOCAL_ZONE) -> Column:
    """struct(source, start_at, end_at, summary_like): the window [start_at, end_at) that a question names, in local days of ``zone``.

    The first phrase of ``WINDOWS`` that the text holds decides, then a number
    of days, then a few days; a mere "lately" counts as a week where a summary
    is asked for. source and both ends are null if no window is named.
    """
    flat = F.lower(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 1000), r"\s+", ""))
    today = F.to_date(F.from_utc_timestamp(now, zone))
    summary = _any(flat, SUMMARY_WORDS)
    digits = F.regexp_extract(flat, r"(?:最近|过去|近)(\d{1,2})天", 1)
    word = F.regexp_extract(flat, f"(?:最近|过去|近)([{''.join(NUMBERS)}])天", 1)
    names = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    days = F.when(digits != "", F.greatest(F.lit(1), F.least(F.lit(MOST_DAYS), digits.cast("int")))).when(word != "", names[word])
    source = F.when(F.lit(False), F.lit(""))
    for name, words in WINDOWS.items():
        source = source.when(_any(flat, words), name)
    source = source.when(days.isNotNull(), F.concat(F.lit("recent_"), days.cast("string"), F.lit("_days"))).when(_any(flat, FEW_DAYS), "recent_few_days").when(flat.contains("最近") & summary, "recent_default_summary")
    month, week = F.trunc(today, "month"), F.date_sub(F.next_day(today, "Mon"), 7)
    ends = {
        "day_before_yesterday": (F.date_sub(today, 2), F.date_sub(today, 1)), "yesterday": (F.date_sub(today, 1), today), "today": (today, F.date_add(today, 1)), "previous_month": (F.add_months(month, -1), month), "current_month": (month, F.date_add(today, 1)),
        "recent_month": (F.date_sub(today, MONTH), F.date_add(today, 1)), "previous_week": (F.date_sub(week, 7), week), "current_week": (week, F.date_add(today, 1)), "recent_week": (F.date_sub(today, WEEK), F.date_add(today, 1)),
        "recent_few_days": (F.date_sub(today, FEW), F.date_add(today, 1)), "recent_default_summary": (F.date_sub(today, WEEK), F.date_add(today, 1)),
    }
    instant = lambda day: F.to_utc_timestamp(day.cast("timestamp"), zone)
    edge = lambda i: reduce(lambda c, e: c.when(source == e[0], instant(e[1][i])), ends.items(), F.when(F.lit(False), now)).otherwise(F.when(source.isNotNull(), instant(F.date_sub(today, days) if i == 0 else F.date_add(today, 1))))
    return F.struct(source.alias("source"), edge(0).alias("start_at"), edge(1).alias("end_at"), summary.alias("summary_like"))


def dated(text: Column, day: Column) -> Column:
    """A text whose words relative to ``day`` are written as dates; null stays null."""
    out = text
    for pattern, shift, part in RELATIVE:
        out = F.regexp_replace(out, F.lit(pattern), F.concat(F.date_format(F.date_add(day, shift), "yyyy-MM-dd"), F.lit(part)))
    return out


def merged_terms(*lists: Column, limit: int = 24) -> Column:
    """Distinct trimmed terms of several lists in order, each by its first writing whatever its case, nulls and blanks left out, at most ``limit``."""
    every = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    lows = F.transform(every, lambda t: F.lower(t))
    first = F.filter(F.transform(every, lambda t, i: F.when(F.array_position(lows, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return F.slice(first, 1, limit)
