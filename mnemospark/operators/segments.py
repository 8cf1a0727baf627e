"""Turns and segments of chat logs, and what follows a message."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BURST_SECONDS, HARD_MINUTES, SOFT_MINUTES = 120, 120, 30
MAX_TURNS, MAX_CHARS = 30, 4200
#: Minutes within which a turn answers the one before, and the hours by which local days are ahead of UTC.
ANSWER_MINUTES, LOCAL_HOURS = 5, 8
# Words that begin a talk, and words that end one.
OPENING = ("早", "早安", "早上好", "在吗", "醒了吗", "新年快乐")
CLOSING = ("晚安", "睡吧", "先这样", "回聊", "不聊了", "下次聊", "拜拜", "再见")


def pieces(messages: DataFrame, key: str, at: str, gap_minutes: int = HARD_MINUTES) -> DataFrame:
    """``messages`` with piece, the number of runs of their key without a pause above the gap; rows without key or time are left out.

    As in activity sessions, blocks of the gap's length are numbered, not rows,
    so no task holds a key.
    """
    gap = gap_minutes * 60_000_000
    rows = messages.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__us", F.unix_micros(at)).withColumn("__block", F.floor(F.col("__us") / F.lit(gap)))
    blocks = rows.groupBy(F.col(key).alias("__k"), "__block").agg(F.min("__us").alias("lo"), F.max("__us").alias("hi"))
    order = Window.partitionBy("__k").orderBy("__block")
    blocks = blocks.withColumn("new", F.coalesce((F.col("lo") - F.lag("hi").over(order) > gap).cast("int"), F.lit(1)))
    blocks = blocks.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(F.col("__k"), F.col("__block").alias("__b"), "piece")
    return rows.join(blocks, (F.col(key) == F.col("__k")) & (F.col("__block") == F.col("__b"))).drop("__k", "__b", "__block")


def turns(messages: DataFrame, key: str, at: str, speaker: str, content: str, tie: str, seconds: int = BURST_SECONDS, block_minutes: int = 10) -> DataFrame:
    """Bursts of one speaker merged: key, piece, turn, speaker, start_us, end_us, n_messages, n_chars, closes, opens.

    Messages follow one another in time within a piece; the same speaker's
    next message at most ``seconds`` later belongs to the same turn. closes and
    opens tell whether the turn's text has a word that ends or begins a talk.
    The last message of each time block is carried to the next one, so rows are
    ordered inside short blocks only and a piece of any length is many tasks.
    """
    compact = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", "")
    has = lambda words: reduce(lambda x, y: x | y, [compact.contains(w) for w in words])
    rows = pieces(messages, key, at).select(key, "piece", "__us", F.col(tie).alias("__tie"), F.col(speaker).alias("__who"), F.length(F.coalesce(content, F.lit(""))).alias("__chars"), has(CLOSING).alias("__closes"), has(OPENING).alias("__opens"))
    rows = rows.withColumn("__block", F.floor(F.col("__us") / F.lit(block_minutes * 60_000_000)))
    inner = Window.partitionBy(key, "piece", "__block").orderBy("__us", "__tie")
    place = F.struct("__us", "__tie")
    last = rows.groupBy(key, "piece", "__block").agg(F.max_by(F.struct(F.col("__us").alias("us"), F.col("__who").alias("who"), F.lit(True).alias("any")), place).alias("end"))
    outer = Window.partitionBy(key, "piece").orderBy("__block")
    last = last.select(F.col(key).alias("__k"), F.col("piece").alias("__p"), F.col("__block").alias("__b"), F.lag("end").over(outer).alias("before"))
    same = [F.col(key) == F.col("__k"), F.col("piece") == F.col("__p"), F.col("__block") == F.col("__b")]
    rows = rows.join(last, same[0] & same[1] & same[2])
    was = F.coalesce(F.lag(F.struct(F.col("__us").alias("us"), F.col("__who").alias("who"), F.lit(True).alias("any"))).over(inner), F.col("before"))
    goes_on = was.isNotNull() & F.col("__who").eqNullSafe(was["who"]) & (F.col("__us") - was["us"] <= seconds * 1_000_000)
    rows = rows.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("bigint"))
    rows = rows.withColumn("__n", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy(F.col(key).alias("__k"), F.col("piece").alias("__p"), F.col("__block").alias("__b")).agg(F.sum("__new").alias("new"))
    counts = counts.select("__k", "__p", "__b", F.coalesce(F.sum("new").over(Window.partitionBy("__k", "__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = rows.drop("__k", "__p", "__b").join(counts, same[0] & same[1] & same[2]).withColumn("turn", F.col("offset") + F.col("__n"))
    return rows.groupBy(key, "piece", "turn").agg(
        F.first("__who").alias("speaker"), F.min("__us").alias("start_us"), F.max("__us").alias("end_us"), F.count(F.lit(1)).alias("n_messages"), F.sum("__chars").alias("n_chars"), F.bool_or("__closes").alias("closes"), F.bool_or("__opens").alias("opens")
    )


def limited_segments(turn_rows: DataFrame, key: str, users: Column | None = None, zone_hours: int = LOCAL_HOURS, max_turns: int = MAX_TURNS, max_chars: int = MAX_CHARS, soft_minutes: int = SOFT_MINUTES, answer_minutes: int = ANSWER_MINUTES) -> DataFrame:
    """Turns with segment.

    A new one begins at a soft gap over local midnight, after a turn that
    closes a talk or before one that opens one, and where the size limits would
    be exceeded, unless that would part a user's turn (``users`` tells whether
    a speaker is one; without it none is) from an answer within ``answer_minutes``. The limits depend on
    where the last segment began, so turns are streamed in order through
    Python; a partition is read in batches and only the running state is kept.
    """
    soft, answer, shift, day = soft_minutes * 60_000_000, answer_minutes * 60_000_000, zone_hours * 3_600_000_000, 86_400_000_000

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, segment, n, chars, end, closed, asked = None, 0, 0, 0, 0, False, False
        for part in parts:
            out = []
            for k, p, start, stop, size, closes, opens, mine in zip(*[part[c] for c in (key, "piece", "start_us", "end_us", "n_chars", "closes", "opens", "mine")], strict=True):
                gap = start - end
                if (k, p) != held:
                    held, segment, n, chars = (k, p), 0, 0, 0
                else:
                    parts_days = (start + shift) // day != (end + shift) // day
                    full = (n >= max_turns or chars + size > max_chars) and (mine or not asked or gap > answer)
                    if gap > soft and (parts_days or closed or opens) or full:
                        segment, n, chars = segment + 1, 0, 0
                n, chars, end, closed, asked = n + 1, chars + size, stop, closes, mine
                out.append(segment)
            yield part.drop(columns=["closes", "opens", "mine"]).assign(segment=out)

    columns = [key, "piece", "turn", "start_us", "end_us", "n_messages", "n_chars"]
    kind = turn_rows.schema[key].dataType.simpleString()
    mine = F.lit(False) if users is None else F.coalesce(users, F.lit(False))
    ordered = turn_rows.select(*columns, "closes", "opens", mine.alias("mine")).repartition(key, "piece").sortWithinPartitions(key, "piece", "turn")
    return ordered.mapInPandas(run, f"{key} {kind}, piece bigint, turn bigint, start_us bigint, end_us bigint, n_messages bigint, n_chars bigint, segment int")


def first_package(segments: DataFrame, key: str, order: str, chars: str, limit: int = 4600, most: int = 6, overhead: int = 300) -> DataFrame:
    """Per key the segments that fit into the next package: a prefix by cost, at least one, at most ``most``."""
    w = Window.partitionBy(key).orderBy(order)
    head = segments.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    used = F.sum(F.col(chars) + overhead).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("used", used).where((F.col("nth") == 1) | (F.col("used") <= limit))


def first_reply(messages: DataFrame, session: str, at: str, within_minutes: int = 10) -> DataFrame:
    """(id, reply_id, wait_us): the first bot response at or after each user message of a session, within the limit.

    Inside a time block of the limit's length the first reply from a message on
    follows from one window; if there is none, it can only be the first reply
    of the next block, which is one row per block. So the work is in proportion
    to the rows, however busy a session is.
    """
    length = within_minutes * 60_000_000
    rows = messages.where(F.col(session).isNotNull() & F.col(at).isNotNull() & F.col("event_type").isin("user_message", "bot_response")).select(F.col(session).alias("s"), "id", (F.col("event_type") == "user_message").alias("asks"), F.unix_micros(at).alias("us"))
    rows = rows.withColumn("b", F.floor(F.col("us") / length))
    reply = F.when(~F.col("asks"), F.struct(F.col("us").alias("rus"), F.col("id").alias("reply_id")))
    onward = Window.partitionBy("s", "b").orderBy(F.col("us")).rangeBetween(0, Window.unboundedFollowing)
    later = rows.where(~F.col("asks")).groupBy("s", "b").agg(F.min(reply).alias("next")).select(F.col("s").alias("ns"), (F.col("b") - 1).alias("nb"), "next")
    asked = rows.withColumn("here", F.min(reply).over(onward)).where("asks").join(later, (F.col("s") == F.col("ns")) & (F.col("b") == F.col("nb")), "left")
    found = asked.select("id", "us", F.coalesce("here", "next").alias("r")).where(F.col("r.rus") - F.col("us") <= length)
    return found.select("id", F.col("r.reply_id").alias("reply_id"), (F.col("r.rus") - F.col("us")).alias("wait_us"))
