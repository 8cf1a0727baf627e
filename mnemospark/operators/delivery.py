"""Exactly one copy of each message delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, fingerprint, small
from .components import connected_components

HEX = "0123456789abcdef"
#: Digits of a sequence number at most.
MOST_DIGITS = 13
#: Numbers of a producer that one window partition holds at most.
RANGE_BLOCK = 1 << 16
#: Stands in place of a number where an identifier is looked up as a whole.
WHOLE = -1


def _sequence(message: Column) -> tuple[Column, Column]:
    """(stem, number) of an id: a stem that is empty or ends in a letter other than a hexadecimal digit, and a hexadecimal number; number is null for other ids."""
    stem = F.rtrim(message, F.lit(HEX))
    digits = F.substring(message, F.length(stem) + 1, F.lit(MOST_DIGITS + 1))
    last = F.substring(stem, -1, 1)
    ends = (stem == "") | last.between("g", "z") | last.between("G", "Z") | last.isin("_", ":", "-")
    canonical = F.length(digits).between(1, MOST_DIGITS) & ((digits == "0") | ~digits.startswith("0")) & ends
    return stem, F.when(canonical, F.conv(digits, 16, 10).cast("bigint"))


def numbered(df: DataFrame, session: str = "session_id", subject: str = "subject_id", kind: str = "event_type", message: str = "message_id") -> DataFrame:
    """Adds producer (struct of two hashes) and number.

    The producer is session, subject, event type and the id's stem; number is
    the id's sequence number. An id without a number, or one written with
    leading zeros (two ids could mean one number), is malformed: number is
    null and the whole id takes the stem's place. A missing part gives a null
    producer.
    """
    stem, number = _sequence(F.col(message))
    whole = F.col(session).isNotNull() & F.col(subject).isNotNull() & F.col(kind).isNotNull() & F.col(message).isNotNull()
    parts = df.withColumns({"number": F.when(whole, number)}).withColumn("__stem", F.when(F.col("number").isNull(), F.col(message)).otherwise(stem))
    maker = fingerprint(F.col(session), F.col(subject), F.col(kind), F.col("__stem"), F.col("number").isNull().cast("string"))
    return parts.withColumn("producer", F.when(whole, maker)).drop("__stem")


def _block(number: Column) -> Column:
    return F.floor(number / F.lit(RANGE_BLOCK)).cast("bigint")


def _key(dedupe: Column) -> Column:
    return F.when(dedupe.isNotNull(), fingerprint(dedupe, F.lit("dedupe key")))


def seen_ranges(df: DataFrame, ledger: DataFrame | None = None, dedupe: str | None = None, **names: str) -> DataFrame:
    """Disjoint ranges of numbers seen per producer: producer, block, lo, hi; ``ledger`` holds earlier batches' ranges.

    Ranges that touch or overlap are merged; none crosses a block of
    ``RANGE_BLOCK`` numbers, so the ledger of a hot producer stays spread.
    Malformed ids are in it only if ``dedupe`` names the dedupe key's column:
    then they and the dedupe keys are ranges of the one number ``WHOLE`` of a
    producer of their own, which is what :func:`redelivered` looks up. Empty
    input returns the ledger's ranges.
    """
    rows = numbered(df, **names)
    made = [rows.where("number is not null").select("producer", _block(F.col("number")).alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi"))]
    if dedupe is not None:
        alone = [rows.where("number is null").select("producer"), rows.select(_key(F.col(dedupe)).alias("producer"))]
        made += [a.where("producer is not null").select("producer", *[F.lit(WHOLE).cast("bigint").alias(x) for x in ("block", "lo", "hi")]) for a in alone]
    now = made[0]
    for m in made[1:]:
        now = now.unionByName(m)
    now = now.distinct()
    if ledger is not None:
        now = now.unionByName(ledger.select("producer", "block", "lo", "hi"))
    order = Window.partitionBy("producer", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = now.withColumn("island", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("producer", "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _accept(identifiers: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """``identifiers`` (a, b, number, ...) with covered: whether an earlier batch's range holds the number.

    In each block the ranges and the batch's own numbers are gone through in
    order, and how far the ranges reach so far tells whether a number is
    covered. An uncovered number is accepted, once, as each stands here once.
    """
    if ledger is None:
        return identifiers.withColumn("covered", F.lit(False))
    mine = identifiers.withColumns({"block": F.when(F.col("number") == WHOLE, F.lit(WHOLE)).otherwise(_block(F.col("number"))).cast("bigint"), "hi": F.lit(None).cast("bigint")})
    nothing = [F.lit(None).cast(identifiers.schema[c].dataType).alias(c) for c in identifiers.columns if c not in ("a", "b", "number")]
    theirs = ledger.select(F.col("producer.a").alias("a"), F.col("producer.b").alias("b"), F.col("lo").alias("number"), *nothing, "block", "hi")
    # Of a range and a number at its beginning, the range comes first.
    order = Window.partitionBy("a", "b", "block").orderBy("number", F.col("hi").isNull())
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = mine.unionByName(theirs).withColumn("covered", F.coalesce(reach >= F.col("number"), F.lit(False)))
    return both.where("hi is null").drop("block", "hi")


def redelivered(
    df: DataFrame,
    row_id: str = "id",
    arrived: str = "created_at",
    dedupe: str = "dedupe_key",
    session: str = "session_id",
    subject: str = "subject_id",
    kind: str = "event_type",
    message: str = "message_id",
    ledger: DataFrame | None = None,
) -> DataFrame:
    """(id, kept_id) of every row that delivers a message again; kept_id is the row that stays.

    Two rows deliver the same message if they share a non-null dedupe key, or
    session, subject, event type and message id, all non-null; this carries
    over from row to row. The earliest ``arrived`` stays, then the least id; a
    null ``arrived`` counts as latest. Rows with neither key are never copies.
    Empty strings are values. An empty table gives no rows; further columns
    are not read. With the ``ledger`` of earlier batches (see
    :func:`seen_ranges`) every row of a message that came in one of them is
    given, with a null kept_id.

    Rows are first combined map-side into one row per pair of keys, so a
    message with any number of copies is one row from then on. Each key is an
    identifier: a number of a producer, or a whole malformed id or dedupe key.
    Numbers are accepted in disjoint ranges per producer and block of numbers,
    whole ones by exact key. Where an identifier has several partners, that one
    stands for the message; only pairs in which both have several go through
    connected components.
    """
    stamp = F.struct(F.col(arrived).isNull().alias("late"), F.col(arrived).alias("at"), F.col("__row").cast("string").alias("id"))
    wanted = df.select(F.col(row_id).alias("__row"), F.col(arrived), _key(F.col(dedupe)).alias("ka"), F.col(session).alias("__s"), F.col(subject).alias("__u"), F.col(kind).alias("__k"), F.col(message).alias("__m"))
    rows = numbered(wanted, "__s", "__u", "__k", "__m").where("ka is not null or producer is not null")
    node = lambda key, number: F.when(F.col(key).isNotNull(), F.struct(F.col(f"{key}.a").alias("a"), F.col(f"{key}.b").alias("b"), number.cast("bigint").alias("number")))
    rows = rows.select(node("ka", F.lit(WHOLE)).alias("na"), node("producer", F.coalesce("number", F.lit(WHOLE))).alias("nb"), "__row", stamp.alias("stamp"))
    pairs = cut(rows.groupBy("na", "nb").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"), F.count(F.lit(1)).alias("n")))
    both = pairs.select(F.explode(F.array("na", "nb")).alias("node")).where("node is not null").groupBy("node.a", "node.b", "node.number").agg(F.count(F.lit(1)).alias("partners"))
    busy = cut(_accept(both, ledger).where("partners > 1 or covered").select(F.struct("a", "b", "number").alias("node"), "covered"))
    side = lambda c: small(busy.select(F.col("node").alias(f"n{c}"), F.col("covered").alias(f"h{c}")))
    touched = pairs.join(side("a"), "na", "left").join(side("b"), "nb", "left").where("n > 1 or ha is not null or hb is not null")
    touched = cut(touched.select("na", "nb", "first", "last", "n", "ha", "hb"))
    bridges = touched.where("ha is not null and hb is not null and na is not null and nb is not null")
    label = F.when(F.col("ha").isNotNull(), F.col("na")).when(F.col("hb").isNotNull(), F.col("nb")).otherwise(F.coalesce("na", "nb"))
    if bridges.isEmpty():
        labelled = touched.withColumn("label", label)
    else:
        found = cut(connected_components(bridges, "na", "nb"))
        of = lambda c: small(found.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}")))
        labelled = touched.join(of("a"), "na", "left").join(of("b"), "nb", "left").withColumn("label", F.coalesce("ca", "cb", label))
    keep = labelled.groupBy("label").agg(F.min("first").alias("keep"), F.sum("n").alias("copies"), F.max(F.coalesce("ha", F.lit(False)) | F.coalesce("hb", F.lit(False))).alias("before"))
    settled = cut(labelled.join(keep.where("copies > 1 or before"), "label").select("na", "nb", "first", "last", "n", "before", F.when(~F.col("before"), F.col("keep.id")).alias("kept_id")))
    kind_of = df.schema[row_id].dataType
    told = settled.select(F.explode(F.when(F.col("n") == 1, F.array("first")).otherwise(F.array("first", "last"))).alias("x"), "kept_id").select(F.col("x.id").cast(kind_of).alias(row_id), "kept_id", F.col("x.id").alias("__id"))
    # First and last of a pair are known; rows between them are looked up.
    many = settled.where("n > 2").select(F.col("na").alias("_a"), F.col("nb").alias("_b"), "first", "last", "kept_id")
    between = rows.join(small(many), F.col("na").eqNullSafe(F.col("_a")) & F.col("nb").eqNullSafe(F.col("_b"))).where((F.col("stamp.id") != F.col("first.id")) & (F.col("stamp.id") != F.col("last.id")))
    every = told.unionByName(between.select(F.col("__row").alias(row_id), "kept_id", F.col("stamp.id").alias("__id")))
    return every.where("kept_id is null or __id <> kept_id").select(row_id, "kept_id")


def drop_redelivered(df: DataFrame, row_id: str = "id", **names: str) -> DataFrame:
    """``df`` with exactly one row per message; see :func:`redelivered`."""
    copies = redelivered(df, row_id, **names).select(F.col(row_id).alias("__copy"))
    return df.join(copies, df[row_id] == copies["__copy"], "left_anti")
