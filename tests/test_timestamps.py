from datetime import datetime, timezone

import pytest

from mnemospark.operators.timestamps import SEQUENCE_BLOCK, repairs, resolve_times

BATCHES = [
    ("cn", "zh_CN", None, 2023, datetime(2023, 10, 30, 2, 0)), ("ny", "en_US", "America/New_York", 2024, datetime(2024, 11, 4, 3, 0)), ("uk", "en_GB", "Europe/London", None, None),
    ("de", "de_DE", "Europe/Berlin", 2025, None), ("bad", "en_GB", "Mars/Base", 2025, None), ("none", None, "UTC", None, None),
]
CASES = [
    ("cn", "2023-10-30 08:00:01", "2023-10-30T00:00:01"), ("cn", "２０２３-１０-３０ ０８：００：０１", "2023-10-30T00:00:01"), ("cn", "昨天 12:15", "2023-10-29T04:15:00"), ("cn", "2023年8月3日 下午3:06:39", "2023-08-03T07:06:39"),
    ("cn", "2023年8月3日 上午12:06", "2023-08-02T16:06:00"), ("cn", "20230617T081101", "2023-06-17T00:11:01"), ("cn", "刚刚", None), ("cn", "just now", None), ("cn", "NaN", None), ("cn", "", None), ("cn", None, None),
    ("ny", "11/3/2024, 1:30:00 AM", "2024-11-03T05:30:00"), ("ny", "2024-03-10 02:30:00", None), ("ny", "Today 00:10", "2024-11-03T04:10:00"), ("ny", "Mar 12, 2023 1:16 am", "2023-03-12T06:16:00"), ("ny", "2023-03-12 10:59:45 EDT", "2023-03-12T14:59:45"),
    ("ny", "2024-11-03T01:30:00-05:00", "2024-11-03T06:30:00"), ("uk", "03/04/2024 10:00", "2024-04-03T09:00:00"), ("uk", "Yesterday 10:00", None), ("uk", "31/02/2025 10:00", None), ("uk", "29/02/2024 10:00", "2024-02-29T10:00:00"), ("uk", "19 Sep 2024 11:34:21", "2024-09-19T10:34:21"),
    ("uk", "Sun, 12 Jan 2025 20:02:38 -0500", "2025-01-13T01:02:38"), ("uk", "1743273139975", "2025-03-29T18:32:19.975"), ("uk", "1743273139975123", "2025-03-29T18:32:19.975"), ("uk", "1743273139", "2025-03-29T18:32:19"), ("uk", "1685935480.611", "2023-06-05T03:24:40.611"), ("uk", "999999999", None),
    ("uk", "2025-13-40 25:61:00", None), ("uk", "0000-00-00 00:00:00", None), ("uk", "--:--", None), ("de", "17. Oktober 2024, 11:41 Uhr", "2024-10-17T09:41:00"), ("de", "28.09.2025 14:21:14", "2025-09-28T12:21:14"), ("de", "2023-10-29 02:30:00", "2023-10-29T00:30:00"), ("de", "11 ago 2023 01h51", "2023-08-10T23:51:00"),
    ("bad", "2025-01-01 10:00:00", None), ("bad", "2025-01-01 10:00:00 +05:45", "2025-01-01T04:15:00"), ("none", "13/02/2024 10:00", "2024-02-13T10:00:00"), ("none", "02/03/2024 10:00", None), ("missing", "2024-01-01 08:00:00", "2024-01-01T00:00:00"), ("cn", "x" * 5000, None),
]


def resolve(spark, rows):
    batches = spark.createDataFrame([(*b, "extra") for b in BATCHES], "id string, locale string, source_timezone string, base_year int, exported_at timestamp, sequence string")
    df = spark.createDataFrame([(i, b, s, raw, 1) for i, (b, s, raw) in enumerate(rows)], "row_id bigint, import_batch_id string, sequence int, raw_time string, y int")
    return {x.row_id: x.utc_us for x in resolve_times(df, batches).collect()}


def micros(text):
    return None if text is None else round(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1e6)


def test_notations(spark):
    got = resolve(spark, [(b, i, raw) for i, (b, raw, _) in enumerate(CASES)])
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if (None if got[i] is None else got[i] // 1000) != (None if c[2] is None else micros(c[2]) // 1000)]
    assert not wrong


def test_missing_years_follow_the_row_before(spark):
    rows = [("de", 1, "12-31 23:00:00"), ("de", 2, "01-01 01:00:00"), ("de", 3, "2024-06-30 10:00:00"), ("de", 4, "junk"), ("de", 5, "07-01 10:00:00"), ("de", 6, "12-30 10:00:00"), ("de", 7, "01-02 10:00:00"), ("uk", 1, "05-05 10:00:00"), ("de", None, "03-03 10:00:00"), ("de", 8, "02-30 10:00:00")]
    got = resolve(spark, rows)
    years = [datetime.fromtimestamp(got[i] / 1e6, timezone.utc).year if got[i] is not None else None for i in range(len(rows))]
    assert years == [2025, 2026, 2024, None, 2024, 2024, 2025, None, 2025, None]


def test_missing_years_cross_blocks(spark):
    """A year that turns several times over blocks of sequence numbers without any full date."""
    rows = [("de", i * (SEQUENCE_BLOCK // 2), f"{1 + (i * 2) % 12:02}-15 10:00:00") for i in range(30)]
    got = resolve(spark, rows)
    assert [datetime.fromtimestamp(got[i] / 1e6, timezone.utc).year for i in range(30)] == [2025 + i * 2 // 12 for i in range(30)]


def test_repairs_and_empty(spark):
    resolved = spark.createDataFrame([(1, 1_700_000_000_123_999), (2, 1_700_000_000_000_000), (3, None), (4, 1_700_000_000_000_000)], "row_id bigint, utc_us bigint")
    at = lambda us: datetime.fromtimestamp(us, timezone.utc).replace(tzinfo=None)
    rows = spark.createDataFrame([(1, None), (2, at(1_700_000_000.5)), (3, None), (4, at(1_700_000_001))], "row_id bigint, occurred_at timestamp")
    assert sorted(map(tuple, repairs(rows, resolved).collect())) == [(1, 1_700_000_000_123), (4, 1_700_000_000_000)]
    assert resolve(spark, []) == {}


@pytest.mark.parametrize("copies", [2])
def test_repeated_rows_resolve_alike(spark, copies):
    got = resolve(spark, [("ny", 5, "11-03 09:00:00")] * copies)
    assert len(set(got.values())) == 1
