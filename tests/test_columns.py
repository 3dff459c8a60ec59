from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanewise.functions import columns as C


def values(spark, texts, f, kind="string"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("f", "texts", "expected"),
    [
        (C.filled, [" a ", "  ", "", None], ["a", None, None, None]),
        (C.parsed_boolean, ["Yes", "T", "1", "no", "F", "0", "maybe", None], [True, True, True, False, False, False, None, None]),
        (C.parsed_integer, ["7", "1.5", "-2.", "x", "1e3", "99999999999", None], [7, 1, -2, None, None, None, None]),
        (lambda c: C.parsed(c, "double"), ["1.5", "1e3", "x", None], [1.5, 1000.0, None, None]),
        (C.region_code, ["Western", " mid-west ", "NE", "north east", "Middle East", None], ["WEST", "MIDWEST", "NORTHEAST", "NORTHEAST", "MIDDLE_EAST", None]),
        (C.status_code, ["pick up", "Completed", "on hold", "canceled", "odd one"], ["PICK_UP", "DELIVERED", "HOLD", "CANCELLED", "ODD_ONE"]),
        (C.state_code, ["t.x.", " ca", "Texas", "", None], ["TX", "CA", None, None, None]),
        (C.clean_text, ["a\t b\x07c ", "\n ", None], ["a b c", None, None]),
        (C.carrier_name, ["  Sun   Belt ", " "], ["Sun Belt", None]),
    ],
)
def test_text_functions(spark, f, texts, expected):
    assert values(spark, texts, f) == expected


def test_timestamps(spark):
    got = values(spark, ["2026-01-01T08:10:00Z", "2026-01-01T08:10:00+02:00", "2026-01-01 08:00:00", "2026-1-1", "soon", None], lambda c: C.parsed_timestamp(c, [C.DEFAULT_TIMESTAMP_FORMAT, "yyyy-MM-dd HH:mm:ss"]).cast("timestamp_ntz"))
    day = lambda h, m=0: datetime(2026, 1, 1, h, m)
    assert got == [day(8, 10), day(6, 10), day(8), day(0), None, None]


def test_delay_and_ratio(spark):
    row = spark.sql("SELECT timestamp'2026-01-01 00:00:00' a, timestamp'2026-01-01 06:10:30' b, CAST(NULL AS timestamp) n, 3L x, 0L z").select(
        C.delay_minutes(F.col("b"), F.col("a")), C.delay_minutes(F.col("a"), F.col("b")), C.delay_minutes(F.col("n"), F.col("a")), C.transit_hours(F.col("a"), F.col("b")), C.ratio(F.col("x"), F.col("z")), C.ratio(F.col("x"), F.col("x"))
    )
    assert row.first()[:] == (370.5, 0.0, None, 6.175, 0.0, 1.0)
