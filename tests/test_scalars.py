from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trackloom.functions import exprs, windows


def one(spark, column, **values):
    row = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()} or {"x": F.lit(1)})
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("hour,name", [(7, "morning"), (15, "afternoon"), (0, "night"), (20, "night"), (3, "other"), (10, "other"), (None, "unknown")])
def test_session_type(spark, hour, name):
    assert one(spark, exprs.session_type(F.lit(hour).cast("int"))) == name


@pytest.mark.parametrize("text,want", [
    ("O8-02-2026 Sun 07:00:01", datetime(2026, 8, 2, 7, 0, 1)),
    ("08-02-2026 Mon 07:00:01", None),
    ("08-02-2626 07:00:01", None),
    ("02-30-2026 07:00:01", None),
    ("08-O2-2O26 x O7:00:Ol", datetime(2026, 8, 2, 7, 0, 1)),
    ("08-02-2026 25:00:01", None),
    ("nothing", None),
    (None, None),
])
def test_overlay_time(spark, text, want):
    assert one(spark, exprs.overlay_time(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("/a/Video 2026-08-05 at 15.47.21.mp4", datetime(2026, 8, 5, 15, 47, 21)), ("v 2026-08-05 saat 05-47-21 (1).mp4", datetime(2026, 8, 5, 5, 47, 21)), ("clip.mp4", None), ("2026-02-31 at 10.00.00.mp4", None)])
def test_file_time(spark, name, want):
    assert one(spark, exprs.file_time(F.lit(name))) == want


@pytest.mark.parametrize("text,want", [("cow1", "COW_0001"), (" Cow-007 ", "COW_0007"), ("COW_12345", "COW_12345"), ("cow000", "COW_0000"), ("Bella", "Bella"), (None, ""), ("cow x1", "cow x1")])
def test_normal_id(spark, text, want):
    assert one(spark, exprs.normal_id(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,default,want", [("False", True, False), (" YES", False, True), ("1", False, True), ("0", True, False), ("maybe", True, True), (None, True, True), ("", False, False)])
def test_bool_text(spark, text, default, want):
    assert one(spark, exprs.bool_text(F.lit(text).cast("string"), default)) is want


def test_boxes_round_half_to_even_and_stay_inside(spark):
    box = [F.lit(v) for v in (0.5, 1.5, 2.5, 3.5)]
    assert [one(spark, c) for c in exprs.clipped_box(box, F.lit(100), F.lit(100))] == [0, 2, 2, 4]
    assert [one(spark, c) for c in exprs.clipped_box([F.lit(v) for v in (-5.0, 200.0, -1.0, 300.0)], F.lit(100), F.lit(50))] == [0, 49, 1, 50]
    a, b = [F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)], [F.lit(v) for v in (1.0, 1.0, 3.0, 3.0)]
    assert one(spark, exprs.box_iou(a, b)) == pytest.approx(1 / 7)


def test_offsets_windows_and_times(spark):
    assert one(spark, exprs.sample_offsets(F.lit(60.0))) == [1.0, 30.0, 59.0]
    assert one(spark, exprs.sample_offsets(F.lit(0.0))) == [0.0]
    assert [one(spark, c) for c in exprs.evidence_window(F.lit(1.0), F.lit(4.0), F.lit(5.0))] == [0.0, 5.0]
    assert one(spark, exprs.plus_seconds(F.lit("2026-09-02 07:00:00"), F.lit(1.9))) == "2026-09-02 07:00:01"
    assert one(spark, exprs.plus_seconds(F.lit(""), F.lit(1.0))) == "" == one(spark, exprs.plus_seconds(F.lit("x"), F.lit(None).cast("double")))


def test_medians(spark):
    m = lambda v: one(spark, windows.array_median(F.lit(v).cast("array<double>")))
    assert m([3.0, 1.0, 2.0]) == 2.0 and m([4.0, 1.0]) == 2.5 and m([]) is None


def test_uuid_is_stable(spark):
    assert one(spark, exprs.uuid5_url(F.lit("a"))) == one(spark, exprs.uuid5_url(F.lit("a"))) != one(spark, exprs.uuid5_url(F.lit("b")))
