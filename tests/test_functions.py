from pyspark.sql import functions as F

from loopsight.functions import boxes, cyclic
from loopsight.operators import checks, matching


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cyclic(spark):
    assert one(spark, cyclic.wrap(F.lit(-3.5), 10)) == 6.5
    assert one(spark, cyclic.wrap(F.lit(-3.5), None)) == -3.5
    assert one(spark, cyclic.cyclic_difference(F.lit(1.0), F.lit(9.0), 10)) == 2.0
    assert one(spark, cyclic.artifact_row(F.lit(9.5), F.lit(0.0), 10)) == 0
    assert one(spark, cyclic.finite(F.lit(float("nan")))) is None


def test_boxes(spark):
    a, b = (tuple(map(F.lit, x)) for x in ((0, 0, 2, 2), (1, 0, 3, 2)))
    assert abs(one(spark, boxes.iou(a, b)) - 1 / 3) < 1e-12
    assert one(spark, boxes.iou(a[:2] + a[:2], a[:2] + a[:2])) == 0.0
    zero, two = F.lit(0), F.lit(2)
    assert one(spark, boxes.precision(zero, zero, zero)) == 1.0
    assert one(spark, boxes.precision(zero, zero, two)) == 0.0
    assert one(spark, boxes.recall(zero, two, zero)) is None


def test_no_frames(spark):
    none = spark.createDataFrame([], "frame_index long")
    assert checks.missing_numbers(none).count() == 0
    boxes_ = spark.createDataFrame([], "frame_index long, label long, bbox_top long, bbox_left long, bbox_bottom long, bbox_right long")
    truth = spark.createDataFrame([], "frame_index long, truth_id long, t_top long, t_left long, t_bottom long, t_right long")
    row = matching.precision_recall(boxes_, truth).first()
    assert (row["tp"], row["precision"], row["recall"]) == (0, 1.0, 1.0)
