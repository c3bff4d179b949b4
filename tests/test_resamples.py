from statistics import median

import pytest
from pyspark.sql import functions as F

from loopsight.operators.evaluation import bootstrap, bootstrap_outcomes, frame_outcomes, resamples
from loopsight.operators.matching import iou_pairs, mutual_best


@pytest.mark.parametrize("n, block", [(1, 1), (7, 1), (7, 3), (7, 7), (7, 20), (2500, 1700)])
def test_draws_are_what_their_hashes_say(spark, n, block):
    samples, blocks = 3, -(-n // block)
    starts = spark.range(samples).crossJoin(spark.range(blocks).withColumnRenamed("id", "b"))
    starts = starts.select("id", "b", F.pmod(F.xxhash64(F.lit(5), "id", "b"), F.lit(n))).collect()
    want = sorted((k, (start + o) % n * 10) for k, b, start in starts for o in range(min(block, n - b * block)))
    known = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 10).alias("v"))
    assert sorted(map(tuple, resamples(known, n, samples, 5, block).collect())) == want


def test_draws_are_never_broadcast(spark, capsys):
    values = spark.range(50).selectExpr("id", "id * 0.5 as v")
    out = bootstrap(values, "v", ["id"], {"mean": F.avg("v"), "largest": F.max("v")}, 40, 3, 5)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 1 and " Range (0, 400" in plan
    assert "Broadcast" not in plan[plan.index("SortMergeJoin") : plan.index(" Range (0, 400")]
    row = out.first()
    assert row["mean_ci_low"] <= row["mean_bootstrap_median"] <= row["mean_ci_high"] and row["largest_ci_high"] <= 24.5


def test_outcomes_are_resampled_without_broadcast_draws(spark, capsys):
    outcomes = spark.range(60).selectExpr("id as frame_index", "id % 4 as tp", "id % 3 as fp", "id % 5 as fn")
    out = bootstrap_outcomes(outcomes, 30, 3, 4)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 1 and " Range (0, 450" in plan
    assert "Broadcast" not in plan[plan.index("SortMergeJoin") : plan.index(" Range (0, 450")]
    rows = [r[1:] for r in sorted(map(tuple, outcomes.collect()))]
    drawn = spark.range(30).crossJoin(spark.range(15).withColumnRenamed("id", "b"))
    drawn = drawn.select("id", F.pmod(F.xxhash64(F.lit(3), "id", "b"), F.lit(60))).collect()
    recalls = []
    for sample in range(30):
        taken = [rows[(start + o) % 60] for k, start in drawn if k == sample for o in range(4)]
        tp, _, fn = map(sum, zip(*taken, strict=True))
        recalls.append(tp / (tp + fn))
    assert out.first()["recall_bootstrap_median"] == pytest.approx(median(recalls))
    assert bootstrap_outcomes(outcomes.limit(0), 30).first()["f1_ci_low"] is None


def test_boxes_are_never_broadcast_for_their_outcomes(spark, capsys):
    rows = spark.range(60).selectExpr("nullif(id div 4, 3) as frame", "id", "id % 3 as at")
    found = rows.selectExpr("frame as frame_index", "id as label", "at * 9 as bbox_top", "0 as bbox_left", "at * 9 + 4 as bbox_bottom", "4 as bbox_right")
    truth = rows.where("id % 4 < 3 and id < 50").selectExpr("frame as frame_index", "id as truth_id", "at * 9 as t_top", "1 as t_left", "at * 9 + 4 as t_bottom", "4 as t_right")
    matches = mutual_best(iou_pairs(found, truth))
    own = matches.select("frame_index", "label").collect()
    for frames in (None, spark.range(5, 20).selectExpr("id as frame_index").union(spark.range(5, 7).selectExpr("nullif(id, 6) as frame_index"))):
        out = frame_outcomes(found, truth, matches, frames)
        capsys.readouterr()
        out.explain()
        assert "Broadcast" not in capsys.readouterr().out
        boxes = [[r[0] for r in df.select("frame_index").collect()] for df in (found, truth)]
        of = lambda all_, f: 0 if f is None else all_.count(f)
        want = set()
        for f in {*boxes[0], *boxes[1]} if frames is None else {r[0] for r in frames.collect()}:
            tp = of([r[0] for r in own], f)
            want.add((f, tp, of(boxes[0], f) - tp, of(boxes[1], f) - tp))
        got = list(map(tuple, out.collect()))
        assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)
