import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopsight.kernels import synthetic
from loopsight.kernels.images import Gates, rendered
from loopsight.operators import build, runs
from loopsight.sources import reports


def frames_of(spark, case):
    rows = [(i, *x.shape, x.ravel().tolist()) for i, x in enumerate(case["frames"])]
    return spark.createDataFrame(rows, "frame_index long, height int, width int, pixels array<double>")


@pytest.mark.parametrize("name", sorted(synthetic.CASES))
def test_cases_are_drawn_again_alike(name):
    a, b = synthetic.case(name, 6), synthetic.case(name, 6)
    assert all((x == y).all() for x, y in zip(a["frames"], b["frames"], strict=True)) and len(a["boxes"]) == 6 * (5 if name == "high_density" else 1)


@pytest.mark.parametrize("name", ["baseline", "negative_velocity"])
def test_cases_are_measured(spark, name):
    case = synthetic.case(name, 40, 48, 64, 80)
    out = build.run(frames_of(spark, case), case["velocity"], 48, 64, 80, threshold=6.0, gates=Gates(min_area=8), gate=5.0, build={"mask_passes": 1, "dilation": 1}, registration={"radius": 1.0, "highpass": 6}, noise={"radius": 8})
    best = max(out["velocities"].collect(), key=lambda r: r["n_detections"])
    assert abs(best["v_y"] - case["particle_velocity"]) < 0.15 and abs(best["ratio"] - 0.7) < 0.1
    truth = spark.createDataFrame([(f, i, t, left, b, r) for i, (f, t, left, b, r, _) in enumerate(case["boxes"])], "frame_index long, truth_id long, t_top long, t_left long, t_bottom long, t_right long")
    got = runs.compared_runs({"a": out}, truth, frames_of(spark, case)).first()
    assert got["recall"] > 0.8 and got["precision"] > 0.8


def test_map_alone_gives_false_detections_only_where_it_is_marked(spark):
    surface = np.random.default_rng(1).normal(size=(60, 32))
    phases = spark.createDataFrame([(f, float(-2 * f % 60)) for f in range(40)], "frame_index long, phase double")
    assert runs.map_only_control(surface, phases, 24, 2.0, 9.0, 5.0, 5).first()["false_detections"] == 0
    surface[20:24, 10:14] += 60
    row = runs.map_only_control(surface, phases, 24, 2.0, 9.0, 5.0, 5).first()
    assert row["false_detections"] >= 10 and row["false_long_tracks"] >= 1


def test_patches_that_recur(spark):
    draw = np.random.default_rng(4)
    surface, rows = draw.normal(scale=2, size=(40, 30)) + 50, []
    ghost = np.zeros((40, 30))
    ghost[18:22, 8:13] = draw.normal(scale=20, size=(4, 5)) + 60  # a mark that the map doesn't hold
    phases = [(f, float(-8 * f % 40), f // 5) for f in range(15)]
    for f, p, _ in phases:
        x = rendered(surface + ghost, p, 24)
        if f == 6:
            x[10:14, 20:25] += 80  # seen once
        rows.append((f, 24, 30, x.ravel().tolist()))
    frames = spark.createDataFrame(rows, "frame_index long, height int, width int, pixels array<double>")
    table = spark.createDataFrame(phases, "frame_index long, phase double, revolution long")
    at = next(f for f, p, r in phases if r == 1 and 4 <= (18 - p) % 40 <= 16)
    y = int((18 - phases[at][1]) % 40)
    det = spark.createDataFrame([(at, 1, y + 1.5, 10.0, y, 8, y + 4, 13), (6, 2, 11.5, 22.0, 10, 20, 14, 25)], "frame_index long, label long, y double, x double, bbox_top long, bbox_left long, bbox_bottom long, bbox_right long")
    got = {r["label"]: r for r in runs.patch_recurrence(det, frames, table, surface, 24, 30).collect()}
    assert got[1]["hard_reject"] and got[1]["valid_revisits"] == 2 and got[1]["transient_score"] < 0.3
    assert not got[2]["hard_reject"] and got[2]["transient_score"] == 1.0


def test_filters_of_runs(spark):
    det = [(f, 1, 2.0 * f, 5.0, 2 * f, 4, 2 * f + 3, 7, 9, 8.0) for f in range(8)] + [(f, 2, 30.0, 20.0, 29, 19, 32, 22, 9, 8.0) for f in range(8)]
    rows = spark.createDataFrame(det, "frame_index long, label long, y double, x double, bbox_top long, bbox_left long, bbox_bottom long, bbox_right long, area_px long, peak_signal double")
    tracks = rows.withColumn("track_id", F.col("label"))
    assert {r["track_id"] for r in runs.filter_tracks(tracks, 2.5, low=0.5)["filtered_velocities"].collect()} == {1}
    out = runs.confirmed_run(rows, rows.where("label = 1 and frame_index < 6"), 2.5, 4.0, 0.5, 1.0, tracks=tracks, rescue=(5, 4, 0.5, 1), dedupe={"iou": 0.5})
    assert sorted(r["frame_index"] for r in out["detections"].collect()) == list(range(7))
    assert [r["track_id"] for r in runs.ghost_tracks(tracks, tracks.limit(0).withColumn("accepted", F.lit(True)), tracks.limit(0), 9).collect()] in ([1, 2], [2, 1])
    phases = spark.createDataFrame([(0, 3.0), (2, 5.0)], "frame_index long, phase double")
    asked = spark.createDataFrame([(0.0,), (2.4,), (7.0,)], "frame_index double")
    assert {r["frame_index"]: r["phase"] for r in runs.phases_of(asked, phases, 2.0, 10).collect()} == {0.0: 3.0, 2.4: 5.0, 7.0: 6.0}


def test_period_states():
    s = lambda *a, **k: (lambda r: (r["model_period_px"], r["belt_period_state_source"]))(runs.period_state(*a, **k))
    assert s(10, 10.0) == (10.0, "supplied") and s(10, None) == (None, "inferred_finite_strip")
    assert s(10, 10, True) == (10.0, "supplied_matching_reuse_height") and s(10, 9, True) == (None, "legacy_reuse_unknown")
    assert s(10, None, True, {"model_period_px": 10}) == (10.0, "metadata") and s(10, 10, True, {"belt_map_periodic": False}) == (None, "metadata_finite_strip")
    for meta in ({"model_period_px": 9}, {"model_period_px": 10, "belt_period_known": False}, {"belt_map_periodic": True}):
        with pytest.raises(ValueError):
            runs.period_state(10, None, True, meta)


def test_reports(tmp_path):
    reports.staged(str(tmp_path), "map", lambda: 1)
    assert len((tmp_path / "progress.jsonl").read_text().splitlines()) == 2 and json.loads((tmp_path / "progress_latest.json").read_text())["message"] == "ended"
    assert reports.png(np.arange(6.0).reshape(2, 3)).startswith(b"\x89PNG") and "&lt;b&gt;" in reports.page("<b>", [{"a": 1}, {"b": None}])
    assert "- x: n/a" in reports.markdown("t", {"s": {"x": float("nan")}}) and "threshold = 12.0" in reports.profile("dense")
    assert reports.grid_values("a.b=1, 2.5,x,true") == ("a.b", [1, 2.5, "x", True]) and "HOME" not in reports.provenance(("LOOP",))["environment"]


def test_bundles(spark, tmp_path):
    from loopsight.sources import bundles, tables

    case = synthetic.case("baseline", 24, 48, 64, 80)
    frames = frames_of(spark, case)
    out = build.run(frames, 2.0, 48, 64, 80, threshold=6.0, gates=Gates(min_area=8), gate=5.0, build={"mask_passes": 1}, registration={"radius": 1.0, "highpass": 6}, noise={"radius": 8})
    truth = spark.createDataFrame([(f, i, t, left, b, r) for i, (f, t, left, b, r, _) in enumerate(case["boxes"])], "frame_index long, truth_id long, t_top long, t_left long, t_bottom long, t_right long")
    true = spark.createDataFrame(list(enumerate(case["phases"])), "frame_index long, true_phase_px double")
    d = str(tmp_path)
    got = bundles.benchmark_report(d, out, truth, frames, case["particle_velocity"], true, 80.0)
    assert got["detections"]["f1"] > 0.8 and got["phases"]["mae"] <= 0.5 and json.loads((tmp_path / "benchmark.json").read_text()) == got
    assert bundles.validation_report(d, out)["tracks"]["tracks"] >= 1 and len(bundles.evaluation_report(d, {"a": out, "b": out})) == 2
    assert bundles.comparison_report(d, {"a": out}, truth, frames)["a"]["recall_ci_low"] > 0.5
    per_frame = out["detections"].groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_detections"))
    assert bundles.audit_report(d, out["phases"], per_frame, out["detections"], out["velocities"])["contract"]["rows"]
    marked = out["detections"].withColumn("rejected", F.col("label") > 1)
    assert bundles.trust_report(d, out["phases"], per_frame, out["tracks"], marked, out["velocities"], 2.0, 1.0)["events"]["n"] >= 1
    assert bundles.stress_report(d, out["detections"], out["phases"], ["loss", "score"])["subsets"]["rows"]
    assert bundles.uncertainty_maps(d, out["phases"], "predicted_phase_px", 80, 48).count() == 80
    assert bundles.map_samples(out["phases"], "predicted_phase_px", 80, 5) == [0, 5, 11, 17, 23] and len(bundles.map_samples(out["phases"], "predicted_phase_px", 80, 2, True, 48)) == 2
    rows = tables.read_csv(spark, f"{d}/map_uncertainty")
    assert rows.count() == 80 and bundles.boxes_by_frame(out["detections"]).count() <= 24
    table = spark.createDataFrame([("a", "0.5", "x"), ("b", "0.7", "2")], ["Label", "labeled_f1", "n_tracks"])
    evidence = bundles.evidence_rows(table)
    none = evidence.limit(0).select("variant", *[F.lit(0.0).alias(c) for c in ("fp_per_frame", "map_only_false_detections", "map_only_false_long_tracks", "map_only_false_accepted_tracks", "small_accepted_tracks", "masked_pixel_fraction", "recurrent_artifact_fraction_from_map")])
    assert [r["n_tracks"] for r in evidence.orderBy("variant").collect()] == [None, 2.0] and bundles.objective_report(d, evidence, none)["winner"]["rows"] == []
    assert bundles.flat_measures({"a": {"f1": 1}, "b": {"f1": 2, "n": 3}}) == {"f1": 1, "n": 3} and bundles.select_file(["a.zip", "b.txt"], pattern="*.zip") == "a.zip"
    assert bundles.smoothed_sequence(frames.withColumn("phase", F.pmod(F.col("frame_index") * -2.0, F.lit(80.0))), case["surface"], "phase", 80.0, 2.0, {"radius": 1.0, "highpass": 6}).count() == 24
