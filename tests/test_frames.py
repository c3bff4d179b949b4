import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopsight.kernels.images import Gates, box_means, rendered
from loopsight.operators import agreement, build, frames as kernels, tracking
from loopsight.sources import images, tables


def png(path, x, rgb=False):
    body = x.astype(np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in body)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", body.shape[1], body.shape[0], 8, 2 if rgb else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images_are_listed_decoded_and_cut(spark, tmp_path):
    for i in (10, 9, 1, 2):
        png(tmp_path / f"f{i}.png", np.full((3, 4), i))
    (tmp_path / "notes.txt").write_text("no")
    listed = images.image_paths(spark, str(tmp_path), stride=2)
    assert [r["path"].rsplit("/", 1)[1] for r in listed.orderBy("frame_index").collect()] == ["f1.png", "f9.png"]
    every = images.decoded(spark, images.image_paths(spark, str(tmp_path), most=3))
    assert {r["frame_index"]: r["pixels"][0] for r in every.collect()} == {0: 1.0, 1: 2.0, 2: 9.0}
    colour = tmp_path / "c"
    colour.mkdir()
    png(colour / "x1.png", np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]]), rgb=True)
    frame = images.decoded(spark, images.image_paths(spark, str(colour)))
    assert frame.first()["pixels"] == [76.0, 150.0, 29.0]
    assert images.cropped(frame, 0, 1, 1, 2).first()["pixels"] == [150.0, 29.0]
    assert [tuple(r) for r in images.pixels(frame).orderBy("x").collect()] == [(0, 0, 0, 76.0), (0, 0, 1, 150.0), (0, 0, 2, 29.0)]
    assert images.packed(images.pixels(frame), 1, 3).first()["pixels"] == [76.0, 150.0, 29.0]
    assert images.parse_region(" 1,2,3,4", 9, 9) == (1, 2, 3, 4) and images.parse_region("", 3, 4) == (0, 0, 3, 4)
    with pytest.raises(ValueError):
        images.parse_region("0,0,9,9", 3, 4)
    meta = images.image_metadata(spark.read.format("binaryFile").load(str(colour))).first()
    assert (meta["format"], meta["width"], meta["height"], meta["mode"]) == ("PNG", 3, 1, "rgb")
    mask = images.excluded(frame, 1, 3)
    assert images.without(images.pixels(frame), mask).count() == 0
    assert images.filled(images.pixels(frame), mask).where("v is null").count() == 3
    keys = spark.createDataFrame([("a10",), ("A9",), ("a009b",), ("b1",)], "n string").orderBy(images.natural_key(F.col("n")))
    assert [r["n"] for r in keys.collect()] == ["A9", "a009b", "a10", "b1"]
    assert images.images_by_stem(spark, str(colour)).first()["stem"] == "x1"


def test_npy_files(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([[1.0, np.nan], [3.0, 4.0]], dtype=np.float32))
    rows = images.read_npy(spark, str(tmp_path / "m.npy"), (2, 2)).orderBy("belt_row", "x").collect()
    assert [(r["belt_row"], r["x"], r["v"]) for r in rows] == [(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)]
    with pytest.raises(Exception, match="shape"):
        images.read_npy(spark, str(tmp_path / "m.npy"), (3, 2)).collect()


def test_labels_and_detector_files(spark, tmp_path):
    text = """{"status": "reviewed", "scored_frames": [1, 2, 9], "particles": [{"frame_index": 1, "top": 1, "left": 2, "bottom": 3, "right": 4, "event_id": "e"}],
        "frames": [{"frame": 2, "boxes": [{"bbox_top": "5", "bbox_left": 0, "bbox_bottom": 6, "bbox_right": 7}]}, {"frame_index": 3, "boxes": []}],
        "tracklets": [{"id": "t", "boxes": [{"frame": 4, "top": 0, "left": 0, "bottom": 1, "right": 1}]}]}"""
    rows = tables.labels_from_json(spark.createDataFrame([(text,)], "value string"))
    got = sorted((r["frame_index"], r["bbox_top"], r["tracklet_id"]) for r in rows.collect() if r["bbox_top"] is not None)
    assert got == [(1, 1.0, "e"), (2, 5.0, None), (4, 0.0, "t")]
    assert sorted(r["frame_index"] for r in rows.collect() if r["bbox_top"] is None) == [3, 9]
    assert tables.reviewed(rows).count() == 5
    with pytest.raises(ValueError):
        tables.reviewed(rows.withColumn("status", F.lit("Draft")))
    wrong = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0, "a"), (-1, 3.0, 0.0, 2.0, None, "b")], "frame_index long, bbox_top double, bbox_left double, bbox_bottom double, bbox_right double, tracklet_id string")
    assert {r["tracklet_id"]: len(r["errors"]) for r in tables.label_errors(wrong, 10, 4, 4).collect()} == {"a": 1, "b": 3}
    csv = spark.createDataFrame([("1.0", "2", "3", "9", "9"), ("2", "", "", "", ""), ("x", "1", "1", "2", "2")], ["frame", "ymin", "xmin", "ymax", "xmax"])
    assert [(r["frame_index"], r["bbox_top"]) for r in tables.label_boxes(csv).orderBy("frame_index").collect()] == [(1, 2.0), (2, None)]
    (tmp_path / "im_3.txt").write_text("0 0.5 0.5 0.5 0.25\n\n1 0.25 0.25 0.5 0.5 0.75\n")
    (tmp_path / "classes.txt").write_text("particle\n")
    lines = tables.read_detector_files(spark, str(tmp_path))
    assert lines.where("error is null").count() == 2 and lines.where("frame_index <> 3").count() == 0
    shapes = spark.createDataFrame([("im_3", 7, 100, 80)], "stem string, frame_index long, width int, height int")
    found = tables.detector_detections(lines, shapes).orderBy("label").collect()
    assert [(r["frame_index"], r["label"], r["bbox_top"], r["bbox_left"], r["bbox_bottom"], r["bbox_right"]) for r in found] == [(7, 1, 30, 25, 50, 75), (7, 2, 0, 0, 40, 50)]
    bad = spark.createDataFrame([("0 1 2 3",), ("0.5 1 1 1 1",), ("0 1 1 0 1",), ("0 1 nan 1 1",)], "value string")
    assert tables.parse_detector_lines(bad).where("error is null").count() == 0


def test_tables_are_read_and_written(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1, 0.5, float("nan"))], "frame_index long, label long, y double, x double")
    tables.write_detections(rows, spark.range(4).withColumnRenamed("id", "frame_index"), str(tmp_path))
    run = tables.read_run(spark, str(tmp_path))
    assert run["detections"].columns == list(tables.FIELDS["detections"]) and run["detections"].count() == 1
    assert {r["frame_index"]: r["n_detections"] for r in run["detections_per_frame"].collect()} == {"0": "0", "1": "0", "2": "1", "3": "0"}
    assert run["tracks"].count() == 0
    assert tables.json_rows(rows).first()["value"] == '{"frame_index":2,"label":1,"y":0.5,"x":null}'
    assert tables.json_safe({"a": (1.0, float("inf")), "b": np.arange(2)}) == {"a": [1.0, None], "b": [0, 1]}
    (tmp_path / "p.jsonl").write_text('{"stage": "map", "elapsed_s": 2.0, "frames": 4}\nbroken\n')
    assert tables.read_progress(spark, str(tmp_path / "p.jsonl")).where("stage = 'map'").count() == 1
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    assert tables.resolved(tables.flattened(tables.read_config(str(tmp_path / "c.toml"))), {"a.b": None, "c": 2}) == {"a.b": 1, "c": 2}
    times = spark.createDataFrame([("1", "0.5"), ("2", "1.0")], ["frame_index", "time_s"])
    assert tables.timestamps(times).count() == 2
    with pytest.raises(ValueError):
        tables.timestamps(times.unionByName(times))
    phases = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b")], "frame_index long, phase_px double, image string")
    assert tables.reused_phases(phases, 2, phases).count() == 2
    with pytest.raises(ValueError):
        tables.reused_phases(phases, 3)


def belt():
    """A surface of 40 rows and 32 columns, frames of 20 rows of it, and one bright particle slower than the belt."""
    draw = np.random.default_rng(3)
    surface = 100 + 25 * np.sin(np.arange(40) * 2 * np.pi / 20)[:, None] + 60 * box_means(draw.normal(size=(40, 32)), 1)
    frames = []
    for f in range(24):
        x = rendered(surface, (-2.0 * f) % 40, 20) + draw.normal(scale=1.0, size=(20, 32))
        y = 1 + 0.75 * f
        if y < 17:
            x[int(round(y)) : int(round(y)) + 3, 12:15] += 80
        frames.append((f, 20, 32, x.ravel().tolist()))
    return surface, frames


@pytest.mark.parametrize("how", [{"aggregation": "trimmed_mean", "trim": 0.25}, {"mask_passes": 1, "threshold": 6.0, "dilation": 1}, {"mask_passes": 1, "huber_passes": 1}])
def test_map_of_a_sequence(spark, how):
    surface, rows = belt()
    frames = spark.createDataFrame(rows, "frame_index long, height int, width int, pixels array<double>").withColumn("phase", F.pmod(F.col("frame_index") * -2.0, F.lit(40.0)))
    got = kernels.surface_of(build.build_map(frames, 40, 32, 20, noise={"radius": 6}, **how), 40, 32)
    assert np.sqrt(np.mean((got - surface) ** 2)) < 2.0


def test_sequence_end_to_end(spark):
    _, rows = belt()
    frames = spark.createDataFrame(rows, "frame_index long, height int, width int, pixels array<double>")
    out = build.run(frames, 2.0, 20, 32, 40, threshold=6.0, gates=Gates(min_area=5), gate=4.0, build={"mask_passes": 1, "dilation": 1}, registration={"radius": 2.0, "highpass": 5}, noise={"radius": 6})
    phases = {r["frame_index"]: r["phase_px"] for r in out["phases"].collect()}
    assert max(abs((p + 2 * f + 20) % 40 - 20) for f, p in phases.items()) <= 0.5
    best = max(out["velocities"].collect(), key=lambda r: r["n_detections"])
    assert best["n_detections"] >= 15 and abs(best["v_y"] - 0.75) < 0.1 and best["accepted"]
    shifts = kernels.pair_shifts(frames, 5, 10)
    assert abs(kernels.velocity_of(shifts, 5) - 2.0) < 0.3
    assert kernels.quality(frames).count() == kernels.texture(frames).count() == 24
    fits = kernels.photometric(kernels.expected(frames.withColumn("phase", F.lit(0.0)), np.ones((40, 32))))
    assert fits.where("gain is null").count() == 24  # nothing to fit


def test_stream_of_tracks_equals_batch(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = []
    for f in range(12):
        for i in range(4):
            if draw.random() < 0.85:
                rows.append((f"s{i % 2}", f, i + 1, 10.0 * i + 1.5 * f + draw.normal() * 0.1, 5.0 * i, 9 + i, 6.0 if i else None))
    schema = "seq string, frame_index long, label long, y double, x double, area_px long, peak_signal double"
    batch = {tuple(r) for r in tracking.track(spark.createDataFrame(rows, schema), 5.0, 2.0, 1.0, seq="seq").collect()}
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"p{part}"))
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    for part in range(3):
        for file in (tmp_path / f"p{part}").glob("*.parquet"):
            file.rename(source / f"{part}.parquet")
        stream = tracking.track_stream(spark.readStream.schema(schema).parquet(str(source)), 5.0, 2.0, 1.0, seq="seq")
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).start()
        query.awaitTermination()
    assert set(seen) == batch and len(seen) == len(rows)


def test_sequential_operators(spark):
    rows = spark.createDataFrame([(f, 10.0, 0.5 * f if f != 3 else 30.0, 0.9) for f in range(8)], "frame_index long, predicted_phase_px double, correction_px double, score double")
    drift = {r["frame_index"]: (round(r["drift_px"], 6), r["accepted"]) for r in tracking.drift(rows, 0.5, max_step=5.0).collect()}
    assert drift[0] == (0.0, True) and drift[3] == (0.75, False) and drift[4] == (0.75, True)
    smooth = {r["frame_index"]: r["correction_px"] for r in tracking.smooth_phases(rows, 3.0).collect()}
    assert abs(smooth[3] - 1.5) < 0.2
    assert tracking.kalman(rows, "predicted_phase_px", 100.0).count() == 8
    det = spark.createDataFrame([(f, 1, 1.0 * f, 2.0, 4.0, 5.0) for f in range(3)], "frame_index long, label long, y double, x double, area_px double, peak_signal double")
    assert {r["link_id"] for r in tracking.short_links(det, 1, 2).collect()} == {0}
    boxes = spark.createDataFrame([(i, f, t, 0.0, t + 4, 4.0, None) for i, (f, t) in enumerate([(0, 0.0), (1, 0.5), (2, 1.0), (2, 20.0)])], "number long, frame_index long, bbox_top double, bbox_left double, bbox_bottom double, bbox_right double, event_id string")
    events = boxes.join(tracking.box_events(boxes).drop("seq"), "number")
    assert sorted(r["event"] for r in events.collect()) == [0, 0, 0, 1]
    m = tracking.event_metrics(events, events.where("event = 0")).first()
    assert (m["predicted"], m["targets"], m["matched"], m["temporal_iou"], m["recall"]) == (2, 1, 1, 1.0, 1.0)


def test_agreement_confirmation_and_stitching(spark):
    box = lambda f, n, t, left, peak, sign, m=None: (f, n, t + 1.5, left + 1.5, t, left, t + 4, left + 4, peak, sign, m)
    schema = "frame_index long, label long, y double, x double, bbox_top long, bbox_left long, bbox_bottom long, bbox_right long, peak_signal double, sign int, map_index long"
    primary = spark.createDataFrame([box(0, 1, 0, 0, 8.0, 1), box(0, 2, 1, 0, 8.0, 1), box(0, 3, 50, 50, 8.0, 1)], schema).drop("map_index")
    other = spark.createDataFrame([box(0, 1, 0, 0, 7.0, 1, 1), box(0, 1, 0, 0, 7.0, 1, 2), box(0, 2, 1, 0, 9.0, 1, 2), box(0, 3, 50, 50, 8.0, -1, 2)], schema)
    got = {r["label"]: (r["confirming_maps"], r["accepted"]) for r in agreement.cross_map_agreement(primary, other).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (0, False)}
    pairs = agreement.confirmation_pairs(primary, other.where("map_index = 2"))
    assert agreement.best_confirmation(pairs, 0.5, 1.0).count() == 3 and agreement.one_to_one(pairs, 0.1, 5.0).count() == 3
    dup = primary.withColumns({"rescued": F.lit(False), "area_px": F.lit(16), "confirmation_iou": F.lit(0.5), "confirmation_distance": F.lit(0.0)})
    kept = {r["label"]: r["kept_label"] for r in agreement.without_duplicates(dup, iou=0.5).collect()}
    assert kept == {1: None, 2: 1, 3: None}
    tracks = spark.createDataFrame([(0, f, 1) for f in range(6)] + [(1, 0, 2)], "track_id long, frame_index long, label long")
    sure = spark.createDataFrame([(0, 1), (1, 1), (0, 2)], "frame_index long, label long")
    assert agreement.rescued(tracks, sure, 3, 2, 0.3).count() == 6 and agreement.rescued(tracks, sure, 3, 2, 0.3, 2).count() == 4
    cams = spark.createDataFrame([(0, "a", 0.0, 1.0), (1, "a", 0.1, 1.0), (2, "b", 0.05, 1.5), (3, "b", 0.12, None), (4, "c", 9.0, 1.0)], "number long, camera string, time_s double, phase double")
    assert {r["number"]: r["event"] for r in agreement.stitched(cams, 0.2, 1.0).collect()} == {0: 0, 2: 0, 1: 1, 3: 1, 4: 4}
    residuals = spark.createDataFrame([(0, y, x, -1.0 if y > 20 else 2.0) for y in (0, 1, 2, 50, 51) for x in (0, 1, 2, 50, 51)], "frame_index long, y long, x long, raw double")
    assert {r["label"]: r["sign"] for r in agreement.raw_sign(primary.drop("sign"), residuals).collect()} == {1: 1, 2: 1, 3: -1}
    points = spark.createDataFrame([(0, 5, 12.0)], "number long, frame_index long, belt_y double")
    phases = spark.createDataFrame([(f, float(-4 * f % 40), f // 10) for f in range(40)], "frame_index long, p double, revolution long")
    r = agreement.find_revisits(points, phases, "p", 10, 3, 40).first()
    assert (r["revisit_before"], r["revisit_after"]) == (None, 18)
