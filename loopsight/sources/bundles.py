"""Reports of whole runs: each gathers tables of a few rows, and writes them as JSON and Markdown and longer ones as CSV.

A run is a dict of tables, as tables.read_run or build.run gives; what it lacks is left out of a report.
"""

import fnmatch
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopsight.functions import scores
from loopsight.operators import agreement, evaluation, frames as kernels, maps, reports, sampling, splits, tracking
from loopsight.operators.assignment import optimal_matches
from loopsight.sources import images, tables
from loopsight.sources.reports import markdown, page


def gathered(sections: dict[str, DataFrame | dict]) -> dict[str, dict]:
    """Each section's single row as a dict; of a table with more rows a list of dicts, as its `rows`."""
    out = {}
    for name, rows in sections.items():
        if isinstance(rows, dict):
            out[name] = rows
            continue
        found = [r.asDict(recursive=True) for r in rows.limit(1001).collect()]  # summaries
        if len(found) > 1000:
            raise ValueError(f"{name} is no summary")
        out[name] = found[0] if len(found) == 1 else {"rows": found}
    return out


def write_report(folder: str, name: str, title: str, sections: dict[str, DataFrame | dict], details: dict[str, DataFrame] | None = None) -> dict:
    """<name>.json, <name>.md and <name>.html of the sections, and a folder of CSV files for each table of details."""
    found = tables.json_safe(gathered(sections))
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(found, indent=1), encoding="utf-8")
    (path / f"{name}.md").write_text(markdown(title, found), encoding="utf-8")
    items = [{"section": s, "measure": k, "value": v} for s, values in found.items() for k, v in values.items()]
    (path / f"{name}.html").write_text(page(title, items), encoding="utf-8")
    for table, rows in (details or {}).items():
        tables.write_csv(rows, f"{folder}/{table}", tuple(c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))))
    return found


def benchmark_report(folder: str, run: dict, truth: DataFrame, frames: DataFrame, velocity: float | None = None, phases: DataFrame | None = None, period: float | None = None) -> dict:
    """Detections, tracks and velocities of a run against truth, and its phases (frame_index, true_phase_px) around the period."""
    sections = {"detections": evaluation.detection_metrics(run["detections"], truth, frames=frames)}
    if "tracks" in run:
        sections["tracks"] = reports.track_continuity(run["tracks"])
    if "velocities" in run:
        sections["velocities"] = reports.velocity_errors(run["velocities"], velocity)
        sections["representative"] = reports.representative_velocity(run["velocities"], None)
    if phases is not None and "phases" in run and period:
        error = F.pmod(F.col("phase_px") - F.col("true_phase_px") + period / 2, F.lit(float(period))) - period / 2
        e = run["phases"].join(phases, "frame_index").select(error.alias("e"))
        sections["phases"] = e.agg(F.count("e").alias("n"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("max_abs"))
    return write_report(folder, "benchmark", "Benchmark", sections)


def validation_report(folder: str, run: dict) -> dict:
    """The run's plain measures and what looks wrong in them."""
    sections = {"detections": reports.detection_quality(run["detections"]), "tracks": reports.track_continuity(run["tracks"])}
    ratio = F.col("ratio")
    sections["velocities"] = run["velocities"].agg(*reports.described(ratio, "ratio_"), reports.share(ratio.between(0.0, 1.1), ratio).alias("in_range"))
    return write_report(folder, "validation", "Validation", sections)


def tracklet_report(folder: str, truth: DataFrame, predictions: DataFrame, matches: DataFrame, frames: DataFrame) -> dict:
    found = evaluation.evaluate_tracklets(truth, predictions, matches, frames)
    return write_report(folder, "tracklets", "Tracklets", {"metrics": found}, {"tracklet_matches": matches})


def evaluation_report(folder: str, runs_: dict[str, dict]) -> dict:
    """One section a run: counts and spreads of its tables."""
    sections = {}
    for name, r in runs_.items():
        per_frame = r["detections"].groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_detections"))
        sections[name] = reports.run_summary(r["phases"], per_frame, r["detections"], r["velocities"])
    return write_report(folder, "evaluation", "Runs", sections)


def comparison_report(folder: str, runs_: dict[str, dict], truth: DataFrame, frames: DataFrame) -> dict:
    """Each run's detections against the same truth, with intervals over frames."""
    sections = {}
    for name, r in runs_.items():
        matches = optimal_matches(r["detections"], truth)
        outcomes = evaluation.frame_outcomes(r["detections"], truth, matches, frames)
        sections[name] = evaluation.detection_metrics(r["detections"], truth, frames=frames).join(evaluation.bootstrap_outcomes(outcomes, 200))
    return write_report(folder, "comparison", "Comparison", sections)


def stress_report(folder: str, detections: DataFrame, features: DataFrame, names: list[str], parts: int = 4) -> dict:
    """Detection rates by how hard frames are, the hardest last."""
    scored = evaluation.stress_scores(features, names, parts)
    return write_report(folder, "stress", "Texture stress", {"subsets": reports.subset_summary(detections, scored)}, {"stress_frames": scored})


def objective_report(folder: str, labeled: DataFrame, map_only: DataFrame) -> dict:
    """Variants by a score that counts what they find where there's nothing, and the best of them."""
    merged = reports.merged_evidence(labeled, map_only)
    scored = merged.select("variant", *[c.alias(n) for n, c in scores.variant_score().items()])
    return write_report(folder, "objective", "Choice of a variant", {"winner": reports.winner(scored), "variants": scored})


def audit_report(folder: str, phases: DataFrame, per_frame: DataFrame, detections: DataFrame, velocities: DataFrame, fits: DataFrame | None = None, n: int = 10) -> dict:
    """What looks wrong in a run, whether it meets the contract, and its worst frames."""
    fits = fits if fits is not None else phases.limit(0).select("frame_index", F.lit(0.0).alias("gain"), F.lit(0.0).alias("rmse_gray"))
    kept = velocities.where("accepted") if "accepted" in velocities.columns else velocities
    rejected = detections.where("rejected") if "rejected" in detections.columns else detections.limit(0)
    sections = {
        "flags": reports.quality_flags(phases, per_frame, detections, velocities, fits), "contract": reports.quality_contract(phases, per_frame, detections, velocities, kept),
        "worst_frames": reports.worst_frames(phases, per_frame, rejected, fits, n),
    }
    return write_report(folder, "audit", "Audit", sections)


def trust_report(folder: str, phases: DataFrame, per_frame: DataFrame, tracks: DataFrame, detections: DataFrame, scores_: DataFrame, velocity: float | None = None, radius: float | None = None) -> dict:
    """Trends, speed, events and rejections of a run."""
    events = reports.events_of_tracks(tracks)
    sections = {"speed": reports.speed_consistency(phases, velocity, radius), "drift": reports.drift(per_frame, phases), "events": events.agg(F.count(F.lit(1)).alias("n"))}
    return write_report(folder, "trust", "Trust", sections, {"events": events, "rejections": reports.rejection_audit(detections, scores_)})


def uncertainty_maps(folder: str, phases: DataFrame, phase: str, height: int, rows: int, periodic: bool = True, scale: float = 1.0) -> DataFrame:
    """belt_row, n, uncertainty of each row of the map, written as CSV; rows that no frame shows have the scale itself."""
    counts = maps.row_counts(phases, phase, height, rows, periodic)
    every = phases.sparkSession.range(height).withColumnRenamed("id", "belt_row").join(counts, "belt_row", "left").fillna(0, ["n"])
    out = every.withColumn("uncertainty", F.when(F.col("n") > 0, scale / F.sqrt(F.greatest(F.col("n"), F.lit(1)))).otherwise(F.lit(float(scale))))
    tables.write_csv(out, f"{folder}/map_uncertainty", tuple(out.columns))
    return out


def export_detector_run(spark: SparkSession, labels: str, pictures: str, folder: str, source: str = "detector") -> DataFrame:
    """A detector's label files on images as the tables of a run; wrong lines are an error."""
    lines = tables.read_detector_files(spark, labels)
    wrong = lines.where("error is not null").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['stem']}: {wrong[0]['error']}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif}").load(pictures)
    sizes = images.image_metadata(files).select(images.stem(F.col("path")).alias("stem"), images.frame_number(F.col("path")).alias("frame_index"), "width", "height")
    found = tables.detector_detections(lines, sizes, source)
    tables.write_detections(found, sizes.select("frame_index"), folder)
    return found


def boxes_by_frame(detections: DataFrame) -> DataFrame:
    """frame_index, boxes: each frame's boxes by label, as one array."""
    box = F.struct("label", *[F.col(f"bbox_{s}").alias(s) for s in ("top", "left", "bottom", "right")])
    return detections.groupBy("frame_index").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def evidence_rows(rows: DataFrame) -> DataFrame:
    """Evidence of a summary table of text, by variant: known measures as numbers, `label`, `run` or `variant` as the variant."""
    from loopsight.functions.values import number

    known = {c.lower(): c for c in rows.columns}
    name = F.coalesce(*[F.col(f"`{known[c]}`") for c in ("variant", "label", "run") if c in known])
    wanted = ("labeled_f1", "fp_per_frame", "n_tracks", "small_accepted_tracks", "masked_pixel_fraction", "recurrent_artifact_fraction_from_map",
              "map_only_false_detections", "map_only_false_long_tracks", "map_only_false_accepted_tracks")
    return rows.select(name.alias("variant"), *[number(F.col(f"`{known[c]}`")).alias(c) for c in wanted if c in known])


def flat_measures(nested: dict) -> dict:
    """Measures of a nested report under their short names: the last part of their path, the first that has it counting."""
    out: dict = {}
    for path, value in tables.flattened(nested).items():
        out.setdefault(path.rpartition(".")[2], value)
    return out


def select_file(names: list[str], name: str | None = None, pattern: str | None = None) -> str:
    """The one file of that name, or that fits the pattern; an error for none or several."""
    found = [n for n in names if (name is None or n == name) and (pattern is None or fnmatch.fnmatch(n, pattern))]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files fit")
    return found[0]


def map_samples(phases: DataFrame, phase: str, height: int, count: int, adaptive: bool = False, crop: int = 1) -> list[int]:
    """Frames to build a map from: spread evenly over those given, in order, or so that they cover the surface."""
    if adaptive:
        return sorted(f for f, _ in splits.adaptive_frames(phases, phase, height, count, crop))
    n = phases.count()
    ranked = evaluation.numbered(phases.select("frame_index"), ["frame_index"])
    chosen = sampling.sample_indices(phases.sparkSession, n, count).withColumnRenamed("frame_index", "i")
    return sorted(r["frame_index"] for r in ranked.join(chosen, "i").collect())  # count at most


def smoothed_sequence(frames: DataFrame, surface, phase: str, period: float | None, window: float, registration: dict | None = None) -> DataFrame:
    """frame_index, correction_px, phase_px: frames registered one by one, then smoothed along the sequence."""
    seen = kernels.registered(frames, surface, phase, period, **(registration or {}))
    rows = seen.select("frame_index", F.col(phase).alias("predicted_phase_px"), "r.correction_px", "r.score")
    return tracking.smooth_phases(rows, window, period).drop("seq")


def confirmed_tracks(rows: DataFrame, least: int = 1, share: float = 0.0) -> DataFrame:
    """Tracks with enough directly confirmed members."""
    found = agreement.track_confirmations(rows)
    return found.where((F.col("direct_confirmed_detections") >= least) & (F.col("direct_confirmed_fraction") >= share))


def control_summary(folder: str, row: DataFrame, tracks: DataFrame | None = None) -> dict:
    """The measures of a run over a map alone (runs.map_only_control)."""
    return write_report(folder, "map_only", "Map-only control", {"counts": row}, {"tracks": tracks} if tracks is not None else None)
