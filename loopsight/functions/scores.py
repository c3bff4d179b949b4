"""Scores, labels and gate reasons of detections, tracks and registrations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite
from loopsight.functions.values import clipped


def _or(x: Column, default: float) -> Column:
    return F.coalesce(finite(x), F.lit(float(default)))


def peak_ratio(a: Column, b: Column) -> Column:
    """The smaller magnitude over the larger; null where either isn't finite or both are 0."""
    a, b = F.abs(finite(a)), F.abs(finite(b))
    return F.when(a.isNotNull() & b.isNotNull() & (F.greatest(a, b) > 0), F.least(a, b) / F.greatest(a, b))


def trust_confidence(peak: Column, mean: Column, area: Column, overlap: Column, truncated: Column, threshold: float = 5.0) -> Column:
    """Logistic margin of the signal over the threshold, weighted by area, artifact overlap and truncation; 0 to 1.

    The mean stands for a missing peak; without any signal, or without an area, that factor is 0.5.
    """
    signal = F.coalesce(finite(peak), finite(mean))
    margin = F.coalesce(1 / (1 + F.exp(-(signal - threshold) / max(threshold, 1e-6))), F.lit(0.5))
    size = F.coalesce(clipped(finite(area) / 20), F.lit(0.5))
    kept = F.greatest(F.lit(0.0), 1 - clipped(_or(overlap, 0)))
    cut = F.when(F.coalesce(truncated, F.lit(False)), 0.75).otherwise(1.0)
    return clipped(margin * (0.5 + 0.5 * size) * kept * cut)


def detection_scores(row: dict[str, Column], registration: Column) -> dict[str, Column]:
    """The factors of a detection's confidence, and their product.

    row holds peak, mean, area, overlap, probability, height and width; missing measures are 0, and a
    missing registration score is 1. Boxes without height or width have no shape score.
    """
    saturated = lambda x: 1 - F.exp(-F.greatest(F.lit(0.0), _or(x, 0)) / 5)
    area, h, w = _or(row["area"], 0), row["height"], row["width"]
    extent = clipped(area / F.greatest(F.lit(1.0), h * w))
    shape = F.when(h.isNull() | w.isNull() | (area <= 0), 1.0).when((h <= 0) | (w <= 0), 0.0).otherwise(F.sqrt(extent))
    penalty = F.greatest(F.lit(0.0), 1 - F.greatest(_or(row["overlap"], 0), _or(row["probability"], 0)))
    score = clipped(_or(registration, 1))
    signal = saturated(row["peak"])
    return {
        "registration_score": score, "signal_score": signal, "shape_score": shape, "artifact_penalty": penalty,
        "detection_confidence": signal * (0.5 + 0.5 * saturated(row["mean"])) * shape * score * penalty,
    }


def track_confidence(n: Column, least: int, peak: Column, rmse: Column, ratio: Column) -> Column:
    """Length, signal, fit and velocity ratio as one product; a missing measure counts as 1."""
    length = clipped(n / F.lit(float(least)))
    p = finite(peak)
    signal = F.when(p.isNull(), 1.0).otherwise(1 - F.exp(-F.greatest(F.lit(0.0), p) / 5))
    fit = F.coalesce(1 / (1 + finite(rmse)), F.lit(1.0))
    r = finite(ratio)
    plausible = F.when(r.isNull() | r.between(0.0, 1.1), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(r - 0.55)))
    return length * signal * fit * plausible


def event_class(overlap: Column, ratio: Column, peak: Column, uncertainty: Column) -> dict[str, Column]:
    """label, confidence and reasons of an event by fixed rules; missing evidence says nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fixed, plausible = yes(overlap > 0.5), yes(ratio.between(0.0, 1.1))
    implausible, strong, unsure = ratio.isNotNull() & ~plausible, yes(peak >= 5.0), yes(uncertainty > 5.0)
    label = F.when(fixed, "belt-fixed-artifact").when(plausible, "loose-particle").when(unsure, "map-uncertainty-artifact")
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    score = F.lit(0.5) + add(fixed, 0.3) + add(plausible, 0.2) - add(implausible, 0.15) + add(strong, 0.1) - add(unsure, 0.1)
    said = (
        (fixed, "high recurrent belt-coordinate overlap"), (plausible, "physically plausible velocity ratio"),
        (implausible, "velocity ratio outside expected range"), (strong, "strong residual peak"),
        (unsure, "high rendered map uncertainty"),
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in said]))
    return {"label": label.otherwise("uncertain"), "confidence": clipped(score), "reasons": reasons}


def taxonomy(role: Column, revisits: Column, rejected: Column, supported: Column, score: Column, threshold: Column) -> Column:
    """What recurrence says about a true (TP) or false (FP) detection, by the evidence that the hard filter used."""
    low = F.lower(role)
    backed = (F.coalesce(supported, F.lit(0)) > 0) | F.coalesce(_or(score, 0) >= finite(threshold), F.lit(False))
    return (
        F.when(revisits == 0, F.concat(low, F.lit("_no_valid_revisits")))
        .when((role == "FP") & rejected, "fp_recurrent_removed")
        .when((role == "FP") & ~backed, "fp_low_shape_supported_recurrence_evidence")
        .when((role == "TP") & rejected, "tp_high_shape_supported_recurrence_accidentally_removed")
        .when(backed, F.concat(low, F.lit("_shape_supported_recurrent_but_not_hard_rejected")))
        .otherwise(F.concat(low, F.lit("_inconclusive_low_recurrence")))
    )


def recurrence_ratio(revisit: Column, original: Column, floor: float) -> Column:
    """What a revisit shows over what the original showed, the latter at least floor."""
    below = F.greatest(original, F.lit(float(floor)))
    return _or(F.greatest(F.lit(0.0), revisit) / F.coalesce(F.when(below > 0, finite(below)), F.lit(float(floor))), 0)


def reranked(score: Column, confidence: Column, transient: Column) -> Column:
    """The detector's confidence (else its score, else 1) times how transient the detection is."""
    return F.coalesce(confidence, score, F.lit(1.0)) * transient


def inflation(factor: float, scale: float, uncertainty: Column) -> Column:
    """By how much to divide a suspect frame's normalized signal: 1 at least."""
    base = F.lit(max(1.0, float(factor)))
    u = finite(uncertainty)
    return F.when(u.isNotNull() & F.lit(scale > 0), F.greatest(base, 1 + F.lit(float(scale)) * F.greatest(F.lit(0.0), u))).otherwise(base)


def registration_reasons(row: dict[str, Column], gates: dict[str, float | None]) -> Column:
    """Names of the gates that an estimate fails; none for estimates that no registration made.

    gates may hold score and loss_gap_ratio (at least), uncertainty_px and correction_px (at most);
    a value that isn't finite fails its gate.
    """
    least = lambda c, x: ~F.coalesce(finite(c) >= x, F.lit(False))
    most = lambda c, x: ~F.coalesce(F.abs(finite(c)) <= x, F.lit(False))
    tests = (("score", least), ("loss_gap_ratio", least), ("uncertainty_px", most), ("correction_px", most))
    failed = [F.when(test(row[n], F.lit(float(gates[n]))), F.lit(n)) for n, test in tests if gates.get(n) is not None]
    none = F.array().cast("array<string>")
    return F.when(F.contains(row["method"], F.lit("registration")), F.array_compact(F.array(*failed)) if failed else none).otherwise(none)


#: Weights of score_variant's terms.
OBJECTIVE = {
    "f1": 1.0, "fp_frame": 0.01, "map_false_detections": 0.05, "map_false_long": 1.0, "map_false_accepted": 1.0,
    "small_accepted": 0.1, "mask_burden": 0.1,
}
#: Variants that are compared with others but never chosen.
BASELINES = ("raw_robust_zscore", "static_average_background")


def variant_score(weights: dict[str, float] = OBJECTIVE) -> dict[str, Column]:
    """small_accepted_tracks_share, mask_burden, missing_score_terms, ghost_objective_score and eligible_for_selection of evidence rows."""
    col = lambda n: finite(F.col(n).cast("double"))
    needed = ("labeled_f1", "fp_per_frame", "map_only_false_detections", "map_only_false_long_tracks", "map_only_false_accepted_tracks")
    missing = [F.when(col(n).isNull(), F.lit(n)) for n in needed]
    missing.append(F.when(F.col("variant").isin(*BASELINES), F.lit("not_a_map_config")))
    missing = F.array_compact(F.array(*missing))
    n = _or(F.col("n_tracks").cast("double"), 0)
    share = F.when(n <= 0, 0.0).otherwise(_or(F.col("small_accepted_tracks").cast("double"), 0) / F.greatest(n, F.lit(1e-300)))
    burden = F.coalesce(col("masked_pixel_fraction"), col("recurrent_artifact_fraction_from_map"), F.lit(0.0))
    parts = dict(zip(("f1", "fp_frame", "map_false_detections", "map_false_long", "map_false_accepted"), map(col, needed), strict=True))
    score = parts.pop("f1") * weights["f1"]
    for name, value in (parts | {"small_accepted": share, "mask_burden": burden}).items():
        score = score - value * weights[name]
    return {
        "small_accepted_tracks_share": share, "mask_burden": burden, "missing_score_terms": F.array_join(missing, ";"),
        "ghost_objective_score": F.when(F.size(missing) == 0, score), "eligible_for_selection": F.size(missing) == 0,
    }
