"""One-to-one matching of boxes within a frame."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.kernels.matching import assign
from loopsight.operators.matching import iou_pairs


def optimal_pairs(pairs: DataFrame, a: str, b: str, gains: list, by: list[str]) -> DataFrame:
    """Rows of pairs (a, b) chosen by assign within each group of `by`; a group's pairs are one array in one task."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    single = len(gains) == 1

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def best(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            found = assign((x["a"], x["b"], x["g"][0] if single else tuple(x["g"])) for x in row)
            out.append([{"a": x[0], "b": x[1]} for x in found])
        return pa.array(out, type=kind)

    one = F.struct(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.array(*[g.cast("double") for g in gains]).alias("g"))
    chosen = pairs.groupBy(*by).agg(F.collect_list(one).alias("pairs")).select(*by, F.inline(best("pairs")))
    return pairs.join(chosen.withColumnsRenamed({"a": a, "b": b}), [*by, a, b], "left_semi")


def optimal_matches(detections: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """frame_index, label, truth_id, iou of the best assignment of each frame; a frame's boxes are one small array."""
    pairs = iou_pairs(detections, truth, least).select("frame_index", "label", "truth_id", "iou")
    return optimal_pairs(pairs, "label", "truth_id", [F.col("iou")], ["frame_index"])
