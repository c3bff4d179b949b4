"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import COMPACT_ROWS, checkpointed, discard


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    Alternating large-star and small-star steps; each round is written to the shared checkpoint
    folder. A node's links are never gathered: each step takes a minimum by node, which is
    pre-aggregated, and joins it back, which Spark can split where a node is hot. Few links are
    worked on in few partitions. Links with a null end and loops are left out; an empty table gives
    an empty result.
    """
    x, y = F.col(a), F.col(b)
    links = checkpointed(
        links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = _signature(links)
    while before[0]:
        parts = -(-2 * before[0] // COMPACT_ROWS)
        links = links.coalesce(parts)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
        after = _signature(links)
        discard(links.sparkSession)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
