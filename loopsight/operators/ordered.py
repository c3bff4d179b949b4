"""Global order without a global task: ranks, running sums and exact quantiles over ranges of the order.

Rows are dealt into ranges, which are stored, as ranges are drawn from a sample and must be the same for
all that is asked of them; each range is worked on by itself, and what the ranges before it add up to is
a table with a row for each range.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite


def stored(rows: DataFrame) -> DataFrame:
    """rows without their lineage, kept in the checkpoint folder if there is one, else in memory and on disk."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            return rows.persist()
        context.setCheckpointDir(named)
    return rows.checkpoint()


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    return stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: list, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """rows with the sum (or largest value) of each column given over all rows up to and including theirs; order is to be total."""
    sums, tops = sums or {}, tops or {}
    dealt = _dealt(rows, order)
    whole = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_{n}") for n, c in tops.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select("_part", *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums], *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in tops])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()], *[F.max(c).over(upto).alias(n) for n, c in tops.items()])
    out = out.join(F.broadcast(before), "_part")
    added = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_{n}") for n in tops}
    return out.withColumns(added).drop("_part", *[f"_{n}" for n in (*sums, *tops)])


def ranks(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank, from 0, in a total order."""
    return running(rows, order, {"rank": F.lit(1)}).withColumn("rank", (F.col("rank") - 1).cast("long"))


def quantiles(rows: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the finite values, between neighbours as by linear interpolation; None without values.

    Only ranges that hold a rank asked for are ranked, and only rows of these ranks leave them.
    """
    dealt = _dealt(rows.select(finite(value.cast("double")).alias("_v")).where("_v is not null"), ["_v"])
    counts = sorted(map(tuple, dealt.groupBy("_part").count().collect()))  # a row for each range
    n = sum(c for _, c in counts)
    if not n:
        return [None] * len(shares)
    wanted = sorted({r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    asked, start = [], 0
    for part, c in counts:
        asked += [(part, r - start, r) for r in wanted if start <= r < start + c]
        start += c
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_v")) - 1
    few = dealt.where(F.col("_part").isin([a[0] for a in asked])).withColumn("_r", rank)
    pick = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i, _ in asked])
    found = {(r["_part"], r["_r"]): r["_v"] for r in few.where(F.exists(pick, lambda x: (x["p"] == F.col("_part")) & (x["i"] == F.col("_r")))).collect()}
    at = {r: found[p, i] for p, i, r in asked}
    out = []
    for q in shares:
        low = math.floor(q * (n - 1))
        high, part = math.ceil(q * (n - 1)), q * (n - 1) - low
        out.append(at[low] + (at[high] - at[low]) * part)
    return out
