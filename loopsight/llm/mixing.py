"""Mixing sources to target weights by subset-sum budget fitting."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopsight.llm.common import WORD, checkpointed, cores, free

#: Parts by seeded hash into which the documents of one source and length are dealt.
PARTS = 1024
#: How many documents of each length, taken and left over, the program may exchange, and the most words (in units of the
#: lengths' common divisor) that these have together; tried in turn until the nearest possible sum is met.
LEVELS = ((1, 1 << 16), (1, 1 << 20), (8, 1 << 20), (64, 1 << 22), (None, 1 << 26))
#: Bits that the program's tables hold at most.
TABLE_BITS = 1 << 32


def _subset(sizes: list[int], counts: list[int], goal: int, up: bool) -> tuple[int, list[int]]:
    """(sum, how many of each size): the sum nearest to goal; of two equally near the lower, or if up the higher."""
    limit = goal + max(sizes, default=0)  # a larger sum has a part that is nearer
    mask = (1 << (limit + 1)) - 1
    items, reach = [], 1
    for i, (size, spare) in enumerate(zip(sizes, counts, strict=True)):
        step = 1
        spare = min(spare, limit // size)
        while spare and not reach >> goal & 1:
            step = min(step, spare)
            spare -= step
            new = (reach << (step * size)) & mask & ~reach
            if new:
                items.append((i, step, new))
                reach |= new
            step *= 2
        if reach >> goal & 1:
            break
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    high = reach >> (goal + 1)
    high = goal + (high & -high).bit_length() if high else None
    best = at = high if high is not None and high - goal < goal - low + up else low
    used = [0] * len(sizes)
    for i, step, new in reversed(items):
        if new >> at & 1:
            used[i] += step
            at -= step * sizes[i]
    return best, used


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents to take of each length so that their words come nearest to budget.

    At every size: the same share of every length, rounded down, then what still fits from the
    longest length down. A bounded-knapsack program then exchanges documents: of each length, as
    many as the level allows of those taken and of those left over are its items, and it finds the
    sum of them nearest to what is missing (the lower of two equally near). Levels grow until
    the sum is the nearest multiple of the lengths' common divisor, or all documents are items and
    the sum is the nearest there is. Only where all documents have more than the last level's words
    (in units of the divisor) can a nearer sum be missed; the error is then at most half the
    shortest length left over.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    some = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0]
    if not some:
        return taken
    unit = math.gcd(*(int(lengths[i]) for i in some))
    size = {i: int(lengths[i]) // unit for i in some}
    total = sum(size[i] * int(counts[i]) for i in some)
    units, rest = divmod(min(max(int(round(budget)), 0), total * unit), unit)
    goal = units + (2 * rest > unit)
    up = 0 < 2 * rest <= unit  # the budget itself lies above the goal
    left = goal
    for i in some:
        taken[i] = int(counts[i]) * goal // total
        left -= size[i] * int(taken[i])
    for i in sorted(some, key=lambda i: -size[i]):
        more = min(int(counts[i] - taken[i]), left // size[i])
        taken[i] += more
        left -= more * size[i]
    best, found = left, None
    for most, words in LEVELS:
        if not best:
            break
        pool, used, items = [], 0, 0
        for i in sorted(some, key=size.get):
            back, more = (int(n) if most is None else min(most, int(n)) for n in (taken[i], counts[i] - taken[i]))
            if used + (back + more) * size[i] > words:
                break
            used += (back + more) * size[i]
            items += (back + more).bit_length()
            pool.append((i, back, back + more))
        if used * items > TABLE_BITS:
            continue
        wanted = left + sum(back * size[i] for i, back, _ in pool)
        # long documents first: fewer items reach the goal
        pool.reverse()
        got, chosen = _subset([size[i] for i, _, _ in pool], [n for _, _, n in pool], wanted, up)
        if abs(wanted - got) < abs(best) or abs(wanted - got) == abs(best) and (got > wanted) == up != (best < 0):
            best, found = wanted - got, [(i, n - back) for (i, back, _), n in zip(pool, chosen, strict=True)]
        if len(pool) == len(some) and all(n == counts[i] for i, _, n in pool):
            break
    for i, change in found or ():
        taken[i] += change
    return taken


def source_targets(totals: DataFrame, source: str, cap: float = 3.0, weights: tuple = (1, 2, 3)) -> DataFrame:
    """totals (source, source_size) with its target: a share by weight of all words, at most cap times its size.

    Sources stand in order of code points, null last, and take the weights in turn. What a capped
    source can't take is shared by weight among the others, until none is above its cap.
    """
    parts = max(1, min(cores(totals.sparkSession) * 2, 200))
    dealt = checkpointed(
        totals.repartitionByRange(parts, F.col(source).asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    )
    before, start = {}, 0
    for part, n in sorted((r[0], r[1]) for r in dealt.groupBy("__part").count().collect()):  # a row for each partition
        before[part], start = start, start + n
    if not start:
        return totals.withColumn("target", F.lit(0.0))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    at = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(source).asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = dealt.withColumn("__weight", F.get(turn, ((at + offset[F.col("__part")]) % len(weights)).cast("int")))
    rows = checkpointed(rows.withColumn("__cap", F.col("source_size") * float(cap)).drop("__part"))
    everything = rows.agg(F.sum("source_size")).first()[0]
    unit, capped = 0.0, -1
    while True:  # the unit only rises, so a capped source stays capped
        over = F.col("__weight") * unit >= F.col("__cap") if capped >= 0 else F.lit(False)
        n, held, weight = rows.agg(
            F.sum(F.when(over, 1).otherwise(0)),
            F.sum(F.when(over, F.col("__cap")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("__weight"))),
        ).first()
        if n == capped or not weight:
            break
        capped, unit = n, (everything - held) / weight
    target = F.least(F.col("__cap"), F.col("__weight") * unit)
    return rows.withColumn("target", target).drop("__weight", "__cap")


#: Columns that mix_sources adds, in this order.
ADDED = ("size", "source_size", "target", "copies")


def mix_sources(
    documents: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    seed: int = 7,
    cap: int = 3,
    weights: tuple = (1, 2, 3),
    keep_text: bool = True,
    names: tuple = ADDED,
) -> DataFrame:
    """Rows of documents with size, source_size, target and copies (0 to cap), under the names given.

    Size is the number of whitespace words (null text: 0). A source takes each document as often
    as its target holds its whole size; for the remaining budget, documents are counted by exact
    length, the bounded-knapsack program says how many of each length are taken once more, and
    those with the smallest seeded hash of doc_id are. Null sources are one source; rows without
    words are never taken; repeated rows and null ids (hashed by their text) count as rows of their
    own (equal rows are interchangeable, so reruns agree). Extra columns are kept unless keep_text
    is false, which keeps doc_id and source only; a name given that documents has already gets an
    underscore. An empty table gives no rows.

    Only counts by (source, length) reach one task, at most one row for each length that occurs.
    The documents of one source and length are dealt into PARTS hash parts; a part is ranked only
    within itself, so a hot source or length doesn't meet in one task.
    """
    kept = documents.columns if keep_text else [doc_id, source]
    size, total, target, copies, body, place, part, site, n, before, whole, more, rank = free(
        kept, *names, "body", "place", "part", "site", "n", "before", "whole", "more", "rank"
    )
    rows = documents.select(*[documents[f"`{c}`"] for c in kept], documents[f"`{text}`"].alias(body))
    rows = rows.withColumn(size, F.coalesce(F.regexp_count(F.col(body), F.lit(WORD)), F.lit(0)).cast("long"))
    key = F.col(f"`{doc_id}`")
    rows = rows.withColumn(place, F.xxhash64(F.lit(seed), key, F.when(key.isNull(), F.xxhash64(body)))).drop(body)
    rows = rows.withColumn(part, F.pmod(F.xxhash64(F.col(place)), F.lit(PARTS)).cast("int"))
    named = F.concat(F.lit("="), F.col(f"`{source}`").cast("string"))
    rows = rows.withColumn(site, F.coalesce(named, F.lit("~")))  # never null, and null last
    counts = checkpointed(rows.groupBy(site, size, part).agg(F.count(F.lit(1)).alias(n)))
    lengths = checkpointed(counts.groupBy(F.col(site).alias("site"), F.col(size).alias("size")).agg(F.sum(n).alias("n")))
    totals = lengths.groupBy("site").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = checkpointed(source_targets(totals, "site", cap, weights))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        held, wanted = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        times = min(cap, int(wanted // held)) if held else 0
        once = np.zeros(len(pdf), dtype=np.int64)
        if held and times < cap:
            once = fit_lengths(pdf["size"].to_numpy(), pdf["n"].to_numpy(), wanted - times * held)
        return pdf[["site", "size"]].assign(source_size=held, target=wanted, whole=times, more=once)

    plan = lengths.join(targets, "site").groupBy("site").applyInPandas(
        fitted, "site string, size long, source_size long, target double, whole long, more long"
    )
    plan = plan.toDF(site, size, total, target, whole, more)
    earlier = Window.partitionBy(site, size).orderBy(part)
    shares = counts.withColumn(before, F.sum(n).over(earlier) - F.col(n))
    left = F.greatest(F.lit(0), F.least(F.col(n), F.col(more) - F.col(before)))
    shares = checkpointed(shares.join(plan, [site, size]).withColumn(more, left).drop(n, before))
    ranked = F.row_number().over(Window.partitionBy(site, size, part).orderBy(place, F.col(f"`{doc_id}`")))
    out = rows.withColumn(rank, ranked).join(shares, [site, size, part])
    once = (F.col(rank) <= F.col(more)).cast("long")
    taken = F.when(F.col(size) == 0, F.lit(0).cast("long")).otherwise(F.col(whole) + once)
    return out.select(*[f"`{c}`" for c in kept], size, total, target, taken.alias(copies))
