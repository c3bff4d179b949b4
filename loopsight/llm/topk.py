"""Exact top-k search by columnar branch-and-bound."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopsight.llm.common import checkpointed, cores, spread

#: Dimensions that are added to the scores before candidates are pruned again.
DIMENSIONS = 8
#: Candidates in one vertical block.
BLOCK_ROWS = 4096
#: Queries of one task, and of one pass over a block: at most so many, which bounds what is held.
QUERY_ROWS, PASS_ROWS = 4096, 256
#: Where less than this share of pairs is left, they are followed one by one instead of as a matrix.
SPARSE = 0.1

_BLOCK = "block long, dims int, norm double, ids binary, rows binary, data binary"
_LEAST, _MOST = -(2**63), 2**63 - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, v array<double> of whole numbers) as blocks with one run of bytes for each dimension."""
    waiting: dict[int, list] = {}

    def block(dims: int, rows: list) -> pa.RecordBatch:
        number = np.array([r[0] for r in rows], dtype=np.int64)
        data = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), dims)
        norms = np.sqrt((data * data).sum(1))
        order = np.argsort(-norms, kind="stable")  # long ones first: they raise the thresholds
        data = data[order].T
        narrow = np.int16 if np.abs(data).max(initial=0) < 2**15 else np.float64
        ids = np.array([r[1] for r in rows], dtype=np.int64)[order]
        columns = [[int(number[0])], [dims], [float(norms.max(initial=0.0))], [ids.tobytes()], [number[order].tobytes()]]
        columns.append([np.ascontiguousarray(data.astype(narrow)).tobytes()])
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "dims", "norm", "ids", "rows", "data"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = waiting.setdefault(len(row[2]), [])
            group.append(row)
            if len(group) == BLOCK_ROWS:
                yield block(len(row[2]), waiting.pop(len(row[2])))
    for dims, rows in waiting.items():
        yield block(dims, rows)


def _unpacked(dims: int, ids: bytes, rows: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number = np.frombuffer(rows, dtype=np.int64)
    kind = np.int16 if len(data) == 2 * dims * len(number) else np.float64
    return np.frombuffer(ids, dtype=np.int64), number, np.frombuffer(data, dtype=kind).reshape(dims, len(number)).astype(np.float64)


def _whole(values: np.ndarray) -> list:
    return [int(x) for x in values.tolist()]


class Best:
    """The k best candidates so far of each of some queries (rows of data are dimensions)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.rows, self.k, self.dims = ids, rows, k, len(data)
        self.vectors = np.ascontiguousarray(data.T, dtype=np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))
        blocks = [np.arange(c, min(c + DIMENSIONS, self.dims)) for c in range(0, self.dims, DIMENSIONS)]
        mass = np.array([(self.vectors[:, b] ** 2).sum(1) for b in blocks]).reshape(len(blocks), len(ids))
        # dimensions that hold most of the queries' mass come first
        by = np.argsort(-mass.sum(1), kind="stable")
        self.blocks = [blocks[i] for i in by]
        self.left = np.vstack([np.cumsum(mass[by][::-1], axis=0)[::-1][1:], np.zeros((1, len(ids)))]) if blocks else mass
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.found = np.zeros(0, dtype=np.int64)
        self.worst = np.full(len(ids), -np.inf)  # the k-th best score, as a bound for doubles

    def add(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray) -> None:
        """Compares a block of candidates with all queries."""
        # doubles hold these sums exactly; wider ones are added up as Python integers
        bound = int(self.largest) * int(np.abs(data).max(initial=0.0)) * max(self.dims, 1)
        if bound >= 2**53:
            return self._add_wide(ids, rows, data)
        mass = [(data[b] ** 2).sum(0) for b in self.blocks]
        left = [np.sum(mass[i + 1 :], axis=0) if i + 1 < len(mass) else np.zeros(len(ids)) for i in range(len(mass))]
        for at in range(0, len(self.ids), PASS_ROWS):
            self._pass(np.arange(at, min(at + PASS_ROWS, len(self.ids))), ids, rows, data, left)

    def _pass(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, left: list) -> None:
        """Scores grow block by block of dimensions; what can't reach a query's k-th best score goes.

        By Cauchy and Schwarz, what is left of two vectors adds no more than the root of both masses.
        """
        vectors, worst = self.vectors[q], self.worst[q]
        alive, score = np.arange(len(ids)), np.zeros((len(q), len(ids)))
        pairs = None  # (query, candidate) where few are left
        for i, b in enumerate(self.blocks):
            rest_q, rest_c = self.left[i][q], left[i]
            if pairs is None:
                score += vectors[:, b] @ data[np.ix_(b, alive)]
                reach = score + np.sqrt(np.multiply.outer(rest_q, rest_c[alive])) * (1 + 1e-9) + 1e-6
                keep = reach >= worst[:, None]
                n = int(keep.sum())
                if n < SPARSE * keep.size:
                    x, y = np.nonzero(keep)
                    pairs, score = (x, alive[y]), score[x, y]
                    continue
                some = keep.any(0)
                if some.sum() < 0.7 * len(alive):
                    alive, score = alive[some], score[:, some]
            else:
                x, y = pairs
                score = score + np.einsum("ij,ji->i", vectors[np.ix_(x, b)] if len(x) else np.zeros((0, len(b))), data[np.ix_(b, y)])
                keep = score + np.sqrt(rest_q[x] * rest_c[y]) * (1 + 1e-9) + 1e-6 >= worst[x]
                pairs, score = (x[keep], y[keep]), score[keep]
        if pairs is None:
            x, y = np.nonzero(score >= worst[:, None])
            pairs, score = (x, alive[y]), score[x, y]
        x, y = pairs
        other = rows[y] != self.rows[q[x]]
        self._merge(q[x[other]], score[other].astype(np.int64), ids[y[other]])

    def _add_wide(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray) -> None:
        exact = [_whole(c) for c in data.T]
        for i, vector in enumerate(self.vectors):
            v = _whole(vector)
            y = np.flatnonzero(rows != self.rows[i])
            scores = [min(max(sum(a * b for a, b in zip(v, exact[j], strict=True)), _LEAST), _MOST) for j in y.tolist()]
            self._merge(np.full(len(y), i), np.array(scores, dtype=np.int64), ids[y])

    def _merge(self, query: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        if not len(query):
            return
        query, score, found = (np.concatenate(c) for c in ((self.query, query), (self.score, score), (self.found, found)))
        order = np.lexsort((found, ~score, query))  # ~score falls as score rises, without overflow
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        order = order[rank < self.k]
        self.query, self.score, self.found = query[rank < self.k], score[order], found[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) >= self.k)
        last = np.searchsorted(self.query, full, side="right") - 1
        self.worst[full] = np.nextafter(self.score[last].astype(np.float64), -np.inf) if len(full) else self.worst[full]


def top_k(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", every: int = 20, k: int = 20, scale: float = 64.0
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query, ties to smaller ids.

    Components become floor(scale * x), x as double. Queries are the rows whose id is divisible by
    `every`; candidates are all rows but the query's own. Rows with a null id, a null vector, or a
    component that is null, non-finite or non-finite once scaled take no part; vectors are compared
    with those of equal length. A repeated row is a candidate (and a query) of its own. A query with
    fewer candidates gets all of them. Scores are exact; one beyond a long is the nearest long, and
    ranks with it. Extra columns are ignored; an empty table gives no rows.

    Candidates lie in vertical blocks, one run of memory for each dimension. The work is dealt in
    tiles, a block of queries and a slice of the candidate blocks, one to a task; the best k of each
    query and slice are merged. Scores grow by DIMENSIONS dimensions at a time, then candidates
    that can't reach the k-th best score so far go.
    """
    x = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull())
    scaled = F.transform(x, lambda e: e * F.lit(float(scale)))
    rows = rows.select("id", scaled.alias("v")).where(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf))))
    # doubles hold floor(x) exactly whatever its size; the function of that name gives longs
    down = F.transform(x, lambda e: F.when(F.abs(e) < F.lit(2.0**53), F.floor(e).cast("double")).otherwise(e))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "id", down.alias("v")))
    blocks = checkpointed(rows.mapInArrow(_packed, _BLOCK))
    asked = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-n // QUERY_ROWS)
    slices = max(1, -(-3 * cores(vectors.sparkSession) // groups))
    slices = min(slices, max(1, blocks.count()))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile: first its queries, then blocks of candidates."""
        tile, best, waiting = None, {}, {}

        def results() -> Iterator[pa.RecordBatch]:
            for b in best.values():
                if len(b.query):
                    columns = [pa.array(b.rows[b.query]), pa.array(b.ids[b.query]), pa.array(b.found), pa.array(b.score)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != tile:
                    yield from results()
                    tile, best, waiting = row["tile"], {}, {}
                if row["v"] is not None:
                    waiting.setdefault(len(row["v"]), []).append((row["row"], row["id"], row["v"]))
                    continue
                for dims, some in waiting.items():
                    number, ids = (np.array([r[i] for r in some], dtype=np.int64) for i in (0, 1))
                    data = np.array([r[2] for r in some], dtype=np.float64).reshape(len(some), dims).T
                    best[dims] = Best(ids, number, data, k)
                waiting.clear()
                if row["dims"] in best:
                    best[row["dims"]].add(*_unpacked(row["dims"], row["ids"], row["rows"], row["data"]))
        yield from results()

    queries = asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn(
        "tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.col("group") * slices + i))
    )
    one = queries.selectExpr(
        "tile", "cast(null as double) as norm", "row", "id", "v", "cast(null as int) as dims", "cast(null as binary) as ids",
        "cast(null as binary) as rows", "cast(null as binary) as data",
    )
    sliced = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).withColumn(
        "tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: i * slices + F.col("slice")))
    )
    other = sliced.selectExpr(
        "tile", "norm", "cast(null as long) as row", "cast(null as long) as id", "cast(null as array<double>) as v", "dims",
        "ids", "rows", "data",
    )
    dealt = spread(one.unionByName(other), "tile", groups * slices).sortWithinPartitions("tile", F.desc_nulls_first("norm"))
    found = dealt.mapInArrow(answered, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
