"""Stupid-backoff language-model scores."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import U64, WORD, WordHashes, lower_words, mixed, text_batches, texts_of

#: Words of one batch of documents, within which n-grams are counted before they are shuffled.
BATCH_WORDS = 2_200_000
#: Words of the corpus for each part of the count tables.
PART_WORDS = 2_000_000
ALPHA, MIN_COUNT, ORDER = 0.4, 2, 3


def _squeezed(values: np.ndarray) -> bytes:
    """values, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueezed(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    planes = flat.reshape(width, len(flat) // width)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as batches of word numbers: (batch, ids, lengths, words, tokens)."""
    hashes = WordHashes(seed=17)
    ids, lengths, parts, n, made = [], [], [], 0, 0
    task = TaskContext.get().partitionId() << 33

    def packed() -> pa.RecordBatch:
        h = np.concatenate(parts) if parts else np.zeros(0, dtype=U64)
        words, tokens, counts = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which compress
        number = np.empty(len(order), dtype=np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task + made], type=pa.int64()),
                pa.array([np.array([x or 0 for x in ids], dtype=np.int64).tobytes()], type=pa.binary()),
                pa.array([np.array([x is None for x in ids], dtype=bool).tobytes()], type=pa.binary()),
                pa.array([lengths], type=pa.list_(pa.int32())), pa.array([words[order].tobytes()], type=pa.binary()),
                pa.array([_squeezed(number[tokens])], type=pa.binary()), pa.array([len(h)], type=pa.int64()),
            ],
            ["batch", "ids", "nulls", "lengths", "words", "tokens", "n"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            h = hashes.of(lower_words(text))
            ids.append(doc_id)
            lengths.append(len(h))
            parts.append(h)
            n += len(h)
            if n >= BATCH_WORDS or len(ids) >= 200_000:
                yield packed()
                ids, lengths, parts, n, made = [], [], [], 0, made + 1
    if ids:
        yield packed()


def _ngrams(h: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, place of its last word); none crosses a document's end."""
    if order == 1:
        return h, np.arange(len(h))
    if len(h) < order:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.flatnonzero(at >= order - 1)
    out = np.zeros(len(last), dtype=U64)
    for j in range(order):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + h[last - (order - 1 - j)] + U64(order))
    return out, last


def _part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins in sorted keys."""
    begins = np.array([(i << 64) // parts for i in range(parts)], dtype=object).astype(U64)
    return np.append(np.searchsorted(keys, begins), len(keys))


def score_documents(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, alpha: float = ALPHA,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """doc_id (a long), n_words, log_score for every row: the sum over words of log10 of their stupid-backoff score.

    Words are whitespace runs, A-Z lower-cased. Counts are over all rows of documents (repeated rows
    and copies count as often as they stand there). The score of a word after its context is
    count(context, word) / count(context) for the longest context, up to order - 1 words of the
    same text, with which it stands min_count times or more, times alpha for each word that the
    context was shortened by; without any it is count(word) / N. Null and empty texts have no words
    and log_score 0; ids may be null or repeated; other columns are ignored.

    Documents are packed into batches, whose n-grams are counted before anything is shuffled. A
    count table of each order is partitioned by hash into ranges: a range gets each batch's sorted
    n-grams with their counts, adds them up, and sends the sums back in the same order, which joins
    them to the batch's n-grams. A frequent n-gram is one row of each batch, so none is hot.

    N-grams stand as 64-bit hashes: of N distinct ones about N * N / 2^65 pairs share a hash and add up
    (0.03 at 10^9, 27,000 at 10^12). ngram_tables.score_by_tables counts the n-grams themselves.
    """
    kind = "batch long, ids binary, nulls binary, lengths array<int>, words binary, tokens binary, n long"
    text_batches()
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    batches = rows.mapInArrow(_batches, kind).repartition("batch")  # one exchange, which both of its uses read
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long"))).first()[0] or 0
    parts = max(12, -(-total // PART_WORDS))

    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(row["words"], dtype=U64)
        return words[_unsqueezed(row["tokens"], np.uint32)], np.asarray(row["lengths"], dtype=np.int64)

    def asked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "part", "batch", "keys", "counts"]
        for record in rows:
            for row in record.to_pylist():
                h, lengths = unpacked(row)
                for o in range(1, order + 1):
                    keys, counts = np.unique(_ngrams(h, lengths, o)[0], return_counts=True)
                    bounds = _part_bounds(keys, parts)
                    out: list[list] = [[], [], [], [], []]
                    for p in range(parts):
                        low, high = int(bounds[p]), int(bounds[p + 1])
                        if low < high:
                            slice_ = keys[low:high]
                            packed = _squeezed(np.diff(slice_, prepend=U64(0)))
                            for c, v in zip(out, (o, p, row["batch"], packed, _squeezed(counts[low:high].astype(np.uint32))), strict=True):
                                c.append(v)
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.cumsum(_unsqueezed(x, U64), dtype=U64) for x in pdf["keys"]]
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.concatenate([_unsqueezed(x, np.uint32) for x in pdf["counts"]])
        sums = np.bincount(place, weights=counts, minlength=len(keys))[place].astype(np.int64)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        pdf = pdf[["gram", "part", "batch"]].copy()
        pdf["counts"] = [_squeezed(x) for x in np.split(sums, cuts)]
        return pdf

    def scored(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        h, lengths = unpacked(row)
        counts = []  # of the n-gram of each order that ends at a word; 0 where the text has begun too late
        for o in range(1, order + 1):
            keys, last = _ngrams(h, lengths, o)
            distinct, place = np.unique(keys, return_inverse=True)
            got = right[right["gram"] == o].sort_values("part")["counts"]
            sums = np.concatenate([_unsqueezed(x, np.int64) for x in got]) if len(got) else np.zeros(0, dtype=np.int64)
            if len(sums) != len(distinct):
                raise ValueError("counts of n-grams are missing")
            full = np.zeros(len(h), dtype=np.int64)
            full[last] = sums[place]
            counts.append(full)
        at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        longest = np.minimum(at, order - 1)  # words of context there are
        score = np.log10(counts[0] / max(total, 1)) + np.log10(alpha) * longest if len(h) else np.zeros(0)
        for o in range(2, order + 1):
            use = np.flatnonzero(counts[o - 1] >= max(min_count, 1))
            context = counts[o - 2][use - 1]
            score[use] = np.log10(counts[o - 1][use] / context) + np.log10(alpha) * (longest[use] - (o - 1))
        sums = np.zeros(len(lengths))
        some = lengths > 0
        if len(h):
            sums[some] = np.add.reduceat(score, (np.cumsum(lengths) - lengths)[some])
        ids = pd.array(np.frombuffer(row["ids"], dtype=np.int64), dtype="Int64")
        ids[np.frombuffer(row["nulls"], dtype=bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": lengths, "log_score": sums})

    counts = batches.mapInArrow(asked, "gram int, part int, batch long, keys binary, counts binary")
    counts = counts.groupBy("gram", "part").applyInPandas(added, "gram int, part int, batch long, counts binary")
    return batches.groupBy("batch").cogroup(counts.groupBy("batch")).applyInPandas(
        scored, "doc_id long, n_words long, log_score double"
    )
