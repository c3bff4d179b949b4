"""Helpers shared by the operators of this subpackage."""

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: A word of most operators is a run of bytes outside these; bytes.split() splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, stored in the folder that spark.checkpoint.dir names, without its lineage.

    Where neither the session's setting nor its context names one, as in a test on one machine, a
    folder of this machine is used; on a cluster, whose executors couldn't share it, that's an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="loopsight-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


#: Rows of a partition of a small stored table.
COMPACT_ROWS = 100_000


def compact(stored: DataFrame) -> DataFrame:
    """A stored table of narrow rows in as many partitions as it needs; each costs files in every shuffle that reads it."""
    return stored.coalesce(max(1, -(-stored.count() // COMPACT_ROWS)))


def discard(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark removes shuffle and checkpoint files that nothing refers to any more.

    It does so by itself every half an hour; a loop of many rounds would fill disks before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one Arrow batch of texts.
TEXT_ROWS = 1000


def text_batches() -> None:
    """Has the session hand texts to Python in batches of up to TEXT_ROWS rows, unless it already does in smaller ones.

    Each batch stands in memory several times, on both sides, and texts are long; Spark's own
    10,000 rows are meant for numbers. The setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def trimmed(function):
    """function, after which the process gives back to the system what it doesn't use any more.

    Python workers stay when a task has ended, and allocators keep what a large batch took.
    """

    @functools.wraps(function)
    def called(*args):
        out = function(*args)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        return out

    return called


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, column: str, n: int) -> DataFrame:
    """df dealt by a column of numbers 0 to n - 1, each to a partition of its own.

    Numbers that are hashed fall on the same partition by chance; here each is replaced by a value
    whose hash is its partition.
    """
    spark = df.sparkSession
    some = spark.range(64 + 24 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    values = dict(map(tuple, some.collect()))  # n rows: one for each task
    if len(values) < n:
        return df.repartition(n, column)
    (key,) = free(df.columns, "key")
    table = F.array(*[F.lit(values[p]) for p in range(n)])
    return df.withColumn(key, F.get(table, F.col(column).cast("int"))).repartition(n, key).drop(key)


def texts_of(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lower_words(text: bytes | None) -> list[bytes]:
    """Whitespace words with A-Z lower-cased (bytes.lower leaves other letters alone)."""
    return text.lower().split() if text else []


#: Lower-cases A-Z, keeps digits, letters and bytes of non-ASCII characters, makes all else a space.
_PLAIN = bytes(
    (b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_PLAIN).split() if text else []


class WordHashes(dict):
    """XXH64 of words; remembers up to `most` of them, so memory is bounded whatever the vocabulary."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def run_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive elements of h; base is odd."""
    if len(h) < k:
        return np.zeros(0, dtype=U64)
    out = np.zeros(len(h) - k + 1, dtype=U64)
    # doubling: hash of 2^j elements from two of 2^(j-1); k is a sum of powers of two
    width, part, at, power = 1, h, 0, int(base)
    left = k
    while True:
        if left & 1:
            out = out * U64(power & 0xFFFFFFFFFFFFFFFF) + part[at : at + len(out)]
            at += width
        left >>= 1
        if not left:
            return mixed(out)
        part = part[:-width] * U64(power) + part[width:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2


def text_key(column) -> list:
    """Two 64-bit hashes that stand for a text (128 bits together); null texts get those of nothing."""
    return [F.xxhash64(column).alias("t1"), F.xxhash64(F.lit(1), column, F.lit(2)).alias("t2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
