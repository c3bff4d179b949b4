"""SimHash near-duplicates by multi-index hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import U64, checkpointed, compact, free, lower_words, text_batches, text_key, texts_of
from loopsight.llm.components import connected_components

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)
_WEIGHTS = U64(1) << np.arange(64, dtype=U64)
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text, unsigned: a bit is 1 if it is set in over half of the shingle hashes."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    of = xxhash.xxh64_intdigest
    pairs = zip(starts.tolist(), ends.tolist(), strict=True)
    return majority_bits(np.fromiter((of(joined[s:e], seed) for s, e in pairs), dtype=U64, count=len(starts)))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        lanes = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(_WEIGHTS[2 * counts > len(hashes)].sum()) if len(hashes) else 0


def fingerprint_column(text, shingle: int = 3, seed: int = 42):
    """fingerprint() of a text column, as a signed long with the same 64 bits."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        values = np.array([fingerprint(x, shingle, seed) for x in texts_of(column)], dtype=U64)
        return pa.array(values.view(np.int64))

    return of(text)


def _low(column):
    return column.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(column):
    return F.shiftrightunsigned(column, 32)


def _flips(column):
    """A 32-bit segment and the 32 values at one bit's distance."""
    ball = [F.lit(0)] + [F.lit(1 << i) for i in range(32)]
    return F.transform(F.array(*[x.cast("long") for x in ball]), lambda m: column.bitwiseXOR(m))


def link_fingerprints(prints: DataFrame, radius: int = 2, crowded: int = 64) -> DataFrame:
    """Links (a, b) that join the distinct longs `fp` at up to `radius` (0, 1 or 2) differing bits.

    Two segments of 32 bits: of two fingerprints within two bits, either the high segments differ
    in one bit at most, or the low segments are equal. The ball of radius one about each high
    segment is enumerated (a flip is only asked for where the bit is 0: its neighbour has the same
    bit at 1 and needs not ask), its members are looked up in the table of segments, and pairs met
    are verified over all 64 bits.

    A bucket of more than `crowded` fingerprints isn't paired. Within it, the other segments are
    hashed again: equal ones under all one-bit flips meet exactly when they differ in up to two
    bits, so each such key links its members to its smallest one (same components, no pairs).
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius is 0, 1 or 2")
    fp = F.col("fp")
    high = prints.select("fp", F.lit(0).alias("seg"), _high(fp).alias("key"), _low(fp).alias("rest"))
    low = prints.select("fp", F.lit(1).alias("seg"), _low(fp).alias("key"), _high(fp).alias("rest"))
    entries = high.unionByName(low)
    full = entries.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = compact(checkpointed(full.where(F.col("n") > crowded).select("seg", "key")))
    calm = entries.join(hot, ["seg", "key"], "left_anti")
    bits = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        lambda m: F.col("key").bitwiseAND(m) == 0,
    )
    asked = high.select("fp", "seg", "rest", F.explode(bits).alias("bit"), "key").select(
        "fp", "seg", (F.col("key") + F.col("bit")).alias("key"), "rest"
    )
    found = calm.select("seg", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    same = calm.select("seg", "key", F.col("fp").alias("a")).join(found, ["seg", "key"]).where(F.col("a") < F.col("b"))
    links = same.where(near).select("a", "b")
    if radius == 0:
        return links.limit(0)
    probes = asked.select("seg", "key", F.col("fp").alias("a"))
    links = links.unionByName(probes.join(found, ["seg", "key"]).where(near).select("a", "b"))
    if hot.isEmpty():
        return links
    crowd = entries.join(hot, ["seg", "key"], "left_semi")
    ball = crowd.select("seg", "key", "fp", F.explode(_flips(F.col("rest"))).alias("near"))
    if radius == 2:
        centre = ball.groupBy("seg", "key", "near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
        within = ball.join(centre.where("n > 1"), ["seg", "key", "near"]).where(F.col("fp") != F.col("b"))
        within = within.select(F.col("fp").alias("a"), "b")
    else:
        exact = crowd.select("seg", "key", F.col("rest").alias("near"), F.col("fp").alias("b"))
        within = ball.select("seg", "key", "near", F.col("fp").alias("a")).join(exact, ["seg", "key", "near"])
        within = within.where(F.col("a") < F.col("b")).select("a", "b")
    links = links.unionByName(within)
    # one bit spent in the high segment leaves radius - 1 for the rest
    to_hot = asked.join(hot, ["seg", "key"], "left_semi")
    rest = _flips(F.col("rest")) if radius == 2 else F.array(F.col("rest"))
    to_hot = to_hot.select("seg", "key", F.explode(rest).alias("near"), F.col("fp").alias("a"))
    exact = crowd.select("seg", "key", F.col("rest").alias("near"), F.col("fp").alias("b"))
    return links.unionByName(to_hot.join(exact, ["seg", "key", "near"]).select("a", "b"))


def simhash_components(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """doc_id, t1, t2 (128-bit hash of the text), fp, root (one long for each group), component_id, one row per row.

    Words are whitespace runs with A-Z lower-cased; shingles count with repeats; a text of fewer
    words is one shingle. Null, empty and blank texts have fingerprint 0 and are linked like any
    other. component_id is the smallest doc_id reachable over links of up to `radius` bits; null
    ids take no part in that, so it's null only if a group holds no id. Repeated rows stay, each
    with its row. Other columns are ignored, whatever their names; an empty table gives no rows.
    Exact copies are one fingerprint: only distinct fingerprints are linked.
    """
    text_batches()
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), fingerprint_column(F.col(text), shingle, seed).alias("fp")
    )
    rows = checkpointed(rows)
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(link_fingerprints(prints.select("fp"), radius))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(groups, "root")
    return rows.join(named, "fp").select("doc_id", "t1", "t2", "fp", "root", "component_id")


def hex_of(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(documents: DataFrame, rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of documents, all columns, less all but one document of each root.

    rows holds doc_id, t1, t2 and root of every row of documents. The document with the smallest
    id stays (null ids come last; then the smallest text hash), as one row even if that row is
    repeated.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first")
    kept = checkpointed(rows.groupBy("root").agg(first).select("first.doc_id", "first.t1", "first.t2"))
    a, b, name, k_id, k1, k2 = free(documents.columns, "t1", "t2", "name", "k_id", "k1", "k2")
    kept = kept.toDF(k_id, k1, k2)
    t1, t2 = text_key(documents[f"`{text}`"])
    keyed = documents.select("*", t1.alias(a), t2.alias(b))
    same = keyed[f"`{doc_id}`"].eqNullSafe(F.col(k_id)) & (keyed[a] == F.col(k1)) & (keyed[b] == F.col(k2))
    out = keyed.join(kept, same, "left_semi")
    repeated = rows.groupBy("doc_id", "t1", "t2").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(f"`{doc_id}`").cast("string")), F.lit("~")))
        out = out.dropDuplicates([name, a, b]).drop(name)
    return out.drop(a, b)
