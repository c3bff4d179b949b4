"""Near copies at a stated similarity: SimHash by multi-index hashing, then exact prefix filtering for what it misses."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopsight.llm.common import U64, WordHashes, checkpointed, compact, cores, discard, lower_words, mixed, run_hashes, text_batches, text_key, texts_of, trimmed
from loopsight.llm.components import connected_components
from loopsight.llm.simhash import keep_first, link_fingerprints, majority_bits

#: Shingles in several of every 16th set are common and come last in the order of prefixes. The order only decides how many
#: candidates there are; any order that is the same for all texts finds all links, so the list may be short.
_COUNTED, _OFTEN, _COMMON = 16, 3, 200_000
#: A key that at least 16 of every 64th set's entries name is dealt out before its rows are gathered.
_SAMPLE, _HOT = 64, 16
#: Hot keys are sent to all executors up to this many (16 bytes each), and joined by shuffle beyond.
_SENT = 100_000
#: Keys (16 bytes each) of texts to compare are sent to all executors up to this many, and joined by shuffle beyond.
_ASKED = 500_000
#: Words whose hashes a worker remembers, and texts it holds at once.
_WORDS, _TEXTS = 100_000, 256
#: Differing bits at which fingerprints link, and rounds of stars before all that is left of a key is compared.
_RADIUS, _ROUNDS = 2, 2
#: Sets of a key that are compared among themselves without another round.
_FEW = 8
#: Slack of float comparisons that rule a pair out before it is compared exactly.
_SLACK = 1e-9


def shingle_set(text: bytes | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the runs of `shingle` words; a text of fewer words is one run, one without words has none."""
    words = lower_words(text)
    return np.unique(run_hashes(hashes.of(words), min(shingle, len(words)), 0x9E3779B97F4A7C15)) if words else np.zeros(0, U64)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 shingles, by how common they are, then by hash.

    Sets of this similarity have a shingle of their prefixes in common, whatever their sizes.
    common is sorted, counts are those of its values.
    """
    n = len(shingles)
    if not n:
        return shingles
    size = n - math.ceil(similarity * n - _SLACK) + 1
    at = np.minimum(np.searchsorted(common, shingles), max(0, len(common) - 1))
    often = np.where(common[at] == shingles, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    return shingles[np.argsort(often, kind="stable")[:size]]


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each of a power of two (2n or more) of slots: whether an odd number of shingles falls into it."""
    slots = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    at = (mixed(shingles ^ U64(0xA0761D6478BD642F)) & U64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_similar(n: int, x: bytes, m: int, y: bytes) -> float:
    """The highest similarity that two sets of these sizes and parities can have."""
    while len(x) != len(y):  # slots of a longer one, laid on each other, are those of a shorter one
        x, y = sorted((x, y), key=len)
        half = len(y) // 2
        y = (int.from_bytes(y[:half], "little") ^ int.from_bytes(y[half:], "little")).to_bytes(half, "little")
    apart = max(abs(n - m), (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count())
    return (n + m - apart) / max(1, n + m + apart)


def _common(documents: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, sorted, and how many of the counted texts have each."""

    @F.arrow_udf("array<long>")
    @trimmed
    def of(column: pa.Array) -> pa.Array:
        hashes = WordHashes(most=_WORDS)
        return pa.array([shingle_set(x, shingle, hashes).view(np.int64) for x in texts_of(column)], type=pa.list_(pa.int64()))

    some = documents.where(F.xxhash64(F.col(text)) % _COUNTED == 0).select(of(F.col(text)).alias("s")).distinct()
    counts = some.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(_COMMON).toPandas()
    values = found["h"].to_numpy(dtype=np.int64).view(U64)
    by = np.argsort(values)
    return values[by], found["n"].to_numpy(dtype=np.int64)[by]


def _described(text, shingle: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """A struct column: size, 128-bit hash, parities and prefix of a text's set of shingles, its SimHash and its rare shingles' number."""
    names = ("n", "s1", "s2", "rare", "fp", "bits", "prefix")
    kind = pa.struct([(c, pa.int64()) for c in names[:5]] + [("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    @F.arrow_udf("n long, s1 long, s2 long, rare long, fp long, bits binary, prefix array<long>")
    @trimmed
    def of(column: pa.Array) -> pa.Array:
        hashes, out = WordHashes(most=_WORDS), []
        for at in range(0, len(column), _TEXTS):
            some = []
            for x in texts_of(column.slice(at, _TEXTS)):
                s = shingle_set(x, shingle, hashes)
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                first = prefix(s, similarity, common, counts).view(np.int64)
                rare = len(s) - int(np.isin(s, common, assume_unique=True).sum())
                fp = np.array([majority_bits(s)], dtype=U64).view(np.int64)[0]
                some.append(dict(zip(names, (len(s), s1, s2, rare, fp, parities(s), first), strict=True)))
            out.append(pa.array(some, type=kind))
        return pa.concat_arrays(out) if out else pa.array([], type=kind)

    return of(text)


def _most(n, x, m, y):
    @F.arrow_udf("double")
    def of(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([most_similar(*row) for row in zip(*(c.to_pylist() for c in (n, x, m, y)), strict=True)], type=pa.float64())

    return of(n, x, m, y)


def _similarity(a, b, shingle: int):
    @F.arrow_udf("double")
    @trimmed
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        hashes, out = WordHashes(most=_WORDS), []
        for x, y in zip(texts_of(left), texts_of(right), strict=True):
            x, y = shingle_set(x, shingle, hashes), shingle_set(y, shingle, hashes)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, type=pa.float64())

    return of(a, b)


def _entries(prints: DataFrame) -> DataFrame:
    """(key, id, n, at): the prefix of each set, each with its place in the order."""
    return prints.select(F.posexplode("prefix").alias("at", "key"), "id", "n").select("key", "id", "n", "at")


def _starred(entries: DataFrame) -> DataFrame:
    """(key, id, n, at, centre, nc, sets): entries of keys that several sets share, with the smallest id's set as centre.

    Copies of one text have what it holds in common and rare shingles where they were edited, and ids
    grow with the number of rare shingles, so the text that they were made from is the centre wherever it's there.
    """
    by_key = Window.partitionBy("key")
    first = F.min(F.struct("id", "n")).over(by_key)
    stars = entries.withColumns({"c": first, "sets": F.count(F.lit(1)).over(by_key)}).where("sets > 1")
    return stars.select("key", "id", "n", "at", F.col("c.id").alias("centre"), F.col("c.n").alias("nc"), "sets")


def _stars(prints: DataFrame) -> DataFrame:
    """_starred entries; keys that a sample shows to be hot are summed up before rows are joined by key, a join that Spark can split."""
    entries = _entries(prints)
    some = _entries(prints.where(F.xxhash64("id") % _SAMPLE == 0))
    hot = compact(checkpointed(some.groupBy("key").count().where(F.col("count") >= _HOT).select("key")))
    n = hot.count()
    if not n:
        return _starred(entries)
    keys = F.broadcast(hot) if n <= _SENT else hot
    busy = entries.join(keys, "key", "left_semi")
    centres = busy.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("sets"))
    centres = centres.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("nc"), "sets")
    met = busy.join(F.broadcast(centres) if n <= _SENT else centres, "key")
    return _starred(entries.join(keys, "key", "left_anti")).unionByName(met)


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose SimHashes differ in up to _RADIUS bits: a star for each fingerprint, and one pair for two of them."""
    first = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    same = prints.select("fp", "id").join(first, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    links = link_fingerprints(first.select("fp"), _RADIUS)
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"i{c}")) for c in ("a", "b"))
    return same.unionByName(links.join(left, "a").join(right, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")))


def _close(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """(a, b, most): the pairs, each once, whose sizes and parities allow a similarity of `least`, with the highest they allow."""
    left = prints.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = prints.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    even = F.least("na", "nb") >= F.greatest("na", "nb") * least - _SLACK
    met = once.join(left, "a").join(right, "b").where(even)
    return met.select("a", "b", _most(F.col("na"), F.col("xa"), F.col("nb"), F.col("xb")).alias("most")).where(F.col("most") >= least - _SLACK)


def _rooted(rows: DataFrame, links: DataFrame, *ids: str) -> DataFrame:
    """rows with the root of each of the id columns as r<id>; links is what connected_components gives."""
    for c in ids:
        named = links.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        rows = rows.join(named, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return rows


def _even(n, m, least: float):
    """Whether the sizes allow a similarity of `least`."""
    return F.least(n, m) >= F.greatest(n, m) * least - _SLACK


def _may_begin(n, x, m, y, similarity: float):
    """Whether sets of sizes n and m whose first common shingle is at places x and y can reach the similarity."""
    return F.least(n - x, m - y) * (1 + similarity) >= (n + m) * similarity - _SLACK


def near_copy_groups(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, t1, t2 (128-bit hash of the text), root (one long for each group), one row per row.

    Texts are linked whose sets of `shingle` words (A-Z lower-cased) have a Jaccard similarity of
    `similarity` or more; groups are what links join. Null, empty and blank texts are one group. A
    text of fewer words is one shingle. Repeated rows stay; null ids are ids like any other; other
    columns are ignored; an empty table gives no rows.

    Candidates come from the texts' SimHashes (distinct shingles, 64 bits), linked at up to two
    bits by multi-index hashing, and, as that misses most pairs near the similarity, from prefix
    filtering: two sets of that similarity have a shingle of their prefixes in common. Sizes, places
    and parities rule out only pairs that can't reach it; all others are compared on the texts'
    shingles. So no link is lost and none is guessed.

    Within a key all are compared with one centre (see _starred). The similarity's complement is a
    metric: a set near the centre and one further than twice the distance that links can't be
    linked. So what isn't near goes on to a centre of its own, what is neither near nor that far is
    compared with those near the centre, and only _FEW sets, or what is left after _ROUNDS centres, are
    compared among themselves; of
    all these only sets that links don't join yet. Nothing is capped, and a group of copies isn't
    expanded into pairs.
    """
    text_batches()
    key = text_key(F.col(text))
    # texts are read where they lie; only what describes their sets is shuffled
    about = _described(F.col(text), shingle, similarity, *_common(documents, text, shingle))
    rows = checkpointed(documents.select(F.col(doc_id).alias("doc_id"), *key, about.alias("x")).select("doc_id", "t1", "t2", "x.*"))
    prints = rows.groupBy("s1", "s2").agg(F.min(F.struct("t1", "t2", "n", "rare", "fp", "bits", "prefix")).alias("first"))
    # ids grow with the number of rare shingles (see _starred)
    ordered = prints.select("s1", "s2", "first.*").repartitionByRange(2 * cores(documents.sparkSession), "rare", "s1").sortWithinPartitions("rare", "s1", "s2")
    prints = checkpointed(ordered.drop("rare").withColumn("id", F.monotonically_increasing_id()))

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= _ASKED else rows

    def kept(rows: DataFrame) -> DataFrame:
        return compact(checkpointed(rows))

    def compared(asked: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose texts have the similarity."""
        ends = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = kept(prints.join(ends, "id", "left_semi").select("id", "t1", "t2"))
        texts = checkpointed(documents.select(*key, F.col(text).alias("text")).join(sent(wanted), ["t1", "t2"]).groupBy("id").agg(F.min("text").alias("text")))
        shown = asked.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return kept(shown.where(_similarity(F.col("ta"), F.col("tb"), shingle) >= similarity).select("a", "b"))

    far = 2 * similarity - 1  # below this a set can't be linked to one that is near the centre
    stars, links, cross = checkpointed(_stars(prints)), None, []
    for turn in range(_ROUNDS):
        spokes = stars.where((F.col("id") != F.col("centre")) & _even(F.col("n"), F.col("nc"), far))
        spokes = spokes.select(F.col("centre").alias("a"), F.col("id").alias("b"))
        close = kept(_close(spokes if turn else spokes.unionByName(_fingerprint_pairs(prints)), prints, far))
        near = compared(close.where(F.col("most") >= similarity - _SLACK).select("a", "b"))
        links = near if links is None else links.unionByName(near)
        direct = sent(near.select(F.col("a").alias("centre"), F.col("b").alias("id")))
        missed = close.join(near, ["a", "b"], "left_anti").select(F.col("a").alias("centre"), F.col("b").alias("id"))
        cross.append((stars.join(sent(kept(missed)), ["centre", "id"], "left_semi"), stars.join(direct, ["centre", "id"], "left_semi")))
        rest = stars.where("id <> centre").join(direct, ["centre", "id"], "left_anti").select("key", "id", "n", "at")
        stars = checkpointed(_starred(rest))
        discard(documents.sparkSession)
        few = stars.where(F.col("sets") <= (_FEW if turn < _ROUNDS - 1 else 1 << 62))
        cross.append((few, few))
        stars = stars.where(F.col("sets") > _FEW)
        if turn < _ROUNDS - 1 and stars.isEmpty():
            break
    roots = kept(connected_components(links))
    met = None
    for one, other in cross:
        left = one.select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("px"))
        right = other.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("py"))
        both = left.join(right, "key").where(F.col("x") < F.col("y") if one is other else F.col("x") != F.col("y"))
        both = both.where(_even(F.col("nx"), F.col("ny"), similarity) & _may_begin(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), similarity))
        both = both.select("x", "y").distinct()
        met = both if met is None else met.unionByName(both)
    met = _rooted(met, roots, "x", "y").where("rx <> ry").select(F.col("x").alias("a"), F.col("y").alias("b"))
    close = kept(_close(met, prints, similarity).select("a", "b"))
    if not close.isEmpty():
        more = compared(close)
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more))
    named = prints.join(roots, prints["id"] == roots["node"], "left").select("s1", "s2", F.coalesce("root", "id").alias("root"))
    return rows.select("doc_id", "t1", "t2", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "t1", "t2", "root")


def drop_near_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents, all columns, less all but one document of each group of near copies (see keep_first)."""
    return keep_first(documents, checkpointed(near_copy_groups(documents, text, doc_id, shingle, similarity)), text, doc_id)
