"""Substring dedup with repeated-phrase automata."""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import U64, WordHashes, checkpointed, cores, run_hashes, text_batches, text_key, texts_of

#: Words of a window, and of the grams that windows are found by.
WINDOW, GRAM = 35, 12
#: Anchors of the texts of one shard, about, and grams of one automaton; a shard with more is streamed through several.
SHARD_ANCHORS, AUTOMATON_GRAMS = 100_000, 100_000
#: Letters that words stand as in automata, and phrases that share a gram from which on they are a crowd.
LETTERS, CROWD = 64, 8
#: What is known of candidate texts is broadcast up to so many bytes, and shuffled beyond.
BROADCAST_BYTES = 48 << 20
#: Bits of a place that number the words of a text; the others number the texts.
WORD_BITS = 26

_GRAM_BASE, _ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive elements."""
    m, w = x, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def window_anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, for each window the smallest of its grams' hashes)."""
    grams = run_hashes(h, gram, _GRAM_BASE)
    return grams, sliding_min(grams, window - gram + 1)


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors_column(text, window: int, gram: int):
    """Words, digest of all words, and anchors: each once, or twice if it stands in the text more than once."""
    kind = pa.struct([("n_words", pa.int64()), ("digest", pa.string()), ("anchors", pa.list_(pa.int64()))])
    nothing = np.zeros(0, dtype=np.int64)

    @F.arrow_udf("n_words long, digest string, anchors array<long>")
    def of(column: pa.Array) -> pa.Array:
        hashes, out = WordHashes(), []
        for x in texts_of(column):
            words = x.split() if x else []
            found = nothing
            if len(words) >= window:
                grams, least = window_anchors(hashes.of(words), window, gram)
                chosen, times = np.unique(grams[np.isin(grams, np.unique(least))], return_counts=True)
                found = np.concatenate([chosen, chosen[times > 1]]).view(np.int64)
            out.append({"n_words": len(words), "digest": kept_digest(words), "anchors": found})
        return pa.array(out, type=kind)

    return of.asNondeterministic()(text)


def _packed(text):
    """Texts as they're stored and shuffled; Spark stores checkpoints as they are."""

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=1).compress
        return pa.array([None if x is None else compress(x) for x in texts_of(column)], type=pa.binary())

    return of(text)


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist())


def _candidates(text: bytes, anchors: np.ndarray, window: int, gram: int, hashes: WordHashes):
    """(words, word hashes, starts of windows whose anchor recurs)."""
    words = text.split()
    h = hashes.of(words)
    _, least = window_anchors(h, window, gram)
    return words, h, np.flatnonzero(np.isin(least, anchors.view(U64)))


def cut_phrases(words: list[bytes], h: np.ndarray, starts: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, int, bytes]]:
    """(anchor, place of its gram, words) of the passages that consecutive windows with the same anchor's gram make up."""
    grams, least = window_anchors(h, window, gram)
    span = window - gram + 1
    at = np.array([s + int(np.argmin(grams[s : s + span])) for s in starts.tolist()], dtype=np.int64)
    breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(at) != 0)) + 1
    for first, last in zip(np.r_[0, breaks].tolist(), np.r_[breaks, len(starts)].tolist(), strict=True):
        begin, end = int(starts[first]), int(starts[last - 1]) + window
        yield int(least[begin : begin + 1].view(np.int64)[0]), int(at[first]) - begin, b" ".join(words[begin:end])


class Letters(dict):
    """One of LETTERS characters for each word, by its hash; remembers up to `most` words.

    Automata over them have few branches at a node, which are searched one by one; words that share a
    character are told apart where a phrase is compared.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> str:
        letter = chr(LETTERS + xxhash.xxh64_intdigest(word, LETTERS) % LETTERS)
        if len(self) < self.most:
            self[word] = letter
        return letter

    def of(self, words: list[bytes]) -> str:
        return "".join(map(self.__getitem__, words))


class Shard:
    """Automata over the anchors' grams of phrases; texts are streamed past them, and phrases grown from each place where one is found.

    A phrase is kept as its bytes, joined by spaces; its words, each an object, would take several times the memory.
    """

    def __init__(self, window: int, gram: int, hashes: WordHashes | None = None, letters: Letters | None = None):
        self.window, self.gram = window, gram
        self.hashes, self.letters = WordHashes() if hashes is None else hashes, Letters() if letters is None else letters
        self.phrases: dict[str, list[tuple[int, int, bytes]]] = {}
        self.automata: list[ahocorasick.Automaton] = []
        self.crowd = np.zeros((2, 0), dtype=U64)

    def add(self, offset: int, phrase: bytes) -> None:
        words = phrase.split()
        self.phrases.setdefault(self.letters.of(words[offset : offset + self.gram]), []).append((offset, len(words), phrase))

    def _windows(self, words: list[bytes]) -> np.ndarray:
        """The 128-bit hash of each window, in two rows."""
        h = self.hashes.of(words)
        return np.stack([run_hashes(h, self.window, b) for b in (_ONE, _TWO)])

    def compile(self) -> None:
        keys, crowd = list(self.phrases), []
        for at in range(0, len(keys), AUTOMATON_GRAMS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
            for key in keys[at : at + AUTOMATON_GRAMS]:
                found = self.phrases.pop(key)
                if len(found) > CROWD:
                    crowd += [self._windows(phrase.split()) for *_, phrase in found]
                    found = None
                automaton.add_word(key, found)
            automaton.make_automaton()
            self.automata.append(automaton)
        if crowd:
            self.crowd = np.concatenate(crowd, axis=1)
            self.crowd = self.crowd[:, np.argsort(self.crowd[0], kind="stable")]

    def _crowded(self, words: list[bytes], places: list[int]) -> np.ndarray:
        """Starts of the windows around these places of grams that are windows of a phrase, by their hash."""
        back = np.arange(self.window - self.gram + 1)
        starts = np.unique(np.array(places)[:, None] - back)
        starts = starts[(starts >= 0) & (starts <= len(words) - self.window)]
        if not len(starts):
            return starts
        one, two = self._windows(words)[:, starts]
        at = np.minimum(np.searchsorted(self.crowd[0], one), self.crowd.shape[1] - 1)
        return starts[(self.crowd[0, at] == one) & (self.crowd[1, at] == two)]

    def located(self, words: list[bytes]) -> np.ndarray:
        """Whether each word lies in a window of a phrase.

        A phrase's windows are all confirmed, so any `window` of its words or more that stand around its gram are.
        Where more than CROWD phrases share a gram, they aren't grown one by one: the windows around the place are
        looked up among all of theirs.
        """
        mask, gram = np.zeros(len(words) + 1, dtype=np.int64), self.gram
        letters, crowded = self.letters.of(words) if self.automata else "", []
        for automaton in self.automata:
            for end, found in automaton.iter(letters):
                at = end + 1 - gram
                if found is None:
                    crowded.append(at)
                    continue
                for offset, length, joined in found:
                    low, high = at - offset, at - offset + length
                    if low < 0 or b" ".join(words[low:high]) != joined:
                        phrase = joined.split()
                        if words[at : end + 1] != phrase[offset : offset + gram]:
                            continue
                        left = 0
                        while left < offset and left < at and words[at - left - 1] == phrase[offset - left - 1]:
                            left += 1
                        low, high = at - left, end + 1
                        rest = phrase[offset + gram :]
                        for a, b in zip(rest, words[high : high + len(rest)], strict=False):
                            if a != b:
                                break
                            high += 1
                        if high - low < self.window:
                            continue
                    mask[low] += 1
                    mask[high] -= 1
        if crowded:
            starts = self._crowded(words, crowded)
            mask[starts] += 1
            mask[starts + self.window] -= 1
        return np.cumsum(mask[:-1]) > 0


def repeated_phrases(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans for every row of documents.

    Words are whitespace runs, unchanged. A word is removed if it lies in a window of `window`
    words whose sequence starts anywhere else too, in the same text or another; windows are judged
    on the input. kept_sha256 is of the kept words joined by one space; spans are the removed runs
    as array<struct<start, end>> of word numbers. Null, empty and short texts lose nothing; copies
    lose all words if they have `window` of them. Repeated rows are copies. Other columns are
    ignored; an empty table gives no rows.

    1. Each window's anchor is the smallest hash among its grams, the same wherever the window
       stands; anchors that stand once in the corpus can't lie in a recurring window.
    2. Windows with a recurring anchor are counted by a 128-bit hash. Of each that stands more than
       once, one place in the corpus is kept; what these places make up, cut by anchor, are the phrases.
    3. Texts are dealt into shards, and each phrase goes to the shards that have its anchor. There
       automata over the anchors' grams are compiled, all texts are streamed past them, and what is
       found is grown to the phrase's words on both sides. No place is known before it's found.

    Exact copies of a text are worked on once. Counts are pre-aggregated, so a passage that many
    documents share is one row for each task, and one phrase for each shard.
    """
    text_batches()
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), _anchors_column(F.col(text), window, gram).alias("x")
    )
    row = F.monotonically_increasing_id().alias("row")
    rows = checkpointed(rows.select(row, "doc_id", "t1", "t2", "x.n_words", "x.digest", "x.anchors"))
    long = rows.where(F.size("anchors") > 0)
    copies = long.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("chosen"))
    one = long.join(copies, ["t1", "t2"]).where("row = chosen")
    placed = one.select("row", "copies", F.explode("anchors").alias("anchor"))
    recurring = placed.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    known = placed.join(recurring, "anchor").groupBy("row").agg(F.max("copies").alias("copies"), F.collect_set("anchor").alias("anchors"))
    known = known.join(rows.select("row", "t1", "t2", F.col("doc_id").alias("chosen")), "row").drop("row")
    known = checkpointed(known)
    size = known.agg(F.sum(F.size("anchors") * 8 + 96)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    known = F.broadcast(known) if small else known
    whole = F.col(text) if small else _packed(F.col(text))  # all texts are shuffled then
    keyed = documents.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), whole.alias("text")).alias("d")
    same = F.expr("d.t1 = k.t1 and d.t2 = k.t2 and d.doc_id <=> k.chosen")
    texts = keyed.join(known.alias("k"), same).select("d.t1", "d.t2", "copies", "anchors", (_packed(F.col("text")) if small else F.col("text")).alias("text"))
    texts = checkpointed(texts)

    sizes = sorted(map(tuple, texts.groupBy(F.spark_partition_id()).count().collect()))  # a row for each partition
    before, n = {}, 0
    for part, count in sizes:
        before[part], n = n, n + count
    if not n:
        return _results(rows, documents.sparkSession.createDataFrame([], _REMOVED))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.spark_partition_id()]
    number = offset.cast("long") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    texts = texts.withColumn("number", number)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["place", "copies", "w1", "w2"]
        for batch in batches:
            numbers, copies, anchors = (batch.column(c).to_pylist() for c in ("number", "copies", "anchors"))
            parts, n = [], 0
            for i, x in enumerate(_unpacked(batch.column("text"))):
                _, h, starts = _candidates(x, np.array(anchors[i], dtype=np.int64), window, gram, hashes)
                w1, w2 = (run_hashes(h, window, b)[starts].view(np.int64) for b in (_ONE, _TWO))
                place = (np.int64(numbers[i]) << WORD_BITS) + starts.astype(np.int64)
                parts.append((place, np.full(len(starts), copies[i], dtype=np.int64), w1, w2))
                n += len(starts)
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
                    parts, n = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    counted = texts.select("number", "copies", "anchors", "text").mapInArrow(windows, "place long, copies long, w1 long, w2 long")
    counted = counted.groupBy("w1", "w2").agg(F.sum("copies").alias("n"), F.max("place").alias("place")).where("n > 1")
    kept = counted.select(F.shiftright("place", WORD_BITS).alias("number"), F.col("place").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("start"))
    kept = checkpointed(kept.groupBy("number").agg(F.array_sort(F.collect_list("start")).alias("starts")))
    size = kept.agg(F.sum(F.size("starts") * 8 + 32)).first()[0] or 0
    chosen = texts.select("number", "text").join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, "number").select("starts", "text")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for starts, x in zip(batch.column("starts").to_pylist(), _unpacked(batch.column("text")), strict=True):
                words = x.split()
                out += cut_phrases(words, hashes.of(words), np.array(starts, dtype=np.int64), window, gram)
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary())
                columns = [pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "gram_at", "words"])

    pieces = chosen.mapInArrow(phrases, "anchor long, gram_at int, words binary")
    total = texts.agg(F.sum(F.size("anchors").cast("long"))).first()[0]
    shards = max(2 * cores(documents.sparkSession), -(-total // SHARD_ANCHORS))
    dealt = texts.withColumn("shard", F.pmod("t1", F.lit(shards)))
    asked = dealt.select("shard", F.explode("anchors").alias("anchor")).distinct()
    sent = asked.join(pieces, "anchor").select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("t2"), "gram_at", "words")
    both = sent.unionByName(dealt.select("shard", F.lit(1).alias("kind"), "t1", "t2", F.lit(None).cast("int").alias("gram_at"), F.col("text").alias("words")))
    both = both.repartition("shard").sortWithinPartitions("shard", "kind")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard: first its phrases, then its texts."""
        hashes, letters, unpack = WordHashes(), Letters(), zstandard.ZstdDecompressor().decompress
        shard, number, ready = Shard(window, gram, hashes, letters), None, False
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
        names = ["t1", "t2", "n_removed", "kept", "spans"]
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "t1", "t2", "gram_at", "words")]
            for own, is_text, t1, t2, at, x in zip(*columns, strict=True):
                if own != number:
                    shard, number, ready = Shard(window, gram, hashes, letters), own, False
                if not is_text:
                    shard.add(at, x)
                    continue
                if not ready:
                    shard.compile()
                    ready = True
                if not shard.automata:
                    continue
                words = unpack(x).split()
                gone = shard.located(words)
                if gone.any():
                    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2).tolist()
                    left = kept_digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    out.append((t1, t2, int(gone.sum()), left, [{"start": s, "end": e} for s, e in edges]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _results(rows, both.mapInArrow(located, _REMOVED))


_REMOVED = "t1 long, t2 long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def _results(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """What is removed of each row; rows of texts that lose nothing keep all words."""
    removed = removed.dropDuplicates(["t1", "t2"])  # a text is there twice if its row is
    out = rows.select("doc_id", "t1", "t2", "n_words", "digest").join(removed, ["t1", "t2"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "digest").alias("kept_sha256"), F.coalesce("spans", F.array().cast(dict(removed.dtypes)["spans"])).alias("spans"),
    )
