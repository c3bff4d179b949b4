"""Benchmark decontamination by CGK embedding and bit-sampling LSH."""

import bisect
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.llm.common import U64, WordHashes, checkpointed, free, mixed, plain_words, text_batches, text_key, texts_of, trimmed

#: Edits (in words) up to this share of an item's words are a match.
EDITS = 0.2
#: Random walks, tables for each walk and symbols sampled for each table.
WALKS, TABLES, SAMPLES = 4, 8, 4
#: Words of items in one index, which is what is sent to executors at once; more items are searched in blocks.
BLOCK_WORDS = 2_000_000


def allowed_edits(n: int, share: float = EDITS) -> int:
    return int(n * share + 1e-9)


def cgk_tables(x: np.ndarray, walks: int, tables: int, samples: int, seed: int) -> np.ndarray:
    """LSH keys (rows, walks * tables) of the rows of x, word hashes of equal length.

    Each walk (Chakraborty, Goldenberg and Koucky, 2016) copies the row to three times its length:
    at every step the current word is written, and a random bit of step and word says whether to
    move on. Edit distance becomes Hamming distance. Each table keeps a few sampled steps.
    """
    n, length = x.shape
    steps = 3 * length
    padded = np.concatenate([x, np.zeros((n, 1), dtype=U64)], axis=1)
    rows = np.arange(n)
    random = np.random.default_rng([seed, length])
    out = np.zeros((n, walks * tables), dtype=U64)
    for w in range(walks):
        salts = random.integers(1, 2**63, size=steps, dtype=np.uint64) | U64(1)
        picked = random.integers(0, steps, size=(tables, samples))
        uses: dict[int, list[int]] = {}
        for t, s in np.ndindex(tables, samples):
            uses.setdefault(int(picked[t, s]), []).append(t)
        at = np.zeros(n, dtype=np.int64)
        for j in range(steps):
            symbol = padded[rows, at]
            for t in uses.get(j, ()):
                c = w * tables + t
                out[:, c] = mixed(out[:, c] * U64(0x9E3779B97F4A7C15) + symbol + salts[j])
            at = np.minimum(at + ((symbol * salts[j]) >> U64(63)).astype(np.int64), length)
    return out


def best_alignment(item: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """(edits, start, end) of the run of words nearest to item; of equals the first end, then the longest run."""
    cost, start = [0] * (len(words) + 1), list(range(len(words) + 1))
    for i, a in enumerate(item, 1):
        above, first = cost[0], start[0]
        cost[0], start[0] = i, 0
        for j, b in enumerate(words, 1):
            here, origin = above + (a != b), first
            above, first = cost[j], start[j]
            if above + 1 < here:
                here, origin = above + 1, first
            if cost[j - 1] + 1 < here:
                here, origin = cost[j - 1] + 1, start[j - 1]
            cost[j], start[j] = here, origin
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    return cost[end], start[end], end


class ItemIndex:
    """Benchmark items, to be searched for in texts."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = EDITS, seed: int = 3):
        self.items, self.share, self.seed = [], share, seed
        self.ids: dict[bytes, int] = {}
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        by_length: dict[int, list[int]] = {}
        hashes = WordHashes()
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            number, k = len(self.items), allowed_edits(len(words), share)
            self.items.append((item_id, words))
            by_length.setdefault(len(words), []).append(number)
            at = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=U64)
            q = min(8, len(words) // (k + 1))
            for j in range(k + 1):
                offset = j * len(words) // (k + 1)
                key = int(self._gram(at[offset : offset + q], q)[0])
                pieces.setdefault(q, {}).setdefault(key, []).append((number, offset))
        self.pieces = {q: (np.array(sorted(d), dtype=U64), d) for q, d in pieces.items()}
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        for length, numbers in by_length.items():
            x = np.array([hashes.of(self.items[i][1]) for i in numbers], dtype=U64)
            keys = cgk_tables(x, WALKS, TABLES, SAMPLES, seed)
            found = self.tables.setdefault(length, {})
            for row, i in zip(keys.tolist(), numbers, strict=True):
                for t, key in enumerate(row):
                    found.setdefault((t, key), []).append(i)

    @staticmethod
    def _gram(ids: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(len(ids) - q + 1, dtype=U64)
        for j in range(q):
            out = out * U64(0x9E3779B97F4A7C15) + ids[j : j + len(out)]
        return mixed(out)

    def _pieces_in(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, item, offset) of item pieces in a run of word numbers, 0 for words of no item."""
        known, out = ids > 0, []
        for q, (keys, owners) in self.pieces.items():
            if len(ids) < q:
                continue
            whole = known[: len(ids) - q + 1].copy()
            for j in range(1, q):
                whole &= known[j : j + len(whole)]
            at = np.flatnonzero(whole)
            grams = np.zeros(len(at), dtype=U64)
            for j in range(q):
                grams = grams * U64(0x9E3779B97F4A7C15) + ids[at + j].astype(U64)
            grams = mixed(grams)
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for i in np.flatnonzero(keys[place] == grams):
                out += [(int(at[i]), number, offset) for number, offset in owners[int(grams[i])]]
        return out

    def search(self, words_of: Iterable[list[bytes]]) -> list[list[dict]]:
        """Matches in each text (a list of words).

        Of the k + 1 equal pieces of an item, k edits leave one untouched, so only windows that
        hold a piece where it belongs, give or take k words, are embedded: no match is lost by it.
        Words are kept only of texts with such windows.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        texts: dict[int, list[bytes]] = {}
        out: list[list[dict]] = []
        group: list[tuple[int, int, list[bytes]]] = []
        ids: list[int] = []

        def flush() -> None:
            begins = [x[1] for x in group]
            for place, number, offset in self._pieces_in(np.array(ids, dtype=np.int64)):
                d, begin, words = group[bisect.bisect_right(begins, place) - 1]
                length = len(self.items[number][1])
                k = allowed_edits(length, self.share)
                centre = place - begin - offset
                span = range(max(0, centre - k), min(len(words), centre + k + 1))
                windows.setdefault(length, set()).update((d, s) for s in span)
                texts[d] = words
            group.clear()
            ids.clear()

        for words in words_of:
            group.append((len(out), len(ids), words))
            out.append([])
            ids.extend(map(self.ids.get, words, repeat(0)))
            ids.append(0)
            if len(ids) > 200_000:
                flush()
        flush()
        hashes = WordHashes()
        near: dict[tuple[int, int], set[int]] = {}
        for length, unsorted in windows.items():
            places = sorted(unsorted)
            found = self.tables[length]
            for block in range(0, len(places), 4096):
                part = places[block : block + 4096]
                x = np.zeros((len(part), length), dtype=U64)
                for r, (d, s) in enumerate(part):
                    got = hashes.of(texts[d][s : s + length])
                    x[r, : len(got)] = got
                keys = cgk_tables(x, WALKS, TABLES, SAMPLES, self.seed)
                for (d, s), row in zip(part, keys.tolist(), strict=True):
                    for t, key in enumerate(row):
                        for i in found.get((t, key), ()):
                            near.setdefault((d, i), set()).add(s)
        for (d, i), starts in sorted(near.items()):
            item_id, item = self.items[i]
            k = allowed_edits(len(item), self.share)
            runs: list[list[int]] = []
            for s in sorted(starts):
                if k and runs and s - runs[-1][1] <= k + 1:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for first, last in runs:
                low = max(0, first - k)
                region = texts[d][low : last + len(item) + k]
                if sum(map(set(region).__contains__, item)) < len(item) - k:
                    continue  # each word that isn't there costs an edit
                edits, start, end = best_alignment(item, region)
                if edits <= k:
                    match = {"item_id": item_id, "start": low + start, "end": low + end, "edits": edits}
                    if match not in out[d]:
                        out[d].append(match)
        return out


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


_MATCHES = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def _sized(items: DataFrame, item_id: str, text: str) -> tuple[int, DataFrame]:
    """(blocks of about BLOCK_WORDS words, (i, t) of all items with an id and a text)."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    return max(1, -(-total // (6 * BLOCK_WORDS))), rows


def _collected(block: DataFrame) -> list[tuple[int, bytes]]:
    """The items of one block, whose size is bounded."""
    return sorted({(r["i"], r["t"].encode()) for r in block.collect()})


def benchmark_matches(
    documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = EDITS, name: str = "matches",
) -> DataFrame:
    """documents with a column `name` of array<struct<item_id, start, end, edits>>: benchmark items that a text holds.

    Words are runs of letters and digits, A-Z lower-cased. An item of n words is found where some
    run of words is within int(share * n) word edits of it; start and end are word numbers. Windows
    of an item's length are embedded and looked up in the item's tables; those that share a bucket
    with an item are aligned exactly; starts up to k + 1 words apart are one place, reported once at its nearest run (the first
    end, then the longest, of equals); without edits allowed each start is a place. Items without words, null items and null ids are never
    found; null and empty texts hold nothing; a repeated item is found once for each id. All rows
    and columns stay.
    """
    spark = documents.sparkSession
    n, rows = _sized(items, item_id, item_text)
    if n == 1:
        index = ItemIndex(_collected(rows), share)
        return documents.withColumn(name, _searched(F.col(f"`{text}`"), spark.sparkContext.broadcast(index)))
    # a block of items is sent, searched for and taken back before the next: what executors hold doesn't grow with the items
    key, t1, t2, part = free(documents.columns, "key", "t1", "t2", "part")
    keyed = documents.select("*", *(x.alias(c) for x, c in zip(text_key(F.col(f"`{text}`")), (t1, t2), strict=True)))
    one = checkpointed(documents.select(*text_key(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text")).dropDuplicates(["t1", "t2"]))
    found = None
    for b in range(n):
        sent = spark.sparkContext.broadcast(ItemIndex(_collected(rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)), share))
        held = one.select("t1", "t2", _searched(F.col("text"), sent).alias("m")).where(F.size("m") > 0)
        held = checkpointed(held)
        sent.destroy()
        found = held if found is None else found.unionByName(held)
    found = found.groupBy("t1", "t2").agg(F.flatten(F.collect_list("m")).alias(name)).withColumnsRenamed({"t1": key, "t2": part})
    out = keyed.join(found, (keyed[t1] == F.col(key)) & (keyed[t2] == F.col(part)), "left").drop(key, part, t1, t2)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(_MATCHES)))


def _searched(text, sent):
    text_batches()

    @F.arrow_udf(_MATCHES)
    @trimmed
    def of(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.search(map(plain_words, texts_of(column))), type=_FOUND)

    return of.asNondeterministic()(text)
