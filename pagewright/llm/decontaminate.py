"""Benchmark decontamination.

For each benchmark item, windows as long as the item slide over every text.  A
window that shares no shingle with an item is nothing like it, so windows are
taken where a shingle of the benchmark occurs.  Each window's SimHash comes
from prefix sums of its shingles' bits; a multi-index looks it up among the
items of that length: fingerprints are cut into ``radius`` + 1 blocks, and one
within the radius agrees in a block at least.  The weighted Jaccard similarity
of the shingle counts then decides, exactly.

The benchmark is the stated query set.  It is taken in blocks of about
``block`` items, each of which is one pass over the texts, so what a task holds
has a bound whatever the benchmark's size.

Words are runs of letters, digits and non-ASCII, A-Z in lower case; shingles
have five words, and of shorter items (or texts) all words make one.

Defined cases: null or wordless texts and items match nothing; repeated rows
match alike; a text shorter than an item is one window; ties between windows
go to the first.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORD_BYTES, Buffer, ngrams, per_text, text_slices
from .simhash import BITS

WORDS, SIMILARITY, RADIUS, BLOCK = 5, 0.8, 18, 20_000
#: Bits of the table that tells most shingles are not of the benchmark.
SIEVE = 22


def _shingles(texts: list[bytes], k: int):
    """Shingle hashes of ``k`` words, their first words and texts; words per text."""
    buffer = Buffer(texts)
    buffer.data = LOWER[buffer.data]
    start, end, owner = buffer.words(WORD_BYTES)
    words = buffer.hashes(start, end)
    hashes, at = ngrams(words, owner, k)
    return hashes, at, owner, words


def simhash_windows(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each run [start, end) of shingle hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    over = (sums[ends] - sums[starts]) * 2 > (ends - starts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


class MultiIndex:
    """Fingerprints by the value of each of ``radius`` + 1 blocks."""

    def __init__(self, fps: np.ndarray, radius: int) -> None:
        self.fps, self.radius = fps, radius
        edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables = []
        for shift, mask in self.blocks:
            value = (fps >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, member) within the radius."""
        found = []
        for (shift, mask), (values, order) in zip(self.blocks, self.tables):
            own = (queries >> shift) & mask
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            count = high - low
            query = np.repeat(np.arange(len(queries)), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            member = order[np.repeat(low, count) + offset]
            close = np.bitwise_count(queries[query] ^ self.fps[member]) <= self.radius
            found.append(query[close] * len(self.fps) + member[close])
        keys = np.unique(np.concatenate(found))
        return keys // len(self.fps), keys % len(self.fps)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Similarity of two multisets."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = sum(min(n, large[x]) for x, n in small.items())
    return both / (a.total() + b.total() - both)


class Items:
    """One block of the benchmark, ready for search."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int, similarity: float, radius: int) -> None:
        self.n, self.similarity = n, similarity
        raw = [(t or "").encode() for t in texts]
        _, _, owner, words = _shingles(raw, 1)
        size = np.bincount(owner, minlength=len(raw))
        self.ids, self.size = ids, size
        self.bags: dict[int, Counter] = {}
        lookup: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        fps = {}
        for k in sorted({min(n, int(s)) for s in size if s}):
            hashes, at, own, _ = _shingles(raw, k)
            for i in np.flatnonzero((np.minimum(size, n) == k)):
                mine = hashes[own[at] == i]
                self.bags[int(i)] = Counter(mine.tolist())
                fps[int(i)] = simhash_windows(mine, np.array([0]), np.array([len(mine)]))[0]
                for h in set(mine.tolist()):
                    lookup[k][h].add(int(size[i]))
        # per shingle size: sorted hashes, a sieve, and the item lengths each belongs to
        self.grams = {}
        for k, table in lookup.items():
            keys = np.array(sorted(table), dtype=np.uint64)
            sieve = np.zeros(1 << SIEVE, dtype=bool)
            sieve[(keys >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
            self.grams[k] = keys, sieve, [sorted(table[int(h)]) for h in keys]
        self.by_length = {}
        for length in sorted({int(s) for s in size if s}):
            members = np.array([i for i in self.bags if size[i] == length])
            self.by_length[length] = members, MultiIndex(np.array([fps[int(i)] for i in members], dtype=np.uint64), radius)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each pair."""
        out = []
        for k, (keys, sieve, lengths) in self.grams.items():
            hashes, at, owner, _ = _shingles(texts, k)
            if not len(hashes):
                continue
            maybe = np.flatnonzero(sieve[(hashes >> np.uint64(64 - SIEVE)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            real = keys[spot] == hashes[maybe]
            hits, spot = maybe[real], spot[real]
            if not len(hits):
                continue
            gram_owner = owner[at]
            first = np.searchsorted(gram_owner, np.arange(len(texts) + 1))
            for text in np.unique(gram_owner[hits]).tolist():
                low, high = first[text], first[text + 1]
                mine = (hits >= low) & (hits < high)
                out += self._windows(text, hashes[low:high], hits[mine] - low, spot[mine], lengths, k)
        return out

    def _windows(self, text, hashes, hits, spot, lengths, k):
        wanted = defaultdict(list)
        for hit, s in zip(hits.tolist(), spot.tolist()):
            for length in lengths[s]:
                wanted[length].append(hit)
        best: dict[int, tuple[float, int, int]] = {}
        for length, at in wanted.items():
            grams = length - k + 1
            last = max(0, len(hashes) - grams)
            # all windows that hold one of the hits
            opened = np.zeros(last + 2, dtype=np.int64)
            at = np.array(at)
            np.add.at(opened, np.clip(at - grams + 1, 0, last), 1)
            np.add.at(opened, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(opened)[:-1] > 0)
            ends = np.minimum(starts + grams, len(hashes))
            members, index = self.by_length[length]
            for window, member in zip(*index.near(simhash_windows(hashes, starts, ends))):
                item = int(members[member])
                bag = Counter(hashes[starts[window]:ends[window]].tolist())
                like = weighted_jaccard(bag, self.bags[item])
                if like >= self.similarity and like > best.get(item, (0.0,))[0]:
                    best[item] = like, int(starts[window]), int(ends[window] - starts[window]) + k - 1
        return [(text, item, *found) for item, found in best.items()]


def benchmark_blocks(benchmark: DataFrame, n: int, similarity: float, radius: int, block: int):
    """The benchmark (item_id, text) as broadcast blocks of about ``block`` items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-items.count() // block))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        if rows:
            yield spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], n, similarity, radius))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS,
    block: int = BLOCK, keep=("doc_id",),
) -> DataFrame:
    """One row per text and item alike: the ``keep`` columns, item_id,
    similarity, first_word and n_words of the most similar window."""
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = T.StructType(source.schema.fields[:-1])
    for name, kind in (("item_id", T.LongType()), ("similarity", T.DoubleType()), ("first_word", T.LongType()), ("n_words", T.LongType())):
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def searcher(held):
        def run(batches):
            items = held.value
            for batch in batches:
                for first, _, texts in text_slices(batch.columns[-1]):
                    found = items.search(texts)
                    rows = pa.array([first + f[0] for f in found], pa.int64())
                    arrays = [c.take(rows) for c in batch.columns[:-1]]
                    arrays.append(pa.array([items.ids[f[1]] for f in found], pa.int64()))
                    arrays += [pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        return run

    out = None
    for held in benchmark_blocks(benchmark, n, similarity, radius, block):
        part = source.mapInArrow(searcher(held), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """The rows of ``docs`` that are like no item, with their own columns."""

    def tester(held):
        def make():
            items = held.value

            def compute(texts: list[bytes]):
                leaks = np.zeros(len(texts), dtype=bool)
                leaks[[f[0] for f in items.search(texts)]] = True
                return [leaks]

            return compute

        return make

    columns = docs.columns
    for held in benchmark_blocks(benchmark, n, similarity, radius, block):
        whole = docs.select(F.struct(*columns).alias("row"))
        found = per_text(whole, tester(held), [("leaks", "boolean")], ["row"], within=("row", "text"))
        docs = found.where("not leaks").select("row.*")
    return docs
