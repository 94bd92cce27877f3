"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are cut into blocks.  Two of them that differ in at most
``radius`` bits agree in all but ``radius`` blocks, so for every choice of
``radius`` blocks the fingerprint is written with the other blocks first and
ranked in Gray order: all that share the leading blocks then lie in one run,
and bits change little from one to the next.  Every run is a small hierarchy:
its fingerprints are grouped in rank order, a node keeps the bits its members
share, and two nodes are compared on the bits both share and their parents do
not, adding to the differences found above; beyond ``radius`` the whole pair of
groups is pruned.  With 8 blocks and radius 2 a run has at most 65,536 members
whatever the size of the corpus.

Only links that join two parts of a run are kept (a spanning forest), so large
groups of copies cost as many rows as members.  Where links are checked for
similarity and some of a group fail, its members are searched again: runs then
hold the shingles too, every pair within reach whose parts are not yet joined is
checked on the spot, and only links that are alike and join two parts leave the
run.  So a failed link hides no other, and a group costs no more rows than it
has members per run.

Defined cases: null or blank text has fingerprint zero and links like any
other; repeated rows share their fingerprint; a null doc_id is kept and takes
part in links, but never names a component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from .common import components, materialize, per_text

BITS, SEED = 64, 42
#: Members of a node, and pairs of nodes compared in one numpy pass.
FANOUT, PAIRS = 16, 8192
#: Bits of a set's sketch, and pairs of sets compared before those joined meanwhile are left out.
SKETCH, CHECKED = 1024, 256


def fingerprint(text: bytes, n: int = 3) -> int:
    """64-bit SimHash of the ``n``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > n:
        starts, ends = starts[:len(words) - n + 1], ends[n - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, keep=("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the 64 bits as a bigint) per row of ``docs``."""

    def make():
        def compute(texts: list[bytes]):
            return [np.array([fingerprint(t, n) for t in texts], dtype=np.uint64).view(np.int64)]

        return compute

    return per_text(docs, make, [("fp", "bigint")], keep)


def hex_digits(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- index ------------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


def arrangements(blocks: int, radius: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Per choice of ``radius`` blocks: the (shift, width) of all blocks, the
    chosen ones last, and the number of bits in the chosen ones."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    cut = [(edges[k], edges[k + 1] - edges[k]) for k in range(blocks)]
    out = []
    for free in combinations(range(blocks), radius):
        order = [b for k, b in enumerate(cut) if k not in free] + [cut[k] for k in free]
        out.append((order, sum(cut[k][1] for k in free)))
    return out


def arrange(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for shift, width in order:
        part = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | part
    return out


def _entries(blocks: int, radius: int):
    """Index rows of fingerprints: arrangement, leading blocks, Gray rank."""
    plan = arrangements(blocks, radius)

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, (order, free) in enumerate(plan):
                rank = gray_rank(arrange(fps, order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), number, dtype=np.int32)),
                     pa.array((rank >> np.uint64(free)).view(np.int64)),
                     pa.array((rank & np.uint64((1 << free) - 1)).view(np.int64)), pa.array(fps.view(np.int64))],
                    names=["arrangement", "run", "rank", "fp"],
                )

    return run


class Forest:
    """Union of small integers, with every root known at any time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            # one link per upper root and pass, so each pass only joins trees
            _, first = np.unique(high, return_index=True)
            target = np.arange(len(self.root))
            target[high[first]] = low[first]
            while True:
                further = target[target]
                if (further == target).all():
                    break
                target = further
            self.root = target[self.root]
            self.links += zip(a[first].tolist(), b[first].tolist())


class Apart(Forest):
    """Collects every pair across given parts instead of joining them."""

    def __init__(self, parts: np.ndarray) -> None:
        super().__init__(len(parts))
        self.root = np.unique(parts, return_inverse=True)[1]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        self.pairs.append((a[apart], b[apart]))


class Alike(Forest):
    """Union of given parts by those links only whose members' sets have a
    Jaccard similarity of at least ``similarity``."""

    def __init__(self, parts: np.ndarray, sets: list[np.ndarray], similarity: float) -> None:
        super().__init__(len(parts))
        _, first, part = np.unique(parts, return_index=True, return_inverse=True)
        self.root = first[part]
        self.sets, self.similarity = sets, similarity
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.sketches = np.empty((len(sets), SKETCH // 64), dtype=np.uint64)
        for k, members in enumerate(sets):
            bits = np.zeros(SKETCH, dtype=bool)
            bits[members.view(np.uint64) % np.uint64(SKETCH)] = True
            self.sketches[k] = np.packbits(bits).view(np.uint64)

    def enough(self, both, a, b):
        return both >= self.similarity * (self.sizes[a] + self.sizes[b] - both)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        a, b = a[apart], b[apart]
        # a bit of one sketch alone is at least one member of that set alone: no alike pair is lost
        x, y = self.sketches[a], self.sketches[b]
        only_a, only_b = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, y & ~x))
        may = self.enough(np.minimum(self.sizes[a] - only_a, self.sizes[b] - only_b), a, b)
        a, b = a[may], b[may]
        while len(a):
            x, y = a[:CHECKED], b[:CHECKED]
            both = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(x, y)])
            good = self.enough(both, x, y)
            super().join(x[good], y[good])
            a, b = a[CHECKED:], b[CHECKED:]
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]


def _hierarchy(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level from members to few nodes: the mask of shared bits and the
    pattern on it."""
    mask, pattern = np.full(len(codes), ~np.uint64(0)), codes
    levels = [(mask, pattern)]
    while len(mask) > FANOUT:
        cuts = np.arange(0, len(mask), FANOUT)
        every = np.bitwise_and.reduceat(mask, cuts)
        same = ~(np.bitwise_or.reduceat(pattern, cuts) ^ np.bitwise_and.reduceat(pattern, cuts))
        mask = every & same
        pattern = pattern[cuts] & mask
        levels.append((mask, pattern))
    return levels


def link_run(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join members of one run (codes in Gray order) at distance
    ``radius`` or less, enough to connect all that can be connected."""
    n = len(codes)
    if n == 2:
        return [(0, 1)] if int(codes[0] ^ codes[1]).bit_count() <= radius else []
    forest = Forest(n)
    levels = _hierarchy(codes)
    # near ones first, so that links that are checked later are the closest there are
    for within in sorted({*range(2, radius, 4), radius}):
        _link_within(codes, levels, forest, within)
    return forest.links


def open_pairs(codes: np.ndarray, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one run (codes in Gray order) at distance ``radius`` or less
    that lie in different ``parts``."""
    apart = Apart(parts)
    _link_within(codes, _hierarchy(codes), apart, radius)
    a, b = (np.concatenate(x) for x in zip(*apart.pairs))
    keys = np.unique(a * len(codes) + b)
    return keys // len(codes), keys % len(codes)


def alike_in_run(codes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of one run (codes in Gray order) between different ``parts`` at
    distance ``radius`` or less whose sets are alike, enough to join all parts
    that such links join."""
    forest = Alike(parts, sets, similarity)
    _link_within(codes, _hierarchy(codes), forest, radius)
    return forest.links


def _link_within(codes: np.ndarray, levels: list, forest: Forest, radius: int) -> None:
    n = len(codes)
    # neighbours in rank first: most groups are one part after this
    near = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= radius)
    forest.join(near, near + 1)
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    stack = [(top, a, b, np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.int64))]
    while stack:
        level, a, b, known, apart = stack.pop()
        mask, pattern = levels[level]
        shared = mask[a] & mask[b]
        apart = apart + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~known).astype(np.int64)
        keep = apart <= radius
        if level:
            # groups that are one part already have nothing to add
            span = FANOUT ** level
            cuts = np.arange(0, n, span)
            low = np.minimum.reduceat(forest.root, cuts)
            one = low == np.maximum.reduceat(forest.root, cuts)
            keep &= ~(one[a] & one[b] & (low[a] == low[b]))
        a, b, shared, apart = a[keep], b[keep], shared[keep], apart[keep]
        if not level:
            forest.join(a, b)
            continue
        below = len(levels[level - 1][0])
        for at in range(0, len(a), PAIRS // 32):
            part = slice(at, at + PAIRS // 32)
            x = (a[part, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            y = (b[part, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            up = np.broadcast_to(shared[part, None, None], x.shape)
            so_far = np.broadcast_to(apart[part, None, None], x.shape)
            fits = (x < below) & (y < below) & (x <= y if level > 1 else x < y)
            stack.append((level - 1, x[fits], y[fits], up[fits], so_far[fits]))


def _search(radius: int):
    """Links within runs, from index rows sorted by arrangement, run and rank."""

    def links(number, run, fps):
        cuts = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (run[1:] != run[:-1]), [True])))
        size = np.diff(cuts)
        left, right = [], []
        pairs = cuts[:-1][size == 2]
        close = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius
        left.append(fps[pairs[close]])
        right.append(fps[pairs[close] + 1])
        for k in np.flatnonzero(size > 2):
            codes = fps[cuts[k]:cuts[k + 1]]
            found = link_run(codes, radius)
            if found:
                a, b = np.array(found).T
                left.append(codes[a])
                right.append(codes[b])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["u", "v"]
        )

    def search(batches):
        held = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3)]
            columns[2] = columns[2].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            number, run, fps = columns
            if not len(number):
                continue
            inner = np.flatnonzero((number != number[-1]) | (run != run[-1]))
            cut = int(inner[-1]) + 1 if len(inner) else 0
            if cut:
                yield links(number[:cut], run[:cut], fps[:cut])
            held = [x[cut:] for x in columns]
        if held is not None and len(held[0]):
            yield links(*held)

    return search


def near_links(fps: DataFrame, radius: int = 2, blocks: int = 8, reach: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that differ in at most
    ``radius`` bits: enough of them to connect every two that a chain connects.
    With a larger ``reach``, links up to it are taken where runs show them."""
    entries = fps.select("fp").mapInArrow(_entries(blocks, radius), "arrangement int, run bigint, rank bigint, fp bigint")
    return (
        entries.repartition("arrangement", "run").sortWithinPartitions("arrangement", "run", "rank")
        .mapInArrow(_search(reach or radius), "u bigint, v bigint")
    )


def _search_alike(radius: int, similarity: float):
    """Alike links that join parts; a group of rows is one group's share of a run."""

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        order = np.argsort(rows.column("rank").to_numpy().view(np.uint64))
        fps, parts = (rows.column(c).to_numpy()[order] for c in ("fp", "part"))
        members = rows.column("members").combine_chunks()
        sets = [members[int(k)].values.to_numpy() for k in order]
        links = alike_in_run(fps.view(np.uint64), parts, sets, radius, similarity) if len(fps) > 1 else []
        u, v = fps[np.array(links, dtype=np.int64).reshape(-1, 2)].T
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return search


def missed_links(
    links: DataFrame, good: DataFrame, sets: DataFrame, radius: int, blocks: int, reach: int | None, similarity: float
) -> DataFrame:
    """Alike links (u, v) within reach that ``links`` left out because a link that
    proved not ``good`` had joined their groups already: enough of them to join
    all parts that such links join."""
    groups = components(links)
    parts = components(good).withColumnRenamed("root", "part")
    rows = groups.join(parts, "node", "left").select("node", "root", F.coalesce("part", "node").alias("part"))
    rows = materialize(rows, "parts")
    # only groups that fell apart can have lost a link
    broken = rows.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("root")
    rows = materialize(lookup(rows, broken, "root", "inner").select(F.col("node").alias("fp"), "root", "part"), "broken")
    entries = rows.select("fp").mapInArrow(_entries(blocks, radius), "arrangement int, run bigint, rank bigint, fp bigint")
    # all within reach in one run are in one group; a run that holds one part of it has nothing to join
    run = Window.partitionBy("arrangement", "run", "root")
    shared = lookup(entries, rows, "fp", "inner").withColumns({"low": F.min("part").over(run), "high": F.max("part").over(run)})
    shared = shared.where("low <> high").drop("low", "high")
    search = _search_alike(reach or radius, similarity)
    return lookup(shared, sets, "fp", "inner").groupBy("arrangement", "run", "root").applyInArrow(search, "u bigint, v bigint").distinct()


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles."""
    words = text.lower().split()
    runs = [b" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype=np.uint64)).view(np.int64)


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                a, b = (batch.column(k)[row].values.to_numpy() for k in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_sets(links: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(fp, members) of the fingerprints of ``links``: the shingles of each one's first document."""
    ends = links.select(F.col("u").alias("fp")).unionByName(links.select(F.col("v").alias("fp"))).distinct()
    firsts = nodes.join(ends, "fp", "left_semi").select("fp", F.col("least").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(firsts, "doc_id").dropDuplicates(["fp"])
    make = lambda: lambda texts: [[shingle_set(t, n) for t in texts]]
    return materialize(per_text(texts, make, [("members", "array<bigint>")], ["fp"]), "shingles")


def alike_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``links``, those whose fingerprints' sets have a Jaccard similarity of
    at least ``similarity``."""
    for end in ("u", "v"):
        links = lookup(links, sets.select(F.col("fp").alias(end), F.col("members").alias(f"of_{end}")), end, "inner")
    return links.select("u", "v", "of_u", "of_v").mapInArrow(_alike(similarity), "u bigint, v bigint")


def near_components(
    docs: DataFrame, n: int = 3, radius: int = 2, blocks: int = 8, reach: int | None = None, similarity: float | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp and component_id, the
    smallest doc_id that chains of links reach.  With ``similarity``, a link also
    needs that Jaccard similarity of the two texts' shingles."""
    rows = materialize(fingerprints(docs, n), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = near_links(nodes, radius, blocks, reach)
    if similarity is not None:
        links = materialize(links.distinct(), "links")
        sets = shingle_sets(links, nodes, docs, n)
        good = materialize(alike_links(links, sets, similarity), "alike")
        links = good.unionByName(materialize(missed_links(links, good, sets, radius, blocks, reach, similarity), "missed"))
    parts = components(links).withColumnRenamed("node", "fp")
    rooted = nodes.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lookup(rooted.select("fp", "root"), lowest, "root", "inner").select("fp", "component_id")
    return lookup(rows, named, "fp", "inner")


#: What the pipeline calls near copies: five words, similarity 0.8, all within 6
#: bits and what the same runs show up to 10.
NEAR = {"n": 5, "radius": 6, "blocks": 9, "reach": 10, "similarity": 0.8}


def drop_near_copies(docs: DataFrame, **near) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest doc_id;
    rows without an id cannot be told apart and stay."""
    found = near_components(docs, **{**NEAR, **near})
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
