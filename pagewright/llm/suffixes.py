"""Suffix-array removal of repeated byte strings.

Every string of ``length`` bytes that also starts earlier (in a document with a
smaller id, or earlier in the same one) is covered; covered bytes go.

Method.  Suffixes are taken at anchors: positions whose ``seed``-byte hash is
smallest in some window of ``length`` bytes.  Equal windows have equal anchors,
so nothing is lost, and there are about 2 anchors per ``length - seed`` bytes.
Those with leading bytes of their own are dropped; of those that agree in all
bytes any window of the anchor can reach, all but the first are covered as they
are.  What remains, one suffix per distinct surrounding, gets its bytes and is
range-partitioned at sampled splitters of leading bytes.  Splitters are compared
on the ``seed`` bytes alone, so what could match never lies across a border.
Each bucket is sorted by a multikey sort on the following and on the preceding
bytes; neighbours' common prefixes then tell which windows of an anchor have an
equal window further up.
Hot leading bytes (more than ``crowd`` surroundings) are settled by grouping
window hashes instead, which aggregates before it shuffles; the result is the same.

Defined cases: null text is empty; documents shorter than ``length`` are never
touched; repeated rows of one id are one document; rows of one id with
different texts count as starting together, so only position decides; a null
id orders first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import lookup
from .common import Buffer, materialize, mix, per_text

LENGTH, SEED, CROWD = 100, 20, 100_000
#: Suffixes that one local sort holds.
BUCKET = 32_768


def sliding(x: np.ndarray, width: int, ufunc) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over every run of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    whole = -(-len(x) // width) * width
    padded = np.concatenate((x, np.full(whole - len(x), x[-1], dtype=x.dtype))).reshape(-1, width)
    ahead = ufunc.accumulate(padded, axis=1).ravel()
    behind = ufunc.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(buffer: Buffer, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and seed hash of each anchor."""
    n = len(buffer.data) - seed + 1
    none = np.zeros(0, dtype=np.int64)
    width = length - seed + 1
    if n < width:
        return none, none, none
    at = np.arange(n)
    hashes = buffer.hashes(at, at + seed)
    lowest = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    best = sliding(np.concatenate((edge, lowest, edge)), width, np.maximum)
    chosen = np.flatnonzero(best == hashes)
    owner = np.searchsorted(buffer.starts, chosen, side="right") - 1
    inside = chosen - buffer.starts[owner]
    fits = (inside + seed <= buffer.lengths[owner]) & (buffer.lengths[owner] >= length)
    return owner[fits], inside[fits], hashes[chosen[fits]].view(np.int64)


#: The text's own hash bits beside a position: rows of one id with different texts stay apart.
SPOT_BITS, TEXT_BITS = 32, 20


def _find_anchors(length: int, seed: int):
    """Spots (text hash bits and position), seed hashes and surroundings' hashes."""

    def compute(texts: list[bytes]):
        buffer = Buffer(texts)
        owner, inside, hashes = anchors(buffer, length, seed)
        start = buffer.starts[owner]
        low = np.maximum(inside - (length - seed), 0)
        high = np.minimum(inside + length, buffer.lengths[owner])
        around = mix(buffer.hashes(start + low, start + high) + (inside - low).astype(np.uint64))
        own = buffer.hashes(buffer.starts, buffer.starts + buffer.lengths) >> np.uint64(64 - TEXT_BITS)
        own = own.astype(np.int64) << SPOT_BITS
        ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        lists = (own[owner] + inside, hashes, around.view(np.int64))
        return [own >> SPOT_BITS, *(pa.ListArray.from_arrays(ends, pa.array(x, type=pa.int64())) for x in lists)]

    return compute


# --- one bucket, sorted ---------------------------------------------------

def multikey_ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of big-endian 8-byte words (n x k).  Each pass splits every tie
    by its next word, as multikey quicksort does.  Returns the order and, per
    word, the dense rank of each row by the words so far."""
    n, k = words.shape
    rank = np.zeros(n, dtype=np.int64)
    ranks = np.zeros((k, n), dtype=np.int64)
    order = np.arange(n)
    for j in range(k):
        if n and rank[order[-1]] < n - 1:
            order = np.lexsort((words[:, j], rank))
            step = (np.diff(rank[order]) != 0) | (words[order[1:], j] != words[order[:-1], j])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(step)))
        ranks[j] = rank
    return order, ranks


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bytes and their true lengths."""
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    block = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(block, dtype=np.uint8).reshape(-1, width), lengths


def _sorted_prefixes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the rows and each row's common prefix with the one before."""
    n, width = block.shape
    whole = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    whole[:, :width] = block
    order, _ = multikey_ranks(whole.view(">u8").astype(np.uint64))
    rows = block[order]
    same = rows[1:] == rows[:-1]
    prefix = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, np.concatenate(([0], prefix)).astype(np.int64)


def covered(before: list[bytes], after: list[bytes], place: np.ndarray, length: int, seed: int):
    """For suffixes with the bytes ``before`` (reversed) and ``after`` each
    anchor and their order of ``place``, the range [low, high) around the anchor
    covered by windows that start earlier elsewhere; low == high: none."""
    n, back = len(after), length - seed
    right, right_len = _padded(after, length)
    left, left_len = _padded(before, back)
    right_order, right_lcp = _sorted_prefixes(right)
    left_order, left_lcp = _sorted_prefixes(left)
    low, high = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    right_run, left_run = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    none = True
    first = np.full(n, -1, dtype=np.int64)
    last = np.full(n, -1, dtype=np.int64)
    for shift in range(back + 1):
        fits = np.flatnonzero((right_len >= length - shift) & (left_len >= shift))
        if not len(fits):
            continue
        right_run[right_order] = np.cumsum(right_lcp < length - shift)
        left_run[left_order] = np.cumsum(left_lcp < shift)
        key = right_run[fits] * (n + 1) + left_run[fits]
        order = np.argsort(key * (n + 1) + place[fits])
        key, at, rank = key[order], fits[order], place[fits][order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        lowest = rank[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        again = at[rank > lowest]
        if len(again):
            none = False
            first[again] = np.where(first[again] < 0, shift, first[again])
            last[again] = shift
    if not none:
        found = last >= 0
        low[found], high[found] = -last[found], length - first[found]
    return low, high


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole groups of equal leading bytes, several to a frame, from sorted rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size < BUCKET:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        cut = bisect_left(frame["lead"].tolist(), frame["lead"].iat[-1])
        if cut:
            yield frame.iloc[:cut]
        held = [frame.iloc[cut:]]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def _settle_bucket(length: int, seed: int):
    def run(batches):
        for frame in _buckets(batches):
            ids = frame["id"].to_numpy(dtype=np.int64)
            at = frame["at"].to_numpy(dtype=np.int64)
            order = np.lexsort((at, ids))
            step = (np.diff(ids[order]) != 0) | (np.diff(at[order]) != 0)
            place = np.empty(len(ids), dtype=np.int64)
            place[order] = np.concatenate(([0], np.cumsum(step)))
            low, high = covered(frame["before"].tolist(), frame["after"].tolist(), place, length, seed)
            hit = np.flatnonzero(high > low)
            own = frame["own"].to_numpy(dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[hit]), pa.array(own[hit]), pa.array((at + low)[hit]), pa.array((at + high)[hit])],
                names=["id", "own", "low", "high"],
            )

    return run


def _settle_crowd(suffixes: DataFrame, length: int, seed: int) -> DataFrame:
    """The same for hot seeds: windows are grouped by hash, which aggregates
    before it shuffles, whatever the size of a group."""
    before, after = F.octet_length("before"), F.octet_length("after")
    shifts = F.sequence(F.greatest(F.lit(0), F.lit(length) - after), F.least(F.lit(length - seed), before))
    windows = (
        suffixes.where(before + after >= length)
        .select("id", "own", "at", "before", "after", F.explode(shifts).alias("shift"))
        .select(
            "id", "own", "at", "shift",
            # preceding bytes are kept reversed, nearest first
            F.sha2(F.concat(
                F.substring("before", F.lit(1), F.col("shift")), F.lit(b"|"),
                F.substring("after", F.lit(1), F.lit(length) - F.col("shift")),
            ), 256).alias("window"),
        )
    )
    order = F.struct("id", "at")
    lowest = windows.groupBy("window").agg(F.min(order).alias("lowest"))
    return (
        lookup(windows, lowest, "window", "inner")
        .where(order > F.col("lowest"))
        .groupBy("id", "own", "at")
        .agg(F.max("shift").alias("last"), F.min("shift").alias("first"))
        .select("id", "own", (F.col("at") - F.col("last")).alias("low"), (F.col("at") + length - F.col("first")).alias("high"))
    )


def _contexts(length: int, seed: int):
    """Per document with open anchors: the bytes around each."""
    back = length - seed
    names = ["id", "own", "at", "lead", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        rows: list[list] = [[] for _ in names]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                key, own = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                text = unpack(batch.column(2)[row].as_py())
                for at in batch.column(3)[row].values.to_pylist():
                    values = (key, own, at, text[at:at + seed], text[max(0, at - back):at][::-1], text[at:at + length])
                    for x, value in zip(rows, values):
                        x.append(value)
                if len(rows[0]) >= 20_000:
                    yield flush()
                    rows = [[] for _ in names]
        if rows[0]:
            yield flush()

    return run


def pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(docs: DataFrame, keep=()) -> DataFrame:
    """(id, own, packed): ids without nulls, the text's hash bits, and the text
    compressed, for it is shuffled."""

    def compute(texts: list[bytes]):
        buffer = Buffer(texts)
        own = buffer.hashes(buffer.starts, buffer.starts + buffer.lengths) >> np.uint64(64 - TEXT_BITS)
        return [own.astype(np.int64), [pack(t) for t in texts]]

    return per_text(docs, lambda: compute, [("own", "bigint"), ("packed", "binary")], [_id().alias("id"), *keep])


def _id():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """Per document with covered ranges (id, own): ``settled``, the anchors all
    of whose surroundings are covered, and ``spans``, further ranges."""
    found = (
        per_text(docs, lambda: _find_anchors(length, seed),
                 [("own", "bigint"), ("spots", "array<bigint>"), ("seeds", "array<bigint>"), ("arounds", "array<bigint>")],
                 [_id().alias("id")])
        .select("id", F.inline(F.arrays_zip("spots", "seeds", "arounds"))).toDF("id", "spot", "seed", "around")
    )
    at = F.col("spot").bitwiseAND((1 << SPOT_BITS) - 1)
    # one sort per partition serves both windows: rows of one seed lie together
    earlier = Window.partitionBy("seed", "around").orderBy("id", at)
    marks = materialize(
        found.repartition("seed")
        .withColumn("first", F.rank().over(earlier) == 1)
        .withColumn("n", F.count(F.when(F.col("first"), 1)).over(Window.partitionBy("seed")))
        .where("not first or n > 1")
        .select("id", F.shiftright("spot", SPOT_BITS).alias("own"), at.alias("at"), "first", (F.col("n") > crowd).alias("hot"))
        .groupBy("id", "own").agg(
            F.collect_list(F.when(~F.col("first"), F.col("at"))).alias("settled"),
            F.collect_list(F.when(F.col("first") & ~F.col("hot"), F.col("at"))).alias("cold"),
            F.collect_list(F.when(F.col("first") & F.col("hot"), F.col("at"))).alias("crowded"),
        ),
        "anchors",
    )
    ranges = "id bigint, own bigint, low bigint, high bigint"

    def suffixes(which: str) -> DataFrame:
        wanted = marks.where(F.size(which) > 0).select("id", "own", which)
        return _packed(docs).join(wanted, ["id", "own"]).select("id", "own", "packed", which).mapInArrow(
            _contexts(length, seed), "id bigint, own bigint, at bigint, lead binary, before binary, after binary"
        )

    cold = (
        # splitters are sampled leading bytes, so suffixes that begin alike never part
        suffixes("cold").repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_settle_bucket(length, seed), ranges)
    )
    parts = cold
    if not marks.where(F.size("crowded") > 0).isEmpty():
        parts = parts.unionByName(_settle_crowd(suffixes("crowded"), length, seed))
    spans = materialize(parts.groupBy("id", "own").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    return marks.select("id", "own", "settled").where(F.size("settled") > 0).join(spans, ["id", "own"], "full")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _cut(batches, length: int, back: int, as_text: bool):
    """Lengths, removed bytes, runs and what remains, from (id, packed, settled, spans)."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for row in range(batch.num_rows):
            data = unpack(batch.column(1)[row].as_py())
            runs, rest = [], data
            settled, open_spans = batch.column(2)[row], batch.column(3)[row]
            ends = []
            if settled.is_valid:
                at = settled.values.to_numpy()
                ends.append(np.stack([at - back, at + length]))
            if open_spans.is_valid:
                ends.append(np.stack([open_spans.values.field(k).to_numpy() for k in (0, 1)]))
            if ends:
                runs = merge_spans(list(zip(*np.clip(np.concatenate(ends, axis=1), 0, len(data)).tolist())))
                parts, end = [], 0
                for low, high in runs:
                    parts.append(data[end:low])
                    end = high
                rest = b"".join([*parts, data[end:]])
            shown = (rest.decode("utf-8", "ignore") if as_text else rest) if runs else None
            for x, value in zip(out, (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), shown)):
                x.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[4:], *(pa.array(x, k) for x, k in zip(out, kinds))],
            names=[*batch.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD, keep=("doc_id",), as_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the ``keep`` columns, n_bytes,
    n_removed, n_spans, kept_sha256, and ``kept``, the remaining bytes where any
    were removed (``as_text``: without characters that a cut splits)."""
    spans = repeated_spans(docs, length, seed, crowd)
    rows = _packed(docs.withColumn("__keep", F.struct(*keep)), [F.col("__keep")])
    known = rows.join(spans, ["id", "own"], "left").select("id", "packed", "settled", "spans", "__keep.*")
    schema = T.StructType(known.schema.fields[4:])
    for name, kind in (("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("kept", "string" if as_text else "binary")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return known.mapInArrow(lambda batches: _cut(batches, length, length - seed, as_text), schema)


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` with what repeats cut from ``text`` (``n_chars``, if
    there, follows), without rows of which nothing is left.  A character that
    a cut splits goes with it."""
    columns = docs.columns
    named = docs.select(F.struct(*columns).alias("row"), "doc_id", "text")
    cut = remove_repeats(named, length, seed, crowd, ["row"], as_text=True)
    touched = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    fresh = {"text": F.coalesce("kept", F.col("row.text"))}
    if "n_chars" in columns:
        chars = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars"))
        fresh["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return touched.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in columns])
