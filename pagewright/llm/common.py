"""What the operators share: tables, shared intermediate folders, Arrow passes
over whole texts, word and window hashes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import lookup
from ..sources.workdir import work_dir

#: Bytes of text that one numpy pass holds; a longer text is one pass of its own.
SLICE_BYTES = 1 << 18
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops shuffle files at the end of the execution that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` under the shared work folder and read it back: cuts lineage
    and survives the loss of executors.  The shuffle files behind it are of no
    more use then, and are dropped."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows (first, end, texts as bytes) of about ``limit`` bytes; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())  # a view
    first, held, size = 0, [], 0
    for n, value in enumerate(column):
        text = value.as_py() or b""
        if held and size + len(text) > limit:
            yield first, n, held
            first, held, size = n, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, len(column), held


def per_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list[bytes]], Sequence]],
    fields: Sequence[tuple[str, str]],
    keep: Sequence[str | Column] = (),
    column: str | Column = "text",
    within: tuple[str, str] | None = None,
) -> DataFrame:
    """One output row per row of ``docs``: the ``keep`` columns and ``fields``
    (name, type), computed from whole texts.  ``make()`` runs once per task and
    returns the function from a list of texts to one sequence per field.
    ``within`` names a kept struct and its text field, where texts that are kept
    anyway need not be sent twice."""
    text = F.col(column) if isinstance(column, str) else column
    source = docs.select(*keep) if within else docs.select(*keep, text.cast("string").alias("__text"))
    kept_fields = source.schema.fields if within else source.schema.fields[:-1]
    schema = T.StructType(kept_fields + [T.StructField(n, T.DataType.fromDDL(t), True) for n, t in fields])
    if within:
        place = source.columns.index(within[0])
        part = source.schema[within[0]].dataType.names.index(within[1])
    types = [ARROW[t] for _, t in fields]
    names = schema.fieldNames()

    def run(batches):
        compute = make()
        for batch in batches:
            kept = batch.columns if within else batch.columns[:-1]
            held = batch.columns[place].flatten()[part] if within else batch.columns[-1]
            for first, end, texts in text_slices(held):
                made = compute(texts)
                arrays = [c.slice(first, end - first) for c in kept]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


# --- hashes over byte buffers ------------------------------------------------

class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES * 2)
            steps = np.full(n, BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = np.uint64(UNBASE)
            self.down = np.cumprod(steps, dtype=np.uint64)


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Buffer:
    """Texts joined by line feeds, with prefix sums for the hash of any range."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.lengths = lengths
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        self._sums = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            POWERS.upto(n + 1)
            out = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * POWERS.up[:n], out=out[1:])
            self._sums = out
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the ranges [start, end)."""
        sums = self.sums()
        return mix((sums[end] - sums[start]) * POWERS.down[start] + (end - start).astype(np.uint64))

    def words(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in the 256-entry table ``member``: starts, ends
        and the number of the text each lies in."""
        inside = np.concatenate(([0], member[self.data].view(np.int8), [0]))
        change = np.diff(inside)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        return start, end, np.searchsorted(self.starts, start, side="right") - 1


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true inside the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: Bytes of words that white space ends, and of words of letters, digits and non-ASCII.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
WORD_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Maps bytes to lower case, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def ngrams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive word hashes of one text, and the position of
    each one's first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(owner[:count] == owner[n - 1:])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total = mix(total + np.uint64(k + 1)) + words[at + k]
    return mix(total), at


# --- graphs --------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v: bigint) as rows
    (node, root), root being the smallest node.  Alternating large and small
    stars; every round is a written table, so a lost executor costs its tasks."""

    def settle(df: DataFrame) -> DataFrame:
        return materialize(df.where("u != v").distinct(), "stars")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(lookup(both.where("v > u"), lowest, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, down, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(down.select("u", F.col("m").alias("v"))))
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
