"""Merkle manifest of a document table as a postorder append log.

Every row is a leaf: H of its fields doc_id, source, lang, n_chars, text,
each ``-`` if null, else the UTF-8 byte count, ``:`` and the value (integers
in decimal); H is the lowercase hex SHA-256 of the concatenated input, digests
entering as hex text.  Per lang (the tree's key) leaves ascend by doc_id; every
8 consecutive nodes of a level (the last run fewer, even one) become their H
until one node, the subroot, remains.  Subroots ordered by lang (null first,
UTF-8 bytewise) make the root the same way.

Layout.  Nodes are addressed by their postorder position, which follows in
closed form from the subtree sizes of a tree of n leaves in aligned runs of 8
(``postorder``); the log table holds (key, pos, level, idx, hash), the tree of
subroots under a key of its own, and is written in completion order before
anything is proved.  Aligned builders: each level is built by groups of 8
aligned siblings, one group per parent, so a hot lang spreads over n / 8 groups
and no group holds more than 8 rows.  Proofs read the log only, by position, and
run top-down: the path of a node (siblings left and right of it, level by level
up to the root) is its parent's path, found at the parent's position, after its
own.  Paths of leaves are never written: each run of 8 leaves meets its parent's
path once, where all its rows are proved and folded, altered or not.

Defined cases: null doc_id sorts first within its lang; rows with equal
doc_id are ordered by their leaf hash (equal rows are equal leaves, each a
leaf of its own); a null lang is a key of its own, first; an empty table gives
no rows.  Columns other than the five fields are ignored.  ``tamper`` says
which rows to alter for the fold check; the altered leaf is folded with the
original siblings.
"""

from __future__ import annotations

from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree of subroots in the log.
UPPER = -1
PROVED = (
    "doc_id {id}, key int, idx long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves (0 for one leaf)."""
    top = 0
    while n > 1:
        n, top = -(-n // FANOUT), top + 1
    return top


def postorder(level: Column, idx: Column, n: Column, top: int) -> Column:
    """Closed-form postorder position of node (level, idx) in the tree of n
    leaves: the nodes wholly left of its leaf range, plus its subtree size, minus one."""
    span = F.pow(F.lit(FANOUT), level).cast("long")
    start = idx * span
    end = F.least((idx + 1) * span, n)
    left = F.lit(0).cast("long")
    size = F.lit(0).cast("long")
    for m in range(top + 1):
        unit = FANOUT**m
        # level m exists while it has more than one node below the top, or is the top
        exists = F.lit(m) <= F.col("__top")
        left = left + F.when(exists, F.floor(start / F.lit(unit))).otherwise(0).cast("long")
        inside = (F.ceil(end / F.lit(unit)) - F.floor(start / F.lit(unit))).cast("long")
        size = size + F.when(F.lit(m) <= level, inside).otherwise(0)
    return (left + size - 1).alias("pos")


def _ranks(leaves: DataFrame) -> DataFrame:
    """idx of each leaf within its key, ascending by (doc_id, leaf): range
    partitions, a local count per partition, offsets from the small table of
    counts per (partition, key)."""
    parts = max(1, leaves.sparkSession.sparkContext.defaultParallelism)
    ordered = leaves.repartitionByRange(parts, "key", "doc_id", "leaf").sortWithinPartitions("key", "doc_id", "leaf")
    schema = T.StructType(ordered.schema.fields + [T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa

        pid = TaskContext.get().partitionId()
        last, run = None, 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            local = np.empty(len(keys), dtype=np.int64)
            for i, k in enumerate(keys):
                run = run + 1 if k == last else 0
                last = k
                local[i] = run
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), pid, dtype=np.int32)), pa.array(local)], names=schema.fieldNames()
            )

    numbered = materialize(ordered.mapInArrow(number, schema), "merkle-leaves")
    counts = numbered.groupBy("pid", "key").count().collect()  # at most partitions + keys rows
    before, offsets = {}, []
    for r in sorted(counts, key=lambda r: (r.key, r.pid)):
        offsets.append((r.pid, r.key, before.get(r.key, 0)))
        before[r.key] = before.get(r.key, 0) + r["count"]
    table = leaves.sparkSession.createDataFrame(offsets, "pid int, key int, offset long")
    return numbered.join(F.broadcast(table), ["pid", "key"]).select(
        *leaves.columns, (F.col("offset") + F.col("local")).alias("idx")
    )


def _groups(nodes: DataFrame) -> DataFrame:
    """Aligned runs of 8 nodes of one level: (key, parent, hashes in order)."""
    return nodes.groupBy("key", (F.col("idx") / FANOUT).cast("long").alias("parent")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("m")
    )


def _parents(groups: DataFrame) -> DataFrame:
    return groups.select("key", F.col("parent").alias("idx"), F.sha2(F.array_join("m.hash", ""), 256).alias("hash"))


def _tree(nodes: DataFrame, tops: dict[int, int], label: str) -> list[DataFrame]:
    """Nodes (key, idx, hash) of every level, bottom-up; those above the leaves are written."""
    out = [nodes]
    for level in range(max(tops.values(), default=0)):
        taller = [k for k, t in tops.items() if t > level]
        out.append(materialize(_parents(_groups(out[-1].where(F.col("key").isin(taller)))), f"{label}-{level}"))
    return out


def _each(values: dict[int, int]) -> Column:
    """The value of a row's key."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("key"))


def _address(df: DataFrame, name: str, level: Column, idx: Column, sizes: dict[int, int]) -> DataFrame:
    """``df`` and the postorder position ``name`` of each row's node (level, idx)."""
    tops = {k: levels_of(n) for k, n in sizes.items()}
    placed = df.withColumn("__top", _each(tops)).withColumn("__n", _each(sizes))
    return placed.withColumn(name, postorder(level, idx, F.col("__n"), max(tops.values()))).drop("__top", "__n")


def _entries(levels: list[DataFrame], sizes: dict[int, int]) -> DataFrame:
    """Log rows of the nodes of all levels, each at its closed-form position."""
    rows = [n.select("key", F.lit(level).alias("level"), "idx", "hash") for level, n in enumerate(levels)]
    placed = _address(reduce(DataFrame.unionByName, rows), "pos", F.col("level"), F.col("idx"), sizes)
    return placed.select("key", "level", "idx", "pos", "hash")


def _in_order(log: DataFrame) -> DataFrame:
    """Completion order: by key, then postorder position."""
    return log.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos")


def write_log(log: DataFrame, path: str) -> None:
    """The append log in completion order: by key, then postorder position."""
    _in_order(log).write.mode("overwrite").parquet(path)


def _runs(log: DataFrame, level: int, sizes: dict[int, int]) -> DataFrame:
    """Logged nodes of one level by the position of their parent: (key, above,
    members in order), for keys whose tree is taller."""
    taller = [k for k, n in sizes.items() if levels_of(n) > level]
    nodes = log.where((F.col("level") == level) & F.col("key").isin(taller))
    placed = _address(nodes, "above", F.lit(level + 1), F.floor(F.col("idx") / FANOUT), sizes)
    return placed.groupBy("key", "above").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("m"))


def _sides(pos: Column) -> Column:
    """The hashes left and right of the member of run ``m`` at ``pos``."""
    side = lambda keep: F.array_join(F.transform(F.filter("m", keep), lambda e: e.hash), "")
    return F.struct(side(lambda e: e.pos < pos).alias("l"), side(lambda e: e.pos > pos).alias("r"))


def _paths(log: DataFrame, sizes: dict[int, int], tail: DataFrame, lowest: int, label: str) -> DataFrame:
    """(key, pos, path) of the logged nodes of level ``lowest``, top-down: the
    path of a key's top node is its ``tail`` (key, path); any other's is its own
    sides, then its parent's path, found at the parent's position."""
    path = None
    for level in range(max(map(levels_of, sizes.values())), lowest - 1, -1):
        topped = [k for k, n in sizes.items() if levels_of(n) == level]
        now = log.where((F.col("level") == level) & F.col("key").isin(topped)).select("key", "pos").join(F.broadcast(tail), "key")
        if path is not None:
            above = path.withColumnRenamed("pos", "above")
            runs = _runs(log, level, sizes).join(above, ["key", "above"]).select("*", F.explode("m.pos").alias("pos"))
            now = now.unionByName(runs.select("key", "pos", F.concat(F.array(_sides(F.col("pos"))), F.col("path")).alias("path")))
        path = materialize(now.select("key", "pos", "path"), f"{label}-path-{level}")
    return path if path is not None else tail.limit(0).select("key", F.lit(0).cast("long").alias("pos"), "path")


def append_log(docs: DataFrame, tamper: Column | None = None) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """(leaves, log, sizes): per row key, doc_id, idx, leaf and the altered leaf
    (null if not to be altered); the written postorder log (key, level, idx, pos,
    hash) of every lang's tree and, under key ``UPPER``, of the tree of subroots;
    and the number of leaves per key of the log."""
    cols = {c: F.col(c) for c in FIELDS}
    altered = F.lit(None).cast("string") if tamper is None else F.when(
        tamper, leaf_hash(cols["doc_id"], cols["source"], cols["lang"], cols["n_chars"], ascii_lower(cols["text"]))
    )
    base = docs.select(
        cols["doc_id"].alias("doc_id"), cols["lang"].alias("lang"), leaf_hash(*cols.values()).alias("leaf"), altered.alias("tleaf")
    )
    langs = [r.lang for r in docs.select("lang").distinct().collect()]  # one row per lang
    langs.sort(key=lambda v: (v is not None, (v or "").encode("utf-8")))
    key_of = {v: k for k, v in enumerate(langs)}
    named = {k: v for v, k in key_of.items() if v is not None}
    lookup = F.create_map(*[x for k, v in named.items() for x in (F.lit(v), F.lit(k))]) if named else None
    key = F.lit(0) if lookup is None else F.when(F.col("lang").isNull(), F.lit(key_of.get(None, -1))).otherwise(F.element_at(lookup, F.col("lang")))
    leaves = _ranks(base.withColumn("key", key.cast("int")).select("key", "doc_id", "leaf", "tleaf"))
    sizes = {r.key: r["count"] for r in leaves.groupBy("key").count().collect()}
    if not sizes:
        return leaves, docs.sparkSession.createDataFrame([], "key int, level int, idx long, pos long, hash string"), {}
    tops = {k: levels_of(n) for k, n in sizes.items()}
    levels = _tree(leaves.select("key", "idx", F.col("leaf").alias("hash")), tops, "merkle-level")
    # the tree of subroots: one key, its leaves ordered by lang key
    subroots = reduce(DataFrame.unionByName, [
        nodes.where(F.col("key").isin([k for k, t in tops.items() if t == level])) for level, nodes in enumerate(levels)
    ])
    subroots = materialize(subroots.select(F.lit(UPPER).alias("key"), F.col("key").cast("long").alias("idx"), "hash"), "merkle-subroots")
    upper = _tree(subroots, {UPPER: levels_of(len(sizes))}, "merkle-upper")
    log = _entries(levels, sizes).unionByName(_entries(upper, {UPPER: len(sizes)}))
    return leaves, materialize(_in_order(log), "merkle-log"), {**sizes, UPPER: len(sizes)}


def prove(leaves: DataFrame, log: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Per row of ``leaves``: doc_id, key, idx, leaf, subroot, root, proof_sha256,
    folded_root and verified, all other digests read from the log by position.
    Every row is folded, altered or not."""
    upper = {UPPER: sizes[UPPER]}
    sizes = {k: n for k, n in sizes.items() if k != UPPER}
    root = log.where((F.col("key") == UPPER) & (F.col("level") == levels_of(upper[UPPER]))).first().hash
    empty = log.sparkSession.createDataFrame([(UPPER, [])], "key int, path array<struct<l:string,r:string>>")
    tail = _paths(log, upper, empty, 0, "merkle-upper")
    # the place of a lang among the subroots is its key
    places = log.where((F.col("key") == UPPER) & (F.col("level") == 0)).select(F.col("idx").cast("int").alias("lang"), "pos")
    tail = materialize(tail.join(F.broadcast(places), "pos").select(F.col("lang").alias("key"), "path"), "merkle-tail")  # one row per lang
    above = _paths(log, sizes, tail, 1, "merkle-level").withColumnRenamed("pos", "above")
    runs = _runs(log, 0, sizes).join(above, ["key", "above"])
    placed = _address(leaves, "pos", F.lit(0), F.col("idx"), sizes)
    lone = [k for k, n in sizes.items() if n == 1]
    below = _address(placed.where(~F.col("key").isin(lone)), "above", F.lit(1), F.floor(F.col("idx") / FANOUT), sizes)
    paths = below.join(runs, ["key", "above"]).select(*placed.columns, F.concat(F.array(_sides(F.col("pos"))), F.col("path")).alias("path"))
    paths = paths.unionByName(placed.where(F.col("key").isin(lone)).join(F.broadcast(tail), "key").select(*paths.columns))
    subroots = log.where((F.col("key") != UPPER) & (F.col("level") == _each({k: levels_of(n) for k, n in sizes.items()})))
    found = paths.join(F.broadcast(subroots.select("key", F.col("hash").alias("subroot"))), "key")
    return found.select(
        "doc_id", "key", "idx", "leaf", "subroot", F.lit(root).alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256).alias("proof_sha256"),
        F.aggregate("path", F.coalesce("tleaf", "leaf"), lambda acc, s: F.sha2(F.concat(s.l, acc, s.r), 256)).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tamper: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaves, log): per row doc_id, key, idx, leaf, subroot, root, proof_sha256,
    folded_root, verified, proved from the log; and the postorder log (key, level,
    idx, pos, hash)."""
    leaves, log, sizes = append_log(docs, tamper)
    if not sizes:
        return docs.sparkSession.createDataFrame([], PROVED.format(id=docs.schema["doc_id"].dataType.simpleString())), log
    return prove(leaves, log, sizes), log


def tampered(doc_id: Column) -> Column:
    """Rows whose unsigned crc32 of the decimal doc_id is divisible by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
