"""Token ids as length-delimited binary records with an offset index.

Documents are range-partitioned by id; each partition is one shard of records
in ascending order.  A record is framed as: length of its payload (8 bytes), a
masked checksum of those 8 bytes, the payload, a masked checksum of the
payload.  A payload is a flag for a null id, the id (8 bytes) and the token
ids, 2 or 4 bytes each as the vocabulary needs.  All numbers are little-endian.
A checksum is a CRC-32, rotated right by 15 bits plus a constant, so that files
which hold checksums do not confuse it.  Beside each shard lies an index: per
record its offset and the number of ids before it, for shuffled reads.

Shards go under the shared work folder, under names of their own attempt; the
manifest, a table that Spark commits, names those that count.  A task that runs
again leaves an unnamed file and no wrong one.

Defined cases: null text is empty and holds the end id only; documents with
equal ids follow each other in no set order; null ids come first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import work_dir
from .bpe import Remembered, byte_symbols
from .common import materialize, text_slices

END_ID = 2
#: Words and pieces a task remembers before it starts anew, and the longest of them.
WORDS, PIECES_HELD, LONGEST = 500_000, 100_000, 64
#: Cuts text into pieces as byte-level vocabularies do; a fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space that ends most texts.
BLANKS = " \t\r\n"
#: A lone space inside text always starts a piece, and what follows it is cut alike anywhere.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class NotLone(Exception):
    """The space before or after a word has more white space beside it."""


class PieceEncoder:
    """The tokenizers library's ids, remembered per word between spaces and per
    piece of text: most of a corpus has been met before, and the library takes
    most of its time to cut texts and to keep offsets nobody asks for."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.find = regex.compile(PIECES).findall
        self.symbols = byte_symbols()
        self.size = self.whole.get_vocab_size()

        #: Ids are kept as they are stored, 2 or 4 bytes each, and joined as bytes.
        self.width = 2 if self.size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.unit = [n.to_bytes(self.width, "little") for n in range(self.size)]
        self.symbol_of = dict(enumerate(self.symbols))
        self.words = Remembered(self._word, WORDS, LONGEST)
        self.pieces = Remembered(self._piece, PIECES_HELD, LONGEST)

    def _merged(self, symbols: str) -> bytes:
        unit = self.unit
        return b"".join([unit[t.id] for t in self.merge(symbols)])

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece.encode().decode("latin-1").translate(self.symbol_of))

    def _word(self, word: str) -> bytes:
        """Ids of a word and the lone space before it."""
        if word.isalpha():
            return self._merged(self.symbols[0x20] + word) if word.isascii() else self._piece(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise NotLone
        if word[-1] in ",.;:!?" and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        return self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        """Ids of a text, cut into its pieces."""
        words, pieces = self.words, self.pieces
        return b"".join([words[p[1:]] if p[0] == " " and p[1:].isalpha() else pieces[p] for p in self.find(text)])

    def stored(self, text: str) -> bytes:
        """Ids of a text as they are stored."""
        for special in self.special:
            if special in text:
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        body = text.rstrip(BLANKS)
        first, *words = body.split(" ")
        if not first[-1:].isspace() and not body[-1:].isspace():
            try:
                return b"".join([self._cut(first), *map(self.words.__getitem__, words), self._cut(text[len(body):])])
            except NotLone:
                pass
        first, *words = LONE_SPACE.split(text)
        last = " " + words.pop() if words else ""
        return b"".join([self._cut(first), *map(self.words.__getitem__, words), self._cut(last)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.stored(text), dtype=self.kind).tolist()


_HELD: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a file, read once per worker process."""
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _HELD[path] = PieceEncoder(path)
    return _HELD[path]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _take(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise ValueError("record ends early")
    return data


def records(file) -> Iterator[bytes]:
    """Payloads of an open shard, each with its checksums tested."""
    while length := file.read(8):
        if len(length) != 8 or struct.unpack("<I", _take(file, 4))[0] != masked(length):
            raise ValueError("wrong length of a record")
        payload = _take(file, struct.unpack("<Q", length)[0])
        if struct.unpack("<I", _take(file, 4))[0] != masked(payload):
            raise ValueError("wrong checksum of a record")
        yield payload


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _write_shard(folder: str, path: str):
    names = ["shard", "file", "width", "n_docs", "n_tokens"]

    def run(batches):
        encoder = piece_encoder(path)
        width = encoder.width
        end_id = np.array([END_ID], dtype=encoder.kind).tobytes()
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, place = _open(f"{folder}/{name}")
        docs = tokens = offset = 0
        data = index = None
        for batch in batches:
            ids = batch.column(0)
            for first, _, texts in text_slices(batch.column(1)):
                if data is None:  # a partition without rows leaves no files
                    data, index = store.open_output_stream(f"{place}.rec"), store.open_output_stream(f"{place}.idx")
                for n, text in enumerate(texts):
                    key = ids[first + n].as_py()
                    found = encoder.stored(text.decode()) + end_id
                    record = frame(struct.pack("<Bq", key is None, key or 0) + found)
                    index.write(struct.pack("<QQ", offset, tokens))
                    data.write(record)
                    docs += 1
                    tokens += len(found) // width
                    offset += len(record)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (context.partitionId(), f"{folder}/{name}", width, docs, tokens)], names=names
            )

    return run


def write_token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all of ``docs`` (doc_id, text) and return the committed manifest
    (shard, file, width, n_docs, n_tokens, start: ids in earlier shards)."""
    folder = folder or work_dir(docs.sparkSession, "tokens")
    store, place = _open(folder)
    store.create_dir(place, recursive=True)
    shards = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(_write_shard(folder, path), "shard bigint, file string, width bigint, n_docs bigint, n_tokens bigint")
    )
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(shards, "manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_batch(keys: list, starts: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), lists], names=["doc_id", "start", "ids"])


def _read_shards(batches):
    for batch in batches:
        for shard in batch.to_pylist():
            store, place = _open(shard["file"])
            kind = np.dtype(f"<u{shard['width']}")
            keys, starts, ids, docs, size = [], [], [], 0, 0
            with (
                store.open_input_stream(f"{place}.idx", buffer_size=1 << 16) as index,
                store.open_input_stream(f"{place}.rec", buffer_size=1 << 20) as file,
            ):
                for payload in records(file):
                    null, key = struct.unpack_from("<Bq", payload)
                    keys.append(None if null else key)
                    starts.append(shard["start"] + struct.unpack("<QQ", _take(index, 16))[1])
                    ids.append(np.frombuffer(payload, dtype=kind, offset=9))
                    docs += 1
                    size += len(ids[-1])
                    if size > 1 << 18:
                        yield _read_batch(keys, starts, ids)
                        keys, starts, ids, size = [], [], [], 0
                if docs != shard["n_docs"] or index.read(1):
                    raise ValueError("shard, index and manifest differ")
            if keys:
                yield _read_batch(keys, starts, ids)


def read_token_files(
    manifest: DataFrame,
    derive: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
    schema: str = "doc_id bigint, start bigint, ids array<int>",
) -> DataFrame:
    """(doc_id, start, ids) of every record of the manifest's shards, or what
    ``derive`` makes of these batches, with its schema, in the task that reads."""
    # each shard is one row: one task per few shards
    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "shard")
    return spread.mapInArrow((lambda batches: derive(_read_shards(batches))) if derive else _read_shards, schema)


def record_at(shard: str, number: int) -> bytes:
    """Payload of one record of a shard, found by the index."""
    store, place = _open(shard)
    with store.open_input_file(f"{place}.idx") as file:
        offset = struct.unpack("<Q", file.read_at(8, 16 * number))[0]
    with store.open_input_file(f"{place}.rec") as file:
        file.seek(offset)
        return next(records(file))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Write, read back and report doc_id, start, n_tokens and ids_crc32; the
    lists read back never leave their task."""
    manifest = write_token_files(docs, path)
    return read_token_files(manifest, _checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
