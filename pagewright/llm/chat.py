"""Chat formatting at token level.

A turn is the reserved start id, the encoded role and a line feed, the encoded
text, the reserved end id and a line feed.  Segments are encoded one by one, so
no token spans a border, and the loss mask follows from the segments' lengths
by prefix sums: it covers the texts of assistant turns.  Control strings in a
text are escaped: a run ``<|`` gets a backslash after the ``<``, one more than
it has, which reading takes away again; what remains can never be read as a
mark.  Roles escape line feeds too.

The output is one row of ids and mask per turn, in order within a
conversation, so a conversation of any length passes through bounded memory.

Defined cases: null text or role is empty; turns with equal numbers follow by
role and text; a null turn comes first; a null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .token_files import piece_encoder

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Assembly and reading of turns with one vocabulary; the two marks take the
    ids after its last."""

    def __init__(self, path: str) -> None:
        self.encoder = piece_encoder(path)
        self.start, self.end = self.encoder.size, self.encoder.size + 1
        back = {s: b for b, s in enumerate(self.encoder.symbols)}
        self.bytes = [b""] * self.encoder.size
        special = set(self.encoder.special)
        for token, n in self.encoder.whole.get_vocab().items():
            self.bytes[n] = token.encode() if token in special else bytes(back[c] for c in token)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        encode = self.encoder.encode
        segments = [[self.start], encode(escape_role(role) + "\n"), encode(escape(text)), [self.end], encode("\n")]
        learned = [False, False, role == ASSISTANT, False, False]
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, dtype=np.int64)
        for on, end, segment in zip(learned, ends, segments):
            if on:
                steps[end - len(segment)] += 1
                steps[end] -= 1
        return np.concatenate([np.array(s, dtype=np.int32) for s in segments]), np.cumsum(steps)[:-1] > 0

    def text(self, ids) -> str:
        """Text of ordinary ids."""
        return b"".join([self.bytes[i] for i in ids]).decode()

    def read(self, ids: list[int]) -> list[tuple[str, str, int]]:
        """Role, text and formatted length of each turn in a run of ids."""
        turns, at = [], 0
        while at < len(ids):
            if ids[at] != self.start:
                raise ValueError("a turn does not begin with its mark")
            end = ids.index(self.end, at)
            stop = ids.index(self.start, end) if self.start in ids[end:] else len(ids)
            inner, tail = self.text(ids[at + 1:end]), self.text(ids[end + 1:stop])
            role, _, text = inner.partition("\n")
            turns.append((unescape_role(role), unescape(text), len(START) + len(inner) + len(END) + len(tail)))
            at = stop
        return turns


_HELD: dict[str, Template] = {}


def template(path: str) -> Template:
    """The template of a vocabulary file, read once per worker process."""
    if path not in _HELD:
        _HELD[path] = Template(path)
    return _HELD[path]


def format_chats(turns: DataFrame, path: str) -> DataFrame:
    """Rows (conv_id, turn, role, mark, ids, mask), one per row of ``turns``
    (conv_id, turn, role, text); ``mark`` orders turns that tie."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    source = turns.select("conv_id", "turn", role.alias("role"), F.xxhash64(text).alias("mark"), text.alias("text"))

    def run(batches):
        shape = template(path)
        for batch in batches:
            made = [shape.turn(*x) for x in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([m[0] for m in made], pa.list_(pa.int32())),
                 pa.array([m[1] for m in made], pa.list_(pa.bool_()))],
                names=[*batch.schema.names[:4], "ids", "mask"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, mark bigint, ids array<int>, mask array<boolean>"
    )


class _Digest:
    """What is known of the conversation being read."""

    def __init__(self, key) -> None:
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self):
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(path: str, key_type: pa.DataType):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        shape, now = template(path), None
        for batch in batches:
            done = []
            for key, ids, mask in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                for role, text, chars in shape.read(ids):
                    now.turns += 1
                    now.chars += chars
                    now.all.update(f"{role}\n{text}\n".encode())
                learned = unescape(shape.text([i for i, on in zip(ids, mask) if on]))
                now.loss_chars += len(learned)
                now.loss.update(learned.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(), kinds)], names=names)

    return run


def chat_digests(turns: DataFrame, path: str) -> DataFrame:
    """Format, write, read back and digest every conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    output = materialize(format_chats(turns, path), "chats")
    return (
        output.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark")
        .select("conv_id", "ids", "mask")
        .mapInArrow(_read_back(path, arrow), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                    "loss_sha256 string, formatted_chars bigint")
    )
