"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed word 1- and 2-grams and of the text's shape
(shares of marks, capitals and digits, repeated words and lines, word length,
in steps).  Counts per class over all labelled training rows give the log-count
ratio of each feature; indicators scaled by the ratios, of unit length, go into
a linear hinge-loss model fitted by dual coordinate descent.  A logistic curve
fitted on training rows that the model did not see turns margins into scores.

Counting and scoring are passes over the texts in tasks; what they send on is
one sparse vector of counts per task.  The fit takes a bounded sample: the
first ``sample`` + ``curve`` labelled rows in the order of a hash of their text
and doc_id (ties by label), each with all its features, as long as their
features together stay within ``HELD``; the driver holds them as views of one
Arrow array.  Scoring uses every feature of a text.

Defined cases: null or blank text has the shape features alone and is scored
like any other; a row with several labels counts once each; without labels of
both classes every score is 0.5; a null doc_id has no label and is held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, WORD_BYTES, Buffer, materialize, mix, ngrams, per_text, text_slices
from .quality_rules import DIGIT, MARKS, UPPER, duplicate_lines, repeated_words, text_sums
from .suffixes import pack, unpack

#: Hash buckets of features; rows in the fit; rows that fit the curve; features the
#: driver holds at most for both (rows are taken whole, in sample order, until it is reached).
BUCKETS, SAMPLE, CURVE, HELD = 1 << 18, 12_000, 4_000, 8_000_000
#: Smoothing of counts, penalty of the hinge loss, passes of dual coordinate descent.
ALPHA, PENALTY, PASSES = 1.0, 1.0, 12
THRESHOLD = 0.3
#: Steps per shape statistic; each step is a feature of its own.
STEPS = 12
SHAPES = 8


def _shapes(buffer: Buffer, texts: list[bytes]) -> np.ndarray:
    """Per text one bucket number per shape statistic."""
    data = buffer.data
    start, end, owner = buffer.words(NOT_SPACE)
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    size = np.maximum(text_sums(buffer, NOT_SPACE[data]), 1)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), dtype=np.int64, count=n)
    share = lambda part, whole: np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1))
    stats = [
        share(text_sums(buffer, MARKS[data]), size), share(text_sums(buffer, UPPER[data]), size),
        share(text_sums(buffer, DIGIT[data]), size), share(repeated_words(buffer, start, end, owner, n), words),
        share(np.fromiter(map(duplicate_lines, texts), dtype=np.int64, count=n), lines),
        np.clip(np.log2(size / np.maximum(words, 1)) / 4, 0, 1), np.clip(np.log2(words + 1) / 16, 0, 1),
        np.clip(np.log2(words / lines + 1) / 10, 0, 1),
    ]
    steps = [np.minimum((s * STEPS).astype(np.int64), STEPS - 1) + k * STEPS for k, s in enumerate(stats)]
    return np.stack(steps, axis=1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct feature numbers, sorted by row: shape features
    come first, then hashed n-grams."""
    buffer = Buffer(texts)
    shapes = _shapes(buffer, texts)
    buffer.data, buffer._sums = LOWER[buffer.data], None
    start, end, owner = buffer.words(WORD_BYTES)
    words = buffer.hashes(start, end)
    pairs, at = ngrams(words, owner, 2)
    marks, spots, whose = _marks(buffer)
    rows = np.concatenate((owner, owner[at], whose, np.repeat(np.arange(len(texts)), SHAPES)))
    hashed = np.concatenate((mix(words), pairs, marks))
    room = np.uint64(BUCKETS - SHAPES * STEPS)
    columns = np.concatenate(((hashed % room).astype(np.int64) + SHAPES * STEPS, shapes.ravel()))
    keys = np.unique(rows * BUCKETS + columns)
    return keys // BUCKETS, keys % BUCKETS


def _marks(buffer: Buffer):
    """Runs of ASCII marks, as words of their own."""
    start, end, owner = buffer.words(MARKS)
    return mix(buffer.hashes(start, end) ^ np.uint64(0x5DEECE66D)), start, owner


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from all learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count_features(batches):
    """Per task and class, how many rows have each feature."""
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end, texts in text_slices(batch.column(0)):
            row, column = features(texts)
            own = label[first:end]
            rows += np.bincount(own, minlength=2)
            totals += np.bincount(own[row] * BUCKETS + column, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    some = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(([-1], some)))] + [pa.array(np.concatenate(([rows[k]], totals[k, some]))) for k in (0, 1)],
        names=["feature", "low", "high"],
    )


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, passes: int = PASSES):
    """Weights and bias of the hinge-loss model by dual coordinate descent.
    ``rows`` hold feature numbers; values are the ratios, scaled to unit length."""
    weights, bias = np.zeros(len(ratios)), 0.0
    values = []
    for row in rows:
        v = ratios[row]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
    signs = np.where(labels > 0, 1.0, -1.0)
    # classes weigh alike whatever their share
    share = np.array([max((labels == k).mean(), 1e-9) for k in (0, 1)])
    upper = penalty * 0.5 / share[labels]
    dual = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            row, v, y = rows[i], values[i], signs[i]
            slope = y * (weights[row] @ v + bias) - 1
            # squared length is 1, and 1 for the bias
            new = min(max(dual[i] - slope / 2, 0.0), upper[i])
            step = new - dual[i]
            if step:
                dual[i] = new
                weights[row] += step * y * v
                bias += step * y
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, bias


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * margins).sum() + 0.01 * a, (p - labels).sum() + 0.01 * b])
        h = np.array([[(w * margins * margins).sum() + 0.01, (w * margins).sum()], [(w * margins).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """What scoring needs: 4 bytes per bucket, whatever the corpus."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights = (weights * ratios).astype(np.float32)
        self.squares = (ratios * ratios).astype(np.float32)
        self.bias, self.slope, self.offset = bias, slope, offset

    def margins(self, texts: list[bytes]) -> np.ndarray:
        row, column = features(texts)
        total = np.bincount(row, self.weights[column], minlength=len(texts))
        length = np.sqrt(np.bincount(row, self.squares[column], minlength=len(texts)))
        return total / np.maximum(length, 1e-12) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def labelled_packed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, turn, packed) of the training rows, in no order; ``turn`` is a
    hash of the text and the doc_id, so copies of a text do not enter a sample
    together.  Texts are compressed before they travel."""
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    known = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    packed = per_text(
        docs.where(known), lambda: lambda texts: [[pack(t) for t in texts]], [("packed", "binary")],
        ["doc_id", F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")), "doc_id").alias("turn")],
    )
    # labels grow with the documents: both sides are dealt by id at every size, never broadcast
    return packed.join(marks.where(known).hint("merge"), "doc_id").select("label", "turn", "packed")


def restored(packed: DataFrame) -> DataFrame:
    """(label, turn, text) of (label, turn, packed) rows."""

    def restore(batches):
        for batch in batches:
            texts = [unpack(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary()).cast(pa.string())], names=["label", "turn", "text"])

    return packed.select("label", "turn", "packed").mapInArrow(restore, "label int, turn bigint, text string")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, turn, text) of the training rows, in no order."""
    return restored(labelled_packed(docs, labels))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, curve: int = CURVE, held: int = HELD) -> Model:
    """Learn from all labelled rows of ``docs`` (doc_id, text) and ``labels``
    (doc_id, quality) that are not held out: class counts of every feature
    from all of them; the hinge fit and the curve from the first ``sample`` +
    ``curve`` rows by ``turn`` (ties by label), taken whole while their
    features stay within ``held``."""
    # the training rows stay compressed on disk
    packed = materialize(labelled_packed(docs, labels), "labelled")
    rows = restored(packed)
    counts = rows.select("text", "label").mapInArrow(_count_features, "feature bigint, low bigint, high bigint")
    # one row per bucket at most
    table = counts.groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas()
    number = np.zeros((2, BUCKETS))
    seen = table[table["feature"] >= 0]
    number[:, seen["feature"].to_numpy(dtype=np.int64)] = seen[["low", "high"]].to_numpy().T
    per_class = table[table["feature"] < 0][["low", "high"]].to_numpy().ravel()
    if len(per_class) < 2 or not per_class.all():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    chance = (number + ALPHA) / (per_class[:, None] + 2 * ALPHA)
    ratios = np.log(chance[1] / chance[0])
    ratios[number.sum(axis=0) == 0] = 0.0

    def whole(texts: list[bytes]):
        row, column = features(texts)
        return [np.split(column.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))]

    # the order picks keys alone; only the texts of the chosen keys are read again
    keys = packed.select("turn", "label").orderBy("turn", "label").limit(sample + curve)
    chosen = restored(packed.join(F.broadcast(keys), ["turn", "label"], "left_semi"))  # sample + curve rows at most
    taken = materialize(per_text(chosen, lambda: whole, [("features", "array<int>")], ["label", "turn"]), "quality-sample")
    sizes = taken.select("turn", "label", F.size("features").alias("n")).orderBy("turn", "label").toPandas()
    within = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), held, side="right"))
    last = sizes.iloc[within - 1] if within else None
    if last is None:
        return Model(np.zeros(BUCKETS), ratios, 0.0, 1.0, 0.0)
    upto = (F.col("turn") < int(last["turn"])) | ((F.col("turn") == int(last["turn"])) & (F.col("label") <= int(last["label"])))
    got = taken.where(upto).orderBy("turn", "label").toArrow()
    label = got.column("label").to_numpy().astype(np.int64)
    # the lists as views of one array: offsets and values, no Python integers
    column = got.column("features").combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    lists = np.split(values, offsets[1:-1] - offsets[0]) if len(column) else []
    # a quarter fits the curve where there are fewer rows than asked for
    cut = min(sample, max(1, len(lists) * 3 // 4))
    weights, bias = fit_hinge(lists[:cut], label[:cut], ratios)
    model = Model(weights, ratios, bias, 1.0, 0.0)
    margins = np.array([
        (model.weights[r] @ np.ones(len(r)) / max(np.sqrt(model.squares[r].sum()), 1e-12)) + bias for r in lists[cut:]
    ])
    if len(margins):
        model.slope, model.offset = fit_curve(margins, label[cut:])
    return model


def score_quality(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """``keep`` and score of every row; the model has a fixed size and goes to every task."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        return lambda texts: [model.scores(texts)]

    return per_text(docs, make, [("score", "double")], keep)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
