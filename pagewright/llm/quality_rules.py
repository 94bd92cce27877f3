"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text gives a vector of transformed statistics.  Per language and source
the minimum-covariance-determinant estimate of centre and scatter is found:
start from medians and median absolute deviations, then repeat concentration
steps, each keeping the 75 % of rows that lie nearest and taking their mean and
covariance.  A text is rejected if its squared Mahalanobis distance, scaled so
that the group's median is the one of a chi-square law, is beyond ``cutoff``.
Digits and repeats are absent from most texts and add nothing to the median
distance, so the median is held against three degrees of freedom; the cutoff is
a quantile with all five, for which outliers have to answer.  Rows of equal
statistics count once in the estimates, so that copies do not narrow them.

Every step is one aggregation over a narrow table of statistics of all rows;
what a group keeps is a few numbers.  Groups of less than ``least`` rows are
judged with their language, and languages of less with all rows.

Defined cases: null or blank text has no words and fails the base rules; null
language or source is a group of its own; repeated rows are judged alike; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Buffer, byte_table, materialize, ngrams, per_text

#: Base rules: fewest words, and most words (percent) in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
#: Rows a group must have for estimates of its own.
LEAST = 200
#: Share of rows a concentration step keeps, and the number of steps.
KEEP, STEPS = 0.75, 3
#: Squared distance beyond which a text is rejected: one in a million of a
#: chi-square law with as many degrees of freedom as statistics.
CUTOFF = 35.89
#: Words at which a text's deviation counts half: short texts vary by chance.
DAMP = 500.0
#: Smallest standard deviation of each statistic, in its own unit; digits and
#: repeats vary much among clean texts, and the base rules see to repeats.
FLOOR = np.array([0.05, 0.02, 0.03, 0.30, 0.20])
FEATURES = len(FLOOR)
#: Median of a chi-square law with three degrees of freedom, and the least scale:
#: a group whose rows hardly differ is judged by the floors.
CHI_MEDIAN, LEAST_SCALE = 2.366, 0.05

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
UPPER, DIGIT = byte_table((0x41, 0x5A)), byte_table((0x30, 0x39))
COUNTS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint")]
STATISTICS = [("z", "array<double>")]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def text_sums(buffer: Buffer, flags: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[buffer.starts + buffer.lengths] - sums[buffer.starts]


def repeated_words(buffer: Buffer, start, end, owner, texts: int) -> np.ndarray:
    """Words per text inside windows of WINDOW words that occur twice or more in it."""
    windows, at = ngrams(buffer.hashes(start, end), owner, WINDOW)
    if not len(at):
        return np.zeros(texts, dtype=np.int64)
    order = np.lexsort((windows, owner[at]))
    same = (windows[order][1:] == windows[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    opened = np.zeros(len(start) + 1, dtype=np.int64)
    hits = at[order[again]]
    np.add.at(opened, hits, 1)
    np.add.at(opened, hits + WINDOW, -1)
    return np.bincount(owner[np.cumsum(opened)[:-1] > 0], minlength=texts)


def _statistics():
    def compute(texts: list[bytes]):
        buffer = Buffer(texts)
        data = buffer.data
        start, end, owner = buffer.words(NOT_SPACE)
        n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        chars = text_sums(buffer, NOT_SPACE[data] & ((data & 0xC0) != 0x80))
        marks = text_sums(buffer, MARKS[data])
        upper, digits = text_sums(buffer, UPPER[data]), text_sums(buffer, DIGIT[data])
        repeats = repeated_words(buffer, start, end, owner, len(texts))
        words, size = np.maximum(n_words, 1), np.maximum(chars, 1)
        angle = lambda part: np.arcsin(np.sqrt(np.clip(part / size, 0, 1)))
        z = np.stack([
            np.log(size / words), angle(marks), angle(upper), angle(digits),
            np.arcsin(np.sqrt(np.clip(repeats / words, 0, 1))),
        ], axis=1)
        return [
            n_words, chars, text_sums(buffer, SYMBOLS[data]),
            np.fromiter(map(duplicate_lines, texts), dtype=np.int64, count=len(texts)), repeats, list(z),
        ]

    return compute


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def text_statistics(docs: DataFrame, keep=(), within=None) -> DataFrame:
    """``keep``, the base counts and the statistics ``z`` per row."""
    return per_text(docs, _statistics, COUNTS + STATISTICS, keep, within=within)


# --- minimum covariance determinant -------------------------------------------

def _levels(stats: DataFrame, least: int) -> DataFrame:
    """Which group judges each (lang, source): itself, its language or all."""
    counts = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    tongues = counts.groupBy("lang").agg(F.sum("n").alias("m")).withColumnRenamed("lang", "tongue")
    name = lambda *parts: F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])
    lang, source = F.col("lang"), F.col("source")
    return counts.join(tongues, lang.eqNullSafe(F.col("tongue"))).select(
        lang.alias("of_lang"), source.alias("of_source"),
        F.when(F.col("n") >= least, name(lang, source)).when(F.col("m") >= least, name(lang)).otherwise(F.lit("all")).alias("judge"),
    )


def _with_judge(rows: DataFrame, levels: DataFrame) -> DataFrame:
    match = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    return rows.join(levels, match).drop("of_lang", "of_source")


def _damped(centre: str = "centre") -> list[Column]:
    """Deviations from the group's medians, damped for short texts."""
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + F.lit(DAMP)))
    return [(F.col("z")[k] - F.col(centre)[k]) * weight for k in range(FEATURES)]


def _distance() -> Column:
    """Squared Mahalanobis distance under the columns ``mean`` and ``inverse``."""
    off = [x - F.col("mean")[k] for k, x in enumerate(_damped())]
    total = F.lit(0.0)
    for i in range(FEATURES):
        row = F.lit(0.0)
        for j in range(FEATURES):
            row = row + F.col("inverse")[i * FEATURES + j] * off[j]
        total = total + row * off[i]
    return total


def _solve(batches):
    """Centre and inverse scatter of each group from its sums."""
    for frame in batches:
        out = []
        for _, row in frame.iterrows():
            n = max(float(row["n"]), 1.0)
            mean = np.array([float(row[f"s{i}"]) for i in range(FEATURES)]) / n
            scatter = np.empty((FEATURES, FEATURES))
            for i in range(FEATURES):
                for j in range(i, FEATURES):
                    scatter[i, j] = scatter[j, i] = float(row[f"p{i}_{j}"]) / n - mean[i] * mean[j]
            scatter[np.diag_indices(FEATURES)] = np.maximum(scatter.diagonal(), 0) + FLOOR ** 2
            out.append((row["judge"], list(row["centre"]), mean.tolist(), np.linalg.inv(scatter).ravel().tolist()))
        yield pd.DataFrame(out, columns=["judge", "centre", "mean", "inverse"])


MODEL = "judge string, centre array<double>, mean array<double>, inverse array<double>"


def fit_rules(stats: DataFrame, least: int = LEAST, keep: float = KEEP, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Groups and their estimates from a written table of statistics; texts
    that fail the base rules do not take part."""
    levels = materialize(_levels(stats, least), "levels")
    rows = _with_judge(stats.where(~base_failed()), levels).select("judge", "n_words", "z").distinct()
    rows = materialize(rows, "distinct")
    # medians, then spreads around them: the robust start
    centre = rows.groupBy("judge").agg(
        F.array(*[F.percentile_approx(F.col("z")[k], 0.5, 2000) for k in range(FEATURES)]).alias("centre")
    )
    centre = materialize(centre, "centres")
    spread = rows.join(centre, "judge").groupBy("judge").agg(
        F.first("centre").alias("centre"), *[F.percentile_approx(F.abs(x), 0.5, 2000).alias(f"d{k}") for k, x in enumerate(_damped())]
    )
    start = [F.lit(0.0)] * (FEATURES * FEATURES)
    for k in range(FEATURES):
        start[k * FEATURES + k] = 1 / (F.pow(F.col(f"d{k}") * 1.4826, 2) + float(FLOOR[k] ** 2))
    model = materialize(
        spread.select("judge", "centre", F.array(*[F.lit(0.0)] * FEATURES).alias("mean"), F.array(*start).alias("inverse")), "start"
    )
    for _ in range(steps):
        near = rows.join(model, "judge").groupBy("judge").agg(F.percentile_approx(_distance(), keep, 2000).alias("within"))
        near = materialize(near, "within")
        x = _damped()
        sums = [F.sum(x[i]).alias(f"s{i}") for i in range(FEATURES)]
        sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(FEATURES) for j in range(i, FEATURES)]
        kept = rows.join(model.join(near, "judge"), "judge").where(_distance() <= F.col("within"))
        moments = kept.groupBy("judge").agg(F.first("centre").alias("centre"), F.count(F.lit(1)).alias("n"), *sums)
        model = materialize(moments.mapInPandas(_solve, MODEL), "estimates")
    scale = rows.join(model, "judge").groupBy("judge").agg(F.percentile_approx(_distance(), 0.5, 2000).alias("middle"))
    model = model.join(scale, "judge").withColumn("scale", F.greatest(F.col("middle") / CHI_MEDIAN, F.lit(LEAST_SCALE))).drop("middle")
    return levels, materialize(model, "model")


def judge(rows: DataFrame, model: tuple[DataFrame, DataFrame], cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, distance and kept to rows with statistics, lang and source."""
    levels, estimates = model
    # a group without a row that passes the base rules has no estimates, and needs none
    known = _with_judge(rows, levels).join(estimates, "judge", "left")
    distance = F.coalesce(_distance() / F.col("scale"), F.lit(0.0))
    return (
        known.withColumn("base_failed", base_failed()).withColumn("distance", distance)
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
        .drop("judge", "centre", "mean", "inverse", "scale")
    )


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source) the base counts,
    base_failed, distance and kept."""
    stats = materialize(text_statistics(docs, ["doc_id", "lang", "source"]), "statistics")
    return judge(stats, fit_rules(stats), cutoff).drop("z", "lang", "source")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    columns = docs.columns
    stats = materialize(text_statistics(docs, ["lang", "source"]), "statistics")
    whole = docs.select(F.struct(*columns).alias("row"), "lang", "source")
    rows = text_statistics(whole, ["row", "lang", "source"], ("row", "text"))
    return judge(rows, fit_rules(stats), cutoff).where("kept").select("row.*")
