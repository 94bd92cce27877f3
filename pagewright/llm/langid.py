"""Language identification of whole texts: script ranges narrow the candidate
languages of each word, per-word scores come from a character n-gram model
learned on the corpus, and a Viterbi pass over the words with a switching
penalty labels spans of mixed-language text.

Model.  Words are maximal runs of letters (Unicode category L*) of the text
lower-cased by Python's ``str.lower``.  Each word, framed by one boundary mark
on each side, gives its 1-, 2- and 3-grams of code points; grams are hashed to
``BUCKETS`` slots.  Training counts grams per (lang, slot) and letters per
(lang, script) in one Arrow pass per task, summed by a shuffle of at most
languages x (slots + scripts) rows per task; the model that the scoring tasks
hold is languages x ``BUCKETS`` floats, a bound fixed by the number of
languages, whatever the corpus size.

Scoring.  A word's emission for language L is its log-likelihood under L,
normalised over the candidates; languages that never wrote the word's script
(the script of its first letter) are no candidates, unless none did.  Viterbi
with a constant ``SWITCH`` penalty runs over the words of many texts at once
(one step per word position, all texts of a slice side by side).  The text's
language is the label covering most letters; its score is that share.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and no spans; an empty training set labels every text ``und``; ties between
languages go to the first by code (UTF-8 order).  Repeated rows are scored
alike.  Only ``text`` (and, for training, ``lang``) is read of the input.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Hash slots of the n-gram model; add-ALPHA smoothing; penalty of a switch in nats.
BUCKETS = 1 << 18
ALPHA = 0.5
SWITCH = 6.0
#: Share of a language's letters a script needs to make the language a candidate.
SCRIPT_SHARE = 0.001
#: Bytes of text that one Viterbi pass holds side by side.
SLICE = 1 << 22

# Unicode script ranges (first, last code point, script name).
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x139F, "Ethiopic"), (0x13A0, 0x13FF, "Cherokee"),
    (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x2C00, 0x2C5F, "Glagolitic"), (0x2D30, 0x2D7F, "Tifinagh"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"),
    (0x3100, 0x312F, "Bopomofo"), (0x3130, 0x318F, "Hangul"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
    (0xA000, 0xA4CF, "Yi"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFB50, 0xFDFF, "Arabic"),
    (0xFE70, 0xFEFF, "Arabic"), (0xFF21, 0xFF5A, "Latin"), (0xFF66, 0xFF9F, "Katakana"), (0x20000, 0x323AF, "Han"),
]
SCRIPTS = sorted({name for _, _, name in SCRIPT_RANGES})
_STARTS = np.array([a for a, _, _ in SCRIPT_RANGES], dtype=np.int64)
_ENDS = np.array([b for _, b, _ in SCRIPT_RANGES], dtype=np.int64)
_IDS = np.array([SCRIPTS.index(n) + 1 for _, _, n in SCRIPT_RANGES], dtype=np.int64)
#: Script number 0: any other code point.
N_SCRIPTS = len(SCRIPTS) + 1

_LETTER_BMP: np.ndarray | None = None


def _letters(cps: np.ndarray) -> np.ndarray:
    """True where the code point is a letter (category L*)."""
    global _LETTER_BMP
    if _LETTER_BMP is None:
        _LETTER_BMP = np.array([unicodedata.category(chr(i)).startswith("L") for i in range(0x10000)], dtype=bool)
    out = np.zeros(len(cps), dtype=bool)
    low = cps < 0x10000
    out[low] = _LETTER_BMP[cps[low]]
    for i in np.flatnonzero(~low):
        out[i] = unicodedata.category(chr(int(cps[i]))).startswith("L")
    return out


def scripts_of(cps: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_STARTS, cps, side="right") - 1
    inside = (at >= 0) & (cps <= _ENDS[np.maximum(at, 0)])
    return np.where(inside, _IDS[np.maximum(at, 0)], 0)


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each gram, word of each gram, letters per word, script per
    word, first code point index of each word) of one text."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters(cps)
    if not letter.any():
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    # letters with one boundary mark (0) between words and at both ends
    keep = letter | np.r_[False, letter[:-1]]
    framed = np.concatenate(([0], np.where(letter, cps, 0)[keep]))
    if framed[-1] != 0:
        framed = np.concatenate((framed, [0]))
    marks = framed == 0
    word = np.cumsum(marks) - 1  # word of each framed position; a mark belongs to the word after it
    n_words = len(starts)
    slots, owners = [], []
    a = framed.astype(np.uint64)
    for n in (1, 2, 3):
        if len(framed) < n:
            continue
        m = len(framed) - n + 1
        h = np.full(m, np.uint64(0x9E3779B97F4A7C15 * n % (1 << 64)))
        for k in range(n):
            h = (h ^ a[k:k + m]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        if n == 1:
            ok, owner = ~marks[:m], word[:m]
        elif n == 2:
            ok = ~(marks[:m] & marks[1:m + 1])
            owner = word[:m]
        else:
            ok, owner = ~marks[1:m + 1], word[1:m + 1]
        slots.append((h[ok] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[ok])
    size = np.diff(np.r_[np.flatnonzero(marks)])
    size = size[:n_words] - 1
    return np.concatenate(slots), np.concatenate(owners), size, scripts_of(cps[starts]), starts


def _train_pass(batches):
    """Per task: (lang, kind, slot, count), kind 0 for grams, 1 for letters by script."""
    grams: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slots, _, size, script, _ = word_grams(text)
            if not len(size):
                continue
            held.setdefault(lang, []).append(slots)
            s = letters.setdefault(lang, np.zeros(N_SCRIPTS, dtype=np.int64))
            s += np.bincount(script, weights=size, minlength=N_SCRIPTS).astype(np.int64)
        for lang, parts in held.items():
            g = grams.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            g += np.bincount(np.concatenate(parts), minlength=BUCKETS)
    out_l, out_k, out_s, out_c = [], [], [], []
    for kind, table in enumerate((grams, letters)):
        for lang, c in table.items():
            nz = np.flatnonzero(c)
            out_l += [lang] * len(nz)
            out_k.append(np.full(len(nz), kind, dtype=np.int32))
            out_s.append(nz.astype(np.int32))
            out_c.append(c[nz])
    if out_l:
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_l, pa.string()), pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_c))],
            names=["lang", "kind", "slot", "count"],
        )


class Model:
    """Log-probabilities (languages x BUCKETS) and the scripts each language writes."""

    def __init__(self, langs: list[str], logp: np.ndarray, writes: np.ndarray) -> None:
        self.langs, self.logp, self.writes = langs, logp, writes


def train(docs: DataFrame, train_rows: Column) -> Model:
    """The model from ``text`` and non-null ``lang`` of the rows ``train_rows`` selects."""
    rows = docs.where(train_rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string"), F.col("lang").cast("string")
    )
    counts = (
        rows.mapInArrow(_train_pass, "lang string, kind int, slot int, count long")
        .groupBy("lang", "kind", "slot").agg(F.sum("count").alias("count"))
        .collect()  # at most languages x (BUCKETS + scripts) rows
    )
    langs = sorted({r.lang for r in counts}, key=lambda v: v.encode("utf-8"))
    at = {v: i for i, v in enumerate(langs)}
    grams = np.zeros((len(langs), BUCKETS))
    letters = np.zeros((len(langs), N_SCRIPTS))
    for r in counts:
        (grams if r.kind == 0 else letters)[at[r.lang], r.slot] = r["count"]
    logp = np.log((grams + ALPHA) / (grams.sum(1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32)
    writes = letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    return Model(langs, logp, writes)


def emissions(model: Model, slots: np.ndarray, owners: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Words x languages: log-likelihood normalised over the candidates, -inf elsewhere."""
    n_words, n_langs = len(script), len(model.langs)
    e = np.zeros((n_words, n_langs))
    for k in range(n_langs):
        e[:, k] = np.bincount(owners, weights=model.logp[k, slots], minlength=n_words)
    allowed = model.writes[:, script].T  # words x languages
    allowed[~allowed.any(1)] = True
    e = np.where(allowed, e, -np.inf)
    top = e.max(1, keepdims=True)
    return e - (top + np.log(np.exp(e - top).sum(1, keepdims=True)))


def viterbi(chains: list[np.ndarray], penalty: float = SWITCH) -> list[np.ndarray]:
    """Best label sequence of each chain (words x languages emissions), where a
    change of label costs ``penalty``; all chains advance one word per step."""
    lengths = np.array([len(c) for c in chains], dtype=np.int64)
    if not lengths.any():
        return [np.zeros(0, dtype=np.int64) for _ in chains]
    flat = np.concatenate([c for c in chains if len(c)])
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    base = offsets[order]
    steps = int(lengths[order[0]])
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
    dp = flat[base].copy()
    choose, came = [None] * steps, [None] * steps
    for t in range(1, steps):
        k = active[t]
        prev = dp[:k]
        best = prev.argmax(1)
        jump = prev[np.arange(k), best][:, None] - penalty
        switch = jump > prev
        dp[:k] = np.where(switch, jump, prev) + flat[base[:k] + t]
        choose[t], came[t] = switch, best
    state = dp.argmax(1)
    labels = np.zeros(len(flat), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[base[:k] + t] = state[:k]
        if t:
            s = state[:k]
            state[:k] = np.where(choose[t][np.arange(k), s], came[t], s)
    return [labels[o:o + n] for o, n in zip(offsets, lengths)]


def identify(model: Model, texts: list[str | None]) -> tuple[list, list, list, list]:
    """lang_pred, score, n_spans and spans ("lang:first-last" in words) per text."""
    parts = [word_grams(t) if t else None for t in texts]
    chains, sizes = [], []
    for p in parts:
        if p is None or not len(p[2]) or not model.langs:
            chains.append(np.zeros((0, max(1, len(model.langs)))))
            sizes.append(None)
        else:
            chains.append(emissions(model, p[0], p[1], p[3]))
            sizes.append(p[2])
    paths = viterbi(chains)
    preds, scores, n_spans, spans = [], [], [], []
    for path, size in zip(paths, sizes):
        if size is None:
            preds.append("und"), scores.append(0.0), n_spans.append(0), spans.append([])
            continue
        share = np.bincount(path, weights=size, minlength=len(model.langs))
        k = int(share.argmax())
        preds.append(model.langs[k])
        scores.append(float(share[k] / share.sum()))
        cut = np.flatnonzero(np.diff(path)) + 1
        first = np.r_[0, cut]
        last = np.r_[cut - 1, len(path) - 1]
        spans.append([f"{model.langs[path[a]]}:{a}-{b}" for a, b in zip(first, last)])
        n_spans.append(len(first))
    return preds, scores, n_spans, spans


def language_ids(docs: DataFrame, train_rows: Column) -> DataFrame:
    """doc_id, lang_pred, score, n_spans, spans of every row of ``docs``; the
    model learns only from the rows ``train_rows`` selects."""
    model = train(docs, train_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("__text"))
    schema = "doc_id bigint, lang_pred string, score double, n_spans bigint, spans array<string>"

    def run(batches):
        m = held.value
        for batch in batches:
            ids = batch.column(0)
            for first, end, texts in text_slices(batch.column(1), SLICE):
                got = identify(m, [t.decode("utf-8") if t else None for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()),
                     pa.array(got[2], pa.int64()), pa.array(got[3], pa.list_(pa.string()))],
                    names=["doc_id", "lang_pred", "score", "n_spans", "spans"],
                )

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the decimal doc_id is divisible by 5 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
