import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm.quality_model import fit_curve, fit_hinge, quality_scores
from pagewright.llm.quality_rules import keep_good, quality_verdicts

from .conftest import edge_rows, prose


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    again = {q for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for q in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_base_counts_equal_brute_force(edge_docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_verdicts(edge_docs).collect())
    want = []
    for i, text, *_ in edge_rows():
        c = brute_counts(text)
        want.append((i or 0, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want)
    assert quality_verdicts(no_docs).count() == 0
    kept = keep_good(edge_docs)
    assert kept.schema.simpleString() == edge_docs.schema.simpleString()
    assert {7, 9} <= {r.doc_id for r in kept.collect()} and keep_good(no_docs).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    rows = [(k, prose(k, 80 + k % 50), "en", f"s{k % 2}") for k in range(900)]
    rows += [(1000 + k, " ".join(w + "%%%!!" for w in prose(k, 90).upper().split()), "en", "s0") for k in range(60)]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(900))
    assert not any(got[1000 + k].kept for k in range(60)) and not any(got[1000 + k].base_failed for k in range(60))


def test_menus_go_and_good_texts_stay(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    menus = {r.doc_id for r in docs.where(F.size(F.split("text", r" \| ")) > 5).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    got = [r for r in quality_verdicts(docs).collect() if not r.base_failed]
    gone = [r.kept for r in got if r.doc_id in menus]
    assert len(gone) > 20 and sum(gone) <= 0.05 * len(gone)
    assert all(r.kept for r in got if r.doc_id in good)


def test_hinge_and_curve_fit_separable_rows():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 400)
    rows = [np.unique(np.concatenate((rng.integers(10, 60, 8), [label]))) for label in labels]
    ratios = np.zeros(60)
    ratios[0], ratios[1] = -2, 2
    ratios[10:] = rng.normal(0, 0.2, 50)
    weights, bias = fit_hinge(rows, labels, ratios)
    margins = np.array([(weights[r] * ratios[r]).sum() / np.sqrt((ratios[r] ** 2).sum()) + bias for r in rows])
    assert ((margins > 0) == labels).mean() > 0.99
    slope, offset = fit_curve(margins, labels)
    assert slope > 0 and (((slope * margins + offset) > 0) == labels).mean() > 0.99


def test_scores_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_scores_of_odd_rows_and_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(edge_docs, none).collect()
    assert len(got) == len(edge_rows()) and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(4, 1, 0), (9, 1, 0), (16, 0, 0), (11, 0, 0), (11, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scores = quality_scores(edge_docs, some)
    assert scores.where(F.col("score").between(0, 1)).count() == len(edge_rows())
    assert quality_scores(no_docs, some).count() == 0


def test_labels_are_never_broadcast(spark, sf_dir):
    from pagewright.llm.quality_model import labelled_packed

    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    got = labelled_packed(docs, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    known = {r.doc_id for r in docs.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert got.count() == sum(r.doc_id in known and r.quality in (0, 1) for r in labels.collect()) > 0
