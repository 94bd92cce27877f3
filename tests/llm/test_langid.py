import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm.langid import held_out, language_ids, viterbi, word_grams

EN = "the river runs under the old stone bridge and the children watch the water with quiet delight".split()
DE = "der fluss läuft unter der alten steinbrücke und die kinder schauen dem wasser mit stiller freude zu".split()
EL = "το ποτάμι τρέχει κάτω από την παλιά πέτρινη γέφυρα και τα παιδιά κοιτάζουν το νερό".split()


def text(words, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def brute(e, penalty):
    """Best score over all label sequences."""
    best = -np.inf
    for path in itertools.product(range(e.shape[1]), repeat=e.shape[0]):
        s = sum(e[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(best, s)
    return best


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    chains = [rng.normal(size=(n, 3)) for n in (0, 1, 4, 6, 2, 6)]
    chains[2][1, 0] = -np.inf  # a language that is no candidate for one word
    for chain, path in zip(chains, viterbi(chains, 1.5)):
        assert len(path) == len(chain)
        if len(chain):
            got = chain[np.arange(len(path)), path].sum() - 1.5 * (np.diff(path) != 0).sum()
            assert abs(got - brute(chain, 1.5)) < 1e-9


def test_word_grams_of_edges():
    assert len(word_grams("")[2]) == 0 and len(word_grams("123 ### !!")[2]) == 0
    slots, owners, size, script, starts = word_grams("Ab, cde ΣΑΣ")
    assert list(size) == [2, 3, 3] and list(starts) == [0, 4, 8] and len(set(script)) == 2
    assert owners.max() == 2 and len(slots) == len(owners)


def test_language_ids_learn_held_out_and_mixed_spans(spark):
    rows = []
    for i in range(300):
        lang, words = [("en", EN), ("de", DE), ("el", EL)][i % 3]
        rows.append((i, text(words, i), lang, "src", 0.5))
    rows += [
        (1000, None, "en", "s", 0.0), (1001, "", "en", "s", 0.0), (1002, "1234 ### 5678", None, "s", 0.0),
        (1003, text(EN, 5, 60) + " " + text(DE, 6, 60), None, "s", 0.0), (1003, text(EN, 5, 60) + " " + text(DE, 6, 60), None, "s", 0.0),
        (1004, "x" * 5000, None, "s", 0.0), (None, text(EL, 9), None, "s", 0.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    got = {}
    for r in language_ids(df, ~held_out(F.col("doc_id"))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(len(v) for v in got.values()) == len(rows)
    labelled = {r[0]: r[2] for r in rows[:300]}
    held = [d for d in labelled if __import__("zlib").crc32(str(d).encode()) % 5 == 0]
    assert held and all(got[d][0].lang_pred == labelled[d] for d in held)
    for d in (1000, 1001, 1002):
        assert (got[d][0].lang_pred, got[d][0].score, got[d][0].n_spans) == ("und", 0.0, 0)
    mixed = got[1003]
    assert mixed[0] == mixed[1] and mixed[0].n_spans == 2 and mixed[0].spans[0].startswith("en:0-")
    assert mixed[0].spans[1].startswith("de:") and 0.4 < mixed[0].score < 0.6
    assert got[None][0].lang_pred == "el" and 0 <= got[1004][0].score <= 1
    # script ranges: a Greek word can only be Greek, however the letters score
    assert all(s.split(":")[0] == "el" for s in got[None][0].spans)


def test_language_ids_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some words here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_ids(df, F.lit(True)).collect()] == [("und", 0.0)]
    assert language_ids(df.limit(0), F.lit(True)).count() == 0
