import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pagewright.llm.common import components
from pagewright.llm.simhash import NEAR, alike_in_run, arrange, arrangements, drop_near_copies, fingerprint, gray_rank, link_run, near_components, open_pairs, shingle_set
from pagewright.llm.suffixes import drop_repeats, remove_repeats

from .conftest import edge_rows, prose


def brute_repeats(rows, length):
    rows = list(dict.fromkeys((-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows))
    first = {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (i, p):
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, b] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [100_000, 2])
def test_repeats_equal_brute_force(spark, edge_docs, crowd):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute_repeats(rows, 100)
    got = remove_repeats(edge_docs, crowd=crowd, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (-(1 << 63) if r.doc_id is None else r.doc_id, (r.text or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[key], key[0]


def test_drop_repeats_keeps_columns_and_clean_rows(edge_docs, no_docs):
    got = drop_repeats(edge_docs)
    assert got.schema.simpleString() == edge_docs.schema.simpleString()
    texts = {r.doc_id: r.text for r in got.where("doc_id is not null").collect()}
    assert texts[7] == next(r[1] for r in edge_rows() if r[0] == 7)  # first of a passage stays whole
    assert 12 not in texts and texts[1] is None and texts[2] == ""
    assert len(texts[8]) < len(next(r[1] for r in edge_rows() if r[0] == 8)) - 100
    assert drop_repeats(no_docs).count() == 0


def brute_components(rows, n, radius):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(rows))]
    least = defaultdict(list)
    for k, (i, _) in zip(label, rows):
        least[k] += [i] if i is not None else []
    return sorted((i or 0, f, min(least[k], default=None)) for (i, _), f, k in zip(rows, fps, label))


@pytest.mark.parametrize("n, radius, blocks", [(3, 2, 8), (5, 6, 9)])
def test_components_equal_brute_force(edge_docs, n, radius, blocks):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = sorted((r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in near_components(edge_docs, n, radius, blocks).collect())
    assert got == brute_components(rows, n, radius)


def test_runs_connect_all_that_can_be_connected():
    rng = np.random.default_rng(5)
    for radius in (2, 6, 10):
        base = rng.integers(0, 1 << 62, size=4, dtype=np.uint64)
        codes = base[rng.integers(0, 4, 500)]
        for _ in range(4):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
        codes = np.unique(codes)
        codes = codes[np.argsort(gray_rank(codes))]
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
        label = np.arange(len(codes))
        while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
            label = new
        root = list(range(len(codes)))
        for a, b in link_run(codes, radius):
            assert near[a, b]
            x, y = sorted((root[a], root[b]))
            assert x != y  # a forest: no link is in vain
            root = [x if r == y else r for r in root]
        assert [label[r] for r in root] == label.tolist() and len(set(root)) == len(set(label.tolist()))


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


def test_chains_and_stars_have_one_root(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(1, 61)} == {0} and {got[1000 + k] for k in range(1, 200)} == {1000}


def test_one_of_each_group_stays(edge_docs, no_docs):
    kept = drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and not {5, 6, 12} & set(ids)
    assert {7, 8, 9, 14, 15, 18} <= set(ids) and ids.count(None) == 2
    assert drop_near_copies(no_docs, **NEAR).count() == 0


def variants(groups=20, members=14):
    """Groups of variants of 120 words whose similarities lie about 0.8."""
    rows = []
    for g in range(groups):
        rng = random.Random(g)
        base = prose(1000 + g, 120).split()
        for m in range(members):
            words = list(base)
            for k in rng.sample(range(120), rng.randint(1, 4)):
                words[k] = f"v{g}x{m}y{k}"
            rows.append((g * members + m, " ".join(words)))
    return rows


def test_open_pairs_are_all_pairs_across_parts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, size=4, dtype=np.uint64)
    codes = base[rng.integers(0, 4, 400)]
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    codes = np.unique(codes)
    codes = codes[np.argsort(gray_rank(codes))]
    parts = rng.integers(0, 3, len(codes))
    want = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 10) & (parts[:, None] != parts[None, :])
    assert {(min(p), max(p)) for p in zip(*map(np.ndarray.tolist, open_pairs(codes, parts, 10)))} == {(a, b) for a, b in np.argwhere(want).tolist() if a < b}


def test_a_failed_link_hides_no_other(spark):
    rows = variants()
    fps = np.array([fingerprint(t.encode(), 5) for _, t in rows], dtype=np.uint64)
    sets = [set(shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    leads = [arrange(fps, order) >> np.uint64(free) for order, free in arrangements(NEAR["blocks"], NEAR["radius"])]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if int(fps[a] ^ fps[b]).bit_count() <= NEAR["reach"] and any(x[a] == x[b] for x in leads)
        and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_components(docs, **NEAR).collect()}
    assert len(pairs) > 50 and [p for p in pairs if got[p[0]] != got[p[1]]] == []


def test_a_broken_run_gives_a_forest_of_alike_links():
    rows = variants(groups=3, members=60)
    fps, first = np.unique(np.array([fingerprint(t.encode(), 5) for _, t in rows], dtype=np.uint64), return_index=True)
    order = np.argsort(gray_rank(fps))
    codes, sets = fps[order], [shingle_set(rows[k][1].encode(), 5) for k in first[order]]
    parts = np.arange(len(codes))
    parts[1::7] = parts[0]  # joined already
    near = list(zip(*open_pairs(codes, parts, 10)))
    alike = [(a, b) for a, b in near if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert len(near) > 2 * len(alike) > 2 * len(codes)

    def classes(links):
        root = parts.tolist()
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    got = alike_in_run(codes, parts, sets, 10, 0.8)
    assert {(min(p), max(p)) for p in got} <= set(alike)
    assert classes(got) == classes(alike)
    assert len(got) == len(set(parts.tolist())) - len(set(classes(alike)))  # no link is in vain
