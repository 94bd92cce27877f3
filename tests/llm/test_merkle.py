import hashlib
import zlib

from pyspark.sql import functions as F

from pagewright.llm.merkle import UPPER, append_log, manifest, prove, tampered

from .conftest import edge_rows


def h(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def field(v) -> str:
    if v is None:
        return "-"
    v = str(v)
    return f"{len(v.encode('utf-8'))}:{v}"


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return h("".join(field(v) for v in (doc_id, source, lang, n_chars, text)))


def build(nodes):
    """Levels of one tree, bottom-up, and its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + 8])) for i in range(0, len(now), 8)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        g = i // 8 * 8
        out.append(("".join(level[g:i]), "".join(level[i + 1:g + 8])))
        i //= 8
    return out


def brute(rows, change):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        items = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = (items, build([leaf(*r) for r in items]))
    upper = build([trees[v][1][-1][0] for v in langs])
    root = upper[-1][0]
    out = []
    for k, lang in enumerate(langs):
        items, levels = trees[lang]
        for i, r in enumerate(items):
            path = sides(levels, i) + sides(upper, k)
            x = leaf(*r)
            t = leaf(r[0], r[1], r[2], r[3], change(r)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None else x
            for left, right in path:
                t = h(left + t + right)
            out.append((r[0], x, levels[-1][0], root, h("".join(a + b for a, b in path)), t, t == root))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def lower(r):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])


def test_manifest_equals_brute_force(spark):
    base = [(d, t, la, s) for d, t, la, s in edge_rows()]
    extra = [(100 + i, f"Text {i} Of Lang", ["en", "de", None, "xx", "é"][i % 5], "s") for i in range(700)]
    rows = [(d, s, la, len(t or ""), t) for d, t, la, s in base + extra]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string").repartition(5)
    got, log = manifest(df, tampered(F.col("doc_id")))
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()),
                 key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute(rows, lower)
    # the log holds every node once, at distinct postorder positions that follow the children
    nodes = log.collect()
    by_key = {}
    for n in nodes:
        by_key.setdefault(n.key, []).append(n)
    for items in by_key.values():
        pos = sorted(n.pos for n in items)
        assert pos == list(range(len(items)))
        where = {(n.level, n.idx): n.pos for n in items}
        for (level, idx), p in where.items():
            if level:
                kids = [where[(level - 1, c)] for c in range(idx * 8, idx * 8 + 8) if (level - 1, c) in where]
                assert max(kids) == p - 1 and all(k < p for k in kids)


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty, _ = manifest(spark.createDataFrame([], schema), tampered(F.col("doc_id")))
    assert empty.count() == 0
    one = [(3, None, None, None, "ABC")]
    got = manifest(spark.createDataFrame(one, schema), tampered(F.col("doc_id")))[0].collect()
    x = leaf(*one[0])
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256) for r in got] == [(x, x, x, h(""))]


def test_proofs_come_from_the_log_and_every_row_is_folded(spark):
    rows = [(i, "s", "en" if i < 90 else "de", 4, "text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves, log, sizes = append_log(docs)
    assert all(r.verified for r in prove(leaves, log, sizes).collect())
    # the log holds the tree of subroots too, and a forged digest at one position
    # reaches every untampered row that has it as a sibling, and no other
    assert log.where(F.col("key") == UPPER).count() == 3
    hit = (F.col("key") == 1) & (F.col("level") == 1) & (F.col("idx") == 2)
    forged = log.withColumn("hash", F.when(hit, h("forged")).otherwise(F.col("hash")))
    got = prove(leaves, forged, sizes).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(64) if i // 8 != 2}
