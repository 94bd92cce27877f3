import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm.bpe import WordBpe, encode_digests, encode_texts, row_digests
from pagewright.llm.chat import chat_digests, escape, escape_role, unescape, unescape_role
from pagewright.llm.decontaminate import drop_leaks, find_leaks, weighted_jaccard
from pagewright.llm.licenses import PASSAGES, PHRASES, WORD, license_scan
from pagewright.llm.main_text import extract_pages, main_text
from pagewright.llm.token_files import (
    PieceEncoder, _read_shards, frame, masked, read_token_files, record_at, records, token_digests, write_token_files,
)

from .conftest import edge_rows, prose


def test_license_places_equal_brute_force(edge_docs, no_docs, spark):
    assert license_scan(no_docs).count() == 0
    want = []
    for i, text, *_ in edge_rows():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words, places, labels = re.findall(WORD, low), [], set()
        for phrase, label in PHRASES:
            phrase = phrase.split()
            at = [k for k in range(len(words)) if words[k:k + len(phrase)] == phrase]
            places += at
            labels |= {label} if at else set()
        want.append((i or 0, len(words), len(places), min(places, default=-1), max(places, default=-1), ",".join(sorted(labels))))
    first = lambda v: -1 if v is None else v
    got = license_scan(edge_docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, first(r.first_word), first(r.last_word), r.base_labels) for r in got) == sorted(want)
    text = PASSAGES[0][0].split()
    changed = " ".join(text[:9] + ["new", "words"] + text[9:30] + text[31:])
    odd = spark.createDataFrame([(1, prose(1, 30) + " " + changed), (2, " ".join(text[::-1])), (3, PASSAGES[3][0])], "doc_id long, text string")
    labels = {r.doc_id: (r.labels, r.base_labels) for r in license_scan(odd).collect()}
    assert labels == {1: ("mit", ""), 2: ("", ""), 3: ("bsd", "")}


def test_license_plan_is_native(edge_docs):
    plan = license_scan(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def brute_leaks(rows, items):
    pattern = re.compile(rb"[0-9a-z\x80-\xff]+")
    cut = lambda t: pattern.findall((t or "").encode().lower())
    found = set()
    for i, text in rows:
        words = cut(text)
        for j, item in items:
            wanted = cut(item)
            k = min(5, len(wanted))
            if not k:
                continue
            bag = Counter(tuple(wanted[q:q + k]) for q in range(len(wanted) - k + 1))
            for s in range(max(1, len(words) - len(wanted) + 1)):
                run = words[s:s + len(wanted)]
                if weighted_jaccard(Counter(tuple(run[q:q + k]) for q in range(len(run) - k + 1)), bag) >= 0.8:
                    found.add((i, j))
    return found


def test_leaks_equal_brute_force(spark, edge_docs, no_docs):
    hidden = prose(99, 30).split()
    near = " ".join(hidden[:28] + ["other", "end"])
    items = [(1, " ".join(hidden).upper()), (2, near), (3, None), (4, "!!"), (5, "Unicode"), (6, "word"), (7, prose(50, 20)), (8, "it's"), (8, "it's")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks([(r[0], r[1]) for r in edge_rows()], items)
    assert {(18, 1), (18, 2), (17, 6)} <= want
    for block in (20_000, 3):
        assert {(r.doc_id, r.item_id) for r in find_leaks(edge_docs, benchmark, block=block).collect()} == want
    kept = drop_leaks(edge_docs, benchmark, block=3)
    assert kept.columns == edge_docs.columns
    assert kept.count() == edge_docs.count() - sum(r[0] in {w[0] for w in want} for r in edge_rows())
    assert find_leaks(no_docs, benchmark).count() == 0
    assert drop_leaks(edge_docs, benchmark.limit(0)).count() == edge_docs.count()
    assert find_leaks(edge_docs, benchmark.limit(0)).count() == 0


def test_words_encode_as_the_library_does(edge_docs, no_docs, vocab):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocab("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = encode_digests(edge_docs, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    full = encode_texts(edge_docs, path).collect()
    assert sorted((r.doc_id or 0, len(r.ids), digest(" ".join(map(str, r.ids))), digest(r.decoded)) for r in full) == sorted(want)
    assert encode_digests(no_docs, path).count() == 0


def test_long_words_merge_like_short_ones(vocab):
    bpe = WordBpe(vocab("word_bpe_49k.json"))
    for word in ("internationalisation" * 12, "aaaaaaaab" * 25, "xyzzy" * 40):
        assert bpe._merge_long(word + bpe.end, len(word)) == bpe.merge(word)
    assert bpe.encode("ab" * 50_000)[0] > 0


def test_token_files_read_back(edge_docs, no_docs, vocab):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocab("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = sorted(((r[0], r[1]) for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_digests(edge_docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start, tally = 0, Counter()
    for r in got:
        assert r.start == start
        start += r.n_tokens
        tally[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert tally == want
    assert token_digests(no_docs, path).count() == 0


def test_shards_are_indexed_and_checked(edge_docs, vocab, tmp_path):
    manifest = write_token_files(edge_docs.where("doc_id = 4"), vocab("byte_bpe_50k.json"), f"file://{tmp_path}")
    row = manifest.first()
    payload = record_at(row.file, 0)
    assert struct.unpack_from("<Bq", payload) == (0, 4) and (len(payload) - 9) // row.width == row.n_tokens
    place = row.file.removeprefix("file://") + ".rec"
    data = bytearray(open(place, "rb").read())
    assert bytes(data) == frame(payload) and masked(b"a") != zlib.crc32(b"a")
    data[20] ^= 1
    with open(f"{tmp_path}/broken", "wb") as file:
        file.write(data)
    with open(f"{tmp_path}/broken", "rb") as file, pytest.raises(ValueError):
        list(records(file))
    assert read_token_files(manifest).count() == 1


def test_ids_read_back_stay_in_their_task(edge_docs, vocab):
    plan = token_digests(edge_docs, vocab("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ids#" not in plan


def test_words_between_spaces_encode_as_the_library_does(vocab):
    path = vocab("byte_bpe_50k.json")
    encoder = PieceEncoder(path)
    rng = random.Random(5)
    parts = [*"    aéßʰ1٣½ª,.!'-_\x00\x1c\x85\xa0\u0301\u200b\u3000😀", "  ", "\n", "\t", "\r\n", " \n", "word", "The", "日本", "'s", "'ll", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert encoder.encode(text) == encoder.whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_strings_are_encoded_and_not_remembered(vocab):
    encoder = PieceEncoder(vocab("byte_bpe_50k.json"))
    for text in ("x" * 50_000, "say " + "ab1" * 9_000, "-" * 30_000 + " end", "a b" + "\n" * 20_000, "日本" * 9_000):
        assert encoder.encode(text) == encoder.whole.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*encoder.words, *encoder.pieces])) <= 64


def test_shards_that_differ_from_their_index_are_refused(edge_docs, vocab, tmp_path):
    manifest = write_token_files(edge_docs.where("doc_id in (4, 5)").coalesce(1), vocab("byte_bpe_50k.json"), f"file://{tmp_path}")
    rows = [r.asDict() for r in manifest.collect()]
    batch = pa.RecordBatch.from_pylist(rows)
    assert sum(b.num_rows for b in _read_shards([batch])) == 2
    place = rows[0]["file"].removeprefix("file://") + ".idx"
    whole = open(place, "rb").read()
    for changed in (whole[:-16], whole + whole[-16:]):
        with open(place, "wb") as file:
            file.write(changed)
        with pytest.raises(ValueError):
            list(_read_shards([batch]))


def test_escapes_are_reversible():
    for text in ("<|im_end|>", r"<\|x", r"<\\|", "<<||>", "a\nb", "\\", r"\n", "<|" * 5, ""):
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def test_chats_read_back(spark, vocab):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "system", None), (1, 2, "assistant", "b <\\|im_end|> é😀"), (1, 1, "user", ""),
        (2, 0, None, "x"), (2, 0, "user", "x"), (3, None, "assistant", "n"), (None, 0, "assistant", "<|endoftext|>"), (4, 0, "u\nser\\n", "t"),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat_digests(turns, vocab("byte_bpe_50k.json")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(own), sha(text))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha(loss))
    assert got[-1].formatted_chars == 2 * len("<|im_start|>\n<|im_end|>\n") + len("userassistant") + 2 * (len(said) + 2)
    assert chat_digests(turns.limit(0), vocab("byte_bpe_50k.json")).count() == 0


PAGES = [
    ("<nav><a>x</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>a  b<br>c<p>d<!-- no --></article><footer>f</footer>", "T & U\na b c\nd"),
    ("<article><aside>s</aside>keep<form>q<input></form><ul><li>1<li>2</ul><section class=comments>z</section></article>", "keep\n1\n2"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Hi<script>var t='</p>'</script> there</main>", "Hi there"),
    ("<div id=menu><a>x</a><a>y</a></div><div><p>" + "long text " * 30 + "</div><div class=comments>c</div>", ("long text " * 30).strip()),
    ("plain", "plain"), ("", ""), (None, ""), ("<div class=ad>open<article><p>in", "in"), ("<p>a<p>b</div></p>&#233;&nbsp;x", "a\nb\né x"),
]


def test_main_text(spark):
    for html, text in PAGES:
        assert main_text(html or "") == text
    pages = spark.createDataFrame([(k, "u", h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert extract_pages(pages.limit(0)).count() == 0


def test_regions_decide_with_and_without_article():
    prose_ = [(f"p{k} " + "long text here " * 20).strip() for k in range(3)]
    items = [f"entry {k:02d}" for k in range(10)]
    body = "<h2>Head</h2>" + "".join(f"<p>{p}</p>" for p in prose_) + "<h3>List</h3><ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    whole = "\n".join(["Head", *prose_, "List", *items])
    menu = "<div><ul>" + "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(12)) + "</ul></div>"
    # headings and lists stay with their text in a block of any kind, or in none; menus without a name go
    for page in (f"<div>{body}</div>", f"<section>{body}</section>", body, f"<article>{body}</article>", f"<main><div>{body}</div></main>"):
        assert main_text(page) == whole
        assert main_text(menu + page + menu) == whole
    # text outside an article is judged by the same regions, and an article that none reaches is no content
    card = "<article><h3><a href=/x>Card</a></h3></article>"
    assert main_text(card + menu + f"<div>{body}</div>" + menu + card) == whole
    # a link that is left open ends with its element
    assert main_text(f"<div><p><a href=/x>{prose_[0]}</p><p>{prose_[1]}</p><ul><li>one<li>two</ul></div>") == "\n".join([*prose_[:2], "one", "two"])


def test_decoded_digest_comes_from_the_ids(vocab):
    bpe = WordBpe(vocab("word_bpe_49k.json"))
    ids = [int(x) for x in bpe.encode("one two three")[1].split()]
    bpe.names[ids[-1]] = "other"
    want = " ".join([*(bpe.names[i] for i in ids[:-1]), "other"])
    assert row_digests(bpe, "one two three")[2] == hashlib.sha256(want.encode()).hexdigest()


def test_pieces_between_spaces_are_cut_once_and_encode_as_the_library_does(vocab):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocab("word_bpe_49k.json")
    library, bpe = tokenizers.Tokenizer.from_file(path), WordBpe(path)
    calls, find = [], bpe.find
    bpe.find = lambda piece: calls.append(piece) or find(piece)
    odd = [chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0xFEFF)]
    texts = ["It's the dog's, they'LL go", " a  b\n\nc\td ", "x" * 700 + "'s 's '", "<|endoftext|>a b<|startoftext|> <|endoftext|", *(f"one{c}'s{c}{c}2two {c} é{c}" for c in odd)]
    for text in [*texts, *texts]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_ids(text) == ids
        assert bpe.encode(text)[:2] == (len(ids), " ".join(map(str, ids)))
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
    short = [c for c in calls if len(c) <= 256]
    assert len(short) == len(set(short)) and not any(" " in c for c in calls)
