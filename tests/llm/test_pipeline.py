from collections import Counter

import corpus_pipeline
from pagewright.llm.queries import QUERIES
from pagewright.llm.simhash import shingle_set


def test_stages_work_on_what_the_one_before_kept(spark, edge_docs, no_docs, sf_dir):
    docs, empty = edge_docs, no_docs
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        if name != "encode":
            assert got.columns == docs.columns
        assert got.count() <= docs.count()
        empty = corpus_pipeline.materialize(stage(spark, empty, sf_dir), name)
        assert empty.count() == 0 and empty.columns == got.columns
        docs = got
    ids = Counter(r.doc_id for r in docs.collect())
    # the row without an id comes before 4, its copy
    assert ids[9] == 1 and ids[None] and not {1, 2, 3, 4, 5, 6, 11, 12, 17} & set(ids)


def test_run_leaves_no_exact_and_few_near_copies(spark, sf_dir):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").collect()}
    assert len({texts[i] for i in ids}) == len(ids) > 100
    sets = {i: set(shingle_set(texts[i].encode(), 5).tolist()) for i in ids}
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])]
    assert len(pairs) <= 1


def test_each_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
