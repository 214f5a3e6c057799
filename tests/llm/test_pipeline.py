"""The pipeline's stages on odd rows: columns stay, decisions take effect, the last stage packs all of them."""

import collections

import corpus_pipeline
from orrery.llm import mixing, neardup, quality, suffixdedup
from orrery.llm.shared import materialize

from .helpers import empty_docs, odd_docs, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark):
    stop = "the of and it was on with by "
    shared = words(150, 500)
    rows = [(i, stop + words(60 + i % 50, 100 + i) + (" " + shared if i % 9 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[1][1], "en", "s0", 0) for i in range(20)] + [(200, "# $ % " * 40, "en", "s1", 0), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, ""), "stage")
        assert docs.columns == before.columns, name
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality rules":
            assert ids == set(range(60)) | set(range(100, 120))
            assert ids == {r.doc_id for r in quality.apply_rules(before).where("kept").collect()}
        elif name == "near dedup":
            assert ids == set(range(60)) == {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
        elif name == "suffix dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert not any(shared[:-5] in t for t in texts.values()) and ids == set(range(60))
            assert sum(r.n_removed for r in suffixdedup.substring_report(before).collect()) > 6 * 400
        else:
            want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(before).select("row.doc_id", "size", "taken").collect() if r.taken}
            assert collections.Counter(r.doc_id for r in docs.collect()) == want
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == collections.Counter(r.doc_id for r in docs.collect())


def test_empty_and_odd_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), "").count() == 0, name
        out = stage(spark, odd_docs(spark), "")
        # none of the odd texts has a stop word, so the rules reject them all
        assert (out.count() == 0) == (name == "quality rules"), name
