import hashlib

import corpus_pipeline
from geomill.llm import decontaminate, ngram_join, quality_cnn, suffix_dedup


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns
        seen.append(docs)
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert kept[4] <= kept[3] == kept[2] < kept[1] < kept[0]
    # One document of each class stays, so no links are left.
    assert not any(r.n_links for r in ngram_join.near_duplicates(seen[2]).collect())
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(seen[2]).collect()}
    assert all(r.text == cut[r.doc_id].kept.decode("utf-8", "ignore") for r in seen[3].collect())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.find_items(seen[3], items).collect() if r["items"]}
    assert kept[3] - kept[4] == bad
    out = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).collect()
    text = {r.doc_id: r.text for r in seen[4].collect()}
    assert {r.doc_id for r in out} == kept[4]
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept[4]


def test_quality_stage_is_the_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.fit(docs, labels, 3, 1)
    want = {r.doc_id for r in quality_cnn.score(docs, net, 3, 1).collect() if r.predicted}
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()} == want
