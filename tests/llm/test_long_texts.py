"""Texts of some MB, the convolutional score by plain loops, and the tables a job leaves."""

import hashlib
import math

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from geomill.llm import byte_bpe, decontaminate, ngram_join, quality_cnn, quality_rules, suffix_dedup, token_count, toxicity, url_filter, workspace


@pytest.fixture(scope="module")
def long(spark):
    prose = "".join(f"Sentence number {i} of a text that goes on for some time.\n" for i in range(50_000))
    solid = hashlib.shake_256(b"x").hexdigest(150_000)
    texts = [(1, prose), (2, solid), (3, prose + "The end."), (4, solid[:1000]), (5, "short")]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(2), dict(texts)


def test_long_texts_are_counted_and_encoded_whole(long):
    df, texts = long
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(df, P.path("piece_bpe_32k.model")).collect()} == {i: len(sp.encode(t)) for i, t in texts.items()}
    codec = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for r in byte_bpe.bpe_round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(lib.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()


def test_long_texts_are_judged_whole(long, spark, docs, labels):
    df, texts = long
    scored = toxicity.score(df, toxicity.fit(docs, labels, 5, 0), 5, 0).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    net = quality_cnn.train([np.frombuffer(t.encode(), np.uint8) for t in ("good words here. " * 9, "##&& $$ ** " * 9) * 8], np.array([1, 0] * 8), epochs=3)
    assert all(0 <= r.score <= 1 for r in quality_cnn.score(df, net, 3, 1).collect())
    rules = {r.doc_id: r for r in quality_rules.judge(df, quality_rules.fit(docs, labels)).collect()}
    assert rules[1].n_words == 600_000 and rules[2].word_chars == 300_000 and rules[1].n_dup_lines == 0
    item = spark.createDataFrame([(1, "Sentence number 49999 of a text that goes on for some time")], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.find_items(df, item)).collect()}
    assert hits[1] == hits[3] == 12 and hits[2] == 0
    html = "<a href='http://b.net/'>" * 100_000 + "x" * 1_000_000
    pages = spark.createDataFrame([(1, "http://a.com/fr/" + "y" * 500_000, html), (None, "http://b.net", None)], "page_id long, url string, html string")
    assert {r.host: r.verdict for r in url_filter.judge(pages).collect()} == {"a.com": "allow", "b.net": "allow"}


def test_long_texts_are_compared_whole(long):
    df, texts = long
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0), 5: (5, 0)}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert kept[1] == b"" and kept[3] in (b"The end.", b"\nThe end.") and kept[2] == texts[2][1000:].encode() and kept[4] == b"" and kept[5] == b"short"


def _score(net, text):
    """Filters, blocks, chunks and pooling in plain loops."""
    width, n = quality_cnn.WIDTH, -(-(len(text) + quality_cnn.PAD) // quality_cnn.BLOCK)
    data = [0] * width + list(text) + [0] * (n * quality_cnn.BLOCK - len(text))
    sym = [b + 256 * bool(b and i + 3 < len(data) and any(i >= k and data[i : i + 4] == data[i - k : i - k + 4] for k in range(2, 17))) for i, b in enumerate(data)]
    k = quality_cnn.FILTERS
    response = [[sum(float(net.filters[w][sym[i + w]][f]) for w in range(width)) for f in range(k)] for i in range(n * quality_cnn.BLOCK)]
    blocks = [[max(r[f] for r in response[b * quality_cnn.BLOCK : (b + 1) * quality_cnn.BLOCK]) for f in range(k)] for b in range(n)]
    chunks, first = [], 0
    while True:
        own = blocks[first : first + quality_cnn.CHUNK]
        chunks.append([math.tanh(max(b[f] for b in own) + float(net.bias[f])) for f in range(k)])
        if first + quality_cnn.CHUNK >= n:
            break
        first += quality_cnn.STRIDE
    x = [sum(c[f] for c in chunks) / len(chunks) for f in range(k)] + [max(c[f] for c in chunks) for f in range(k)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, net.weights.tolist())) + net.offset)))


def test_score_is_brute_force(docs, labels):
    net = quality_cnn.fit(docs, labels, 3, 1)
    rows = [r for r in docs.orderBy("doc_id").limit(40).collect() if r.text and len(r.text) < 3000]
    got = net.score([np.frombuffer(r.text.encode(), np.uint8) for r in rows])
    assert len(rows) > 15 and got == pytest.approx([_score(net, r.text.encode()) for r in rows], abs=1e-4)


def test_a_job_deletes_its_own_tables(spark, tmp_path):
    before = workspace.clear(spark)
    kept = workspace.written(spark.range(3))
    workspace.written(spark.range(4))
    assert before >= 0 and kept.count() == 3 and workspace.clear(spark) == 2 and workspace.clear(spark) == 0
