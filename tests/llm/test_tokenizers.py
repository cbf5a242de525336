import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from geomill.llm import byte_bpe, token_count

ALPHABET = " aAeEtT\n  \t▁éß漢字😀1290.,<0x41>\x00\r"


def _strings():
    rng = random.Random(0)
    return ["", "   ", " a", "a ", "  a  b ", "\n\n a \n", "<s> hi </s>", "a" * 700, " " * 700, "日本語 テキスト", " ▁▁x", "ab" * 400, "!" * 999] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_counts_equal_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = _strings() + [r.text for r in docs.collect()]
    counter = token_count.Counter(token_count.load(P.path("piece_bpe_32k.model")), limit=500)
    assert counter(texts) == [len(x) for x in sp.encode(texts)]


def test_counts_of_rows(docs, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (docs, odd):
        got = sorted(map(tuple, token_count.token_counts(df, P.path("piece_bpe_32k.model")).collect()), key=str)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in df.collect()), key=str)
        assert got == want
    assert token_count.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


def test_tree_encoding_equals_the_library(docs):
    codec = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in _strings() + [r.text for r in docs.collect()]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert codec.decode(ids, leaf=3) == t.encode()


def test_windows_widen_until_stable():
    codec = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for n in (5, 17, 64, 333, 2000):
        data = (b"ab ba" * n)[: 3 * n]
        for cut in (1, n, 2 * n):
            assert codec.join(codec._merge(data[:cut]), codec._merge(data[cut:])) == codec._merge_long(data)


def test_round_trip_rows(odd, none):
    codec = byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = byte_bpe.bpe_round_trip(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    want = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == want
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert byte_bpe.bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    with pytest.raises(KeyError):
        codec.decode(np.array([10**6], "<u4").tobytes())


def test_memo_tables_are_bounded():
    codec = byte_bpe.TreeCodec(byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, P.PATTERN, limit=50)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    counter = token_count.Counter(token_count.load(P.path("piece_bpe_32k.model")), limit=50)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i in range(30):
        text = " ".join(f"w{i * 31 + j}x" for j in range(40)) + " " + "q" * 500 + str(i)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == lib.encode_ordinary(text)
        assert counter([text]) == [len(sp.encode(text))]
        # Between texts no more than one text's distinct words over the limit, and none of them long.
        for known in (codec.matches, counter.seen):
            assert len(known) <= 100 and all(len(m) <= 64 for m in known)
