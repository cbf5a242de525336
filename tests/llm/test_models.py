import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import quality_cnn, quality_rules, toxicity, url_filter

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.fit(docs, labels, 3, 1)
    rows = quality_cnn.score(docs, net, 3, 1).join(labels, "doc_id").filter("held_out").collect()
    wrong = [r for r in rows if r.predicted != r.quality]
    assert len(rows) > 100 and len(wrong) <= 0.03 * len(rows)
    alone = {r.doc_id: r.score for r in quality_cnn.score(docs.limit(5).repartition(5), net, 3, 1).collect()}
    every = {r.doc_id: r.score for r in quality_cnn.score(docs, net, 3, 1).collect()}
    assert all(every[i] == s for i, s in alone.items())
    rows = quality_cnn.score(odd, net, 3, 1).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality_cnn.score(none, net, 3, 1).count() == 0
    assert quality_cnn.accepted(odd, net).columns == odd.columns


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts = [np.frombuffer((b"good words here. " if i % 2 else b"##&& $$ ** ") * int(rng.integers(3, 30)), np.uint8) for i in range(60)]
    y = np.arange(60) % 2
    p = quality_cnn.train(texts, y, epochs=8).score(texts)
    assert ((p >= 0.5) == y).all()


def test_without_labels_scores_are_even(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(odd, labels, 3, 1)
    assert {r.score for r in quality_cnn.score(odd, net, 3, 1).collect()} == {0.5}
    index = toxicity.fit(odd, labels, 5, 0)
    assert {r.score for r in toxicity.score(odd, index, 5, 0).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.1/" + f"{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels, 5, 0)
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), index, 5, 0).join(labels, "doc_id").filter("held_out").collect()
    found = collections.Counter((r.toxic, r.predicted) for r in rows)
    assert found[1, 1] >= 0.85 * (found[1, 1] + found[1, 0]) and found[0, 1] <= 0.01 * (found[0, 1] + found[0, 0])
    rows = toxicity.score(odd, index, 5, 0).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, index, 5, 0).count() == 0


def test_toxicity_learns_from_few_examples(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), toxicity.fit(docs, labels, 5, 0), 5, 0).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert len(toxic) == 6 and {r.lang for r in toxic if r.predicted} == {r.lang for r in toxic} == {"en", "es", "fr"}
    assert sum(r.predicted for r in toxic) >= 5 and not any(r.predicted for r in rows if r.toxic == 0)


def test_every_term_of_label_1_counts(spark):
    texts = [f"common words of text {'a' * (i % 7 + 1)} and {'b' * (i % 11 + 1)}" + (" vile filth" if i % 20 == 0 else "") for i in range(200)]
    rows = spark.createDataFrame([(t + " " + "c" * i, int("vile" in t)) for i, t in enumerate(texts)], "text string, label int")
    words = {w: n for w, n, _ in toxicity.vocabulary(rows, 10, 190)}
    assert words["vile"] == words["filth"] == 10 and "common" not in words
    few = rows.filter("label = 0").unionByName(rows.filter("label = 1").limit(1))
    assert {"vile", "filth"} <= {w for w, _, _ in toxicity.vocabulary(few, 1, 190)}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    words = [(f"w{i}", 5 + i) for i in range(30)]
    examples = []
    for e in range(400):
        own = sorted(rng.choice(30, int(rng.integers(1, 6)), replace=False).tolist())
        examples.append((str(e), int(rng.integers(0, 2)), own, rng.integers(1, 5, len(own)).tolist()))
    ix = toxicity.Index.build(words, 1000, examples)
    dense = np.zeros((400, 30))
    for w, (e, x) in enumerate(ix.postings):
        dense[e, w] = x
    for _ in range(50):
        own = sorted(rng.choice(30, 3, replace=False).tolist())
        counts = rng.integers(1, 4, 3).tolist()
        q = np.zeros(30)
        q[own] = (1 + np.log(counts)) * ix.idf[own]
        q /= np.linalg.norm(q)
        cos = np.round(dense @ q, 12)
        want = sorted(((-c, e) for e, c in enumerate(cos) if c > 0))[:15]
        got = ix.nearest(tuple(own), tuple(counts))
        assert [e for _, e in got] == [e for _, e in want]
        assert np.allclose([s for s, _ in got], [-c for c, _ in want])


def test_rare_and_frequent_terms_search_alike(monkeypatch):
    rng = np.random.default_rng(3)
    words = [(f"w{i}", 2 + i % 50) for i in range(300)]
    examples = []
    for e in range(900):
        own = np.unique((300 * rng.random(12) ** 3).astype(int)).tolist()
        examples.append((str(e), int(e >= 700), own, rng.integers(1, 5, len(own)).tolist()))
    results = []
    for rare in (0, 16, 10**6):  # none, some and all terms in blocks
        monkeypatch.setattr(toxicity, "RARE", rare)
        ix = toxicity.Index.build(words, 1000, examples)
        results.append(ix.others(0, 900))
    assert results[0] == results[1] == results[2]
    dense = np.zeros((900, 300))
    np.add.at(dense, (np.repeat(np.arange(900), np.diff(ix.begin)), ix.term), ix.weight)
    cosine = np.round(dense @ dense.T, 12)
    np.fill_diagonal(cosine, 0)
    for e, found in enumerate(results[1]):
        want = sorted((-c, x) for x, c in enumerate(cosine[e].tolist()) if c > 0)[:15]
        assert np.allclose([-c for c, _ in want], [c for c, _ in found], atol=1e-9) and sum(x != y for (_, x), (_, y) in zip(want, found)) <= 2


class Counted:
    """Blocks that know which of them were asked for."""

    def __init__(self, blocks):
        self.blocks, self.seen = blocks, []

    def __len__(self):
        return len(self.blocks)

    def __getitem__(self, b):
        self.seen.append(b)
        return self.blocks[b]

    def __getattr__(self, name):
        return getattr(self.blocks, name)


def test_search_keeps_to_the_blocks_of_its_kind(monkeypatch):
    """Four vocabularies in turn: a query of one doesn't multiply blocks of the others, and the neighbours are those of plain loops whatever the kinds and the room for rows."""
    rng = np.random.default_rng(4)
    words = [(f"w{i}", 5 + i % 40) for i in range(160)]
    examples, queries = [], []
    for e in range(2048):
        own = np.sort(rng.choice(40, 12, replace=False)) + 40 * (e % 4)
        examples.append((str(e), int(e >= 1800), own.tolist(), rng.integers(1, 5, 12).tolist()))
    examples[77] = ("77", 0, *examples[5][2:])  # a tie
    for _ in range(32):
        queries.append((np.sort(rng.choice(40, 10, replace=False)) + 40, rng.integers(1, 5, 10)))
    bounds, term, count = np.arange(33) * 10, np.concatenate([t for t, _ in queries]), np.concatenate([c for _, c in queries])
    ix = toxicity.Index.build(words, 3000, examples)
    ix._invert()
    ix.blocks = blocks = Counted(ix.blocks)
    found = ix.search(bounds, term, count)
    assert len(blocks.seen) <= len(blocks) // 2
    dense = np.zeros((2048, 160))
    dense[np.repeat(np.arange(2048), 12), ix.term] = ix.weight
    for (t, c), got in zip(queries, found):
        q = np.zeros(160)
        q[t] = (1 + np.log(c)) * ix.idf[t]
        cosine = np.round(dense @ (q / np.linalg.norm(q)), 12)
        want = sorted((-c, e) for e, c in enumerate(cosine.tolist()) if c > 0)[:15]
        assert np.allclose([-c for c, _ in want], [c for c, _ in got], atol=1e-9) and sum(x != y for (_, x), (_, y) in zip(want, got)) <= 2
    others = ix.others(0, 300)
    assert others[5][0] == (1.0, 77) and others[77][0] == (1.0, 5)
    for name, value in (("KINDS", 1), ("CELLS", 0), ("CELLS", 5000), ("TOGETHER", 7)):
        monkeypatch.setattr(toxicity, name, value)
        ix = toxicity.Index.build(words, 3000, examples)
        assert ix.search(bounds, term, count) == found and ix.others(0, 300) == others
        assert sum(b.size for b in ix.blocks) <= toxicity.CELLS


def test_search_with_empty_sides():
    none = toxicity.Index.build([], 0, [])
    assert none.search(np.zeros(3, int), np.zeros(0, int), np.zeros(0, int)) == [[], []] and none.others(0, 0) == []
    one = toxicity.Index.build([("a", 1), ("b", 1)], 2, [("x", 1, [0], [1])])
    assert one.search(np.array([0, 0, 1, 2]), np.array([0, 1]), np.array([1, 1])) == [[], [(1.0, 0)], []]
    assert one.others(0, 1) == [[]]


def test_toxicity_is_brute_force(spark, docs, labels, odd):
    """Terms, ties, weights, cosines and votes in plain loops over the sample."""
    index = toxicity.fit(docs, labels, 5, 0)
    label = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    sample = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5:
            sample[r.text or ""] = (r.doc_id, label[r.doc_id])

    def amounts(text):
        n = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            n.update([w, *("^" + w[:k] for k in (5, 6, 7) if len(w) > k)])
        return {b + mark: k for b, k in n.items() for mark, least in (("", 1), ("#2", 2), ("#4", 4), ("#8", 8)) if k >= least}

    own = {t: amounts(t) for t in sample}
    pos, total = sum(y for _, y in sample.values()), len(sample)
    n1, n0 = collections.Counter(), collections.Counter()
    for t, (_, y) in sample.items():
        (n1 if y else n0).update(own[t].keys())
    weight = {}
    for w, a in n1.items():
        b, c, d = n0[w], pos - a, total - pos - n0[w]
        if a * (total - pos) > b * pos:
            tie = (total * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))) ** 0.5 if c + d else 0
            weight[w] = (math.log((1 + total) / (1 + a + b)) + 1) * tie

    def vector(text):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in amounts(text).items() if weight.get(w)}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    vectors = {t: vector(t) for t in sample}
    for df in (docs, odd):
        for r, text in ((r, r.text or "") for r in toxicity.score(df, index, 5, 0).join(df.select("doc_id", "text"), "doc_id").collect()):
            v = vector(text)
            cosine = sorted(((sum(x * u.get(w, 0) for w, x in v.items()), *sample[t]) for t, u in vectors.items()), reverse=True)
            found = [c for c in cosine if c[0] > 0][:15]
            if not found:
                assert not r.voters and r.score == index.bare
                continue
            assert np.allclose([c for c, *_ in found], [x.cosine for x in r.voters], atol=1e-9)
            if len(found) < 15 or found[-1][0] > cosine[15][0] + 1e-9:
                vote = sum(c for c, _, y in found if y) / sum(c for c, *_ in found)
                a, b = index.curve
                assert r.score == pytest.approx(1 / (1 + math.exp(-(a * vote + b)))) and r.voters[0].id == r.nearest


def test_rules_are_brute_force(docs, labels, odd, none):
    field = quality_rules.fit(docs, labels)
    for df in (docs, odd):
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(r.text or "")
        for r in quality_rules.judge(df, field).collect():
            t = texts[r.doc_id][0]
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), r.doc_id
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none, field).count() == 0


def test_rules_keep_good_documents(docs, labels):
    rows = quality_rules.judge(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 2


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    owner, x, sizes = [], [], []
    for s in range(30):
        n = int(rng.integers(1, 8))
        owner += [s] * n
        sizes.append(n)
    x = rng.random((len(owner), 3))
    field = quality_rules.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    got, at = field.decode(x, np.array(owner)), 0
    for n in sizes:
        s = x[at : at + n] @ field.emit
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(s[i, y[i]] for i in range(n)) + sum(field.move[y[i - 1], y[i]] for i in range(1, n)))
        assert tuple(got[at : at + n]) == best
        at += n


URLS = ["https://www.Example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "https://a.b.com/fr/x", "https://b.com/de/x", "ftp://com/de/", None, "no url", "http://net", "http://x.net?q=1/es/", "://com/fr/"]


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").withColumn("html", F.lit(None).cast("string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rounds=2).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block") and got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block") and got[5] == ("com", "/de/", "com/de/", "block")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("net", "", None, "allow") and got[9] == ("x.net", "", None, "allow")
    assert got[10] == ("com", "/fr/", "com/fr/", "allow")
    assert url_filter.judge(df.limit(0), rounds=1).count() == 0


def test_links_and_ranks(spark):
    html = '<a href="//b.net/x"><A HREF=http://c.net/y?z>q</a><a href=\'/own\'><a href="mailto:x@y.z">'
    df = spark.createDataFrame([(1, "http://a.com/fr/", html), (2, "http://a.com/fr/2", '<a href="https://B.net">'), (3, "http://b.net", '<a href="http://d.net/">'), (4, "http://e.net", '<a href="http://bad.com">'), (5, "http://bad.com/de/", "")], "page_id int, url string, html string")
    links = {(r.src, r.dst): r.n for r in url_filter.links(df).collect()}
    assert links == {("a.com", "b.net"): 2, ("a.com", "c.net"): 1, ("a.com", "a.com"): 1, ("b.net", "d.net"): 1, ("e.net", "bad.com"): 1}
    rows = {r.host: r for r in url_filter.judge(df).collect()}
    hosts = ["a.com", "b.net", "c.net", "d.net", "e.net", "bad.com"]
    at = {h: i for i, h in enumerate(hosts)}

    def rank(pairs, seed):
        m = np.zeros((6, 6))
        for (s, d), n in pairs.items():
            m[at[d], at[s]] += n
        for j in range(6):
            if not m[:, j].any():
                m[j, j] = 1
        m /= m.sum(axis=0)
        start = np.eye(6)[at[seed]]
        r = start.copy()
        for _ in range(url_filter.ROUNDS):
            r = 0.85 * m @ r + 0.15 * start
        return r

    trust, distrust = rank(links, "a.com"), rank({(d, s): n for (s, d), n in links.items()}, "bad.com")
    for h, r in rows.items():
        assert r.trust == pytest.approx(trust[at[h]]) and r.distrust == pytest.approx(distrust[at[h]])
    assert rows["e.net"].verdict == "block" and rows["b.net"].verdict == "allow"


def test_far_hosts_and_many_seeds(spark):
    chain = [(i, f"http://h{i}.net", f'<a href="http://h{i + 1}.net">') for i in range(30)] + [(30, "http://h30.net", '<a href="http://bad.com">'), (31, "http://bad.com/de/", "")]
    seeds = spark.range(100, 100_100).selectExpr("id AS page_id", "concat('http://s', id, '.com/de/') AS url", "'' AS html")
    df = spark.createDataFrame(chain, "page_id long, url string, html string").unionByName(seeds).coalesce(4)
    rows = {r.host: r for r in url_filter.judge(df).filter("page_id < 100").collect()}
    assert all(r.verdict == "block" for r in rows.values())
    # The walk's fixed point: a host n links before the blocked one has 0.85^n of its rank; the last of the chain keeps what comes.
    bad = 0.15 / 100_001
    for i in range(31):
        want = bad * 0.85 ** (31 - i) / (0.15 if i == 0 else 1)
        assert abs(rows[f"h{i}.net"].distrust - want) <= 1e-6 * want


def test_url_filter_of_odd_rows(spark):
    """Repeated rows, null ids and columns named like the result's."""
    rows = [(1, "http://a.com/fr/", "<a href='//b.net'>"), (1, "http://a.com/fr/", "<a href='//b.net'>"), (None, "http://b.net/x", None), (2, None, "<a href='//c.net'>")]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "page_id int, url string, html string, host string, verdict string, rule string, rank int")
    got = sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in url_filter.judge(df).collect())
    assert got == [("1", "a.com", "com/fr/", "allow"), ("1", "a.com", "com/fr/", "allow"), ("2", "", None, "allow"), ("None", "b.net", None, "allow")]
    assert {(r.src, r.dst): r.n for r in url_filter.links(df).collect()} == {("a.com", "b.net"): 2}


def test_url_filter_is_native(spark, sf_dir):
    df = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rounds=1)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
