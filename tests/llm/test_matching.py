import collections
import gc
import hashlib
import random
import re
import weakref

import numpy as np
import pytest

from pyspark.sql import functions as F

from geomill.llm import decontaminate, line_dedup, ngram_join, quality_cnn, quality_rules, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _hits(docs, items, size=10):
    windows = collections.defaultdict(set)
    for i, text in items:
        w = _words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, 300])
def test_decontamination_is_brute_force(docs, items, odd, spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    extra = spark.createDataFrame([(900, "passage3 shared passage4 SHARED"), (901, None), (902, "  "), (903, "one two three")], "item_id long, text string")
    every = items.select("item_id", "text").unionByName(extra.selectExpr(f"cast(item_id as {dict(items.dtypes)['item_id']}) as item_id", "text"))
    for df in (docs, odd):
        got = sorted(map(tuple, decontaminate.digest(decontaminate.find_items(df, every)).collect()), key=str)
        assert got == _hits([(r.doc_id, r.text) for r in df.collect()], [tuple(r) for r in every.collect()])


def test_blocks_are_held_one_at_a_time(docs, items, spark, monkeypatch):
    alive, most, made = weakref.WeakSet(), [0], [0]

    begin = decontaminate.Phrases.__init__

    def counted(self, *args):
        gc.collect()
        most[0], made[0] = max(most[0], len(alive) + 1), made[0] + 1
        alive.add(self)
        begin(self, *args)

    texts = items.select("item_id", "text").limit(30).collect()
    few = spark.createDataFrame(texts, items.select("item_id", "text").schema).coalesce(1)
    want = sorted(map(tuple, decontaminate.digest(decontaminate.find_items(docs, few)).collect()), key=str)
    monkeypatch.setattr(decontaminate.Phrases, "__init__", counted)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (sum(len(r.text.encode()) for r in texts) // 3 + 1,))
    got = decontaminate.digest(decontaminate.find_items(docs, few))
    assert (made[0], most[0]) == (3, 1)
    assert sorted(map(tuple, got.collect()), key=str) == want
    with pytest.raises(ValueError, match="distinct words"):
        decontaminate.vocabulary(items, "text", 10)


def test_decontamination_of_nothing(docs, items, none):
    assert decontaminate.find_items(none, items).count() == 0
    rows = decontaminate.digest(decontaminate.find_items(docs, items.limit(0))).collect()
    assert len(rows) == docs.count() and not any(r.contaminated for r in rows)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x gamma y alpha beta z"), (2, "alpha beta q q q q q q gamma"), (3, "alpha gamma")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: [(s.first, s.end) for s in r.spans] for r in decontaminate.find_items(df, item, slop=2).collect()}
    assert got == {1: [(1, 5)], 2: [], 3: []}
    assert not any(r.spans for r in decontaminate.find_items(df, item).collect())


def test_clean_keeps_columns_and_clean_rows(odd, spark):
    item = spark.createDataFrame([(1, " ".join(f"passage{i} shared" for i in range(3, 9)))], "item_id long, text string")
    kept = decontaminate.clean(odd, item)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (5, 6, 7))


def _near(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    least = {g: min((v for v in ids if v is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], least[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(n)), key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_join_is_brute_force(docs, odd, spark, block):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(1000 + i, " ".join(w if rng.random() > 0.012 else "edit" + str(rng.randrange(99)) for w in base)) for i in range(25)]
    near = spark.createDataFrame(rows, "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id is not null").selectExpr("doc_id + 5000 as doc_id", "text")).unionByName(near)
    got = sorted(map(tuple, ngram_join.near_duplicates(df, block=block).collect()), key=str)
    assert got == _near([tuple(r) for r in df.collect()])


def test_join_of_small_blocks(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    rows = [(i, " ".join(w if rng.random() > rng.choice((0.01, 0.05)) else "edit" + str(rng.randrange(99)) for w in base[i % 4])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"meet": 3}, {"meet": 16, "block_bytes": 5000}):
        got = sorted(map(tuple, ngram_join.near_duplicates(df, **options).collect()), key=str)
        assert got == _near(rows)


def test_texts_that_only_share_a_band_are_not_compared(spark):
    """A chain of texts of which each shares a third of the next one's shingles: bands collide, no pair is left."""
    words = [f"w{i}" for i in range(12 * 1201 + 24)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 24])) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"threshold": 0.8, "k": 1, "rows": ngram_join.ROWS, "bands": ngram_join.BANDS, "tolerance": ngram_join.TOLERANCE, "step": ngram_join.STEP, "meet": ngram_join.MEET, "text_col": "text"}
    _, sets, near = ngram_join.class_sets(df, **options)
    assert sets.count() == 1200 and near.count() == 0
    assert not any(r.n_links for r in ngram_join.near_duplicates(df, k=1).collect())


def test_equal_hashes_are_not_equal_bytes(spark):
    """Thue-Morse strings and their complements, which collide under any polynomial modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a}\n{b}"), (2, " ".join([a, "one", "two", "three", "four", "five"])), (3, " ".join([b, "one", "two", "three", "four", "five"])), (4, a + "c"), (5, b + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = {r.doc_id: r for r in quality_rules.judge(df, quality_rules.train(np.zeros((0, len(quality_rules.FEATURES)), bool), np.zeros(0, np.int64), np.zeros(0, np.int64))).collect()}
    assert rules[1].n_dup_lines == 0 and rules[1].n_repeat_words == 0
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str) == _near(rows)
    assert sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()), key=str) == _cut(rows)


def test_columns_of_any_name(spark):
    """Columns named like the ones that the operators use inside."""
    names = ["key", "__key", "row", "row_key", "id", "begins", "ends", "gone", "k", "segment", "text_key", "runs"]
    df = spark.createDataFrame([(i, f"some words of text number {i % 2} that are more than ten words long", *["x"] * len(names)) for i in range(4)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    item = spark.createDataFrame([(1, "some words of text number 1 that are more than ten words")], "item_id long, text string")
    net = quality_cnn.train([np.frombuffer(b"some text", np.uint8)] * 4, np.array([1, 1, 1, 1]))
    for kept, n in ((ngram_join.one_of_each(df), 2), (suffix_dedup.without_repeats(df), 4), (decontaminate.clean(df, item), 2), (quality_cnn.accepted(df, net, threshold=0.0), 4)):
        assert kept.columns == df.columns and kept.count() == n
        assert all(r.key == r.gone == r.ends == "x" for r in kept.collect())
    assert line_dedup.without_repeated_units(df, min_words=5).count() == 4


def test_join_keeps_one_of_each(odd, none):
    rows = ngram_join.one_of_each(odd)
    assert rows.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in rows.collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 8, 9, 11, 12, None]))  # 6 and 7 are near or exact copies of 5, 10 of 9
    assert ngram_join.one_of_each(none).count() == 0 and ngram_join.near_duplicates(none).count() == 0


def test_posterior_tolerance():
    least = ngram_join.least_matches(78, 13, 0.8, 1e-7)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 78
    rng = np.random.default_rng(0)
    m = rng.binomial(13, 0.8, (200_000, 6)).cumsum(axis=1)
    assert (m >= np.array(least)).all()


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)])
    s = ngram_join.minhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def _cut(rows, length=200):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"most_runs": 1}, {"bucket_bytes": 3000}])
def test_repeats_are_brute_force(docs, odd, options):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(df, **options)).collect()), key=str)
    assert got == _cut([tuple(r) for r in df.collect()])


def test_copies_send_their_runs_once(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    text = " ".join(words)
    words[100] = "variant"
    held, by_array = [], suffix_dedup._by_array
    monkeypatch.setattr(suffix_dedup, "_by_array", lambda df, *a: held.append(df) or by_array(df, *a))
    df = spark.range(3001).selectExpr("id AS doc_id").withColumn("text", F.when(F.col("doc_id") == 3000, F.lit(" ".join(words))).otherwise(F.lit(text)))
    rows = suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()
    assert sorted({tuple(r)[1:] for r in rows}) == sorted({r[1:] for r in _cut([(0, text), (1, text), (2, " ".join(words))])})
    runs = held[0].collect()
    assert 0 < len(runs) == len({(r.anchor, r.name) for r in runs}) < 20


@pytest.mark.parametrize("most_runs", [1, 3, 8000])
def test_very_frequent_anchors(spark, most_runs):
    """Many differing surroundings of one passage, some of them repeated."""
    rng = random.Random(7)
    core = "".join(rng.choice("abcdefgh") for _ in range(90))
    near = ["".join(rng.choice("xy") for _ in range(n)) for n in (5, 20, 40, 70, 100, 140, 200) for _ in range(3)]
    rows = [(i, rng.choice(near) + core + rng.choice(near)) for i in range(60)] + [(100, (core + "z" * 30) * 9), (101, core * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(df, most_runs=most_runs)).collect()), key=str)
    assert got == _cut(rows)


def test_repeats_of_odd_rows(odd, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    rows = suffix_dedup.without_repeats(odd)
    assert rows.columns == odd.columns and rows.count() == odd.count()


def test_suffix_array_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(40):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(40, 400)))
        data += data[5:60] + b"xyz" + data[:30]
        starts = np.array(sorted(rng.sample(range(len(data) - 11), (len(data) - 12) // 2)))
        seen = collections.Counter(data[p : p + 12] for p in starts)
        assert suffix_dedup.repeated(np.frombuffer(data, np.uint8), starts, 12).tolist() == [seen[data[p : p + 12]] > 1 for p in starts]


def test_line_dedup_keeps_the_first(odd, spark, none):
    line = "this line of more than five words repeats"
    df = spark.createDataFrame([(2, f"{line}\nshort\nother words are here and stay"), (1, f"short\n  This LINE of more than  five words repeats\n{line}"), (3, None), (None, f"{line}\nx")], "doc_id long, text string")
    for name in ("line", "sentence"):
        rows = {r.doc_id: r for r in line_dedup.without_repeated_units(df, name, 5).collect()}
        assert rows[None].kept == f"{line}\nx"
        assert rows[1].kept == "short" and len(rows[1].removed) == (2 if name == "line" else 3)
        assert rows[2].kept == "short\nother words are here and stay"
        assert [(s.begin, s.end) for s in rows[2].kept_units] == [(len(line) + 1, len(line) + 6), (len(line) + 7, len(line) + 36)]
        assert rows[3].kept == "" and rows[3].n_units == 0
    # One word is enough where the caller says so.
    rows = {r.doc_id: r for r in line_dedup.without_repeated_units(df, "line", 1).collect()}
    assert rows[1].kept == "short" and rows[2].kept == "other words are here and stay"
    assert line_dedup.without_repeated_units(none).count() == 0
    assert line_dedup.without_repeated_units(odd, unit="paragraph").count() == odd.count()


def test_passages_inside_lines_go_and_short_sentences_stay(spark):
    passage = " ".join("These are %s words of a passage that is longer than one sentence." % w for w in ("the first", "some more", "other", "yet other", "the last"))
    wide = "".join(f"これは{i}番目の長い文章です。" for i in range(40))
    common = "All rights reserved. Les. He went."
    texts = [f"{common}\nsome words before {passage} and some behind\n{common}", f"Another start with that {passage}\n{common}", f"{common} Nothing else is in here.", wide, "前書き。" + wide + "後書き。"]
    long = "".join(f"Sentence {i} of a very long text stands here once. " for i in range(60_000))
    texts += [long + passage + " \n", long[: 2 << 20] + "tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.without_repeated_units(df).collect()}
    assert rows[0].kept == texts[0] and rows[2].kept == texts[2]
    assert rows[1].kept == f"Another start with that\n{common}"
    assert rows[3].kept == wide and rows[4].kept == "前書き。後書き。"
    assert rows[5].kept == long.rstrip() and len(rows[6].kept) < 200
    for i, r in rows.items():
        data = texts[i].encode()
        spans = sorted([*r.removed, *r.kept_units])
        assert len(spans) == r.n_units and b"".join(b"".join(data[a:b].split()) for a, b in spans) == b"".join(data.split())
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_line_dedup_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = line_dedup.digest(line_dedup.without_repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())
