import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geomill.llm import bloom_lines, centroid_clusters, merkle, queries
from geomill.llm.text import pieces

WHITE = " \t\n\r\v\f"


@pytest.mark.parametrize("name", ["op9_line_dedup", "op11_centroid_clusters", "op12_bloom_lines", "op13_merkle_manifest"])
def test_queries_match_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    df = queries.QUERIES[name](spark, sf_dir).select(*names)
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


# Clusters


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, n int")


def _lloyd(rows, k, rounds, dims):
    """Every distance by plain integers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in hashed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        member = collections.defaultdict(list)
        for _, v in kept:
            member[near(v)[1]].append(v)
        centroids = [[sum(p) // len(member[i]) for p in zip(*member[i])] if member[i] else c for i, c in enumerate(centroids)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


def test_clusters_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(6)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 6), (400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 7), (404, [None] + [1.0] * 5), (405, [float("nan")] * 6), (406, [float("inf")] * 6), (407, [-1000.0] * 6)]
    df = _vectors(spark, [(i, v, "x", 1) for i, v in rows]).repartition(3)
    found, centroids = centroid_clusters.clusters(df, k=9, rounds=3, dims=6)
    want, at = _lloyd(rows, 9, 3, 6)
    assert centroids.tolist() == at
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    out = centroid_clusters.summary(found, centroids).collect()
    total = sum(d for *_, d in want)
    assert all(r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest() for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact_and_passes_centroids_over(seed):
    rng = np.random.default_rng(seed)
    spread = [1, 40, 3, 1000][seed]
    c = rng.integers(-spread, spread + 1, (50, 8)) + rng.integers(-5 * spread, 5 * spread + 1, (50, 1))
    q = np.concatenate([rng.integers(-spread, spread + 1, (500, 8)) + rng.integers(-5 * spread, 5 * spread + 1, (500, 1)), c])
    number, dist, computed = centroid_clusters.nearest(q, centroid_clusters.by_mean(c))
    every = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert computed < every.size / 2


def test_ties_go_to_the_smaller_number():
    c = np.array([[2, 0], [0, 2], [2, 0], [-1, 3]])
    number, dist, _ = centroid_clusters.nearest(np.array([[0, 0], [1, 1], [2, 0]]), centroid_clusters.by_mean(c))
    assert number.tolist() == [0, 0, 0] and dist.tolist() == [4, 2, 0]


def test_few_and_no_vectors(spark):
    df = _vectors(spark, [(1, [1.0, 2.0], "", 0), (2, [5.0, 5.0], "", 0)])
    found, centroids = centroid_clusters.clusters(df, k=16, dims=2)
    assert len(centroids) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    assert centroid_clusters.summary(*centroid_clusters.clusters(df.limit(0), dims=2)).collect() == []
    with pytest.raises(Exception, match="134217728 or more"):
        centroid_clusters.clusters(_vectors(spark, [(1, [1e30, 0.0], "", 0)]), dims=2)


# Lines


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def _lines(rows, min_chars=40, min_docs=5):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[_key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=rank) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (_key(s) in last and last[_key(s)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


FORTY = "exactly forty code points stand here: ok"
WIDE = "é" * 39 + "日"


def _texts():
    rng = random.Random(5)
    pool = [FORTY, FORTY[:-1], WIDE, WIDE[:-1], "A" + FORTY[1:].upper(), "  " + FORTY + "\t\r", "x" * 200, "", " \t", "short", "Z" * 60, "\x0b" + "z" * 60 + "\x0c", " " + FORTY]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(i, f"unique line of text number {i} which is long enough\n" * 3 + "w" * 50) for i in range(100, 104)]
    return rows + [(None, FORTY), (None, "x" * 200 + "\nmore"), (7, FORTY), (7, FORTY), (200, None), (201, "\n"), (202, FORTY + "\n"), (203, ("no line end " * 50_000 + "\n") * 2 + FORTY)]


@pytest.mark.parametrize("limits", [(40, 5), (1, 2)])
def test_frequent_lines_are_brute_force(spark, odd, limits):
    rows = _texts()
    df = spark.createDataFrame([(i, t, "k", "g", None) for i, t in rows], "doc_id long, text string, key string, gone string, id string").repartition(5)
    got = bloom_lines.digest(bloom_lines.without_frequent_lines(df, *limits))
    assert sorted(map(tuple, got.collect()), key=str) == _lines(rows, *limits)
    got = bloom_lines.digest(bloom_lines.without_frequent_lines(odd, *limits))
    assert sorted(map(tuple, got.collect()), key=str) == _lines([(r.doc_id, r.text) for r in odd.collect()], *limits)


def test_texts_and_numbers_of_lines(spark, none):
    rows = [(i, f"first {i}\n{FORTY}\nlast") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.dropped, r.kept) for r in bloom_lines.without_frequent_lines(df).collect()}
    assert got[4] == ([], rows[4][1]) and got[0] == ([1], "first 0\nlast")
    assert bloom_lines.without_frequent_lines(none).collect() == []


@pytest.mark.parametrize("size", [bloom_lines.SLICE, 4 * bloom_lines.SLICE])
def test_a_full_filter_only_adds_suspects(spark, monkeypatch, size):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(bloom_lines, "MAX_BITS", size)
    monkeypatch.setattr(bloom_lines, "FLUSH", 3)
    assert sorted(map(tuple, bloom_lines.digest(bloom_lines.without_frequent_lines(df)).collect()), key=str) == _lines(rows)
    monkeypatch.setattr(bloom_lines, "seen_twice", lambda docs, bits, *_: np.full(bits // 8, 255, np.uint8))
    assert sorted(map(tuple, bloom_lines.digest(bloom_lines.without_frequent_lines(df)).collect()), key=str) == _lines(rows)


def test_second_filter_holds_what_two_texts_hold(spark):
    both, one = [f"line {i} that two of the texts hold, long enough" for i in range(300)], [f"line {i} that a single text holds, long enough" for i in range(300)]
    texts = [both[i] + "\n" + one[i] + "\n" + one[i] for i in range(300)] + both
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    bits = 1 << 18
    known = bloom_lines.seen_twice(df, bits)

    def held(lines):
        piece = next(pieces(pa.array(["\n".join(lines)])))
        at = bloom_lines.places(bloom_lines.long_lines(piece, 40)[2], bits)
        return (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)

    assert held(both).all() and held(one).mean() < 0.02


# Manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def _manifest(rows):
    """Whole trees in memory. rows: (doc_id, source, lang, n_chars, text)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, _leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = _path(trees[s], i) + _path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = _leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf
            for left, right in path:
                node = _h(*left, node, *right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], _h(*(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, total string, grp string"


def _check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "p", "t", "g") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, merkle.tamper_proof(df, **options).collect()), key=str) == _manifest(rows)


def test_manifest_is_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["src"] * 3 + ["Src", "é", "z", "", None]), rng.choice(["en", None]), i % 7 or None, rng.choice(["Text", "text", "", None, "日本 A\n"]) ) for i in range(700)]
    rows += [(1000, "alone", "en", 1, "One"), (None, None, None, None, None), (None, "src", "en", 3, "Abc"), (7, "src", "en", 3, "Abc"), (7, "src", "en", 3, "Abc"), (7, "src", "en", 3, "abd"), (1001, "long", "en", 1, "Wor d" * 500_000)]
    _check(spark, rows)
    _check(spark, rows[:1])
    _check(spark, [(i, f"s{i:03}", "en", 1, "T") for i in range(300)])
    _check(spark, [(i, "one", "en", 1, "T") for i in (3, 1, 2)])


def test_trees_of_several_checkpoints(spark):
    rows = [(i, "big", "en", 1, f"T{i}") for i in range(4097)] + [(i, f"small{i % 40}", "en", 1, "T") for i in range(5000, 5300)]
    _check(spark, rows, depth=1)
    _check(spark, rows, depth=2)


def test_manifest_of_nothing(spark):
    assert merkle.tamper_proof(spark.createDataFrame([], SCHEMA)).collect() == []


def test_siblings_prove_a_row(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"T{i}") for i in range(100)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    for r in merkle.manifest(df, with_siblings=True).collect():
        assert r.verified and merkle.folded(r.leaf, r.left, r.right) == r.root
        assert _h(*(s for pair in zip(r.left, r.right) for s in pair)) == r.proof_sha256
    other = df.withColumn("text", F.when(F.col("doc_id") == 50, "changed").otherwise(F.col("text")))
    assert merkle.manifest(other).first().root != merkle.manifest(df).first().root
