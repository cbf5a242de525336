"""Jaccard self-join on word shingles with Bayesian candidate pruning.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity
of at least 0.8. Texts with one set of shingles are a class, compared once.

1. Each class has `rows * bands` MinHash values. Classes that agree on a band meet in its
   bucket; with the defaults a pair at the threshold meets nowhere with probability 8e-9,
   and a more similar one with less. Of buckets with the same members one is kept.
2. Inside a bucket the stored MinHash values are compared `step` at a time. With m of n
   equal, the similarity has the posterior Beta(1 + m, 1 + n - m); a pair whose probability
   of reaching the threshold falls below `tolerance` is dropped. Texts that only share a
   band end here: none of their shingles are read again. The task needs only what is
   connected by pairs that stay, so it searches from one class to the others not reached yet,
   and a bucket of near copies costs little more than one comparison a member. Buckets
   of more than `meet` classes are cut into blocks, and each pair of blocks is a group.
3. Classes connected by pairs that stay are verified: a component is cut into blocks of
   bounded bytes, each pair of blocks is one group of a shuffle, and in a group the pairs
   that the MinHash values leave are compared exactly on the shingle sets. So a component of
   any size is spread over many tasks and no pair is ever a row.
4. A group returns its classes' numbers of links and, as pairs, a spanning forest of
   its links: enough for the connected classes, and no more rows than members.

Words are runs of characters other than ASCII white space. Texts of one to four words
have one shingle, all their words.

Defined results: null and empty texts have no shingles, are linked to nothing and are
each their own class; a very long text is a block of its own; repeated rows count as links
of each other; rows with null ids link like others, and the least id of a class is null only
if it has no other; an empty table gives an empty table; extra columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.suffix_dedup import text_key
from geomill.llm.text import mix, pieces, shingles, span_hashes, thrifty, thrifty_group, word_spans
from geomill.llm.workspace import broadcast_if_small, checkpointed, let_go, written

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 3, 26
TOLERANCE, STEP = 1e-7, 13
#: Classes of one block where shingle sets are compared, their bytes, about, and classes of one block where only MinHash values are.
BLOCK, BLOCK_BYTES, MEET = 1024, 4 << 20, 16_384
#: Rows of the left block compared with the right one at a time.
SLAB = 256


def shingle_sets(piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a piece, sorted, with the bounds of the rows."""
    start, end, row = word_spans(piece)
    word = span_hashes(piece.data, start, end)
    h, at = shingles(word, row, k)
    row_of = row[at]
    count = np.bincount(row, minlength=len(piece))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = count[short] > j
            whole[more] = mix(whole[more] * np.uint64(31) + word[first[more] + j])
        h, row_of = np.concatenate([h, whole]), np.concatenate([row_of, short])
    order = np.lexsort((h, row_of))
    h, row_of = h[order], row_of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row_of[1:] != row_of[:-1]))[: len(h)]
    h, row_of = h[new], row_of[new]
    return h, np.searchsorted(row_of, np.arange(len(piece) + 1))


@lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s[:n] | np.uint64(1), s[n:]


def minhash(h: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 32 bits for each row; rows without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    first = bounds[:-1][full]
    mult, add = _seeds(n)
    buf = np.empty(len(h), np.uint64)
    for j in range(n):
        np.multiply(h, mult[j], out=buf)
        buf += add[j]
        buf >>= np.uint64(32)
        out[full, j] = np.minimum.reduceat(buf, first)
    return out


def signatures(docs: DataFrame, text_col: str, k: int, rows: int, bands: int) -> DataFrame:
    """(key, d1, d2, n_shingles, minhash): one row for each text; d1 and d2 are a digest of its set of shingles, minhash the values as bytes."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("minhash", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                h, bounds = shingle_sets(piece, k)
                own = b"".join([hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
                half = np.frombuffer(own, np.int64).reshape(-1, 2)
                sign = minhash(h, bounds, rows * bands)
                columns = [pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), pa.array(np.diff(bounds), pa.int32()), pa.array([r.tobytes() for r in sign], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)).cast(pa.binary()), *columns], names=schema.names)

    return docs.select(text_key(text_col).alias("key"), F.col(text_col)).mapInArrow(thrifty(run), schema)


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the least node that each node of the edges is connected with.

    Large-star and small-star steps alternate until no edge changes; each step is a
    group-by on edges that keeps the degree of nodes low, and is checkpointed.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    e = checkpointed(e)
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Checkpointed, so that the join has its own shuffles and Spark can split the edges of a hub.
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


@lru_cache(maxsize=2)
def least_matches(n: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values the fewest equal ones with P(similarity >= threshold) >= tolerance.

    For a Beta(1 + m, 1 + n - m) posterior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    from math import comb

    out = []
    for seen in range(step, n + 1, step):
        total, m = 0.0, 0
        while m <= seen:
            total += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float, tolerance: float, step: int) -> np.ndarray:
    """Which of the pairs (i of a, j of b) the sizes of the sets and their MinHash values leave."""
    at = np.flatnonzero(np.minimum(size_a[i], size_b[j]) >= threshold * np.maximum(size_a[i], size_b[j]) - 1e-9)
    i, j, equal = i[at], j[at], np.zeros(len(at), np.int32)
    n = a.shape[1]
    for least, low in zip(least_matches(n, step, threshold, tolerance), range(0, n, step)):
        if not len(at):
            break
        equal += (a[i, low : low + step] == b[j, low : low + step]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        at, i, j, equal = at[keep], i[keep], j[keep], equal[keep]
    return at


def connected(sign: np.ndarray, size: np.ndarray, threshold: float, tolerance: float, step: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that survive, found by searching from each class to those not reached yet."""
    rest, edges = np.arange(len(size)), []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = surviving(sign, sign, np.full(len(rest), x), rest, size, size, threshold, tolerance, step)
            if len(hit):
                found = rest[hit].tolist()
                edges += [(x, y) for y in found]
                todo += found
                rest = np.delete(rest, hit)
    return edges


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, a: np.ndarray, b: np.ndarray | None, threshold: float, tolerance: float, step: int) -> np.ndarray:
    """Pairs (i, j) of sets with similarity >= threshold, given their MinHash values; right None compares left with itself, i < j."""
    other, b = (left, a) if right is None else (right, b)
    na, nb = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    out = []
    for top in range(0, len(left), SLAB):
        i = np.repeat(np.arange(top, min(top + SLAB, len(left))), len(other))
        j = np.tile(np.arange(len(other)), min(SLAB, len(left) - top))
        if right is None:
            i, j = i[i < j], j[i < j]
        at = surviving(a, b, i, j, na, nb, threshold, tolerance, step)
        i, j = i[at], j[at]
        if len(i) <= 8:
            both = np.array([len(np.intersect1d(left[x], other[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        else:
            both = _common(left, other, i, j)
        keep = both >= threshold * (na[i] + nb[j] - both) - 1e-9
        out.append(np.stack([i[keep], j[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _common(left: list[np.ndarray], other: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of shingles that the sets of each pair share, from products of 0/1 matrices."""
    li, i = np.unique(i, return_inverse=True)
    lj, j = np.unique(j, return_inverse=True)
    sets = [left[x] for x in li] + [other[y] for y in lj]
    # Shingles of only one set count for no pair.
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[code]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    total = np.zeros((len(li), len(lj)), np.float32)
    width = max(256, (8 << 20) // len(sets))
    for low in range(0, int(column[-1]) + 1, width):
        x, y = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[x:y], column[x:y] - low] = 1
        total += m[: len(li)] @ m[len(li) :].T
    return total[i, j].astype(np.int64)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A subset of the pairs that connects the same nodes without a cycle."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            kept.append(k)
    return pairs[kept]


def _dealt(rows: DataFrame, part: str, seed: str, packs: int) -> DataFrame:
    """Rows with n_blocks and blk as groups (kind, group): parts of one block are packed together, larger ones have a group for each pair (x, y) of blocks."""
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y")))
    dealt = rows.select("*", F.inline(pairs_of))
    alone = F.col("n_blocks") == 1
    return dealt.withColumns({"kind": F.when(alone, F.lit(0)).otherwise(1), "group": F.when(alone, F.pmod(F.xxhash64(part, F.lit(seed)), F.lit(packs))).otherwise(F.xxhash64(part, "x", "y"))}).drop("n_blocks")


def _groups(table: pa.Table, part: str) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(x, y) and the rows of each part of a group."""
    key = np.stack([table.column(c).to_numpy() for c in (part, "x", "y")])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    turn = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    for low, high in zip(turn.tolist(), [*turn[1:].tolist(), len(order)]):
        yield (int(key[1, low]), int(key[2, low])), order[low:high]


def _minhashes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("minhash").to_pylist()), np.uint32).reshape(table.num_rows, -1)


def class_sets(docs: DataFrame, threshold: float, k: int, rows: int, bands: int, tolerance: float, step: int, meet: int, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts' signatures, their classes (set_id, d1, d2, copies, n_shingles, minhash, key), and pairs (a, b) that connect all classes whose MinHash values leave them a chance."""
    signed = written(signatures(docs, text_col, k, rows, bands).filter("n_shingles > 0").withColumn("uid", F.monotonically_increasing_id()))
    sets = written(signed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("set_id"), F.first("n_shingles").alias("n_shingles"), F.first("minhash").alias("minhash"), F.first("key").alias("key")))
    band = lambda j: F.xxhash64(F.substring("minhash", 4 * rows * j + 1, 4 * rows), F.lit(j))
    met = sets.select("set_id", F.explode(F.array(*map(band, range(bands)))).alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("f1"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("f2")).filter("n > 1")
    # Written, so that the join has its own shuffles and Spark can split a bucket that very many classes are in.
    kept = written(buckets.groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    let_go(docs.sparkSession)
    members = kept.agg(F.sum("n")).first()[0] or 0
    n_blocks = F.ceil(F.col("n") / meet).cast("int")
    placed = met.join(kept, "bucket").select("set_id", "bucket", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("set_id", "bucket"), n_blocks).cast("int").alias("blk"))
    dealt = _dealt(placed.join(sets.select("set_id", "n_shingles", "minhash"), "set_id"), "bucket", "pack", members // min(4096, meet) + 1)
    # The blocks of a large bucket meet in pairs of different ones; each pair looks through both.
    dealt = dealt.filter("kind = 0 OR x < y").select("kind", "group", "bucket", "x", "y", "set_id", "n_shingles", "minhash")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(table: pa.Table) -> pa.Table:
        sign, ids, size = _minhashes(table), table.column("set_id").to_numpy(), table.column("n_shingles").to_numpy()
        found, two = [], []
        for _, own in _groups(table, "bucket"):
            if len(own) == 2:
                two.append(own)
            else:
                found += [(own[x], own[y]) for x, y in connected(sign[own], size[own], threshold, tolerance, step)]
        if two:
            pair = np.stack(two)
            found += pair[surviving(sign, sign, pair[:, 0], pair[:, 1], size, size, threshold, tolerance, step)].tolist()
        edge = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(ids[edge[:, 0]]), pa.array(ids[edge[:, 1]])], names=out.names)

    return signed, sets, written(dealt.groupBy("kind", "group").applyInArrow(thrifty_group(search), out))


def links(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, rows: int = ROWS, bands: int = BANDS, tolerance: float = TOLERANCE, step: int = STEP, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, meet: int = MEET, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, set_id, class_id, n_links) for each text, n_links counting rows; second, the linking pairs (a, b) of a spanning forest."""
    spark = docs.sparkSession
    signed, sets, near = class_sets(docs, threshold, k, rows, bands, tolerance, step, meet, text_col)
    let_go(spark)
    part = F.greatest((8 * F.col("n_shingles") + 400) / block_bytes, F.lit(1.0 / block))
    placed = written(components(near).withColumnRenamed("node", "set_id").join(sets.select("set_id", "n_shingles"), "set_id").select("set_id", "component", part.alias("part")))
    per = written(placed.groupBy("component").agg(F.ceil(F.sum("part") - 1e-6).cast("int").alias("n_blocks")))
    packs = int(placed.agg(F.sum("part")).first()[0] or 0) + 1
    member = placed.join(per, "component").select("set_id", "component", "n_blocks", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("n_blocks")).cast("int").alias("blk"))
    wanted = written(member.join(sets.select("set_id", "key", "copies", "minhash"), "set_id"))
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).join(broadcast_if_small(wanted.select("key"), 48), "key", "left_semi").dropDuplicates(["key"])
    dealt = _dealt(_hashed(texts.join(wanted, "key"), k), "component", "pack", packs).select("kind", "group", "component", "x", "y", "blk", "set_id", "copies", "minhash", "shingles")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])

    def compare(table: pa.Table) -> pa.Table:
        blk, ids, copies = (table.column(c).to_numpy() for c in ("blk", "set_id", "copies"))
        sets, sign = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")], _minhashes(table)
        count, tree = np.zeros(len(ids), np.int64), []
        for (x, y), own in _groups(table, "component"):
            left, right = (own, None) if x == y else (own[blk[own] == x], own[blk[own] == y])
            found = linked([sets[r] for r in left], None if right is None else [sets[r] for r in right], sign[left], None if right is None else sign[right], threshold, tolerance, step)
            a, b = left[found[:, 0]], (left if right is None else right)[found[:, 1]]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            if len(a):
                where = np.zeros(len(ids), np.int64)
                where[own] = np.arange(len(own))
                tree.append(own[forest(np.stack([where[a], where[b]], axis=1), len(own))])
        tree = np.concatenate(tree) if tree else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(count)
        return pa.table([pa.array(np.concatenate([ids[some], ids[tree[:, 0]]])), pa.array(np.concatenate([ids[some], ids[tree[:, 1]]])), pa.array(np.concatenate([count[some], np.zeros(len(tree), np.int64)]))], names=out.names)

    found = written(dealt.groupBy("kind", "group").applyInArrow(thrifty_group(compare), out))
    let_go(spark)
    tree = found.filter("a <> b").select("a", "b").distinct()
    joined = components(tree)
    counts = found.filter("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    per_set = sets.select("set_id", "d1", "d2", "copies").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").join(counts.withColumnRenamed("a", "set_id"), "set_id", "left")
    per_set = per_set.select("d1", "d2", "set_id", F.coalesce("component", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_key = signed.select("key", "d1", "d2").dropDuplicates(["key"]).join(per_set, ["d1", "d2"]).drop("d1", "d2")
    return by_key, tree


def _hashed(texts: DataFrame, k: int) -> DataFrame:
    """The rows with their texts replaced by the sorted shingle hashes, as bytes."""
    rest = [c for c in texts.columns if c not in ("text", "key")]
    schema = T.StructType([*(texts.schema[c] for c in rest), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                h, bounds = shingle_sets(piece, k)
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=schema.names)

    return texts.select("text", *rest).mapInArrow(thrifty(run), schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, n_links) for each row: class_id is the least id of the rows connected by links, n_links the number of other rows linked."""
    by_key, _ = links(docs, text_col=text_col, **options)
    rows = docs.select(id_col, text_key(text_col).alias("key")).join(by_key, "key", "left")
    rows = written(rows.select(id_col, F.col("class_id").alias("group"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    # Written, so that Spark can split the rows of a large class.
    least = written(rows.filter("n_links > 0").groupBy("group").agg(F.min(id_col).alias("class_id")))
    return rows.join(least, "group", "left").select(id_col, F.coalesce("class_id", id_col).alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows less near duplicates: of each class the row with the least id stays (of repeated rows, any one); texts without shingles all stay."""
    by_key, _ = links(docs, text_col=text_col, **options)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), text_key(text_col).alias("row_key"))
    rows = written(keyed.select(F.col("row_id").alias("id"), F.col("row_key").alias("key")).join(by_key.select("key", "class_id"), "key"))
    best = written(rows.groupBy("class_id").agg(F.min(F.struct("id", "key")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    grouped = rows.join(best, "class_id")
    is_best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    beaten = grouped.filter(~is_best).select("id", "key").distinct()
    again = grouped.filter(is_best).groupBy("id", "key").count().filter("count > 1").select("id", "key")
    gone = written(beaten.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))))
    match = (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id"))
    small = broadcast_if_small(gone, 80)
    out = keyed.join(small, match, "left_anti").select("row.*")
    again = gone.filter("again")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, match, "left_semi").dropDuplicates(["row_key"]).select("row.*"))
    return out
