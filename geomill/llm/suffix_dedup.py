"""Removal of repeated byte strings with suffix arrays built by difference cover.

Every string of `length` bytes that starts at least twice in the corpus is removed
wherever it starts. To sort suffixes of a corpus that no task can hold, the text is
first dealt so that equal strings meet:

1. Each window of `length` bytes has an anchor, the gram with the least hash inside
   it. Windows with one anchor form a run; equal windows have equal anchors, so a
   window can repeat only among runs whose anchor occurs twice. The others are done.
2. Equal runs are counted by name (a BLAKE2 hash of their bytes) with map-side combining:
   a run that occurs twice repeats as a whole, however many copies there are.
3. Anchors with differing runs go to buckets of bounded bytes. A bucket's suffix
   array is built by difference cover modulo 3: triples of the sampled positions
   are sorted and named, triples of names are sorted again until names reach the
   length or are unique, the remaining suffixes are sorted by one byte and the next
   name and merged in; neighbours in the array that share `length` bytes repeat.
4. Anchors with more than `most_runs` differing runs would make a bucket as large as
   the corpus allows. Their runs are split and dealt by longer anchors: each window holds
   half of its other bytes before the anchor or behind it, and this half and the anchor
   name it from now on. Equal windows still meet, by step 2 or in a bucket of step 3. An
   anchor that is still too frequent is made longer again, until it is the window.

Defined results: null and empty texts have no bytes; texts shorter than `length` keep
all bytes; texts of any length are read whole; repeated rows each give a row and remove each
other; null ids are kept; an empty table gives an empty table; extra columns are not read,
or stay as they are, whatever their names. Ties need no rule, as all occurrences are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.text import Rolling, pieces, thrifty, thrifty_group
from geomill.llm.workspace import broadcast_if_small, let_go, written

LENGTH, GRAM = 200, 64
#: Bytes of text in one bucket, about; numpy needs some 60 times as much.
BUCKET_BYTES = 1 << 19
#: Bytes of text whose runs a task finds at once, with some 60 bytes of arrays for each.
RUN_BYTES = 1 << 19
#: Differing runs of one anchor that a bucket may hold, about 2 MB of text on top of its own.
MOST_RUNS = 2000


def text_key(text: str) -> Column:
    """The first 16 bytes of a text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)), 1, 16)


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 for each span."""
    view = memoryview(data)
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())]), np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, name, first byte and number of windows of each run of windows with one anchor."""
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty
    rolling = Rolling(data)
    h = rolling.grams(gram)
    # The low half holds the place, so the least hash that stands furthest left wins.
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + length <= offsets[row + 1])
    if not len(at):
        return empty, empty, empty, empty, empty
    anchor, row = anchor[at], row[at]
    turn = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    first, count = at[turn], np.diff(np.append(turn, len(at)))
    name = span_names(data, first, first + count + length - 1)
    return row[turn], h[anchor[turn]].view(np.int64), name, first - offsets[row[turn]], count


def all_runs(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """(key, anchors, names, firsts, counts) of each text with a run."""
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("anchors", longs), T.StructField("names", longs), T.StructField("firsts", ints), T.StructField("counts", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), RUN_BYTES):
                row, anchor, name, first, count = runs(piece.data, piece.offsets, length, gram)
                bounds = pa.array(np.searchsorted(row, np.arange(len(piece) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v, kind)) for v, kind in ((anchor, pa.int64()), (name, pa.int64()), (first, pa.int32()), (count, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)).cast(pa.binary()), *lists], names=schema.names)

    return docs.select(text_key(text_col).alias("key"), text_col).mapInArrow(thrifty(run), schema).filter(F.size("anchors") > 0)


def _rank(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Names from 1 in the order of the keys; equal keys have equal names."""
    held = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(True, held[1:] != held[:-1]))
    return out


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts begin a string of `length` bytes that another start begins too. All have that many bytes."""
    n = len(data)
    flags = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return flags
    padded = np.concatenate([data, np.zeros(length + 16, np.uint8)])
    word = np.zeros(n + length, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : n + length + j].astype(np.uint64)
    sample = np.arange(n)
    sample = sample[sample % 3 != 0]
    # Names of sampled suffixes; 0 stands for all that lies behind the end.
    names = np.zeros(n + 4 * length + 64, np.int64)
    key = word[sample]
    names[sample] = _rank(np.argsort(key), key)
    depth = 8
    while depth < length and names.max() < len(sample):
        step = depth // 3 * 3  # keeps to the sample
        a, b, c = (names[sample + j * step] for j in range(3))
        if names.max() >> 21:
            key = a << 31 | b
            a = _rank(np.argsort(key), key)
            key = a << 31 | c
        else:
            key = a << 42 | b << 21 | c
        names[sample] = _rank(np.argsort(key), key)
        depth += 2 * step
    # Only starts need to be in the array: sampled ones by name, the rest by a byte and the next name, then merged.
    mod = starts % 3
    cover, rest = starts[mod != 0], starts[mod == 0]
    cover = cover[np.argsort(names[cover], kind="stable")]
    one = data[rest].astype(np.int64) << 40 | names[rest + 1]
    rest = rest[np.argsort(one)]
    place = np.zeros(len(rest), np.int64)
    for m in (1, 2):
        own = cover[cover % 3 == m]
        lead = lambda p: p.astype(np.int64)
        if m == 1:
            mine, theirs = (lead(padded[p]) << 40 | names[p + 1] for p in (own, rest))
        else:
            mine, theirs = ((lead(padded[p]) << 8 | lead(padded[p + 1])) << 40 | names[p + 2] for p in (own, rest))
        place += np.searchsorted(mine, theirs)
    at = np.arange(len(rest)) + np.maximum.accumulate(place)
    order = np.empty(len(starts), np.int64)
    free = np.ones(len(starts), bool)
    free[at] = False
    order[at], order[free] = rest, cover
    pair = np.arange(len(order) - 1)
    for j in [*range(0, length - 7, 8), length - 8]:
        pair = pair[word[order[pair] + j] == word[order[pair + 1] + j]]
    twice = np.zeros(n + 1, bool)
    twice[order[pair]] = True
    twice[order[pair + 1]] = True
    return twice[starts]


RUN = "struct<anchor:bigint,name:bigint,first:int,count:int>"


def _cut_out(docs: DataFrame, wanted: DataFrame, text_col: str, length: int, fields: T.StructType, emit) -> DataFrame:
    """Call `emit(anchor, name, bytes)` for the runs listed in `wanted` (key, runs), each taken from one text with that key, of whatever copies."""
    keys = wanted.select("key")
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).join(broadcast_if_small(keys, 48), "key", "left_semi").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(0)[k].as_buffer()
                held = batch.column(1)[k].values
                anchor, name, first, count = (held.field(j).to_pylist() for j in range(4))
                view = memoryview(text)
                out = [emit(a, m, view[f : f + c + length - 1]) for a, m, f, c in zip(anchor, name, first, count)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[j] for o in out]) for j in range(len(fields))], names=fields.names)

    return texts.join(wanted, "key").select(F.col("text").cast("binary"), "runs").mapInArrow(thrifty(run), fields)


HELD = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("name", T.LongType()), T.StructField("bytes", T.BinaryType())])


def _one(anchor: int, name: int, data: memoryview) -> tuple[pa.Array, ...]:
    return pa.array([anchor], pa.int64()), pa.array([name], pa.int64()), pa.array([bytes(data)], pa.binary())


def _by_array(held: DataFrame, buckets: int, length: int) -> DataFrame:
    """(anchor, name, lows, highs): ranges of windows of a run (anchor, name, bytes) that repeat, from the buckets' suffix arrays."""
    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("name", T.LongType()), T.StructField("lows", ints), T.StructField("highs", ints)])

    def bucket(table: pa.Table) -> pa.Table:
        anchor, name = (table.column(c).to_numpy() for c in ("anchor", "name"))
        texts = table.column("bytes").to_pylist()
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        windows = size - length + 1
        starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        flags = repeated(np.frombuffer(b"".join(texts), np.uint8), starts, length)
        run = np.repeat(np.arange(len(texts)), windows)
        low, high = _ranges(flags, run)
        lead = np.cumsum(windows) - windows
        owner = run[low]
        bounds = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v - lead[owner], pa.int32())) for v in (low, high)]
        return pa.table([pa.array(anchor), pa.array(name), *lists], names=out.names)

    dealt = held.withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(thrifty_group(bucket), out).filter(F.size("lows") > 0)


def _ranges(flags: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of set flags within one run."""
    change = np.append(True, run[1:] != run[:-1])
    before = np.append(False, flags[:-1])
    after = np.append(flags[1:], False)
    low = np.flatnonzero(flags & (~before | change))
    high = np.flatnonzero(flags & (~after | np.append(change[1:], True)))
    return low, high


PART = T.StructType([*(T.StructField(c, T.LongType()) for c in ("run_anchor", "run_name")), *(T.StructField(c, T.IntegerType()) for c in ("at", "count", "low", "high")), *HELD.fields])


def halves(at: int, count: int, low: int, high: int, data: memoryview, length: int) -> Iterator[tuple]:
    """(at, count, low, high, anchor, name, bytes) of a run's windows with half of their other bytes before the anchor [low, high), and of the rest.

    `at` counts windows from the start of the first run; low and high count bytes from the first window of `data`.
    """
    other = length - (high - low)
    half = (other + 1) // 2
    before = min(max(low - half + 1, 0), count)  # windows that start so early
    for first, n, a, b in ((0, before, low - half, high), (before, count - before, low, high + other - half + 1)):
        if n:
            own = bytes(data[first : first + n + length - 1])
            names = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in (own[a - first : b - first], own)]
            yield at + first, n, a - first, b - first, *names, own


def _by_longer_anchors(many: DataFrame, gram: int, length: int, bucket_bytes: int, most_runs: int) -> DataFrame:
    """The same for runs (anchor, name, bytes) whose anchors are in very many differing runs: by longer anchors, made longer until no bucket is too large."""

    def shape(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts) if parts else [()] * len(PART), (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary()))], names=PART.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for anchor, name, data in zip(*(batch.column(c).to_pylist() for c in HELD.names)):
                h = Rolling(np.frombuffer(data, np.uint8)).grams(gram).view(np.int64)
                low = int(np.flatnonzero(h == anchor)[0])  # the one furthest left is the anchor of all windows
                parts += [(anchor, name, *p) for p in halves(0, len(data) - length + 1, low, low + gram, memoryview(data), length)]
            yield shape(parts)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for anchor, name, at, count, low, high, data in zip(*(batch.column(c).to_pylist() for c in ("run_anchor", "run_name", "at", "count", "low", "high", "bytes"))):
                parts += [(anchor, name, *p) for p in halves(at, count, low, high, memoryview(data), length)]
            yield shape(parts)

    found, split = [], many.select(*HELD.names).mapInArrow(thrifty(first), PART)
    while True:
        parts = written(split)
        kinds = written(parts.groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("n"), F.first("count").alias("windows")))
        variants = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"))
        whole = kinds.filter("n > 1").select("anchor", "name", F.array(F.lit(0)).alias("lows"), F.array(F.col("windows") - 1).alias("highs"))
        contested = written(parts.dropDuplicates(["anchor", "name"]).join(variants, "anchor"))
        few, many = contested.filter(F.col("variants") <= most_runs), contested.filter(F.col("variants") > most_runs)
        size = few.select(F.sum(F.octet_length("bytes"))).first()[0] or 0
        marks = whole.unionByName(_by_array(few.select(*HELD.names), int(size // bucket_bytes) + 1, length))
        moved = lambda c: F.transform(c, lambda x: x + F.col("at"))
        found.append(written(parts.join(marks, ["anchor", "name"]).select(F.col("run_anchor").alias("anchor"), F.col("run_name").alias("name"), moved("lows").alias("lows"), moved("highs").alias("highs"))))
        if many.isEmpty():
            break
        split = many.mapInArrow(thrifty(again), PART)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, begins, ends): for each text with a repeated string the byte ranges to remove, unmerged."""
    spark = docs.sparkSession
    texts = written(all_runs(docs, text_col, length, gram).withColumn("uid", F.monotonically_increasing_id()))
    every = texts.select("uid", F.inline(F.arrays_zip("anchors", "names", "firsts", "counts"))).toDF("uid", "anchor", "name", "first", "count")
    # Written, so that the join has a shuffle of its own on both sides and Spark can split an anchor that is in very many runs.
    hot = written(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    shared = written(every.join(hot, "anchor"))
    let_go(spark)
    kinds = shared.groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("n"), F.first("uid").alias("uid"), F.first("first").alias("first"), F.first("count").alias("count"))
    kinds = written(kinds)
    variants = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"))
    contested = kinds.join(variants, "anchor").select("uid", "variants", F.struct("anchor", "name", "first", "count").alias("run"))
    listed = written(
        contested.groupBy("uid")
        .agg(F.collect_list(F.when(F.col("variants") <= most_runs, F.col("run"))).alias("few"), F.collect_list(F.when(F.col("variants") > most_runs, F.col("run"))).alias("many"))
        .join(texts.select("uid", "key"), "uid")
    )
    let_go(spark)
    few, many = (listed.filter(F.size(c) > 0).select("key", F.col(c).alias("runs")) for c in ("few", "many"))
    size = few.select(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["count"] + length - 1))).first()[0] or 0
    whole = kinds.filter("n > 1").select("anchor", "name", F.array(F.lit(0)).alias("lows"), F.array(F.col("count") - 1).alias("highs"))
    found = _by_array(_cut_out(docs, few, text_col, length, HELD, _one), int(size // bucket_bytes) + 1, length)
    if not many.isEmpty():
        found = found.unionByName(_by_longer_anchors(_cut_out(docs, many, text_col, length, HELD, _one), gram, length, bucket_bytes, most_runs))
    found = written(found)
    let_go(spark)
    single = found.join(kinds.filter("n = 1").select("anchor", "name"), ["anchor", "name"], "left_semi")
    marks = shared.join(whole.unionByName(single), ["anchor", "name"]).select("uid", "first", F.inline(F.arrays_zip("lows", "highs"))).groupBy("uid").agg(F.collect_list(F.col("first") + F.col("lows")).alias("begins"), F.collect_list(F.col("first") + F.col("highs") + length).alias("ends"))
    return marks.join(texts.select("uid", "key"), "uid").groupBy("key").agg(F.first("begins").alias("begins"), F.first("ends").alias("ends"))


def _cut(docs: DataFrame, marks: DataFrame, text_col: str, schema: T.StructType, shape) -> DataFrame:
    """Join the marks to the rows and hand each batch's rows, merged ranges and kept bytes to `shape`."""
    names = docs.columns
    marks = written(marks.toDF("k", "begins", "ends"))  # so that Spark can split the copies of one text
    joined = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text_key(text_col).alias("key")).join(marks, F.col("key") == F.col("k"), "left").select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)], "begins", "ends")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                part = batch.slice(piece.first, len(piece))
                spans, kept = [], []
                for i in range(len(piece)):
                    text, begins = piece.text(i), part.column(len(names))[i]
                    own = []
                    if begins.is_valid:
                        begin, end = begins.values.to_numpy(), part.column(len(names) + 1)[i].values.to_numpy()
                        by = np.argsort(begin, kind="stable")
                        begin, end = begin[by], np.maximum.accumulate(end[by])
                        lead = np.append(True, begin[1:] > end[:-1])
                        own = list(zip(begin[lead].tolist(), end[np.append(np.flatnonzero(lead)[1:] - 1, len(end) - 1)].tolist()))
                        text = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in own)], [*(b for b, _ in own), len(text)]))
                    spans.append(own)
                    kept.append(text)
                yield shape(part, np.diff(piece.offsets), spans, kept)

    return joined.mapInArrow(thrifty(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_bytes, removed, kept) for each row: merged byte ranges that go, and the bytes that stay."""
    docs = docs.select(id_col, text_col)
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def shape(part: pa.RecordBatch, size: np.ndarray, spans: list, kept: list) -> pa.RecordBatch:
        removed = pa.array([[{"begin": b, "end": e} for b, e in own] for own in spans], kind)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), removed, pa.array(kept, pa.binary())], names=schema.names)

    return _cut(docs, repeats(docs, length, text_col=text_col, **options), text_col, schema, shape)


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", **options) -> DataFrame:
    """The rows with repeated strings cut out of their texts; bytes that no longer form a character go too."""
    at = docs.columns.index(text_col)
    names = docs.columns

    def shape(part: pa.RecordBatch, size: np.ndarray, spans: list, kept: list) -> pa.RecordBatch:
        out = [part.column(i) for i in range(len(names))]
        out[at] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.RecordBatch.from_arrays(out, names=names)

    return _cut(docs, repeats(docs, length, text_col=text_col, **options), text_col, docs.schema, shape)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["begin"]).cast("long"))
    return removed.select(id_col, "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
