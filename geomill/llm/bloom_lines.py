"""Removal of lines that many documents repeat, with two Bloom filters.

A line's key is the line without white space at both ends, ASCII letters lower-cased. Keys
of at least `min_chars` code points found in at least `min_docs` documents lose all their
lines, except in the document of the largest id that holds them.

Three passes over the texts:

1. Each task sets the bits of its keys in a filter of what was seen once and, where a bit
   comes again, in one of what was seen twice (a key counts once for each text). It sends the
   places of its bits by slices of 65,536 bits; a slice merges as (a | b, aa | bb | a & b),
   in any order. The slices' second filters are put together: that filter never misses a key
   of two texts, and others pass as in a common Bloom filter of the same size.
2. Keys whose bits are all set in the second filter are suspects: only their digests (128
   bits of BLAKE2), with id and line number, are shuffled. They are counted exactly by
   distinct ids, and the largest id is found.
3. Lines to drop are joined to their texts and cut.

The filter has 16 bits for each line that can be long enough, at most `MAX_BITS`: so it
is broadcast with a known bound of 64 MB. Beyond 33 million lines (30 GB have about 150
million) more keys are suspected without need and shuffled, and the result stays the same.

Defined results: null and empty texts are one empty line; texts of any length are cut in one
piece; rows of one id are one document (so repeated rows keep and lose the same lines, and all
rows of the largest id keep theirs); null ids are one document, less than any other; an empty
table gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.line_dedup import LOWER
from geomill.llm.suffix_dedup import text_key
from geomill.llm.text import Piece, pieces, thrifty
from geomill.llm.workspace import written

MIN_CHARS, MIN_DOCS = 40, 5
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bits of a filter: for each line, and at most.
LINE_BITS, MAX_BITS = 16, 1 << 29
SLICE = 1 << 16
#: Digests that a task holds before it sends their bits.
FLUSH = 1 << 20


def long_lines(piece: Piece, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row, number in its text and digest of the key of each line whose key is long enough."""
    data, n = piece.data, len(piece)
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(n), np.searchsorted(piece.offsets, breaks, "right") - 1])
    start = np.concatenate([piece.offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.searchsorted(row, np.arange(n))
    end = np.append(start[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = piece.offsets[row[last] + 1]
    dark = np.flatnonzero(~WHITE[data])
    low, high = np.searchsorted(dark, start), np.searchsorted(dark, end) - 1
    some = np.flatnonzero(low <= high)
    begin, stop = dark[low[some]], dark[high[some]] + 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    long = points[stop] - points[begin] >= min_chars
    some, begin, stop = some[long], begin[long], stop[long]
    view = memoryview(LOWER[data].tobytes())
    digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), stop.tolist())]
    return row[some], some - first[row[some]], digests


def places(digests: list[bytes], bits: int) -> np.ndarray:
    """The two places of each digest in a filter of so many bits, a power of two."""
    half = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return (half & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(docs: DataFrame, text_col: str, min_chars: int) -> int:
    """Size of the filters: a power of two from the number of lines that can have so many characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text)
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n = docs.select(F.least(lines, size / min_chars).alias("n")).agg(F.sum("n")).first()[0] or 0
    return min(MAX_BITS, max(SLICE, 1 << int(LINE_BITS * n).bit_length()))


def _slices(seen: np.ndarray) -> pa.RecordBatch:
    """(slice, once, twice): places within each slice that come at all, and more than once."""
    place, times = np.unique(seen, return_counts=True)
    number = place // SLICE
    lead = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    kinds = []
    for chosen in (np.ones(len(place), bool), times > 1):
        upto = np.append(0, np.cumsum(chosen))[np.append(lead, len(place))]
        kinds.append(pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer((2 * upto).astype(np.int32)), pa.py_buffer((place[chosen] % SLICE).astype("<u2"))]))
    return pa.RecordBatch.from_arrays([pa.array(number[lead], pa.int32()), *kinds], names=["slice", "once", "twice"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter of each slice, from rows sorted by slice; one slice is held at a time."""
    held, times = None, np.zeros(SLICE, np.int64)
    give = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([np.packbits(times > 1, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])
    for batch in batches:
        for number, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if number != held:
                if held is not None:
                    yield give()
                held, times = number, np.zeros(SLICE, np.int64)
            times[np.frombuffer(once, "<u2")] += 1
            times[np.frombuffer(twice, "<u2")] += 1
    if held is not None:
        yield give()


def seen_twice(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS, text_col: str = "text") -> np.ndarray:
    """The filter of keys that two texts hold, as packed bits; at most MAX_BITS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                row, _, digests = long_lines(piece, min_chars)
                if digests:
                    once = list({(r, d): None for r, d in zip(row.tolist(), digests)})
                    held.append(places([d for _, d in once], bits).ravel())
                    n += len(once)
                if n >= FLUSH:
                    yield _slices(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield _slices(np.concatenate(held))

    sent = docs.select(text_col).mapInArrow(thrifty(run), "slice int, once binary, twice binary")
    merged = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(thrifty(_merged), "slice int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _suspects(docs: DataFrame, bits: int, twice: np.ndarray, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, lines, digests): the lines of each text that the second filter knows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(twice.tobytes())
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("digests", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for piece in pieces(batch.column(2)):
                row, line, digests = long_lines(piece, min_chars)
                if not digests:
                    continue
                at = places(digests, bits)
                hit = np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))
                row, line = row[hit], line[hit]
                own = np.unique(row)
                bounds = pa.array(np.append(np.searchsorted(row, own), len(row)), pa.int32())
                part = batch.slice(piece.first, len(piece)).take(pa.array(own))
                lists = [pa.ListArray.from_arrays(bounds, v) for v in (pa.array(line, pa.int32()), pa.array([digests[i] for i in hit.tolist()], pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1), *lists], names=schema.names)

    return docs.select(text_key(text_col).alias("key"), F.col(id_col).alias("id"), text_col).mapInArrow(thrifty(run), schema)


def _gone(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, gone): numbers of the lines that a text loses."""
    bits = filter_bits(docs, text_col, min_chars)
    twice = seen_twice(docs, bits, min_chars, text_col)
    # Written, so that the join shuffles both sides on its own and Spark can split the rows of a very frequent line.
    suspects = written(_suspects(docs, bits, twice, min_chars, id_col, text_col))
    lines = suspects.select("key", "id", F.inline(F.arrays_zip("lines", "digests"))).toDF("key", "id", "line", "digest")
    holder = F.struct("id")
    many = written(lines.groupBy("digest").agg(F.count_distinct(holder).alias("n"), F.max(holder).alias("last")).filter(F.col("n") >= min_docs).select("digest", "last"))
    lost = lines.join(many, "digest").filter(~F.col("id").eqNullSafe(F.col("last.id")))
    return written(lost.groupBy("key", "id").agg(F.collect_set("line").alias("gone")))


def without_frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, dropped, kept) for each row: the number of lines, the numbers of those dropped (from 0), and the other lines joined again."""
    gone = _gone(docs, min_chars, min_docs, id_col, text_col).toDF("k", "i", "gone")
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("key"))
    rows = keyed.join(gone, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left").select("id", "text", F.array_sort("gone").alias("gone"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("dropped", T.ArrayType(T.IntegerType())), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lost = batch.column(1), batch.column(2)
            count = pc.add(pc.count_substring(text, "\n"), 1).cast(pa.int64())
            drop = lost.to_pylist()
            if any(drop):
                out = text.to_pylist()
                for i, numbers in enumerate(drop):
                    if numbers:
                        away = set(numbers)
                        out[i] = "\n".join([s for j, s in enumerate(out[i].split("\n")) if j not in away])
                text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), count, pa.array([d or [] for d in drop], pa.list_(pa.int32())), text.cast(pa.string())], names=schema.names)

    return rows.mapInArrow(thrifty(cut), schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same result in SQL; keys are compared themselves.
ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, text, n, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, text, unnest(s) AS l, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), many AS (
  SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT line.*, many.key IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN many USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
