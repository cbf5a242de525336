"""Removal of repeated lines or paragraphs by global hashing.

A text is cut into units: lines, paragraphs (at blank lines) or sentences. A sentence
begins on a new line, behind a full stop and at a capital letter, so that a passage put
into the middle of a line has units of its own. A single short unit ("All rights
reserved.") says little, so what is hashed is the shortest run of whole units that
reaches `min_words` words, from each unit on and back from each unit; with
`min_words=1` it is each unit alone. Runs are normalised (ASCII lower case, one space
between words) and hashed.

Digests are counted globally, first by 64 bits with map-side combining; only runs whose
64 bits occur twice meet by all 128. The occurrence with the least (id, unit number) is
kept, and the units of every other one are removed. A unit is removed only because an
earlier one like it exists, so at least one of each stays. Byte offsets of removed and
kept units refer to the original text.

Words are runs of bytes outside [\\x20\\x09-\\x0D] and also end behind the full stops of
scripts without spaces; a word counts once more for each 16 bytes, so such scripts
reach `min_words` too.

Defined results: null and empty texts and texts without words have no units and stay;
texts of any length are cut in one piece; null ids rank first; repeated rows with one id
tie, so they keep and lose the same units; an empty table gives an empty table; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.suffix_dedup import text_key
from geomill.llm.text import Piece, pieces, thrifty, word_spans
from geomill.llm.workspace import written

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Ends of sentences: the last is for scripts without spaces.
STOPS, WIDE_STOPS = ".!?", "。！？"
MIN_WORDS, WORD_BYTES = 40, 16


@lru_cache(maxsize=1)
def _capitals() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Lu" for c in range(0x1F000)])


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at these places of valid UTF-8."""
    byte = lambda j: data[np.minimum(at + j, len(data) - 1)].astype(np.int64)
    b, tail = byte(0), [byte(j) & 0x3F for j in (1, 2, 3)]
    two, three = (b & 0x1F) << 6 | tail[0], (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    return np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, two, three], four)


@dataclass
class Units:
    """Units of the rows of a piece: row, first and last byte, size in words, and place in the normalised buffer."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray
    low: np.ndarray
    high: np.ndarray
    buffer: bytes
    first: np.ndarray  # first unit of each row, and the end


def units(piece: Piece, unit: str) -> Units:
    data = piece.data
    start, end, row = word_spans(piece)
    wide = np.zeros(len(data) + 4, bool)
    for mark in WIDE_STOPS:
        a, b, c = mark.encode()
        wide[: max(0, len(data) - 2)] |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    cuts = np.flatnonzero(wide) + 3
    if len(cuts):
        cuts = cuts[~wide[cuts]]
        inside = np.searchsorted(start, cuts, "left") - 1
        cuts = cuts[(inside >= 0) & (cuts < end[np.maximum(inside, 0)])]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        row = np.searchsorted(piece.offsets, start, "right") - 1
    n = len(start)
    lines = np.append(0, np.cumsum(data == 10))
    opens = np.ones(n, bool)
    if n > 1:
        gap = lines[start[1:]] - lines[end[:-1]]
        if unit == "sentence":
            stop = np.isin(data[end[:-1] - 1], np.frombuffer(STOPS.encode(), np.uint8)) | wide[np.maximum(end[:-1] - 3, 0)]
            code = _code_points(data, start[1:])
            capital = _capitals()[np.minimum(code, 0x1EFFF)] & (code < 0x1F000)
            inner = (gap > 0) | stop | capital
        else:
            inner = gap > {"line": 0, "paragraph": 1}[unit]
        opens[1:] = inner | (row[1:] != row[:-1])
    lead = np.flatnonzero(opens)
    last = np.append(lead[1:], n) - 1 if n else lead
    size = end - start
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    to = np.cumsum(size + 1) - (size + 1)
    skip = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[step + np.repeat(to - skip, size)] = LOWER[data[step + np.repeat(start - skip, size)]]
    words = np.add.reduceat(1 + size // WORD_BYTES, lead) if n else size
    return Units(row[lead], start[lead], end[last], words, to[lead], (to + size)[last], out.tobytes(), np.searchsorted(row[lead], np.arange(len(piece) + 1)))


def unit_runs(u: Units, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and end of the shortest runs of at least min_words words, from each unit and up to each unit, of one row each."""
    upto = np.append(0, np.cumsum(u.words))
    low = np.arange(len(u.row))
    forth = np.searchsorted(upto, upto[low] + min_words)
    back = np.searchsorted(upto, upto[low + 1] - min_words, "right") - 1
    a = np.stack([low, forth], axis=1)[forth <= u.first[u.row + 1]]
    b = np.stack([back, low + 1], axis=1)[back >= u.first[u.row]]
    pair = np.unique(np.concatenate([a, b]), axis=0)
    return pair[:, 0], pair[:, 1]


def _hashed(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """(key, id, lows, highs, h1, h2): the runs of each text with any, by the numbers of their units, and the halves of their digests."""
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("lows", ints), T.StructField("highs", ints), T.StructField("h1", longs), T.StructField("h2", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                u = units(piece, unit)
                low, end = unit_runs(u, min_words)
                view = memoryview(u.buffer)
                digest = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(u.low[low].tolist(), u.high[end - 1].tolist())])
                half = np.frombuffer(digest, "<i8").reshape(-1, 2)
                row = u.row[low]
                bounds = pa.array(np.searchsorted(row, np.arange(len(piece) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v, kind)) for v, kind in ((low - u.first[row], pa.int32()), (end - u.first[row], pa.int32()), (np.ascontiguousarray(half[:, 0]), pa.int64()), (np.ascontiguousarray(half[:, 1]), pa.int64()))]
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1), *lists], names=schema.names)

    return docs.select(text_key(text_col).alias("key"), F.col(id_col).alias("id"), text_col).mapInArrow(thrifty(run), schema).filter(F.size("lows") > 0)


def _gone(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """(key, id, gone): the runs of units, as (low, high), that each text loses."""
    texts = written(_hashed(docs, id_col, text_col, unit, min_words).withColumn("uid", F.monotonically_increasing_id()))
    # Written, so that the joins shuffle both sides on their own and Spark can split a digest with very many runs.
    hot = written(texts.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    every = texts.select("uid", "id", F.inline(F.arrays_zip("lows", "highs", "h1", "h2"))).toDF("uid", "id", "low", "high", "h1", "h2")
    shared = written(every.join(hot, "h1"))
    first = written(shared.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "low")).alias("first")).filter("n > 1"))
    later = shared.join(first, ["h1", "h2"]).filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("low") == F.col("first.low"))))
    marks = later.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    return written(marks.join(texts.select("uid", "key", "id"), "uid").groupBy("key", "id").agg(F.first("gone").alias("gone")))


def without_repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_units, removed, kept_units, kept) for each row: byte ranges of removed and kept units, and the text that stays.

    Kept units stay with the white space before them (after the last one also what follows),
    but the text doesn't begin with the white space behind a removed unit.
    """
    gone = _gone(docs, id_col, text_col, unit, min_words)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("key"))
    rows = keyed.join(gone.toDF("k", "i", "gone"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left").select("id", "text", "gone")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_units", T.LongType()), T.StructField("removed", span), T.StructField("kept_units", span), T.StructField("kept", T.StringType())])

    def spans(u: Units, flags: np.ndarray, base: np.ndarray) -> pa.Array:
        at = np.flatnonzero(flags)
        bounds = pa.array(np.append(0, np.cumsum(flags))[u.first], pa.int32())
        both = [pa.array(v[at] - base[at], pa.int32()) for v in (u.begin, u.end)]
        return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(both, names=["begin", "end"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                part = batch.slice(piece.first, len(piece))
                u = units(piece, unit)
                edge = np.zeros(len(u.row) + 1, np.int64)
                lost = part.column(2)
                for i in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    held = lost[i].values
                    np.add.at(edge, u.first[i] + held.field(0).to_numpy(), 1)
                    np.add.at(edge, u.first[i] + held.field(1).to_numpy(), -1)
                out = np.cumsum(edge[:-1]) > 0
                texts = [piece.text(i) for i in range(len(piece))]
                for i in np.unique(u.row[out]).tolist():
                    a, b = u.first[i], u.first[i + 1]
                    base, own = piece.offsets[i], ~out[a:b]
                    if not own.any():
                        texts[i] = b""
                        continue
                    begin, end = u.begin[a:b] - base, u.end[a:b] - base
                    lead, tail = np.append(0, end[:-1]), end.copy()
                    tail[-1] = len(texts[i])
                    at = np.flatnonzero(own)
                    if at[0]:
                        lead[at[0]] = begin[at[0]]
                    texts[i] = b"".join([texts[i][x:y] for x, y in zip(lead[at].tolist(), tail[at].tolist())])
                base = piece.offsets[u.row]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(u.first), pa.int64()), spans(u, out, base), spans(u, ~out, base), pa.array([t.decode() for t in texts], pa.string())], names=schema.names)

    return rows.mapInArrow(thrifty(cut), schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["begin"]).cast("long"))
    return found.select(id_col, "n_units", F.size("removed").cast("long").alias("n_removed"), size.alias("removed_bytes"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same result in SQL; runs of units are compared by their normalised text instead of its hash.
ORACLE_SQL = rf"""
WITH word AS (
  SELECT doc_id, n, w, regexp_extract(w, '^[ \t\n\r\v\f]*') AS lead, ltrim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS n
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[ \t\n\r\v\f]*(?:[^ \t\n\r\v\f{WIDE_STOPS}]*[{WIDE_STOPS}]+|[^ \t\n\r\v\f{WIDE_STOPS}]+)') AS l FROM documents))
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS u
  FROM (SELECT *, cast(n = 1 OR contains(lead, chr(10)) OR regexp_matches(core, '^\p{{Lu}}') OR regexp_matches(lag(core) OVER (PARTITION BY doc_id ORDER BY n), '[{STOPS}{WIDE_STOPS}]$') AS INT) AS opens FROM word)
), unit AS (
  SELECT doc_id, u, string_agg(w, '' ORDER BY n) AS raw, string_agg(translate(core, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' ORDER BY n) AS norm,
         sum(1 + strlen(core) // {WORD_BYTES}) AS size, strlen(arg_min(lead, n)) AS lead
  FROM numbered GROUP BY doc_id, u
), added AS (
  SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY u) AS upto FROM unit
), run AS (
  SELECT a.doc_id, a.u AS low, b.u AS high FROM added a ASOF JOIN added b ON a.doc_id = b.doc_id AND a.upto - a.size + {MIN_WORDS} <= b.upto
  UNION
  SELECT b.doc_id, a.u, b.u FROM added b ASOF JOIN (SELECT doc_id, u, upto - size AS before FROM added) a ON a.doc_id = b.doc_id AND b.upto - {MIN_WORDS} >= a.before
), ranked AS (
  SELECT doc_id, low, high, row_number() OVER (PARTITION BY norm ORDER BY doc_id, low) > 1 AS gone
  FROM (SELECT r.doc_id, low, high, string_agg(norm, ' ' ORDER BY u) AS norm FROM run r JOIN unit ON unit.doc_id = r.doc_id AND u BETWEEN low AND high GROUP BY r.doc_id, low, high)
), lost AS (
  SELECT DISTINCT unit.doc_id, u FROM ranked r JOIN unit ON unit.doc_id = r.doc_id AND u BETWEEN low AND high WHERE gone
), marked AS (
  SELECT unit.*, lost.u IS NOT NULL AS gone FROM unit LEFT JOIN lost ON lost.doc_id = unit.doc_id AND lost.u = unit.u
), joined AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, coalesce(sum(strlen(raw) - lead) FILTER (WHERE gone), 0) AS removed_bytes,
         coalesce(string_agg(raw, '' ORDER BY u) FILTER (WHERE NOT gone), '') AS body, bool_or(gone AND u = 1) AS opening, arg_max(gone, u) AS closing
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, cast(coalesce(removed_bytes, 0) AS BIGINT) AS removed_bytes,
       sha256(CASE WHEN n_units IS NULL THEN coalesce(d.text, '')
              ELSE CASE WHEN opening THEN ltrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE body END || CASE WHEN closing THEN '' ELSE regexp_extract(d.text, '[ \t\n\r\v\f]*$') END END) AS kept_sha256
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
