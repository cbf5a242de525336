"""Benchmark decontamination with a positional inverted index sharded by documents.

`build_index` turns stretches of the corpus into index segments: for each term of
the test items the ascending word positions in the segment, as gaps. The segments
are stored; a segment is bounded by the bytes of text it covers, and documents that
hold frequent words only make their own segment longer. `search` sends the items'
phrases to every segment (a stated query set, in blocks of bounded size), takes the
phrase's terms from the rarest in the segment on and intersects their positions less
their offsets until none is left or all terms have agreed; `slop` > 0 looks for
proximity matches instead: the shortest stretches of at most phrase length + slop
words that hold all of the phrase's terms in any order.

Words: A-Z lower-cased, then runs of bytes outside \\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F.

Defined results: null and empty texts have no words and are never hit; items without
words have no window; an item without an id is named by the empty string; texts of any length
are searched whole; repeated rows each give a row; null ids are kept; an empty
corpus or item table gives an empty or hitless result; extra columns, whatever their names,
are not carried, or stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.llm.text import pieces, ranges, thrifty
from geomill.llm.suffix_dedup import text_key
from geomill.llm.workspace import broadcast_if_small, written

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that one index segment covers, unless a single document is longer.
SEGMENT_BYTES = 4 << 20
#: Bytes of item text that one block of queries may hold; the driver holds about 70 times as many for one block at a time.
BLOCK_BYTES = 4 << 20
#: Distinct words of all items, held by the driver and by each task that builds the index (some 250 MB); more are refused.
MOST_WORDS = 2_000_000


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct windows of a block of items: `size` consecutive words, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, str | None]], size: int, vocab: dict[bytes, int]):
        owners: dict[tuple[int, ...], list[int]] = {}
        self.items = [i or "" for i, _ in items]
        for n, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab)) for w in words((text or "").encode())]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                own = owners.setdefault(tuple(ids[at : at + size]), [])
                if not own or own[-1] != n:
                    own.append(n)
        self.windows, self.owners = list(owners), list(owners.values())
        width = max(map(len, self.windows), default=1)
        self.matrix = np.full((len(self.windows), width), -1, np.int64)
        for row, w in zip(self.matrix, self.windows):
            row[: len(w)] = w
        self.n_terms = len(vocab)
        # Each window is listed under its term that the fewest windows have: a segment without it needn't look at the window.
        held = self.matrix >= 0
        often = np.append(np.bincount(self.matrix[held], minlength=self.n_terms), np.iinfo(np.int64).max)
        lead = self.matrix[np.arange(len(self.matrix)), often[self.matrix].argmin(axis=1)]
        self.listed = np.argsort(lead, kind="stable")
        self.first = np.searchsorted(lead[self.listed], np.arange(self.n_terms + 1))

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """Windows whose rarest term is among the terms."""
        own = terms[terms < self.n_terms]
        return self.listed[ranges(self.first[own], self.first[own + 1])]


def vocabulary(items: DataFrame, text_col: str, most: int = MOST_WORDS) -> tuple[dict[bytes, int], int]:
    """Numbers of the words of all items, and the bytes of their texts."""
    vocab: dict[bytes, int] = {}
    total = 0
    for row in items.select(text_col).toLocalIterator():
        text = (row[0] or "").encode()
        total += len(text)
        for w in words(text):
            vocab.setdefault(w, len(vocab))
        if len(vocab) > most:
            raise ValueError(f"the items have more than {most} distinct words; split the item table")
    return vocab, total


def blocks(items: DataFrame, size: int, vocab: dict[bytes, int], id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Items in blocks of bounded bytes, fetched and made into windows one block at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        held += len((row[1] or "").encode())
        if held >= limit:
            yield Phrases(block, size, vocab)
            block, held = [], 0
    if block:
        yield Phrases(block, size, vocab)


def build_index(docs: DataFrame, vocab: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments: the documents' ids, first positions and lengths, and terms with postings (int32 gaps)."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("starts", ints), T.StructField("n_words", ints), T.StructField("terms", ints), T.StructField("counts", ints), T.StructField("gaps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocab.get
        for batch in batches:
            for piece in pieces(batch.column(1), SEGMENT_BYTES):
                folded = piece.data.tobytes().translate(FOLD)
                term, size = [], []
                for a, b in zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist()):
                    w = folded[a:b].split()
                    size.append(len(w))
                    term.append(np.fromiter(map(find, w, repeat(-1)), np.int32, len(w)))
                    term.append(np.array([-1], np.int32))  # no phrase crosses from one document to the next
                term = np.concatenate(term)
                size = np.array(size, np.int32)
                at = np.flatnonzero(term >= 0).astype(np.int32)
                at = at[np.argsort(term[at], kind="stable")]
                terms, counts = np.unique(term[at], return_counts=True)
                gaps = np.diff(at, prepend=np.int32(0)).astype(np.int32)
                ids = batch.column(0).slice(piece.first, len(piece))
                one = lambda x: pa.array([x], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one((np.cumsum(size + 1) - size - 1).astype(np.int32)), one(size), one(terms.astype(np.int32)), one(counts.astype(np.int32)), pa.array([gaps.tobytes()])], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)


class Segment:
    """Postings of one index segment, decoded."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, gaps: bytes, n_terms: int):
        at = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int32)
        self.of = dict(zip(terms.tolist(), np.split(at, np.cumsum(counts)[:-1]))) if len(terms) else {}
        self.count = np.zeros(n_terms + 1, np.int64)
        self.count[terms] = counts
        self.count[-1] = 1  # what pads the matrix of windows

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """First positions of exact occurrences."""
        order = sorted(range(len(window)), key=lambda i: self.count[window[i]])
        at = self.of[window[order[0]]] - order[0]
        for i in order[1:]:
            if not len(at):
                break
            there = self.of[window[i]]
            want = at + i
            found = np.searchsorted(there, want)
            at = at[there[np.minimum(found, len(there) - 1)] == want]
        return at

    def near(self, window: tuple[int, ...], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of stretches of at most len(window) + slop words with all of the terms."""
        own = sorted(set(window), key=lambda t: self.count[t])
        reach = len(window) + slop
        rare = self.of[own[0]]
        first = np.unique(np.concatenate([self.of[t] for t in own]))
        close = np.minimum(np.searchsorted(rare, first), len(rare) - 1)
        first = first[(rare[close] >= first) & (rare[close] - first < reach)]
        last = first.copy()
        for t in own:
            found = np.searchsorted(self.of[t], last * 0 + first)
            nxt = np.where(found < len(self.of[t]), self.of[t][np.minimum(found, len(self.of[t]) - 1)], np.iinfo(np.int32).max)
            last = np.maximum(last, nxt)
        ok = last - first < reach
        return first[ok], last[ok]


def search(index: DataFrame, phrases: Phrases, n_terms: int, id_col: str = "doc_id", slop: int = 0) -> tuple[DataFrame, Broadcast]:
    """(segment, nth, id, n_words, items, spans) for each document: the sorted items found and the merged word ranges they cover; and the broadcast windows, for the caller to drop when the frame is done with."""
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField(id_col, index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    del phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, starts, size, terms, counts = (batch.column(i)[k].values for i in range(5))
                starts, size, terms, counts = (x.to_numpy(zero_copy_only=False) for x in (starts, size, terms, counts))
                seg = Segment(terms, counts, batch.column(5)[k].as_py(), n_terms)
                edge = np.zeros(int(size.sum()) + len(size) + 1, np.int32)
                owner: dict[int, set[int]] = {}
                some = p.possible(terms)
                for w in some[(seg.count[p.matrix[some]] > 0).all(axis=1)].tolist():
                    if slop:
                        first, last = seg.near(p.windows[w], slop)
                    else:
                        first = seg.phrase(p.windows[w])
                        last = first + len(p.windows[w]) - 1
                    doc = np.searchsorted(starts, first, "right") - 1
                    inside = (last < starts[doc] + size[doc]) if len(first) else np.zeros(0, bool)
                    np.add.at(edge, first[inside], 1)
                    np.add.at(edge, last[inside] + 1, -1)
                    for d in set(doc[inside].tolist()):
                        owner.setdefault(d, set()).update(p.owners[w])
                hit = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                spans: list[list[dict]] = [[] for _ in range(len(size))]
                for a, b in turn.reshape(-1, 2).tolist():
                    d = int(np.searchsorted(starts, a, "right")) - 1
                    spans[d].append({"first": a - int(starts[d]), "end": b - int(starts[d])})
                items = [sorted({p.items[i] for i in owner.get(d, ())}) for d in range(len(size))]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(6)[k].as_py()] * len(size), pa.int64()), pa.array(np.arange(len(size), dtype=np.int32)), ids, pa.array(size.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], names=schema.names)

    return index.mapInArrow(thrifty(run), schema), shared


def find_items(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, items, spans) for each document, over all items.

    Each block of items is made into windows, broadcast, searched and its findings written
    before the next; documents are told apart by the segment number stored with the index,
    and the blocks' findings are united per document.
    """
    vocab, total = vocabulary(items, item_text)
    index = written(build_index(docs, vocab, id_col, text_col).withColumn("segment", F.monotonically_increasing_id()))
    found: list[DataFrame] = []
    asked = blocks(items, size, vocab, item_id, item_text)
    single = total < blocks.__defaults__[0]
    while (phrases := next(asked, None)) is not None or not found:
        part, shared = search(index, phrases or Phrases([], size, vocab), len(vocab), id_col, slop)
        del phrases
        found.append(part if single else written(part))
        if not single:
            shared.destroy()
    every = found[0]
    if len(found) > 1:
        for f in found[1:]:
            every = every.unionByName(f)
        every = every.groupBy("segment", "nth").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")).withColumn("spans", _united())
    return every.select(id_col, "n_words", "items", "spans")


def _united():
    """Merge overlapping or touching word ranges."""
    kind = "array<struct<first:int,end:int>>"
    return F.expr(
        f"""aggregate(array_sort(spans), cast(array() as {kind}), (acc, s) ->
            if(size(acc) > 0 and element_at(acc, -1).end >= s.first,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, s.end)))),
               concat(acc, array(s))))"""
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the digest of the items of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["first"]).cast("long"))
    return found.select(id_col, F.col("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", **names) -> DataFrame:
    """The rows whose text holds no window of an item, with all their columns. Texts are known by their digest, so ids may be null or repeated."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key(text_col).alias("key"))
    found = find_items(keyed.select("key", F.col("row").getField(text_col).alias("text")), items, size, id_col="key", **names)
    hit = written(found.filter(F.size("items") > 0).select("key").distinct())
    return keyed.join(broadcast_if_small(hit, 48), "key", "left_anti").select("row.*")
