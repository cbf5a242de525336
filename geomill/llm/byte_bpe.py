"""Byte-level BPE as a reduction over a tree of byte strings.

encode(x) halves x, encodes the halves and joins them. A join re-encodes a window
of tokens around the seam, first one token of either side, and widens it until the
tokens next to the window are stable: a token sequence is the encoding of its bytes
exactly if each pair of neighbours is the encoding of the two together, so it is
enough that the pairs at the window's edges are. Tokens further out then keep.
Decoding concatenates neighbours up the tree.

Defined results: null and empty texts have no tokens; texts of any length are encoded whole;
repeated rows each give a row; null ids are kept; an empty table gives an empty table; extra
columns, whatever their names, are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geomill.llm.text import pieces, thrifty


#: Entries of a memo table at most, and characters of a match that is remembered from text to text: so a table holds some 100 MB whatever the texts.
MEMO, REMEMBERED = 250_000, 64


class TreeCodec:
    """Encoder and decoder for one table of ranks; memo tables are emptied at `limit` entries of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = MEMO):
        import regex

        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.matches: dict[str, bytes] = {}

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Lowest-rank merges of a short window, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        n, ranks = len(data), self.ranks
        end, prev, live = [*range(1, n + 1)], [-1, *range(n - 1)], bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i] or end[i] >= n or end[end[i]] != stop:
                continue
            live[end[i]] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _window(self, data: bytes) -> tuple[int, ...]:
        if len(data) > 32:
            return self._merge(data)
        known = self.windows.get(data)
        if known is None:
            if len(self.windows) >= self.limit:
                self.windows.clear()
            known = self.windows[data] = self._merge(data)
        return known

    def _stable(self, a: int, b: int) -> bool:
        return self._window(self.bytes_of[a] + self.bytes_of[b]) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenation of two encoded strings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = self._window(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            free_left = i >= len(left) or self._stable(left[-i - 1], window[0])
            free_right = j >= len(right) or self._stable(window[-1], right[j])
            if free_left and free_right:
                return left[:-i] + window + right[j:]
            if not free_left:
                i = min(len(left), i + 1 if i < 4 else 2 * i)
            if not free_right:
                j = min(len(right), j + 1 if j < 4 else 2 * j)

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        known = self.parts.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
            if len(data) <= 8:
                if len(self.parts) >= self.limit:
                    self.parts.clear()
                self.parts[data] = known
        return known

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        found = self.find(text)
        known = self.matches
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        new = set(found).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(found)
        for m in new:
            ids = self.encode_piece(m.encode())
            known[m] = ids[0].to_bytes(4, "little") if len(ids) == 1 else np.array(ids, "<u4").tobytes()
        out = b"".join(map(known.__getitem__, found))
        for m in new:
            if len(m) > REMEMBERED:
                del known[m]
        return out

    def forget(self) -> None:
        """Empty the memo tables, which other stages' tasks of the same worker don't need."""
        for known in (self.parts, self.windows, self.matches):
            known.clear()

    def decode(self, ids: bytes, leaf: int = 4096) -> bytes:
        """Bytes of the tokens, concatenated pairwise up the tree."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        level = [b"".join(map(self.bytes_of.__getitem__, numbers[i : i + leaf])) for i in range(0, len(numbers), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> TreeCodec:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return TreeCodec(ranks, pattern)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row; with_ids adds `ids`, the tokens themselves."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(ranks_path, pattern)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for piece in pieces(batch.column(1)):
                ids = [codec.encode(piece.text(i).decode()) for i in range(len(piece))]
                out = [batch.column(0).slice(piece.first, len(piece)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([digest(x) for x in ids]), pa.array([digest(codec.decode(x)) for x in ids])]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
        codec.forget()

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)
