"""Token counts of a SentencePiece BPE model by rank-synchronous array merging.

Each text is cut into pre-tokens that no vocabulary piece can bridge. The
distinct new pre-tokens of a piece of the corpus are held as one ragged numpy
array of symbols. In each round every sequence applies its own lowest-rank pair,
all sequences at once, until no pair merges; surviving symbols are counted, and a
symbol outside the vocabulary counts its UTF-8 bytes (byte fallback). Counts of
distinct pre-tokens are kept in a bounded dictionary of the Python worker.

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole;
repeated rows each give a row; null ids are kept; an empty table gives an empty table; extra
columns, whatever their names, are not carried.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geomill.llm.text import pieces, thrifty

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Sequences longer than this keep their pairs by rank, so that a round touches only the pairs it merges.
LONG = 512


class PieceModel:
    """Merge table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as spec

        proto = spec.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with the identity normalizer are supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        chars = sorted({c for p in score for c in p} | set(score))
        self.ids = {s: i for i, s in enumerate(chars)}
        self.known = np.array([s in score for s in chars])
        order = sorted({-v for v in score.values()})
        rank_of = {v: i for i, v in enumerate(order)}
        rank, pairs = {}, {}
        for p, v in score.items():
            rank[self.ids[p]] = rank_of[-v]
            for i in range(1, len(p)):
                a, b = self.ids.get(p[:i]), self.ids.get(p[i:])
                if a is not None and b is not None:
                    pairs[a, b] = self.ids[p]
        self.n = len(chars)
        self.names = chars
        self.of_code = np.full(0x110000, -1, np.int64)
        self.of_code[0x80:0x800], self.of_code[0x800:0x10000], self.of_code[0x10000:] = -2, -3, -4
        for s, i in self.ids.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        self.pairs = {k: (rank[m], m) for k, m in pairs.items()}
        keys = np.array([a * self.n + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], made[by]
        self.rank = np.array([rank[m] for m in self.made.tolist()], np.int64)
        # A piece is calm if every merge that uses it comes strictly later than its own: then all its pairs may merge in one round.
        calm = np.ones(self.n, bool)
        for (a, b), m in pairs.items():
            for part in (a, b):
                if part in rank and rank[m] <= rank[part]:
                    calm[part] = False
        self.calm = calm
        inner = {c for p in score if len(p) > 1 for c in p}
        bridged = any(SPACE in p.lstrip(SPACE) for p in score)
        if bridged:
            self.cut = None
        else:
            self.cut = re.compile(r" +[^ ]*|[^ ]+") if "\n" in inner else re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")

    def split(self, text: str) -> list[str]:
        text = self.prefix + text.replace(SPACE, " ")
        return self.cut.findall(text) if self.cut else [text]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        tokens = [t.replace(" ", SPACE) for t in tokens]
        out = np.zeros(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            if len(t) > LONG:
                out[i] = self._long(t)
        batch = [i for i, t in enumerate(tokens) if 0 < len(t) <= LONG]
        if not batch:
            return out
        # A character outside the table is minus its number of bytes: it merges with nothing.
        sym = self.of_code[np.frombuffer("".join([tokens[i] for i in batch]).encode("utf-32-le"), np.uint32)]
        seq = np.repeat(np.arange(len(batch)), [len(tokens[i]) for i in batch])
        same = np.zeros(len(sym), bool)
        same[:-1] = seq[:-1] == seq[1:]
        rank, made = self._look(sym, np.append(sym[1:], -1))
        rank[~same] = NONE
        count = np.zeros(len(batch), np.int64)
        while len(sym):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            least = np.repeat(least, size)
            done = least == NONE
            if done.any():
                np.add.at(count, seq[done], self._weight(sym[done]))
                keep = ~done
                sym, seq, rank, made, least = sym[keep], seq[keep], rank[keep], made[keep], least[keep]
                continue
            chosen = np.flatnonzero(rank == least)
            owner = seq[chosen]
            lead = np.append(True, owner[1:] != owner[:-1])
            calm = self.calm[made[chosen]]
            # Pairs that overlap (a a a) merge from the left, every other one of a run.
            run = np.append(True, (np.diff(chosen) != 1) | (owner[1:] != owner[:-1]))
            start = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            even = (np.arange(len(chosen)) - start) % 2 == 0
            lead_calm = np.repeat(np.minimum.reduceat(calm, np.flatnonzero(lead)), np.diff(np.append(np.flatnonzero(lead), len(chosen))))
            at = chosen[np.where(lead_calm, even, lead)]
            sym[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            fresh[(at - 2)[at > 1]] |= gone[(at - 1)[at > 1]]
            keep = ~gone
            sym, seq, rank, made, fresh = sym[keep], seq[keep], rank[keep], made[keep], fresh[keep]
            at = np.flatnonzero(fresh)
            nxt = np.minimum(at + 1, len(sym) - 1)
            r, m = self._look(sym[at], sym[nxt])
            r[(nxt == at) | (seq[nxt] != seq[at])] = NONE
            rank[at], made[at] = r, m
        out[batch] = count
        return out

    def _weight(self, sym: np.ndarray) -> np.ndarray:
        out = np.where(sym < 0, -sym, 1)
        rare = np.flatnonzero(sym >= 0)
        rare = rare[~self.known[sym[rare]]]
        if len(rare):
            out[rare] = [len(self.names[s].encode()) for s in sym[rare]]
        return out

    def _long(self, token: str) -> int:
        """Tokens of one long pre-token: the same rounds, over linked symbols and lists of places by rank."""
        sym = self.of_code[np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(sym)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        rank, made, live = np.full(n, NONE), np.full(n, -1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(r: int, at: np.ndarray) -> None:
            if r not in places:
                heapq.heappush(heap, r)
            places.setdefault(r, []).append(at)

        def look(at: np.ndarray) -> None:
            rank[at], made[at] = NONE, -1
            at = at[after[at] >= 0]
            r, m = self._look(sym[at], sym[after[at]])
            at, r, m = (v[r != NONE] for v in (at, r, m))
            rank[at], made[at] = r, m
            by = np.argsort(r, kind="stable")
            turn = np.flatnonzero(np.append(True, np.diff(r[by]) != 0))[: len(by)]
            for own in np.split(at[by], turn[1:]) if len(by) else ():
                push(int(rank[own[0]]), own)

        look(np.arange(n))
        waiting: dict[int, list[int]] = {}  # places of ranks that go one by one, as heaps
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if r not in waiting and self.calm[made[at]].all():
                # Pairs that overlap merge from the left, every other one of a run.
                run = np.append(True, after[at[:-1]] != at[1:])[: len(at)]
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                own = waiting.setdefault(r, [])
                for x in at.tolist():
                    heapq.heappush(own, x)
                while own and not (live[own[0]] and rank[own[0]] == r):
                    heapq.heappop(own)
                at = np.array([heapq.heappop(own)] if own else [], np.int64)
                if own:
                    push(r, at[:0])
            if not len(at):
                continue
            right = after[at]
            sym[at], live[right] = made[at], False
            after[at] = after[right]
            behind = after[at]
            before[behind[behind >= 0]] = at[behind >= 0]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return int(self._weight(sym[live]).sum())


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


#: Known pre-tokens at most, and characters of one that is remembered from text to text: some 50 MB whatever the texts.
MEMO, REMEMBERED = 250_000, 64


class Counter:
    """Counts texts; the dictionary of known pre-tokens is emptied when it reaches `limit` entries, which are of bounded size."""

    def __init__(self, model: PieceModel, limit: int = MEMO):
        self.model, self.limit, self.seen = model, limit, {}

    def __call__(self, texts: Iterable[str]) -> list[int]:
        split = [self.model.split(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.seen))
        if len(self.seen) + len(new) > self.limit:
            self.seen.clear()
            new = list(set().union(*split))
        self.seen.update(zip(new, self.model.count(new).tolist()))
        get = self.seen.__getitem__
        counts = [sum(map(get, s)) for s in split]
        for token in new:
            if len(token) > REMEMBERED:
                del self.seen[token]
        return counts


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, over its whole text."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(model_path, Counter(load(model_path)))
        for batch in batches:
            for piece in pieces(batch.column(1)):
                counts = counter([piece.text(i).decode() for i in range(len(piece))])
                size = np.diff(piece.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(size), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])], names=schema.names)
        counter.seen.clear()

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)
