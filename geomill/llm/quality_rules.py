"""Quality rules by line sequence labelling.

Each line with a word is described by binary features (length, share of symbols,
capitals and digits, repeated words, repetition of an earlier line, place in the text),
and a linear-chain conditional random field labels the lines as content or boilerplate:
Viterbi decoding over the whole text, many texts at a time. A text is kept if content
lines hold at least `content_share` of its words and no base rule fails.

The field's weights are trained here by maximum likelihood (forward-backward in numpy)
on a bounded sample of labelled documents, whose lines take their document's label.
Without labels the weights are 0 and every line counts as content.

Words are runs of characters outside [\\x20\\x09-\\x0D]; lines end at \\n. Words, lines and
windows are equal if all their bytes are.

Defined results: null and empty texts have no words and fail the base rule; texts of any
length are judged whole; repeated rows each give a row; null ids are kept; an empty table
gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geomill.llm.labels import sample
from geomill.llm.text import Piece, codes, pieces, run_codes, thrifty, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True
LEAST_WORDS, MOST_REPEATED, CONTENT_SHARE = 10, 20, 0.5
TRAIN_ROWS, TRAIN_BYTES, ROUNDS = 1500, 16_000, 120
FEATURES = ("bias", "one to three words", "over 40 words", "symbols 1 to 5 %", "symbols over 5 %", "capitals over half", "digits over 20 %", "a word follows itself", "a third of words follow themselves", "equal to an earlier line", "first line", "last line", "ends like a sentence", "a bar between words", "half of the words come earlier in the line")


def describe(piece: Piece) -> dict[str, np.ndarray]:
    """Counts of each row, and features, owner and words of each line with a word."""
    data, n = piece.data, len(piece)
    start, end, row = word_spans(piece)
    word, _ = codes(data, start, end)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    symbols = np.append(0, np.cumsum(SYMBOLS[data]))
    n_words = np.bincount(row, minlength=n)
    word_chars = np.bincount(row, weights=chars[end] - chars[start], minlength=n).astype(np.int64)
    n_symbols = symbols[piece.offsets[1:]] - symbols[piece.offsets[:-1]]
    # Five-word windows that their text has twice cover words.
    window = run_codes(word, 5)
    at = np.flatnonzero(row[: len(window)] == row[len(row) - len(window) :])
    h, own = window[at], row[at]
    order = np.lexsort((h, own))
    same = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    n_repeat = np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=n).astype(np.int64)
    # Lines: from each break or text start to the next.
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([piece.offsets[:-1][np.diff(piece.offsets) > 0], breaks + 1]))
    begin = np.unique(begin[begin < len(data)])
    owner = np.searchsorted(piece.offsets, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), piece.offsets[owner + 1])
    stop = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
    first = np.searchsorted(start, begin)
    count = np.searchsorted(start, stop) - first
    some = count > 0
    begin, stop, owner, first, count = begin[some], stop[some], owner[some], first[some], count[some]
    line, _ = codes(data, begin, stop)
    order = np.lexsort((np.arange(len(line)), line, owner))
    equal = np.append(False, (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1]))[: len(line)]
    again = np.zeros(len(line), bool)
    again[order[equal]] = True
    n_dup = np.bincount(owner, weights=again, minlength=n).astype(np.int64)
    # Features of lines.
    size = np.maximum(stop - begin, 1)
    total = lambda flags: (c := np.append(0, np.cumsum(flags)))[stop] - c[begin]
    upper, digit = total(UPPER[data]), total(DIGIT[data])
    lower = total((data >= 97) & (data <= 122))
    sym = symbols[stop] - symbols[begin]
    follows = np.append(False, (word[1:] == word[:-1]) & (row[1:] == row[:-1]))[: len(word)]
    fsum = np.append(0, np.cumsum(follows))
    doubled = fsum[first + count] - fsum[first]
    line_of = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((word, line_of))
    seen_equal = np.append(False, (word[order][1:] == word[order][:-1]) & (line_of[order][1:] == line_of[order][:-1]))[: len(word)]
    seen = np.zeros(len(word), bool)
    seen[order[seen_equal]] = True
    ssum = np.append(0, np.cumsum(seen))
    seen_share = (ssum[first + count] - ssum[first]) / np.maximum(count, 1)
    tail = data[end[first + count - 1] - 1] if len(first) else np.zeros(0, np.uint8)
    single = (end - start == 1) & (data[start] == 124) if len(start) else np.zeros(0, bool)
    bars = np.append(0, np.cumsum(single))
    x = np.stack(
        [
            np.ones(len(begin), bool), count <= 3, count > 40, (sym > 0.01 * size) & (sym <= 0.05 * size), sym > 0.05 * size, upper > lower, digit > 0.2 * size,
            doubled > 0, doubled * 3 > count, again, np.append(True, owner[1:] != owner[:-1])[: len(owner)], np.append(owner[1:] != owner[:-1], True)[: len(owner)],
            np.isin(tail, np.frombuffer(b".!?", np.uint8)), bars[first + count] > bars[first], seen_share >= 0.5,
        ],
        axis=1,
    )
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "x": x, "owner": owner, "count": count}


class Field:
    """Linear-chain CRF with two labels (0 boilerplate, 1 content)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (features, 2) and (2, 2)

    def decode(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Viterbi labels of all lines; sequences advance together, longest first. A tie is content."""
        score = x @ self.emit
        lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        size = np.diff(np.append(lead, len(owner)))
        by = np.argsort(-size, kind="stable")
        lead, size = lead[by], size[by]
        back = np.zeros((len(owner), 2), np.int8)
        best = score[lead].copy()
        for t in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
            step = best[:live, :, None] + self.move[None]
            back[lead[:live] + t] = np.where(step[:, 1] >= step[:, 0], 1, 0)
            best[:live] = step.max(axis=1) + score[lead[:live] + t]
        label = np.zeros(len(owner), np.int8)
        now = np.where(best[:, 1] >= best[:, 0], 1, 0).astype(np.int8) if len(best) else np.zeros(0, np.int8)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            at = lead[:live] + t
            label[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return label


def train(x: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent with momentum; each sequence weighs alike within its label, both labels alike."""
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    if not len(owner):
        return field
    lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(lead, len(owner)))
    by = np.argsort(-size, kind="stable")
    lead, size = lead[by], size[by]
    weight = np.where(label[lead] == 1, 0.5 / max(1, (label[lead] == 1).sum()), 0.5 / max(1, (label[lead] == 0).sum())) / size
    line_weight = np.zeros(len(owner))
    live_at = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)]
    for t in range(int(size[0])):
        line_weight[lead[: live_at[t]] + t] = weight[: live_at[t]]
    xf, gold = x.astype(float), np.eye(2)[label]
    ve, vm = np.zeros_like(field.emit), np.zeros((2, 2))
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(rounds):
        score = xf @ field.emit
        alpha, beta = score.copy(), np.zeros_like(score)
        for t in range(1, int(size[0])):
            at = lead[: live_at[t]] + t
            alpha[at] = score[at] + lse(alpha[at - 1][:, :, None] + field.move[None], 1)
        for t in range(int(size[0]) - 1, 0, -1):
            at = lead[: live_at[t]] + t
            beta[at - 1] = lse(field.move[None] + (score[at] + beta[at])[:, None, :], 2)
        post = alpha + beta
        post = np.exp(post - lse(post, 1)[:, None])
        grad_e = xf.T @ ((gold - post) * line_weight[:, None]) - ridge * field.emit
        inner = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))
        pair = alpha[inner - 1][:, :, None] + field.move[None] + (score[inner] + beta[inner])[:, None, :]
        pair = np.exp(pair - lse(pair.reshape(-1, 4), 1)[:, None, None])
        want = gold[inner - 1][:, :, None] * gold[inner][:, None, :]
        grad_m = ((want - pair) * line_weight[inner][:, None, None]).sum(axis=0) - ridge * field.move
        ve, vm = 0.9 * ve + grad_e, 0.9 * vm + grad_m
        field.emit += 1.0 * ve
        field.move += 1.0 * vm
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    rows = sample(docs, labels, label, 1, -1, train_rows, train_bytes, id_col, text_col).collect()
    x, owner, y = [np.zeros((0, len(FEATURES)), bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    known = np.array([r["label"] for r in rows], np.int64)
    for piece in pieces(pa.array([r["text"] for r in rows], pa.string())):
        d = describe(piece)
        x.append(d["x"])
        owner.append(d["owner"] + piece.first)
        y.append(known[d["owner"] + piece.first])
    return train(np.concatenate(x), np.concatenate(owner), np.concatenate(y))


def judge(docs: DataFrame, field: Field, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, content_share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, labels) for each row; `labels` has c or b for each line with a word."""
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("labels", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                d = describe(piece)
                label = field.decode(d["x"], d["owner"])
                n = len(piece)
                content = np.bincount(d["owner"], weights=d["count"] * label, minlength=n)
                share = content / np.maximum(d["n_words"], 1)
                failed = (d["n_words"] < least_words) | (100 * d["n_repeat_words"] > most_repeated * d["n_words"])
                kept = ~failed & (share >= content_share)
                marks = np.where(label == 1, ord("c"), ord("b")).astype(np.uint8).tobytes().decode()
                lead = np.searchsorted(d["owner"], np.arange(n + 1)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, n), *(pa.array(d[c], pa.int64()) for c in longs), pa.array(failed), pa.array(kept), pa.array(share), pa.array([marks[a:b] for a, b in zip(lead[:-1], lead[1:])])], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)
