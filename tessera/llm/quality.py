"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad. The score of a label is linear in surface features of the
line and of its two neighbours; neighbouring labels are tied by a 2 x 2 transition matrix. Forward-backward
gives each line's marginal probability of being good, and the mean of the marginals, weighted by the
lines' lengths in bytes, is the document's quality (0 to 1).

Training takes a bounded sample of labelled documents, each line with its document's label.

Edge cases: a text that is null, empty or without a non-blank line has quality 0. Without labelled
documents of both classes every other document has quality 1 (nothing is known against it). Lines are cut at "\\n";
a text of one line is a chain of one. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .labelled import sample_with_label

# Classes of bytes; 0 is "other".
UPPER, LOWER, DIGIT, SPACE, STOP, BANG, SYMBOL, PIPE, WIDE = range(1, 10)
CLASS = np.zeros(256, np.int64)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, WIDE
CLASS[[32, 9, 13, 11, 12]] = SPACE
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = STOP
CLASS[ord("!")] = BANG
CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\/=+_`"]] = SYMBOL
CLASS[ord("|")] = PIPE

NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False

OWN = 13
WIDTH = 1 + 3 * OWN + 2


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines with something visible, and the first line of each row (n + 1)."""
    starts, ends, _ = B.words(data, offsets, NOT_NEWLINE)
    if len(starts):
        seen = np.concatenate(([0], np.cumsum(VISIBLE[data])))
        ok = seen[ends] > seen[starts]
        starts, ends = starts[ok], ends[ok]
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lines x WIDTH features (own, previous and next line), lines' lengths, first line of each row."""
    starts, ends, first = lines(data, offsets)
    n = len(starts)
    if n == 0:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), first
    line = np.repeat(np.arange(n), ends - starts)
    at = np.arange(len(line)) + np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts)
    by = np.bincount(line * 10 + CLASS[data[at]], minlength=n * 10).reshape(n, 10).astype(np.float32)
    size = (ends - starts).astype(np.float32)
    letters = by[:, UPPER] + by[:, LOWER] + by[:, WIDE]
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    low = B.LOWER[data]
    ws, we, _ = B.words(low, offsets, VISIBLE)
    wh = B.span_hashes(low, ws, we)
    wl = np.searchsorted(starts, ws, side="right") - 1
    count = np.bincount(wl, minlength=n).astype(np.float32)
    order = np.lexsort((wh, wl))
    new = np.ones(len(order), bool)
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (wl[order][1:] != wl[order][:-1])
    distinct = np.bincount(wl[order][new], minlength=n).astype(np.float32)
    key = B.mix(B.span_hashes(low, starts, ends) + B.mix(row.astype(np.uint64)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    own = np.column_stack((
        by[:, UPPER] / np.maximum(letters, 1), by[:, DIGIT] / size, by[:, SPACE] / size, 10 * by[:, STOP] / size, 10 * by[:, BANG] / size, 10 * by[:, SYMBOL] / size, 10 * by[:, PIPE] / size,
        letters / size, np.log1p(size) / 5, size / np.maximum(count, 1) / 10, distinct / np.maximum(count, 1), np.log(times[inverse]), CLASS[data[ends - 1]] == STOP,
    )).astype(np.float32)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    begins, closes = np.ones(n, bool), np.ones(n, bool)
    begins[1:] = row[1:] != row[:-1]
    closes[:-1] = begins[1:]
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    out[begins, 1 + OWN : 1 + 2 * OWN] = 0
    out[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    out[closes, 1 + 2 * OWN : 1 + 3 * OWN] = 0
    out[:, -2], out[:, -1] = begins, closes
    return out, size.astype(float), first


def _pass(emit: np.ndarray, first: np.ndarray, count: np.ndarray, trans: np.ndarray, back: bool) -> np.ndarray:
    """log P(good) - log P(bad) of the messages into each line from one side; all chains step at once."""
    out = np.zeros(len(emit))
    order = np.argsort(-count, kind="stable")
    size, msg = count[order], np.zeros(len(count))
    top = size[0] if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(top), side="left")  # chains longer than t
    t = trans.T if back else trans
    for k in range(top):
        own = order[: alive[k]]
        at = first[own] + (size[: alive[k]] - 1 - k if back else k)
        if k:
            r = msg[: alive[k]]
            msg = np.logaddexp(t[1, 1] + r, t[0, 1]) - np.logaddexp(t[1, 0] + r, t[0, 0])
        else:
            msg = np.zeros(alive[k])
        out[at] = msg
        msg = msg + emit[at]
    return out


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of each line given its whole document."""
        emit, count = x @ self.weights, np.diff(first)
        z = emit + _pass(emit, first[:-1], count, self.trans, False) + _pass(emit, first[:-1], count, self.trans, True)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def quality(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, first = features(data, offsets)
        total = np.concatenate(([0.0], np.cumsum(self.marginals(x, first) * size)))
        weight = np.concatenate(([0.0], np.cumsum(size)))
        some = first[1:] > first[:-1]
        out = np.zeros(len(some))
        out[some] = (total[first[1:]] - total[first[:-1]])[some] / (weight[first[1:]] - weight[first[:-1]])[some]
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150, ridge: float = 2e-4) -> Model:
    """Maximum likelihood by Adam. Each document weighs the same, each class half; lines carry their document's label."""
    count = np.diff(first)
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    y = np.repeat(label, count)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    per_line = np.repeat(share / np.maximum(count, 1), count)
    inner = np.ones(len(x), bool)  # lines with a line before them in their document
    inner[first[:-1][count > 0]] = False
    here = np.flatnonzero(inner)
    m1, m2 = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        emit = x @ w
        f, b = _pass(emit, first[:-1], count, trans, False), _pass(emit, first[:-1], count, trans, True)
        p = 1 / (1 + np.exp(-np.clip(emit + f + b, -50, 50)))
        gw = x.T @ (per_line * (y - p)) - ridge * w
        left, right = (f + emit)[here - 1], (emit + b)[here]
        joint = np.stack([trans[i, j] + i * left + j * right for i in (0, 1) for j in (0, 1)], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        real = np.zeros_like(joint)
        real[np.arange(len(here)), 3 * y[here].astype(int)] = 1
        # documents have one label throughout, so the ties are held down: their weights mustn't drown the lines
        gt = (per_line[here, None] * (real - joint)).sum(0) - 0.02 * trans.ravel()
        g = np.concatenate((gw, gt))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:WIDTH], trans + move[WIDTH:].reshape(2, 2)
    return Model(w, trans)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = 1200) -> Model | None:
    """Fits on a bounded sample of about `per_label` documents a class, of the folds 1 to 4 of 5."""
    rows = sample_with_label(docs.select(id_col, text_col), labels, "quality", per_label, 3, (1, 2, 3, 4), id_col)

    def scorer():
        def f(data, offsets, col):
            x, _, first = features(data, offsets)
            return [[x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]]

        return f

    got = B.annotate(rows, text_col, [T.StructField("_x", T.BinaryType())], scorer, ["_label"]).collect()
    got = sorted(((int(r["_label"] > 0), bytes(r["_x"])) for r in got if r["_x"]))
    if len({y for y, _ in got}) < 2:
        return None
    xs = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x in got]
    first = np.concatenate(([0], np.cumsum([len(x) for x in xs])))
    return fit(np.concatenate(xs).astype(float), first, np.array([float(y) for y, _ in got]))


def score(df: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """df with the quality (0 to 1) of every whole text."""

    def scorer():
        def f(data, offsets, col):
            if model is None:
                _, _, first = lines(data, offsets)
                return [(np.diff(first) > 0).astype(float)]
            return [model.quality(data, offsets)]

        return f

    return B.annotate(df, text_col, [T.StructField(out, T.DoubleType())], scorer, keep)


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learns from four folds of five, scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.withColumn("held_out", B.fold("doc_id", 5) == 0), model, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_good(spark, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: keeps the rows of docs with a quality of `least` or more.

    Null, empty and blank texts have no line and score 0, so they go; a long text is scored whole. Repeated
    rows stay or go together, a null id takes part. Without labels of both classes every text with a line
    stays. An empty table stays empty. Columns of any name pass through.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = B.free(docs, "_quality")
    return score(docs, model, out=mark).where(F.col(mark) >= least).select(*docs.columns)
